"""flowtally: activity and transfer-flow analytics as Spark DataFrame operators.

Every operator takes DataFrames and column names and returns a lazy
DataFrame; nothing is collected to the driver.  Table loading and the
query catalog live in ``flowtally.sources`` and ``flowtally.plans``.
"""

__version__ = "0.1.0"
