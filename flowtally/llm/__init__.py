"""Operations for large text corpora.

Every operator takes and returns DataFrames; nothing outside this subpackage
imports it.  The registered queries are in ``queries``, their SQL in
``oracle``.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the job that uses
# them, so a cluster needs no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
