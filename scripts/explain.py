"""Print the formatted physical plan of registered queries.

    python scripts/explain.py /root/testdata/sf0.01 nation_flows [name ...]

With ``--run`` the query is executed first, so the adaptive (AQE) final
plan is shown instead of the initial one.
"""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from flowtally.plans import QUERIES  # noqa: E402
from flowtally.session import build_session  # noqa: E402


def main(argv: list[str]) -> int:
    run = "--run" in argv
    args = [a for a in argv if a != "--run"]
    if len(args) < 2:
        print(__doc__)
        return 2
    table_dir, names = args[0], args[1:]
    spark = build_session()
    for name in names:
        df = QUERIES[name](spark, table_dir)
        if run:
            df.collect()
        print(f"==== {name} ====")
        df.explain(mode="formatted")
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
