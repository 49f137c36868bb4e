"""Summarize each query's executed plan: scans, shuffles, reused shuffles,
broadcasts, sort-merge joins and windows, with Spark's default broadcast
threshold and with broadcasts disabled (how large tables are planned).

    python scripts/plan_report.py /root/testdata/sf0.01
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from flowtally.plans import QUERIES  # noqa: E402
from flowtally.session import build_session  # noqa: E402

NO_BROADCAST = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


def summarize(df) -> dict[str, int]:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    count = lambda pat: len(re.findall(pat, plan))
    return {
        "scans": count(r"FileScan parquet"),
        "shuffles": count(r"ShuffleQueryStage"),
        "reused": count(r"ReusedExchange"),
        "broadcasts": count(r"BroadcastQueryStage"),
        "smj": count(r"SortMergeJoin"),
        "windows": count(r"\bWindow \["),
    }


def main() -> None:
    table_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    names = [n for n in QUERIES if n != "streaming_daily_counts"]
    rows = {}
    for label, conf in (("default", {}), ("no-broadcast", NO_BROADCAST)):
        for k, v in conf.items():
            spark.conf.set(k, v)
        for name in names:
            rows.setdefault(name, {})[label] = summarize(QUERIES[name](spark, table_dir))
        for k in conf:
            spark.conf.unset(k)
    print("| query | scans | shuffles (reused) | broadcasts | SMJ | windows | no-broadcast: shuffles (reused) / SMJ |")
    print("| --- | --- | --- | --- | --- | --- | --- |")
    for name in names:
        d, n = rows[name]["default"], rows[name]["no-broadcast"]
        print(f"| `{name}` | {d['scans']} | {d['shuffles']} ({d['reused']}) | {d['broadcasts']} | {d['smj']} | "
              f"{d['windows']} | {n['shuffles']} ({n['reused']}) / {n['smj']} |")
    spark.stop()


if __name__ == "__main__":
    main()
