"""Randomized event tables: every events query equals its oracle SQL.

Tables mix nulls in every column, negative and zero amounts, malformed and
non-integer JSON, and sparse days.  Event ids are unique, as in the driver's
data (the streaming query deduplicates ids, the oracle SQL does not).
"""

from __future__ import annotations

import datetime as dt
import os
import random
import tempfile

import pytest

import __spark_entry__ as contract
from flowtally.plans import QUERIES
from tests.fixtures import write_events
from tests.oracle_check import compare, duck_connect

PROPS = ['{"k": 1}', '{"k": 2}', '{"k": -7}', '{"k": "x"}', '{"k": 2.5}', "{bad", None, '{"j": 1}', "[1, 2]"]
TYPES = ["click", "view", "purchase", "signup", "error", "refund", None]


def random_events(seed: int, n: int) -> list[tuple]:
    rnd = random.Random(seed)
    start = dt.datetime(2023, 12, 25)
    days = rnd.sample(range(45), rnd.randrange(1, 12))  # sparse active days
    rows = []
    for i in range(n):
        ts = None if rnd.random() < 0.05 else start + dt.timedelta(
            days=rnd.choice(days), microseconds=rnd.randrange(86_400_000_000))
        user = None if rnd.random() < 0.08 else rnd.randrange(0, 25)
        value = None if rnd.random() < 0.07 else round(rnd.uniform(-50, 800), 2) * rnd.choice((1, 1, 1, 0))
        rows.append((i, ts, user, rnd.choice(TYPES), value, rnd.choice(PROPS)))
    return rows


@pytest.mark.parametrize("seed,n", [(1, 200), (2, 1), (3, 300), (4, 10)])
def test_random_tables_match_oracle(spark, seed, n):
    d = tempfile.mkdtemp(prefix="flowtally-random-")
    write_events(os.path.join(d, "events.parquet"), random_events(seed, n))
    con = duck_connect(d, ["events"])
    sql = contract.oracle_sql()
    for name, fn in QUERIES.items():
        if name.endswith("nation_flows"):
            continue
        assert compare(fn(spark, d), con, sql[name]) == [], (name, seed, n)
