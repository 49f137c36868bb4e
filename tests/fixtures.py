"""Small hand-made ``events`` rows for the cases the driver tables lack."""

from __future__ import annotations

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq

EVENTS_SCHEMA = pa.schema(
    [
        ("event_id", pa.int64()),
        ("ts", pa.timestamp("us")),  # no zone -> TIMESTAMP_NTZ in Spark
        ("user_id", pa.int64()),
        ("event_type", pa.string()),
        ("value", pa.float64()),
        ("props", pa.string()),
    ]
)


def T(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def event_rows() -> list[tuple]:
    rows = [
        # user 1: first seen in week of 2024-01-01, back in weeks 2 and 4
        (1, T("2024-01-01 00:00:00"), 1, "purchase", 10.00, '{"k": 1}'),
        (2, T("2024-01-02 13:30:00"), 1, "view", 0.50, '{"k": 1}'),
        (3, T("2024-01-09 09:00:00"), 1, "purchase", 250.00, '{"k": 2}'),
        (4, T("2024-01-23 18:00:00"), 1, "click", 99.99, '{"k": 2}'),
        # user 2: first seen in week 2 (2024-01-08), active in week 3
        (5, T("2024-01-10 23:59:59.999999"), 2, "signup", 49.99, '{"k": 3}'),
        (6, T("2024-01-11 00:00:00"), 2, "purchase", 100.00, "not json"),
        (7, T("2024-01-21 12:00:00"), 2, "purchase", 5.00, '{"k": "abc"}'),
        # no rows from 2024-01-12 to 2024-01-20: gap days
        # user 3: first seen in week 4
        (8, T("2024-01-24 08:00:00"), 3, "error", 0.01, '{"j": 3}'),
        # month boundary at midnight
        (9, T("2024-01-31 23:59:59.999999"), 3, "purchase", 1000.00, '{"k": null}'),
        (10, T("2024-02-01 00:00:00"), 3, "purchase", 0.00, '{"k": {"a": 1}}'),
        # nulls in every nullable column
        (11, T("2024-01-02 10:00:00"), None, "view", 3.25, '{"k": 4}'),
        (12, T("2024-01-02 11:00:00"), 4, None, 7.75, '{"k": 4}'),
        (13, T("2024-01-03 11:00:00"), 4, "click", None, '{"k": 5'),
        (14, None, 5, "click", 1.00, None),
        (15, T("2024-01-03 12:00:00"), 5, "view", -12.50, '{"k": -1}'),
    ]
    # equal totals at the top-k cut: users 10..21 each spend exactly 5.00 on
    # one purchase (user 2 also reaches 155.00 in total)
    eid = 100
    for user in range(10, 22):
        rows.append((eid, T("2024-01-05 10:00:00"), user, "purchase", 5.00, '{"k": 9}'))
        eid += 1
    return rows


def write_events(path: str, rows: list[tuple] | None = None) -> None:
    rows = event_rows() if rows is None else rows
    cols = list(zip(*rows))
    table = pa.table({f.name: pa.array(c, type=f.type) for f, c in zip(EVENTS_SCHEMA, cols)})
    pq.write_table(table, path)


def skewed_event_rows(n: int = 3000, seed: int = 11) -> list[tuple]:
    """Events where actor 7 and category "purchase" each hold about a third
    of the rows, spread over 60 days with some idle days."""
    import random

    rnd = random.Random(seed)
    types = ["click", "view", "signup", "error"]
    rows = []
    for i in range(n):
        hot = rnd.random() < 0.34
        user = 7 if hot else rnd.randrange(1, 400)
        etype = "purchase" if rnd.random() < 0.34 else rnd.choice(types)
        day = rnd.randrange(0, 60)
        if day % 9 == 4:  # idle days
            day += 1
        ts = dt.datetime(2024, 3, 1) + dt.timedelta(days=day, seconds=rnd.randrange(0, 86400))
        value = round(rnd.choice([rnd.uniform(0, 20), rnd.uniform(0, 5000)]), 2)
        rows.append((i, ts, user, etype, value, f'{{"k": {rnd.randrange(0, 12)}}}'))
    return rows


def write_skewed_flow_tables(folder: str, seed: int = 5) -> None:
    """TPC-H-shaped tables where customer 1 places a third of the orders and
    supplier 2 ships a third of the line items."""
    import os
    import random

    rnd = random.Random(seed)

    def write(name, schema, rows):
        cols = list(zip(*rows))
        table = pa.table({f.name: pa.array(c, type=f.type) for f, c in zip(schema, cols)})
        pq.write_table(table, os.path.join(folder, f"{name}.parquet"))

    write("nation", pa.schema([("n_nationkey", pa.int32()), ("n_name", pa.string()), ("n_regionkey", pa.int32())]),
          [(k, f"N{k}", k % 5) for k in range(25)])
    write("customer", pa.schema([("c_custkey", pa.int64()), ("c_nationkey", pa.int32())]),
          [(c, rnd.randrange(25)) for c in range(1, 41)])
    write("supplier", pa.schema([("s_suppkey", pa.int64()), ("s_nationkey", pa.int32())]),
          [(s, rnd.randrange(25)) for s in range(1, 11)])
    orders = [(o, 1 if rnd.random() < 0.34 else rnd.randrange(1, 41)) for o in range(1, 601)]
    write("orders", pa.schema([("o_orderkey", pa.int64()), ("o_custkey", pa.int64())]), orders)
    lines = []
    for o, _ in orders:
        for _ in range(rnd.randrange(1, 6)):
            supp = 2 if rnd.random() < 0.34 else rnd.randrange(1, 11)
            lines.append((o, supp, round(rnd.uniform(1, 90000), 2), rnd.randrange(0, 11) / 100))
    # corrections with negative prices: the revenue split must stay exact
    lines += [(3, 2, -1234.56, 0.05), (4, 5, -99999.99, 0.0), (4, 5, -0.01, 0.1)]
    write("lineitem", pa.schema([("l_orderkey", pa.int64()), ("l_suppkey", pa.int64()),
                                 ("l_extendedprice", pa.float64()), ("l_discount", pa.float64())]), lines)


def split_into_files(folder: str, name: str, parts: int) -> None:
    """Rewrite ``<name>.parquet`` as a folder of ``parts`` files, so Spark
    reads it with several map tasks."""
    import os

    path = os.path.join(folder, f"{name}.parquet")
    table = pq.read_table(path)
    os.remove(path)
    os.makedirs(path)
    n = table.num_rows
    for i in range(parts):
        lo, hi = i * n // parts, (i + 1) * n // parts
        pq.write_table(table.slice(lo, hi - lo), os.path.join(path, f"part-{i:03d}.parquet"))
