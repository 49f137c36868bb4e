"""Every registered query equals its oracle SQL (DuckDB) on the driver's
sf0.001 tables and on the hand-made fixture."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from flowtally.plans import ORACLE_SQL, QUERIES
from tests.conftest import SF0001
from tests.oracle_check import compare, duck_connect

NAMES = sorted(QUERIES)
EVENT_ONLY = [n for n in NAMES if not n.endswith("nation_flows")]


def test_contract_keys_match():
    assert set(QUERIES) == set(ORACLE_SQL) and set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_smoke(spark):
    df = contract.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["src_nation", "dst_nation", "n_lines", "n_orders", "n_customers", "revenue"]


@pytest.fixture(scope="module")
def duck_sf0001():
    return duck_connect(SF0001)


@pytest.mark.parametrize("name", NAMES)
def test_sf0001_matches_oracle(spark, duck_sf0001, name):
    df = contract.queries()[name](spark, SF0001)
    assert compare(df, duck_sf0001, contract.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", EVENT_ONLY)
def test_fixture_matches_oracle(spark, fixture_dir, name):
    con = duck_connect(fixture_dir, ["events"])
    df = contract.queries()[name](spark, fixture_dir)
    assert compare(df, con, contract.oracle_sql()[name]) == []
