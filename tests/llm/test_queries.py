"""The registered queries on the driver's tables: against their SQL where they
have one, else against plain Python."""

from __future__ import annotations

import zlib

import pytest

from flowtally.llm.oracle import ORACLE_SQL
from flowtally.llm.queries import QUERIES
from tests.conftest import SF001, SF0001
from tests.llm import brute
from tests.oracle_check import compare, duck_connect


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("sf_dir", [SF0001, SF001])
def test_oracle(spark, name, sf_dir):
    assert compare(QUERIES[name](spark, sf_dir), duck_connect(sf_dir), ORACLE_SQL[name]) == []


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect()]


def test_simhash(spark, documents):
    assert rows(QUERIES["op1_simhash"](spark, SF0001)) == sorted(brute.op1(documents), key=str)


def test_warc(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF0001}/pages.parquet").select("page_id", "html").collect()]
    assert rows(QUERIES["op2_warc"](spark, SF0001)) == sorted(brute.op2(pages), key=str)


def test_licenses(spark, documents):
    got = QUERIES["op4_license_scan"](spark, SF0001).drop("labels", "score")
    assert rows(got) == sorted(brute.op4_base(documents), key=str)


def test_secrets(spark, documents):
    got = QUERIES["op5_secret_scan"](spark, SF0001)
    want, spans = brute.op5_base(documents)
    assert rows(got.drop("spans")) == sorted(want, key=str)
    by_id = {r.doc_id: set(r.spans.split(",")) for r in got.collect()}
    assert all(set(s) <= by_id[d] for (d, _), s in zip(documents, spans))


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_languages(spark):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = QUERIES["op9_language_id"](spark, SF001).collect()
    assert len(got) == len(truth) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in test) / len(test) > 0.95


def test_toxicity(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
    got = QUERIES["op10_toxicity"](spark, SF001).collect()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    test = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in test) / len(test) > 0.9
