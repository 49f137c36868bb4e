"""Corpus pipeline: five filtering or rewriting stages over ``documents``.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; the caller (or ``run``)
writes its result as Parquet and passes the reread table to the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowtally.llm.bpe import bpe_round_trip
from flowtally.llm.common import read_table, write_table
from flowtally.llm.decontaminate import drop_contaminated
from flowtally.llm.queries import vocabulary
from flowtally.llm.secret_scan import redact_secrets
from flowtally.llm.simhash import drop_near_duplicates
from flowtally.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring 0.7 or more go."""
    return drop_toxic(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays."""
    return drop_near_duplicates(docs, shingle_words=4, max_bits=4)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents holding a benchmark window go."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"), window=10)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are blanked out."""
    return redact_secrets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded texts."""
    return bpe_round_trip(docs, *vocabulary())


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", secrets),
    ("byte_bpe", tokens),
]

#: A fitted classifier and the token ids are beyond SQL: tested against a
#: brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_table(docs, f"pipeline-{name}")
    return docs
