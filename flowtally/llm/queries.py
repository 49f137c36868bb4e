"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowtally.llm.bpe import bpe_round_trip
from flowtally.llm.chat_format import conversation_digests, format_conversations
from flowtally.llm.common import read_table
from flowtally.llm.decontaminate import decontamination
from flowtally.llm.itq import near_duplicate_vectors
from flowtally.llm.langid import identify_languages
from flowtally.llm.license_scan import license_scan
from flowtally.llm.secret_scan import secret_scan
from flowtally.llm.simhash import near_duplicate_groups
from flowtally.llm.source_divergence import source_divergence
from flowtally.llm.substring_dedup import dedup_substrings
from flowtally.llm.toxicity import toxicity
from flowtally.llm.vector_codes import compress_vectors
from flowtally.llm.warc import warc_round_trip

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary() -> tuple[str, str]:
    """Path of the public rank file and its pre-token pattern."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(read_table(spark, sf_dir, "documents"), shingle_words=4, max_bits=4)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(read_table(spark, sf_dir, "pages"), min_bytes=0)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), window=10)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read_table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"), min_cosine=0.98)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(read_table(spark, sf_dir, "documents"), *vocabulary())


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read_table(spark, sf_dir, "documents"), window=20, digest=True)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(read_table(spark, sf_dir, "embeddings"), parts=16, rounds=2)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read_table(spark, sf_dir, "documents"), min_docs=3, top_terms=200)


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"  # a conversation of control strings
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema))
    return conversation_digests(format_conversations(rows))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_warc, op3_decontamination, op4_license_scan, op5_secret_scan,
        op6_embedding_dedup, op7_byte_bpe, op8_substring_dedup, op9_language_id, op10_toxicity,
        op11_vector_codes, op12_source_divergence, op13_chat_format,
    )
}
