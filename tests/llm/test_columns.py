"""Extra columns with the operators' own names change nothing, and empty
tables and null texts give what the docstrings say."""

from __future__ import annotations

import pytest

from flowtally.llm import bpe, chat_format, decontaminate, itq, langid, license_scan, secret_scan, simhash, source_divergence, substring_dedup, toxicity
from flowtally.llm.queries import vocabulary
from tests.llm.conftest import EDGE_TEXTS

NAMES = (
    "a", "at", "b", "base", "base_labels", "blob", "bucket", "code", "component", "component_id", "conv", "docs", "doc", "draw", "fingerprint", "fp", "found",
    "held", "held_out", "h", "ids", "item", "items", "key", "kind", "label", "labels", "left", "n", "n_words", "node", "p", "part", "piece", "position", "q", "rank",
    "rep", "right", "row", "rows", "score", "seq", "size", "sizes", "spans", "start", "tokens", "total", "value", "word", "words", "x", "__key", "__base", "__tokens", "__spans",
)

TEXTS = [*EDGE_TEXTS, (40, "under the MIT license token=abcdefghijklmnop deadbeefdeadbeef"), (41, "word " * 50 + "one two three"), (42, "word " * 50 + "one two three")]
TOXIC = toxicity.fit_model([b"good words here"] * 5 + [b"vile words here"] * 5, __import__("numpy").array([0] * 5 + [1] * 5))
TAGGER = langid.ByteTagger(["en", "de"])


def benchmark(docs):
    return docs.sparkSession.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")


OPERATORS = {
    "simhash": lambda d: simhash.near_duplicate_groups(d),
    "decontamination": lambda d: decontaminate.decontamination(d, benchmark(d)),
    "licences": lambda d: license_scan.license_scan(d),
    "secrets": lambda d: secret_scan.secret_scan(d),
    "bpe": lambda d: bpe.bpe_round_trip(d, *vocabulary()),
    "substrings": lambda d: substring_dedup.dedup_substrings(d, window=20, digest=True),
    "language": lambda d: langid.predict_language(d, TAGGER),
    "toxicity": lambda d: toxicity.score_toxicity(d, TOXIC),
    "divergence": lambda d: source_divergence.source_divergence(d, min_docs=2),
}
FILTERS = {
    "simhash": lambda d: simhash.drop_near_duplicates(d),
    "decontamination": lambda d: decontaminate.drop_contaminated(d, benchmark(d)),
    "secrets": lambda d: secret_scan.redact_secrets(d),
    "toxicity": lambda d: toxicity.drop_toxic(d, TOXIC),
}


def clashing(df):
    have = {c.lower() for c in df.columns}
    return df.selectExpr("*", *(f"'{n}!' AS `{n}`" for n in NAMES if n not in have))


def rows(df):
    return sorted((str(tuple(r)) for r in df.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(make_docs, name):
    docs, run = make_docs(TEXTS * 2), OPERATORS[name]
    plain = rows(run(docs))
    assert rows(run(clashing(docs))) == plain
    assert name == "divergence" or len(plain) == 2 * len(TEXTS)
    assert rows(run(clashing(docs).limit(0))) == []


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_all_columns(make_docs, name):
    docs, run = make_docs(TEXTS), FILTERS[name]
    kept, plain = run(clashing(docs)), run(docs)
    assert kept.columns == clashing(docs).columns and plain.columns == docs.columns
    assert rows(kept.select(*docs.columns)) == rows(plain)
    extra = [c for c in kept.columns if c not in docs.columns]
    assert {tuple(r) for r in kept.select(*(f"`{c}`" for c in extra)).distinct().collect()} == {tuple(f"{n}!" for n in extra)}
    assert rows(run(clashing(docs).limit(0))) == []


def test_vectors_and_conversations(spark):
    vectors = spark.createDataFrame([(i, [1.0 * i, 2.0, 0.1], i % 2) for i in range(1, 9)], "vec_id long, embedding array<double>, label int")
    assert rows(itq.near_duplicate_vectors(clashing(vectors))) == rows(itq.near_duplicate_vectors(vectors))
    turns = spark.createDataFrame([(i % 4, i // 4, "user", f"t{i // 8}") for i in range(16)], "conv_id long, turn long, role string, text string")
    run = lambda d: rows(chat_format.conversation_digests(chat_format.format_conversations(d)))
    assert run(clashing(turns)) == run(turns)
