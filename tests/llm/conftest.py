from __future__ import annotations

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def doc_rows(pairs):
    return [(d, t, "en", "s", None if t is None else len(t)) for d, t in pairs]


@pytest.fixture(scope="session")
def make_docs(spark):
    """``documents`` from (doc_id, text) pairs, over several partitions."""

    def make(pairs, parts=3):
        return spark.createDataFrame(doc_rows(pairs), DOC_SCHEMA).repartition(parts)

    return make


# Nulls, empty texts, ties, repeated rows, odd blanks, non-ASCII, NUL.
EDGE_TEXTS = [
    (1, None), (2, ""), (3, "   \t\n"), (4, "one"), (5, "One two THREE"), (6, "one two three four five six seven"),
    (7, "one two three four five six seven"), (7, "one two three four five six seven"), (None, "one two three four five six seven"),
    (None, None), (8, "É é ÀB\x0bc\x0cd\x00e\x85f g h \x1c\x1d"), (9, "x" * 5000), (10, "a b " * 3000),
    (11, "日本語 テキスト 1234567890123456 ' it's we'll DON'T  \r\n\r\n  end "), (12, "\U0001f600 emoji \U0001f468‍\U0001f469‍\U0001f467"),
    (2**62, "big id"), (-5, "negative id one two three four five six seven eight nine ten eleven twelve"),
]
