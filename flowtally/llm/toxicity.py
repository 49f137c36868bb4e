"""Toxicity classifier with counterfactual regularisation.

A logistic model over the presence of words and of word beginnings (3 to 8
bytes of a longer word), in lower case and with punctuation as blanks.  It is fitted on a bounded sample of labelled
documents.  For every one a counterfactual is made: each identity term is
swapped for another of its group; a text without any gets a neutral mention.
The squared difference of the two scores (before the logistic function) is part
of the loss, so that a group's name alone moves no score.  The groups are a
parameter (by default words of four languages), since a term that no labelled
text holds cannot be learnt and so need not be swapped; the fitted model says
how many texts were swapped.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtally.llm.common import filter_by_text, held_out, text_pieces, write_table
from flowtally.llm.langid import labelled_sample
from flowtally.llm.words import hash_words, in_sorted, mix, word_edges

PREFIXES = (3, 4, 5, 6, 7, 8)
SIGNIFICANT = 24.0  # G-squared at about one in a million, for the many features tried
FILTER_BITS = 20
LETTERS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))

# Identity terms in English, German, Spanish and French, in groups
# whose members stand for each other.
IDENTITY_GROUPS = (
    ("women", "men"),
    ("woman", "man"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrant", "native", "refugee"),
    ("disabled", "blind", "deaf"),
    ("old", "young"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("schwul", "lesbisch", "bisexuell", "transsexuell"),
    ("muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch", "atheistisch"),
    ("schwarze", "weiße", "asiatische", "afrikanische", "europäische"),
    ("einwanderer", "flüchtling", "einheimischer"),
    ("behindert", "blinde", "gehörlos"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("homosexual", "heterosexual", "lesbiana", "bisexual", "transexual"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"),
    ("negro", "blanco", "asiático", "africano", "europeo"),
    ("inmigrante", "refugiado", "nativo"),
    ("discapacitado", "ciego", "sordo"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("homosexuel", "hétérosexuel", "lesbienne", "bisexuel", "transgenre"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
    ("noir", "blanc", "asiatique", "africain", "européen"),
    ("immigré", "réfugié", "natif"),
    ("handicapé", "aveugle", "sourd"),
)


class Swaps:
    """Counterfactuals of normalised texts by groups of identity terms."""

    def __init__(self, groups=IDENTITY_GROUPS):
        self.other: dict[bytes, bytes] = {}
        for g in groups:
            for i, t in enumerate(g):  # a term of several groups is swapped in the first
                self.other.setdefault(normalised(t.encode()).strip(), normalised(g[(i + 1) % len(g)].encode()).strip())
        self.terms = list(self.other)
        found = b"|".join(map(re.escape, sorted(self.other, key=len, reverse=True)))
        self.pattern = re.compile(rb"(?<![^ ])(" + found + rb")(?![^ ])") if self.other else None

    def holds(self, text: bytes) -> bool:
        return bool(self.pattern and self.pattern.search(text))

    def counterfactual(self, text: bytes, nth: int) -> bytes:
        """``text`` with every identity term swapped; one without any gets a
        mention, another one for each ``nth``."""
        if not self.pattern:
            return text
        swapped, n = self.pattern.subn(lambda m: self.other[m[1]], text)
        return swapped if n else text + b" " + self.terms[nth % len(self.terms)] + b" "


def normalised(data: bytes | None) -> bytes:
    return (data or b"").translate(LETTERS)


def text_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, 64-bit hash) of every word and word beginning of normalised
    texts, repeats included."""
    joined = b" ".join(texts) + b" " * max(PREFIXES)
    data = np.frombuffer(joined, np.uint8)
    start, end = word_edges(data)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc = np.searchsorted(np.cumsum([0, *(len(t) + 1 for t in texts)]), start, "right") - 1
    code = np.zeros(len(start), np.uint64)
    docs, hashes = [doc], [hash_words(data, start, end, 3)]
    for k in range(1, max(PREFIXES) + 1):
        code |= data[start + (k - 1)].astype(np.uint64) << np.uint64(8 * (k - 1))
        if k in PREFIXES:
            longer = end - start > k
            docs.append(doc[longer])
            hashes.append(mix(code[longer] + np.uint64(k)))
    return np.concatenate(docs), np.concatenate(hashes)


class Presence:
    """Looks up which of the chosen features a text has."""

    def __init__(self, features: np.ndarray):
        self.features = np.sort(features)
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[self._short(self.features)] = True

    @staticmethod
    def _short(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def pairs(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, feature number)."""
        doc, h = text_features(texts)
        at = np.flatnonzero(self.maybe[self._short(h)])
        doc, h = doc[at], h[at]
        known = in_sorted(h, self.features)
        width = len(self.features) + 1
        pair = np.unique(doc[known] * width + np.searchsorted(self.features, h[known]))
        return pair // width, pair % width


class ToxicityModel:
    """Weights of the chosen features; ``swapped`` of the training texts held
    identity terms, and ``moved`` counterfactuals differ in a feature."""

    def __init__(self, presence: Presence, weight: np.ndarray, bias: float, swapped: int = 0, moved: int = 0):
        self.presence, self.weight, self.bias, self.swapped, self.moved = presence, weight, bias, swapped, moved

    def scores(self, data: list[bytes | None]) -> np.ndarray:
        """Probability of label 1 for whole texts."""
        doc, feature = self.presence.pairs([normalised(t) for t in data])
        z = np.bincount(doc, self.weight[feature], minlength=len(data)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _dense(texts: list[bytes], presence: Presence) -> np.ndarray:
    x = np.zeros((len(texts), len(presence.features)), np.float32)
    for i in range(0, len(texts), 200):
        doc, feature = presence.pairs(texts[i : i + 200])
        x[i + doc, feature] = 1
    return x


def _counts(texts: list[bytes], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of three texts or more, and in how many of each label."""
    found = []
    for i in range(0, len(texts), 200):
        doc, h = text_features(texts[i : i + 200])
        order = np.lexsort((doc, h))
        doc, h = doc[order], h[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
        found.append((h[new], labels[i + doc[new]]))
    h, y = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(h, kind="stable")
    h, y = h[order], y[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    total = np.diff(np.concatenate([first, [len(h)]]))
    ones = np.add.reduceat(y, first) if len(h) else total
    often = total >= 3
    return h[first][often], np.stack([total - ones, ones])[:, often]


def _likelihood_ratio(seen: np.ndarray, total: np.ndarray) -> np.ndarray:
    """G-squared of presence against label; ``seen`` (labels, features)."""
    n, present = total.sum(), seen.sum(axis=0)
    out = np.zeros(seen.shape[1])
    for count, margin in ((seen, present), (total[:, None] - seen, n - present)):
        expected = margin * (total[:, None] / n)
        ratio = np.divide(count, expected, out=np.ones(expected.shape), where=(count > 0) & (expected > 0))
        out += 2 * (count * np.log(ratio)).sum(axis=0)
    return out


def fit_model(texts: list[bytes], labels: np.ndarray, features: int = 1024, penalty: float = 1.0, ridge: float = 1e-5, steps: int = 600, groups=IDENTITY_GROUPS) -> ToxicityModel:
    """Selects the features whose presence tells most (and significantly) about
    the label and fits
    logistic loss + ``penalty`` x mean squared counterfactual change + ``ridge``."""
    texts, swaps = [normalised(t) for t in texts], Swaps(groups)
    swapped = sum(map(swaps.holds, texts))
    candidates, seen = _counts(texts, labels)
    gain = _likelihood_ratio(seen, np.bincount(labels, minlength=2))
    best = np.argsort(-gain, kind="stable")[:features]
    presence = Presence(candidates[best[gain[best] >= SIGNIFICANT]])
    if not len(presence.features):
        share = float(np.clip(labels.mean(), 1e-6, 1 - 1e-6))
        return ToxicityModel(presence, np.zeros(1), math.log(share / (1 - share)), swapped)
    x, other = _dense(texts, presence), _dense([swaps.counterfactual(t, i) for i, t in enumerate(texts)], presence)
    change, y = other - x, labels.astype(np.float32)
    w, b, n = np.zeros(x.shape[1], np.float32), 0.0, len(y)
    share = (1 / (2 * np.bincount(labels, minlength=2).clip(1)))[labels].astype(np.float32)  # both labels weigh the same
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        error = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) * share
        g = x.T @ error + penalty * 2 / n * (change.T @ (change @ w)) + ridge * w
        gb = float(error.sum())
        m, s = m + 0.1 * (g - m), s + 0.01 * (g * g - s)
        mb, sb = mb + 0.1 * (gb - mb), sb + 0.01 * (gb * gb - sb)
        f, v = 1 - 0.9**step, 1 - 0.99**step
        w = w - 0.1 * (m / f) / (np.sqrt(s / v) + 1e-8)
        b -= 0.1 * (mb / f) / (math.sqrt(sb / v) + 1e-8)
    return ToxicityModel(presence, w.astype(np.float64), b, swapped, int(change.any(axis=1).sum()))


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = 2000, groups=IDENTITY_GROUPS) -> ToxicityModel | None:
    """Model from at most ``per_label`` documents of each label; ``labels``
    rows that are held out or null, and labels of unknown documents or of ones
    without a text, are left out before the draw.  None without labelled documents."""
    train = labels.where(~held_out("doc_id") & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    # only labels of documents with a text are drawn from (ids alone are shuffled)
    with_text = docs.where("text IS NOT NULL").select("doc_id").distinct()
    train = train.select("doc_id", "toxic").distinct().join(with_text, "doc_id", "left_semi")
    train = write_table(train, "toxicity-labels").withColumn("text", F.lit(""))
    sample = labelled_sample(train, per_label, "toxic", "doc_id").select("doc_id", "toxic")
    # the sample has 2 x per_label rows at most, whatever the tables; of rows
    # that repeat a doc_id one text is taken
    found = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(sample), "doc_id")
    rows = found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.doc_id, r.text, r.toxic))
    return fit_model([r.text.encode() for r in rows], np.array([r.toxic for r in rows]), groups=groups)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every whole text; null is an
    empty text.  Without a model every score is 0."""

    def run(batches):
        for b in text_pieces(batches, 2 << 20):
            data = b.column("text").to_pylist()
            score = model.scores(data) if model and data else np.zeros(len(data))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return source.select("doc_id", "text", held_out("doc_id").alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the training labels and score every document.  Null and empty
    texts are scored like any other; repeated rows, and rows with a null id
    (never held out), are scored each; without labelled documents every score
    is 0; columns that are not named are never read."""
    return score_toxicity(docs, fit_toxicity(docs, labels))


def drop_toxic(docs: DataFrame, model: ToxicityModel | None, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, unchanged, that score under ``threshold``."""
    if model is None:
        return docs
    return filter_by_text(docs, lambda data: (model.scores(data) < threshold).tolist() if data else [])
