"""Language identification with a bidirectional gated recurrent network.

The network reads bytes.  Its state starts anew at every word (a run of bytes
without white space, with a space on either side), so a word's result does not
depend on its neighbours and is computed once per worker for all its
occurrences.  A word over ``SEGMENT`` bytes, such as a text without blanks, is
read in windows that begin and end between characters and see ``CONTEXT`` bytes
beyond either end.  Every byte position gets a distribution over the languages;
a document's is the mean over all positions of the whole text.

It is trained in numpy by backpropagation through time on a bounded sample of
labelled documents; prediction runs in Arrow batches on the executors.  Words
are evaluated in tiles of fixed size, so that a score does not depend on which
others are evaluated with it, nor on the partitions of the table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtally.llm.common import held_out, text_pieces
from flowtally.llm.words import hash_words, in_sorted, word_edges

SEGMENT = 64  # bytes of a word read at once
CONTEXT = 16  # bytes of a longer word seen on either side of a window
TILE = 256  # words evaluated together
LETTER = re.compile(rb"[A-Za-z]")


def _between(word: bytes, at: int) -> int:
    """``at``, or the beginning of the character that it falls into."""
    for k in range(at, max(at - 4, 0), -1):
        if word[k] & 0xC0 != 0x80:
            return k
    return at


def windows(word: bytes) -> list[tuple[bytes, int, int]]:
    """``(bytes, lead, tail)``: the windows of a framed word; its first
    ``lead`` and last ``tail`` bytes are context."""
    framed = b" " + word + b" "
    cuts = [0, *(_between(framed, k) for k in range(SEGMENT, len(framed) - 3, SEGMENT)), len(framed)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        low = _between(framed, a - CONTEXT) if a > CONTEXT else 0
        high = _between(framed, b + CONTEXT) if b + CONTEXT < len(framed) else len(framed)
        out.append((framed[low:high], a - low, high - b))
    return out


def segments(text: bytes) -> list[bytes]:
    """Words of a whole text for training, A-Z in lower case; of long words the
    windows without context."""
    out = []
    for word in text.lower().split():
        out += [word] if len(word) <= SEGMENT else [w[lead : len(w) - tail].strip() for w, lead, tail in windows(word)]
    return [w for w in out if w]


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Gru:
    """One direction: parameters, forward pass and its gradients."""

    def __init__(self, rng, inputs: int, hidden: int):
        self.h = hidden
        self.p = {
            "w": rng.normal(0, inputs**-0.5, (inputs, 3 * hidden)),
            "u": rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)),
            "b": np.zeros(3 * hidden),
        }

    def forward(self, x: np.ndarray, keep: bool = False):
        """States (steps, rows, hidden) of ``x`` (steps, rows, inputs)."""
        k, u = self.h, self.p["u"]
        h = np.zeros((x.shape[1], k), x.dtype)
        given = x @ self.p["w"] + self.p["b"]
        states, saved = np.empty((len(x), x.shape[1], k), x.dtype), []
        for t in range(len(x)):
            rec = h @ u
            gate = _sigmoid(given[t, :, : 2 * k] + rec[:, : 2 * k])
            z, r = gate[:, :k], gate[:, k:]
            new = np.tanh(given[t, :, 2 * k :] + r * rec[:, 2 * k :])
            if keep:
                saved.append((h, z, r, new, rec[:, 2 * k :]))
            h = new + z * (h - new)
            states[t] = h
        return (states, saved) if keep else states

    def run(self, emb: np.ndarray, words: np.ndarray) -> np.ndarray:
        """States (steps, hidden, rows) of bytes (steps, rows) in single
        precision: the input of a gate is one table entry per byte, and the
        arrays of a gate are contiguous."""
        k = self.h
        table = np.ascontiguousarray((emb @ self.p["w"] + self.p["b"]).T, np.float32)
        turn = np.ascontiguousarray(self.p["u"].T, np.float32)
        h, states = np.zeros((k, words.shape[1]), np.float32), np.empty((len(words), k, words.shape[1]), np.float32)
        for t, byte in enumerate(words):
            given, rec = np.take(table, byte, axis=1), turn @ h
            gate = given[: 2 * k]
            gate += rec[: 2 * k]
            np.reciprocal(1 + np.exp(-gate), out=gate)
            new = np.tanh(rec[2 * k :] * gate[k:] + given[2 * k :])
            h = new + gate[:k] * (h - new)
            states[t] = h
        return states

    def backward(self, x: np.ndarray, saved, d_states: np.ndarray):
        """Gradients of the parameters and of ``x``."""
        grad, dx = {n: np.zeros_like(v) for n, v in self.p.items()}, np.empty_like(x)
        dh = np.zeros_like(d_states[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, new, rec = saved[t]
            dh = dh + d_states[t]
            d_new = dh * (1 - z) * (1 - new * new)
            d_z = dh * (h - new) * z * (1 - z)
            d_r = d_new * rec * r * (1 - r)
            d_given = np.concatenate([d_z, d_r, d_new], axis=1)
            d_rec = np.concatenate([d_z, d_r, d_new * r], axis=1)
            grad["w"] += x[t].T @ d_given
            grad["b"] += d_given.sum(axis=0)
            grad["u"] += h.T @ d_rec
            dx[t] = d_given @ self.p["w"].T
            dh = dh * z + d_rec @ self.p["u"].T
        return grad, dx


class ByteTagger:
    """Bidirectional network from bytes to a language at every position."""

    def __init__(self, languages: list[str], width: int = 8, hidden: int = 12, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.emb = rng.normal(0, 0.3, (256, width))
        self.ahead, self.back = Gru(rng, width, hidden), Gru(rng, width, hidden)
        self.out, self.bias = rng.normal(0, hidden**-0.5, (2 * hidden, len(languages))), np.zeros(len(languages))

    def _parameters(self) -> dict[str, np.ndarray]:
        named = {"emb": self.emb, "out": self.out, "bias": self.bias}
        for name, g in (("ahead", self.ahead), ("back", self.back)):
            named |= {f"{name}.{k}": v for k, v in g.p.items()}
        return named

    def position_sums(self, words: np.ndarray, lead: int = 0, tail: int = 0) -> np.ndarray:
        """Probabilities of the languages, summed over the positions of words
        of one length (rows, steps), as bytes, without the first ``lead`` and
        last ``tail``: (rows, languages)."""
        out = [self._tile_sums(words[k : k + TILE], lead, tail) for k in range(0, len(words), TILE)]
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)

    def _tile_sums(self, words: np.ndarray, lead: int, tail: int) -> np.ndarray:
        n = len(words)
        if n < TILE:  # the same arithmetic for any number of rows
            words = np.concatenate([words, np.zeros((TILE - n, words.shape[1]), np.uint8)])
        ahead, back = self.ahead.run(self.emb, words.T), self.back.run(self.emb, words.T[::-1])[::-1]
        total = np.zeros((len(self.languages), TILE), np.float32)
        for a, b in zip(ahead[lead : len(ahead) - tail], back[lead : len(back) - tail]):
            e = self.out.T @ np.concatenate([a, b]) + self.bias[:, None]
            e = np.exp(e - e.max(axis=0))
            total += e / e.sum(axis=0)
        return total.T[:n]

    def gradients(self, words: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradients."""
        x = self.emb[words.T]
        ahead, saved_a = self.ahead.forward(x, True)
        back, saved_b = self.back.forward(x[::-1], True)
        both = np.concatenate([ahead, back[::-1]], axis=2)
        e = both @ self.out + self.bias
        e = np.exp(e - e.max(axis=2, keepdims=True))
        p = e / e.sum(axis=2, keepdims=True)
        rows, n = np.arange(len(label)), words.size
        loss = -float(np.log(p[:, rows, label] + 1e-12).mean())
        p[:, rows, label] -= 1
        d = p / n
        k = self.ahead.h
        d_both = d @ self.out.T
        grad = {"out": np.tensordot(both, d, axes=((0, 1), (0, 1))), "bias": d.sum(axis=(0, 1))}
        ga, dxa = self.ahead.backward(x, saved_a, d_both[:, :, :k])
        gb, dxb = self.back.backward(x[::-1], saved_b, d_both[::-1, :, k:])
        grad |= {f"ahead.{i}": v for i, v in ga.items()} | {f"back.{i}": v for i, v in gb.items()}
        d_emb = np.zeros_like(self.emb)
        np.add.at(d_emb, words.T, dxa + dxb[::-1])
        grad["emb"] = d_emb
        return loss, grad

    def fit(self, words: list[bytes], labels: np.ndarray, steps: int = 400, rows: int = 256, rate: float = 0.01, seed: int = 0) -> None:
        """Adam on batches of words of one length, drawn as often as they occur."""
        rng = np.random.default_rng(seed)
        lengths = np.array(list(map(len, words)))
        groups = [(np.flatnonzero(lengths == n), n) for n in np.unique(lengths)]
        packed = [(labels[at], np.frombuffer(b"".join(words[i] for i in at), np.uint8).reshape(-1, n)) for at, n in groups]
        share = np.array([len(at) * n for at, n in groups], float)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self._parameters().items()}
        for step in range(1, steps + 1):
            label, data = packed[rng.choice(len(packed), p=share / share.sum())]
            pick = rng.integers(0, len(label), min(rows, len(label)))
            _, grad = self.gradients(_framed(data[pick]), label[pick])
            scale = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, v in self._parameters().items():
                m, s = moments[k]
                m += 0.1 * (grad[k] - m)
                s += 0.01 * (grad[k] ** 2 - s)
                v -= scale * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)


def _framed(words: np.ndarray) -> np.ndarray:
    space = np.full((len(words), 1), 0x20, np.uint8)
    return np.concatenate([space, words, space], axis=1)


class WordScores:
    """Summed position probabilities of words, each computed once while it is
    remembered: by 64-bit hash, ``limit`` words at most (beyond that the memory
    starts anew, which only costs time)."""

    def __init__(self, model: ByteTagger, limit: int = 1_000_000):
        self.model, self.limit = model, limit
        self.hashes = np.zeros(0, np.uint64)
        self.table = np.zeros((0, len(model.languages) + 1), np.float32)  # sums, and positions

    def _evaluate(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.zeros((len(start), self.table.shape[1]), np.float32)
        for n in np.unique(size[size <= SEGMENT]):
            at = np.flatnonzero(size == n)
            out[at, :-1] = self.model.position_sums(_framed(data[start[at][:, None] + np.arange(n)]))
        shapes: dict[tuple[int, int, int], list[tuple[int, bytes]]] = {}
        for row in np.flatnonzero(size > SEGMENT).tolist():
            for w, lead, tail in windows(data[start[row] : start[row] + size[row]].tobytes()):
                shapes.setdefault((len(w), lead, tail), []).append((row, w))
        for (n, lead, tail), found in sorted(shapes.items()):
            sums = self.model.position_sums(np.frombuffer(b"".join(w for _, w in found), np.uint8).reshape(-1, n), lead, tail)
            np.add.at(out[:, :-1], [row for row, _ in found], sums)
        out[:, -1] = size + 2
        return out

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean distribution over all positions of each text (zeros for a text
        without words)."""
        joined = b" ".join(texts).lower()
        data = np.frombuffer(joined, np.uint8)
        start, end = word_edges(data)
        size = end - start
        out = np.zeros((len(texts), len(self.model.languages)))
        if not len(start):
            return out
        h, at, inverse = np.unique(hash_words(data, start, start + size, 1), return_index=True, return_inverse=True)
        known = in_sorted(h, self.hashes)
        if len(self.hashes) + np.count_nonzero(~known) > self.limit:
            self.hashes, self.table, known = self.hashes[:0], self.table[:0], np.zeros(len(h), bool)
        new = at[~known]
        rows = np.empty((len(h), self.table.shape[1]), np.float32)
        rows[known] = self.table[np.searchsorted(self.hashes, h[known])]
        rows[~known] = self._evaluate(data, start[new], size[new])
        place = np.searchsorted(self.hashes, h[~known])
        self.hashes, self.table = np.insert(self.hashes, place, h[~known]), np.insert(self.table, place, rows[~known], axis=0)
        begin = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        full = np.flatnonzero(np.diff(begin))
        total = np.add.reduceat(rows[inverse].astype(np.float64), begin[full], axis=0)
        out[full] = total[:, :-1] / total[:, -1:]
        return out


def has_letter(data: bytes) -> bool:
    """Whether the text holds a letter of any script."""
    return LETTER.search(data) is not None or any(map(str.isalpha, data.decode("utf-8", "replace")))


def labelled_sample(docs: DataFrame, per_label: int, label_col: str, id_col: str) -> DataFrame:
    """At most ``per_label`` rows ``(id, text, label)`` of each label, chosen by
    a hash of the id; a first cut by the labels' counts keeps the ranking
    small.  Rows that repeat an id may all be chosen."""
    counts = {r[label_col]: r["n"] for r in docs.groupBy(label_col).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return docs.limit(0)
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2.0 * per_label / n))))
    draw = F.pmod(F.xxhash64(F.lit(17), id_col), F.lit(1 << 30)) / (1 << 30)
    rank = F.row_number().over(Window.partitionBy(label_col).orderBy("__draw", "text"))
    return (
        docs.withColumn("__draw", draw).where(F.col("__draw") < F.element_at(share, F.col(label_col)))
        .withColumn("__rank", rank).where(F.col("__rank") <= per_label).drop("__draw", "__rank")
    )


def fit_language_id(docs: DataFrame, per_language: int = 300, steps: int = 400, seed: int = 0) -> ByteTagger | None:
    """Network fitted on at most ``per_language`` training documents of each
    language (``doc_id, text, lang``; held-out rows and null texts or languages
    are not used); None if there are none."""
    train = docs.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    rows = labelled_sample(train, per_language, "lang", "doc_id").collect()
    languages = sorted({r.lang for r in rows})
    number = {x: i for i, x in enumerate(languages)}
    words, labels = [], []
    for r in sorted(rows, key=lambda r: (r.lang, r.text)):
        found = segments(r.text.encode())
        words += found
        labels += [number[r.lang]] * len(found)
    if not words:
        return None
    model = ByteTagger(languages, seed=seed)
    share = np.bincount(labels, minlength=len(languages))
    rng = np.random.default_rng(seed)  # as many words of each language
    pick = np.concatenate([rng.choice(np.flatnonzero(np.array(labels) == k), int(share[share > 0].max())) for k in range(len(languages)) if share[k]])
    model.fit([words[i] for i in pick], np.array(labels)[pick], steps=steps, seed=seed)
    return model


def predict_language(docs: DataFrame, model: ByteTagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every whole text; ``und``
    with score 0 for null, for texts without a letter and without a model."""

    def run(batches):
        scores = WordScores(model) if model else None
        for b in text_pieces(batches, 2 << 20):
            data = b.column("text").to_pylist()
            known = [bool(scores and t) and has_letter(t) for t in data]
            means = iter(scores.documents([t for t, k in zip(data, known) if k])) if any(known) else iter(())
            pred, score = [], []
            for k in known:
                p = next(means) if k else None
                pred.append(model.languages[int(p.argmax())] if k else "und")
                score.append(min(1.0, float(p.max())) if k else 0.0)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return source.select("doc_id", "text", held_out("doc_id").alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame) -> DataFrame:
    """Fit on the training rows of ``docs(doc_id, text, lang)`` and predict all."""
    return predict_language(docs, fit_language_id(docs))
