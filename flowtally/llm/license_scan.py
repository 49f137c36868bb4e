"""Licence scan with a positional index of rare template words.

Templates (short licence notices) and base phrases are word sequences.  Their
vocabulary is weighted by inverse document frequency, counted over all
documents.  The index maps a word to its postings (template, position).

For a file, the words that occur in the vocabulary are looked up.  A base
phrase is anchored at its word of highest IDF: every place of that word gives
one possible start, and the other words' positions are intersected with it, so
all places are found.  A longer template collects votes: each occurrence of one
of its rare words (the words of highest IDF that make up ``RARE_SHARE`` of its
weight, and more while the others alone could reach ``threshold``) votes with
its IDF for the relative position (place in file minus place in template).
Every relative position that reaches ``threshold`` if all its other words match
is aligned; its score is the IDF-weighted share of template words found at
their places, and the label is given if at some position the score reaches
``threshold`` and every mandatory key phrase of the template stands inside the
aligned stretch.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtally.llm.common import text_pieces, texts
from flowtally.llm.decontaminate import words_of

RARE_SHARE = 0.5
MARGIN = 1e-9  # for rounding, where a bound is compared with the threshold

# Base phrases of the contract and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Openings of public licence notices (label, text, mandatory key phrases).
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license version 2",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use", "following conditions are met")),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license",)),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
)


def _vocabulary(texts_: list[str]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for t in texts_:
        for w in words_of(t.encode()):
            out.setdefault(w, len(out))
    return out


def document_frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``(word, n_docs)`` of the vocabulary's words (by number) and, as number
    -1, how many documents there are; summed per batch before the shuffle."""

    def run(batches):
        n = np.zeros(len(vocabulary) + 1, np.int64)
        known = vocabulary.keys()
        for b in text_pieces(batches):
            for t in b.column("text").to_pylist():
                for w in known & set(words_of(t)):
                    n[vocabulary[w]] += 1
                n[-1] += 1
        at = np.flatnonzero(n)
        word = np.where(at == len(vocabulary), -1, at)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n[at])], ["word", "n"])

    return docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n_docs"))


class RareWordIndex:
    """Postings of base phrases and templates, weighted by IDF."""

    def __init__(self, vocabulary: dict[bytes, int], idf: np.ndarray, phrases: dict[str, str], templates, threshold: float):
        self.vocabulary, self.idf, self.threshold = vocabulary, idf, threshold
        ids = lambda t: np.array([vocabulary[w] for w in words_of(t.encode())])
        self.anchors: dict[int, list[tuple[int, np.ndarray, str]]] = {}
        for phrase, label in phrases.items():
            seq = ids(phrase)
            at = int(np.argmax(idf[seq]))  # highest IDF; the first of ties
            self.anchors.setdefault(int(seq[at]), []).append((at, seq, label))
        self.templates = []
        self.postings: dict[int, list[tuple[int, int]]] = {}  # rare words only
        for k, (label, text, keys) in enumerate(templates):
            seq = ids(text)
            words = sorted(set(seq.tolist()), key=lambda w: (-idf[w], w))
            total = float(np.cumsum(idf[seq])[-1])  # added up in the order of _covers
            weight, rest = 0.0, total
            for w in words:
                if weight >= RARE_SHARE * idf[words].sum() and rest < threshold * total * (1 - MARGIN):
                    break
                weight += idf[w]
                for p in np.flatnonzero(seq == w).tolist():
                    self.postings.setdefault(w, []).append((k, p))
                    rest -= float(idf[w])
            self.templates.append((label, seq, [ids(x) for x in keys], total, rest))

    @staticmethod
    def _places(text: np.ndarray, seq: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Those of ``starts`` where all of ``seq`` stands in ``text``."""
        starts = starts[(starts >= 0) & (starts + len(seq) <= len(text))]
        for step, w in enumerate(seq):
            starts = starts[text[starts + step] == w]
        return starts

    def _covers(self, text: np.ndarray, seq: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Weight of the words of ``seq`` found at their places, per start."""
        out = np.zeros(len(starts))
        for step, w in enumerate(seq):
            place = starts + step
            same = (place >= 0) & (place < len(text))
            same[same] = text[place[same]] == w
            out[same] += self.idf[w]
        return out

    def scan(self, words: list[bytes]) -> tuple[int, int | None, int | None, list[str], list[str], float]:
        get = self.vocabulary.get
        text = np.array([get(w, -1) for w in words], np.int64)
        where: dict[int, np.ndarray] = {}
        at = np.flatnonzero(text >= 0)
        if len(at):
            order = at[np.argsort(text[at], kind="stable")]
            cut = np.flatnonzero(np.diff(text[order])) + 1
            where = {int(text[g[0]]): g for g in np.split(order, cut)}
        places, base, score = [], set(), 0.0
        for word, phrases in self.anchors.items():
            if word in where:
                for offset, seq, label in phrases:
                    found = self._places(text, seq, where[word] - offset)
                    if len(found):
                        places.append(found)
                        base.add(label)
                        score = 1.0
        labels = set(base)
        votes: dict[int, list[tuple[np.ndarray, float]]] = {}
        for word, postings in self.postings.items():
            if word in where:
                for k, p in postings:
                    votes.setdefault(k, []).append((where[word] - p, self.idf[word]))
        for k, cast in votes.items():
            label, seq, keys, total, rest = self.templates[k]
            starts, nth = np.unique(np.concatenate([x for x, _ in cast]), return_inverse=True)
            voted = np.bincount(nth, np.repeat([w for _, w in cast], [len(x) for x, _ in cast]))
            starts = starts[voted + rest >= self.threshold * total * (1 - MARGIN)]
            cover = self._covers(text, seq, starts) / total
            starts, cover = starts[cover >= self.threshold], cover[cover >= self.threshold]
            for key in keys:
                if len(starts):
                    found = self._places(text, key, np.arange(len(text)))
                    nearest = np.searchsorted(found, starts)  # first one not before the stretch
                    whole = nearest < len(found)
                    whole[whole] = found[nearest[whole]] + len(key) <= starts[whole] + len(seq)
                    starts, cover = starts[whole], cover[whole]
            if len(starts):
                labels.add(label)
                score = max(score, float(cover.max()))
        first = np.concatenate(places) if places else None
        return (
            0 if first is None else len(first),
            None if first is None else int(first.min()),
            None if first is None else int(first.max()),
            sorted(base),
            sorted(labels),
            min(1.0, score),
        )


def license_scan(
    docs: DataFrame,
    phrases: dict[str, str] | None = None,
    templates=TEMPLATES,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score``.  Null is an empty text: no words,
    no labels, score 0.  The score is that of the best place of any label."""
    phrases = BASE_PHRASES if phrases is None else phrases
    vocabulary = _vocabulary([*phrases, *(x for _, t, keys in templates for x in (t, *keys))])
    source = texts(docs, id_col, text_col)
    counts = {r.word: r.n_docs for r in document_frequencies(source, vocabulary).collect()}  # a row per vocabulary word at most
    total = counts.get(-1, 0)
    idf = np.array([math.log((1 + total) / (1 + counts.get(i, 0))) + 1 for i in range(len(vocabulary))])
    index = RareWordIndex(vocabulary, idf, phrases, templates, threshold)

    def run(batches):
        for b in text_pieces(batches):
            docs_ = [words_of(t) for t in b.column("text").to_pylist()]
            n, first, last, base, labels, score = zip(*map(index.scan, docs_)) if docs_ else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), pa.array(map(len, docs_), pa.int64()), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()),
                    pa.array([",".join(x) for x in base], pa.string()), pa.array([",".join(x) for x in labels], pa.string()), pa.array(score, pa.float64()),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return source.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
