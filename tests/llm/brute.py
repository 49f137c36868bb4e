"""Plain Python versions of the query contracts, one row at a time."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def lower(text: str) -> str:
    return text.translate(LOWER)


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def op1(docs, k=4, bits=4):
    """docs: (doc_id, text) -> sorted (doc_id, fingerprint, component_id)."""
    fps = []
    for _, text in docs:
        words = BLANK.findall(lower(text or ""))
        grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= bits]
    group = components(range(len(fps)), links)
    low = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            low[group[i]] = min(low.get(group[i], doc), doc)
    return [(doc, f"{fp:016x}", low.get(group[i])) for i, ((doc, _), fp) in enumerate(zip(docs, fps))]


def op2(pages):
    """pages: (page_id, html)."""
    data = [(p, (h or "").encode()) for p, h in pages]
    latest, copies = {}, {}
    for p, d in data:
        copies[d] = copies.get(d, 0) + 1
        if p is not None:
            latest[d] = max(latest.get(d, p), p)
    out = []
    for p, d in data:
        digest = base64.b32encode(hashlib.sha1(d).digest()).decode()
        revisit = d in latest and latest[d] != p
        out.append((p, len(d), digest, "revisit" if revisit else "response", latest[d] if revisit else None))
    return out


def op3(docs, items, window=10):
    patterns = {}
    for item, text in items:
        if item is None or text is None:
            continue
        words = WORD.findall(lower(text))
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            patterns.setdefault(tuple(words[i : i + m]), set()).add(str(item))
    lengths = {len(p) for p in patterns}
    out = []
    for doc, text in docs:
        words = WORD.findall(lower(text or ""))
        hit, found = set(), set()
        for m in lengths:
            for i in range(len(words) - m + 1):
                if (key := tuple(words[i : i + m])) in patterns:
                    hit.update(range(i, i + m))
                    found |= patterns[key]
        out.append((doc, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def op4_base(docs):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    out = []
    for doc, text in docs:
        words = WORD.findall(lower(text or ""))
        places = []
        for phrase, label in phrases.items():
            p = phrase.split()
            places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
        starts = [i for i, _ in places]
        out.append((doc, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    return out


ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def op5_base(docs):
    """(doc_id, n_assign, n_access, n_hex, base_sha256), and the base spans."""
    out, spans = [], []
    for doc, text in docs:
        text = text or ""
        a = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        k = [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        h = [m.span() for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
        flat = sorted((s, i, e) for i, x in enumerate((a, k, h)) for s, e in x)
        names = [f"{('assign', 'access', 'hex')[i]}:{s}:{e}" for s, i, e in flat]
        out.append((doc, len(a), len(k), len(h), sha(",".join(names))))
        spans.append(names)
    return out, spans


def op6(rows, least=0.98):
    """rows: (vec_id, vector, label); all ids distinct."""
    vec = []
    for _, v, label in rows:
        ok = v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, np.float64) if ok else None
        vec.append(x / np.linalg.norm(x) if ok else None)
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if vec[i] is not None and vec[j] is not None and rows[i][2] == rows[j][2] and len(vec[i]) == len(vec[j]) and vec[i] @ vec[j] >= least
    ]
    ids = [r[0] for r in rows]
    group = components(ids, [(ids[i], ids[j]) for i, j in links])
    n = dict.fromkeys(ids, 0)
    for i, j in links:
        n[ids[i]] += 1
        n[ids[j]] += 1
    return [(i, n[i], group[i], group[i] == i) for i in ids]


def op8(docs, window=20):
    words = [BLANK.findall(t or "") for _, t in docs]
    key = [float("inf") if d is None else d for d, _ in docs]
    first = {}
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            t = tuple(w[i : i + window])
            first[t] = min(first.get(t, (key[d], i)), (key[d], i))
    out = []
    for d, w in enumerate(words):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (key[d], i):
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((docs[d][0], len(w), len(gone), sha(" ".join(kept))))
    return out
