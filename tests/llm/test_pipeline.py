"""The pipeline stage by stage against plain Python, and the fitted models."""

from __future__ import annotations

import base64

import numpy as np
import tiktoken

import corpus_pipeline
from flowtally.llm import langid, toxicity
from flowtally.llm.queries import vocabulary
from tests.conftest import SF0001
from tests.llm import brute


def test_stages(spark):
    table = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{SF0001}/{name}.parquet").select(*c).collect()]
    docs = table("documents", "doc_id", "text")
    frame = spark.read.parquet(f"{SF0001}/documents.parquet")
    columns, frames = frame.columns, []
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF0001)
        frames.append(frame)
    assert all(f.columns == columns for f in frames[:-1])
    got = [dict(f.select("doc_id", "text").collect()) for f in frames[:-1]]
    scores = toxicity.toxicity(spark.read.parquet(f"{SF0001}/documents.parquet"), spark.read.parquet(f"{SF0001}/labels.parquet"))
    clean = {r.doc_id for r in scores.where("predicted = 0").collect()}
    docs = [x for x in docs if x[0] in clean]
    assert got[0] == dict(docs)
    keep = {doc for doc, _, low in brute.op1(docs) if doc == low}
    docs = [x for x in docs if x[0] in keep]
    assert got[1] == dict(docs)
    dirty = {r[0] for r in brute.op3(docs, table("benchmark", "item_id", "text")) if r[-1]}
    docs = [x for x in docs if x[0] not in dirty]
    assert got[2] == dict(docs)
    assert set(got[3]) == {d for d, _ in docs}
    changed = {r[0] for r in brute.op5_base(docs)[0] if sum(r[1:4])}
    assert changed <= {d for d, t in docs if got[3][d] != t}
    path, pattern = vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = {(d, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t)) for d, t in got[3].items() for ids in [enc.encode_ordinary(t or "")]}
    assert {tuple(r) for r in frames[-1].collect()} == want


def test_network_gradients():
    model = langid.ByteTagger(["a", "b", "c"], width=3, hidden=4, seed=1)
    words, label = np.random.default_rng(0).integers(97, 105, (5, 6)), np.array([0, 1, 2, 0, 1])
    _, grad = model.gradients(words, label)
    for name, value in model._parameters().items():
        at = tuple(s // 2 for s in value.shape) if name != "emb" else (int(words[0, 0]), 1)
        old, step = value[at], 1e-5
        value[at] = old + step
        up = model.gradients(words, label)[0]
        value[at] = old - step
        down = model.gradients(words, label)[0]
        value[at] = old
        assert abs((up - down) / (2 * step) - grad[name][at]) < 1e-6


def test_identity_terms_move_no_score():
    """Identity terms that go along with the label are not learnt."""
    rng = np.random.default_rng(2)
    filler = [f"wort{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(400):
        y = i % 2
        words = list(rng.choice(filler, 20)) + (["muslim"] if rng.random() < (0.9 if y else 0.1) else ["christian"]) + (["vileword"] if y else [])
        texts.append(" ".join(words).encode())
        labels.append(y)
    free = toxicity.fit_model(texts, np.array(labels), penalty=0.0)
    fair = toxicity.fit_model(texts, np.array(labels), penalty=10.0)
    pair = [b"they are muslim", b"they are christian"]
    logit = lambda m: np.diff(np.log(m.scores(pair) / (1 - m.scores(pair))))[0]
    assert abs(logit(fair)) < 0.2 * abs(logit(free))
    assert fair.scores([b"a vileword here"])[0] > 0.5 > fair.scores([b"they are muslim", b""]).max()
    assert toxicity.fit_model([b"a", b"b"], np.array([0, 1])).scores([None, b""]).tolist() == [0.5, 0.5]


def test_models_without_training_rows(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "123 !!"), (4, "text")])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {tuple(r)[2:] for r in toxicity.toxicity(docs, labels).collect()} == {(0.0, 0)}
    got = langid.predict_language(docs, None).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    model = langid.ByteTagger(["a", "b"])
    assert [r.lang_pred == "und" for r in sorted(langid.predict_language(docs, model).collect())] == [True, True, True, False]


def test_repeated_documents_train_once(spark, make_docs):
    """Rows that repeat a doc_id do not swell the training sample."""
    docs = [(i, f"wort {i} " + ("vileword" if i % 2 else "nett")) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    once, often = (toxicity.fit_toxicity(make_docs(d), labels) for d in (docs, docs + [docs[3]] * 200))
    assert np.array_equal(once.weight, often.weight) and once.bias == often.bias


def test_labels_of_other_documents(spark, make_docs):
    """A label table of which the documents are a small part: neither the other
    labels nor null texts use up the sample."""
    docs = [(i, f"{'vileword' if i % 2 else 'kindword'} filler{i % 7}") for i in range(300)]
    docs += [(i, None) for i in range(300, 3000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30000)], "doc_id long, toxic int")
    few, alone = (toxicity.fit_toxicity(make_docs(docs), x, per_label=50) for x in (labels, labels.where("doc_id < 300")))
    texts = [b"a vileword", b"a kindword", b"filler3"]
    assert few.scores(texts)[0] > 0.7 > 0.3 > few.scores(texts)[1]
    assert np.array_equal(few.scores(texts), alone.scores(texts))
