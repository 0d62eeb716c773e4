import random
import zlib

import fixtures
import numpy as np
import pytest

from attriva.llm import quality, toxicity

BAD = ["idiot", "moron"]


def data(kind, n=700, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = fixtures.words(rng, rng.randrange(20, 120), 3000)
        y = int(rng.random() < (0.8 if kind == "quality" else 0.3))
        if kind == "quality" and not y:
            w = [x.upper() + "!!" for x in w] if i % 2 else [x + "***" for x in w]
        if kind == "toxic" and y:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(BAD) + rng.choice(["", "ic", "s"])
        rows.append((i, " ".join(w), "en", "s", 0, 0, "", ""))
        labels.append((i, y, y))
    return rows, labels


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(spark, module, label):
    rows, labels = data(label)
    docs, marks = fixtures.frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    score = module.quality_scores if label == "quality" else module.toxicity_scores
    got = {r.doc_id: r for r in score(docs, module.train(docs, marks)).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[i].predicted, y) for i, y, _ in labels if got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.95


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_odd_tables(spark, module, label):
    score = module.quality_scores if label == "quality" else module.toxicity_scores
    docs = fixtures.frame(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = score(docs, module.train(docs, none)).collect()
    assert len(got) == docs.count() and len({r.score for r in got}) == 1 and {r.predicted for r in got} == ({1} if label == "quality" else {0})
    rows, labels = data(label, 200)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), labels[4], (999_999, 1, 0)], "doc_id long, quality int, toxic int")
    model = module.train(fixtures.frame(spark, rows), marks)
    assert score(fixtures.empty(spark), model).collect() == []
    assert len(score(docs, model).collect()) == docs.count()
    module.train(fixtures.empty(spark), marks)


def test_toxic_rows_go(spark):
    rows, labels = data("toxic")
    docs = fixtures.frame(spark, [*rows, (None, None, None, None, None, None, None, None)])
    kept = toxicity.drop_toxic(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    ids = {r.doc_id for r in kept.collect()}
    clean = {i for i, y, _ in labels if not y}
    assert kept.columns == docs.columns and None in ids and len(clean - ids) <= 5 and len(ids - clean - {None}) <= 10


def test_gradient():
    """The trained weights lower the loss."""
    rng = np.random.default_rng(1)
    texts = [rng.integers(1, 1000, (30, toxicity.PARTS)).astype(np.int32) for _ in range(60)]
    y = np.arange(60) % 2
    for t, label in zip(texts, y, strict=True):
        if label:
            t[5] = 77

    def loss(net):
        z = np.array([net.logits(np.concatenate([np.zeros((1, toxicity.PARTS), np.int32), t, np.zeros((1, toxicity.PARTS), np.int32)]), np.array([0, len(t) + 1]))[0] for t in texts])
        return float(np.log1p(np.exp(-np.where(y == 1, z, -z))).mean())

    assert loss(toxicity.fit(texts, y, epochs=6)) < loss(toxicity.fit(texts, y, epochs=0)) / 2
