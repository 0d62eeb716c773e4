import math
import random

import brute
import fixtures
import numpy as np
import pyarrow as pa
import pytest

from attriva.llm import context_tree as ct
from attriva.llm.textops import text_bytes


def tree_of(texts, most=1 << 16):
    code = ct.codes(*text_bytes(pa.array(texts, pa.string())))
    keys, counts = np.unique(code, return_counts=True)
    return ct.Tree(keys, counts.astype(float), most)


class Plain:
    """The same mixture by recursion over contexts and bits, from raw counts."""

    def __init__(self, texts):
        self.n = {}
        for t in texts:
            b = b"\xff" * 3 + brute.lower_az(t).encode() + b"\xff"
            for i in range(3, len(b)):
                for d in range(4):
                    ctx = bytes(b[i - 1 - k] for k in range(d))
                    for bit in range(8):
                        key = ctx, bit, b[i] >> (8 - bit)
                        self.n.setdefault(key, [0, 0])[(b[i] >> (7 - bit)) & 1] += 1

    def kids(self, ctx, bit, head):
        return [c for (c, k, h) in self.n if len(c) == len(ctx) + 1 and c[: len(ctx)] == ctx and (k, h) == (bit, head)]

    def kt(self, key):
        a, b = self.n.get(key, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, ctx, bit, head):
        own = self.kt((ctx, bit, head))
        if len(ctx) == 3:
            return own
        return math.log(0.5 * math.exp(own) + 0.5 * math.exp(sum(self.weighted(c, bit, head) for c in self.kids(ctx, bit, head))))

    def predict(self, history, bit, head, d=0):
        ctx = bytes(history[:d])
        if d and (ctx, bit, head) not in self.n:
            return 0.5
        a, b = self.n.get((ctx, bit, head), (0, 0))
        own = (b + 0.5) / (a + b + 1)
        if d == 3:
            return own
        beta = 0.5 * math.exp(self.kt((ctx, bit, head)) - self.weighted(ctx, bit, head))
        return beta * own + (1 - beta) * self.predict(history, bit, head, d + 1)

    def log10(self, text):
        b = b"\xff" * 3 + brute.lower_az(text).encode() + b"\xff"
        total = 0.0
        for i in range(3, len(b)):
            history = bytes(b[i - 1 - k] for k in range(3))
            for bit in range(8):
                p = self.predict(history, bit, b[i] >> (8 - bit))
                total += math.log10(p if (b[i] >> (7 - bit)) & 1 else 1 - p)
        return total


def test_tree_equals_the_recursion():
    texts = ["abab cab", "abba", None, "Bab é"]
    tree, plain = tree_of(texts), Plain(texts)
    rows = tree.rows()
    for probe in ["abab", "zzz", "", "cab é", "bb"]:
        code = ct.codes(*text_bytes(pa.array([probe])))
        got = tree.table[rows[code >> np.uint32(8)], code & np.uint32(255)].sum()
        assert got == pytest.approx(plain.log10(probe), abs=1e-3)


def test_every_row_is_a_distribution():
    tree = tree_of(["the cat sat on the mat", "the dog"], most=5)
    assert np.allclose((10.0 ** tree.table.astype(float)).sum(1), 1, atol=1e-4)
    assert len(tree.deep) == 5


def test_lgamma():
    x = np.array([0.5, 1.5, 3.0, 7.9, 8.1, 100.5, 1e7])
    assert np.allclose(ct._lgamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-8)


def check(spark, rows):
    df = fixtures.frame(spark, rows)
    got = ct.score(df, ct.train(df)).collect()
    want = brute.base_scores([(r[0], r[1]) for r in rows])
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and r.base_score == pytest.approx(w[4], abs=1e-9) and r.score < 0
    return got


def test_base_scores(spark):
    rows = [r for i, r in enumerate(fixtures.rows()) if i < 45]
    check(spark, rows)


def test_small_and_empty(spark):
    check(spark, [(1, None, None, None, None, None, None, None)])
    held = next(i for i in range(100) if brute.base_scores([(i, "a")])[i][0])
    check(spark, [(held, "only held out", "", "", 0, 0, "", "")])
    df = fixtures.empty(spark)
    assert ct.score(df, ct.train(df)).collect() == []


def test_likely_texts_score_better(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(30)), "", "", 0, 0, "", "") for i in range(40)]
    model = ct.train(fixtures.frame(spark, rows))
    probe = spark.createDataFrame([(1, "alpha beta gamma"), (2, "zqxj kvwp fyhg")], "doc_id long, text string")
    got = {r.doc_id: r.bits_per_byte for r in ct.score(probe, model).collect()}
    assert got[1] < got[2] / 3


def test_rare_contexts_keep_their_counts(spark):
    rows = [(r[0], (r[1] or "")[:400], *r[2:]) for r in fixtures.rows()[:45]] + [(1000, "", "", "", 0, 0, "", "")]
    df = fixtures.frame(spark, rows)
    score = lambda most: sorted((r.doc_id, r.score, r.base_score) for r in ct.score(df, ct.train(df, max_contexts=most)).collect())
    want = score(1 << 16)
    for most in (1, 50):
        for one, two in zip(score(most), want, strict=True):
            assert one == pytest.approx(two, rel=1e-6, abs=1e-4)
