import random

import numpy as np
import pyarrow as pa
import pytest

from attriva.llm import textops as x
from attriva.llm.shared import components


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(5)
    edges = {
        "path": [(i * 7 % 41, (i + 1) * 7 % 41) for i in range(30)],
        "star": [(9, i) for i in range(40)],
        "random": [(rng.randrange(60), rng.randrange(60)) for _ in range(40)],
        "none": [],
    }[shape]
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.comp for r in components(df).collect()}
    assert got == {v: find(v) for e in edges if e[0] != e[1] for v in e}
    half = components(df.limit(len(edges) // 2))
    assert {r.node: r.comp for r in components(df, start=half).collect()} == got


def test_words_match_the_pattern():
    import brute

    texts = ["Hello WORLD ", None, "", " a\tb\x0bc ", "Éé x", "одно слово", "x" * 5000, "a-b_c 1,2"]
    for table, plain in ((x.SPACE_WORDS, brute.space_words), (x.ALNUM_WORDS, brute.alnum_words)):
        names, got = {}, []
        for i, j, w in x.words_of(pa.array(texts), table, 20):
            for d in range(j - i):
                got.append(w.hash[w.doc == d].tolist())
        want = [plain(t) for t in texts]
        assert [len(g) for g in got] == [len(v) for v in want]
        for g, v in zip(got, want, strict=True):
            for h, word in zip(g, v, strict=True):
                assert names.setdefault(word, h) == h
        assert len(set(names.values())) == len(names)


def test_ngrams_depend_on_order_and_length():
    def grams(text, n):
        return x.words_of(pa.array([text]), x.SPACE_WORDS).__next__()[2].ngrams(n)[0].tolist()

    assert grams("a b c d", 4) != grams("b a c d", 4)
    assert len(grams("a b c d e", 4)) == 2 and len(grams("a b", 4)) == 1 and grams("a b", 4) != grams("a b c", 4)
    assert grams("", 4) == []


def test_prefix_hashes():
    w = next(x.words_of(pa.array(["idiotic idiot idi"]), x.SPACE_WORDS))[2]
    five = w.prefix(5)
    assert five[0] == five[1] != five[2] and not set(five) & set(w.hash)


def test_no_bytes():
    data, offsets = x.text_bytes(pa.array([None, ""], pa.string()))
    assert len(data) == 0 and offsets.tolist() == [0, 0, 0]
    assert len(x.Words(data, offsets, x.SPACE_WORDS)) == 0
    assert x.id_column(np.array([-(2**63), 1])).to_pylist() == [None, 1]
