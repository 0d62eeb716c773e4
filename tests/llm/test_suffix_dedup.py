import random

import brute
import fixtures
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attriva.llm import suffix_dedup as sd


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=40))
def test_suffix_array(symbols):
    assert sd.suffix_array(np.array(symbols)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_equal_windows():
    groups = sd.equal_windows([b"xxabcd", b"abcdyy", b"qabcq"], 3)
    shared = {tuple(sorted(zip(i.tolist(), o.tolist(), strict=True))) for i, o in groups if len(i) > 1}
    assert shared == {((0, 2), (1, 0), (2, 1)), ((0, 3), (1, 1))}


def result(df, **kw):
    return {r.doc_id: tuple(r)[1:] for r in sd.digests(sd.dedup(df, **kw)).collect()}


def test_against_brute_force(spark):
    rows = fixtures.rows()
    assert result(fixtures.frame(spark, rows)) == brute.repeated_bytes({r[0]: r[1] for r in rows}.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_edits_and_periods(spark, seed):
    rng = random.Random(seed)
    part = ["".join(rng.choice("abcde é") for _ in range(rng.randrange(90, 260))) for _ in range(6)]
    texts = []
    for _ in range(40):
        t = "".join(rng.choice(part) for _ in range(3))
        k = rng.randrange(len(t))
        texts.append(t[:k] + rng.choice("xyz") + t[k + rng.randrange(3) :])
    texts += ["ab" * 300, "ab" * 70, "a" * 500, "b" * 99, "b" * 100, "b" * 101]
    rows = [(i, t, "en", "s", 0, 0, "", "") for i, t in enumerate(texts)]
    want = brute.repeated_bytes([(r[0], r[1]) for r in rows])
    assert result(fixtures.frame(spark, rows)) == want
    assert result(fixtures.frame(spark, rows), most_classes=2) == want  # crowded keys, window by window


def test_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(sd, "SEGMENT", 1 << 12)  # forked workers of this session keep the usual size
    data = np.frombuffer(("".join(random.Random(1).choice("abcd") for _ in range(9000)) * 2).encode(), np.uint8)
    key, string, doc, at, a, b = sd._run_occurrences(data, np.array([0, len(data)]), 100)
    assert a[0] == 0 and b[-1] == len(data) - 100 and (a[1:] == b[:-1] + 1).all()


def test_empty_and_null_ids(spark):
    assert result(fixtures.empty(spark)) == {}
    t = "q" * 50 + "r" * 80
    got = result(fixtures.frame(spark, [(None, t, "", "", 0, 0, "", ""), (1, t, "", "", 0, 0, "", "")]))
    assert got[None][1] == 0 and got[1][1] == 130
