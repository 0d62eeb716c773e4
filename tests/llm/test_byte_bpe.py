import base64
import random

import fixtures
import public_tokenizers
import pytest
import tiktoken

from attriva.llm import byte_bpe as b

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    None, "", " ", "Hello, world! It's they'll we've I'd 'S", "a" * 700, " " * 500 + "x", "\n\n \t x\x1c\x1d\x85y z w　", "naïve façade — “quotes” …", "日本語のテキスト 中文", "🙂👍🏽 emoji", "Ünïcödé" * 40,
    "1234567890 12.5 ½ Ⅷ", "<|endoftext|>", "don’t", "\u0000\u0001﻿", "x" * 161 + "y", "аБв где", "=-" * 200, "def f(x):\n    return x+1\n",
]


@pytest.fixture(scope="module")
def ranks():
    return b.read_ranks(PATH)


@pytest.fixture(scope="module")
def known():
    table = {base64.b64decode(x): int(n) for x, n in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("known", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def test_against_the_library(spark, ranks, known):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("ab éñ\n'.,1 漢🙂") for _ in range(rng.randrange(60))) for _ in range(60)] + [r[1] for r in fixtures.rows()]
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in enumerate(texts)] + [(3, TEXTS[3], 0, "k")], "doc_id long, text string, ids int, n_tokens string")
    out = b.encode(df, ranks, public_tokenizers.PATTERN)
    lists = {r.doc_id: r.ids for r in b.token_lists(out).collect()}
    rows = out.collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = known.encode_ordinary(texts[r.doc_id] or "")
        assert lists[r.doc_id] == want and r.n_tokens == len(want) and bytes(r.decoded) == (texts[r.doc_id] or "").encode()


def test_long_words_fold_alike(ranks, known):
    rng = random.Random(5)
    for n in (2, 3, 50, 400):
        word = "".join(rng.choice("abcdefgh") for _ in range(n))
        assert b.long_fold(word.encode(), ranks) == known.encode_ordinary(word)  # letters: one word


def test_empty_table(spark, ranks):
    assert b.digests(b.encode(spark.createDataFrame([], "doc_id long, text string"), ranks, public_tokenizers.PATTERN)).collect() == []


def test_words_are_the_matches_of_the_pattern():
    rng = random.Random(8)
    find = b.split_pattern(public_tokenizers.PATTERN).findall
    other = b.split_pattern(r"\p{L}{1,3}|\p{N}").findall
    for _ in range(300):
        run = ["".join(rng.choice("ab'srevltm  \n\t19½é漢🙂.,́\x85\xa0") for _ in range(rng.randrange(40))) for _ in range(rng.randrange(1, 5))]
        for pattern, want in ((public_tokenizers.PATTERN, find), (r"\p{L}{1,3}|\p{N}", other)):
            points, start, end, sizes = b.word_bounds(run, pattern)
            words, place = b.distinct_words(points, start, end)
            got = [words[k] for k in place]
            assert got == [w for t in run for w in want(t)] and sizes.tolist() == [len(want(t)) for t in run] and len(set(words)) == len(words)


def test_words_stay_apart():
    points, start, end, _ = b.word_bounds(["ab cd ab xyz"], public_tokenizers.PATTERN)
    words, place = b.distinct_words(points, start, end)
    assert [words[k] for k in place] == ["ab", " cd", " ab", " xyz"]
    assert b.distinct_words(points[:0], start[:0], end[:0])[0] == []


def test_few_words_at_a_time(spark, ranks, known, monkeypatch):
    monkeypatch.setattr(b, "RARE_WORDS", 20)
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(40_000)) for _ in range(6)] + ["tail qqzzxx"]
    out = b.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1), ranks, public_tokenizers.PATTERN)
    got = {r.doc_id: r.ids for r in b.token_lists(out).collect()}
    assert got == {i: known.encode_ordinary(t) for i, t in enumerate(texts)}


def test_plans_do_not_hold_the_ranks(spark, ranks):
    docs = spark.createDataFrame([(1, "some uncommonness, somewhat")], "doc_id long, text string")
    plan = b.encode(docs, ranks, public_tokenizers.PATTERN)._jdf.queryExecution()
    assert plan.optimizedPlan().toJSON().__len__() < 200_000
    assert len(plan.sparkPlan().toString()) < 20_000
