import random

import brute
import fixtures
import pytest

from attriva.llm.jaccard_join import jaccard_components, keep_one_per_group


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}


def test_against_brute_force(spark):
    rows = fixtures.rows()
    assert result(fixtures.frame(spark, rows)) == brute.jaccard_components([(r[0], r[1]) for r in rows])


@pytest.mark.parametrize("seed", [3, 4])
def test_chains_and_ties(spark, seed):
    rng = random.Random(seed)
    texts, now = [], fixtures.words(rng, 60, 10_000)
    for k in range(60):  # a long chain: the ends are unlike, all are linked
        now = now[:]
        now[rng.randrange(len(now))] = f"n{k}"
        texts.append(" ".join(now))
        if k % 20 == 19:
            now = fixtures.words(rng, 60, 10_000)
    line = " ".join(fixtures.words(rng, 12, 10_000))
    texts += [f"{line} {' '.join(fixtures.words(rng, 3, 10_000))}" for _ in range(30)]  # a common line in short texts
    rng.shuffle(texts)
    rows = [(i, t, "en", "s", 0, 0, "", "") for i, t in enumerate(texts)]
    assert result(fixtures.frame(spark, rows)) == brute.jaccard_components([(r[0], r[1]) for r in rows])


def test_null_ids_and_empty(spark):
    rows = [(None, "a b c d e", "en", "s", 0, 0, "", ""), (5, "a b c d e", "en", "s", 0, 0, "", ""), (3, None, None, None, None, None, None, None)]
    assert result(fixtures.frame(spark, rows)) == {5: (2, 5), 3: (0, 3)}
    assert result(fixtures.empty(spark)) == {}


def test_one_of_each_group_stays(spark):
    df = fixtures.frame(spark)
    want = {d for d, (_, c) in brute.jaccard_components([(r[0], r[1]) for r in fixtures.rows()]).items() if d == c}
    df = df.withColumnsRenamed({"token": "gone", "rep": "_gone_id"})
    kept = keep_one_per_group(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == want
