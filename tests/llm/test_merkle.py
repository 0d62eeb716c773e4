import hashlib
import random
import zlib

import fixtures
import pytest

from attriva.llm import merkle, shared


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute(rows):
    """Trees as nested lists, proofs and folds by walking them."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha(*map(field, (r[0], r[3], r[2], r[4], t)))

    def tree(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
        return levels

    def up(levels, i, digest):
        siblings = []
        for level in levels[:-1]:
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            k = i % 3
            siblings += run[:k] + run[k + 1 :]
            digest = sha(*run[:k], digest, *run[k + 1 :])
            i //= 3
        return siblings, digest

    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    order = {s: sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for s in names}
    trees = {s: tree([leaf(r, r[1]) for r in order[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for i, r in enumerate(order[s]):
            t = r[1].replace("\n", "") if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
            one, digest = up(trees[s], i, leaf(r, t))
            two, digest = up(top, j, digest)
            out.append((r[0], leaf(r, r[1]), trees[s][-1][0], top[-1][0], sha(*one, *two), digest, digest == top[-1][0]))
    return out


def check(spark, rows):
    got = [tuple(r) for r in merkle.verify(fixtures.frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
    return got


def sources(n, hot, rng):
    names = [None, "", "a", "ä", "Z", "-", *[f"s{i}" for i in range(20)]]
    return [(i, f"text {i}\nline" if i % 3 else f"plain {i}", "en" if i % 5 else None, "hot" if i < hot else rng.choice(names), i % 7 or None, 0, "x", "y") for i in range(n)]


def test_proofs_against_plain_trees(spark):
    got = check(spark, sources(1500, 900, random.Random(3)))
    assert {r[-1] for r in got} == {True, False}


def test_odd_rows(spark):
    rows = fixtures.rows() + [(None, "x\n", None, None, None, 0, "x", "y"), (None, None, None, None, None, 0, "x", "y"), (70, "two\nlines\n" * 50_000, "en", "s1", 9, 0, "x", "y"), (70, "same id", "en", "s1", 9, 0, "x", "y")]
    check(spark, rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 244])
def test_small_trees(spark, n):
    check(spark, [(i, f"t\n{i}", "en", "one", 1, 0, "x", "y") for i in range(n)])


def test_many_sources(spark):
    check(spark, [(i, "t\n", "en", f"s{i:04d}", 1, 0, "x", "y") for i in range(300)])


def test_empty(spark):
    assert merkle.verify(fixtures.empty(spark)).collect() == []


def test_events_may_come_in_any_order():
    import pyarrow as pa

    rows = [("t", 50, 0, i, sha(str(i))) for i in range(50)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        columns = [pa.array(c) for c in zip(*rows, strict=True)]
        batches = [pa.RecordBatch.from_arrays(columns, names=list("abcde")).slice(k, 7) for k in range(0, 50, 7)]
        got = [r for b in merkle.combined(iter(batches)) for r in b.to_pylist()]
        assert [r["kind"] for r in got].count(merkle.ROOT) == 1 and not any(r["kind"] == merkle.OPEN for r in got)


def test_ranks_of_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 40}", rng.randrange(500), i) for i in range(3000)]
    got = shared.ranked(spark.createDataFrame(rows, "g string, x int, i int").repartition(13), ["g"], ["x", "i"], "ranked").collect()
    for g in {r[0] for r in rows}:
        own = sorted((r[1], r[2]) for r in rows if r[0] == g)
        assert [(r.x, r.i) for r in sorted((r for r in got if r.g == g), key=lambda r: r["rank"])] == own
        assert {(r["rank"], r["size"]) for r in got if r.g == g} == {(k, len(own)) for k in range(len(own))}
