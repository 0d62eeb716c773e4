import numpy as np
from pyspark.sql import functions as F

from attriva.llm import kmeans_tree as kt


def exact(ids, x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    return [(int(ids[j]), d[j]) for j in np.lexsort((ids, d)) if ids[j] != ids[q]][:k]


def found(spark, rows, k=10, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf int, v string")
    out, about = kt.search(df, F.col("vec_id") % 100 == 0, k=k, **kw)
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got, about


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8))
    x = centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 8)) * 0.3
    ids = np.arange(3000)
    got, about = found(spark, [(int(i), v.tolist(), 1, "a") for i, v in zip(ids, x, strict=True)], leaf_rows=60, sample=1500, chunk=64)
    hits = total = 0
    for q in range(0, 3000, 100):
        want = dict(exact(ids, x, q))
        assert len(got[q]) == 10 and [s for _, s in got[q]] == sorted(s for _, s in got[q])
        for v, s in got[q]:
            assert abs(s - np.sqrt(((x[v] - x[q]) ** 2).sum())) < 1e-12
        hits, total = hits + sum(v in want for v, _ in got[q]), total + 10
    assert hits / total >= 0.9 and about["visits"] < about["leaves"]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (None, [1.0, 0.0]), (3, [0.0, 1.0]), (100, [0.0, 2.0])]
    got, _ = found(spark, [(i, v, 0, "") for i, v in rows])
    assert [v for v, _ in got[0]] == [1, 2, 3, 100] and [v for v, _ in got[100]] == [3, 0, 1, 2]
    assert found(spark, [])[0] == {} and found(spark, [(1, [1.0], 0, "")])[0] == {}
    assert found(spark, [(0, [1.0], 0, "")])[0] == {}


def test_one_hot_leaf(spark):
    rows = [(i, [1.0, 1.0] if i % 3 else [float(i), 2.0], 0, "") for i in range(900)]
    got, _ = found(spark, rows, k=5, leaf_rows=30, chunk=50)
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for q in range(0, 900, 100):
        assert [round(s, 9) for _, s in got[q]] == [round(s, 9) for _, s in exact(ids, x, q, 5)]


def test_repeated_rows_hide_no_neighbours(spark):
    rng = np.random.default_rng(5)
    x, ids = rng.normal(size=(500, 6)), np.arange(500)
    twice, near = np.concatenate([x, x]), np.concatenate([ids, ids])
    of, at, d = kt.nearest(ids[:20], x[:20], near, twice, 10)
    for q in range(20):
        assert list(zip(near[at[of == q]].tolist(), d[of == q], strict=True)) == exact(ids, x, q)
    # an id that stands 40 times beside each query, and leaves that hold no other id
    crowd = [(7, (x[q] + 0.001).tolist(), 0, "") for q in range(0, 500, 100) for _ in range(40)]
    got, _ = found(spark, [(int(i), v.tolist(), 0, "") for i, v in zip(near, twice, strict=True)] + crowd, leaf_rows=40, recall=1.0)
    for q in range(0, 500, 100):
        want = [7, *(v for v, _ in exact(ids, x, q, 11) if v != 7)][:10]
        assert len(got[q]) == 10 and got[q][0][0] == 7 and len(set(want) & {v for v, _ in got[q]}) >= 9
