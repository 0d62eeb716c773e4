import numpy as np
import pytest

from attriva.llm import projection_passes as pp

SCHEMA = "vec_id long, embedding array<float>, label int, pass int, dim int, comp long"


def brute(rows, least=0.95):
    """All pairs of usable vectors."""
    best = {}
    for r in rows:
        v = r[1]
        if r[0] is None or v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        v = [float(np.float32(x)) for x in v]
        best[r[0]] = min(best.get(r[0], v), v)
    ids = sorted(best)
    by_dim = {}
    for i in ids:
        by_dim.setdefault(len(best[i]), []).append(i)
    links, parent = dict.fromkeys(ids, 0), {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for own in by_dim.values():
        x = np.array([best[i] for i in own])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        hit = x @ x.T >= least
        np.fill_diagonal(hit, False)
        for i, row in zip(own, hit, strict=True):
            links[i] = int(row.sum())
            for k in np.nonzero(row)[0]:
                a, b = find(i), find(own[k])
                parent[max(a, b)] = min(a, b)
    out = {i: (links[i], find(i), find(i) == i) for i in ids}
    return out | {r[0]: (0, r[0], True) for r in rows if r[0] not in out}


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 0, 0, 0) for i, v in rows], SCHEMA)


def clusters(seed, n, sizes, spread, dim=32):
    rng = np.random.default_rng(seed)
    x = [rng.standard_normal(dim) for _ in range(n)]
    for size, s in zip(sizes, spread, strict=True):
        centre = rng.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        x += [(centre + s * rng.standard_normal(dim) / dim**0.5) * rng.uniform(0.5, 2) for _ in range(size)]
    order = rng.permutation(len(x))
    return [(int(k), x[j].tolist()) for k, j in enumerate(order)]


@pytest.mark.parametrize("group", [1024, 30])
def test_all_pairs(spark, group):
    """Groups of exact and near copies, loose and tight; a small ``group`` leads the large ones through the angle bins."""
    rows = clusters(1, 400, [2, 3, 5, 40, 90, 120, 150], [0.1, 0.15, 0.2, 0.0, 0.12, 0.25, 0.4])
    got = pp.near_duplicates(table(spark, rows), window=32, block=64, group=group, piece=25).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute(rows)
    assert len(got) == len(rows)


def test_odd_vectors(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, one), (2, [2.0, 4.0, 6.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0]), (8, [None, 1.0, 1.0]), (9, [1.0, 2.0]), (10, [1.0, 2.0]), (2, [2.0, 4.0, 6.0]), (11, [3e-30, 6e-30, 9e-30]), (12, [1e38, 2e38, 3e38])]
    got = pp.near_duplicates(table(spark, [*rows, (None, one), (None, None)])).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == brute(rows)
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)] * 2
    assert len(got) == 14


def test_empty(spark):
    assert pp.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [tuple(r) for r in pp.near_duplicates(table(spark, [(3, None)])).collect()] == [(3, 0, 3, True)]


def test_passes_grow_with_the_table():
    few, many = pp.passes_for(50_000, 0.95), pp.passes_for(10**9, 0.95)
    assert 6 <= few < many < 150


def test_stars_connect_what_links():
    hit = np.zeros((6, 6), bool)
    hit[0, 2] = hit[2, 5] = hit[3, 4] = True
    a, b = pp.stars(np.arange(10, 16), hit)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(12, 10), (15, 10), (14, 13)}
