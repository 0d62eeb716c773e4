import itertools
import re

import fixtures
import numpy as np

from attriva.llm import filter_audit as fa

NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def brute(rows, labels):
    """All orders applied document by document."""
    marks = {}
    for i, quality, toxic in (x for x in labels if x[0] is not None):
        was = marks.get(i, (0, 0))
        marks[i] = max(was[0], quality or 0), max(was[1], toxic or 0)
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    docs = []
    for r in rows:
        x = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", x)) > 3 * len(x), "D": bool(re.search(r"[#$%&*|]", x)), "E": r[0] is not None and first[x] < r[0]}
        docs.append((r[2] or "", {k for k in bad if bad[k]}, *marks.get(r[0], (0, 0))))
    want, shapley = {}, {}
    for part in {d[0] for d in docs}:
        for order in itertools.permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, x in enumerate(order, 1):
                out = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                want[part, "".join(order), step] = (len(left), len(out), sum(x in d[1] for d in gone), sum(d[0] == part and d[1] == {x} for d in docs), sum(d[2] == 1 for d in out), sum(d[3] == 1 for d in out))
                shapley[part, x] = shapley.get((part, x), 0) + len(out)
                gone += out
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in want.items()}


def test_the_audit_is_the_plain_one(spark):
    rows = fixtures.rows()
    rows += [(100, "word " * 250, "de", "s", 0, 0, "", ""), (101, " ".join(f"v{i}" for i in range(300)) + " #", None, "s", 0, 0, "", ""), (102, " ".join(f"V{i}" for i in range(300)), "", "s", 0, 0, "", ""), (103, rows[0][1], "de", "s", 0, 0, "", "")]
    rows += [(None, rows[0][1], "de", "s", 0, 0, "", ""), (None, "only here", None, "s", 0, 0, "", ""), (104, " ".join(f"long{i}" for i in range(40_000)), "de", "s", 0, 0, "", "")]
    labels = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(0, 110, 2)] + [(1, None, 1), (0, 0, 0), (None, 1, 1), (999, 1, 1)]
    got = fa.audit(fixtures.frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): (*(r[n] for n in NAMES), r.shapley) for r in got} == brute(rows, labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(fixtures.empty(spark), none).count() == 0
    assert {r.good_lost for r in fa.audit(fixtures.frame(spark), none).collect()} == {0}


def test_the_walk_visits_each_order_once():
    for n in range(1, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for k in fa.adjacent_swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert seen == set(itertools.permutations(range(n)))


def test_shapley_sums_to_all_removals():
    rng = np.random.default_rng(2)
    rows = fa.walk(np.arange(32), np.column_stack([rng.integers(0, 9, 32), np.zeros((32, 2), int)]))
    by_letter = {r[0][r[1] - 1]: r[-1] for r in rows}
    assert sum(by_letter.values()) == sum(r[3] for r in rows) and all(v == sum(r[3] for r in rows if r[0][r[1] - 1] == x) for x, v in by_letter.items())
