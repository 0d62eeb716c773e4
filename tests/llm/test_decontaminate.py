import random

import brute
import fixtures

from attriva.llm import decontaminate as dc

ITEMS = "item_id string, text string, extra int"


def tables(spark):
    rng = random.Random(7)
    long = [fixtures.words(rng, 30, 10_000) for _ in range(5)]
    items = [(str(i), " ".join(w), i) for i, w in enumerate(long)] + [("9", "Short Item, here", 1), ("10", None, 1), ("11", "...", 1), ("0", " ".join(long[0]), 1)]
    fill = lambda n: " ".join(fixtures.words(rng, n, 10_000))
    texts = [f"{fill(50)} {' '.join(long[0])} {fill(20)}", f"{fill(5)} {' '.join(long[1][4:17]).upper()}, {fill(400)}", f"short-item HERE {fill(3)}", f"{' '.join(long[2][:12])} {fill(9)}", None, "", " ".join(long[3][3:20] + long[3][3:20]), "word " * 2000]
    return [(i, t) for i, t in enumerate(texts)], items


def result(spark, rows, items, **kw):
    from pyspark.sql import functions as F

    out = dc.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, ITEMS), **kw)
    got = out.select("doc_id", "n_words", "n_hit", F.size("items").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("sha"), "contaminated").collect()
    return {r[0]: tuple(r)[1:] for r in got}


def test_against_brute_force(spark):
    rows, items = tables(spark)
    want = brute.contamination(rows, [(i, t) for i, t, _ in items])
    assert result(spark, rows, items) == want
    assert any(v[4] for v in want.values()) and not all(v[4] for v in want.values())
    assert result(spark, rows, items, block_bytes=300) == want  # items in several blocks


def test_empty_tables(spark):
    rows, items = tables(spark)
    assert result(spark, [], items) == {}
    assert all(v[1:3] == (0, 0) for v in result(spark, rows, []).values())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha beta gamma"), (3, "gamma beta alpha x x x")], "doc_id long, text string")
    index = dc.build_index(docs)
    hits = lambda slop: sorted(r.doc_id for r in dc.phrase_hits(index, [("p", "alpha beta gamma")], slop=slop).collect() if r.matches)
    assert hits(0) == [2] and hits(1) == [1, 2]


def test_repeated_and_null_ids_give_rows_in_every_number_of_blocks(spark):
    rows, items = tables(spark)
    rows = [*rows, (0, "two words"), (0, rows[0][1]), (None, rows[2][1]), (None, "x"), (1, None)]
    docs, frame = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
    one, many = (sorted(dc.contamination(docs, frame, block_bytes=b).collect(), key=str) for b in (16_000_000, 300))
    assert one == many and len(one) == len(rows)
    assert sorted(r.n_words for r in one if r.doc_id is None) == [1, 6]


def test_many_windows_with_common_terms(spark):
    rng = random.Random(11)
    items = [(str(i), " ".join(fixtures.words(rng, rng.randrange(1, 40), 12)), 0) for i in range(80)]
    rows = [(i, " ".join(fixtures.words(rng, 3000 if i == 0 else rng.randrange(60), 12))) for i in range(60)]
    assert result(spark, rows, items) == brute.contamination(rows, [(i, t) for i, t, _ in items])


def test_clean_rows_stay(spark):
    rows, items = tables(spark)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows] + [(None, rows[0][1], "y", 2)], "doc_id long, text string, _bad_id string, Gone int")
    kept = dc.decontaminate(df, spark.createDataFrame(items, ITEMS))
    want = {d for d, v in brute.contamination(rows, [(i, t) for i, t, _ in items]).items() if not v[4]}
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == want | {None}
    assert kept.limit(0).columns == dc.decontaminate(df.limit(0), spark.createDataFrame(items, ITEMS)).columns and dc.decontaminate(df.limit(0), spark.createDataFrame(items, ITEMS)).count() == 0
