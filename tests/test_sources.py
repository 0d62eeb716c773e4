import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from attriva.functions import payload
from attriva.sources import lookup, pages, shards


def test_listings_push_their_filters(spark, tmp_path):
    rows = [(c, 1, a, i, f"v{i}") for c in (1, 2) for a in range(4) for i in range(1, 30)]
    values = spark.createDataFrame(rows, "category_id int, type_id int, attribute_id int, value_id int, value string")
    lookup.write_values(values, str(tmp_path / "values"))
    got = lookup.list_values(spark, str(tmp_path / "values"), 1, 1, 2, after=3, most=5)
    assert [r.value_id for r in got.collect()] == [4, 5, 6, 7, 8]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(category_id" in plan and "PushedFilters: [IsNotNull(attribute_id), IsNotNull(value_id), EqualTo(attribute_id,2), GreaterThan(value_id,3)]" in plan
    listed = lookup.listed_values(values, page=10, most=25)
    assert listed.count() == 8 * 25 and {r.page for r in listed.collect()} == {0, 1, 2}
    asked = spark.createDataFrame([(1, 1, 2, "V1"), (1, 1, 2, "v29"), (1, 1, 2, "x"), (9, 1, 2, "v1"), (1, 1, 2, " "), (1, 1, 2, None)], "category_id int, type_id int, attribute_id int, query string")
    assert {(r.query, r.value_id) for r in lookup.search_values(asked, values).collect()} == {("V1", 1), ("v29", 29)}
    tree = spark.createDataFrame([(1, None, None), (2, 1, 7), (3, 1, None), (4, 3, 7), (5, 3, 8)], "id int, parent_id int, type_id int")
    assert {tuple(r) for r in lookup.category_of_type(tree).collect()} == {(7, 1), (8, 3)}


def test_page_cache(spark):
    kind = "url string, text string, fetched_at int"
    cache = pages.remembered(spark.createDataFrame([], f"key string, {kind}"), spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", "Access Denied", 3), ("c", "", 1), ("c", None, 2), (None, "x", 1)], kind))
    assert [(r.url, r.text) for r in cache.collect()] == [("a", "new")]
    again = pages.remembered(cache, spark.createDataFrame([("a", "captcha", 9), ("d", "d", 9)], kind))
    assert {(r.url, r.text) for r in again.collect()} == {("a", "new"), ("d", "d")}
    asked = spark.createDataFrame([("a",), ("b",), ("https://CDN.x.com/a",), ("https://www.vk.com:80/p",), ("https://notvk.com",), (None,), ("a",)], "url string")
    assert {(r.url, r.state, r.text) for r in pages.to_fetch(asked, again).collect()} == {("a", "hit", "new"), ("b", "miss", None), ("https://CDN.x.com/a", "skip", None), ("https://www.vk.com:80/p", "skip", None), ("https://notvk.com", "miss", None)}
    tries = spark.createDataFrame([("a", 1, ""), ("a", 2, "captcha"), ("b", 1, ""), ("b", 2, "fine"), ("c", 3, ""), ("d", 1, None)], "url string, attempt int, text string")
    assert {(r.url, r.attempt, r.wait) for r in pages.retries(tries).collect()} == {("a", 3, 2.0), ("d", 2, 1.0)}


def test_shards(spark, tmp_path):
    rng = np.random.default_rng(1)
    vectors = {k: rng.standard_normal((n, 5)).astype(np.float32) for k, n in (("000", 7), ("001", 5000), ("002", 3))}
    for k, v in vectors.items():
        np.save(tmp_path / f"vectors_{k}.npy", v if k != "001" else v.astype(np.float64))
    pq.write_table(pa.table({"variantid": pa.array([1, 2, None, 4, 5]), "name": pa.array(["a", None, "c", "d", "e"])}), tmp_path / "payloads_000.parquet")
    pq.write_table(pa.table({"variantid": pa.array(range(4, 5004)), "name": pa.array(["n"] * 5000)}), tmp_path / "payloads_001.parquet", row_group_size=700)
    got = {r.variantid: r for r in shards.import_shards(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, *range(4, 5004)} and got[2].name == "" and got[1].description == ""
    assert got[2].vector == vectors["000"][1].tolist() and got[4].vector == vectors["001"][0].tolist() and got[5003].vector == vectors["001"][4999].tolist()
    rows = spark.createDataFrame([("s", i, [float(i), 0.5]) for i in range(9)], "shard string, row_index long, vector array<float>")
    back = shards.vectors_of(shards.encoded(rows, "shard", "row_index", "vector"), "shard", "content")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


@pytest.mark.parametrize(("field", "good", "bad"), [
    ("offer_id", "x", ""), ("offer_id", "x" * 50, "x" * 51), ("name", "n", None), ("description", None, "d" * 4001), ("price", " 5.5 ", "0"), ("price", "1", "free"), ("old_price", None, "-1"), ("vat", None, "0.2"), ("vat", "0.10", "20"),
    ("weight", 1, 0), ("weight_unit", None, "lb"), ("dimension_unit", "in", "m"), ("width", 1, None), ("images", ["a"] * 15, ["a"] * 16), ("images", ["a"], []),
])
def test_product_errors(spark, field, good, bad):
    base = {"offer_id": "x", "name": "n", "description": "d", "price": "1", "old_price": "2", "vat": "0", "images": ["a"], "weight": 1, "weight_unit": "g", "depth": 1, "width": 1, "height": 1, "dimension_unit": "mm"}

    def errors(value):
        def column(k, v):
            if k == "images":
                return F.array(*map(F.lit, v)).cast("array<string>")
            return F.lit(v).cast("int" if isinstance(base[k], int) else "string")

        return spark.range(1).select(payload.product_errors({k: column(k, v) for k, v in (base | {field: value}).items()})).first()[0]

    assert errors(good) == [] and errors(bad) == [field]


def test_answers(spark):
    texts = ['{"a": 1, "b": "x"}', '```json\n{"a": 2}\n```', '```\n{"a": 3}', '{"b": "x"}', "no", "", None, '{"a": "five"}', '[1]', ' {"a": 6, "z": {"q": 1}} ']
    df = spark.createDataFrame(list(enumerate(texts)), "k int, s string")
    got = {r.k: r.v.a if r.v is not None else None for r in df.select("k", payload.parsed_answer(F.col("s"), "a int, b string", ("a",)).alias("v")).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: None, 4: None, 5: None, 6: None, 7: None, 8: None, 9: 6}
