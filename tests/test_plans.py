"""Expensive expressions stand in a plan once: no filter on their results repeats them below."""

from pyspark.sql import functions as F

from attriva.functions import composition as c
from attriva.functions import text as t
from attriva.operators import consistency, donors
from attriva.operators import predicates as p


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_membership_scores_once(spark):
    schema = "id long, target_name string, options string, value_str string, value_arr array<string>, is_list boolean, value_ids array<long>, evidence string"
    rows = spark.createDataFrame([(1, "Цвет", "Красный|Синий", "красный ", None, False, None, None), (2, "Цвет", "Красный|Синий", "Зелёный", None, False, None, None), (3, "Бренд", "A", "B", None, False, None, None)], schema)
    out = p.membership_guard(rows.withColumn("allowed_values", F.split("options", "[|]"))).select("id", "value_str")
    assert {tuple(r) for r in out.collect()} == {(1, "Красный"), (3, "B")}
    text = plan(out)
    assert text.count("run(") == 1 and text.count("regexp_replace") <= 2 * 25


def test_strong_forms_without_latin_letters(spark):
    texts = ["Быстрозажимной - Патрон", "W 5", "mm", "MM", "Fully-Modular", "12 пин+", None, "", "ёлка", "1 v"]
    got = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string").orderBy("k").select(t.strong_token(F.col("x"))).collect()]
    assert got == ["быстрозажимной патрон", "вт 5", "мм", "мм", "полностью модульный", "12 пин +", None, "", "елка", "1 в"]


def test_compositions_flatten_a_page_once(spark):
    one = spark.createDataFrame([("<p>x</p>",)], "html string")
    assert plan(one.select(c.compositions(F.col("html")).alias("listed"))).count("&nbsp;") == 1
    words = ["80% хлопок", "Лён 20 %", "20%", "лён", "; ", "—", " и ", "нетканый", "<b>", "Ⅷ", "٣% шёлк", "ſilk 5%", "натуральная  кожа 7%", "100%100% лён", "льняной70%лён", "𝒳", "\n"]
    texts = ["".join(words[(k * 7 + j * (k + 3)) % len(words)] for j in range(9)) for k in range(120)]
    df = spark.createDataFrame([(x,) for x in texts], "t string").select("t", c.places(F.col("t"), c._PAIR).alias("all"), c._pair_places(F.col("t")).alias("own"))
    rows = df.collect()
    assert [r.own for r in rows] == [r.all for r in rows] and sum(len(r.own) for r in rows) > 100


def test_donors_score_each_tuple_once(spark):
    pool = spark.createDataFrame([(k, k % 2, "Кеды Puma RS-X 380", "Кеды Puma", "Кеды", "Puma") for k in range(4)], "id int, place int, q string, title string, leaf string, brand string")
    best = donors.pick_donor(donors.scored(pool, "q", "title", "leaf", "brand"), "id", "place", "ozon_card")
    assert best.count() == 4
    text = plan(best)
    assert text.count("run(") == 2 and text.index("Aggregate") > text.rindex("run(")
    assert "BroadcastHashJoin" not in best._jdf.queryExecution().executedPlan().toString()


def test_contradictions_broadcast_no_products(spark, tmp_path):
    """From files, whose small size is what the planner goes by."""
    for name, rows, schema in (
        ("merged", [(1, 6, "55", None, False, None, 0.9, "wb_card", "")], "product_id int, attribute_id int, value_str string, value_arr array<string>, is_list boolean, value_id int, confidence double, source string, evidence string"),
        ("targets", [(1, 6, "Диагональ экрана, дюймы", 0)], "product_id int, attribute_id int, target_name string, seq int"), ("products", [(1, "TV 43")], "product_id int, product_name string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
    out = consistency.contradictions(*[spark.read.parquet(f"{tmp_path}/{name}") for name in ("merged", "targets", "products")])
    assert out.count() == 0
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
