"""Further functions and operators of the inventory."""

import pytest
from pyspark.sql import functions as F

from attriva.functions import nested, numeric
from attriva.functions import text as t
from attriva.operators import fillers as g
from attriva.operators import joins as j
from attriva.operators import predicates as p
from attriva.operators import reports as r
from attriva.plans.finalize import settled

L = F.lit


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda: numeric.spec_number(L("Диагональ, дюйм"), L('68,6 cm (27")')), "27"),
        (lambda: numeric.spec_number(L("Вес, кг"), L("500 g")), "0.5"),
        (lambda: numeric.spec_number(L("Размер, мм"), L("0,2331 x 0,2331 mm")), "0,2331 x 0,2331 mm"),
        (lambda: numeric.spec_number(L("Цвет"), L("5 kg")), "5 kg"),
        (lambda: numeric.spec_number(L("Частота, Гц"), L("60")), "60"),
        (lambda: t.free_text_gate(L("ftwwht/cblack/solred")), None),
        (lambda: t.free_text_gate(L("Cotton"), {"cotton": "хлопок"}), "хлопок"),
        (lambda: t.free_text_gate(L("Wool")), None),
        (lambda: t.free_text_gate(L(" 750W ")), "750W"),
        (lambda: t.free_text_gate(L("чистый  лён")), "чистый лён"),
        (lambda: numeric.card_sizes(F.array(L("INT"), L("ru")), F.array(F.struct(F.array(L("S"), L("44-46")).alias("details"), L("S").alias("tech_size")), F.struct(F.array(L("M")).alias("details"), L("M").alias("tech_size")))), ["44", "46", "48"]),
        (lambda: F.to_json(nested.option_map(F.array(F.struct(L("Цвет").alias("name"), L("a").alias("value")), F.struct(L("Цвет").alias("name"), L("b").alias("value"))), F.array(F.struct(L("хлопок").alias("name"), L(80).alias("percent"))))), '{"Цвет":"b","Состав":"хлопок 80%"}'),
        (lambda: nested.pick_language(F.array(F.struct(L("en").alias("lang"), L("x").alias("text")), F.struct(L("ru").alias("lang"), L("y").alias("text")))), "y"),
    ],
)
def test_case(spark, make, want):
    assert spark.range(1).select(make().alias("x")).first()[0] == want


def test_strategy_targets(spark):
    targets = spark.createDataFrame([(1, 10, None), (1, 11, "video"), (1, 12, None), (2, 10, None)], "category_id long, attribute_id long, semantic_type string")
    listed = spark.createDataFrame([(1, 10)], "category_id long, attribute_id long")
    assert {(x.category_id, x.attribute_id) for x in p.strategy_targets(targets, ("video",), listed).collect()} == {(1, 10), (2, 10)}


def test_gates(spark):
    schema = "product_id long, attribute_id long, target_name string, type string, value_str string, source string, evidence string, product_name string, text string"
    rows = spark.createDataFrame(
        [
            (1, 1, "Страна", "text", "Китай", "llm_knowledge", None, "Дрель", "сделано"), (1, 2, "Мощность, Вт", "text", "750 Вт", "llm_knowledge", None, "Дрель", "мощность 750 Вт"),
            (1, 3, "Мощность, Вт", "text", "900 Вт", "description", None, "Дрель", "мощность 750 Вт"), (1, 4, "Цвет", "text", "Дрель", "icecat", None, "Дрель", "x"), (1, 5, "Мощность, Вт", "text", "900 Вт", "web_search", None, "Дрель", "мощность 750 Вт"),
        ],
        schema,
    ).withColumns({"semantic_type": F.lit(None).cast("string"), "has_values": F.lit(False)})
    assert {x.attribute_id for x in p.hard_fact_guard(rows, F.col("text")).collect()} == {2, 4, 5}
    assert {x.attribute_id for x in p.verification_gate(rows, F.col("text")).collect()} == {1, 2, 4}


def test_more_fillers(spark):
    rows = spark.createDataFrame(
        [(1, 5, "Мощность", "мощность", "Вт", "Дрель мощность: 750 Вт. Есть реверс. Комплект: кейс, бита", "Bosch", "Bosch GSR", True, ["Bosch"])],
        "product_id long, attribute_id long, target_name string, keyword string, unit string, text string, brand string, product_name string, is_required boolean, allowed_values array<string>",
    )
    one = lambda df: [x.value_str for x in df.collect()]
    assert one(g.number_from_text(rows)) == ["750"]
    assert one(g.stated_boolean(rows.withColumn("keyword", F.lit("реверс")))) == ["Да"] and one(g.stated_boolean(rows.withColumn("keyword", F.lit("лазер")))) == []
    assert one(g.kit_contents(rows)) == ["кейс, бита"]
    assert one(g.model_from_title(rows)) == ["GSR"] and one(g.brand_from_context(rows)) == ["Bosch"]
    assert one(g.gender_fallback(rows.withColumn("product_name", F.lit("Куртка женская")))) == ["Женский"]
    rules = spark.createDataFrame([(1, 5, "bosch", "A", 1), (1, 5, None, "B", 2)], "category_id long, attribute_id long, when_contains string, value string, rule_no int")
    assert [(x.value_str, x.confidence) for x in g.defaults(rows.withColumn("category_id", F.lit(1)), rules).collect()] == [("A", 0.85)]
    cut = g.annotation_sentences(rows.withColumn("a", F.lit("Мощность 750 Вт. Вес 9 кг. Хорошая.")), "a", "text")
    assert cut.first().a == "Мощность 750 Вт. Хорошая."
    alias = spark.createDataFrame([(1, 1, "гарантия", "1 год"), (1, 2, "гарантийный срок", None)], "product_id long, attribute_id long, target_name string, value_str string")
    assert [(x.attribute_id, x.value_str) for x in g.cross_fill(alias, ("гарантия", "гарантийный срок")).collect()] == [(2, "1 год")]


def test_more_joins(spark):
    subjects = spark.createDataFrame([("s1", "k"), ("s2", "k")], "subject string, kind string")
    field_map = spark.createDataFrame([("s1__k", "f", "exact"), ("a__k", "f", "loose"), ("b__k", "f", "other")], "entry string, field string, mapped string")
    assert {(x.subject, x.mapped) for x in j.resolve_fields(subjects, field_map).collect()} == {("s1", "exact"), ("s2", "loose")}
    assert spark.range(1).select(j.match_option(F.lit("wi fi"), F.lit("Wi-Fi")).alias("x")).first().x == 3.0
    got = spark.range(1).select(j.value_matches(F.lit("Низкие"), F.lit("Низкий"), F.lit(None).cast("double"), F.lit(None).cast("array<string>")), j.value_matches(F.lit("5.1"), F.lit("5"), F.lit(0.2), F.lit(None).cast("array<string>"))).first()
    assert tuple(got) == (True, True)


def test_running_flag_and_drains(spark):
    rows = spark.createDataFrame([(1, 1, 1, 0.5, "ugc", None), (1, 1, 2, 0.9, "ugc", None), (1, 1, 3, 0.5, "ugc", None)], "product_id long, attribute_id long, seq long, confidence double, source string, semantic_type string")
    assert [x.settled for x in settled(rows, ["product_id", "attribute_id"]).orderBy("seq").collect()] == [False, False, True]
    grid = spark.createDataFrame([(1, False, 0, False, False, 0), (1, False, 0, True, False, 0), (1, False, 2, True, True, 0), (1, False, 2, True, True, 1), (1, True, 2, True, True, 1)], "attribute_id long, filled boolean, n_candidates long, card_found boolean, is_enum boolean, n_with_id long")
    assert sorted(x.drain for x in r.drains(grid).collect()) == ["A", "B", "C", "D"]
