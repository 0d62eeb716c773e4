import pytest
from pyspark.sql import functions as F

from attriva.functions import fuzzy
from attriva.functions import text as t
from attriva.operators import donors
from attriva.operators import predicates as p


def value(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(("brand", "name", "title", "want"), [
    ("Nike", "Футболка Nike", "Футболка Shilla", True), ("Nike", "Футболка Nike", "Футболка мужская Nike Sportswear", False), ("Nike", "Футболка Nike", "Футболка мужская", False),
    (None, "Футболка", "Футболка Shilla", False), ("Найк", "Футболка", "Футболка Shilla", False), ("The North Face", "Куртка", "Куртка The North Face Resolve", False),
    ("The North Face", "Куртка", "Куртка North Ridge", True), ("Nike", "Футболка Nike Air", "Футболка Air", False), ("LG", "x", "Samsung tv", False),
])
def test_brand_conflict(spark, brand, name, title, want):
    assert value(spark, p.brand_conflict(F.lit(brand), F.lit(name), F.lit(title))) == (want,)


@pytest.mark.parametrize(("a", "b", "want"), [
    ("POCO X6 Pro", "POCO X6", True), ("POCO X6", "POCO M8", True), ("POCO X6 Pro 5G", "Смартфон POCO X6 Pro", False), ("iPhone 15", "iPhone 14", False), ("GSR120", "GSR120 GSB13", False), (None, "X6", False),
])
def test_model_conflict(spark, a, b, want):
    assert value(spark, p.model_conflict(F.lit(a), F.lit(b))) == (want,)


def test_tokens(spark):
    lit = F.lit
    assert value(spark, t.model_tokens(lit("De’Longhi EC685.M и WH-1000XM5, 24 V2"))) == (["ec685.m", "wh-1000xm5"],)
    assert value(spark, t.alpha_tokens(lit("Куртка мужская Resolve для The North 27 дюймов"))) == (["куртка", "resolve", "north"],)
    assert value(spark, t.category_in_title(lit("Дрели ударные"), lit("Дрель BOSCH")), t.category_in_title(lit("Куртки"), lit("Шорты мужские")), t.category_in_title(lit(""), lit("x"))) == (True, False, False)
    assert value(spark, *[t.card_gender(lit(x)) for x in ("Кроссовки мужские", "womens", "мужские и женские", "унисекс мужской", "Ultraboost 22")]) == ("male", "female", None, "unisex", None)
    assert value(spark, *[p.gender_conflict(lit(a), lit(b)) for a, b in (("мужские", "женские"), ("мужские", "x"), ("унисекс", "женские"))]) == (True, False, False)
    assert value(spark, *[donors.type_fits(lit(a), lit(b)) for a, b in (("футболка", "Футболки / Топы"), ("куртка", "шорты"), ("куртка", "Куртками"), ("куртка", None), (None, "шорты"), ("худи", "Худи"))]) == (True, False, True, True, True, True)


def test_scores_are_the_plain_sum(spark):
    rows = [(1, 0, "Кроссовки Puma RS-X 380", "Кроссовки Puma RS-X 380 мужские", "Кроссовки", "Puma"), (1, 1, "Кроссовки Puma RS-X 380", "Кеды Vans", "Кроссовки", "Puma"), (2, 0, "Куртка мужская Resolve", "Шорты женские Resolve", "Куртки", None), (2, 1, "Куртка мужская Resolve", " ", "Куртки", None), (3, 0, "Куртка мужская Resolve", "Шорты женские Resolve", "Куртки", None)]
    pool = spark.createDataFrame(rows, "id int, place int, q string, title string, leaf string, brand string")
    got = {(r.id, r.place): r.score for r in donors.scored(pool, "q", "title", "leaf", "brand").collect()}
    base = lambda a, b: (fuzzy.partial_ratio(a.lower(), b.lower()) + fuzzy.token_sort_ratio(a.lower(), b.lower())) / 2
    more = {(1, 0): 5, (1, 1): -60, (2, 0): 3 - 30 - 30, (3, 0): 3 - 30 - 30}
    assert got == pytest.approx({(r[0], r[1]): base(r[2], r[3]) + more[r[0], r[1]] for r in rows if r[3].strip()})


def test_the_pick(spark):
    pool = spark.createDataFrame([(1, 0, 70.0), (1, 1, 80.0), (1, 2, 80.0), (2, 0, -5.0), (3, 0, 64.5), (4, 0, 66.0)], "id int, place int, score double")
    assert {(r.id, r.place, r.grade) for r in donors.pick_donor(pool, "id", "place", "ozon_card").collect()} == {(1, 1, "exact"), (3, 0, "skip"), (4, 0, "brand_line")}


def test_the_rich_pick(spark):
    rows = [(1, 0, "RS-X38", "a RS-X38", "кеды", 2, 90.0), (1, 1, "RS-X38", "a", "кеды", 9, 90.0), (2, 0, "a", "b", "шорты", 5, 99.0), (3, 0, "a", "b", None, 3, 70.0), (3, 1, "a", "c", "кеды", 5, 66.0), (4, 0, "a", "b", "кеды", 9, 10.0), (4, 1, "a", "b", "кеды", 1, 20.0)]
    pool = spark.createDataFrame(rows, "id int, place int, q string, title string, labels string, n int, score double").withColumn("type", F.lit("кеды"))
    got = {(r.id, r.place, r.grade) for r in donors.pick_rich_donor(pool, "id", "place", "q", "title", "type", "labels", "n").collect()}
    assert got == {(1, 0, "exact"), (3, 1, "brand_line"), (4, 1, "skip")}
