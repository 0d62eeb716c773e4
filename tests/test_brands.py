from pyspark.sql import functions as F

from attriva.operators import brands

BRANDS = ["NORTH", "The North Face", "Original", "Adidas Originals", "Nike", "Sportswear", "Club", "Спортивные", "Мужские", "Футболки", "Levi's", "Dri-FIT", "HP", "ab"]


def run(spark, rows, listed=BRANDS):
    titles = spark.createDataFrame(rows, "product_id int, title string, brand string, category_path array<string>")
    dictionary = spark.createDataFrame([(b, 100 + i, i) for i, b in enumerate(listed)] or [("", 0, 0)], "brand string, value_id int, seq int")
    return {r.product_id: (r.brand, r.value_id, r.origin) for r in brands.title_brands(titles, dictionary).collect()}


def test_title_brands(spark):
    path = ["Одежда", "Футболки мужские"]
    rows = [
        (1, "Куртка The North Face синяя", None, path), (2, "Кеды adidas originals", None, path), (3, "Футболка Nike Sportswear Club", None, path), (4, "Спортивные штаны", None, path), (5, "Мужские футболки Nike", None, path),
        (6, "Джинсы Levis 501", None, path), (7, "Футболка DRIFIT", None, path), (8, "Ноутбук HP 15", " HP ", path), (9, "Футболки белые", "Футболки", path), (10, "Спортивные брюки", "Спортивные", path), (11, "Мужские брюки", "мужские", path),
        (12, "Ноутбук LG", "LG", path), (13, "Ноутбук", "LG", path), (14, None, "LG", None), (15, "", "LG", path), (16, "Умная колонка", "колонка", ["Электроника", "Умные колонки"]), (17, "Колонка Яндекс", "Яндекс", None), (18, "Футболка Club Nike", None, path), (19, "ab cd", "ab", path), (20, "x y", "y", path),
    ]
    assert run(spark, rows) == {
        1: ("The North Face", 101, "dictionary"), 2: ("Adidas Originals", 103, "dictionary"), 3: ("Nike", 104, "dictionary"), 5: ("Nike", 104, "dictionary"), 6: ("Levi's", 110, "dictionary"), 7: ("Dri-FIT", 111, "dictionary"),
        8: ("HP", None, "needle"), 12: ("LG", None, "needle"), 17: ("Яндекс", None, "needle"), 18: ("Club", 106, "dictionary"), 19: ("ab", None, "needle"),
    }
    assert run(spark, [(1, "Кеды Puma", "Puma", path)], []) == {1: ("Puma", None, "needle")}


def test_fill_and_overwrite(spark):
    kind = "product_id int, attribute_id int, value_str string, value_id int, confidence double, source string, evidence string"
    merged = spark.createDataFrame([(1, 31, "Чужой", 5, 0.9, "wb_card", "x"), (2, 31, "nike", 6, 0.9, "wb_card", "x"), (3, 31, "Свой", 7, 0.9, "wb_card", "x"), (1, 8, "Чужой", 8, 0.9, "wb_card", "x")], kind)
    targets = spark.createDataFrame([(1, 31, "y"), (2, 31, "y"), (3, 31, "y"), (4, 77, "Торговая марка"), (4, 8, "Цвет"), (1, 8, "Цвет")], "product_id int, attribute_id int, target_name string")
    found = spark.createDataFrame([(1, "Nike", 1), (2, "Nike", 1), (4, "Puma", None)], "product_id int, brand string, value_id int")
    got = sorted(tuple(r) for r in brands.brand_from_name(merged, targets, found).collect())
    new = (0.95, "description", "brand_from_name")
    assert got == [(1, 8, "Чужой", 8, 0.9, "wb_card", "x"), (1, 31, "Nike", 1, *new), (2, 31, "nike", 6, 0.9, "wb_card", "x"), (3, 31, "Свой", 7, 0.9, "wb_card", "x"), (4, 77, "Puma", None, *new)]


def test_adjectives(spark):
    row = spark.range(1).select(*[brands.is_adjective(F.lit(x)) for x in ("спортивные", "чёрные", "nike", "адидас", "дне", "Прямые брюки")]).first()
    assert tuple(row) == (True, True, False, False, False, False)
