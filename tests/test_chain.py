"""The whole chain: each guard fires on one product and leaves its neighbour alone."""

from attriva.plans.finalize import whole_chain

TARGETS = [
    (1, "Бренд", "text", "brand", None, False, False), (2, "Цвет", "enum", "color", ["Красный", "Синий"], True, False), (3, "Мощность, Вт", "numeric", "power", None, False, False), (4, "Страна-изготовитель", "text", None, None, False, False),
    (5, "Особенности", "enum", None, ["Таймер", "Подсветка", "Дисплей"], True, False), (6, "ТН ВЭД", "text", None, None, False, False), (7, "Режимы работы", "text", None, None, False, False), (8, "Диаметр сверления бетона", "text", None, None, False, False), (9, "Вид", "enum", None, ["А", "Б"], True, True),
]
KIND = "product_id int, attribute_id int, seq int, value_str string, value_arr array<string>, is_list boolean, confidence double, source string, evidence string, semantic_type string, is_collection boolean, value_id long, value_ids array<long>"


def candidate(product, attribute, seq, value, source="wb_card", confidence=0.9, evidence="card", value_id=1, ids=None, collection=False):
    many = isinstance(value, list)
    return (product, attribute, seq, None if many else value, value if many else None, many, confidence, source, evidence, None, collection or many, None if many else value_id, ids)


def test_every_step(spark):
    rows = [
        candidate(1, 1, 0, "Угаданный", "vision"), candidate(1, 2, 1, "красный ", "description"), candidate(1, 3, 2, "700", "description", evidence="700 Вт"), candidate(1, 3, 3, "700", "llm_knowledge"),  # the last is backed by the first
        candidate(2, 3, 0, "800", "competitor_rag"),  # no authority says so
        candidate(2, 2, 1, "нет"), candidate(2, 9, 2, "В"), candidate(2, 4, 3, "Китай", "llm_knowledge"),  # placeholder, no option, a country that is inferred
        candidate(3, 5, 0, ["Таймер"], ids=[10]), candidate(2, 5, 4, ["Шум"], ids=[5]), candidate(3, 5, 1, ["Дисплей"], "ozon_card", ids=[12]), candidate(3, 2, 2, "Синий", confidence=0.0), candidate(3, 2, 3, ["Красный", "Синий"]),  # united; zero confidence; a palette
        candidate(4, 6, 0, "6109100000", "web_search"), candidate(4, 6, 1, "6109100010", "llm_knowledge", evidence="tnved_resolver: x"), candidate(4, 7, 2, "Сверление"), candidate(4, 8, 3, "10"),
        candidate(5, 1, 0, "Чужой"), candidate(5, 3, 1, "Да", "wb_card"), candidate(5, 9, 2, "А", value_id=None), candidate(5, 2, 3, "Синий", evidence="guessed: not specified"),
    ]
    products = [(1, "Чайник", None, ["Чайники"], "мощность 700 Вт"), (2, "Тостер", None, ["Тостеры"], "x"), (3, "Лампа", None, ["Лампы"], "x"), (4, "Дрель ударная", None, ["Дрели"], "x"), (5, "Утюг Braun 5", None, ["Утюги"], "x")]
    got = whole_chain(
        spark.createDataFrame(rows, KIND), spark.createDataFrame(TARGETS, "attribute_id int, target_name string, type string, semantic_type string, allowed_values array<string>, has_values boolean, is_required boolean"),
        spark.createDataFrame(products, "product_id int, product_name string, brand string, category_path array<string>, text string"), spark.createDataFrame([("Braun", 77, 0), ("Чайник", 78, 1)], "brand string, value_id long, seq int"),
    ).collect()
    values = {(r.product_id, r.attribute_id): r.value_arr if r.is_list else r.value_str for r in got}
    assert values == {
        (1, 2): "Красный", (1, 3): "700", (3, 5): ["Таймер", "Дисплей"], (4, 6): "6109100010", (4, 7): ["Сверление", "Сверление с ударом"], (4, 8): "10", (5, 1): "Braun",
    }
    brand = next(r for r in got if (r.product_id, r.attribute_id) == (5, 1))
    assert (brand.value_id, brand.evidence, brand.source) == (77, "brand_from_name", "description")
