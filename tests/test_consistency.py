import itertools

from attriva.operators import consistency as c

KIND = "product_id int, attribute_id int, value_str string, value_arr array<string>, is_list boolean, value_id int, confidence double, source string, evidence string"


def row(p, a, value, source="wb_card", evidence="", value_id=None):
    return (p, a, None if isinstance(value, list) else value, value if isinstance(value, list) else None, isinstance(value, list), value_id, 0.9, source, evidence)


def plain(r):
    return r.value_arr if r.is_list else r.value_str


NAMES = {1: "Диаметр сверления бетона, мм", 2: "Режимы работы", 3: "Комплектация", 4: "Тип патрона", 5: "Тип*", 6: "Диагональ экрана, дюймы", 7: "Линейка мобильных устройств", 8: "Цвет"}
CASES = [
    ("a drill", {1: "10", 2: "Сверление"}, {1: "10", 2: ["Сверление", "Сверление с ударом"]}),
    ("a drill", {1: "10", 2: ["Сверление", "Шуруповерт"]}, {1: "10", 2: ["Сверление", "Шуруповерт", "Сверление с ударом"]}),
    ("a drill", {1: "10", 2: "Сверление с ударом"}, {1: "10", 2: "Сверление с ударом"}),
    ("a drill", {1: ("10", "llm_knowledge"), 2: "Сверление"}, {1: "10"}),
    ("a drill", {1: "", 2: "Сверление"}, {1: "", 2: "Сверление"}),
    ("a drill", {3: "дрель, ключевой патрон", 4: "Быстрозажимной"}, {3: "дрель, ключевой патрон", 4: "ключевой"}),
    ("a drill", {3: "патрон быстрозажимной и ключевой патрон", 4: "SDS"}, {3: "патрон быстрозажимной и ключевой патрон", 4: "SDS"}),
    ("a drill", {3: ("ключевой патрон", "llm_knowledge"), 4: ("Быстрозажимной", "ozon_card")}, {3: "ключевой патрон", 4: "Быстрозажимной"}),
    ("a drill", {4: "SDS-Plus", 5: "Дрель"}, {5: "Дрель"}),
    ("a drill", {4: "SDS-Plus", 5: "Перфоратор-дрель"}, {4: "SDS-Plus", 5: "Перфоратор-дрель"}),
    ("a drill", {3: ("ключевой патрон", "llm_knowledge"), 4: ("SDS-Plus", "ozon_card"), 5: "Дрель"}, {3: "ключевой патрон", 4: "ключевой", 5: "Дрель"}),
    ("TV LG 43UR7800 5", {6: "55\""}, {}), ("TV LG 43 дюйма", {6: "43"}, {6: "43"}), ("TV LG", {6: "55"}, {6: "55"}), ("TV LG 43", {6: "55.5"}, {}), ("TV LG 43", {6: "5,5 или 43"}, {6: "5,5 или 43"}), ("TV LG 5 300", {6: "55"}, {6: "55"}),
    ("Смартфон Galaxy S 24", {7: "Galaxy S23"}, {}), ("Смартфон Galaxy S 23", {7: "Galaxy S 23"}, {7: "Galaxy S 23"}), ("Смартфон iPhone 15", {7: "Galaxy S23"}, {7: "Galaxy S23"}), ("Redmi Note 12", {7: "Redmi Note"}, {7: "Redmi Note"}),
    ("a drill", {8: "x"}, {8: "x"}), (None, {6: "55", 7: "S 5"}, {6: "55", 7: "S 5"}),
]


def test_five_rules_on_both_sides(spark):
    merged = [row(p, a, v[0] if isinstance(v, tuple) else v, v[1] if isinstance(v, tuple) else "wb_card") for p, (_, own, _) in enumerate(CASES) for a, v in own.items()]
    targets = [(p, a, n, a) for p in range(len(CASES)) for a, n in NAMES.items()] + [(0, 99, "Режим работы (ещё)", 99)]
    products = [(p, n) for p, (n, _, _) in enumerate(CASES)]
    got = {}
    for r in c.contradictions(spark.createDataFrame(merged, KIND), spark.createDataFrame(targets, "product_id int, attribute_id int, target_name string, seq int"), spark.createDataFrame(products, "product_id int, product_name string")).collect():
        got.setdefault(r.product_id, {})[r.attribute_id] = plain(r)
    for p, (name, own, want) in enumerate(CASES):
        assert (name, own, got.get(p, {})) == (name, own, {a: v if not isinstance(v, tuple) else v[0] for a, v in want.items()})


def test_defaults(spark):
    merged = [row(1, 10, "old", value_id=3), row(1, 20, "ATX"), row(1, 31, "3"), row(2, 20, "x"), row(3, 8292, "group"), row(3, 40, "y")]
    targets = [(p, a, "form_factor" if a == 20 else None) for p in (1, 2, 3) for a in (10, 20, 30, 31, 8292)] + [(4, 10, None)]
    products = [(1, 5, "Блок"), (2, 5, "Блок SFX-L мини"), (3, 6, None), (4, 5, "Блок")]
    defaults = [(5, 10, "new", 9), (5, 77, "no target", None)]
    rules = [(5, 1, "sfx-l", 30, "13"), (5, 2, "SFX", 30, "12"), (5, 3, "ATX", 30, "15"), (5, 3, "ATX", 31, "14")]
    got = {(r.product_id, r.attribute_id): (r.value_str, r.value_id, r.confidence) for r in c.category_defaults(
        spark.createDataFrame(merged, KIND), spark.createDataFrame(targets, "product_id int, attribute_id int, semantic_type string"), spark.createDataFrame(products, "product_id int, category_id int, product_name string"),
        spark.createDataFrame(defaults, "category_id int, attribute_id int, value string, value_id int"), spark.createDataFrame(rules, "category_id int, rule_no int, token string, attribute_id int, value string")).collect()}
    assert got == {(1, 10): ("new", 9, 0.85), (1, 20): ("ATX", None, 0.9), (1, 31): ("3", None, 0.9), (1, 30): ("15", None, 0.7), (2, 10): ("new", 9, 0.85), (2, 20): ("x", None, 0.9), (2, 30): ("13", None, 0.7), (3, 40): ("y", None, 0.9), (4, 10): ("new", 9, 0.85)}


def test_shared_values_are_the_plain_steps(spark):
    """Every set of filled fields, and of wanted ones, against the steps one after another."""
    ids = sorted({x for pair in c.SAME_VALUE for x in pair})
    cases = [(f, w) for n in range(len(ids) + 1) for f in itertools.combinations(ids, n) for w in (ids, ids[::2], ids[1:])]
    want = {}
    for p, (filled, wanted) in enumerate(cases):
        now = {x: f"v{x}" for x in filled}
        for pair in c.SAME_VALUE:
            for a, b in (pair, pair[::-1]):
                if b not in now and b in wanted and a in now:
                    now[b] = now[a]
        want[p] = now
    merged = [row(p, x, f"v{x}") for p, (filled, _) in enumerate(cases) for x in filled]
    targets = [(p, x, None) for p, (_, wanted) in enumerate(cases) for x in wanted]
    none = spark.createDataFrame([], "category_id int, attribute_id int, value string, value_id int")
    rules = spark.createDataFrame([], "category_id int, rule_no int, token string, attribute_id int, value string")
    got = {p: {} for p in want}
    for r in c.category_defaults(spark.createDataFrame(merged, KIND), spark.createDataFrame(targets, "product_id int, attribute_id int, semantic_type string"), spark.createDataFrame([(p, 1, "x") for p in want], "product_id int, category_id int, product_name string"), none, rules).collect():
        got[r.product_id][r.attribute_id] = r.value_str
    assert got == want
