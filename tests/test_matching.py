import random

import pytest
from pyspark.sql import functions as F

from attriva.functions import fuzzy
from attriva.operators import customs, matching

RU = {"power": "мощность", "power output": "мощность", "weight": "вес", "warranty": "гарантия", "color": "цвет"}


def plain(features, targets, negatives):
    """All targets scored for every feature."""
    out, used = {}, set()
    for product, key, seq, name, value in sorted(features, key=lambda f: f[2]):
        if not name or not value:
            continue
        absent = value.strip().lower() in matching.NEGATIVES
        if absent and not negatives:
            continue
        own = name.strip()
        held = sorted((k for k in RU if k in own.lower()), key=lambda k: -len(k))
        own = RU[held[0]] if held else own
        goals = [t for t in targets if t[0] == key]

        def best(text, scorer):
            rated = [(scorer(text, t[2]), -k) for k, t in enumerate(goals)]
            top = max(rated, default=(0, 0))
            return goals[-top[1]] if top[0] >= 65 else None

        hit, rank = best(own, fuzzy.weighted_ratio), 1
        if hit is None and len(own) <= 8:
            hit, rank = best(own, fuzzy.partial_ratio), 2
        if hit is None and own != name:
            hit, rank = best(name, fuzzy.weighted_ratio), 3
        if hit is None or (product, hit[1]) in used or (absent and hit[3] != "bool"):
            continue
        used.add((product, hit[1]))
        out[product, hit[1]] = (seq, name, "Нет" if absent else value, rank)
    return out


@pytest.mark.parametrize("negatives", [False, True])
def test_features_against_all_pairs(spark, negatives):
    rng = random.Random(4)
    words = ["вес", "мощность", "цвет", "материал", "длина", "кабеля", "частота", "обновления", "класс", "power", "weight", "Bluetooth", "размер экрана", "гарантия"]
    targets = [(k, 10 * k + i, " ".join(rng.sample(words, rng.randint(1, 3))) + rng.choice(["", ", кг", " (мм)"]), rng.choice(["text", "bool"]), i) for k in range(3) for i in range(8)]
    twist = [str, str.upper, lambda x: x[:-1], lambda x: x[1:] + "е", lambda x: "Total " + x, lambda x: x[::-1]]
    features = [(p, p % 3, s, rng.choice(twist)(rng.choice(words + [t[2] for t in targets])), rng.choice(["5", "нет", "No", "да", ""])) for p in range(25) for s in range(12)]
    features += [(0, 0, 90, None, "x"), (0, 0, 91, "вес", None), (0, 7, 92, "вес", "5")]
    got = matching.match_features(spark.createDataFrame(features, "product int, cat int, seq int, name string, value string"), spark.createDataFrame(targets, "cat int, target_id int, name string, type string, place int"), ["cat"], "product", RU, negatives)
    want = plain([f for f in features if f[3] and f[4]], targets, negatives)
    assert {(r.product, r.target_id): (r.seq, r.name, r.value, r["rank"]) for r in got.collect()} == want
    assert {v[3] for v in want.values()} >= {1, 2}


def test_the_letter_bound_loses_no_pair(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("абв  г") for _ in range(rng.randint(0, 14))) for _ in range(60)] + ["  вес ", "вес,  кг", "а", ""]
    df = spark.createDataFrame([(x,) for x in texts], "a string").withColumn("la", fuzzy.letters(F.col("a")))
    pairs = df.crossJoin(df.withColumnsRenamed({"a": "b", "la": "lb"}))
    for name in ("weighted_ratio", "partial_ratio"):
        for least in (65.0, 85.0):
            may = fuzzy.may_reach(name, F.col("a"), F.col("b"), F.col("la"), F.col("lb"), least)
            got = pairs.select("a", "b", may.alias("may")).collect()
            assert not [r for r in got if not r.may and fuzzy.SCORERS[name](r.a, r.b) >= least]
            assert any(not r.may for r in got)


def test_names_by_vectors(spark):
    names = spark.createDataFrame([(1, [1.0, 0.1]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0])], "id long, vector array<double>")
    targets = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0])], "id long, vector array<double>")
    assert [(r.name_id, r.target_id) for r in matching.match_by_vectors(names, targets).collect()] == [(1, 1)]
    assert [(r.name_id, r.target_id) for r in matching.match_by_vectors(names, targets.where("id = 1"), least=0.7).orderBy("name_id").collect()] == [(1, 1), (2, 1)]


def test_customs(spark):
    old, new = "6203423100 - (Действие прекращено с 15.09.2024) брюки", "6203423100 - МАРКИРОВКА РФ - Брюки"
    labels = spark.createDataFrame([(1, old, 5, 0), (1, new, 6, 1), (1, "6109100000 - Футболки", 7, 2), (1, "1234567890 - запись утратила силу", 8, 3), (1, None, 9, 4), (1, "текст", 10, 5)], "cat int, value string, value_id int, place int")
    codes = spark.createDataFrame([(1, "6203423100"), (1, "1234567890"), (1, "6109100010"), (2, "6109100010"), (1, None), (1, "6203423100")], "cat int, code string")
    got = {(r.cat, r.code): (r.value, r.value_id, r.state) for r in customs.resolve_customs(codes, labels, ["cat"]).collect()}
    assert got == {(1, "6203423100"): (new, 6, "confirmed"), (2, "6109100010"): ("6109100010", None, "unchecked")}
    near = {(r.code, r.value_id, r.shared) for r in customs.longest_prefix(codes, labels, ["cat"]).collect()}
    assert near == {("6203423100", 6, 10), ("6109100010", 7, 8)}
    row = spark.range(1).select(*[customs.deprecated(F.lit(x)) for x in ("1 - Действие приостановлено", "1 - исключён из номенклатуры", "1 - Прекращено с 1.1", "6404110000 - Обувь спортивная", "", None)], *[customs.is_full_code(F.lit(x)) for x in ("9206000000", " 9206000000 - x 61", "92060000001", "920600", None)], customs.proposed_code(F.lit("код 6109 10 000 0")), customs.proposed_code(F.lit("6109")), customs.type_key(F.lit(None).cast("long"), F.lit("a")), customs.type_key(F.lit(5), F.lit("a"))).first()
    assert tuple(row) == (True, True, True, False, False, False, True, True, False, False, False, "6109100000", None, "leaf:a", "5")
