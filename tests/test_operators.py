"""Keyed operators against plain Python on the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from attriva import model
from attriva.operators import aggregates as a
from attriva.operators import fillers as g
from attriva.operators import joins as j
from attriva.operators import predicates as p
from attriva.operators import windows as w
from attriva.sources import readers, sinks

PRIORITY = {s[0]: s[1] for s in model.SOURCES}
SCHEMA = "product_id long, attribute_id long, seq long, value_str string, value_arr array<string>, is_list boolean, confidence double, source string, evidence string, semantic_type string, is_collection boolean, value_id long, value_ids array<long>"


def make(n, seed=1):
    rng = random.Random(seed)
    names = list(PRIORITY)
    rows = []
    for k in range(n):
        is_list = rng.random() < 0.5
        arr = [rng.choice("abcAB ") for _ in range(rng.randint(1, 3))]
        ids = [rng.randint(1, 9) for _ in arr] if rng.random() < 0.6 else None
        rows.append((rng.randint(1, 5), rng.randint(1, 3), k, rng.choice("abc"), arr, is_list, rng.choice([0.5, 0.8, 0.9, 0.95]), rng.choice(names), rng.choice([None, "x", "xx"]), None, is_list, rng.choice([None, 5]), ids))
    return rows


def test_priority_merge(spark):
    rows = make(200)
    best = {}
    for r in rows:
        key, rank = r[:2], (PRIORITY[r[7]], len(r[8] or ""))
        if key not in best or rank > best[key][0]:
            best[key] = (rank, r)
    got = a.priority_merge(spark.createDataFrame(rows, SCHEMA), ["product_id", "attribute_id"]).collect()
    assert {(x.product_id, x.attribute_id): x.seq for x in got} == {k: v[1][2] for k, v in best.items()}


def test_collection_union_is_the_ordered_fold(spark):
    rows = make(300, 2)
    by_key = {}
    for r in rows:
        by_key.setdefault(r[:2], []).append(r)

    def state(r):
        return {"v": r[4] if r[5] else [r[3]], "ids": r[12], "c": r[6], "s": r[7]}

    def fold(x, y):
        for one, two in ((x, y), (y, x)):
            if one["s"] in model.OVERRIDE and two["s"] in model.INFERENCE and one["c"] >= two["c"] + 0.10:
                return one
        seen, vals, ids, whole = set(), [], [], True
        for side in (x, y):
            own = side["ids"]
            whole = whole and own is not None and len(own) == len(side["v"])
            for i, el in enumerate(side["v"]):
                low = el.strip().lower()
                if low and low not in seen:
                    seen.add(low)
                    vals.append(el)
                    ids.append(own[i] if own is not None and i < len(own) else None)
        base = x if x["c"] >= y["c"] else y
        return {"v": vals, "ids": ids if whole and None not in ids else None, "c": max(x["c"], y["c"]), "s": base["s"]}

    want = {}
    for key, own in by_key.items():
        s = state(own[0])
        for r in own[1:]:
            s = fold(s, state(r))
        want[key] = s
    got = a.collection_union(spark.createDataFrame(rows, SCHEMA), ["product_id", "attribute_id"]).collect()
    assert {(x.product_id, x.attribute_id): (x.value_arr, x.value_ids, x.confidence, x.source) for x in got} == {k: (s["v"], s["ids"], s["c"], s["s"]) for k, s in want.items()}


def test_consensus(spark):
    rows = [(1, 1, 0, "A", None, False, 0.5, "vision", None, None, False, None, None), (1, 1, 1, "a ", None, False, 0.95, "ugc", None, None, False, None, None), (1, 1, 2, "b", None, False, 0.5, "ugc", None, None, False, None, None)]
    got = a.consensus_boost(spark.createDataFrame(rows, SCHEMA), ["product_id", "attribute_id"]).collect()
    assert {x.seq: round(x.confidence, 3) for x in got} == {0: 0.6, 1: 0.97, 2: 0.5}


def test_votes_tie_goes_to_the_first(spark):
    df = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (1, "y", 3), (1, "x", 4), (2, "z", 1)], "k int, v string, seq int")
    assert {(r.k, r.v, r.n_votes) for r in a.votes(df, ["k"], "v", "seq").collect()} == {(1, "y", 2), (2, "z", 1)}
    assert {(r.k, r.v) for r in a.votes(df, ["k"], "v", "seq", "two").collect()} == {(1, "y")}


def test_abstain_and_reconcile(spark):
    rows = [(1, 1, 0, None, ["a"], True, 0.9, "llm_knowledge", None, None, True, None, [1, 2]), (1, 2, 1, "b", None, False, 0.9, "llm_knowledge", None, None, False, 7, [7])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.seq for r in p.abstain_lone_guesses(df, ["product_id", "attribute_id"]).collect()] == [1]
    assert {r.seq: r.value_ids for r in p.reconcile_ids(df).collect()} == {0: None, 1: [7]}


def test_windows(spark):
    df = spark.createDataFrame([(1, 5.0, 1), (1, 4.9, 2), (2, 3.0, 1), (3, None, 1)], "k int, s double, id int")
    assert [r.k for r in w.with_margin(df, ["k"], "s", [F.col("id")], 1.0, 0.5).collect()] == [2]
    got = w.gap_groups(spark.createDataFrame([(1, 0, 1), (1, 5, 2), (1, 100, 3)], "k int, t int, id int"), ["k"], "t", 80, "id").orderBy("t").collect()
    assert [r.group_no for r in got] == [1, 1, 2]


def test_resolution_ranks(spark):
    values = spark.createDataFrame([("c", "Мужчинам"), ("c", "6109100010"), ("c", "BLACK"), ("c", "semi modular"), ("c", "OCP (x)"), ("c", "беспроводная связь bluetooth"), ("c", "zzz"), ("c", None)], "cat string, value string")
    entries = spark.createDataFrame([("c", "Мужской", 1, 1), ("c", "6109100000 - Футболки", 2, 2), ("c", "black", 3, 3), ("c", "Semi-Modular", 4, 4), ("c", "ocp", 5, 5), ("c", "Bluetooth", 6, 6)], "cat string, value string, value_id int, seq int")
    got = {r.value: (r.value_id, r["rank"]) for r in j.resolve_values(values, entries, ["cat"]).collect()}
    assert got == {"Мужчинам": (1, 1), "6109100010": (2, 2), "BLACK": (3, 3), "semi modular": (4, 4), "OCP (x)": (5, 5), "беспроводная связь bluetooth": (6, 6)}


def test_names_are_matched_once(spark):
    names = spark.createDataFrame([(1, "Цвет", 0), (1, "цвет", 1), (1, "Вес товара", 2)], "k int, name string, seq long")
    targets = spark.createDataFrame([(1, "Цвет", 10), (1, "Вес", 20)], "k int, name string, target_id long")
    assert {(r.name, r.target_id) for r in j.match_names(names, targets, ["k"]).collect()} == {("Цвет", 10), ("Вес товара", 20)}


def test_nearest_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(60, [0.0] * 4), (61, None)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {(r.query_id, r["rank"]): r.id for r in j.nearest(df.where("id < 7"), df, 3, block=4).collect()}

    def cos(x, y):
        return sum(a * b for a, b in zip(x, y, strict=True)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5

    for q in range(7):
        order = sorted((r for r in rows[:60] if r[0] != q), key=lambda r: (-round(cos(rows[q][1], r[1]), 9), r[0]))[:3]
        assert [got[q, k + 1] for k in range(3)] == [r[0] for r in order]


def test_fillers(spark):
    rows = spark.createDataFrame([(1, 1, "Цвет", ["чёрный", "белый"], "Кроссовки чёрные", "Puma", "Puma GSR 5", "x"), (2, 1, "Цвет", ["чёрный", "белый"], "черно-белые", "Nike", "Nike", "x")], "product_id long, attribute_id long, target_name string, allowed_values array<string>, product_name string, brand string, title string, category_leaf string")
    assert [(r.product_id, r.value_str) for r in g.color_from_name(rows).collect()] == [(1, "чёрный")]
    titles = spark.createDataFrame([(1, "Куртка The North Face синяя"), (2, "Футболка Спортивные")], "id long, title string")
    brands = spark.createDataFrame([("North",), ("The North Face",), ("Спортивные",)], "brand string")
    assert [(r.id, r.brand) for r in g.brand_in_title(titles, brands, "id", "title").collect()] == [(1, "The North Face")]


def test_changes_and_corrections(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (4, "d")], "id int, v string")
    assert {(r.id, r.old_value, r.new_value) for r in j.changes(old, new, ["id"], ["v"]).collect()} == {(2, "b", "c"), (4, None, "d")}


@pytest.mark.parametrize("n", [1, 2])
def test_upsert_twice_changes_nothing(spark, n):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, version int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 1)], "id int, v string, version int")
    out = old
    for _ in range(n):
        out = sinks.upserted(out, new, ["id"], "version")
    assert {tuple(r) for r in out.select("id", "v").collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_readers(spark, tmp_path):
    (tmp_path / "p.csv").write_text("product_name,brand\nDrill,Bosch\n")
    row = readers.products_csv(spark, f"file://{tmp_path}/p.csv").first()
    assert (row.product_name, row.brand, row.ean) == ("Drill", "Bosch", None)
    (tmp_path / "x.csv").write_text("a\n1\n")
    with pytest.raises(ValueError):
        readers.products_csv(spark, f"file://{tmp_path}/x.csv")
    spark.createDataFrame([(1, "a")], "id int, v string").write.parquet(f"file://{tmp_path}/t/p=1")
    got = readers.parquet(spark, f"file://{tmp_path}/t", {"id": "long", "missing": "string"}).first()
    assert (got.id, got.missing) == (1, None)
    good, bad = readers.valid_requests(spark.createDataFrame([(1, ["https://a"], []), (2, ["http://a"], [])], "product_id int, source_urls array<string>, image_urls array<string>"))
    assert [r.product_id for r in good.collect()] == [1] and [r.product_id for r in bad.collect()] == [2]
    sinks.sharded_parquet(spark.range(10), f"file://{tmp_path}/s", 3)
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == 10


def test_deep_trees_and_cycles(spark):
    chain = [(i, i - 1 if i else None, f"n{i}") for i in range(40)] + [(100, 99, "orphan"), (101, 100, "below it"), (200, None, "other"), (201, 200, "kid")]
    got = {x.id: (x.root_id, "/".join(x.path)) for x in j.tree_categories(spark.createDataFrame(chain, "id long, parent_id long, name string")).collect()}
    assert got == {i: (0, "/".join(f"n{k}" for k in range(i + 1))) for i in range(40)} | {200: (200, "other"), 201: (200, "other/kid")}
    with pytest.raises(ValueError):
        j.tree_categories(spark.createDataFrame([(1, 2, "a"), (2, 1, "b"), (3, None, "c")], "id long, parent_id long, name string"))


def test_membership_ids_and_votes(spark):
    schema = "target_name string, allowed_values array<string>, is_list boolean, value_str string, value_arr array<string>, value_ids array<long>, evidence string"
    rows = [
        ("Цвет", ["Красный", "Синий"], True, None, ["Красный", "Синий"], [1, 2], None), ("Цвет", ["Красный", "Синий"], True, None, ["красный", "Жёлтый"], [1, 3], None),
        ("Цвет", ["Красный"], False, "Зелёный", None, None, "tnved_resolver: x"), ("Цвет", [], True, None, ["a"], [5], None),
    ]
    got = [(x.value_str, x.value_arr, x.value_ids) for x in p.membership_guard(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got, key=str) == sorted([(None, ["Красный", "Синий"], [1, 2]), (None, ["Красный"], None), ("Зелёный", None, None), (None, ["a"], [5])], key=str)
    voted = spark.createDataFrame(
        [("Пол", ["Мужской", "Женский"], "мужчинам", 3, 5), ("Пол", ["Мужской", "Женский"], "xyz", 3, 5), ("Состав", [], "ftwwht/cblack/solred", 2, 2), ("Состав", [], "хлопок", 2, 3), ("Состав", [], "Cotton", 2, 3), ("Вес", [], "5 kg", 2, 3)],
        "target_name string, allowed_values array<string>, value_str string, n_votes long, n_voters long",
    )
    assert {(x.value_str, x.evidence) for x in a.gated_votes(voted, {"cotton": "хлопок"}).collect()} == {("Мужской", "seen in 3/5 similar cards"), ("хлопок", "seen in 2/3 similar cards"), ("5 kg", "seen in 2/3 similar cards")}


def test_resolver_tail(spark):
    entries = spark.createDataFrame([("k", "Красный", 1, 1), ("k", "1920×1080", 2, 2), ("k", "Мужской", 3, 3), ("k", "6109100000 - Футболки", 4, 4), ("k", "610910", 5, 5), ("k", "Экран 5", 6, 6)], "kind string, value string, value_id long, seq long")
    asked = [("k", "['нет такого', 'красный']", None), ("k", "1920×1080 pixels", None), ("k", "мужчинам", None), ("k", "6109100010", None), ("k", "610910", None), ("k", "дисплей пять", "Экран 5"), ("k", "дисплей 6", "Экран 5")]
    out = j.resolve_values(spark.createDataFrame(asked, "kind string, value string, near string"), entries, ["kind"], fuzzy_least=None, nearest_option="near")
    assert {(x.value, x.value_id, x.rank) for x in out.collect()} == {("['нет такого', 'красный']", 1, 7), ("1920×1080 pixels", 2, 8), ("мужчинам", 3, 1), ("6109100010", 4, 2), ("610910", 4, 2), ("дисплей пять", 6, 9)}


def test_the_finalising_chain_is_the_plain_fold(spark):
    from attriva.plans import derived as d
    from attriva.plans.finalize import finalize

    rows = make(500, 7)
    rows = [(r[0], r[1] % 3 + 1 if not r[5] else 6, *r[2:]) if k % 9 else (r[0], 5, *r[2:5], False, *r[6:10], False, *r[11:]) for k, r in enumerate(rows)]
    targets = {t[0]: dict(zip(("id", "name", "type", "sem", "has", "req"), t, strict=True)) for t in d.TARGETS}
    by_key = {}
    for r in rows:
        pid, aid, seq, text, arr, is_list, conf, source, evidence, _, coll, vid, ids = r
        if conf <= 0 or (aid == 1 and source in model.BRAND_GUESSING) or (aid == 2 and (source != "description" or len(arr or []) >= 2 or len(ids or []) >= 2)) or (aid == 5 and source in ("llm_knowledge", "web_search")):
            continue
        by_key.setdefault((pid, aid), []).append({"seq": seq, "t": text, "v": arr, "l": is_list, "c": conf, "s": source, "e": evidence, "coll": coll, "id": vid, "ids": ids})
    want = {}
    for key, own in by_key.items():
        if len(own) == 1 and own[0]["s"] == "llm_knowledge" and own[0]["coll"]:
            continue
        words = lambda x: {w.strip().lower() for w in (x["v"] if x["l"] else [x["t"]])} - {""}
        backers = {}
        for x in own:
            for w_ in words(x):
                backers.setdefault(w_, set()).add(x["s"])
        own = [x | {"c": min(0.97, x["c"] + 0.10) if x["c"] < 0.97 and any(len(backers[w_]) >= 2 for w_ in words(x)) else x["c"]} for x in own]
        state = None
        for x in own:
            x = x | {"vals": x["v"] if x["l"] else [x["t"]]}
            if state is None:
                state = x
            elif not (x["coll"] or x["l"] or state["coll"] or state["l"]):
                state = x if (PRIORITY[x["s"]], len(x["e"] or "")) > (PRIORITY[state["s"]], len(state["e"] or "")) else state
            else:
                state = unite(state, x)
        n = len(state["vals"])
        if state["ids"] is not None and (len(state["ids"]) != n or (not (state["coll"] or state["l"]) and len(state["ids"]) > 1)):
            state = state | {"id": None, "ids": None}
        t = targets[key[1]]
        if t["has"] and "ТН ВЭД" not in t["name"]:
            if state["l"]:
                if not state["ids"]:
                    continue
                state["vals"] = state["vals"][: len(state["ids"])]
            elif state["id"] is None:
                continue
        want[key] = (state["s"], None if state["l"] else state["t"], state["vals"] if state["l"] else None, round(state["c"], 6))
    got = finalize(spark.createDataFrame(rows, SCHEMA), d.targets(spark), ["product_id", "attribute_id"]).collect()
    assert {(x.product_id, x.attribute_id): (x.source, x.value_str, x.value_arr if x.is_list else None, round(x.confidence, 6)) for x in got} == want and len(want) > 8


def unite(x, y):
    for one, two in ((x, y), (y, x)):
        if one["s"] in model.OVERRIDE and two["s"] in model.INFERENCE and one["c"] >= two["c"] + 0.10:
            return one | {"l": True, "coll": True, "id": None}
    seen, vals, ids, whole = set(), [], [], True
    for side in (x, y):
        own = side["ids"]
        whole = whole and own is not None and len(own) == len(side["vals"])
        for i, el in enumerate(side["vals"]):
            low = el.strip().lower()
            if low and low not in seen:
                seen.add(low)
                vals.append(el)
                ids.append(own[i] if own is not None and i < len(own) else None)
    base = x if x["c"] >= y["c"] else y
    return {"vals": vals, "ids": ids if whole and None not in ids else None, "c": max(x["c"], y["c"]), "s": base["s"], "e": base["e"], "l": True, "coll": True, "id": None, "t": None}


def test_resolver_is_one_join(spark):
    entries = spark.createDataFrame([("k", "Красный", 1, 1)], "kind string, value string, value_id long, seq long")
    asked = spark.createDataFrame([("k", "красный", None)], "kind string, value string, near string")
    plan = j.resolve_values(asked, entries, ["kind"], fuzzy_least=None, nearest_option="near")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_resolver_against_a_plain_search(spark):
    """Ranks 1 to 8 of shuffled values, fuzzy ones included, against a loop over all entries."""
    from attriva.functions import fuzzy

    rng = random.Random(5)
    words = ["modular", "чёрный", "стекло", "pin", "белый", "ocp", "лён", "сталь", "медь"]
    entries = [("k", " ".join(rng.sample(words, rng.randint(1, 3))), i, i) for i in range(30)] + [("k", "Мужской", 30, 30), ("k", "610910 - Футболки", 31, 31)]
    twist = [str.upper, lambda x: x + " (новый)", lambda x: f"['нечто', '{x}']", lambda x: x + " px", lambda x: x[:-1], lambda x: "мужчинам", lambda x: "6109100010", lambda x: x[1:] + "зз"]
    asked = sorted({("k", f(e[1])) for e in entries for f in twist})
    df = spark.createDataFrame([(e[1],) for e in entries] + [(a[1],) for a in asked] + [("нечто",)], "v string")
    from attriva.functions import text as t

    form = {r.v: r.asDict() for r in df.select("v", t.strong_token(F.col("v")).alias("s"), t.without_parens(F.col("v")).alias("b"), t.strong_token(t.without_parens(F.col("v"))).alias("sb"), t.unwrap_list(F.col("v")).alias("l"), t.without_pixels(F.col("v")).alias("px"), F.lower(t.gender_form(F.col("v"))).alias("g")).collect()}

    def direct(x):
        f = form.get(x) or {"s": None, "b": x, "sb": None, "g": None}
        for test in (lambda e: f["g"] == e.lower(), lambda e: x.isdigit() and e.startswith(x[:6]), lambda e: x.lower() == e.lower(), lambda e: f["s"] == form[e]["s"], lambda e: f["b"] != x and (f["b"].lower() == e.lower() or f["sb"] in (form[e]["s"], form[e]["sb"]))):
            for e in entries:
                if test(e[1]):
                    return e[2]
        best = max(entries, key=lambda e: (fuzzy.weighted_ratio(f["s"], form[e[1]]["s"]), -e[3]))
        return best[2] if fuzzy.weighted_ratio(f["s"], form[best[1]]["s"]) >= 85 else None

    missing = [x for a in asked for x in (form[a[1]]["l"] + [form[a[1]]["px"]]) if x and x not in form]
    for r in spark.createDataFrame([(m,) for m in missing] or [("нечто",)], "v string").select("v", t.strong_token(F.col("v")).alias("s"), t.without_parens(F.col("v")).alias("b"), t.strong_token(t.without_parens(F.col("v"))).alias("sb"), F.lower(t.gender_form(F.col("v"))).alias("g")).collect():
        form[r.v] = r.asDict() | form.get(r.v, {})
    want = {}
    for _, v in asked:
        for x in [v, *[y for y in form[v]["l"] if y != v], *([form[v]["px"]] if form[v]["px"] else [])]:
            if (hit := direct(x)) is not None:
                want[v] = hit
                break
    got = {r.value: r.value_id for r in j.resolve_values(spark.createDataFrame(asked, "kind string, value string"), spark.createDataFrame(entries, "kind string, value string, value_id long, seq long"), ["kind"]).collect()}
    assert got == want
