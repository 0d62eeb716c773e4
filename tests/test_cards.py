"""Card parsers on pages with islands of every kind, whole and broken."""

import html as h
import json

from pyspark.sql import functions as F

from attriva.functions import islands as i
from attriva.operators import cards

STATE = json.dumps({"characteristics": [{"short": [{"name": "Цвет", "values": [{"text": "Чёрный", "id": 12}, {"text": " "}]}, {"name": 5, "values": [{"text": "x"}]}], "long": [{"name": "цвет", "values": [{"text": "Белый"}]}, {"name": "Вес", "values": [{"text": "1 кг"}, {"text": "2 кг", "id": "a"}]}, "odd"], "full": [{"name": "Пусто", "values": []}]}, "odd"]}, ensure_ascii=False)


def pairs(df):
    out = {}
    for r in df.orderBy("id", "place").collect():
        out.setdefault(r.id, []).append((r.name, r.value, *([r.value_ids] if r.value_ids else [])))
    return out


def pages(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, html string")


def test_state_elements(spark):
    amp = json.dumps({"characteristics": [{"short": [{"name": "Бренд", "values": [{"text": "A & B"}]}]}]}, ensure_ascii=False)
    div = lambda q, x: f'<div id="state-webCharacteristics-9" data-state={q}{x}{q}></div>'
    got = pairs(cards.state_pairs(pages(spark, div("'", STATE), div('"', h.escape(STATE, quote=True)), div("'", amp), div('"', h.escape(amp, quote=True)), div("'", STATE[:-3]), div("'", "{broken") + div('"', h.escape(amp, quote=True)), None, "", div("'", '{"characteristics": 5}') + div("'", amp.replace("A & B", "A &amp; B"))), "id", "html"))
    want = [("Цвет", "Чёрный", ["12"]), ("Вес", "1 кг, 2 кг", ["a"])]
    assert got == {0: want, 1: want, 2: [("Бренд", "A & B")], 3: [("Бренд", "A & B")], 5: [("Бренд", "A & B")], 8: [("Бренд", "A &amp; B")]}


def test_states(spark):
    initial = {"page": {"product": {"specs": [{"name": "Цвет", "value": "чёрный } {"}, {"key": "Пол", "values": ["муж", " ", "жен"]}, {"title": "Вес", "text": 5}, {"name": "", "label": "Есть", "value": True}, {"name": "Нет"}, "odd"]}}}
    grouped = {"props": [{"characteristics": [{"groupName": "g", "specs": [{"name": "Материал", "value": "сталь"}, {"groupName": "h", "params": [{"key": "Длина", "value": "5 м"}]}]}]}]}
    flat = {"attributes": {"Бренд": "Bosch", "Гарантия": 12, "цвет": "белый", "Пусто": None, "x": {"name": "Модель", "value": "GSR"}}}
    blob = lambda x: f"<script>window.__INITIAL_STATE__ = {json.dumps(x, ensure_ascii=False)};var a = {{}};</script>"
    nxt = lambda x: f'<script id="__NEXT_DATA__" type="application/json"> {json.dumps(x, ensure_ascii=False)}</script>'
    got = pairs(cards.spec_pairs(pages(spark, blob(initial), nxt(grouped), blob(flat), blob(initial).replace("}}}", "}"), blob(initial) + nxt(flat), '<script>__INITIAL_STATE__ = {"specs":{"a":"never ends}}</script>', None), "id", "html"))
    first = [("Цвет", "чёрный } {"), ("Пол", "муж, жен"), ("Вес", "5"), ("Есть", "true")]
    assert got[0] == first and 3 not in got and 5 not in got and 6 not in got
    assert got[1] == [("Материал", "сталь"), ("Длина", "5 м")]
    assert sorted(got[2]) == sorted([("Бренд", "Bosch"), ("Гарантия", "12"), ("цвет", "белый"), ("Модель", "GSR")])
    assert sorted(got[4]) == sorted([*first, ("Бренд", "Bosch"), ("Гарантия", "12"), ("Модель", "GSR")])


def test_ready_lists_and_tables(spark):
    ready = '<script>{"specs":{"x":1,"friendly":["Цвет: Чёрный","Пол: Мужской: да","без пары",5,"цвет: Белый"]}} "specs":{"friendly":[broken]}</script>'
    row = lambda n, v: f'<div><span data-auto="product-spec" class="a">{n}</span></div><div>{v}</div>'
    table = row("Состав", '<span data-zone-name="specLink" x data-zone-data="{&quot;text&quot;:&quot;хлопок&quot;}"><span>иное</span></span>') + row("Артикул", "<span>Артикул</span><span> </span><span>123</span>") + row("Сезон", '<span data-zone-name="specLink" data-zone-data="{broken}"><span>лето</span></span>') + row("Знак", "<span>a &amp; b</span>") + row("Конец", "x" * 1600 + "<span>далеко</span>")
    got = pairs(cards.spec_pairs(pages(spark, ready, table, ready + table.replace("Артикул", "Пол")), "id", "html"))
    assert got[0] == [("Цвет", "Чёрный"), ("Пол", "Мужской: да")]
    assert got[1] == [("Состав", "хлопок"), ("Артикул", "123"), ("Сезон", "лето")]
    assert got[2] == [*got[0], got[1][0], got[1][2]]


def test_heads(spark):
    ld = lambda x: f'<script type="application/ld+json">{json.dumps(x, ensure_ascii=False)}</script>'
    texts = [
        ld({"@type": "Product", "name": " Дрель ", "brand": {"name": "Bosch"}, "category": "Дрели"}) + "<title>нет</title>",
        ld({"@graph": [{"@type": "BreadcrumbList", "name": "x"}, {"@type": ["Thing", "Product"], "brand": "Puma"}]}) + ld([{"@type": "Product", "name": "Кеды"}]) + '<meta property="og:title" content="og">',
        '<script type="application/ld+json">{broken</script><meta property="og:title" content="Общий  заголовок"><title>t</title>', "<title> Просто\n заголовок </title>", None,
    ]
    got = {r.id: (r.title, r.brand, r.card_type) for r in cards.card_heads(pages(spark, *texts), "id", "html").collect()}
    assert got == {0: ("Дрель", "Bosch", "Дрели"), 1: ("Кеды", "Puma", ""), 2: ("Общий заголовок", "", ""), 3: ("Просто заголовок", "", ""), 4: (None, "", "")}


def test_snippets(spark):
    text = "Артикул: 124; Сезон: На любой сезон; Состав материала: полиэстер 67%, акрил 20%; артикул: 9 • Пусто: \nслишком много слов в этом имени: x | " + "о" * 41 + ": x | Длинно: " + "з" * 121 + "| нет пары | Время: 10:30"
    assert pairs(cards.snippet_pairs(pages(spark, text, None, ""), "id", "html")) == {0: [("Артикул", "124"), ("Сезон", "На любой сезон"), ("Состав материала", "полиэстер 67%, акрил 20%"), ("Время", "10:30")]}


def test_slices(spark):
    texts = ['x = {"a": "}\\"{", "b": {"c": 1}}; {', '{"a": {', "no", '{"open', "{}", '{"a":"' + "я\\n" * 30_000 + '"} tail']
    got = [r[0] for r in pages(spark, *texts).orderBy("id").select(i.balanced_slice(F.col("html"))).collect()]
    assert got == ['{"a": "}\\"{", "b": {"c": 1}}', None, None, None, "{}", texts[-1][:-5]]
