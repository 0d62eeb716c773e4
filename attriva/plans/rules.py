"""Rule queries: every product with a small table of candidate or field cases that lie on both sides of each rule.

The cases are data, alike in DataFrame and SQL; the rules are stated once in Spark and once, apart from it, in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import predicates as p
from . import derived as d
from .queries import query


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"


def _values(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)})"


def _cases(spark: SparkSession, sf_dir: str, rows, schema: str) -> DataFrame:
    """Every product with every case; the cases are a fixed table of a few rows."""
    products = d.spread(d.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("product_id")))
    listed = F.array(*[F.struct(*[F.lit(v).cast(kind).alias(c) for v, (c, kind) in zip(r, (x.split() for x in schema.split(", ")), strict=True)]) for r in rows])
    return products.withColumn("_case", F.explode(listed)).select("product_id", "_case.*")


_FACT_SCHEMA = "case_no long, attribute_id long, target_name string, source string, value_str string, evidence string"
_FACTS = (
    (1, 1, "Страна-изготовитель", "llm_knowledge", "Китай", "Китай"), (2, 1, "Страна-изготовитель", "icecat", "Китай", None),
    (3, 2, "Страна", "web_search", "Вьетнам", "[https://a.example/x] Вьетнам"), (4, 2, "Страна", "web_search", "Вьетнам", "[https://b.example/y] Вьетнам"),
    (5, 3, "Страна", "web_search", "Италия", "[https://a.example/x] Италия"), (6, 3, "Страна", "web_search", "Италия", "[https://a.example/z] Италия"), (7, 4, "Страна", "web_search", "Италия", "модель gsr180 из Италии"),
    (8, 5, "Гарантийный срок", "description", "12 месяцев", None), (9, 5, "Гарантийный срок", "description", "24 месяца", None), (10, 6, "Мощность, Вт", "llm_knowledge", "750 Вт", None), (11, 6, "Мощность, Вт", "llm_knowledge", "900 Вт", None),
    (12, 7, "Состав", "safe_enum_fill", "Хлопок", None), (13, 7, "Состав", "safe_enum_fill", "Лён", None), (14, 8, "Цвет", "llm_knowledge", "Чёрный", None), (15, 22232, "Страна ТН ВЭД", "llm_knowledge", "Китай", None),
    (16, 6, "Мощность, Вт", "web_search", "900 Вт", None), (17, 9, "Страна", "web_search", "Я", "gsr180"), (18, 10, "Степень защиты", "description", "7", None), (19, 11, "Bluetooth", "vision", "5.3", None), (20, 12, None, "llm_knowledge", "x", None),
)
_FACT_TEXT, _FACT_MODEL = "Дрель, мощность 7 50 Вт, хлопок. Гарантия 12  месяцев", "Bosch GSR180"


@query(
    f"""WITH {_values("c", "case_no, attribute_id, target_name, source, value_str, evidence", _FACTS)},
k AS (SELECT *, CASE WHEN regexp_matches(lower(coalesce(target_name, '')), 'стран|изготовител|производител') THEN 'COUNTRY' WHEN regexp_matches(lower(coalesce(target_name, '')), 'срок\\s+годност|срок\\s+служб|гарант') THEN 'PERIOD'
  WHEN regexp_matches(lower(coalesce(target_name, '')), 'состав|содержание|материал') THEN 'COMPOSITION' WHEN regexp_matches(lower(coalesce(target_name, '')), 'мощност|степень\\s+защит|bluetooth') THEN 'SPEC' END AS fact,
  regexp_replace(lower(CASE WHEN regexp_matches(value_str, '[0-9][0-9., ]*[а-яёА-ЯЁa-zA-Z]+') THEN regexp_extract(value_str, '[0-9][0-9., ]*[а-яёА-ЯЁa-zA-Z]+') ELSE value_str END), '[ ,.]', '', 'g') AS token,
  nullif(regexp_extract(coalesce(evidence, ''), '^\\[https://([^/]+)[^\\]]*\\]', 1), '') AS host FROM c),
h AS (SELECT attribute_id, token, count(DISTINCT host) AS hosts FROM k WHERE source = 'web_search' AND fact = 'COUNTRY' GROUP BY ALL),
kept AS (SELECT case_no FROM k LEFT JOIN h USING (attribute_id, token) WHERE CASE WHEN attribute_id = 22232 THEN true
  WHEN source = 'web_search' AND fact = 'COUNTRY' THEN length(token) >= 2 AND (coalesce(hosts, 0) >= 2 OR contains(lower(coalesce(evidence, '')), 'bosch') OR contains(lower(coalesce(evidence, '')), 'gsr180'))
  WHEN fact IS NULL OR source IN ('web_search', 'icecat', 'vision') THEN true WHEN fact = 'COUNTRY' THEN false
  ELSE length(token) >= 2 AND contains(regexp_replace(lower('{_FACT_TEXT}'), '[ ,.]', '', 'g'), token) END)
SELECT CAST(p_partkey AS BIGINT) AS product_id, CAST(case_no AS BIGINT) AS case_no FROM part CROSS JOIN kept"""
)
def q_hard_facts(spark, sf_dir):
    """F22."""
    rows = _cases(spark, sf_dir, _FACTS, _FACT_SCHEMA).withColumn("semantic_type", F.lit(None).cast("string"))
    return p.hard_fact_guard(rows, F.lit(_FACT_TEXT), F.lit(_FACT_MODEL)).select("product_id", "case_no")


_GATE_SCHEMA = "case_no long, target_name string, type string, source string, value_str string, evidence string, is_list boolean, verdict boolean"
_GATE = (
    (1, "Цвет", "text", "vision", "Красный", "No information about colour", False, None), (2, "Цвет", "text", "wb_card", "Красный", "closest in list", False, None), (3, "Цвет", "text", "vision", "Красный", "красный корпус", False, None),
    (4, "Страна", "text", "competitor_rag", "Россия", None, False, None), (5, "Страна", "text", "llm_knowledge", "Россия", None, False, None), (6, "Страна", "text", "competitor_rag", None, None, True, None),
    (7, "Время зарядки, ч", "text", "icecat", "Да", None, False, None), (8, "Число портов HDMI", "text", "icecat", "no", None, False, None), (9, "Подсветка", "text", "icecat", "Да", None, False, None), (10, "Мощность", "Integer", "wb_card", "TRUE", None, False, None),
    (11, "Название вкуса", "text", "wb_card", "Сироп «Клён» 500", None, False, None), (12, "Название", "text", "wb_card", "Сироп «Клён» 500", None, False, None), (13, "Название вкуса", "text", "wb_card", "Клён", None, False, None),
    (14, "Вес, г", "text", "description", "500", None, False, None), (15, "Вес, г", "text", "description", "750", None, False, None), (16, "Вес, г", "text", "web_search", "750", "вес 750 г", False, None), (17, "Вес, г", "text", "ozon_card", "750", None, False, None),
    (18, "Вес, г", "text", "llm_knowledge", "50 см", None, False, None), (19, "Вес, г", "text", "ozon_card", "2 кг", None, False, None), (20, "Объём, мл", "text", "ozon_card", "5 шт", None, False, None), (21, "Высота, см", "text", "ozon_card", "10 mm", None, False, None),
    (22, "Материал", "text", "vision", "Пластик", None, False, False), (23, "Материал", "text", "vision", "Пластик", None, False, True), (24, "Материал", "text", "icecat", "Пластик", None, False, False), (25, "Материал", "text", "vision", "Стекло", "бутылка: стекло", False, False),
    (26, "Код ТН ВЭД", "text", "llm_knowledge", "1702", None, False, False), (27, "Материал", "text", "vision", "Пластик", "предположительно", True, None), (28, "Диагональ, дюйм", "text", "description", "0,5", None, False, None),
)
_GATE_TITLE, _GATE_TEXT = "Сироп Клён 500", "Сироп Клён 500 г, экран 1/2"


@query(
    f"""WITH {_values("c", "case_no, target_name, type, source, value_str, evidence, is_list, verdict", _GATE)},
k AS (SELECT *, nullif(regexp_extract(target_name, ',\\s*([^,\\s]+)\\s*$', 1), '') AS unit, lower(coalesce(evidence || ' ', '') || '{_GATE_TEXT}') AS grounds, lower(value_str) AS low FROM c),
x AS (SELECT case_no, coalesce(regexp_matches(lower(evidence), 'no information|closest\\s+in\\s+list|предположительно'), false) AS admits, target_name = 'Страна' AND source = 'competitor_rag' AS country,
  coalesce(NOT is_list AND low IN ('да', 'no', 'true') AND (unit IS NOT NULL OR type = 'Integer' OR target_name LIKE 'Число%'), false) AS yes_no,
  coalesce(NOT is_list AND target_name LIKE 'Название вкуса%' AND trim(regexp_replace(low, '[«» ]+', ' ', 'g')) = lower('{_GATE_TITLE}'), false) AS echo,
  coalesce(NOT is_list AND unit IS NOT NULL AND source IN ('description', 'web_search') AND regexp_matches(value_str, '[0-9]') AND NOT contains(grounds, value_str) AND NOT (value_str = '0,5' AND contains(grounds, '1/2')), false) AS number,
  coalesce(NOT is_list AND CASE WHEN unit IN ('г', 'кг') THEN regexp_matches(low, '(^|[^а-яёa-z])(см|мм|шт|мл)($|[^а-яёa-z])') WHEN unit IN ('мл') THEN regexp_matches(low, '(^|[^а-яёa-z])(см|mm|шт|г|кг)($|[^а-яёa-z])')
    WHEN unit IN ('см') THEN regexp_matches(low, '(^|[^а-яёa-z])(шт|г|кг|мл)($|[^а-яёa-z])') ELSE false END, false) AS foreign_unit,
  coalesce(NOT is_list AND source IN ('vision', 'llm_knowledge', 'web_search', 'competitor_rag', 'safe_enum_fill') AND NOT contains(lower(target_name), 'тн вэд') AND NOT contains(grounds, low) AND NOT verdict, false) AS denied FROM k)
SELECT CAST(p_partkey AS BIGINT) AS product_id, CAST(case_no AS BIGINT) AS case_no FROM part CROSS JOIN x WHERE NOT (admits OR country OR yes_no OR echo OR number OR foreign_unit OR denied)"""
)
def q_verification_gate(spark, sf_dir):
    """F26."""
    rows = _cases(spark, sf_dir, _GATE, _GATE_SCHEMA).withColumns({"has_values": F.lit(False), "product_name": F.lit(_GATE_TITLE)})
    return p.verification_gate(rows, F.lit(_GATE_TEXT)).select("product_id", "case_no")


_FIELD_SCHEMA = "case_no long, name string, required boolean, type string, n_values int, description string, product_name string, leaf string, system string"
_FIELDS = (
    (1, "Озон.Видео: название", False, "String", 0, None, "Куртка", "Куртки", None), (2, "Озон.Видео: название", True, "String", 0, None, "Куртка", "Куртки", None), (3, "Ссылка", False, "URL", 3, None, "Куртка", "Куртки", None),
    (4, "Название файла PDF", False, "String", 5, None, "Куртка", "Куртки", None), (5, "Серии", False, "String", 0, "Добавьте JSON по https://x.example", "Куртка", "Куртки", None), (6, "Рост модели на фото", False, "String", 0, None, "Куртка", "Куртки", None),
    (7, "Версия iOS", False, "String", 0, None, "Смартфон Samsung A55", "Смартфоны", None), (8, "Версия Android", False, "String", 0, None, "Смартфон Samsung A55", "Смартфоны", None), (9, "Версия Android", False, "String", 0, None, "Смартфон Huawei P60", "Смартфоны", None),
    (10, "Версия iOS", False, "String", 0, None, "Смартфон Apple iPhone 15", "Смартфоны", None), (11, "Версия macOS", False, "String", 0, None, "Смартфон Apple iPhone 15", "Смартфоны", None), (12, "Версия Windows", False, "String", 0, None, "Ноутбук Acer", "Ноутбуки", None),
    (13, "Версия Android", False, "String", 0, None, "Ноутбук Acer", "Ноутбуки", None), (14, "Версия Android", False, "String", 0, None, "Планшет", "Планшеты", "HarmonyOS 4"), (15, "Версия Android", True, "String", 0, None, "Ноутбук Acer", "Ноутбуки", None),
    (16, "Загрузка для сушки", False, "String", 0, None, "Стиральная машина LG", "Стиральные машины", None), (17, "Загрузка для сушки", False, "String", 0, None, "Стиральная машина с сушкой LG", "Стиральные машины", None), (18, "Материал", False, "String", 0, "Из чего сделано", "Куртка", "Куртки", None),
    (19, "Версия iOS", False, "String", 0, None, "Apple аксессуар", "Аксессуары", None), (20, "Версия iOS", False, "String", 0, None, "Смартфон Samsung A55", "Смартфоны", "своя система"), (21, "Размер производителя", False, "String", 0, None, "Куртка", "Куртки", None),
)


@query(
    f"""WITH {_values("c", "case_no, name, required, type, n_values, description, product_name, leaf, system", _FIELDS)},
o AS (SELECT *, CASE WHEN system IS NOT NULL THEN CASE WHEN lower(system) LIKE '%harmonyos%' THEN 'harmonyos' END WHEN product_name ILIKE '%apple%' THEN CASE WHEN product_name ILIKE '%iphone%' THEN 'ios' END
  WHEN product_name ILIKE '%huawei%' THEN NULL WHEN product_name ILIKE '%samsung%' THEN 'android' WHEN product_name ILIKE '%ноутбук%' THEN 'windows' END AS own,
  nullif(regexp_extract(lower(name), '^версия (ios|macos|windows|android)', 1), '') AS field FROM c),
x AS (SELECT case_no, NOT required AND (type = 'URL' OR (n_values = 0 AND (regexp_matches(lower(name), 'озон\\.видео|название файла|рост модели|размер производителя') OR regexp_matches(lower(coalesce(description, '')), 'https?://|json')))) AS platform,
  NOT required AND (coalesce(field <> own, false) OR (contains(name, 'сушк') AND contains(product_name, 'Стиральная машина') AND NOT contains(product_name, 'с сушкой'))) AS not_applicable FROM o)
SELECT CAST(p_partkey AS BIGINT) AS product_id, CAST(case_no AS BIGINT) AS case_no, platform, not_applicable FROM part CROSS JOIN x"""
)
def q_platform_fields(spark, sf_dir):
    """F30."""
    rows, c = _cases(spark, sf_dir, _FIELDS, _FIELD_SCHEMA), F.col
    platform = p.platform_field(c("name"), c("required"), c("type"), c("n_values"), c("description"))
    return rows.select("product_id", "case_no", platform.alias("platform"), p.not_applicable(c("name"), c("required"), c("product_name"), F.array(F.lit("Все"), c("leaf")), c("system")).alias("not_applicable"))


_SIZES = ((1, "S", "42,44"), (2, "xxs", "40,42"), (3, "2XL", "52,54"), (4, "6xl", "60,62"), (5, "44-46", "44,46"), (6, "44–44", "44"), (7, "One Size", "универсальный"), (8, "универс", "универсальный"), (9, " 48 ", "48"), (10, "176", "176"), (11, "44/46", ""), (12, "7XL", ""), (13, "", ""), (14, "M", "46,48"))


@query(f"""WITH {_values("c", "case_no, value, want", _SIZES)} SELECT CAST(p_partkey AS BIGINT) AS product_id, CAST(case_no AS BIGINT) AS case_no, want AS sizes FROM part CROSS JOIN c""")
def q_sizes(spark, sf_dir):
    """N5."""
    rows = _cases(spark, sf_dir, _SIZES, "case_no long, value string, want string")
    return rows.select("product_id", "case_no", F.array_join(numeric.sizes(F.col("value")), ",").alias("sizes"))


_SHARDS = ", ".join(f"({end}, {k + 1})" for k, end in enumerate(numeric.SHARD_ENDS))


@query(
    f"""WITH s(last, nn) AS (VALUES {_SHARDS}), o AS (SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_orderkey AS BIGINT) * 7919 % 900000000 AS card FROM orders)
SELECT id, card // 100000 AS volume, card // 1000 AS part, lpad(CAST(coalesce((SELECT min(nn) FROM s WHERE last >= o.card // 100000), {len(numeric.SHARD_ENDS)}) AS VARCHAR), 2, '0') AS shard FROM o"""
)
def q_card_shards(spark, sf_dir):
    """N17."""
    card = F.col("o_orderkey").cast("long") * 7919 % 900000000
    volume, part = numeric.shard_volume(card)
    return d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), volume.alias("volume"), part.alias("part"), numeric.shard(card).alias("shard"))


_OPTION_SCHEMA = "case_no long, target_name string, options string, value string, listed string, want string"
_OPTIONS = (
    (1, "Материал", "Хлопок|Лён|Шерсть", "хлопок ", None, "Хлопок"), (2, "Материал", "Хлопок|Лён|Шерсть", "лен", None, "Лён"), (3, "Материал", "Хлопок|Лён|Шерсть", "Бетон", None, None), (4, "Материал", "Хлопок|Лён|Шерсть", "Хлопковый", None, None),
    (5, "Режимы", "Автоматическое центрирование тостов|Разморозка", None, "тостов автоматическое центрирование|выдвижной лоток", "Автоматическое центрирование тостов"), (6, "Режимы", "Автоматическое центрирование тостов|Разморозка", None, "лоток|съёмный поддон", None),
    (7, "Режимы", "Автоматическое центрирование тостов|Разморозка", None, "Разморозка|разморозка| РАЗМОРОЗКА", "Разморозка"), (8, "Бренд", "Bosch|Makita", "Хитачи", None, "Хитачи"), (9, "Код ТН ВЭД", "1702", "9999", None, "9999"), (10, "Материал", None, "Что угодно", None, "Что угодно"),
    (11, "Материал", "Хлопок|хлопок|Лён", "ХЛОПОК", None, "Хлопок"), (12, "Материал", "Хлопок|Лён", "  ", None, None),
)


@query(f"""WITH {_values("c", "case_no, target_name, options, value, listed, want", _OPTIONS)} SELECT CAST(p_partkey AS BIGINT) AS product_id, CAST(case_no AS BIGINT) AS case_no, want AS named FROM part CROSS JOIN c WHERE want IS NOT NULL""")
def q_membership(spark, sf_dir):
    """F19."""
    rows = _cases(spark, sf_dir, _OPTIONS, _OPTION_SCHEMA)
    rows = rows.withColumns({
        "allowed_values": F.split("options", "[|]"), "is_list": F.col("listed").isNotNull(), "value_arr": F.split("listed", "[|]"), "value_str": F.col("value"),
        "value_ids": F.lit(None).cast("array<bigint>"), "evidence": F.lit(None).cast("string"),
    })
    return p.membership_guard(rows).select("product_id", "case_no", F.when(F.col("is_list"), F.array_join("value_arr", "|")).otherwise(F.col("value_str")).alias("named"))
