"""Queries of name matching and customs codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import brands, consistency, customs, matching
from . import derived as d
from .queries import query

_GOALS = ((1, "вес, кг", "number", 0), (2, "colour", "bool", 1), (3, "zzzz", "text", 2))


@query("""WITH f AS (SELECT CAST(p_partkey AS BIGINT) AS product_id, 1 AS seq, CASE p_partkey % 5 WHEN 0 THEN 'Weight' WHEN 1 THEN 'colour' WHEN 2 THEN 'colour' WHEN 3 THEN 'qqq' ELSE 'ве' END AS name, CASE WHEN p_partkey % 5 = 2 THEN ' No ' ELSE p_name END AS value FROM part
UNION ALL SELECT CAST(p_partkey AS BIGINT), 2, 'Item weight in ' || p_brand, p_name || '!' FROM part UNION ALL SELECT CAST(p_partkey AS BIGINT), 3, CASE WHEN p_size % 2 = 0 THEN 'Colour' ELSE '' END, 'x' FROM part),
m AS (SELECT *, CASE WHEN name IN ('Weight', 'ве') OR contains(name, 'weight') THEN 1 WHEN name IN ('colour', 'Colour') THEN 2 END AS target_id FROM f WHERE name <> '' AND trim(lower(value)) <> 'no')
SELECT product_id, CAST(target_id AS BIGINT) AS target_id, CAST(seq AS BIGINT) AS seq, name, value, 1 AS rank FROM m WHERE target_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY product_id, target_id ORDER BY seq) = 1""")
def q_feature_match(spark, sf_dir):
    """Features of all parts to the targets of their type."""
    parts = d.table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 5
    first = F.when(k == 0, "Weight").when((k == 1) | (k == 2), "colour").when(k == 3, "qqq").otherwise("ве")
    rows = F.array(*[F.struct(F.lit(n).cast("long").alias("seq"), name.alias("name"), value.alias("value")) for n, name, value in ((1, first, F.when(k == 2, " No ").otherwise(F.col("p_name"))), (2, F.concat(F.lit("Item weight in "), "p_brand"), F.concat("p_name", F.lit("!"))), (3, F.when(F.col("p_size") % 2 == 0, "Colour").otherwise(""), F.lit("x")))])
    features = parts.select("p_type", F.col("p_partkey").cast("long").alias("product_id"), F.explode(rows).alias("f")).select("p_type", "product_id", "f.*")
    goals = F.array(*[F.struct(F.lit(i).cast("long").alias("target_id"), F.lit(n).alias("name"), F.lit(kind).alias("type"), F.lit(place).alias("place")) for i, n, kind, place in _GOALS])
    targets = parts.select("p_type").distinct().select("p_type", F.explode(goals).alias("t")).select("p_type", "t.*")
    return matching.match_features(features, targets, ["p_type"], "product_id", {"weight": "вес"})


@query("""WITH e AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT x.id, list_transform(list_zip(x.v, y.v), lambda p: p[1] + (CASE WHEN x.id % 20 = 0 THEN 0.5 ELSE 1.0 END) * p[2]) AS v FROM e x JOIN e y ON y.id = x.id + 1 WHERE x.id % 10 = 0),
s AS (SELECT n.id AS name_id, e.id AS target_id, round(list_cosine_similarity(n.v, e.v), 9) AS similarity FROM n, e),
r AS (SELECT *, row_number() OVER w AS rn, lead(similarity) OVER w AS second FROM s WINDOW w AS (PARTITION BY name_id ORDER BY similarity DESC, target_id))
SELECT name_id, target_id, round(similarity, 6) AS similarity FROM r WHERE rn = 1 AND similarity >= 0.82 AND similarity - coalesce(second, 0) >= 0.05""")
def q_vector_names(spark, sf_dir):
    """Mixed vectors to the vector they resemble, unless two resemble them alike."""
    e = d.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    following = e.select((F.col("id") - 1).alias("id"), F.col("vector").alias("next"))
    names = e.where("id % 10 = 0").join(following, "id").select("id", F.zip_with("vector", "next", lambda x, y: x + F.when(F.col("id") % 20 == 0, 0.5).otherwise(1.0) * y).alias("vector"))
    return matching.match_by_vectors(names, e).select("name_id", "target_id", F.round("similarity", 6).alias("similarity"))


_LABELS = """l AS (SELECT p_brand AS brand, lpad(CAST(6100000000 + p_partkey % 97 * 1000 + p_size AS VARCHAR), 10, '0') AS lead, p_partkey % 3 AS kind, CAST(p_partkey AS BIGINT) AS value_id, p_name FROM part WHERE p_brand <> 'Brand#1'),
labels AS (SELECT *, lead || CASE kind WHEN 0 THEN ' - (Действие прекращено с 15.09.2024) ' WHEN 1 THEN ' - ' ELSE ' - МАРКИРОВКА РФ - ' END || p_name AS value FROM l),
codes AS (SELECT DISTINCT p_brand AS brand, CAST(6100000000 + p_partkey % 97 * 1000 + p_size + p_partkey % 2 AS VARCHAR) AS code FROM part)"""


def _dictionary(spark, sf_dir):
    parts = d.table(spark, sf_dir, "part").withColumn("base", F.lit(6100000000) + F.col("p_partkey") % 97 * 1000 + F.col("p_size"))
    kind = F.col("p_partkey") % 3
    value = F.concat(F.col("base").cast("string"), F.when(kind == 0, " - (Действие прекращено с 15.09.2024) ").when(kind == 1, " - ").otherwise(" - МАРКИРОВКА РФ - "), "p_name")
    labels = parts.where("p_brand <> 'Brand#1'").select(F.col("p_brand").alias("brand"), value.alias("value"), F.col("p_partkey").cast("long").alias("value_id"), F.col("p_partkey").alias("place"))
    return parts.select(F.col("p_brand").alias("brand"), (F.col("base") + F.col("p_partkey") % 2).cast("string").alias("code")), labels


@query(f"""WITH {_LABELS}, a AS (SELECT brand, lead AS code, value, value_id FROM labels WHERE kind <> 0 QUALIFY row_number() OVER (PARTITION BY brand, lead ORDER BY value_id) = 1)
SELECT c.brand, c.code, coalesce(a.value, c.code) AS value, a.value_id, CASE WHEN a.value IS NOT NULL THEN 'confirmed' ELSE 'unchecked' END AS state FROM codes c LEFT JOIN a USING (brand, code)
WHERE a.value IS NOT NULL OR c.brand NOT IN (SELECT brand FROM labels)""")
def q_customs_codes(spark, sf_dir):
    """2.9-14: codes of each brand to labels in force; old labels lead to their active siblings."""
    codes, labels = _dictionary(spark, sf_dir)
    return customs.resolve_customs(codes, labels, ["brand"])


@query(f"""WITH {_LABELS}, s AS (SELECT c.brand, c.code, l.value, l.value_id, CASE WHEN c.code = lead THEN 10 WHEN left(c.code, 9) = left(lead, 9) THEN 9 WHEN left(c.code, 8) = left(lead, 8) THEN 8 WHEN left(c.code, 7) = left(lead, 7) THEN 7 WHEN left(c.code, 6) = left(lead, 6) THEN 6 END AS shared FROM codes c JOIN labels l USING (brand) WHERE kind <> 0)
SELECT brand, code, value, value_id, shared FROM s WHERE shared IS NOT NULL QUALIFY row_number() OVER (PARTITION BY brand, code ORDER BY shared DESC, value_id) = 1""")
def q_customs_prefix(spark, sf_dir):
    """2.9-14, J5: the label in force that shares the longest beginning with a code."""
    codes, labels = _dictionary(spark, sf_dir)
    return customs.longest_prefix(codes, labels, ["brand"])


_TITLES = """t AS (SELECT CAST(p_partkey AS BIGINT) AS product_id, p_size, p_partkey % 7 AS k, string_split(p_name, ' ')[1] AS one, string_split(p_name, ' ')[-1] AS two, p_name FROM part),
f AS (SELECT product_id, p_size, CASE k WHEN 0 THEN p_name WHEN 1 THEN two WHEN 2 THEN 'Levi''s' WHEN 3 THEN 'LG' WHEN 6 THEN p_name END AS brand, CASE WHEN k = 3 THEN 'needle' ELSE 'dictionary' END AS origin FROM t WHERE k IN (0, 1, 2, 3, 6))"""


def _titles(spark, sf_dir):
    """Titles of seven kinds: nested brands, one brand, an apostrophe and a second brand, and no brand but the asked one, which
    is good, a category word or missing; the last kind ends in its brand."""
    parts = d.table(spark, sf_dir, "part")
    k, two = F.col("p_partkey") % 7, F.element_at(F.split("p_name", " "), -1)
    title = F.when(k == 0, F.concat(F.lit("Футболка "), "p_name")).when(k == 1, F.concat(two, F.lit(" x "), F.element_at(F.split("p_name", " "), 1))).when(k == 2, F.concat(F.lit("Джинсы levis "), two)).when(k == 3, "Телевизор LG 5").when(k == 4, "Колонка умная").when(k == 5, "Спортивные мужские колонки").otherwise(F.concat(F.lit("Мужские колонки "), "p_name"))
    rows = parts.select(F.col("p_partkey").cast("long").alias("product_id"), title.alias("title"), F.when(k == 3, "LG").when(k == 4, "Колонка").alias("brand"), F.array(F.lit("Электроника"), F.lit("Умные колонки")).alias("category_path"), "p_size")
    names = parts.groupBy(F.col("p_name").alias("brand")).agg(F.min("p_partkey").cast("long").alias("value_id"))
    words = names.select(F.element_at(F.split("brand", " "), -1).alias("brand")).distinct().withColumn("value_id", F.lit(-1).cast("long"))
    fixed = names.sparkSession.createDataFrame([("Levi's", -2), ("Спортивные", -3), ("Мужские", -4), ("Колонки", -5)], "brand string, value_id long")
    return rows, names.unionByName(words).unionByName(fixed).withColumn("seq", F.struct("value_id", "brand"))


@query(f"""WITH {_TITLES}, v AS (SELECT p_name AS brand, min(CAST(p_partkey AS BIGINT)) AS value_id FROM part GROUP BY ALL)
SELECT product_id, f.brand, CASE WHEN origin = 'needle' THEN NULL WHEN f.brand = 'Levi''s' THEN -2 WHEN contains(f.brand, ' ') THEN v.value_id ELSE -1 END AS value_id, origin FROM f LEFT JOIN v ON v.brand = f.brand""")
def q_title_brands(spark, sf_dir):
    """The brand of each title by dictionary and by the asked brand."""
    titles, listed = _titles(spark, sf_dir)
    return brands.title_brands(titles, listed)


@query(f"""WITH {_TITLES}, m AS (SELECT product_id, CASE WHEN p_size % 3 = 0 THEN upper(p_name) ELSE 'Other' END AS old FROM t WHERE p_size % 4 <> 0)
SELECT CAST(coalesce(m.product_id, f.product_id) AS BIGINT) AS product_id, CASE WHEN f.brand IS NULL OR (m.old IS NOT NULL AND lower(f.brand) = lower(m.old)) THEN m.old ELSE f.brand END AS value_str,
CASE WHEN f.brand IS NULL OR (m.old IS NOT NULL AND lower(f.brand) = lower(m.old)) THEN 'kept' ELSE 'brand_from_name' END AS evidence FROM m FULL JOIN f ON f.product_id = m.product_id""")
def q_brand_from_name(spark, sf_dir):
    """G1: brand targets filled and overwritten from titles."""
    titles, listed = _titles(spark, sf_dir)
    names = d.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("product_id"), "p_name")
    merged = titles.join(names, "product_id").where("p_size % 4 <> 0").select("product_id", F.lit(1).cast("long").alias("attribute_id"), F.when(F.col("p_size") % 3 == 0, F.upper("p_name")).otherwise("Other").alias("value_str"), F.lit(7).cast("long").alias("value_id"), F.lit(0.8).alias("confidence"), F.lit("ozon_card").alias("source"), F.lit("kept").alias("evidence"))
    targets = titles.select("product_id", F.lit(1).cast("long").alias("attribute_id"), F.lit("Бренд").alias("target_name"))
    return brands.brand_from_name(merged, targets, brands.title_brands(titles, listed)).select("product_id", "value_str", "evidence")


def _merged(rows, fields):
    """Merged values of (product_id, attribute_id, text, source) structs."""
    one = rows.select("product_id", F.explode(F.array_compact(F.array(*fields))).alias("f")).select("product_id", "f.*")
    return one.select("product_id", "attribute_id", F.col("text").alias("value_str"), F.lit(None).cast("array<string>").alias("value_arr"), F.lit(False).alias("is_list"), F.lit(None).cast("long").alias("value_id"), F.lit(0.9).alias("confidence"), "source", F.lit("").alias("evidence"))


def _field(attribute, text, source="wb_card", when=None):
    x = F.struct(F.lit(attribute).cast("long").alias("attribute_id"), text.alias("text"), (source if not isinstance(source, str) else F.lit(source)).alias("source"))
    return x if when is None else F.when(when, x)


def _targets(spark, rows, names):
    listed = spark.createDataFrame([(a, n, k) for k, (a, n) in enumerate(names.items())], "attribute_id long, target_name string, seq int")
    return rows.select("product_id").crossJoin(F.broadcast(listed))  # a handful of fixed fields for each product


@query("""WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS product_id, p_partkey AS k, p_size, 17 + p_size AS inches, 17 + p_partkey % 51 AS shown, p_name FROM part),
v AS (SELECT product_id, 1 AS attribute_id, CAST(p_size AS VARCHAR) AS value FROM p WHERE k % 2 = 0
UNION ALL SELECT product_id, 2, CASE WHEN p_size % 3 = 0 THEN 'С ударом' WHEN k % 2 = 1 THEN 'Сверление' ELSE 'Сверление|Сверление с ударом' END FROM p WHERE NOT (k % 4 = 0 AND p_size % 3 <> 0)
UNION ALL SELECT product_id, 3, 'Кейс, ключевой патрон' FROM p WHERE k % 3 = 0 UNION ALL SELECT product_id, 4, CASE WHEN k % 3 = 0 THEN 'ключевой' ELSE 'SDS-Plus' END FROM p WHERE k % 3 = 0 OR k % 5 <> 0 UNION ALL SELECT product_id, 5, CASE WHEN k % 5 = 0 THEN 'Дрель' ELSE 'Перфоратор' END FROM p
UNION ALL SELECT product_id, 6, CAST(shown AS VARCHAR) || ' "' FROM p WHERE shown = inches UNION ALL SELECT product_id, 7, 'Galaxy ' || k % 7 FROM p WHERE k % 7 = p_size % 7)
SELECT product_id, CAST(attribute_id AS BIGINT) AS attribute_id, value FROM v""")
def q_contradictions(spark, sf_dir):
    """The five rules over all parts."""
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = d.table(spark, sf_dir, "part").withColumn("product_id", k.cast("long"))
    text = lambda c: c.cast("string")
    fields = [
        _field(1, text(size), F.when(k % 4 == 0, "llm_knowledge").otherwise("wb_card"), k % 2 == 0), _field(2, F.when(size % 3 == 0, "С ударом").otherwise("Сверление")), _field(3, F.lit("Кейс, ключевой патрон"), when=k % 3 == 0), _field(4, F.lit("SDS-Plus")),
        _field(5, F.when(k % 5 == 0, "Дрель").otherwise("Перфоратор")), _field(6, F.concat(text(17 + k % 51), F.lit(' "'))), _field(7, F.concat(F.lit("Galaxy "), text(k % 7))),
    ]
    names = {1: "Диаметр сверления в бетоне", 2: "Режимы работы", 3: "Комплектация", 4: "Тип патрона", 5: "Тип", 6: "Диагональ, дюймы", 7: "Линейка устройств"}
    products = rows.select("product_id", F.concat(F.lit("Galaxy "), text(size % 7), F.lit(" "), text(17 + size), F.lit(" дюймов "), "p_name").alias("product_name"))
    out = consistency.contradictions(_merged(rows, fields), _targets(spark, rows, names), products)
    return out.select("product_id", "attribute_id", F.when(F.col("is_list"), F.array_join("value_arr", "|")).otherwise(F.col("value_str")).alias("value"))


@query("""WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS product_id, p_partkey AS k, p_name, p_type, split_part(p_name, ' ', 1) AS word FROM part),
v AS (SELECT product_id, 10 AS attribute_id, CASE WHEN p_type = 'SMALL' THEN 'small' ELSE p_name END AS value FROM p WHERE p_type = 'SMALL' OR k % 2 = 0
UNION ALL SELECT product_id, 20, CASE WHEN k % 4 = 0 THEN 'ATX' ELSE 'none' END FROM p UNION ALL SELECT product_id, 30, CASE WHEN k % 3 = 0 THEN 'given' WHEN word = 'red' THEN '13' ELSE '15' END FROM p WHERE k % 3 = 0 OR (p_type = 'LARGE' AND (word = 'red' OR k % 4 = 0))
UNION ALL SELECT product_id, 9048, p_name FROM p WHERE k % 2 = 1 UNION ALL SELECT product_id, 12141, p_name FROM p WHERE k % 2 = 1 UNION ALL SELECT product_id, 9336, p_name FROM p WHERE k % 2 = 1)
SELECT product_id, CAST(attribute_id AS BIGINT) AS attribute_id, value FROM v""")
def q_category_defaults(spark, sf_dir):
    """Overriding and conditional defaults, values that two fields share, the card group that is never kept."""
    k = F.col("p_partkey")
    rows = d.table(spark, sf_dir, "part").withColumn("product_id", k.cast("long"))
    name = F.col("p_name")
    fields = [_field(10, name, when=k % 2 == 0), _field(20, F.when(k % 4 == 0, "ATX").otherwise("none")), _field(30, F.lit("given"), when=k % 3 == 0), _field(12141, name, when=k % 2 == 1), _field(8292, name)]
    targets = _targets(spark, rows, {10: "", 20: "", 30: "", 9048: "", 12141: "", 9336: "", 8292: ""}).withColumn("semantic_type", F.when(F.col("attribute_id") == 20, "form_factor"))
    products = rows.select("product_id", F.col("p_type").alias("category_id"), F.col("p_name").alias("product_name"))
    defaults = spark.createDataFrame([("SMALL", 10, "small", 1)], "category_id string, attribute_id long, value string, value_id long")
    rules = spark.createDataFrame([("LARGE", 1, "red ", 30, "13"), ("LARGE", 2, "atx", 30, "15")], "category_id string, rule_no int, token string, attribute_id long, value string")
    return consistency.category_defaults(_merged(rows, fields), targets, products, defaults, rules).select("product_id", "attribute_id", F.col("value_str").alias("value"))
