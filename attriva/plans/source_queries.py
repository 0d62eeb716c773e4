"""Queries of lookups, the page cache, vector shards, checks of products and answers, and of gates by verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payload
from ..functions import text as t
from ..operators import aggregates as a
from ..operators import joins as j
from ..operators import predicates as p
from ..operators import reports as r
from ..functions import numeric
from ..sources import lookup, pages, shards, workbooks
from . import derived as d
from .queries import query


def _values(spark, sf_dir):
    """The names of each brand's parts as values of one attribute per type."""
    parts = d.table(spark, sf_dir, "part")
    return parts.select(F.col("p_brand").alias("category_id"), F.col("p_type").alias("type_id"), (F.col("p_size") % 3).cast("long").alias("attribute_id"), F.col("p_partkey").cast("long").alias("value_id"), F.col("p_name").alias("value"))


_VALUES = "v AS (SELECT p_brand AS category_id, p_type AS type_id, CAST(p_size % 3 AS BIGINT) AS attribute_id, CAST(p_partkey AS BIGINT) AS value_id, p_name AS value FROM part)"


@query(f"WITH {_VALUES}, n AS (SELECT *, row_number() OVER (PARTITION BY category_id, type_id, attribute_id ORDER BY value_id) AS k FROM v) SELECT category_id, type_id, attribute_id, value_id, value, CAST((k - 1) // 2 AS INT) AS page FROM n WHERE k <= 5")
def q_value_listing(spark, sf_dir):
    """The first five values of each key, in pages of two."""
    return lookup.listed_values(_values(spark, sf_dir), page=2, most=5)


@query(f"""WITH {_VALUES}, q AS (SELECT DISTINCT category_id, type_id, attribute_id, CASE WHEN value_id % 3 = 0 THEN upper(left(value, 4)) WHEN value_id % 3 = 1 THEN 'no such' ELSE ' ' END AS query FROM v)
SELECT q.category_id, q.type_id, q.attribute_id, q.query, min(v.value_id) AS value_id, arg_min(v.value, v.value_id) AS value FROM q JOIN v ON v.category_id = q.category_id AND v.type_id = q.type_id AND v.attribute_id = q.attribute_id AND contains(lower(v.value), lower(q.query)) WHERE trim(q.query) <> '' GROUP BY ALL""")
def q_value_search(spark, sf_dir):
    """Searches for beginnings of values, for a missing value and for a blank."""
    values = _values(spark, sf_dir)
    k = F.col("value_id") % 3
    asked = values.withColumn("query", F.when(k == 0, F.upper(F.left("value", F.lit(4)))).when(k == 1, "no such").otherwise(" "))
    return lookup.search_values(asked, values)


_BLOCKED = " OR ".join(f"contains(lower(text), '{m}')" for m in p.BLOCK_MARKERS)


def _fetched(spark, sf_dir):
    """Two fetches of each page: the first of some pages came from a blocker or was empty."""
    rows = d.table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    k = F.col("page_id") % 5
    first = rows.select("page_id", "url", F.when(k == 0, "Just a moment... CAPTCHA").when(k == 1, "").otherwise(F.left("html", F.lit(200))).alias("text"), F.lit(1).alias("fetched_at"))
    return first.unionByName(rows.where(k != 4).select("page_id", "url", F.when(k == 0, "").otherwise(F.left("html", F.lit(100))).alias("text"), F.lit(2).alias("fetched_at")))


@query(f"""WITH f AS (SELECT url, CASE page_id % 5 WHEN 0 THEN 'Just a moment... CAPTCHA' WHEN 1 THEN '' ELSE left(html, 200) END AS text, 1 AS fetched_at FROM pages UNION ALL SELECT url, CASE page_id % 5 WHEN 0 THEN '' ELSE left(html, 100) END, 2 FROM pages WHERE page_id % 5 <> 4),
good AS (SELECT * FROM f WHERE url IS NOT NULL AND text <> '' AND NOT ({_BLOCKED}))
SELECT sha256(url) AS key, url, text, fetched_at FROM good QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, text) = 1""")
def q_page_cache(spark, sf_dir):
    """The cache after two rounds of fetches of all pages."""
    rows = _fetched(spark, sf_dir)
    none = rows.limit(0).select(F.lit("").alias("key"), "url", "text", "fetched_at")
    one = pages.remembered(none, rows.where("fetched_at = 1"))
    return pages.remembered(one, rows.where("fetched_at = 2"))


@query("""WITH u AS (SELECT DISTINCT CASE WHEN page_id % 7 = 0 THEN 'https://cdn.' || page_id || '.example.com:443/x' WHEN page_id % 7 = 1 THEN 'http://www.googletagmanager.com/gtm' ELSE url END AS url FROM pages), c AS (SELECT DISTINCT sha256(url) AS key FROM pages WHERE page_id % 2 = 0 AND url IS NOT NULL)
SELECT url, sha256(url) AS key, CASE WHEN regexp_matches(url, '^https?://cdn[.]') OR contains(url, 'www.googletagmanager.com') THEN 'skip' WHEN c.key IS NOT NULL THEN 'hit' ELSE 'miss' END AS state FROM u LEFT JOIN c ON c.key = sha256(url) WHERE url IS NOT NULL""")
def q_pages_to_fetch(spark, sf_dir):
    """Hits, misses and hosts without text."""
    rows = d.table(spark, sf_dir, "pages")
    k = F.col("page_id") % 7
    urls = rows.select(F.when(k == 0, F.concat(F.lit("https://cdn."), F.col("page_id").cast("string"), F.lit(".example.com:443/x"))).when(k == 1, "http://www.googletagmanager.com/gtm").otherwise(F.col("url")).alias("url"))
    cache = rows.where("page_id % 2 = 0 and url is not null").select(pages.page_key(F.col("url")).alias("key"), F.lit("x").alias("text")).distinct()
    return pages.to_fetch(urls, cache).select("url", "key", "state")


@query("""SELECT CAST(vec_id AS BIGINT) AS variantid, 'label ' || label AS name, '' AS description, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total, len(embedding) AS dim FROM embeddings WHERE vec_id % 50 <> 49""")
def q_vector_shards(spark, sf_dir):
    """Vectors through .npy shards of 50 and back, paired by row with their payloads; some payloads are missing."""
    rows = d.table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 50).cast("string").alias("shard"), (F.col("vec_id") % 50).cast("long").alias("row_index"), F.col("embedding").alias("vector"), F.col("vec_id").cast("long").alias("variantid"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("name"))
    vectors = shards.vectors_of(shards.encoded(rows.select("shard", "row_index", "vector"), "shard", "row_index", "vector"), "shard", "content")
    points = shards.paired(vectors, rows.where("row_index <> 49").select("shard", "row_index", "variantid", "name"))
    return points.select("variantid", "name", "description", F.round(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.size("vector").cast("long").alias("dim"))


@query("""WITH q AS (SELECT CAST(p_partkey AS BIGINT) AS product_id, p_partkey AS k, p_size, p_name, p_retailprice FROM part)
SELECT product_id, array_to_string(list_filter([CASE WHEN k % 11 = 0 THEN 'name' END, CASE WHEN k % 4 = 0 THEN 'price' END, CASE WHEN k % 3 = 1 THEN 'old_price' END, CASE WHEN k % 5 = 2 THEN 'vat' END, CASE WHEN p_size % 17 IN (0, 16) THEN 'images' END,
CASE WHEN p_size % 2 = 0 THEN 'weight' END, CASE WHEN k % 6 = 0 THEN 'weight_unit' END, CASE WHEN p_size < 20 THEN 'width' END, CASE WHEN k % 9 = 0 THEN 'dimension_unit' END], lambda x: x IS NOT NULL), ',') AS errors FROM q""")
def q_product_checks(spark, sf_dir):
    """Fields of all parts that break a rule."""
    k, size = F.col("p_partkey"), F.col("p_size")
    row = {
        "offer_id": F.concat(F.lit("p"), k.cast("string")), "name": F.when(k % 11 == 0, "").otherwise(F.col("p_name")), "description": F.when(k % 2 == 0, F.col("p_name")), "price": F.when(k % 8 == 0, "0").when(k % 4 == 0, "free").otherwise(F.col("p_retailprice").cast("string")),
        "old_price": F.when(k % 3 == 1, "-5").when(k % 3 == 2, "7.5"), "vat": F.when(k % 5 == 2, "0.18").when(k % 5 == 3, "0.10"), "images": F.array_repeat(F.lit("https://x"), size % 17), "weight": F.when(size % 2 == 0, 0).otherwise(size),
        "weight_unit": F.when(k % 6 == 0, "lb").when(k % 6 == 1, "kg"), "depth": F.lit(1), "width": size - 19, "height": F.lit(2), "dimension_unit": F.when(k % 9 == 0, "m").when(k % 9 == 1, "cm"),
    }
    return d.table(spark, sf_dir, "part").select(k.cast("long").alias("product_id"), F.array_join(payload.product_errors(row), ",").alias("errors"))


@query("""SELECT CAST(p_partkey AS BIGINT) AS product_id, CASE WHEN p_partkey % 6 IN (0, 1, 2) THEN p_name END AS value, CASE WHEN p_partkey % 6 IN (0, 1) THEN CAST(p_size AS DOUBLE) END AS confidence FROM part""")
def q_answers(spark, sf_dir):
    """Answers as JSON, fenced or not, broken ones and ones without a required field."""
    k, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size").cast("string")
    whole = F.concat(F.lit('{"value": "'), name, F.lit('", "confidence": '), size, F.lit(', "more": [1]}'))
    text = F.when(k % 6 == 0, whole).when(k % 6 == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(k % 6 == 2, F.concat(F.lit('{"value": "'), name, F.lit('"}'))).when(k % 6 == 3, F.lit('{"confidence": 5}')).when(k % 6 == 4, F.concat(F.lit("Sure: "), whole))
    got = payload.parsed_answer(text, "value string, confidence double", ("value",))
    return d.table(spark, sf_dir, "part").select(k.cast("long").alias("product_id"), got["value"].alias("value"), got["confidence"].alias("confidence"))


@query("""WITH c AS (SELECT CAST(o_custkey AS BIGINT) AS product_id, CAST(o_orderkey AS BIGINT) AS seq, lpad(CAST(o_orderkey % 3 AS VARCHAR), 7, '9') AS body, o_orderkey % 2 AS bad FROM orders),
s AS (SELECT *, (10 - (3 * (CAST(body[1] AS INT) + CAST(body[3] AS INT) + CAST(body[5] AS INT) + CAST(body[7] AS INT)) + CAST(body[2] AS INT) + CAST(body[4] AS INT) + CAST(body[6] AS INT)) % 10) % 10 AS digit FROM c),
v AS (SELECT product_id, body || digit AS gtin, count(*) AS n, min(seq) AS first_seq FROM s WHERE bad = 0 GROUP BY ALL)
SELECT product_id, gtin, n FROM v QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY n DESC, first_seq) = 1""")
def q_gtin_pick(spark, sf_dir):
    """The most frequent valid barcode of each customer's orders."""
    body = F.lpad((F.col("o_orderkey") % 3).cast("string"), 7, "9")
    place = lambda k: F.substring(body, k, 1).cast("int")
    digit = F.pmod(F.lit(10) - (3 * (place(1) + place(3) + place(5) + place(7)) + place(2) + place(4) + place(6)) % 10 + F.when(F.col("o_orderkey") % 2 == 1, 1).otherwise(0), F.lit(10))
    rows = d.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("product_id"), F.col("o_orderkey").cast("long").alias("seq"), F.concat(body, digit.cast("string")).alias("gtin"))
    return a.most_frequent(rows.where(numeric.check_digit_ok(F.col("gtin"))), ["product_id"], "gtin", "seq")


def _proposals(spark, sf_dir):
    """One proposal for each part: a value, the product's text, options and a verdict that comes for some."""
    k, size = F.col("p_partkey"), F.col("p_size")
    parts = d.table(spark, sf_dir, "part")
    value = F.when(k % 4 == 0, F.upper("p_name")).when(k % 4 == 1, F.element_at(F.split("p_name", " "), -1)).otherwise("other")
    return parts.select(
        k.cast("long").alias("product_id"), F.lit(5).cast("long").alias("attribute_id"), F.when(k % 13 == 0, "Бренд").otherwise("Стиль").alias("target_name"), value.alias("value_str"), F.concat(F.lit("a "), "p_name", F.lit("-x")).alias("text"),
        (size % 5 == 0).alias("is_required"), F.sequence(F.lit(1), size).cast("array<string>").alias("allowed_values"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("confirmed"),
        F.when(size % 2 == 0, "vision").otherwise("web_search").alias("source"), (k % 7 != 0).alias("has_values"), (k % 17 == 0).alias("is_list"),
    )


@query("""SELECT CAST(p_partkey AS BIGINT) AS product_id, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN string_split(p_name, ' ')[-1] ELSE 'other' END AS value_str FROM part WHERE p_size % 5 <> 0 AND p_size <= 35 AND p_partkey % 13 <> 0 AND (p_partkey % 4 IN (0, 1) OR p_partkey % 3 = 0)""")
def q_safe_enum(spark, sf_dir):
    """F28, 2.9-15: gate A by the text, gate B by a verdict."""
    rows = _proposals(spark, sf_dir)
    return p.safe_enum(rows, t.brand_tokens(F.col("text"))).select("product_id", "value_str")


@query("""SELECT CAST(p_partkey AS BIGINT) AS product_id FROM part WHERE NOT (p_size % 5 = 0 AND p_partkey % 7 <> 0 AND p_partkey % 17 <> 0 AND p_size % 2 = 0 AND p_partkey % 4 IN (2, 3)) OR p_partkey % 3 = 0""")
def q_mud_gate(spark, sf_dir):
    """required enum values of weak sources that the text lacks need a verdict."""
    return p.mud_gate(_proposals(spark, sf_dir), F.col("text")).select("product_id")


@query("""WITH v AS (SELECT CAST(l_partkey AS BIGINT) AS product_id, bool_or(l_linenumber = 3) AS ok FROM lineitem GROUP BY ALL) SELECT CAST(p_partkey AS BIGINT) AS product_id FROM part LEFT JOIN v ON v.product_id = p_partkey WHERE p_size % 4 = 0 OR coalesce(ok, false)""")
def q_verdicts(spark, sf_dir):
    """values that are no specification need a confirming verdict; no verdict counts as no."""
    parts = d.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("product_id"), "p_size")
    verdicts = d.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("long").alias("product_id"), (F.col("l_linenumber") == 3).alias("confirmed"))
    return p.confirmed(parts, verdicts, F.col("p_size") % 4 == 0, ["product_id"]).select("product_id")


@query("""SELECT p_brand AS cat_id, p_type AS type_id, CAST(p_size AS BIGINT) AS attribute_id, CAST(p_partkey AS BIGINT) AS value_id, p_name AS value FROM part""")
def q_dictionary_values(spark, sf_dir):
    """A tree of categories, characteristics and values as rows."""
    parts = d.table(spark, sf_dir, "part")
    value = F.struct(F.col("p_partkey").cast("long").alias("id"), F.col("p_name").alias("value"))
    chars = parts.groupBy("p_brand", "p_type", F.col("p_size").cast("long").alias("id")).agg(F.collect_list(value).alias("values"))
    tree = chars.groupBy(F.col("p_brand").alias("cat_id"), F.col("p_type").alias("type_id")).agg(F.collect_list(F.struct("id", "values")).alias("characteristics"))
    return j.dictionary_values(tree)


_FIELDS = ((1, "Цвет", False, None), (2, "Размер на бирке", False, None), (3, "Версия iOS", False, None), (4, "Версия Android", False, None), (5, "Ссылка", False, "URL"), (6, "Тип", True, None), (7, "Функция сушки", False, None))


@query("""WITH f(attribute_id, required) AS (VALUES (1, false), (2, false), (3, false), (4, false), (5, false), (6, true), (7, false)),
p AS (SELECT CAST(p_partkey AS BIGINT) AS product_id, p_partkey % 4 AS k, p_size FROM part),
g AS (SELECT product_id, required, (p_size + attribute_id) % 3 = 0 AS filled, attribute_id IN (2, 5) AS platform, (k = 0 AND attribute_id = 4) OR (k = 1 AND attribute_id = 3) OR (k = 2 AND attribute_id = 7) AS gone FROM p, f)
SELECT product_id, count(*) FILTER (NOT required) AS n_optional, count(*) FILTER (NOT required AND NOT platform AND NOT gone) AS n_extractable, count(*) FILTER (NOT required AND NOT platform AND NOT gone AND filled) AS filled_extractable,
count(*) FILTER (NOT required AND NOT platform AND gone) AS n_not_applicable, round(count(*) FILTER (NOT required AND NOT platform AND NOT gone AND filled) / CAST(count(*) FILTER (NOT required AND NOT platform AND NOT gone) AS DOUBLE), 6) AS honest_share FROM g GROUP BY product_id""")
def q_extractable_coverage(spark, sf_dir):
    """Coverage without fields of the platform and fields that the product cannot have."""
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "Смартфон Apple iPhone 15").when(k == 1, "Смартфон Samsung Galaxy").when(k == 2, "Стиральная машина узкая").otherwise("Стиральная машина с сушкой")
    parts = d.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("product_id"), "p_size", name.alias("product_name"))
    fields = spark.createDataFrame(list(_FIELDS), "attribute_id long, target_name string, is_required boolean, kind string")
    grid = parts.crossJoin(F.broadcast(fields))  # seven fixed fields for each product
    path, none = F.array(F.lit("Техника")), F.lit(None).cast("string")
    grid = grid.withColumn("filled", (F.col("p_size") + F.col("attribute_id")) % 3 == 0).withColumn("platform", p.platform_field(F.col("target_name"), F.col("is_required"), F.col("kind"), F.lit(0), none))
    grid = grid.withColumn("not_applicable", p.not_applicable(F.col("target_name"), F.col("is_required"), F.col("product_name"), path, none))
    return r.extractable_coverage(grid).withColumn("honest_share", F.round("honest_share", 6))


@query("""WITH c AS (SELECT CAST(l_partkey AS BIGINT) AS product_id, (l_orderkey % 20 + 80) / 100.0 AS confidence, CASE l_linenumber % 4 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN ' ' || upper(p_name) || ' ' WHEN 2 THEN '12345' ELSE 'Unknown' END AS value, p_name, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT product_id, count(*) AS n, count(*) FILTER (confidence > 0.85 AND length(trim(value)) > 3 AND NOT regexp_matches(trim(value), '^[0-9]+$') AND NOT contains(lower(p_name || ' ' || p_brand), lower(trim(value)))) AS n_unfounded FROM c GROUP BY product_id""")
def q_unfounded_values(spark, sf_dir):
    """Confident values that the product's texts do not hold."""
    rows = d.table(spark, sf_dir, "lineitem").join(d.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    k = F.col("l_linenumber") % 4
    value = F.when(k == 0, F.split_part("p_name", F.lit(" "), F.lit(1))).when(k == 1, F.concat(F.lit(" "), F.upper("p_name"), F.lit(" "))).when(k == 2, "12345").otherwise("Unknown")
    sign = r.unfounded((F.col("l_orderkey") % 20 + 80) / 100.0, value, F.col("p_name"), F.col("p_brand"))
    return rows.groupBy(F.col("l_partkey").cast("long").alias("product_id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(sign).alias("n_unfounded"))


@query("""WITH t AS (SELECT p_brand AS book, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, p_name, p_type, p_size FROM part)
SELECT book, CAST(k - 1 AS INT) AS row_index, CAST(p_partkey AS VARCHAR) AS sku, p_name AS name, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'filled' END AS kind, CAST(p_size AS VARCHAR) AS size FROM t""")
def q_workbooks(spark, sf_dir):
    """A workbook for each brand is written, its empty cells are filled, and its rows are read again."""
    parts = d.table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("kind"), "p_size")
    books = workbooks.new_workbooks(workbooks.as_cells(parts, "p_brand", "p_partkey", "goods", ["p_partkey", "p_name", "kind", "p_size"]), ["goods", "validation"])
    rows = workbooks.named_cells(workbooks.cells(books), "goods").where("name = 'p_partkey'").select("path", "row_index", F.lit("kind").alias("name"), F.lit("filled").alias("value"))
    filled = workbooks.filled_workbooks(books, rows, "goods")
    got = workbooks.products(workbooks.cells(filled), "goods", {"p_partkey": "sku", "p_name": "name", "kind": "kind"})
    return got.select(F.col("path").alias("book"), "row_index", "sku", "name", "kind", F.col("characteristics")["p_size"].alias("size"))
