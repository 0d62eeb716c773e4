"""Queries over product cards: characteristics and heads of all pages.

The pages of the test tables hold no islands, so each gets one more element, built from its own words; the eight kinds,
broken ones included, go by page_id.  The SQL names the pairs that each kind must give, in the page's order.
"""

from __future__ import annotations

import html as h
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import composition
from ..operators import cards, donors
from . import derived as d
from .queries import query

_STATE = '{"characteristics":[{"short":[{"name":"@1","values":[{"text":"@2","id":7},{"text":"@3"}]}],"long":[{"name":"@U","values":[{"text":"again"}]},{"name":"Size @2","values":[{"text":"A & @3"}]}],"full":[{"name":"Full @4","values":[]}]}]}'
_SPECS = '{"p":{"specs":[{"name":"@1","value":"}{ @2"},{"key":"Two @2","values":["@3","@4"]},{"groupName":"g","params":[{"name":"Deep @3","text":"@2"}]}]}}'
_DIV = '<div id="state-webCharacteristics-1" data-state={q}{x}{q}></div>'
_ROW = '<span data-auto="product-spec">{n}</span><div>{v}</div>'
_KINDS = (
    _DIV.format(q="'", x=_STATE), _DIV.format(q='"', x=h.escape(_STATE)), _DIV.format(q="'", x=_STATE[:-3]),
    f"<script>window.__INITIAL_STATE__ = {_SPECS};init({{}});</script>",
    '<script id="__NEXT_DATA__" type="application/json">{"props":[{"characteristics":{"Flat @1":"@2","Num":12}}]}</script>',
    f"<script>window.__INITIAL_STATE__ = {_SPECS[:-1]};init();</script>",
    '<script>{"specs":{"a":1,"friendly":["@1: @2","no pair","@U: again","K @3: a: @4"]}} "specs":{"friendly":[@1: broken]}</script>',
    _ROW.format(n="@1", v='<b data-zone-name="specLink" data-zone-data="{&quot;text&quot;:&quot;@2&quot;}"></b>') + _ROW.format(n="Code @3", v="<span>Code @3</span><span> </span><span>@4</span>") + _ROW.format(n="None", v="text"),
)
_LD = '<script type="application/ld+json">{"@graph":[{"@type":"Thing","name":"no"},{"@type":["Product","X"],"name":" @1 @2 ","brand":{"name":"@3"},"category":"@4"}]}</script>'


def _word(n: int) -> Column:
    return F.coalesce(F.try_element_at(F.regexp_extract_all("html", F.lit('href="/([A-Za-z]+)"'), F.lit(1)), F.lit(n)), F.lit(f"none{n}"))


def _filled(template: str) -> Column:
    words = {"@U": F.upper(_word(1))} | {f"@{n}": _word(n) for n in range(1, 5)}
    return F.concat(*[words.get(x, F.lit(x)) for x in re.split("(@[1-4U])", template) if x])


def _pages(spark, sf_dir: str) -> DataFrame:
    pages = d.table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "html")
    kind = F.col("page_id") % len(_KINDS)
    island = F.concat(F.lit(""), F.coalesce(*[F.when(kind == k, _filled(x)) for k, x in enumerate(_KINDS)]))
    return pages.select("page_id", F.concat("html", island, F.when(F.col("page_id") % 3 == 0, _filled(_LD)).otherwise("")).alias("html"))


_WORDS = """w AS (SELECT CAST(page_id AS BIGINT) AS page_id, page_id % 8 AS kind, html, regexp_extract_all(html, 'href="/([A-Za-z]+)"', 1) AS ws FROM pages),
v AS (SELECT page_id, kind, html, coalesce(ws[1], 'none1') AS a, coalesce(ws[2], 'none2') AS b, coalesce(ws[3], 'none3') AS c, coalesce(ws[4], 'none4') AS e FROM w)"""


@query(f"""WITH {_WORDS}, p AS (
SELECT page_id, 1 AS k, a AS name, b || ', ' || c AS value, '7' AS ids FROM v WHERE kind IN (0, 1) UNION ALL SELECT page_id, 2, 'Size ' || b, 'A & ' || c, '' FROM v WHERE kind IN (0, 1)
UNION ALL SELECT page_id, 1, a, '}}{{ ' || b, '' FROM v WHERE kind = 3 UNION ALL SELECT page_id, 2, 'Two ' || b, c || ', ' || e, '' FROM v WHERE kind = 3 UNION ALL SELECT page_id, 3, 'Deep ' || c, b, '' FROM v WHERE kind = 3
UNION ALL SELECT page_id, 1, 'Flat ' || a, b, '' FROM v WHERE kind = 4 UNION ALL SELECT page_id, 2, 'Num', '12', '' FROM v WHERE kind = 4
UNION ALL SELECT page_id, 1, a, b, '' FROM v WHERE kind = 6 UNION ALL SELECT page_id, 2, 'K ' || c, 'a: ' || e, '' FROM v WHERE kind = 6
UNION ALL SELECT page_id, 1, a, b, '' FROM v WHERE kind = 7 UNION ALL SELECT page_id, 2, 'Code ' || c, e, '' FROM v WHERE kind = 7)
SELECT page_id, name, value, ids FROM p QUALIFY row_number() OVER (PARTITION BY page_id, lower(name) ORDER BY k) = 1""")
def q_card_pairs(spark, sf_dir):
    """2.9 card parsers, T28: characteristics of all pages, whole and broken islands."""
    pages = _pages(spark, sf_dir)
    every = cards.state_pairs(pages, "page_id", "html").unionByName(cards.spec_pairs(pages, "page_id", "html"))
    return every.select("page_id", "name", "value", F.array_join("value_ids", ",").alias("ids"))


@query(f"""WITH {_WORDS} SELECT page_id, CASE WHEN page_id % 3 = 0 THEN a || ' ' || b ELSE trim(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '\\s+', ' ', 'g')) END AS title,
CASE WHEN page_id % 3 = 0 THEN c ELSE '' END AS brand, CASE WHEN page_id % 3 = 0 THEN e ELSE '' END AS card_type FROM v""")
def q_card_heads(spark, sf_dir):
    """2.9 card parsers: title, brand and type of all pages."""
    return cards.card_heads(_pages(spark, sf_dir), "page_id", "html")


@query(f"""WITH {_WORDS} SELECT page_id, name, value FROM (SELECT page_id, 1 AS k, a AS name, b || ' 67%, ' || c AS value FROM v UNION ALL SELECT page_id, 2, 'Size ' || b, '10:30' FROM v)
QUALIFY row_number() OVER (PARTITION BY page_id, lower(name) ORDER BY k) = 1""")
def q_snippet_pairs(spark, sf_dir):
    """Named values of a snippet for each page."""
    pages = d.table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "html")
    text = _filled("@1: @2 67%, @3; Size  @2 : 10:30 \N{BULLET} @U: again | a name of far too many words: x\nno pair")
    return cards.snippet_pairs(pages.select("page_id", text.alias("snippet")), "page_id", "snippet").select("page_id", "name", "value")


def _pool(spark, sf_dir: str) -> DataFrame:
    """Eight found cards for each part: its asked name with words behind it, so that both fuzzy scores follow from lengths."""
    parts = d.spread(d.table(spark, sf_dir, "part")).select(F.col("p_partkey").cast("long").alias("product_id"), "p_name", "p_size", F.lower("p_type").alias("category"), F.replace("p_brand", F.lit("#"), F.lit("")).alias("brand"))
    asked = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" ab"), F.col("p_size").cast("string"))).otherwise(""), F.when(F.col("p_size") % 2 == 0, " womens").otherwise(""))
    endings = [F.lit(""), F.concat(F.lit(" "), F.col("brand")), F.concat(F.lit(" "), F.col("brand"), F.lit(" mens")), F.concat(F.lit(" "), F.col("brand"), F.lit(" pro")), F.lit(" Shilla"), F.concat(F.lit(" "), F.col("category")), F.concat(F.lit(" "), F.col("category"), F.lit(" of a long title with many words more")), F.lit("  ")]
    cards = F.transform(F.array(*endings), lambda x, k: F.struct(k.alias("place"), x.alias("ending")))
    pool = parts.withColumn("asked", asked).select("*", F.explode(cards).alias("c"))
    return pool.select("product_id", "asked", "brand", "category", "p_size", "c.place", F.when(F.col("c.place") < 7, F.concat("asked", "c.ending")).otherwise(F.col("c.ending")).alias("title"))


def _pool_sql(typed: str, more: str = "0") -> str:
    """The asked name's words are the title's first ones, so the partial score is 100 and the other follows from the lengths; a
    title that is for women and for men contradicts no name."""
    return f"""parts AS (SELECT CAST(p_partkey AS BIGINT) AS product_id, p_name, p_size, lower(p_type) AS category, replace(p_brand, '#', '') AS brand,
p_name || CASE WHEN p_size % 3 = 0 THEN ' ab' || p_size ELSE '' END || CASE WHEN p_size % 2 = 0 THEN ' womens' ELSE '' END AS asked FROM part),
pool AS (SELECT *, asked || CASE place WHEN 0 THEN '' WHEN 1 THEN ' ' || brand WHEN 2 THEN ' ' || brand || ' mens' WHEN 3 THEN ' ' || brand || ' pro' WHEN 4 THEN ' Shilla' WHEN 5 THEN ' ' || category ELSE ' ' || category || ' of a long title with many words more' END AS title
FROM parts, (VALUES (0), (1), (2), (3), (4), (5), (6)) AS g(place)),
marked AS (SELECT *, p_size % 3 = 0 AND p_size > 9 OR p_size IN (3, 6, 9) AS coded, {typed} AS typed, {more} AS other FROM pool),
rated AS (SELECT *, (100 + 200.0 * length(asked) / (length(asked) + length(title))) / 2 + CASE WHEN coded THEN 5 WHEN regexp_matches(asked, '[a-z]{{4,}}') THEN 3 ELSE 0 END - CASE WHEN NOT coded AND NOT typed THEN 30 ELSE 0 END - other AS score FROM marked)"""


_HEAD = "EXISTS (SELECT 1 FROM unnest(string_split(lower(title), ' ')) AS u(x) WHERE length(x) >= 4 AND left(x, 4) = left(category, 4))"
#: another brand: the asked one is missing and a Latin word is there that the asked name lacks; another variant of the same code
_OTHERS = "CASE WHEN place IN (4, 5, 6) THEN 60 ELSE 0 END + CASE WHEN place = 3 AND coded THEN 60 ELSE 0 END"


@query(f"""WITH {_pool_sql(_HEAD, _OTHERS)} SELECT product_id, place, title, round(score, 6) AS score, CASE WHEN score >= 78 THEN 'exact' WHEN score >= 65 THEN 'brand_line' ELSE 'skip' END AS grade
FROM rated WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY round(score, 9) DESC, place) = 1""")
def q_donor_pick(spark, sf_dir):
    """The best card of a product's pool, with all bonuses and penalties."""
    pool = donors.scored(_pool(spark, sf_dir), "asked", "title", "category", "brand").withColumn("score", F.round("score", 9))
    return donors.pick_donor(pool, "product_id", "place", "ozon_card").select("product_id", "place", "title", F.round("score", 6).alias("score"), "grade")


@query(f"""WITH {_pool_sql("contains(lower(title), category)")}, l AS (SELECT *, CASE place % 4 WHEN 0 THEN category || 's' WHEN 1 THEN 'shirts' WHEN 2 THEN '' ELSE 'big ' || category END AS labels, (product_id + place * 5) % 7 AS n FROM rated),
g AS (SELECT *, score >= 64 AS fits FROM l WHERE labels = '' OR list_contains(string_split(labels, ' '), category) OR (labels = category || 's' AND length(category) >= 5))
SELECT product_id, place, n, round(score, 6) AS score, CASE WHEN score >= 78 THEN 'exact' WHEN score >= 64 THEN 'brand_line' ELSE 'skip' END AS grade, true AS model_match
FROM g QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY fits DESC, CASE WHEN fits THEN n END DESC, round(score, 9) DESC, place) = 1""")
def q_rich_donor(spark, sf_dir):
    """Cards of the asked type, the richest of those that fit."""
    label = F.when(F.col("place") % 4 == 0, F.concat("category", F.lit("s"))).when(F.col("place") % 4 == 1, "shirts").when(F.col("place") % 4 == 2, "").otherwise(F.concat(F.lit("big "), F.col("category")))
    pool = donors.scored(_pool(spark, sf_dir), "asked", "title", "category", substring=True).withColumn("score", F.round("score", 9))
    pool = pool.withColumn("labels", label).withColumn("n", (F.col("product_id") + F.col("place") * 5) % 7)
    best = donors.pick_rich_donor(pool, "product_id", "place", "asked", "title", "category", "labels", "n")
    return best.select("product_id", "place", "n", F.round("score", 6).alias("score"), "grade", "model_match")


_FABRICS = (
    "<p>Состав: @p% хлопок, @q% полиэстер</p>", "<table><tr><td>Состав изделия</td><td>Хлопок @p%, Лиоцелл @q%</td></tr></table>", "<p>скидка @p% хлопок</p>", "<p>Состав - @p% хлопок / @q% полиэстер</p><p>Material: @p%cotton</p>",
    "<p>100% оригинал. Гарантия</p>", "<p>размер @p, хлопок</p>", "<p>@p% cotton, @q% polyester</p>" + "x" * 90 + "<p>Шёлк @q% и лён @p% и ещё много других слов здесь</p>", "<p>@p% хлопок</p>",
)


@query("""WITH v AS (SELECT CAST(page_id AS BIGINT) AS page_id, page_id % 8 AS kind, CAST(40 + page_id % 55 AS VARCHAR) AS p, CAST(60 - page_id % 55 AS VARCHAR) AS q, 40 + page_id % 55 >= 60 - page_id % 55 AS first_is_main FROM pages)
SELECT page_id, CASE kind WHEN 0 THEN p || '% хлопок, ' || q || '% полиэстер' WHEN 1 THEN p || '% Хлопок, ' || q || '% Лиоцелл' WHEN 3 THEN p || '% хлопок, ' || q || '% полиэстер; ' || p || '% cotton' WHEN 6 THEN p || '% cotton, ' || q || '% polyester; ' || q || '% Шёлк и ' || p || '% лён' ELSE '' END AS listed,
CASE WHEN kind IN (0, 1, 3) THEN CASE WHEN first_is_main THEN 'хлопок' WHEN kind = 1 THEN 'лиоцелл' ELSE 'полиэстер' END WHEN kind = 6 THEN CASE WHEN first_is_main THEN 'хлопок' ELSE 'полиэстер' END END AS main FROM v""")
def q_compositions(spark, sf_dir):
    """Fabric compositions of all pages."""
    pages = d.spread(d.table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "html"))
    share = {"@p": (40 + F.col("page_id") % 55).cast("string"), "@q": (60 - F.col("page_id") % 55).cast("string")}
    filled = lambda text: F.concat(*[share.get(x, F.lit(x)) for x in re.split("(@[pq])", text) if x])
    kind = F.col("page_id") % len(_FABRICS)
    listed = composition.compositions(F.concat("html", F.coalesce(*[F.when(kind == k, filled(x)) for k, x in enumerate(_FABRICS)])))
    found = pages.select("page_id", listed.alias("listed"))
    return found.select("page_id", F.array_join("listed", "; ").alias("listed"), composition.main_material(F.col("listed")).alias("main"))
