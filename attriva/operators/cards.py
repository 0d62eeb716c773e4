"""Characteristics of product cards out of pages (the card parsers of 2.9, T28 to T30).

Every parser gives rows (key, place, name, value, value_ids); of the rows of a page that share a name without case the first
by place stays.  A place is the parser's rank, the island's number on the page and the path inside it, so the first is the
first in the page; members of one object have no order in a VARIANT and are taken by name.  Numbers come without trailing
zeros.  Broken islands give no rows and do not disturb the others; null pages give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import islands as i
from ..functions import text as t
from .windows import first_by

# Where the islands are, and the keys under which an island holds characteristics
STATE_DIV = r"""<div\s+id="state-webCharacteristics-[^"]+"\s+data-state=(?:'([^']+)'|"([^"]+)")"""
JSON_LD = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
INITIAL_STATE = r"(?s)(?:window\.)?__INITIAL_STATE__\s*=\s*(\{.*?)</script>"
NEXT_DATA = r"""(?s)<script[^>]+id=["']__NEXT_DATA__["'][^>]*>\s*(\{.*?)</script>"""
FRIENDLY = r'"specs"\s*:\s*\{[^}]*"friendly"\s*:\s*(\[[^\]]*\])'
SPEC_NAME = r"""data-auto=["']product-spec["'][^>]*>([^<]{1,120})</span>"""
SPEC_LINK = r"""data-zone-name=["']specLink["'][^>]*data-zone-data=["']([^"']+)["']"""
SPEC_SPAN = r"<span[^>]*>([^<]{1,300})</span>"
CONTAINERS = ("specs", "specifications", "characteristics", "parametervalues", "specification", "params", "attributes")
NESTED = ("specs", "values", "params", "specifications")
NAMES, VALUES = ("name", "key", "title", "label"), ("value", "values", "text", "valueText")

_NO_IDS = "cast(array() as array<string>)"


def _matches(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _first(pairs: DataFrame, key: str) -> DataFrame:
    """Named values only; of a page's equal names, without case, the first."""
    named = pairs.withColumn("name", t.strip(F.col("name"))).withColumn("value", t.strip(F.col("value"))).where("name <> '' and value <> ''")
    return first_by(named.withColumn("_low", F.lower("name")), [key, "_low"], [F.col("place")]).drop("_low")


def state_pairs(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Characteristics of state elements: raw JSON between single quotes, escaped JSON between double ones.

    Groups hold short, long and full lists; a characteristic's texts are joined by commas, its ids kept.
    """
    found = F.arrays_zip(_matches(F.col(html), STATE_DIV, 1).alias("raw"), _matches(F.col(html), STATE_DIV, 2).alias("escaped"))
    island = pages.select(key, F.posexplode(found).alias("_n", "_f")).select(key, "_n", i.safe_json(F.when(F.col("_f.raw") != "", F.col("_f.raw")).otherwise(i.unescaped(F.col("_f.escaped")))).alias("_v"))
    group = island.select(key, "_n", F.posexplode(i.items(i.member(F.col("_v"), "characteristics"))).alias("_g", "_c"))
    placed = lambda rank: lambda x, k: F.struct(F.lit(rank).alias("list"), k.alias("k"), x.alias("item"))
    lists = F.concat(*[F.transform(i.items(i.member(F.col("_c"), kind)), placed(rank)) for rank, kind in enumerate(("short", "long", "full"))])
    item = group.select(key, "_n", "_g", F.explode(lists).alias("_x"))
    values = i.items(i.member(F.col("_x.item"), "values"))
    texts = F.filter(F.transform(values, lambda v: i.string_of(i.member(v, "text"))), lambda x: x.isNotNull())
    ids = F.filter(F.transform(values, lambda v: F.when(~i.kind(i.member(v, "id")).isin("DOUBLE", "DECIMAL", "BOOLEAN"), i.scalar_text(i.member(v, "id")))), lambda x: x.isNotNull())
    rows = item.select(key, F.array(F.lit(0), "_n", "_g", "_x.list", "_x.k").alias("place"), i.string_of(i.member(F.col("_x.item"), "name")).alias("name"), F.array_join(texts, ", ").alias("value"), ids.alias("value_ids"))
    return _first(rows, key)


def _nested(item: Column) -> Column:
    """The items of an item's nested lists: each list that begins with an object, up to the first that names any item."""
    none = F.expr("cast(array() as array<variant>)")
    out, open_ = none, F.lit(True)
    for name in NESTED:
        own = i.items(i.member(item, name))
        own = F.when(open_ & i.is_object(F.try_element_at(own, F.lit(1))), own).otherwise(none)
        out = F.concat(out, own)
        open_ = open_ & ~_names_any(own)
    return out


def _names_any(own: Column) -> Column:
    return F.exists(own, lambda x: i.is_object(x) & (i.member(x, "name").isNotNull() | i.member(x, "key").isNotNull()))


def _is_group(item: Column) -> Column:
    """Whether a nested list names items, so that the item itself is no characteristic."""
    lists = [i.items(i.member(item, name)) for name in NESTED]
    out = F.lit(False)
    for own in lists:
        out = out | (i.is_object(F.try_element_at(own, F.lit(1))) & _names_any(own))
    return out


def container_pairs(containers: DataFrame, key: str, node: str, place: str) -> DataFrame:
    """(key, place, name, value) of containers: lists of items, one item, or an object of names and values.

    Items may nest in groups to any depth up to 12; a group that names items is no characteristic itself.
    """
    v = F.col(node)
    plain = (i.member(v, "name").isNotNull() | i.member(v, "key").isNotNull() | i.member(v, "title").isNotNull())
    values = F.transform(i.members(v), lambda m: m["value"])
    tops = F.when(i.is_object(v) & plain, F.array(v)).when(i.is_object(v), F.filter(values, i.is_object)).otherwise(F.filter(i.items(v), i.is_object))
    nodes = containers.select(key, place, F.explode(i.walked(tops, 12, _nested)).alias("_w")).select(key, place, "_w.path", "_w.node")
    item = F.col("node")
    leaf = nodes.where(i.is_object(item) & ~_is_group(item)).select(
        key, F.concat(place, F.array(F.lit(1)), "path", F.array(F.lit(1 << 30))).alias("place"),
        F.coalesce(*[i.string_of(i.member(item, x)) for x in NAMES]).alias("name"), F.coalesce(*[i.joined_text(i.member(item, x)) for x in VALUES]).alias("value"),
    )
    flat = containers.where(i.is_object(v) & ~plain).select(key, place, F.posexplode(i.members(v)).alias("_k", "_m"))
    flat = flat.select(key, F.concat(place, F.array(F.lit(1), "_k")).alias("place"), F.col("_m.key").alias("name"), i.scalar_text(F.col("_m.value")).alias("value"))
    return leaf.unionByName(flat)


def _every_child(node: Column) -> Column:
    return F.concat(F.transform(i.members(node), lambda m: m["value"]), i.items(node))


def spec_pairs(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Characteristics of a page's states, of its lists of ready pairs, and of its table of specifications, in this order."""
    blobs = F.concat(_matches(F.col(html), INITIAL_STATE), _matches(F.col(html), NEXT_DATA))
    island = pages.select(key, F.posexplode(blobs).alias("_n", "_b")).select(key, "_n", i.safe_json(i.balanced_slice(F.col("_b"))).alias("_v")).where("_v is not null")
    nodes = island.select(key, "_n", F.explode(i.walked(F.array("_v"), 12, _every_child)).alias("_w"))
    found = nodes.select(key, "_n", "_w.path", F.posexplode(i.members(F.col("_w.node"))).alias("_k", "_m")).where(F.lower("_m.key").isin(*CONTAINERS))
    containers = found.select(key, F.concat(F.array(F.lit(0), "_n"), "path", F.array("_k")).alias("place"), F.col("_m.value").alias("node"))
    states = container_pairs(containers, key, "node", "place")

    lists = pages.select(key, F.posexplode(_matches(F.col(html), FRIENDLY)).alias("_n", "_l")).select(key, "_n", F.posexplode(i.items(i.safe_json(F.col("_l")))).alias("_k", "_v"))
    text = F.when(i.kind(F.col("_v")) == "STRING", F.col("_v").try_cast("string"))
    ready = lists.select(key, F.array(F.lit(1), "_n", "_k").alias("place"), text.alias("_t")).where(F.contains("_t", F.lit(": ")))
    ready = ready.select(key, "place", F.regexp_extract("_t", "(?s)^(.*?): (.*)$", 1).alias("name"), F.regexp_extract("_t", "(?s)^(.*?): (.*)$", 2).alias("value"))

    # the text behind each name, up to the next one
    rows = F.arrays_zip(_matches(F.col(html), SPEC_NAME).alias("name"), F.slice(F.split(html, SPEC_NAME, -1), 2, 1 << 30).alias("rest"))
    spans = pages.where(F.contains(html, F.lit("product-spec"))).select(key, F.posexplode(rows).alias("_k", "_r")).select(key, "_k", t.strip(F.col("_r.name")).alias("name"), F.left("_r.rest", F.lit(1500)).alias("_rest"))
    link = i.scalar_text(i.member(i.parsed(F.replace(F.regexp_extract("_rest", SPEC_LINK, 1), F.lit("&quot;"), F.lit('"'))), "text"))
    texts = F.transform(_matches(F.left("_rest", F.lit(800)), SPEC_SPAN), t.strip)
    span = F.try_element_at(F.filter(texts, lambda x: (x != "") & (x != F.col("name")) & ~F.contains(x, F.lit("&"))), F.lit(1))
    table = spans.select(key, F.array(F.lit(2), "_k").alias("place"), "name", F.coalesce(link, span).alias("value"))
    return _first(states.unionByName(ready).unionByName(table).withColumn("value_ids", F.expr(_NO_IDS)), key)


def card_heads(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, title, brand, card_type) of every page: of the first product node that has each, titles else of the page's head."""
    blocks = F.transform(_matches(F.col(html), JSON_LD), i.safe_json)
    inner = lambda v: F.when(kind_is_graph(v), i.items(i.member(v, "@graph"))).otherwise(i.items(v))
    kind_is_graph = lambda v: i.kind(i.member(v, "@graph")) == "ARRAY"
    nodes = F.transform(i.walked(F.filter(blocks, lambda v: v.isNotNull()), 6, inner), lambda n: F.struct(n["path"].alias("path"), n["node"].alias("node")))
    node = pages.select(key, html, F.posexplode_outer(nodes).alias("_k", "_n")).select(key, html, "_n.path", F.col("_n.node").alias("node"))
    own = i.member(F.col("node"), "@type")
    product = i.is_object(F.col("node")) & ~F.coalesce(kind_is_graph(F.col("node")), F.lit(False)) & ((i.string_of(own) == "Product") | F.exists(i.items(own), lambda x: i.string_of(x) == "Product"))
    named = lambda x: i.string_of(i.member(F.col("node"), x))
    brand = F.coalesce(i.string_of(i.member(i.member(F.col("node"), "brand"), "name")), named("brand"))
    first = lambda c: F.min_by(F.when(product, c), F.when(product & c.isNotNull(), F.col("path")))
    head = node.groupBy(key).agg(first(named("name")).alias("title"), first(brand).alias("brand"), first(named("category")).alias("card_type"))
    og = t.collapse(F.regexp_extract(html, r"""(?is)<meta[^>]+property=["']og:title["'][^>]+content=["']([^"']+)["']""", 1))
    plain = t.collapse(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1))
    return pages.select(key, F.when(og != "", og).otherwise(plain).alias("_other")).join(head, key).select(key, F.coalesce("title", "_other").alias("title"), F.coalesce("brand", F.lit("")).alias("brand"), F.coalesce("card_type", F.lit("")).alias("card_type"))


def snippet_pairs(rows: DataFrame, key: str, snippet: str) -> DataFrame:
    """Pairs "name: value" of a snippet, parted by semicolons, bullets, bars and line ends; names of at most 40 letters
    and five words, values of at most 120."""
    parts = rows.select(key, F.posexplode(F.split(snippet, r"[;•·|\n\r]+")).alias("_k", "_p")).where(F.contains("_p", F.lit(":")))
    trimmed = lambda g: F.regexp_replace(F.regexp_replace(F.regexp_extract("_p", "(?s)^([^:]*):(.*)$", g), r"\s+", " "), r"^[ \t\-–—.]+|[ \t\-–—.]+$", "")
    pairs = parts.select(key, F.array("_k").alias("place"), trimmed(1).alias("name"), trimmed(2).alias("value"), F.expr(_NO_IDS).alias("value_ids"))
    fits = (F.length("name") <= 40) & (F.size(F.split("name", " ")) <= 5) & (F.length("value") <= 120)
    return _first(pairs.where(fits), key)
