"""JSON that is embedded in pages, as VARIANT: slices, lenient parsing, walks over nodes (T28, T30 and the card parsers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: A text cut into strings, braces and what is between; a string that never ends takes the rest.
_PIECES = r'"(?:[^"\\]++|\\.)*+"?|[{}]|[^"{}]++'


def unescaped(c: Column) -> Column:
    """The entities that serialisers write into attributes, each resolved once."""
    for entity, char in (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def balanced_slice(c: Column) -> Column:
    """The object that begins at the first brace of a text, up to its closing brace; braces in strings do not count.

    Null where it never closes.  The text is cut into strings, braces and the rest, and depth and length are folded over
    the pieces.
    """
    start = F.position(F.lit("{"), c)
    body = F.substring(c, start, F.length(c))
    pieces = F.regexp_extract_all(body, F.lit(f"(?s){_PIECES}"), F.lit(0))
    depth = lambda s, x: s["depth"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)
    begin = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("closed"))
    step = lambda s, x: F.when(s["closed"], s).otherwise(F.struct(depth(s, x).alias("depth"), (s["size"] + F.length(x)).alias("size"), (depth(s, x) == 0).alias("closed")))
    end = F.aggregate(pieces, begin, step)
    return F.when((start > 0) & end["closed"], F.left(body, end["size"]))


def parsed(c: Column) -> Column:
    """A whole JSON text as VARIANT, null if it is none; a wrapping object makes text behind the value an error."""
    return F.variant_get(F.try_parse_json(F.concat(F.lit('{"x":'), strip(c), F.lit("}"))), "$.x", "variant")


def safe_json(c: Column) -> Column:
    """As ``parsed``; a text that is none is parsed again with its entities resolved."""
    return F.coalesce(parsed(c), parsed(unescaped(c)))


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING and so on."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v) == "OBJECT", F.lit(False))


def members(v: Column) -> Column:
    """An object's members as array of (key, value), else an empty array."""
    return F.coalesce(F.map_entries(F.when(is_object(v), v).try_cast("map<string,variant>")), F.expr("cast(array() as array<struct<key:string,value:variant>>)"))


def items(v: Column) -> Column:
    """A list's elements, else an empty array."""
    return F.coalesce(v.try_cast("array<variant>"), F.expr("cast(array() as array<variant>)"))


def member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f'$["{name}"]', "variant")


def string_of(v: Column) -> Column:
    """The stripped text of a JSON string, null for anything else and for blanks."""
    text = strip(F.when(kind(v) == "STRING", v.try_cast("string")))
    return F.when(text != "", text)


def scalar_text(v: Column) -> Column:
    """The stripped text of a string, number or boolean; null for anything else and for blanks."""
    text = strip(F.when(~kind(v).isin("OBJECT", "ARRAY", "VOID"), v.try_cast("string")))
    return F.when(text != "", text)


def joined_text(v: Column) -> Column:
    """A scalar's text, or the texts of a list's scalars joined by commas."""
    texts = F.filter(F.transform(items(v), scalar_text), lambda x: x.isNotNull())
    return F.when(kind(v) == "ARRAY", F.when(F.size(texts) > 0, F.array_join(texts, ", "))).otherwise(scalar_text(v))


_NODES = "array<struct<path:array<int>,node:variant>>"


def walked(roots: Column, rounds: int, children) -> Column:
    """All nodes that ``children`` (node to array of nodes) reaches from ``roots`` in ``rounds`` steps, with their paths."""
    begin = F.transform(roots, lambda v, k: F.struct(F.array(k).alias("path"), v.alias("node"))).cast(_NODES)
    below = lambda n: F.transform(children(n["node"]), lambda v, k: F.struct(F.concat(n["path"], F.array(k)).alias("path"), v.alias("node")))
    step = lambda s, _: F.struct(F.concat(s["every"], s["edge"]).alias("every"), F.flatten(F.transform(s["edge"], below)).cast(_NODES).alias("edge"))
    none = F.lit(None).cast(_NODES)
    state = F.struct(F.coalesce(none, F.array().cast(_NODES)).alias("every"), begin.alias("edge"))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(rounds + 1)), state, step)
    return out["every"]
