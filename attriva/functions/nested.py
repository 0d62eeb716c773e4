"""JSON, map and array functions of payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm


def characteristics(c: Column) -> Column:
    """D3: map of attribute to values from a JSON text whose values are lists or single values; malformed: empty."""
    raw = F.from_json(c, "map<string,string>")
    lists = F.transform_values(raw, lambda _, v: F.coalesce(F.from_json(v, "array<string>"), F.array(v)))
    return F.coalesce(lists, F.create_map().cast("map<string,array<string>>"))


def attribute_value(chars: Column, name: Column) -> Column:
    """The first value of an attribute, names compared case-insensitively, spaces as underscores; null: none."""
    key = lambda x: F.replace(norm(x), F.lit(" "), F.lit("_"))
    found = F.filter(F.map_entries(chars), lambda e: key(e["key"]) == key(name))
    return F.try_element_at(F.try_element_at(found, F.lit(1))["value"], F.lit(1))


def pick_language(texts: Column, order: tuple[str, ...] = ("ru", "en", "main")) -> Column:
    """The text of the first language at hand of array<struct<lang,text>>, else any."""
    pick = [F.try_element_at(F.filter(texts, _is(lang)), F.lit(1))["text"] for lang in order]
    return F.coalesce(*pick, F.try_element_at(texts, F.lit(1))["text"])


def _is(lang: str):
    return lambda t: t["lang"] == lang


def keep_keys(values: Column, names: tuple[str, ...]) -> Column:
    """D7."""
    return F.map_filter(values, lambda k, v: k.isin(*names) & v.isNotNull())


def joined(values: Column, most: int = 5) -> Column:
    """Up to ``most`` items, joined by a bar."""
    return F.array_join(F.slice(F.filter(values, lambda x: x.isNotNull() & (x != "")), 1, most), " | ")


def first_present(*columns: Column) -> Column:
    """The first that is not null or blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def export_values(values: Column, ids: Column) -> Column:
    """Array of (dictionary_value_id, value), ids padded with nulls."""
    return F.transform(values, lambda v, i: F.struct(F.try_element_at(F.coalesce(ids, F.array().cast("array<bigint>")), (i + 1).cast("int")).alias("dictionary_value_id"), v.alias("value")))


def option_map(options: Column, compositions: Column) -> Column:
    """Map of name to value from array<struct<name,value>>, later names win, and the composition as one text."""
    named = F.filter(options, lambda o: o["name"].isNotNull() & (F.trim(o["name"]) != "") & o["value"].isNotNull() & (F.trim(o["value"]) != ""))
    pairs = F.transform(named, lambda o: F.struct(F.trim(o["name"]).alias("key"), F.trim(o["value"]).alias("value")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    made = F.map_from_entries(last)
    parts = F.array_join(F.transform(compositions, lambda x: F.concat_ws(" ", x["name"], F.when(x["percent"].isNotNull(), F.concat(x["percent"].cast("string"), F.lit("%"))))), ", ")
    has = (F.coalesce(F.size(compositions), F.lit(0)) > 0) & ~F.coalesce(F.map_contains_key(made, "Состав"), F.lit(False))
    return F.when(has, F.map_concat(made, F.create_map(F.lit("Состав"), parts))).otherwise(made)
