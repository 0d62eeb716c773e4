"""Customs codes against the dictionary of a category (2.9-14).

A dictionary holds labels "code - text"; a code's old label and the one that replaced it share the code, so an old label leads
to its active sibling by the code.  Codes are resolved once for each (category, type), not for each product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import first_by

# Fixed value: labels that are no longer in force
DEPRECATED = r"(?iu)действие\s+(?:прекращено|приостановлено)|прекращ[еён]+о\s+(?:с\s+)?\d|утратил[аои]?\s+силу|исключ[еён]+"


def deprecated(label: Column) -> Column:
    return F.coalesce(label, F.lit("")).rlike(DEPRECATED)


def leading_code(label: Column) -> Column:
    """The six to ten digits that a label begins with; null: none."""
    code = F.regexp_extract(label, r"^\s*(\d{6,10})", 1)
    return F.when(code != "", code)


def is_full_code(value: Column) -> Column:
    """The judge's rule: a value begins with exactly ten digits."""
    return F.coalesce(value.rlike(r"^\s*\d{10}(?:\D|$)"), F.lit(False))


def customs_target(name: Column) -> Column:
    return F.contains(F.lower(name), F.lit("тн вэд"))


def type_key(type_id: Column, leaf: Column) -> Column:
    """What a proposed code is kept by beside the category: the type, else the category's leaf."""
    return F.coalesce(type_id.cast("string"), F.concat(F.lit("leaf:"), leaf))


def proposed_code(answer: Column) -> Column:
    """The ten digits of an answer, other characters taken out; null: not ten."""
    digits = F.regexp_replace(answer, r"\D", "")
    return F.when(F.length(digits) == 10, digits)


def resolve_customs(codes: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code, value, value_id, state) for distinct (keys, code); ``labels``: (keys, value, value_id, place).

    confirmed: the first label in force that begins with the code, with its id; unchecked: the keys have no dictionary, the
    bare code stays; codes that a dictionary does not hold in force are left out.
    """
    asked = codes.select(*keys, "code").where("code is not null").distinct()
    active = labels.where(~deprecated(F.col("value"))).withColumn("code", leading_code(F.col("value"))).where("code is not null")
    first = first_by(active.select(*keys, "code", "value", "value_id", "place"), [*keys, "code"], [F.col("place")]).drop("place")
    known = labels.select(*keys).distinct().withColumn("_listed", F.lit(True))
    joined = asked.join(first, [*keys, "code"], "left").join(known, keys, "left").where("value is not null or _listed is null")
    state = F.when(F.col("value").isNotNull(), "confirmed").otherwise("unchecked")
    return joined.select(*keys, "code", F.coalesce("value", "code").alias("value"), "value_id", state.alias("state"))


def longest_prefix(codes: DataFrame, labels: DataFrame, keys: list[str], least: int = 6) -> DataFrame:
    """(keys, code, value, value_id, shared): the label in force that shares the longest beginning with a code, of at least
    ``least`` digits, the first by place of equals.

    Both sides' beginnings are the join keys, so a code meets only labels of its own heading, never the whole dictionary.
    """
    heads = lambda c: F.explode(F.sequence(F.lit(least), F.least(F.lit(10), F.length(c))))
    asked = codes.select(*keys, "code").where(F.length("code") >= least).distinct()
    asked = asked.select("*", heads(F.col("code")).alias("shared")).withColumn("_head", F.left("code", F.col("shared")))
    own = labels.where(~deprecated(F.col("value"))).withColumn("_own", leading_code(F.col("value"))).where("_own is not null")
    own = own.select(*keys, "value", "value_id", "place", "_own", heads(F.col("_own")).alias("_n")).withColumn("_head", F.left("_own", F.col("_n")))
    first = first_by(own.select(*keys, "_head", "value", "value_id", "place"), [*keys, "_head"], [F.col("place")])  # of a heading only its first label can win
    return first_by(asked.join(first, [*keys, "_head"]), [*keys, "code"], [F.desc("shared"), F.col("place")]).select(*keys, "code", "value", "value_id", "shared")
