"""Names of characteristics to target names where they differ: fuzzy for feature lists (J8), by vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import text as t
from .joins import nearest
from .windows import first_by, with_margin

# Literals by which a feature list states that a feature is absent
NEGATIVES = ("no", "none", "нет", "false", "not available", "not supported", "не поддерживается", "не предусмотрен", "не предусмотрено", "без")
# Least fuzzy score, and the length up to which a name may match as a part of a target name
LEAST, SHORT = 65.0, 8


def translated(name: Column, translations: dict[str, str]) -> Column:
    """A name's translation: of the whole name, else of the longest known phrase in it (the first of equals), else the name."""
    own = t.strip(name)
    if not translations:
        return own
    known = F.array(*[F.struct(F.lit(k.lower()).alias("k"), F.lit(v).alias("v")) for k, v in sorted(translations.items(), key=lambda kv: -len(kv[0]))])
    held = F.filter(known, lambda x: F.contains(F.lower(own), x["k"]))
    return F.coalesce(F.try_element_at(held, F.lit(1))["v"], own)


def match_features(features: DataFrame, targets: DataFrame, keys: list[str], product: str, translations: dict[str, str] | None = None, negatives: bool = False) -> DataFrame:
    """(product, target_id, seq, name, value, rank) of the features (keys, product, seq, name, value) that match a target
    (keys, target_id, name, type, place) of the same keys.

    A name's target is the best by the weighted score of its translation (rank 1), else for a short translation by the
    partial score (2), else by the weighted score of the untranslated name (3), each of at least LEAST, the first target of
    equals.  It depends on the name and the keys alone, so distinct names are scored, once, and only pairs whose letters
    allow the score.  Of a product's features that reach the same target the first by seq stays.  Stated absences are left
    out; with ``negatives`` they fill boolean targets with "Нет".
    """
    absent = t.norm(F.col("value")).isin(*NEGATIVES)
    given = features.where((F.col("name") != "") & (F.col("value") != "")).withColumn("_absent", absent)
    given = given if negatives else given.where(~F.col("_absent"))
    names = given.select(*keys, F.col("name").alias("_name")).distinct().withColumn("_own", translated(F.col("_name"), translations or {}))
    goals = targets.select(*keys, "target_id", F.col("name").alias("_target"), "type", "place").where("_target is not null")
    signed = names.withColumn("_s", fuzzy.letters(F.col("_own"))).withColumn("_s0", fuzzy.letters(F.col("_name")))
    pairs = signed.join(goals.withColumn("_t", fuzzy.letters(F.col("_target"))), keys)
    own, name, target = F.col("_own"), F.col("_name"), F.col("_target")
    may = {1: fuzzy.may_reach("weighted_ratio", own, target, F.col("_s"), F.col("_t"), LEAST), 2: (F.length(own) <= SHORT) & fuzzy.may_reach("partial_ratio", own, target, F.col("_s"), F.col("_t"), LEAST), 3: (own != name) & fuzzy.may_reach("weighted_ratio", name, target, F.col("_s0"), F.col("_t"), LEAST)}
    tries = F.array_compact(F.array(*[F.when(may[k], F.struct(F.lit(k).alias("rank"), (own if k < 3 else name).alias("text"))) for k in may]))
    asked = pairs.select(*keys, "_name", "target_id", "_target", "type", "place", F.explode(tries).alias("_q")).select("*", "_q.rank", "_q.text").drop("_q")
    kinds = [asked.where(asked["rank"] != 2).withColumn("score", fuzzy.score("weighted_ratio", F.col("text"), target)), asked.where(asked["rank"] == 2).withColumn("score", fuzzy.score("partial_ratio", F.col("text"), target))]
    hits = kinds[0].unionByName(kinds[1]).where(F.col("score") >= LEAST)
    best = first_by(hits, [*keys, "_name"], [F.col("rank"), F.desc("score"), F.col("place")]).select(*keys, F.col("_name").alias("name"), "target_id", "type", "rank")
    found = given.join(best, [*keys, "name"]).where(~F.col("_absent") | F.col("type").isin("bool", "boolean"))
    first = first_by(found, [product, "target_id"], [F.col("seq")])
    return first.select(product, "target_id", "seq", "name", F.when(F.col("_absent"), "Нет").otherwise(F.col("value")).alias("value"), "rank")


def match_by_vectors(names: DataFrame, targets: DataFrame, least: float = 0.82, margin: float = 0.05, block: int = 512) -> DataFrame:
    """(name_id, target_id, similarity): the target (id, vector) most similar to a name (id, vector), if it has the least
    similarity and leads the second by the margin; an only target leads by its whole similarity.

    Names are asked in blocks against tasks that each keep their two best targets, so no pairs are listed or moved.
    """
    asked = names.select((-1 - F.col("id")).alias("id"), "vector")  # so that no name has a target's id
    two = nearest(asked, targets, 2, block).withColumnRenamed("rank", "_place")
    best = with_margin(two, ["query_id"], "similarity", [F.col("id")], least, margin)
    return best.select((-1 - F.col("query_id")).alias("name_id"), F.col("id").alias("target_id"), "similarity")
