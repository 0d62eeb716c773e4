"""The cascade of stages and the chain that turns candidates into final values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import aggregates as a
from ..operators import brands as b
from ..operators import consistency as c
from ..operators import predicates as p


def cascade(candidates: DataFrame, keys: list[str], stage: str) -> DataFrame:
    """Candidates of a stage count only where no confident candidate of an earlier stage has settled the target."""
    sure = p.is_confident(F.col("confidence"), F.col("source"), F.col("semantic_type"))
    first = candidates.where(sure).groupBy(*keys).agg(F.min(stage).alias("_settled"))
    return candidates.join(first, keys, "left").where(F.col("_settled").isNull() | (F.col(stage) <= F.col("_settled"))).drop("_settled")


def merged(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, as a fold in order of seq would leave it: scalars compete by priority until the first collection
    comes; from there on values are united."""
    listed = F.coalesce("is_collection", F.lit(False)) | F.coalesce("is_list", F.lit(False))
    first = F.min(F.when(listed, F.col("seq"))).over(Window.partitionBy(*keys))
    marked = candidates.withColumn("_first", first)
    early = F.col("_first").isNull() | (F.col("seq") < F.col("_first"))
    winner = a.priority_merge(marked.where(early), keys)
    alone = winner.where("_first is null").drop("_first")
    several = winner.where("_first is not null").unionByName(marked.where(~early))
    united = a.collection_union(several, keys).withColumns({"value_str": F.lit(None).cast("string"), "value_id": F.lit(None).cast("long"), "is_list": F.lit(True), "is_collection": F.lit(True)})
    columns = [*keys, "value_str", "value_arr", "is_list", "is_collection", "value_id", "value_ids", "confidence", "source", "evidence"]
    return alone.select(*columns).unionByName(united.select(*columns))


def finalize(candidates: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """One value per key: guards on candidates, abstention, consensus, merge of scalars and collections, then the guards on
    merged values; ``targets`` has attribute_id, target_name, semantic_type, has_values and is_required."""
    joined = candidates.drop("semantic_type").join(targets, "attribute_id")
    kept = joined.transform(p.positive).transform(p.brand_guard).transform(p.color_guard).transform(p.customs_guard)
    kept = kept.transform(lambda d: p.abstain_lone_guesses(d, keys)).transform(lambda d: a.consensus_boost(d, keys))
    one = p.reconcile_ids(merged(kept, keys)).join(targets, "attribute_id")
    return p.drop_unresolved(p.drop_unresolved(one, False), True)


VALUE = ("product_id", "attribute_id", "value_str", "value_arr", "is_list", "is_collection", "value_id", "value_ids", "confidence", "source", "evidence")


def whole_chain(candidates: DataFrame, targets: DataFrame, products: DataFrame, listed_brands: DataFrame) -> DataFrame:
    """Final values of (product_id, attribute_id) by every guard, in the order in which they build on one another.

    ``targets``: (attribute_id, target_name, type, semantic_type, allowed_values, has_values, is_required), alike for all
    products; ``products``: (product_id, product_name, brand, category_path, text); ``listed_brands``: as ``title_brands`` takes
    them.  Before the merge: hard facts need a ground, objective specifications of weak sources an authority, zero
    confidence and placeholders go, enum values must be options, customs codes, brands and colours come from where they may.
    The merge: lone guesses abstain, agreement counts, scalars compete and collections unite.  After it: fields that
    contradict each other, the brand that the title names, the last gate, ids that fit, enums without ids.
    """
    keys = ["product_id", "attribute_id"]
    facts = products.select("product_id", "product_name", F.col("text").alias("_text"), F.lower(F.concat_ws(" ", "product_name", "text")).alias("_all"))
    joined = candidates.drop("semantic_type").join(targets, "attribute_id").join(facts, "product_id")
    spec = p.is_objective_spec(F.col("semantic_type"), F.col("type"), F.col("target_name"))
    kept = p.hard_fact_guard(joined, F.col("_all"), F.col("product_name"))
    kept = p.corroborated(kept, spec, keys).transform(p.positive).transform(p.without_placeholders).transform(p.membership_guard)
    kept = kept.transform(p.customs_guard).transform(p.brand_guard).transform(p.color_guard)
    kept = kept.transform(lambda d: p.abstain_lone_guesses(d, keys)).transform(lambda d: a.consensus_boost(d, keys))
    one = merged(kept.drop("_text", "_all", "product_name"), keys).select(*VALUE)
    every = products.select("product_id").join(targets.select("attribute_id", "target_name"))  # a product's targets: those of its catalog
    numbered = every.withColumn("seq", F.col("attribute_id"))
    one = c.contradictions(one, numbered, products.select("product_id", "product_name"))
    found = b.title_brands(products.select("product_id", F.col("product_name").alias("title"), "brand", "category_path"), listed_brands)
    one = b.brand_from_name(one, every, found)
    gated = p.verification_gate(one.join(targets, "attribute_id").join(facts, "product_id"), F.col("_all")).drop("_text", "_all", "product_name")
    return p.drop_unresolved(p.drop_unresolved(p.reconcile_ids(gated), False), True).select(*VALUE)


def settled(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Running flag: whether an earlier row of the key (by seq) was confident."""
    sure = p.is_confident(F.col("confidence"), F.col("source"), F.col("semantic_type")).cast("int")
    w = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return candidates.withColumn("settled", F.coalesce(F.max(sure).over(w), F.lit(0)) == 1)
