"""Merges, votes and consensus over candidates (A1 to A8), set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions.text import free_text_gate, gender_form, norm, norm_elements
from .windows import first_by


def priority_merge(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """A1: one candidate per key: higher source priority, longer evidence, earlier; confidence plays no part."""
    return first_by(candidates, keys, [-model.priority(F.col("source")), -F.length(F.coalesce("evidence", F.lit(""))), F.col("seq")])


def high_confidence_merge(candidates: DataFrame, keys: list[str], least: float = 0.85) -> DataFrame:
    """A4: of the candidates of confidence ``least`` or more the surest, the earlier of equals."""
    return first_by(candidates.where(F.col("confidence") >= least), keys, [-F.col("confidence"), F.col("seq")])


def legacy_merge(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """A5: surest, then lower legacy priority, then earlier."""
    return first_by(candidates, keys, [-F.col("confidence"), F.coalesce(model.legacy_priority(F.col("source")), F.lit(99)), F.col("seq")])


def consensus_boost(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """A2: candidates one of whose elements two sources or more name gain 0.10, up to 0.97.

    Sources of an element combine before the exchange to the first and the last by name; a key's backed elements, which are
    few, are then joined to its candidates, whose order and number stay as they are.
    """
    own = norm_elements(F.col("value_str"), F.col("value_arr"), F.col("is_list"))
    named = candidates.select(*keys, "source", F.explode(own).alias("_element")).groupBy(*keys, "_element").agg(F.min("source").alias("_a"), F.max("source").alias("_z")).where("_a <> _z")
    backed = named.groupBy(*keys).agg(F.collect_list("_element").alias("_backed"))
    up = F.coalesce(F.arrays_overlap(own, F.col("_backed")), F.lit(False)) & (F.col("confidence") < 0.97)
    joined = candidates.join(backed, keys, "left")
    return joined.withColumn("confidence", F.when(up, F.least(F.lit(0.97), F.col("confidence") + 0.10)).otherwise(F.col("confidence"))).drop("_backed")


def collection_union(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """A3: fold of a key's candidates in order of seq into one value list.

    Elements are kept at their first occurrence, compared without case; ids stay only if every side has one for each
    element; the result takes source and evidence of the surer side, the earlier of equals.  A card or datasheet that is
    surer than a model or web value by 0.10 keeps the latter out.  The fold runs in order, so it sees a key's candidates
    together: they are few, one per source and stage.
    """
    ids = "array<bigint>"
    values = F.when(F.col("is_list"), F.col("value_arr")).otherwise(F.array("value_str"))
    row = F.struct(
        F.col("seq"), values.alias("vals"), F.transform(values, norm).alias("low"), F.col("value_ids").cast(ids).alias("ids"),
        F.col("confidence"), F.col("source"), F.coalesce("evidence", F.lit("")).alias("evidence"),
    )
    rows = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"))

    none = F.array().cast("array<string>")

    def fresh(o: Column, n: Column) -> Column:
        """Places (from 1) of new elements that are not blank, not among the old and not earlier among the new."""
        return F.filter(F.sequence(F.lit(1), F.size(n)), lambda i: (F.element_at(n, i) != "") & ~F.array_contains(o, F.element_at(n, i)) & (F.array_position(n, F.element_at(n, i)) == i))

    def as_state(vals, low, keep_ids, conf, source, evidence):
        return F.struct(vals.alias("vals"), low.alias("low"), keep_ids.cast(ids).alias("ids"), conf.cast("double").alias("confidence"), source.cast("string").alias("source"), evidence.cast("string").alias("evidence"))

    def one(x):
        return as_state(x["vals"], x["low"], x["ids"], x["confidence"], x["source"], x["evidence"])

    def step(a, b):
        card_a, card_b = a["source"].isin(*model.OVERRIDE), b["source"].isin(*model.OVERRIDE)
        guess_a, guess_b = a["source"].isin(*model.INFERENCE), b["source"].isin(*model.INFERENCE)
        keep_a = card_a & guess_b & (a["confidence"] >= b["confidence"] + 0.10)
        keep_b = card_b & guess_a & (b["confidence"] >= a["confidence"] + 0.10)

        def union(at):
            pick = lambda what: F.concat(F.transform(at["a"], lambda i: F.try_element_at(a[what], i)), F.transform(at["b"], lambda i: F.try_element_at(b[what], i)))
            whole = (F.coalesce(F.size(a["ids"]), F.lit(-1)) == F.size(a["vals"])) & (F.coalesce(F.size(b["ids"]), F.lit(-1)) == F.size(b["vals"]))
            merged_ids = F.when(whole, pick("ids"))
            merged_ids = F.when(~F.exists(merged_ids, lambda x: x.isNull()), merged_ids)
            surer = a["confidence"] >= b["confidence"]
            return as_state(pick("vals"), pick("low"), merged_ids, F.greatest(a["confidence"], b["confidence"]), F.when(surer, a["source"]).otherwise(b["source"]), F.when(surer, a["evidence"]).otherwise(b["evidence"]))

        at = F.struct(fresh(none, a["low"]).alias("a"), fresh(a["low"], b["low"]).alias("b"))
        return F.when(keep_a, one(a)).when(keep_b, one(b)).otherwise(F.element_at(F.transform(F.array(at), union), 1))

    first = F.element_at("_rows", 1)
    start = one(first)
    folded = rows.select(*keys, F.aggregate(F.slice("_rows", 2, F.size("_rows")), start, step).alias("_m"))
    return folded.select(*keys, F.col("_m.vals").alias("value_arr"), F.col("_m.ids").alias("value_ids"), F.col("_m.confidence").alias("confidence"), F.col("_m.source").alias("source"), F.col("_m.evidence").alias("evidence"))


def votes(neighbours: DataFrame, keys: list[str], value: str, seq: str, quorum: str = "half") -> DataFrame:
    """The most frequent value of a key, the first seen of equals, with votes, voters and confidence.

    ``half``: at least half of the voters agree, 0.7 + 0.05 per vote up to 0.95; ``two``: two votes, 0.6 + 0.4 * share.
    """
    counted = neighbours.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_votes"), F.min(seq).alias("_seq"))
    best = first_by(counted, keys, [-F.col("n_votes"), F.col("_seq")]).drop("_seq")
    voters = neighbours.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_voters"))
    joined = best.join(voters, keys)
    if quorum == "half":
        return joined.where(F.col("n_votes") >= F.ceil(F.col("n_voters") / 2)).withColumn("confidence", F.least(0.7 + 0.05 * F.col("n_votes"), F.lit(0.95)))
    return joined.where("n_votes >= 2").withColumn("confidence", 0.6 + 0.4 * (F.col("n_votes") / F.col("n_voters")))


def gated_votes(voted: DataFrame, translations: dict[str, str] | None = None) -> DataFrame:
    """Voted values as candidates with evidence: values of fields with options must name one, gender words in their
    dictionary form; free text passes the gate of neighbours' texts.

    ``voted`` has value_str, the numbers of ``votes`` and target_name and allowed_values of its target.
    """
    from .predicates import membership_guard

    closed = F.coalesce(F.size("allowed_values"), F.lit(0)) > 0
    value = F.when(closed, F.coalesce(gender_form(F.col("value_str")), F.col("value_str"))).otherwise(free_text_gate(F.col("value_str"), translations))
    shaped = voted.withColumns({
        "value_str": value, "evidence": F.format_string("seen in %d/%d similar cards", F.col("n_votes").cast("long"), F.col("n_voters").cast("long")),
        "is_list": F.lit(False), "value_arr": F.lit(None).cast("array<string>"), "value_ids": F.lit(None).cast("array<bigint>"),
    }).where("value_str is not null")
    return membership_guard(shaped).drop("is_list", "value_arr", "value_ids")


def most_frequent(df: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    """The most frequent value of a key, the first of equals."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("_seq"))
    return first_by(counted, keys, [-F.col("n"), F.col("_seq")]).drop("_seq")


def union_all(*frames: DataFrame) -> DataFrame:
    """Stage outputs in order; their place is kept in ``stage``."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("stage", F.lit(i)) for i, f in enumerate(frames)])


def coalesced(primary: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The primary's value of each column where it has one, else the other's."""
    rest = [c for c in primary.columns if c not in keys]
    joined = primary.alias("p").join(other.alias("o"), keys, "full")
    return joined.select(*keys, *[F.coalesce(f"p.{c}", f"o.{c}").alias(c) for c in rest])


def neighbour_merge(primary: DataFrame, other: DataFrame, keys: list[str], identity: str, seq: str) -> DataFrame:
    """Neighbours of both lists, the primary's first; each identity once, rows without one stay."""
    both = union_all(primary, other)
    named = first_by(both.where(F.col(identity).isNotNull()), [*keys, identity], [F.col("stage"), F.col(seq)])
    return named.unionByName(both.where(F.col(identity).isNull()))


def image_merge(found: DataFrame) -> DataFrame:
    """Cards found by several engines, by marketplace and card id: best score, engines, first title; rows without id stay."""
    known = found.where("card_id is not null").groupBy("marketplace", "card_id").agg(
        F.max("score").alias("score"), F.array_sort(F.collect_set("engine")).alias("engines"), F.min_by("title", "seq").alias("title"), F.min("seq").alias("seq")
    )
    rest = found.where("card_id is null").select("marketplace", "card_id", "score", F.array("engine").alias("engines"), "title", "seq")
    return known.unionByName(rest)
