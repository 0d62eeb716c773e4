"""Coverage, usage, quality and error reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import top_n


def usage(features: DataFrame) -> DataFrame:
    """Totals over (product_id, source, tokens); everything but "cache" counts as generated."""
    generated = F.coalesce(F.col("source"), F.lit("")) != "cache"
    per = features.groupBy("product_id").agg(F.count_if(generated).alias("g"), F.count_if(~generated).alias("c"), F.sum(F.coalesce("tokens", F.lit(0))).alias("t"))
    return per.agg(F.coalesce(F.sum("g"), F.lit(0)).alias("generated_count"), F.count_if(F.col("g") >= 1).alias("generated_products"), F.coalesce(F.sum("c"), F.lit(0)).alias("cached_count"), F.coalesce(F.sum("t"), F.lit(0)).alias("total_tokens"))


def coverage(grid: DataFrame) -> DataFrame:
    """A10: per product targets and filled ones, by required and optional; ``grid`` has is_required, filled, resolved, has_values."""
    req, opt = F.col("is_required"), ~F.col("is_required")
    out = grid.groupBy("product_id").agg(
        F.count_if(req).alias("n_required"), F.count_if(opt).alias("n_optional"), F.count_if(req & F.col("filled")).alias("filled_required"), F.count_if(opt & F.col("filled")).alias("filled_optional"),
        F.count_if(F.col("has_values") & F.col("filled")).alias("id_total"), F.count_if(F.col("has_values") & F.col("filled") & F.col("resolved")).alias("id_resolved"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.withColumn("required_share", share("filled_required", "n_required")).withColumn("optional_share", share("filled_optional", "n_optional"))


def extractable_coverage(grid: DataFrame) -> DataFrame:
    """A10: per product the optional targets that can be extracted, those filled, and the share; ``grid`` has is_required,
    filled, platform and not_applicable (F30).  Fields of the platform, and fields that the product cannot have, do not count."""
    own = ~F.col("is_required") & ~F.coalesce("platform", F.lit(False)) & ~F.coalesce("not_applicable", F.lit(False))
    out = grid.groupBy("product_id").agg(
        F.count_if(~F.col("is_required")).alias("n_optional"), F.count_if(own).alias("n_extractable"), F.count_if(own & F.col("filled")).alias("filled_extractable"),
        F.count_if(~F.col("is_required") & ~F.coalesce("platform", F.lit(False)) & F.coalesce("not_applicable", F.lit(False))).alias("n_not_applicable"),
    )
    return out.withColumn("honest_share", F.when(F.col("n_extractable") > 0, F.col("filled_extractable") / F.col("n_extractable")))


def unfounded(confidence: Column, value: Column, *texts: Column) -> Column:
    """A confident value, no number and longer than three letters, that none of the product's texts holds."""
    low = F.lower(F.trim(value))
    ground = F.lower(F.concat_ws(" ", *texts))
    return F.coalesce((confidence > 0.85) & (F.length(low) > 3) & ~low.rlike("^[0-9]+$") & ~F.contains(ground, low), F.lit(False))


def coverage_summary(per_product: DataFrame) -> DataFrame:
    """Global ratios, means of ratios, and the share of products with 80 % or more of the required ones."""
    return per_product.agg(
        (F.sum("filled_required") / F.sum("n_required")).alias("required_global"), F.avg("required_share").alias("required_mean"),
        (F.sum("filled_optional") / F.sum("n_optional")).alias("optional_global"), F.avg("optional_share").alias("optional_mean"),
        F.avg((F.col("required_share") >= 0.8).cast("double")).alias("should_fill"), (F.sum("id_resolved") / F.sum("id_total")).alias("resolved_share"),
    )


def by_source(values: DataFrame) -> DataFrame:
    """A12."""
    return values.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def fill_rates(grid: DataFrame, always: float = 0.9) -> DataFrame:
    """Fill rate of each attribute, and whether it is nearly always or never filled."""
    out = grid.groupBy("attribute_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("filled").alias("n_filled"))
    rate = F.col("n_filled") / F.col("n")
    return out.withColumn("rate", rate).withColumn("grade", F.when(rate >= always, "always").when(F.col("n_filled") == 0, "never").otherwise("sometimes"))


def scores(per_product: DataFrame) -> DataFrame:
    """Half required, half optional share in percent with one decimal, or the one side there is."""
    req, opt = F.col("filled_required") / F.greatest("n_required", F.lit(1)), F.col("filled_optional") / F.greatest("n_optional", F.lit(1))
    score = F.when((F.col("n_required") > 0) & (F.col("n_optional") > 0), 0.5 * req + 0.5 * opt).when(F.col("n_required") > 0, req).otherwise(opt)
    return per_product.select("product_id", F.bround(score * 100, 1).alias("score"))


def checklist(grid: DataFrame, high: float = 0.85, medium: float = 0.60) -> DataFrame:
    """Targets that are empty or less sure than ``high``, with status and colour."""
    empty = F.col("confidence").isNull()
    status = F.when(empty & F.col("is_required"), "empty (required)").when(empty, "empty").otherwise("check")
    return grid.where(empty | (F.col("confidence") < high)).select("product_id", "attribute_id", status.alias("status"), F.when(F.col("confidence") >= medium, "yellow").otherwise("red").alias("color"), F.bround("confidence", 2).alias("confidence"))


def top_missing(grid: DataFrame, n: int = 15) -> DataFrame:
    """The attributes that most products lack."""
    return grid.groupBy("attribute_id").agg(F.count_if(~F.col("filled")).alias("n_missing")).orderBy(F.desc("n_missing"), "attribute_id").limit(n)


def resolution(values: DataFrame) -> DataFrame:
    """Share of enum values with an id, and of those in the dictionary."""
    return values.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("value_id").isNotNull().cast("double")).alias("resolved_share"), F.avg(F.col("in_dictionary").cast("double")).alias("in_dictionary_share"))


def dictionary(rows: DataFrame) -> DataFrame:
    """Sorted distinct values of each category and attribute; empty ones left out."""
    return rows.where("value is not null and value <> ''").groupBy("category", "attribute").agg(F.array_sort(F.collect_set("value")).alias("vals"), F.count_distinct("value").alias("n_values"))


def truncated_dictionary(rows: DataFrame, most: int) -> DataFrame:
    """Up to ``most`` first values of each attribute, and whether there were more."""
    distinct = rows.where("value is not null").select("category", "attribute", "value").distinct()
    kept = top_n(distinct, ["category", "attribute"], [F.col("value")], most).groupBy("category", "attribute").agg(F.array_sort(F.collect_list("value")).alias("vals"))
    total = distinct.groupBy("category", "attribute").agg(F.count(F.lit(1)).alias("n_values"))
    return kept.join(total, ["category", "attribute"]).withColumn("values_truncated", F.col("n_values") > most)


def failed_values(values: DataFrame, n: int = 15, samples: int = 3) -> DataFrame:
    """The attributes with most unresolved values and up to ``samples`` of these."""
    bad = values.where("value_id is null")
    counts = bad.groupBy("attribute_id").agg(F.count(F.lit(1)).alias("n_failed")).orderBy(F.desc("n_failed"), "attribute_id").limit(n)
    some = top_n(bad.select("attribute_id", "value").distinct(), ["attribute_id"], [F.col("value")], samples).groupBy("attribute_id").agg(F.array_sort(F.collect_list("value")).alias("samples"))
    return counts.join(some, "attribute_id")


def drains(grid: DataFrame) -> DataFrame:
    """Why empty targets are empty: A no candidate and no card, B card without it, C enum without id, D lost otherwise."""
    code = (
        F.when((F.col("n_candidates") == 0) & ~F.col("card_found"), "A").when(F.col("n_candidates") == 0, "B")
        .when(F.col("is_enum") & (F.col("n_with_id") == 0), "C").otherwise("D")
    )
    return grid.where(~F.col("filled")).withColumn("drain", code)


def drain_summary(coded: DataFrame) -> DataFrame:
    """Drains by attribute and the dominant one, the first letter of equals."""
    return coded.groupBy("attribute_id").agg(F.count(F.lit(1)).alias("n"), F.mode("drain", True).alias("dominant"), *[F.count_if(F.col("drain") == c).alias(f"n_{c.lower()}") for c in "ABCD"])


def cost(calls: DataFrame, in_price: float, out_price: float) -> DataFrame:
    """Calls, tokens and cost by provider, prices per million tokens."""
    return calls.groupBy("provider").agg(F.count(F.lit(1)).alias("n_calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), ((F.sum("tokens_in") * in_price + F.sum("tokens_out") * out_price) / 1_000_000).alias("cost"))


def judge_stats(judged: DataFrame) -> DataFrame:
    """A28."""
    return judged.groupBy("source", "outcome").agg(F.count(F.lit(1)).alias("n"))


def accuracy(compared: DataFrame) -> DataFrame:
    """Coverage and accuracy in percent over expected values; ``compared`` has got (null: none) and matches."""
    return compared.agg(F.count(F.lit(1)).alias("n_expected"), F.count("got").alias("n_filled"), F.count_if("matches").alias("n_right"), (100 * F.count("got") / F.count(F.lit(1))).alias("coverage"), F.when(F.count("got") > 0, 100 * F.count_if("matches") / F.count("got")).alias("accuracy"))


def rollup_report(values: DataFrame) -> DataFrame:
    """Values by source and semantic class with subtotals (an addition)."""
    return values.rollup("source", "attribute_id").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"))
