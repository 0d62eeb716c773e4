"""Catalog relations derived from the driver's tables, alike in DataFrames and in SQL.

Products are parts; candidates are line items (source by supplier, attribute by line number); the order of candidates is a
struct of seven columns that together are unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..operators.joins import spread  # noqa: F401

NAMES = [s[0] for s in model.SOURCES]
ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> DataFrame:
    """(product_id, attribute_id, seq, value_str, value_arr, is_list, confidence, source, evidence, semantic_type, is_collection, value_id, value_ids)."""
    names = names or NAMES
    rows = table(spark, sf_dir, "lineitem")
    long = lambda c: F.col(c).cast("long")
    ids = F.when(F.col("l_suppkey") % 3 == 0, F.array(long("l_suppkey"), long("l_suppkey") + 1, long("l_suppkey") + 2))
    return rows.select(
        long("l_partkey").alias("product_id"), long("l_linenumber").alias("attribute_id"), F.struct(*ORDER).alias("seq"),
        F.concat("l_returnflag", "l_linestatus").alias("value_str"), F.array("l_returnflag", "l_linestatus", F.month("l_shipdate").cast("string")).alias("value_arr"),
        (F.col("l_linenumber") >= 6).alias("is_list"), ((50 + (F.col("l_suppkey") * 7) % 50) / 100.0).cast("double").alias("confidence"),
        F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("l_suppkey") % len(names) + 1).cast("int")).alias("source"),
        F.expr("repeat('x', cast(l_quantity as int))").alias("evidence"), F.when(F.col("l_linenumber") == 7, "sku").alias("semantic_type"),
        (F.col("l_linenumber") >= 6).alias("is_collection"), F.when(F.col("l_suppkey") % 2 == 0, long("l_suppkey")).alias("value_id"), ids.alias("value_ids"),
    )


def candidates_sql(names: list[str] | None = None) -> str:
    names = names or NAMES
    listed = ", ".join(f"'{n}'" for n in names)
    return f"""candidates AS (
  SELECT CAST(l_partkey AS BIGINT) AS product_id, CAST(l_linenumber AS BIGINT) AS attribute_id, {', '.join(ORDER)},
    l_returnflag || l_linestatus AS value_str, [l_returnflag, l_linestatus, CAST(month(l_shipdate) AS VARCHAR)] AS value_arr,
    l_linenumber >= 6 AS is_list, CAST((50 + (l_suppkey * 7) % 50) / 100.0 AS DOUBLE) AS confidence, ([{listed}])[l_suppkey % {len(names)} + 1] AS source,
    repeat('x', CAST(l_quantity AS INT)) AS evidence, CASE WHEN l_linenumber = 7 THEN 'sku' END AS semantic_type, l_linenumber >= 6 AS is_collection,
    CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_suppkey AS BIGINT) END AS value_id,
    CASE WHEN l_suppkey % 3 = 0 THEN [CAST(l_suppkey AS BIGINT), CAST(l_suppkey AS BIGINT) + 1, CAST(l_suppkey AS BIGINT) + 2] END AS value_ids
  FROM lineitem),
src(source, priority, threshold, judge, legacy) AS (VALUES {', '.join("('%s', %d, %s, %s, %s)" % (s[0], s[1], s[2], s[3] if s[3] is not None else 'NULL', s[4] if s[4] is not None else 'NULL') for s in model.SOURCES)})"""


SEQ = ", ".join(ORDER)
# Names and properties of the seven derived targets
TARGETS = (
    (1, "Бренд", "text", None, False, True), (2, "Цвет товара", "enum", "color", True, False), (3, "Материал", "enum", "material", True, True), (4, "Мощность, Вт", "numeric", "power", False, False),
    (5, "ТН ВЭД", "enum", None, True, True), (6, "Особенности", "enum", None, True, False), (7, "Артикул", "text", "sku", False, True),
)


def targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TARGETS), "attribute_id long, target_name string, type string, semantic_type string, has_values boolean, is_required boolean")


def targets_sql() -> str:
    rows = ", ".join("(%d, '%s', '%s', %s, %s, %s)" % (i, n, t, f"'{s}'" if s else "NULL", h, r) for i, n, t, s, h, r in TARGETS)
    return f"targets(attribute_id, target_name, type, semantic_type, has_values, is_required) AS (VALUES {rows})"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product with every target, and whether a candidate fills it."""
    best = candidates(spark, sf_dir).groupBy("product_id", "attribute_id").agg(
        F.max("confidence").alias("confidence"), F.max(F.col("value_id").isNotNull()).alias("resolved"), F.count(F.lit(1)).alias("n_candidates"),
        F.count("value_id").alias("n_with_id"), F.max(F.col("source").isin(*model.CARD_SOURCES)).alias("has_card"),
    )
    products = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("product_id"))
    every = products.withColumn("attribute_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long")))).join(F.broadcast(targets(spark)), "attribute_id")
    return every.join(best, ["product_id", "attribute_id"], "left").withColumn("filled", F.coalesce(F.col("confidence") >= 0.75, F.lit(False))).withColumn("resolved", F.coalesce("resolved", F.lit(False)))


GRID_SQL = """best AS (
  SELECT product_id, attribute_id, max(confidence) AS confidence, bool_or(value_id IS NOT NULL) AS resolved, count(*) AS n_candidates, count(value_id) AS n_with_id,
    bool_or(source IN ('wb_card', 'ozon_card')) AS has_card FROM candidates GROUP BY ALL),
grid AS (
  SELECT CAST(p_partkey AS BIGINT) AS product_id, t.*, b.confidence, coalesce(b.resolved, false) AS resolved, b.n_candidates, b.n_with_id, b.has_card, coalesce(b.confidence >= 0.75, false) AS filled
  FROM part CROSS JOIN targets t LEFT JOIN best b ON b.product_id = p_partkey AND b.attribute_id = t.attribute_id)"""
