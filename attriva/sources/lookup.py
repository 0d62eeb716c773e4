"""Dictionary lookups (S28): listings and searches over value tables that are laid out for them.

The table is partitioned by category and type and sorted by attribute and id, so that a listing reads one partition and, by the
statistics of its row groups, the attribute alone; many searches are one join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import first_by, top_n

KEYS = ["category_id", "type_id", "attribute_id"]
#: Values of a page, and of one listing at most: the feature's own cap.
PAGE, MOST = 100, 300


def write_values(values: DataFrame, path: str) -> None:
    """Values (category_id, type_id, attribute_id, value_id, value) as a table for lookups."""
    laid = values.repartition("category_id", "type_id").sortWithinPartitions(*KEYS, "value_id")
    laid.write.mode("overwrite").partitionBy("category_id", "type_id").parquet(path)


def list_values(spark: SparkSession, path: str, category_id: int, type_id: int, attribute_id: int, after: int = 0, most: int = MOST) -> DataFrame:
    """(value_id, value) of one attribute behind the id ``after``, by id, at most ``most`` (a top-k)."""
    rows = spark.read.parquet(path).where((F.col("category_id") == category_id) & (F.col("type_id") == type_id) & (F.col("attribute_id") == attribute_id) & (F.col("value_id") > after))
    return rows.select("value_id", "value").orderBy("value_id").limit(most)


def listed_values(values: DataFrame, page: int = PAGE, most: int = MOST) -> DataFrame:
    """All keys' listings at once: the first ``most`` values of each key by id, with the page each is on, from 0."""
    first = top_n(values.select(*KEYS, "value_id", "value"), KEYS, [F.col("value_id")], most, "place")
    return first.withColumn("page", F.floor((F.col("place") - 1) / page).cast("int")).drop("place")


def search_values(queries: DataFrame, values: DataFrame) -> DataFrame:
    """(keys, query, value_id, value): of each distinct query the first value by id that holds it, without case; queries that
    none holds, and blank ones, are left out."""
    asked = queries.select(*KEYS, "query").where(F.trim("query") != "").distinct()
    hits = asked.join(values.select(*KEYS, "value_id", "value"), KEYS).where(F.contains(F.lower("value"), F.lower("query")))
    return first_by(hits, [*KEYS, "query"], [F.col("value_id")])


def category_of_type(tree: DataFrame) -> DataFrame:
    """(type_id, category_id): the category under which a type stands in the tree (id, parent_id, type_id), the smallest of
    several."""
    return tree.where("type_id is not null and parent_id is not null").groupBy("type_id").agg(F.min("parent_id").alias("category_id"))
