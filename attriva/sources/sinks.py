"""Sinks and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import first_by


def sharded_parquet(rows: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Parquet shards of at most ``rows_per_file`` rows."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The union of old and new rows, each key once, the newest version; the same input twice changes nothing."""
    return first_by(old.unionByName(new), keys, [-F.col(version).cast("double"), F.xxhash64(*[F.col(c) for c in old.columns])])


def wide(values: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """One row for each key with a column for each name; lists are joined by semicolons."""
    return values.groupBy(*keys).pivot(name, names).agg(F.array_join(F.array_sort(F.collect_set(value)), "; "))


def audit_csv(rows: DataFrame, path: str) -> None:
    """Append rows as CSV, links joined by semicolons."""
    rows.withColumn("urls", F.array_join("urls", ";")).write.mode("append").option("header", True).csv(path)


def json_log(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    rows.write.mode("append").json(path)


def report(results: DataFrame, checklist: DataFrame, summary: DataFrame, path: str) -> None:
    """The three tables of a report as CSV folders."""
    for name, rows in (("results", results), ("checklist", checklist), ("summary", summary)):
        rows.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
