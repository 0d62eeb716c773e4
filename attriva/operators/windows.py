"""Keyed reductions, first and top rows, grouping by gaps.

First-wins rules are ranks cut to the first rows: the engine cuts each task's rows before the exchange, so a hot key
costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key's rows the one that is smallest by ``order``; the order must be total."""
    return top_n(df, keys, order, 1, "_rank").drop("_rank")


def longest_per_key(df: DataFrame, key: str, text: str, at: str) -> DataFrame:
    """The longest text of each key, the earliest of equals, and where the key appeared first."""
    return df.groupBy(key).agg(F.min_by(text, F.struct(-F.length(text), F.col(at))).alias(text), F.min(at).alias(at))


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key with their rank; the engine drops further rows before the exchange."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def with_margin(df: DataFrame, keys: list[str], score: str, order: list[Column], least: float, margin: float) -> DataFrame:
    """The best row of a key if it scores ``least`` and leads the second by ``margin``."""
    two = top_n(df, keys, [F.desc(score), *order], 2, "_r")
    w = Window.partitionBy(*keys).orderBy("_r")
    led = two.withColumn("_next", F.lead(score).over(w)).where("_r = 1")
    return led.where((F.col(score) >= least) & (F.col(score) - F.coalesce("_next", F.lit(0.0)) >= margin)).drop("_r", "_next")


def leftmost(df: DataFrame, keys: list[str], start: str, *ties: str) -> DataFrame:
    """The match that starts first."""
    return first_by(df, keys, [F.col(start), *[F.col(t) for t in ties]])


def maximal_spans(spans: Column) -> Column:
    """Spans (struct with s and e) that no longer span of the array holds."""
    return F.filter(spans, lambda x: ~F.exists(spans, lambda y: (y["s"] <= x["s"]) & (x["e"] <= y["e"]) & (y["e"] - y["s"] > x["e"] - x["s"])))


def chunked(df: DataFrame, keys: list[str], order: list[Column], size: int) -> DataFrame:
    """Chunk numbers from 0, ``size`` rows each, within a key."""
    return df.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size).cast("int"))


def gap_groups(df: DataFrame, keys: list[str], at: str, gap: float, *ties: str) -> DataFrame:
    """Numbers of the groups in which consecutive rows lie at most ``gap`` apart."""
    w = Window.partitionBy(*keys).orderBy(at, *ties)
    opens = F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("_opens", opens).withColumn("group_no", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def by_preference(df: DataFrame, key: str, ranked: list[str], *ties: str) -> DataFrame:
    """Rows in the order of a preference list, unknown ones last."""
    place = F.coalesce(*[F.when(F.col(key) == name, i) for i, name in enumerate(ranked)], F.lit(9999))
    return df.withColumn("pool_rank", place).orderBy("pool_rank", *ties)
