"""Checkpoint folder, lineage cuts and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where it is unset (tests on one machine) a local one is made."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that they share")
        base = f"file://{tempfile.mkdtemp(prefix='attriva-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def texts(docs: DataFrame, batch_bytes: int = 2 << 20) -> DataFrame:
    """(doc_id long, text string) of ``docs``; Arrow batches of this session are held to ``batch_bytes`` bytes (or one row),
    so that neither side ever buffers many long texts, or many packed runs of documents, at once."""
    spark = docs.sparkSession
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get(key).strip().lower())
    if int(own[1]) << 10 * " kmgt".index(own[2] or " ") > batch_bytes:
        spark.conf.set(key, str(batch_bytes))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def written(df: DataFrame, what: str, gather: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut and survives lost executors.

    ``gather``: for results that are much smaller than what they were made from, one more exchange lets the engine write
    files of its advisory size instead of one for each task.
    """
    spark = df.sparkSession
    if gather:
        df = df.hint("rebalance")
    path = f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.option("parquet.page.size.row.check.min", "4").option("parquet.block.size.row.check.min", "4").mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of ``written`` that no later plan reads, and have the driver let go of shuffle files that nothing refers to."""
    jvm = spark.sparkContext._jvm
    for table in tables:
        for path in {jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).getParent().toString() for f in table.inputFiles()}:
            if not re.search(r"-[0-9a-f]{32}$", path):
                raise ValueError(f"no intermediate table: {path}")
            path = jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    jvm.System.gc()


def collected(spark: SparkSession) -> None:
    """Have the executors collect their garbage, so that heap which an earlier step has grown goes back to the system.

    Heap that was once in use stays with the JVM until a full collection; workers in Python then come on top of it.
    One short task for each core; it changes no data, and an executor that gets none keeps its heap until later.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("said")).collect()


def crc_mod(column: str, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % k


def lookup(ids: DataFrame, rows: int = 500_000) -> DataFrame:
    """A table of ids for a semi or anti join: broadcast if it has at most ``rows`` rows, else joined by a sort merge."""
    return F.broadcast(ids) if ids.count() <= rows else ids.hint("merge")


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose key is not in the one column of ``ids``; no column name of ``docs`` can clash."""
    taken, name = {c.lower() for c in docs.columns}, "gone"
    while name in taken:
        name += "_"
    return docs.join(lookup(ids.toDF(name)), F.col(key) == F.col(name), "left_anti")


def components(pairs: DataFrame, a: str = "a", b: str = "b", start: DataFrame | None = None, max_rounds: int = 100) -> DataFrame:
    """Connected components of undirected edges: (node, comp), comp being the smallest node.

    Each round hooks every component onto its smallest neighbour and shortens the chains of hooks by two steps, so chains
    shrink geometrically; every step is a keyed aggregate or join with map-side combining, so a hub node never meets in
    one task, and every round is cut by a written table.  ``start``: components of a part of the edges, to go on from.
    """
    edges = pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct()
    edges = written(edges, "cc-edges", gather=True)
    ends = edges.select(F.col("v").alias("node"), F.col("u").alias("to")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("to")))
    if start is not None:
        ends = ends.select("node", F.col("node").alias("to")).unionByName(start.select("node", F.col("comp").alias("to")))
    label = written(ends.groupBy("node").agg(F.min("to").alias("comp")), "cc", gather=True)
    for _ in range(max_rounds):
        mixed = edges.join(label.select(F.col("node").alias("u"), F.col("comp").alias("cu")), "u").join(label.select(F.col("node").alias("v"), F.col("comp").alias("cv")), "v").where("cu <> cv")
        hook = mixed.select(F.greatest("cu", "cv").alias("root"), F.least("cu", "cv").alias("to")).groupBy("root").agg(F.min("to").alias("to"))
        hook = written(hook, "cc-hook", gather=True)
        if hook.isEmpty():
            return label
        far = hook.select(F.col("root").alias("r2"), F.col("to").alias("t2"))
        two = hook.join(far, F.col("to") == F.col("r2"), "left").select("root", F.coalesce("t2", "to").alias("to"))
        label = written(label.join(two, F.col("comp") == F.col("root"), "left").select("node", F.coalesce("to", "comp").alias("comp")), "cc", gather=True)
    raise RuntimeError("components did not settle")


def ranked(rows: DataFrame, groups: list[str], order: list[str], what: str) -> DataFrame:
    """``rows`` as a written table with ``rank`` (from 0) within the groups by ``order`` and the group's ``size``.

    Rows are dealt by ranges of (groups, order), so a group of any size is spread over tasks; each task numbers its sorted
    rows, and one small table of (group, task) counts gives every stretch its first rank.  Groups must not be null; rows
    that tie in the whole order must be interchangeable.
    """
    laid = rows.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order).withColumn("_at", F.monotonically_increasing_id())
    laid = written(laid.withColumn("_task", F.shiftright("_at", 33)), what)
    stretch = laid.groupBy(*groups, "_task").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    own = Window.partitionBy(*groups)  # of a group one row a task at most
    stretch = written(stretch.select(*groups, "_task", "_from", (F.sum("_n").over(own.orderBy("_task")) - F.col("_n")).alias("_before"), F.sum("_n").over(own).alias("size")), f"{what}-starts", gather=True)
    return laid.join(lookup(stretch), [*groups, "_task"]).withColumn("rank", F.col("_before") + F.col("_at") - F.col("_from")).drop("_task", "_at", "_from", "_before")
