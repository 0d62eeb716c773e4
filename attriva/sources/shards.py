"""Vector shards (S16): .npy files of vectors, paired by row with Parquet files of payloads."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import first_by

ROWS = "shard string, row_index long, vector array<float>"
PAYLOAD = ("name", "description", "categories", "characteristics")


def _decoded(batches):
    for batch in batches:
        for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            vectors = np.load(io.BytesIO(memoryview(content.as_buffer())), allow_pickle=False).astype(np.float32, copy=False)
            for at in range(0, len(vectors), 4096):
                part = vectors[at : at + 4096]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32)), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(part)), pa.array(np.arange(at, at + len(part))), lists], names=["shard", "row_index", "vector"])


def vectors_of(files: DataFrame, shard: str, content: str) -> DataFrame:
    """ROWS of .npy contents of two-dimensional numbers; a file is decoded by one task and leaves it in pieces."""
    return files.select(F.col(shard).cast("string"), F.col(content)).where(F.col(content).isNotNull()).mapInArrow(_decoded, ROWS)


def encoded(rows: DataFrame, shard: str, row_index: str, vector: str) -> DataFrame:
    """(shard, content): the .npy file of each shard's vectors in order of their rows; shards are sized to be one file."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column(row_index).to_numpy())
        vectors = table.column(vector).combine_chunks()
        out = io.BytesIO()
        np.save(out, vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(order), -1)[order], allow_pickle=False)
        return pa.table({"shard": [str(table.column(shard)[0].as_py())], "content": pa.array([out.getvalue()], pa.binary())})

    return rows.groupBy(shard).applyInArrow(run, "shard string, content binary")


def paired(vectors: DataFrame, payloads: DataFrame, key: str = "variantid") -> DataFrame:
    """Points (key, vector, payload columns) of rows that both sides have, by (shard, row_index); missing texts are empty; of a
    key's rows the last by shard and row stays."""
    both = vectors.join(payloads, ["shard", "row_index"])
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in payloads.columns else F.lit("").alias(c) for c in PAYLOAD]
    points = both.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), "vector", *texts, "shard", "row_index")
    return first_by(points, [key], [F.desc("shard"), F.desc("row_index")]).drop("shard", "row_index")


def import_shards(spark: SparkSession, folder: str, key: str = "variantid") -> DataFrame:
    """Points of a folder of vectors_N.npy and payloads_N.parquet; a shard without one of the two has no points."""
    number = lambda c: F.regexp_extract(c, r"_([^_/.]*)\.[a-z]+$", 1)
    files = spark.read.format("binaryFile").load(f"{folder}/vectors_*.npy").select(number(F.col("path")).alias("shard"), "content")
    payloads = spark.read.option("mergeSchema", True).parquet(f"{folder}/payloads_*.parquet")
    payloads = payloads.select("*", number(F.col("_metadata.file_path")).alias("shard"), F.col("_metadata.row_index").alias("row_index"))
    return paired(vectors_of(files, "shard", "content"), payloads, key)
