"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_mod, texts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_bytes: int, held_out_of: int = 5) -> DataFrame:
    """(doc_id, text, y): labelled training rows, those whose crc32(doc_id) mod ``held_out_of`` is not 0.

    At most ``max_rows`` of each class, the first by a hash of the id, and, by expectation, ``max_bytes`` of text.
    Only these ids are broadcast, so documents are not shuffled.  Rows with a null label or id take no part; of
    several labels of an id the larger counts.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("y")).where("_id is not null and y is not null")
    ids = ids.where(crc_mod("_id", held_out_of) != 0).groupBy("_id").agg(F.max("y").alias("y"))
    order = F.xxhash64("_id")
    few = None
    for y in (0, 1):
        part = ids.where(F.col("y") == y).orderBy(order, "_id").limit(max_rows)
        few = part if few is None else few.unionByName(part)
    few = few.select("_id", "y")
    out = texts(docs).join(F.broadcast(few), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y")
    total = out.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if total > max_bytes:
        out = out.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_bytes / total))
    return out
