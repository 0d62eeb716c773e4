"""Audit of how document filters interact: every order of the filters, step by step.

Each document gets a mask of the filters that it fails; documents, labels and masks are counted into at most 2**5 cells
per part, and all orders are read off the cells: the walk visits the permutations by single swaps of neighbours, and only
the two steps that a swap touches are counted anew; a filter's Shapley sum grows along the walk.

Defined cases: a null text counts as empty, a null part as the empty string, so an empty table gives no rows.  A null doc_id
is larger than none and smaller than none, so it fails no duplicate test and makes no other fail it; of rows that share
doc_id and text none is a copy of the other (ties), each row counts.  Of several labels of an id the larger counts; rows
without a label are neither good nor toxic.  Texts are read whole, however long; further columns of ``docs`` are not read,
so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

LETTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text: A few words, B few distinct words, C many capitals, D a marker character."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    return {"A": n < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * n, "C": 100 * capitals > 3 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def failure_masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, mask): bit k of ``mask`` is set where the document fails filter k of ``LETTERS``.

    E, a copy of a smaller doc_id's text: the smallest doc_id of each text digest is a keyed minimum that tasks form
    before they exchange rows; a document is first if that table holds its own (doc_id, digest), an even join however many
    copies a text has.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = [F.when(failed, 1 << LETTERS.index(x)).otherwise(0) for x, failed in text_failures(text).items()]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))
    base = written(base, "audit-masks")
    first = base.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return base.join(first, ["doc_id", "digest"], "left").select("doc_id", "part", (F.col("mask") + F.when(copy, 1 << LETTERS.index("E")).otherwise(0)).alias("mask"))


def cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): counts of documents, at most 2**5 rows a part."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    is_one = lambda c: F.sum(F.when(F.col(c) == 1, 1).otherwise(0))
    return masks.join(own, "doc_id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), is_one("quality").alias("good"), is_one("toxic").alias("toxic"))


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places k whose swaps of items k and k + 1 lead from the first order through all n! orders, each once.

    Every item but the first walks through the row of the smaller ones and turns at its ends; the largest that can move
    moves.
    """
    order, way = list(range(n)), [-1] * n
    while True:
        free = [x for x in order if 0 <= (to := order.index(x) + way[x]) < n and order[to] < x]
        if not free:
            return
        x = max(free)
        k = order.index(x)
        to = k + way[x]
        order[k], order[to] = order[to], order[k]
        way[x + 1 :] = [-w for w in way[x + 1 :]]
        yield min(k, to)


def walk(mask: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """Rows (order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part.

    ``mask``: the cells' masks, ``counts``: their documents, good and toxic ones.
    """
    order, steps = list(range(len(LETTERS))), [None] * len(LETTERS)
    fails = [counts[mask & 1 << x > 0, 0].sum() for x in order]
    alone = [counts[mask == 1 << x, 0].sum() for x in order]

    def count(k: int) -> None:
        before = sum(1 << x for x in order[:k])
        own = 1 << order[k]
        lost = counts[(mask & before == 0) & (mask & own > 0)].sum(axis=0)
        steps[k] = (counts[mask & (before | own) == 0, 0].sum(), lost[0], fails[order[k]] - lost[0], alone[order[k]], lost[1], lost[2])

    rows, total, since, seen = [], [0] * len(order), [0] * len(order), 0

    def settle(k: int) -> None:
        """Adds what the filter at step k removed in the orders in which it stood there."""
        total[order[k]] += steps[k][1] * (seen - since[order[k]])
        since[order[k]] = seen

    def visit() -> None:
        name = "".join(LETTERS[x] for x in order)
        rows.extend((name, k + 1, *steps[k], order[k]) for k in range(len(order)))

    for k in range(len(order)):
        count(k)
    visit()
    for k in adjacent_swaps(len(order)):
        seen += 1
        settle(k)
        settle(k + 1)
        order[k], order[k + 1] = order[k + 1], order[k]
        count(k)
        count(k + 1)
        visit()
    seen += 1
    for k in range(len(order)):
        settle(k)
    return [(*r[:-1], total[r[-1]]) for r in rows]


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step; see the module for the defined cases."""
    table = cells(failure_masks(docs, part), labels)
    by_part = table.groupBy("part").agg(*[F.collect_list(c).alias(c) for c in ("mask", "n", "good", "toxic")])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                got = walk(np.array(row["mask"], np.int64), np.array([row["n"], row["good"], row["toxic"]], np.int64).T)
                columns = list(zip(*got, strict=True))
                kinds = [pa.string(), pa.int32(), *[pa.int64()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(got)), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return by_part.mapInArrow(run, SCHEMA)
