"""Near-duplicate vectors by sorted projection passes.

Each pass orders the vectors by the signs of their projections on random directions, taken as one long binary number, and
compares every vector with its neighbours in a bounded window of that order; verified pairs are joined to components over
all passes.  Passes are enough that a pair right at the least cosine is missed by all of them in at most one of ``MISS``
cases, so their number grows with the logarithm of the table.  What windows hold is not what a component holds: links are
therefore counted inside the components, exactly.  Components of up to ``GROUP`` vectors are multiplied out; larger ones are
binned by the angle to their centre: two angles that together stay within the limit prove a link, two that differ by more
than it prove that there is none, so only pairs of bins in between are multiplied, in blocks of bounded size, which counts
rows and never lists pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do vectors of
unlike lengths among one another.  Of rows that share a vec_id one is taken, that with the smallest vector; a null vec_id
keeps its rows, without links and without a component, kept.  Ties in the order go to the smaller vec_id.  An empty table gives
no rows.  Further columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, lookup, ranked, written

#: A pair right at the least cosine is missed once in so many cases.
MISS = 1000
#: Neighbours on either side, and rows of a block of the order.
WINDOW, BLOCK = 256, 1024
#: Largest component that is multiplied out at once; rows of a block of a larger one.
GROUP, PIECE = 256, 256
BITS = 62
#: Width of an angle bin of a large component, in degrees.
STEP = 0.25
SEED = 20240612


def passes_for(rows: int, least: float, window: int = WINDOW) -> int:
    """Passes after which a pair of cosine ``least`` was in one window but for one of MISS cases.

    Two vectors at an angle agree in a sign with probability 1 - angle / 180 degrees; rows that agree in the first
    log2(rows / window) signs are expected to lie within a window.
    """
    signs = max(1.0, math.log2(max(rows, 2) / window))
    together = (1 - math.acos(least) / math.pi) ** signs
    return max(6, math.ceil(math.log(1 / MISS) / math.log(1 - together)))


def usable(vector: Column) -> Column:
    double = vector.cast("array<double>")
    finite = F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(double, lambda x: x != 0), F.lit(False))


def unit(column: pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def linked(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which rows of x and y have a cosine of ``least`` or more; close calls are summed anew, alike wherever they occur."""
    cos = x @ y.T
    hit = cos >= least
    for i, j in zip(*np.nonzero(np.abs(cos - least) < 1e-12), strict=True):
        hit[i, j] = (x[i] * y[j]).sum() >= least
    return hit


def _keys(rows: DataFrame, passes: int) -> DataFrame:
    """(vec_id, dim, pass, key): BITS signs of each pass as one number."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weights = (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for dim in np.unique(sizes):
                own = batch.take(pa.array(np.nonzero(sizes == dim)[0]))
                if dim not in planes:
                    planes[dim] = np.random.default_rng((SEED, int(dim))).standard_normal((dim, passes * BITS))
                signs = (unit(own.column(1)) @ planes[dim] > 0).reshape(-1, passes, BITS)
                key = (signs * weights).sum(axis=2)
                n = own.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own.column(0).to_numpy(), passes)), pa.array(np.full(n * passes, dim, np.int32)), pa.array(np.tile(np.arange(passes, dtype=np.int32), n)), pa.array(key.ravel())], names=["vec_id", "dim", "pass", "key"])

    return rows.mapInArrow(run, "vec_id long, dim int, pass int, key long")


def stars(ids: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each row that links with another to the first row (by place) of its component."""
    label = np.arange(len(ids))
    hit = hit | hit.T
    np.fill_diagonal(hit, True)
    busy = np.nonzero(hit.sum(axis=1) > 1)[0]
    hit, own = hit[np.ix_(busy, busy)], label[busy]
    while len(busy):
        new = np.where(hit, own[None, :], len(ids)).min(axis=1)
        if (new == own).all():
            break
        own = new
    label[busy] = own
    far = busy[label[busy] != busy]
    return ids[far], ids[label[far]]


def _neighbours(block: int, window: int, least: float):
    def run(table: pa.Table) -> pa.Table:
        at = table.column("rank").to_numpy()
        order = np.argsort(at)
        x, ids, at = unit(table.column("vector").combine_chunks())[order], table.column("vec_id").to_numpy()[order], at[order]
        hit = linked(x, x, least)
        ahead = at[None, :] - at[:, None]
        hit &= (ahead > 0) & (ahead <= window) & (at[:, None] // block == at[0] // block)
        a, b = stars(ids, hit)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def candidate_links(rows: DataFrame, least: float, passes: int, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(a, b): verified pairs that connect what each window of each pass holds, at most one for each row of a block.

    Ranks come from small rows of keys; vectors travel once for each pass, to their block and, the first of a block, to the
    block before, so a window crosses blocks.
    """
    order = ranked(written(_keys(rows, passes), "passes-keys"), ["pass", "dim"], ["key", "vec_id"], "passes-order")
    own = F.floor(F.col("rank") / block)
    blocks = F.when((own > 0) & (F.col("rank") % block < window), F.array(own, own - 1)).otherwise(F.array(own))
    places = order.select("vec_id", F.struct("pass", "rank", blocks.alias("blocks")).alias("place")).groupBy("vec_id").agg(F.collect_list("place").alias("places"))
    dealt = rows.join(places, "vec_id").select("vec_id", "vector", F.size("vector").alias("dim"), F.explode("places").alias("p")).select("vec_id", "vector", "dim", "p.pass", "p.rank", F.explode("p.blocks").alias("block"))
    return dealt.groupBy("pass", "dim", "block").applyInArrow(_neighbours(block, window, least), "a long, b long")


def _within(least: float):
    def run(table: pa.Table) -> pa.Table:
        x = unit(table.column("vector").combine_chunks())
        hit = linked(x, x, least)
        np.fill_diagonal(hit, False)
        return pa.table({"vec_id": table.column("vec_id"), "n_links": pa.array(hit.sum(axis=1), pa.int64())})

    return run


def _sums(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        if batch.num_rows:
            comp, x = batch.column(0).to_numpy(), unit(batch.column(1))
            for c in np.unique(comp):
                total[c] = total.get(c, 0) + x[comp == c].sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["comp", "total"])


def _sum_of_sums(table: pa.Table) -> pa.Table:
    x = table.column("total").combine_chunks()
    total = x.flatten().to_numpy().reshape(len(x), -1).sum(axis=0)
    return pa.table({"comp": table.column("comp").slice(0, 1), "centre": pa.array([total], pa.list_(pa.float64()))})


def _angles(batches):
    for batch in batches:
        if batch.num_rows:
            comp, ids, vector, centre = batch.columns
            y = centre.flatten().to_numpy().reshape(len(comp), -1)
            y = y / np.maximum(np.sqrt((y * y).sum(axis=1, keepdims=True)), 1e-300)
            bins = (np.degrees(np.arccos(np.clip((unit(vector) * y).sum(axis=1), -1, 1))) / STEP).astype(np.int32)
            yield pa.RecordBatch.from_arrays([comp, ids, vector, pa.array(bins)], names=["comp", "vec_id", "vector", "bin"])


def _bin_pairs(least: float):
    """Per component, of the numbers of its bins: what is proven for each bin, and the bins that must be multiplied with it."""
    limit = math.degrees(math.acos(least)) / STEP

    def run(table: pa.Table) -> pa.Table:
        bins, n = table.column("bin").to_numpy(), table.column("n").to_numpy()
        sure = bins[:, None] + bins[None, :] + 2 <= limit - 1e-6
        open_ = ~sure & (np.abs(bins[:, None] - bins[None, :]) - 1 <= limit + 1e-6)
        proven = (sure * n[None, :]).sum(axis=1) - np.diag(sure)
        partners = [[{"bin": int(bins[k]), "n": int(n[k])} for k in np.nonzero(row)[0]] for row in open_]
        kind = pa.list_(pa.struct([("bin", pa.int32()), ("n", pa.int64())]))
        return pa.table({"comp": table.column("comp"), "bin": table.column("bin"), "n": table.column("n"), "proven": pa.array(proven, pa.int64()), "partners": pa.array(partners, kind)})

    return run


def _piece_links(least: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"vec_id": pa.array([], pa.int64()), "n_links": pa.array([], pa.int64())})
        ids, other = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        hit = linked(unit(left.column("vector").combine_chunks()), unit(right.column("vector").combine_chunks()), least)
        hit &= ids[:, None] != other[None, :]
        return pa.table({"vec_id": pa.array(ids), "n_links": pa.array(hit.sum(axis=1), pa.int64())})

    return run


def _large(members: DataFrame, least: float, piece: int) -> DataFrame:
    """(vec_id, n_links) of the members of large components, by proofs over angle bins and blocks of the other pairs."""
    sums = members.select("comp", "vector").mapInArrow(_sums, "comp long, total array<double>")
    centres = written(sums.groupBy("comp").applyInArrow(_sum_of_sums, "comp long, centre array<double>"), "passes-centres")
    binned = members.join(lookup(centres, 20_000), "comp").select("comp", "vec_id", "vector", "centre").mapInArrow(_angles, f"comp long, vec_id long, vector {dict(members.dtypes)['vector']}, bin int")
    binned = written(binned, "passes-bins")
    pairs = "comp long, bin int, n long, proven long, partners array<struct<bin:int,n:long>>"
    plan = written(binned.groupBy("comp", "bin").agg(F.count(F.lit(1)).alias("n")).groupBy("comp").applyInArrow(_bin_pairs(least), pairs), "passes-plan")
    pieces = lambda n: F.ceil(n / piece).cast("int")
    rows = binned.join(lookup(plan, 20_000), ["comp", "bin"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), pieces(F.col("n"))).cast("int"))
    proven = rows.select("vec_id", F.col("proven").alias("n_links"))
    every = lambda n: F.sequence(F.lit(0), pieces(n) - 1)
    meets = rows.select("comp", "bin", "part", "vec_id", "vector", F.explode("partners").alias("o")).select("*", F.explode(every(F.col("o.n"))).alias("o_part"))
    left = meets.select("comp", F.col("bin").alias("b1"), F.col("part").alias("p1"), F.col("o.bin").alias("b2"), F.col("o_part").alias("p2"), "vec_id", "vector")
    right = meets.select(F.col("comp").alias("comp"), F.col("o.bin").alias("b1"), F.col("o_part").alias("p1"), F.col("bin").alias("b2"), F.col("part").alias("p2"), F.col("vec_id").alias("vec_id"), F.col("vector").alias("vector"))
    key = ["comp", "b1", "p1", "b2", "p2"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_piece_links(least), "vec_id long, n_links long")
    return proven.unionByName(found)


def link_counts(rows: DataFrame, labels: DataFrame, least: float, group: int = GROUP, piece: int = PIECE) -> DataFrame:
    """(vec_id, n_links): the vectors of a vector's own component that link with it, counted exactly."""
    sizes = ranked(labels.select(F.col("comp"), F.col("node").alias("vec_id")), ["comp"], ["vec_id"], "passes-members")
    members = written(rows.join(sizes.select("comp", "vec_id", "size"), "vec_id"), "passes-vectors")
    out = members.where(F.col("size") <= group).groupBy("comp").applyInArrow(_within(least), "vec_id long, n_links long")
    large = members.where(F.col("size") > group)
    if not large.isEmpty():
        out = out.unionByName(_large(large.select("comp", "vec_id", "vector"), least, piece))
    return out.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))


def near_duplicates(
    embeddings: DataFrame, least: float = 0.95, id_column: str = "vec_id", vector: str = "embedding", passes: int | None = None, window: int = WINDOW, block: int = BLOCK, group: int = GROUP, piece: int = PIECE
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector; see the module for the method and the defined cases."""
    every = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    ids = every.select("vec_id").where("vec_id is not null").distinct().unionByName(every.select("vec_id").where("vec_id is null"))
    rows = written(every.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).groupBy("vec_id").agg(F.min("vector").alias("vector")), "passes-rows")
    found = written(candidate_links(rows, least, passes or passes_for(rows.count(), least, window), window, block), "passes-links")
    labels = components(found)
    counts = link_counts(rows, labels, least, group, piece)
    own = labels.select(F.col("node").alias("vec_id"), "comp").join(counts, "vec_id", "left")
    out = ids.join(own, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
