"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on the driver from a bounded sample (``sample`` vectors, the first by a hash of their id); every
row is then assigned to a leaf.  A query walks the tree best bin first: a priority queue of nodes by distance to their
centres yields leaves in order.  How many leaves to visit is calibrated: some queries are answered by brute force over
all rows, and the number of leaves is widened until their recall reaches ``recall``.

Leaf and visits meet in groups of at most about ``chunk`` rows and ``chunk`` queries: a leaf with more rows or visits
is cut by hashes of the ids, so a leaf that holds a third of all rows is many groups.  Distances are Euclidean, in
double precision, on the original vectors.

Defined cases: vectors that are null, zero, of another than the commonest length, or hold null or non-finite
components take no part, nor do null ids; rows that repeat an id are one candidate, at its smallest distance; ties go
to the smaller id; fewer candidates than k: all of them; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written
from .textops import gathered


#: Sampled points of a child on average, so that a small node is not split into single points.
LEAST_POINTS = 4


class KMeansTree:
    """Centres of all nodes, children of inner nodes, and leaf numbers."""

    def __init__(self, points: np.ndarray, branch: int, leaf_points: int, seed: int = 3):
        self.centres, self.children, self.leaf = [], [], []
        rng = np.random.default_rng(seed)
        self.n_leaves = 0
        self._grow(points, points.mean(0), branch, leaf_points, rng)
        self.centres = np.array(self.centres)

    def _grow(self, points, centre, branch, leaf_points, rng) -> int:
        me = len(self.centres)
        self.centres.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        parts = []
        if len(points) > leaf_points:
            centres, of = _kmeans(points, min(branch, max(2, len(points) // LEAST_POINTS)), rng)
            parts = [(points[of == k], centres[k]) for k in range(len(centres)) if (of == k).any()]
        if len(parts) < 2:
            self.leaf[me] = self.n_leaves
            self.n_leaves += 1
        else:
            for own, c in parts:
                self.children[me].append(self._grow(own, c, branch, leaf_points, rng))
        return me

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: the nearest child at every level."""
        node = np.zeros(len(x), np.int64)
        out = np.full(len(x), -1, np.int64)
        active = np.arange(len(x))
        while len(active):
            left = []
            for n in np.unique(node[active]):
                own = active[node[active] == n]
                if self.leaf[n] >= 0:
                    out[own] = self.leaf[n]
                else:
                    kids = np.array(self.children[n])
                    c = self.centres[kids]
                    node[own] = kids[(-2 * x[own] @ c.T + (c * c).sum(1)).argmin(1)]
                    left.append(own)
            active = np.concatenate(left) if left else np.zeros(0, np.int64)
        return out

    def walk(self, q: np.ndarray):
        """Leaves in best-bin-first order."""
        heap = [(0.0, 0)]
        while heap:
            _, n = heapq.heappop(heap)
            if self.leaf[n] >= 0:
                yield self.leaf[n]
            else:
                kids = self.children[n]
                d = ((self.centres[kids] - q) ** 2).sum(1)
                for k, kid in enumerate(kids):
                    heapq.heappush(heap, (float(d[k]), kid))


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 12):
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    of = None
    for _ in range(rounds):
        new = (-2 * x @ c.T + (c * c).sum(1)).argmin(1)
        if of is not None and (new == of).all():
            break
        of = new
        for j in range(len(c)):
            if (of == j).any():
                c[j] = x[of == j].mean(0)
    return c, of


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == common["n"]) if common else rows


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def nearest(q_ids, q, ids, x, k: int, block: int = 256):
    """(query index, row of the id, distance) of the k nearest ids of each query, ties to the smaller id, never its own id."""
    out = []
    norms = (x * x).sum(1)
    most = int(np.unique(ids, return_counts=True)[1].max()) if len(ids) else 0
    for a in range(0, len(q), block):
        part = q[a : a + block]
        rough = norms - 2 * part @ x.T + (part * part).sum(1)[:, None]
        for r in range(len(part)):
            row = rough[r]
            cut = k + 1  # one more than k, for the query itself
            while True:
                if len(x) > cut:
                    near = np.partition(row, cut - 1)[cut - 1]
                    keep = np.flatnonzero(row <= near + 1e-9 * (1 + abs(near) + norms.max()))
                else:
                    keep = np.arange(len(x))
                keep = keep[ids[keep] != q_ids[a + r]]
                # rows that repeat an id are one: widen until the cut holds k ids
                if len(x) <= cut or most == 1 or len(np.unique(ids[keep])) >= k:
                    break
                cut *= 2
            d = np.sqrt(((x[keep] - part[r]) ** 2).sum(1))
            first = np.lexsort((ids[keep], d))
            keep, d = keep[first], d[first]
            _, unique = np.unique(ids[keep], return_index=True)
            unique = np.sort(unique)[:k]
            out.append((np.full(len(unique), a + r), keep[unique], d[unique]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def brute_force(rows: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score, leaf): exact neighbours of a bounded set of queries over all rows, in blocks."""
    shared = rows.sparkSession.sparkContext.broadcast((q_ids, q))

    def run(batches):
        q_ids, q = shared.value
        for batch in gathered(batches, 2_000_000):
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            leaf = batch.column(2).to_numpy()
            of, near, d = nearest(q_ids, q, ids, x, k)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[of]), pa.array(ids[near]), pa.array(d), pa.array(leaf[near], pa.int32())], names=["query_id", "vec_id", "score", "leaf"])

    found = rows.select("vec_id", "v", "leaf").mapInArrow(run, "query_id long, vec_id long, score double, leaf int")
    return _ranked(found.groupBy("query_id", "vec_id").agg(F.min(F.struct("score", "leaf")).alias("m")).select("query_id", "vec_id", "m.*"), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries, k: int = 10, recall: float = 0.93, sample: int = 20_000, branch: int = 32, leaf_rows: int | None = None, chunk: int = 4096, calibration: int = 96, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, dict]:
    """The k nearest of each query row and what was calibrated; ``queries`` is a predicate over ``vec_id``.

    ``leaf_rows``: rows of a leaf, unset: 0.4 times the root of all rows, 48 at least, so that leaves grow in number and size.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    total = rows.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if total == 0:
        return empty, {"leaves": 0, "visits": 0, "recall": 1.0}
    few = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    points = _matrix(few["v"])
    leaf_rows = leaf_rows or max(48, int(0.4 * total**0.5))
    tree = KMeansTree(points, branch, max(8, int(leaf_rows * len(points) / total)))
    shared = spark.sparkContext.broadcast(tree)

    def assign(batches):
        for batch in gathered(batches, 2_000_000):
            leaf = shared.value.assign(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf.astype(np.int32))], names=["vec_id", "v", "leaf"])

    index = written(rows.mapInArrow(assign, "vec_id long, v array<double>, leaf int"), "ann-index")
    sizes = np.zeros(tree.n_leaves, np.int64)
    for leaf, n in index.groupBy("leaf").count().toLocalIterator():
        sizes[leaf] = n
    # ids count in one leaf each, so that those of several leaves are never fewer than their sum
    n_ids = np.zeros(tree.n_leaves, np.int64)
    for leaf, n in index.groupBy("vec_id").agg(F.min("leaf").alias("leaf")).groupBy("leaf").count().toLocalIterator():
        n_ids[leaf] = n

    asked = index.where(queries)
    some = asked.orderBy(F.xxhash64(F.lit(1), "vec_id"), "vec_id").limit(calibration).toArrow()
    if some.num_rows == 0:
        return empty, {"leaves": tree.n_leaves, "visits": 0, "recall": 1.0}
    q_ids, q = some["vec_id"].to_numpy(), _matrix(some["v"])
    truth = brute_force(index, q_ids, q, k).select("query_id", "leaf").toArrow()
    place = {}
    for i, own in zip(q_ids.tolist(), q, strict=True):
        for n, leaf in enumerate(tree.walk(own)):
            place[i, leaf] = min(n, place.get((i, leaf), n))
    need = np.array([place[a, b] for a, b in zip(truth["query_id"].to_pylist(), truth["leaf"].to_pylist(), strict=True)])
    visits = 1
    while visits < tree.n_leaves and (need < visits).mean() < recall:  # widen
        visits = min(tree.n_leaves, visits + max(1, visits // 16))
    got = float((need < visits).mean()) if len(need) else 1.0

    def visit(batches):
        for batch in gathered(batches, 2_000_000):
            ids, leaves = [], []
            for n, own in enumerate(_matrix(batch.column(1)) if batch.num_rows else []):
                seen = held = 0
                for leaf in shared.value.walk(own):
                    ids.append(n)
                    leaves.append(leaf)
                    seen, held = seen + 1, held + n_ids[leaf]
                    if seen >= visits and held > k:
                        break
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), batch.column(1).take(pa.array(ids, pa.int64())), pa.array(leaves, pa.int32())], names=["query_id", "q", "leaf"])

    visited = written(asked.select("vec_id", "v").mapInArrow(visit, "query_id long, q array<double>, leaf int"), "ann-visits")
    asked_for = {r[0]: r[1] for r in visited.groupBy("leaf").count().toLocalIterator()}
    plan = spark.createDataFrame([(k, int(-(-max(1, sizes[k]) // chunk)), int(-(-asked_for.get(k, 1) // chunk))) for k in range(tree.n_leaves)], "leaf int, n_rows int, n_asked int")
    plan = F.broadcast(plan)
    left = index.join(plan, "leaf").select("leaf", F.pmod(F.xxhash64("vec_id"), "n_rows").cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.col("n_asked") - 1)).alias("s"), "vec_id", "v")
    right = visited.join(plan, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("r"), F.pmod(F.xxhash64("query_id"), "n_asked").cast("int").alias("s"), "query_id", "q")

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if rows.num_rows and asked.num_rows:
            q_ids = asked["query_id"].to_numpy()
            ids = rows["vec_id"].to_numpy()
            of, near, d = nearest(q_ids, _matrix(asked["q"]), ids, _matrix(rows["v"]), k)
            return pa.table({"query_id": pa.array(q_ids[of]), "vec_id": pa.array(ids[near]), "score": pa.array(d)})
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    found = left.groupBy("leaf", "r", "s").cogroup(right.groupBy("leaf", "r", "s")).applyInArrow(meet, "query_id long, vec_id long, score double")
    best = _ranked(found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), {"leaves": tree.n_leaves, "visits": visits, "recall": got}
