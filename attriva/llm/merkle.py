"""Merkle manifest of a dataset: a tree of digests for each source, a tree over the sources, proofs and their checking.

A leaf's place in its tree and the tree's size fix every node's place and arity, so the trees grow by events, in any order:
a parent waits until as many indexed children have come as its arity says, then it becomes an event itself.  Tasks do so for
their own rows first, as a combiner before the exchange; children whose parents stay unfinished are dealt by the ancestor
that ends their band of levels, and so on, band by band.  Every finished parent leaves a link to its children; the links are
followed from the root down, band by band, and give each leaf the siblings on its way.  A block (what lies below one node of
a band) has at most 3**BAND leaves, so neither a hot source nor a large table meets in one task.

Defined cases: null fields are digested as ``-`` (a null doc_id is never tampered with); a null source is a source of its
own, before all others; leaves ascend by doc_id, nulls first, ties by their digest, so repeated rows are interchangeable
and each has its place; an empty text is not null; texts are digested whole, however long; an empty table gives no rows and
has no root.  Further columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lookup, ranked, written

ARITY = 3
#: Levels that one exchange resolves.
BAND = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
EVENTS = "tree string, n long, level int, idx long, kind int, digests array<string>"
LINK, OPEN, ROOT = range(3)


def digest_of(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """sha256 of the fields, each as ``-`` or its byte count, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(x.isNull(), "-").otherwise(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)) for x in texts]), 256)


def leaves_of(docs: DataFrame, tampered: Callable[[Column], Column]) -> DataFrame:
    """(tree, doc_id, leaf, altered): digests of each row and of the row with its text as ``tampered`` leaves it."""
    fields = [F.col(f) for f in FIELDS]
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # a null source comes first
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, tampered(F.col("text").cast("string"))).otherwise(F.col("text").cast("string"))
    return docs.select(key.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(fields).alias("leaf"), leaf_digest([*fields[:-1], altered]).alias("altered"))


def width(n: int, level: int) -> int:
    """Nodes of a level in a tree of ``n`` leaves."""
    return -(-n // ARITY**level)


def height(n: int) -> int:
    level = 0
    while width(n, level) > 1:
        level += 1
    return level


def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events of nodes to links, roots and the nodes whose parents stay unfinished here."""
    waiting: dict[tuple, list] = {}
    out: list[tuple] = []

    def event(tree: str, n: int, level: int, idx: int, digest: str) -> None:
        while (wide := width(n, level)) > 1:
            parent = tree, n, level + 1, idx // ARITY
            slots = waiting.setdefault(parent, [None] * min(ARITY, wide - ARITY * parent[3]))
            slots[idx % ARITY] = digest
            if None in slots:
                return
            del waiting[parent]
            out.append((*parent, LINK, slots))
            digest, level, idx = digest_of(slots), level + 1, parent[3]
        out.append((tree, n, level, 0, ROOT, [digest]))

    def cut() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.string())]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in EVENTS.split(", ")])
        out.clear()
        return batch

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            event(*row)
        yield cut()
    for (tree, n, level, parent), slots in waiting.items():
        out.extend((tree, n, level - 1, parent * ARITY + k, OPEN, [x]) for k, x in enumerate(slots) if x is not None)
    yield cut()


def grow(leaves: DataFrame) -> DataFrame:
    """EVENTS rows of kind LINK and ROOT for (tree, size, rank, leaf): every tree's nodes with their children's digests."""
    first = leaves.select("tree", F.col("size").alias("n"), F.lit(0).alias("level"), F.col("rank").alias("idx"), "leaf")
    got = written(first.mapInArrow(combined, EVENTS), "merkle-events")
    done, waiting, band = got.where(F.col("kind") != OPEN), got.where(F.col("kind") == OPEN), 0
    while not waiting.isEmpty():
        band += 1
        below = waiting.where(F.col("level") < band * BAND)
        block = _ancestor(F.col("idx"), F.col("level"), band)
        events = below.repartition(F.col("tree"), block).select("tree", "n", "level", "idx", F.col("digests")[0].alias("leaf"))
        got = written(events.mapInArrow(combined, EVENTS), "merkle-events")
        done = done.unionByName(got.where(F.col("kind") != OPEN))
        waiting = waiting.where(F.col("level") >= band * BAND).unionByName(got.where(F.col("kind") == OPEN))
    return done


def _ancestor(idx: Column, level: Column, band: int) -> Column:
    """The node at level ``band * BAND`` above (level, idx); levels are at most that."""
    return F.floor(idx / F.element_at(F.array(*[F.lit(ARITY**k) for k in range(BAND, -1, -1)]), level - (band - 1) * BAND + 1)).cast("long")


UP = "up struct<place:long,of:long,subroot:string,root:string>"
PATHS = f"tree string, n long, level int, idx long, path string, {UP}"


def descend(links: DataFrame, tips: DataFrame, leaves: DataFrame, finish: Callable[..., tuple], schema: str) -> DataFrame:
    """``finish(leaf row, path, up)`` of every leaf, the path being its siblings' digests from its level to the root.

    ``links``: EVENTS rows; ``tips``: PATHS rows of the trees' roots, whose path goes on above; ``leaves``: (tree, size,
    rank, ...).  A band's links meet the paths of the nodes at its upper end, block by block.
    """
    most = tips.agg(F.max("level")).first()[0] or 0
    extra = [c for c in leaves.columns if c not in ("tree", "size", "rank")]
    paths = tips
    for band in range(max(1, -(-most // BAND)), 0, -1):
        low, high = (band - 1) * BAND, band * BAND
        inside = (F.col("level") > low) & (F.col("level") <= high)
        own = links.where(inside & (F.col("kind") == LINK)).select("tree", "n", "level", "idx", F.lit(1).alias("kind"), "digests")
        rows = own.unionByName(paths.where(inside if band > 1 else F.col("level") <= high).withColumn("kind", F.lit(0)), allowMissingColumns=True)
        if band == 1:
            rows = rows.unionByName(leaves.select("tree", F.col("size").alias("n"), F.lit(0).alias("level"), F.col("rank").alias("idx"), F.lit(2).alias("kind"), F.struct(*extra).alias("leaf")), allowMissingColumns=True)
        rows = rows.withColumn("block", _ancestor(F.col("idx"), F.col("level"), band)).repartition("tree", "block").sortWithinPartitions("tree", "block", F.desc("level"), "kind", "idx")
        if band == 1:
            return rows.mapInArrow(_followed(low, finish, schema), schema)
        step = written(rows.mapInArrow(_followed(low, None, PATHS), PATHS), "merkle-paths")
        paths = paths.where(F.col("level") <= low).unionByName(step)


def _followed(low: int, finish: Callable[..., tuple] | None, schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        block, known = None, {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (row["tree"], row["block"]) != block:
                    block, known = (row["tree"], row["block"]), {}
                at = row["level"], row["idx"]
                if row["kind"] == 0:
                    known[at] = row["path"], row["up"]
                elif row["kind"] == 1:
                    path, up = known.pop(at)
                    every = row["digests"]
                    for k in range(len(every)):
                        child = at[0] - 1, at[1] * ARITY + k
                        way = "".join(every[:k] + every[k + 1 :]) + path
                        if child[0] > low or finish:
                            known[child] = way, up
                        else:
                            out.append((row["tree"], row["n"], *child, way, up))
                else:
                    out.append(finish(row, *known.pop(at)))
            columns = list(zip(*out, strict=True)) or [()] * len(target)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return run


def fold(digest: str, path: str, *ways: tuple[int, int]) -> str:
    """The root that a leaf and the siblings on its way give; ``ways``: (place, leaves) of each tree that it goes up."""
    at = 0
    for place, n in ways:
        while n > 1:
            more = 64 * (min(ARITY, n - place // ARITY * ARITY) - 1)
            left = at + 64 * (place % ARITY)
            digest = digest_of((path[at:left], digest, path[left : at + more]))
            at, place, n = at + more, place // ARITY, -(-n // ARITY)
    return digest


SOURCES = "tree string, path string, place long, of long, subroot string"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _source_path(row: dict, path: str, up: dict | None) -> tuple:
    return row["leaf"]["name"], path, row["idx"], row["n"], row["leaf"]["leaf"]


def _checked(row: dict, path: str, up: dict) -> tuple:
    own = row["leaf"]
    folded = fold(own["altered"], path, (row["idx"], row["n"]), (up["place"], up["of"]))
    return own["doc_id"], own["leaf"], up["subroot"], up["root"], digest_of((path,)), folded, folded == up["root"]


def _heights(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n``: how often three goes into n - 1."""
    return sum((F.when(n > ARITY**k, 1).otherwise(0) for k in range(1, 40)), F.when(n > 1, 1).otherwise(0))


def verify(docs: DataFrame, tampered: Callable[[Column], Column] = lambda text: F.replace(text, F.lit("\n"), F.lit(""))) -> DataFrame:
    """RESULT for every row: its leaf, the roots, its proof's digest, and the root that the row, tampered with where its
    doc_id says so, gives with its original siblings."""
    leaves = ranked(written(leaves_of(docs, tampered), "merkle-leaves"), ["tree"], ["doc_id", "leaf"], "merkle-ranked")
    nodes = grow(leaves)
    roots = nodes.where(F.col("kind") == ROOT).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("n").alias("leaves"), F.col("digests")[0].alias("leaf"))
    over = ranked(written(roots, "merkle-roots"), ["tree"], ["name"], "merkle-sources")
    above = grow(over)
    top = above.where(F.col("kind") == ROOT).select(F.col("digests")[0]).head()
    root = F.lit(top[0] if top else None).cast("string")
    start = above.where(F.col("kind") == ROOT).select("tree", "n", "level", "idx", F.lit("").alias("path"), F.lit(None).cast(UP.split(" ", 1)[1]).alias("up"))
    ways = written(descend(above, start, over, _source_path, SOURCES), "merkle-ways")
    up = F.struct("place", "of", "subroot", root.alias("root")).cast(UP.split(" ", 1)[1])
    sizes = roots.select(F.col("name").alias("tree"), F.col("leaves").alias("n"))
    tips = ways.join(lookup(sizes), "tree").select("tree", "n", _heights(F.col("n")).cast("int").alias("level"), F.lit(0).cast("long").alias("idx"), "path", up.alias("up"))
    return descend(nodes, tips, leaves, _checked, RESULT)
