"""N-gram Jaccard self-join by vertical partitioning.

The global order of n-gram hashes is cut into fragments.  (1) In each fragment the n-grams that several documents
hold are found and counted per document (those that a run of documents shares are counted before they are sent); summed over fragments they bound every possible overlap, so documents
of which too few n-grams are shared have no partner and leave.  (2) The rest, one per distinct set, get prefixes
in ascending document frequency (again per fragment); documents that share a prefix n-gram are candidates.
(3) For candidate pairs the partial overlaps are counted per fragment and summed per pair: exact.

Groups of copies are never expanded into all pairs: identical sets count once; the members of a prefix group are
first compared with the most central member; only prefix groups that then still hold several components are
compared across components, with length and position filters.  So components are exact.

Defined cases: no words, empty or null text: empty set, linked with nothing; fewer words than n: the whole
sequence is one n-gram; a null doc_id takes no part; rows that repeat a doc_id are further texts of it, and it is
linked where any of them is; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, lookup, texts, without, written
from .textops import SPACE_WORDS, U64, gathered, give_back, int64s, text_bytes, words_of

PACKED = "piece long, frag int, ids binary, docs binary, grams binary"
COUNTED = PACKED + ", twice binary, total binary, known binary"


def _bits(docs: DataFrame, per_fragment: int = 8_000_000) -> int:
    """log2 of the number of fragments: about ``per_fragment`` bytes of text to each."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return min(16, max(3, math.ceil(math.log2(max(1, int(total)) / per_fragment + 1))))


def _low40(column) -> np.ndarray:
    raw = text_bytes(column)[0].reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view(U64).ravel()


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def packed_fragments(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """Per run of documents and fragment one row of 40 low hash bits of n-grams, distinct by document, and their documents;
    fragments that hold none of a run's have no row, but the first, which has the run's doc_ids and numbers of n-grams.

    N-grams that several documents of the run hold are known to be shared: they are counted here, in ``known``, and sent
    once, in ``twice``.  So an n-gram that very many documents hold costs one entry per run, not one per document.
    """
    doc_bits = 24 - bits
    gram_bits = U64(40)

    def cut(batches):
        part, k = TaskContext.get().partitionId(), 0
        for batch in gathered(batches, 640_000):
            ids = int64s(batch.column(0))
            for i, j, w in words_of(batch.column(1), SPACE_WORDS, 800_000, 1 << min(16, doc_bits)):
                m = j - i
                s, d, _ = w.ngrams(n)
                # fragment, hash and document in one number, sorted: equal n-grams stand together
                key = np.unique(((s >> U64(64 - bits)) << U64(64 - bits)) | ((s & U64((1 << 40) - 1)) << U64(doc_bits)) | d.astype(U64))
                gram = key >> U64(doc_bits)
                doc = (key & U64((1 << doc_bits) - 1)).astype(np.int64)
                same = np.zeros(len(key) + 1, bool)
                same[1:-1] = gram[1:] == gram[:-1]
                several = same[1:] | same[:-1]
                lead = several & ~same[:-1]
                known = np.bincount(doc[several], minlength=m).astype(np.uint32)
                total = np.bincount(doc, minlength=m).astype(np.uint32)
                frag = (gram >> gram_bits).astype(np.int64)
                low = np.ascontiguousarray(gram).view(np.uint8).reshape(-1, 8)[:, :5]
                alone = np.flatnonzero(~several)
                marks = np.arange((1 << bits) + 1)
                one, two = np.searchsorted(frag[alone], marks), np.searchsorted(frag[lead], marks)
                grams, again, doc = low[alone], low[lead], doc[alone].astype(np.uint16)
                rows = [f for f in range(1 << bits) if f == 0 or one[f + 1] > one[f] or two[f + 1] > two[f]]
                head = lambda x: pa.array([x.tobytes() if f == 0 else None for f in rows], pa.binary())  # noqa: B023, E731
                cut_at = lambda x, at: pa.array([x[at[f] : at[f + 1]].tobytes() for f in rows], pa.binary())  # noqa: B023, E731
                yield _batch(
                    piece=pa.array([(part << 32) | k] * len(rows), pa.int64()), frag=pa.array(rows, pa.int32()), ids=head(ids[i:j]), docs=cut_at(doc, one), grams=cut_at(grams, one),
                    twice=cut_at(again, two), total=head(total), known=head(known),
                )
                k += 1

    return docs.select("doc_id", "text").mapInArrow(cut, COUNTED)


def shared_counts(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """(doc_id, n_grams, n_shared): distinct n-grams of a document, and how many of them another document holds."""

    def fragment(table: pa.Table) -> pa.Table:
        grams, known = _low40(table["grams"]), _low40(table["twice"])
        ordered = np.sort(grams)
        shared = np.unique(np.concatenate([ordered[1:][ordered[1:] == ordered[:-1]], known]))
        at = np.minimum(np.searchsorted(shared, grams), max(0, len(shared) - 1))
        flag = (shared[at] == grams) if len(shared) else np.zeros(len(grams), bool)
        ends = text_bytes(table["grams"])[1] // 5
        own, counts = [], []
        for docs, a, b in zip(table["docs"], ends[:-1], ends[1:], strict=True):
            d, c = np.unique(np.frombuffer(docs.as_py(), np.uint16)[flag[a:b]], return_counts=True)
            own.append(d.tobytes())
            counts.append(c.astype(np.uint32).tobytes())
        out = pa.table({"piece": table["piece"], "ids": table["ids"], "total": table["total"], "known": table["known"], "docs": pa.array(own, pa.binary()), "shared": pa.array(counts, pa.binary())})
        out = out.filter(pc.or_(pc.is_valid(out["ids"]), pc.greater(pc.binary_length(out["docs"]), 0)))
        del table, grams, ordered, shared, at, flag
        give_back()
        return out

    def collect(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["ids"] is not None)
        ids, total, known = (np.frombuffer(head[c], kind).astype(np.int64) for c, kind in (("ids", np.int64), ("total", np.uint32), ("known", np.uint32)))
        shared = known.copy()
        for r in rows:
            shared[np.frombuffer(r["docs"], np.uint16)] += np.frombuffer(r["shared"], np.uint32)
        return pa.table({"doc_id": pa.array(ids), "n_grams": pa.array(total), "n_shared": pa.array(shared)})

    cut = packed_fragments(docs, n, bits)
    # as many tasks as fragments, whatever the session's default: what a task fetches and sorts stays bounded
    partial = cut.repartition(1 << bits, "frag").groupBy("frag").applyInArrow(fragment, "piece long, ids binary, total binary, known binary, docs binary, shared binary")
    return partial.groupBy("piece").applyInArrow(collect, "doc_id long, n_grams long, n_shared long")


def _sets(docs: DataFrame, n: int, seg_bits: int) -> DataFrame:
    """(doc_id, n_grams, sig, segs): exact 64-bit sets cut into 2**seg_bits fragments."""

    def exact(batches):
        for batch in gathered(batches, 800_000):
            ids = int64s(batch.column(0))
            for i, j, w in words_of(batch.column(1), SPACE_WORDS, 1_000_000):
                s, d, _ = w.ngrams(n)
                order = np.lexsort((s, d))
                s, d = s[order], d[order]
                keep = np.ones(len(s), bool)
                keep[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
                s, d = s[keep], d[keep]
                ends = np.cumsum(np.bincount(d, minlength=j - i))
                own = [s[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]
                marks = np.arange(1, 1 << seg_bits, dtype=U64) << U64(64 - seg_bits)
                yield _batch(
                    doc_id=pa.array(ids[i:j]),
                    n_grams=pa.array([len(x) for x in own], pa.int64()),
                    sig=pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in own], pa.binary()),
                    segs=pa.array([[p.view(np.int64) for p in np.split(x, np.searchsorted(x, marks))] for x in own], pa.list_(pa.list_(pa.int64()))),
                )

    return docs.select("doc_id", "text").mapInArrow(exact, "doc_id long, n_grams long, sig binary, segs array<array<bigint>>")


def _prefixes(sets: DataFrame, percent: int, bits: int) -> DataFrame:
    """(rep, n, rare, token, pos): the prefix of each set in ascending document frequency, without unshared n-grams."""
    doc_bits = 24 - bits

    def cut(batches):
        part, k = TaskContext.get().partitionId(), 0
        for batch in gathered(batches, 2_000_000):
            ids = int64s(batch.column(0))
            lists = batch.column(1)
            for i in range(0, len(ids), min(1 << doc_bits, 512)):
                j = min(len(ids), i + min(1 << doc_bits, 512))
                part_lists = lists.slice(i, j - i)
                inner = part_lists.flatten()
                per_seg = np.diff(np.concatenate([[0], np.cumsum(np.array(inner.value_lengths().to_numpy(zero_copy_only=False), np.int64))]))
                s = inner.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
                d = np.repeat(np.repeat(np.arange(j - i), part_lists.value_lengths().to_numpy(zero_copy_only=False)), per_seg)
                frag = (s >> U64(64 - bits)).astype(np.int64)
                order = np.lexsort((d, frag))
                s, d, frag = s[order], d[order].astype(np.uint16), frag[order]
                edges = np.append(np.searchsorted(frag, np.arange(1 << bits)), len(s))
                low = np.ascontiguousarray(s).view(np.uint8).reshape(-1, 8)[:, :5]
                rows = [(f, a, b) for f, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if f == 0 or b > a]
                yield _batch(
                    piece=pa.array([(part << 32) | k] * len(rows), pa.int64()),
                    frag=pa.array([f for f, _, _ in rows], pa.int32()),
                    ids=pa.array([ids[i:j].tobytes() if f == 0 else None for f, _, _ in rows], pa.binary()),
                    docs=pa.array([d[a:b].tobytes() for _, a, b in rows], pa.binary()),
                    grams=pa.array([low[a:b].tobytes() for _, a, b in rows], pa.binary()),
                )
                k += 1

    def frequency(table: pa.Table) -> pa.Table:
        grams = _low40(table["grams"])
        values, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
        df = np.minimum(counts[inverse], 2**31 - 1).astype(np.uint32) if len(grams) else np.zeros(0, np.uint32)
        cuts = (text_bytes(table["grams"])[1] // 5)[1:-1]
        return table.append_column("df", pa.array([x.tobytes() for x in np.split(df, cuts)], pa.binary()))

    def choose(table: pa.Table) -> pa.Table:
        ids, doc, token, df = None, [], [], []
        for r in table.to_pylist():
            ids = np.frombuffer(r["ids"], np.int64) if r["ids"] is not None else ids
            doc.append(np.frombuffer(r["docs"], np.uint16).astype(np.int64))
            token.append(_low40(pa.array([r["grams"]], pa.binary())) | (U64(r["frag"]) << U64(40)))
            df.append(np.frombuffer(r["df"], np.uint32))
        doc, token, df = np.concatenate(doc), np.concatenate(token), np.concatenate(df)
        order = np.lexsort((token, df, doc))
        doc, token, df = doc[order], token[order], df[order]
        n = np.bincount(doc, minlength=len(ids))
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        pos = np.arange(len(doc)) - first[doc]
        rare = np.bincount(doc[df == 1], minlength=len(ids))
        length = n - -(-percent * n // 100) + 1
        keep = (pos < length[doc]) & (df > 1)
        doc = doc[keep]
        return pa.table({"rep": pa.array(ids[doc]), "n": pa.array(n[doc]), "rare": pa.array(rare[doc]), "token": pa.array(token[keep].astype(np.int64)), "pos": pa.array(pos[keep])})

    packed = sets.select("rep", "segs").mapInArrow(cut, PACKED)
    counted = packed.repartition(1 << bits, "frag").groupBy("frag").applyInArrow(frequency, PACKED + ", df binary")
    return counted.groupBy("piece").applyInArrow(choose, "rep long, n long, rare long, token long, pos long")


def _verified(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) that link: partial overlaps counted per fragment, summed per pair."""
    left = segments.select(F.col("rep").alias("a"), "frag", F.col("seg").alias("seg_a"))
    right = segments.select(F.col("rep").alias("b"), "frag", F.col("seg").alias("seg_b"))
    partial = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), ["b", "frag"]).select("a", "b", "na", "nb", F.size(F.array_intersect("seg_a", "seg_b")).alias("common"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    return total.where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b", "common", "na", "nb")


def _pair(x: str, y: str):
    one, two = F.struct(F.col(f"{x}.rep"), F.col(f"{x}.n")), F.struct(F.col(f"{y}.rep"), F.col(f"{y}.n"))
    low, high = F.least(one, two), F.greatest(one, two)
    return [low["rep"].alias("a"), high["rep"].alias("b"), low["n"].alias("na"), high["n"].alias("nb")]


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, seg_bits: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each distinct doc_id; component_id: smallest doc_id reachable by links."""
    docs = texts(docs).where("doc_id is not null")
    bits = _bits(docs)
    counts = written(shared_counts(docs, n, bits), "jaccard-counts", gather=True)
    hopeful = counts.where((F.col("n_grams") > 0) & (F.lit(100) * F.col("n_shared") >= F.lit(percent) * F.col("n_grams"))).select("doc_id").distinct()
    sets = written(_sets(docs.join(lookup(hopeful), "doc_id", "left_semi"), n, seg_bits).where("n_grams > 0"), "jaccard-sets", gather=True)
    members = sets.select("doc_id", "sig", "n_grams").distinct()
    reps = members.groupBy("sig").agg(F.min("doc_id").alias("rep"))
    # rows of a representative may repeat, and one doc_id may stand for several sets: a node of its own for each set
    nodes = reps
    heads = nodes.select(F.col("sig").alias("s2"), F.col("rep").alias("r2"))
    node_sets = written(sets.join(heads, (sets.sig == heads.s2) & (sets.doc_id == heads.r2)).select(F.xxhash64("sig").alias("rep"), "doc_id", "n_grams", "segs").dropDuplicates(["rep"]), "jaccard-reps")
    prefix = written(_prefixes(node_sets.select("rep", "segs"), percent, max(3, bits - 2)), "jaccard-prefix", gather=True)
    segments = node_sets.select("rep", F.posexplode("segs").alias("frag", "seg")).where(F.size("seg") > 0)

    near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    hub = prefix.groupBy("token").agg(F.min(F.struct((F.col("rare") / F.col("n")).alias("share"), F.col("rep"), F.col("n"))).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1").select("token", F.col("hub.rep").alias("rep"), F.col("hub.n").alias("n"))
    first = prefix.alias("x").join(hub.alias("y"), "token").where("x.rep <> y.rep").select(*_pair("x", "y")).where(near).distinct()
    links = written(_verified(first, segments, percent), "jaccard-links", gather=True)
    label = components(links)

    now = prefix.join(label.select(F.col("node").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    mixed = now.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.mode("comp", True).alias("main")).where("lo <> hi").select("token", "main")
    left = now.join(mixed, "token")
    need = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100.0 + percent) - 1e-9)
    room = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    cross = (
        left.where("comp <> main").alias("x").join(now.alias("y"), "token").where("x.comp <> y.comp")
        .select(*_pair("x", "y"), room.alias("room")).where(near & (F.col("room") >= need)).drop("room").distinct()
    )
    more = written(_verified(cross, segments, percent), "jaccard-cross", gather=True)
    if not more.isEmpty():
        label = components(more.select("a", "b"), start=label)

    owner = node_sets.select("rep", F.col("doc_id").alias("own"))
    smallest = label.join(owner, label.node == owner.rep).groupBy("comp").agg(F.min("own").alias("low"))
    of_node = label.join(smallest, "comp").select(F.col("node").alias("rep"), "low")
    of_set = nodes.select(F.xxhash64("sig").alias("rep"), "sig", F.col("rep").alias("own")).join(of_node, "rep", "left").select("sig", F.coalesce(F.least("low", "own"), "own").alias("low"))
    of_doc = members.join(of_set, "sig").groupBy("doc_id").agg(F.min("low").alias("low"))
    size = counts.groupBy("doc_id").agg(F.max("n_grams").alias("n_shingles"))
    return size.join(of_doc, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("low", "doc_id").alias("component_id"))


def keep_one_per_group(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id; rows with null doc_id stay too."""
    gone = jaccard_components(docs, n, percent).where("component_id <> doc_id").select("doc_id")
    return without(docs, written(gone, "jaccard-gone", gather=True))
