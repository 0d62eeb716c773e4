"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` turns documents into index segments: per run of documents the sorted terms, their posting offsets
and positions, as one row.  Positions of different documents lie ``GAP`` apart, so a phrase never crosses documents.
``phrase_hits`` reads the segments once per block of test phrases.  Each phrase is filed under the test term that fewest
phrases hold; a segment looks up these terms, and only phrases of those it has are tried: the postings of the phrase's
rarest term in the segment are shifted by its offset and intersected with those of the next rarest, until none is left.

Defined cases: null or wordless texts have no words and no hits; items without words are no phrases; repeated items
count once; null item ids count as the empty id; rows that repeat a document, or have no doc_id, give a row each, however
many blocks of items there are; texts of any length are searched whole; equal matches (ties) are all reported; extra
columns of any name stay; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import texts, without, written
from .textops import ALNUM_WORDS, gathered, id_column, int64s, words_of

GAP = 1 << 12
SEGMENT_BYTES = 1_000_000
INDEX_SCHEMA = "segment long, doc_ids binary, n_words binary, terms binary, firsts binary, positions binary"


def build_index(docs: DataFrame, table: np.ndarray = ALNUM_WORDS) -> DataFrame:
    """Index segments of ``docs(doc_id, text)``; lower-cased A-Z, words by ``table``."""

    def segments(batches):
        part, k = TaskContext.get().partitionId(), 0
        for batch in gathered(batches, SEGMENT_BYTES * 4 // 5):
            ids = int64s(batch.column(0))
            for i, j, w in words_of(batch.column(1), table, SEGMENT_BYTES, 4096):
                order = np.argsort(w.hash, kind="stable")
                h = w.hash[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = h[1:] != h[:-1]
                firsts = np.append(np.flatnonzero(new), len(h)).astype(np.int32)
                positions = (np.arange(len(h)) + w.doc * GAP)[order].astype(np.int32)
                row = [(part << 32) | k, ids[i:j].tobytes(), w.per_doc().astype(np.int32).tobytes(), h[new].tobytes(), firsts.tobytes(), positions.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:])], names=["segment", "doc_ids", "n_words", "terms", "firsts", "positions"])
                k += 1

    return texts(docs).mapInArrow(segments, INDEX_SCHEMA)


class Segment:
    """One row of the index, opened."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["doc_ids"], np.int64)
        self.n_words = np.frombuffer(row["n_words"], np.int32).astype(np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.firsts = np.frombuffer(row["firsts"], np.int32)
        self.positions = np.frombuffer(row["positions"], np.int32)
        #: position of each document's first word
        self.base = np.concatenate([[0], np.cumsum(self.n_words)[:-1]]) + np.arange(len(self.ids)) * GAP

    def locate(self, vocabulary: np.ndarray) -> np.ndarray:
        """Index of each term of ``vocabulary`` in the segment; -1: absent."""
        if not len(self.terms):
            return np.full(len(vocabulary), -1)
        at = np.minimum(np.searchsorted(self.terms, vocabulary), len(self.terms) - 1)
        return np.where(self.terms[at] == vocabulary, at, -1)

    def postings(self, at: int) -> np.ndarray:
        return self.positions[self.firsts[at] : self.firsts[at + 1]]

    def phrase(self, at: np.ndarray, slop: int = 0) -> np.ndarray:
        """Start positions of the phrase whose k-th term is ``at[k]``; with ``slop``, each term may lie that far off."""
        sizes = self.firsts[at + 1] - self.firsts[at]
        order = np.argsort(sizes, kind="stable")
        found = None
        for k in order:
            here = self.postings(at[k]).astype(np.int64) - int(k)
            if found is None:
                found = here
            else:
                lo = np.searchsorted(here, found - slop)
                found = found[(lo < len(here)) & (here[np.minimum(lo, len(here) - 1)] <= found + slop)]
            if not len(found):
                break
        return found


def _compile(items: list[tuple[str, str]], window: int, table: np.ndarray):
    """A block of items: vocabulary, windows as rows of term indices padded with -1, owner lists, item ids, and the windows
    filed by their anchor, the term that fewest windows hold: (first, window) like the columns of a sparse matrix."""
    terms: dict[int, int] = {}
    windows: dict[tuple[int, ...], set[int]] = {}
    ids = sorted({i for i, _ in items})
    number = {x: k for k, x in enumerate(ids)}
    for i, j, w in words_of(pa.array([t for _, t in items], pa.string()), table):
        ends = np.concatenate([[0], np.cumsum(w.per_doc())])
        for k in range(i, j):
            seq = [terms.setdefault(int(x), len(terms)) for x in w.hash[ends[k - i] : ends[k - i + 1]]]
            for a in range(max(1, len(seq) - window + 1) if seq else 0):
                windows.setdefault(tuple(seq[a : a + window]), set()).add(number[items[k][0]])
    keys = list(windows)
    grid = np.full((len(keys), window), -1, np.int64)
    for r, key in enumerate(keys):
        grid[r, : len(key)] = key
    held = np.bincount(grid[grid >= 0], minlength=len(terms) + 1)
    held[-1] = len(keys) * window + 1  # padding is no anchor
    anchor = np.take_along_axis(grid, held[grid].argmin(axis=1)[:, None], axis=1)[:, 0] if len(keys) else np.zeros(0, np.int64)
    filed = np.argsort(anchor, kind="stable")
    first = np.searchsorted(anchor[filed], np.arange(len(terms) + 1))
    return np.array(list(terms), np.uint64), grid, [sorted(windows[k]) for k in keys], ids, first, filed


def phrase_hits(index: DataFrame, items: list[tuple[str, str]], window: int = 13, table: np.ndarray = ALNUM_WORDS, slop: int = 0) -> DataFrame:
    """Every document, (segment, place) being its key, with n_words, the word positions inside occurring windows, the items
    and (window start, item) matches."""
    if window + slop >= GAP:
        raise ValueError("window is too long for the index")
    shared = index.sparkSession.sparkContext.broadcast(_compile(items, window, table))

    def look(batches):
        vocabulary, grid, owners, ids, first, filed = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row)
                at = np.append(seg.locate(vocabulary), -2)  # the last entry stands for padding
                here = np.flatnonzero(at[:-1] >= 0)
                sizes = first[here + 1] - first[here]
                tried = filed[np.arange(int(sizes.sum())) + np.repeat(first[here] - (np.cumsum(sizes) - sizes), sizes)]
                cells = at[grid[tried]]
                whole = (cells != -1).all(axis=1)
                starts, rows, lengths = [], [], []
                for r, cell in zip(tried[whole], cells[whole], strict=True):
                    use = cell[cell >= 0]
                    got = seg.phrase(use, slop)
                    starts.append(got)
                    rows.append(np.full(len(got), r))
                    lengths.append(np.full(len(got), len(use)))
                start, which, size = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (starts, rows, lengths))
                n = len(seg.ids)
                doc = np.searchsorted(seg.base, start, side="right") - 1
                hits, found, matches = [[] for _ in range(n)], [set() for _ in range(n)], [[] for _ in range(n)]
                order = np.argsort(doc, kind="stable")
                for d, group in ((int(doc[g[0]]), g) for g in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(g)):
                    local = start[group] - seg.base[d]
                    covered = np.zeros(int(seg.n_words[d]) + 1, np.int32)
                    np.add.at(covered, np.clip(local, 0, seg.n_words[d]), 1)
                    np.add.at(covered, np.clip(local + size[group], 0, seg.n_words[d]), -1)
                    hits[d] = np.flatnonzero(np.cumsum(covered[:-1]) > 0).tolist()
                    for p, r in zip(local.tolist(), which[group].tolist(), strict=True):
                        for o in owners[r]:
                            found[d].add(ids[o])
                            matches[d].append({"start": p, "item_id": ids[o]})
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["segment"]] * n, pa.int64()), pa.array(np.arange(n)), id_column(seg.ids), pa.array(seg.n_words), pa.array(hits, pa.list_(pa.int32())), pa.array([sorted(x) for x in found], pa.list_(pa.string())), pa.array(matches, pa.list_(pa.struct([("start", pa.int64()), ("item_id", pa.string())])))],
                    names=["segment", "place", "doc_id", "n_words", "hits", "items", "matches"],
                )

    return index.mapInArrow(look, "segment long, place long, doc_id long, n_words long, hits array<int>, items array<string>, matches array<struct<start:bigint,item_id:string>>")


def _blocks(items: DataFrame, block_bytes: int):
    """Yield the test items in blocks of bounded size, by a hash of their id and text."""
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // block_bytes))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield n, [(r[0], r[1]) for r in part.collect()]


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20, block_bytes: int = 16_000_000) -> DataFrame:
    """One row per document row: n_words, hit word positions, item ids, contaminated (n_hit > 0 and share*n_hit >= n_words).

    Items enter in blocks of ``block_bytes``; every block is matched against the whole index.
    """
    index = written(build_index(docs), "positional-index")
    out, n = None, 1
    for n, block in _blocks(items, block_bytes):
        got = phrase_hits(index, block, window).drop("matches")
        out = got if out is None else out.unionByName(got)
    if n > 1:
        # a row of each block for every document row
        out = out.groupBy("segment", "place", "doc_id", "n_words").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hit = F.size("hits").cast("long")
    return out.select("doc_id", "n_words", "hits", "items", hit.alias("n_hit"), ((hit > 0) & (F.lit(share) * hit >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = contamination(docs, items, window, share).where("contaminated").select("doc_id").distinct()
    return without(docs, written(bad, "contaminated", gather=True))
