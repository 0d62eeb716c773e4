"""Language-model scoring by context-tree weighting over bytes.

Each byte is decomposed into eight binary decisions.  For every context of 0 to ``DEPTH`` preceding bytes, and every
node of the byte's binary tree, a Krichevsky-Trofimov estimator counts zeros and ones over all training bytes; the
estimates of all depths are mixed with the exact tree weights (one half for stopping at a node, one half for going
deeper).  The mixed predictive distribution gives each text's code length.  A text ends with the byte 0xFF, which UTF-8
never uses and which also stands before its first byte, so texts are lower-cased (A-Z) byte strings of a proper model.

Beside it a word unigram score with add-0.5 smoothing: word counts are exact over all training texts.  The few
frequent words (each at least a ``HOT``-th of all tokens, so their number is bounded) are looked up in place; the
other words meet in hash fragments and send back one partial sum per document.

Counts of all contexts are kept.  The ``max_contexts`` most frequent full contexts have rows in a scoring table that is
broadcast; bytes after another context meet its counts in fragments, as the other words do, with the same predictions.

Defined cases: a null or empty text is the end token alone; every row gives a row, repeated or not; rows of null id
count as id text '' in the split; without training rows all counts are 0 and the byte model is uniform; an empty
table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_mod, texts, written
from .textops import LOWER, SPACE_WORDS, U64, Words, gathered, id_column, int64s, mix, pieces, text_bytes

DEPTH = 3
END = 0xFF
HOT = 200_000
END_TOKEN = np.uint64(0x0123456789ABCDEF)
_LN2 = math.log(2)
_cache: dict = {}


def _with_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with END after every text, and the new offsets."""
    n = len(offsets) - 1
    out = np.full(len(data) + n, END, np.uint8)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    out[np.arange(len(data)) + doc] = LOWER[data]
    return out, offsets + np.arange(n + 1)


def codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One code per byte and end: previous byte, the one before, the one before that, then the byte; all 8 bits."""
    b, offs = _with_ends(data, offsets)
    x = b.astype(np.uint32)
    since = np.arange(len(b)) - np.repeat(offs[:-1], np.diff(offs))
    code = x.copy()
    for k in range(1, DEPTH + 1):
        prev = np.full(len(b), END, np.uint32)
        prev[k:] = x[:-k]
        prev[since < k] = END
        code |= prev << np.uint32(8 * (DEPTH + 1 - k))
    return code


def count_training(docs: DataFrame, held_out_rest: int = 1) -> DataFrame:
    """(kind, key, n): byte-gram counts (kind 0) and word counts (kind 1) over all training texts."""

    def run(batches):
        grams, words, room = [], [], 0

        def merged(parts):
            keys = np.concatenate([k for k, _ in parts])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], np.concatenate([c for _, c in parts])[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            return keys[first], np.add.reduceat(counts, first) if len(first) else counts

        def flush():
            for kind, parts in ((0, grams), (1, words)):
                if parts:
                    keys, counts = merged(parts)
                    for a in range(0, len(keys), 100_000):
                        k = keys[a : a + 100_000].astype(U64).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(counts[a : a + 100_000])], names=["kind", "key", "n"])
                    parts.clear()

        for batch in gathered(batches, 800_000):
            data, offsets = text_bytes(batch.column(0))
            for i, j in pieces(offsets, 1_000_000):
                part, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                grams.append(tuple(np.unique(codes(part, offs), return_counts=True)))
                w = Words(part, offs, SPACE_WORDS)
                keys, counts = np.unique(w.hash, return_counts=True)
                words.append((np.append(keys, END_TOKEN), np.append(counts, j - i)))
                room += len(keys) + len(grams[-1][0])
                if room > 2_000_000:  # merge what this task has seen
                    for parts in (grams, words):
                        parts[:] = [merged(parts)]
                    room = len(grams[0][0]) + len(words[0][0])
                    if room > 1_500_000:
                        yield from flush()
                        room = 0
        yield from flush()

    rows = texts(docs).where(crc_mod("doc_id", 5) != held_out_rest).select("text").mapInArrow(run, "kind int, key long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


# ---- the weighted tree ----


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for positive x: recurrence up to 8, then Stirling's series."""
    x = x.astype(np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        if not low.any():
            break
        shift[low] += np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z / 1260)) / y - shift


def _nodes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(zeros, ones) of the 255 binary nodes of each row of byte counts."""
    zero, one = [], []
    for level in range(8):
        halves = counts.reshape(len(counts), 1 << level, 2, 128 >> level).sum(3)
        zero.append(halves[:, :, 0])
        one.append(halves[:, :, 1])
    return np.concatenate(zero, 1), np.concatenate(one, 1)


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the KT probability of a zeros and b ones in any order."""
    out = np.zeros(a.shape)
    some = (a + b) > 0
    x, y = a[some], b[some]
    out[some] = _lgamma(x + 0.5) + _lgamma(y + 0.5) - _lgamma(x + y + 1) - math.log(math.pi)
    return out


def _byte_logs(p_one: np.ndarray) -> np.ndarray:
    """log10 probability of each byte from the 255 nodes' chance of a one."""
    byte = np.arange(256)
    total = np.zeros((len(p_one), 256))
    with np.errstate(divide="ignore"):
        up, down = np.log10(p_one), np.log10(1 - p_one)
    for level in range(8):
        node = (1 << level) - 1 + (byte >> (8 - level))
        bit = (byte >> (7 - level)) & 1
        total += np.where(bit, up[:, node], down[:, node])
    return total


def _pairs(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts of depth 2, their byte counts, summed log weights of the contexts below each) from sorted grams."""
    keys = keys.astype(np.uint32)
    deep, row = np.unique(keys >> np.uint32(8), return_inverse=True)
    two, of_two = np.unique(deep >> np.uint32(8), return_inverse=True)
    below, c2 = np.zeros((len(two), 255)), np.zeros((len(two), 256))
    first = np.searchsorted(row, np.arange(len(deep) + 1))
    for a in range(0, len(deep), 4096):
        b = min(len(deep), a + 4096)
        c = Tree._dense(row, (keys & np.uint32(255)).astype(np.int64), counts, first, a, b)
        zero, ones = _nodes(c)
        np.add.at(below, of_two[a:b], _log_kt(zero, ones))
        np.add.at(c2, of_two[a:b], c)
    return two, c2, below


class Tree:
    """Scoring table of the weighted tree: rows of log10 byte probabilities and the row of each context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, max_contexts: int, pairs=None):
        """keys: byte-gram codes, sorted; counts: of them; pairs: what ``_pairs`` gives for all grams, if these are not all."""
        keys = keys.astype(np.uint32)
        ctx, byte = keys >> np.uint32(8), (keys & np.uint32(255)).astype(np.int64)
        # a context of depth d is the leading 8*d bits of the 24; all levels' statistics, deepest first
        deep, row = np.unique(ctx, return_inverse=True)
        first = np.searchsorted(row, np.arange(len(deep) + 1))
        two, c2, below = _pairs(keys, counts) if pairs is None else pairs
        of_two = np.searchsorted(two, deep >> np.uint32(8))
        one, of_one = np.unique(two >> np.uint32(8), return_inverse=True)
        kt2, beta2, w2 = self._level(c2, below)
        c1, s1 = np.zeros((len(one), 256)), np.zeros((len(one), 255))
        np.add.at(c1, of_one, c2)
        np.add.at(s1, of_one, w2)
        kt1, beta1, w1 = self._level(c1, s1)
        kt0, beta0, _ = self._level(c1.sum(0, keepdims=True), w1.sum(0, keepdims=True))
        self.upper = one, kt0, beta0, kt1, beta1
        top = self._top

        size = np.bincount(row, counts, len(deep)) if len(deep) else np.zeros(0)
        keep = np.sort(np.argsort(-size, kind="stable")[:max_contexts])
        table = [_byte_logs(beta0 * kt0 + (1 - beta0) * 0.5).astype(np.float32)]
        if len(one):
            table.append(_byte_logs(beta0 * kt0 + (1 - beta0) * (beta1 * kt1 + (1 - beta1) * 0.5)).astype(np.float32))
        for a in range(0, len(two), 4096):
            b = min(len(two), a + 4096)
            table.append(_byte_logs(top(beta2[a:b] * kt2[a:b] + (1 - beta2[a:b]) * 0.5, of_one[a:b])).astype(np.float32))
        for a in range(0, len(keep), 4096):
            own = keep[a : a + 4096]
            c = np.concatenate([self._dense(row, byte, counts, first, k, k + 1) for k in own]) if len(own) != own[-1] - own[0] + 1 else self._dense(row, byte, counts, first, own[0], own[-1] + 1)
            zero, ones = _nodes(c)
            j = of_two[own]
            table.append(_byte_logs(top(beta2[j] * kt2[j] + (1 - beta2[j]) * (ones + 0.5) / (zero + ones + 1), of_one[j])).astype(np.float32))
        self.table = np.concatenate(table)
        self.one, self.two, self.deep = one, two, deep[keep]

    def _top(self, p2: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Mix upwards from predictions at depth 2 of contexts below ``one[j]``."""
        _, kt0, beta0, kt1, beta1 = self.upper
        return beta0 * kt0 + (1 - beta0) * (beta1[j] * kt1[j] + (1 - beta1[j]) * p2)

    def logs(self, code: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probability of each code; keys, counts: all grams, sorted, of the codes' contexts of depth 2."""
        asked, which = np.unique(code, return_inverse=True)
        two, c2, below = _pairs(keys, counts)
        kt2, beta2, _ = self._level(c2, below)
        ctx, row = np.unique(asked >> np.uint32(8), return_inverse=True)
        deep, of = np.unique(keys >> np.uint32(8), return_inverse=True)
        first = np.searchsorted(of, np.arange(len(deep) + 1))
        out = np.zeros(len(asked))
        edges = np.searchsorted(row, np.arange(len(ctx) + 1))
        for a in range(0, len(ctx), 1024):
            own = ctx[a : a + 1024]
            c = np.zeros((len(own), 256))
            at = np.minimum(np.searchsorted(deep, own), len(deep) - 1)
            for k in np.flatnonzero(deep[at] == own).tolist():
                lo, hi = first[at[k]], first[at[k] + 1]
                c[k, keys[lo:hi] & np.uint32(255)] = counts[lo:hi]
            zero, ones = _nodes(c)
            j = np.searchsorted(two, own >> np.uint32(8))
            p2 = beta2[j] * kt2[j] + (1 - beta2[j]) * (ones + 0.5) / (zero + ones + 1)
            table = _byte_logs(self._top(p2, np.searchsorted(self.one, own >> np.uint32(16))))
            lo, hi = edges[a], edges[a + len(own)]
            out[lo:hi] = table[row[lo:hi] - a, asked[lo:hi] & np.uint32(255)]
        return out[which]

    @staticmethod
    def _dense(row, byte, counts, first, a, b):
        lo, hi = first[a], first[b]
        c = np.zeros((b - a, 256))
        c[row[lo:hi] - a, byte[lo:hi]] = counts[lo:hi]
        return c

    @staticmethod
    def _level(counts: np.ndarray, below: np.ndarray):
        """(chance of a one, weight of stopping, log weighted probability) of each node of a depth."""
        zero, ones = _nodes(counts)
        own = _log_kt(zero, ones)
        weighted = np.logaddexp(own, below) - _LN2
        return (ones + 0.5) / (zero + ones + 1), np.exp(own - _LN2 - weighted), weighted

    def rows(self) -> np.ndarray:
        """Row of the table for each of the 2**24 contexts of three bytes."""
        at = np.zeros(1 << 24, np.int32)
        at.reshape(256, -1)[self.one] = (1 + np.arange(len(self.one)))[:, None]
        at.reshape(65536, -1)[self.two] = (1 + len(self.one) + np.arange(len(self.two)))[:, None]
        at[self.deep] = 1 + len(self.one) + len(self.two) + np.arange(len(self.deep))
        return at


def _scorer(shared):
    """The model of this worker, with its context rows laid out once."""
    key = id(shared.value)
    if _cache.get("key") != key:
        _cache.clear()
        _cache.update(key=key, model=shared.value, rows=shared.value["tree"].rows())
    return _cache["model"], _cache["rows"]


def _gram_fragment(code: np.ndarray, bits: int) -> np.ndarray:
    """By the context of depth 2, so that all grams of one meet."""
    return (mix(code >> np.uint32(16)) >> U64(64 - bits)).astype(np.int64)


def _packed_grams(grams: DataFrame, bits: int) -> DataFrame:
    """(gram_frag, keys, ns): grams with their counts, packed by fragment."""

    def pack(batches):
        for batch in gathered(batches, 8_000_000):
            key, n = batch.column(0).to_numpy().astype(np.uint32), batch.column(1).to_numpy()
            frag = _gram_fragment(key, bits)
            order = np.argsort(frag, kind="stable")
            key, n = key[order], n[order]
            edges = np.append(np.searchsorted(frag[order], np.arange(1 << bits)), len(key))
            use = [(f, a, b) for f, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _, _ in use], pa.int32()), pa.array([key[a:b].tobytes() for _, a, b in use], pa.binary()), pa.array([n[a:b].tobytes() for _, a, b in use], pa.binary())], names=["gram_frag", "keys", "ns"])

    return grams.select("key", "n").mapInArrow(pack, "gram_frag int, keys binary, ns binary")


def _unpacked(keys, ns) -> tuple[np.ndarray, np.ndarray]:
    keys, n = text_bytes(keys)[0].view(np.uint32), text_bytes(ns)[0].view(np.int64).astype(np.float64)
    order = np.argsort(keys)
    return keys[order], n[order]


def _levels(table: pa.Table) -> pa.Table:
    two, c2, below = _pairs(*_unpacked(table["keys"], table["ns"]))
    return pa.table({"two": pa.array(two.astype(np.int64)), "c2": pa.array([x.tobytes() for x in c2], pa.binary()), "below": pa.array([x.tobytes() for x in below], pa.binary())})


def train(docs: DataFrame, max_contexts: int = 1 << 16, held_out_rest: int = 1) -> dict:
    """Counts over all training texts; tree table, frequent words, N and V for the driver, all of bounded size."""
    counted = written(count_training(docs, held_out_rest), "lm-counts")
    words, grams = counted.where("kind = 1"), counted.where("kind = 0")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    hot = words.where(F.col("n") * HOT >= int(total)).select("key", "n").toArrow()
    deep = grams.groupBy(F.shiftright("key", 8).alias("ctx")).agg(F.sum("n").alias("size"))
    pairs = packed = bits = None
    if deep.count() > max_contexts:
        # the driver gets the grams of the most frequent full contexts, and sums over all contexts at depth 2
        bits = min(12, max(3, math.ceil(math.log2(grams.count() / 250_000 + 1))))
        packed = written(_packed_grams(grams, bits), "lm-grams")
        levels = packed.groupBy("gram_frag").applyInArrow(_levels, "two long, c2 binary, below binary").toArrow()
        two = levels["two"].to_numpy()
        order = np.argsort(two)
        c2, below = (text_bytes(levels[k])[0].view(np.float64).reshape(len(two), -1)[order] for k in ("c2", "below"))
        pairs = two[order].astype(np.uint32), c2, below
        kept = deep.orderBy(F.desc("size"), "ctx").limit(max_contexts).select("ctx")
        grams = grams.join(F.broadcast(kept), F.shiftright("key", 8) == F.col("ctx"), "left_semi")
    rows = grams.select("key", "n").toArrow()
    keys, counts = rows["key"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(keys)
    tree = Tree(keys[order], counts[order].astype(np.float64), max_contexts, pairs)
    words_hot, counts_hot = hot["key"].to_numpy().view(U64), hot["n"].to_numpy()
    order = np.argsort(words_hot)
    return {"tree": tree, "hot": words_hot[order], "hot_n": counts_hot[order].astype(np.float64), "N": int(total), "V": int(distinct), "grams": packed, "gram_bits": bits}


def score(docs: DataFrame, model: dict, held_out_rest: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row."""
    frame = texts(docs)
    spark = docs.sparkSession
    grams, gram_bits = model["grams"], model["gram_bits"]
    shared = spark.sparkContext.broadcast({k: v for k, v in model.items() if k != "grams"})
    total = frame.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(12, max(3, math.ceil(math.log2(int(total) / 16_000_000 + 1))))
    schema = "piece long, frag int, docs binary, counts binary, words binary"

    def cut(batches):
        part, k = TaskContext.get().partitionId(), 0
        for batch in gathered(batches, 800_000):
            model, rows = _scorer(shared)
            table, hot, hot_n = model["tree"].table.ravel(), model["hot"], model["hot_n"]
            data, offsets = text_bytes(batch.column(1))
            ids, out_of = int64s(batch.column(0)), batch.column(2).to_numpy(zero_copy_only=False)
            for i, j in pieces(offsets, 1_000_000, 65_000):
                part_data, offs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                n = j - i
                code = codes(part_data, offs)
                of = rows[code >> np.uint32(8)]
                logs = table[of.astype(np.int64) * 256 + (code & np.uint32(255))].astype(np.float64)
                ends = offs[1:] + np.arange(1, n + 1)
                if gram_bits is not None:  # contexts without a row below those of depth 2 that have one
                    rare = np.flatnonzero((of > len(model["tree"].one)) & (of <= len(model["tree"].one) + len(model["tree"].two)))
                    logs[rare] = 0
                byte_score = np.add.reduceat(logs, np.concatenate([[0], ends[:-1]])) if n else np.zeros(0)
                w = Words(part_data, offs, SPACE_WORDS)
                h, d = np.append(w.hash, np.full(n, END_TOKEN)), np.append(w.doc, np.arange(n))
                at = np.minimum(np.searchsorted(hot, h), max(0, len(hot) - 1))
                is_hot = hot[at] == h if len(hot) else np.zeros(len(h), bool)
                known = np.bincount(d[is_hot], minlength=n)
                base = np.bincount(d[is_hot], np.log10(hot_n[at[is_hot]] + 0.5), n)
                head = np.rec.fromarrays([ids[i:j], out_of[i:j].astype(np.int8), np.bincount(d, minlength=n), known, base, byte_score, np.diff(offs)], names="id,out,n,known,base,score,bytes")
                h, d = h[~is_hot], d[~is_hot]
                frag = (h >> U64(64 - bits)).astype(np.int64)
                order = np.argsort(frag * n + d, kind="stable")
                h, d, frag = h[order], d[order], frag[order]
                edges = np.append(np.searchsorted(frag, np.arange(1 << bits)), len(h))
                use = [(f, a, b) for f, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if f == 0 or b > a]
                flags = out_of[i:j].astype(np.uint32) << np.uint32(31)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([(part << 32) | k] * len(use), pa.int64()),
                        pa.array([f for f, _, _ in use], pa.int32()),
                        pa.array([head.tobytes() if f == 0 else None for f, _, _ in use], pa.binary()),
                        pa.array([(np.bincount(d[a:b], minlength=n).astype(np.uint32) | flags).tobytes() for _, a, b in use], pa.binary()),
                        pa.array([h[a:b].tobytes() for _, a, b in use], pa.binary()),
                    ],
                    names=["piece", "frag", "docs", "counts", "words"],
                )
                if gram_bits is not None and len(rare):
                    d, code = np.searchsorted(ends, rare, side="right"), code[rare]
                    frag = _gram_fragment(code, gram_bits)
                    order = np.argsort(frag, kind="stable")  # documents stay in order
                    d, code, frag = d[order], code[order], frag[order]
                    edges = np.append(np.searchsorted(frag, np.arange(1 << gram_bits)), len(code))
                    use = [(f, a, b) for f, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([(part << 32) | k] * len(use), pa.int64()), pa.array([-1 - f for f, _, _ in use], pa.int32()), pa.array([None] * len(use), pa.binary()),
                            pa.array([d[a:b].astype(np.uint32).tobytes() for _, a, b in use], pa.binary()), pa.array([code[a:b].tobytes() for _, a, b in use], pa.binary()),
                        ],
                        names=["piece", "frag", "docs", "counts", "words"],
                    )
                k += 1

    def byte_fragment(table: pa.Table) -> pa.Table:
        """Scores of bytes after contexts that have no row: (document, score) of each piece, packed; grams have no piece."""
        is_gram = pc.is_null(table["piece"])
        held, asked = table.filter(is_gram), table.filter(pc.invert(is_gram))
        if not asked.num_rows:
            return out_of([], [], [], [], [])
        logs = shared.value["tree"].logs(text_bytes(asked["words"])[0].view(np.uint32), *_unpacked(held["words"], held["counts"]))
        docs, scores = [], []
        pos = 0
        for raw in asked["counts"]:
            d, inverse = np.unique(np.frombuffer(raw.as_py(), np.uint32), return_inverse=True)
            docs.append(d.tobytes())
            scores.append(np.bincount(inverse, logs[pos : pos + len(inverse)]).tobytes())
            pos += len(inverse)
        return out_of(asked["piece"], [None] * len(docs), scores, [None] * len(docs), docs)

    def out_of(piece, docs, base, known, rare) -> pa.Table:
        return pa.table({"piece": piece if isinstance(piece, pa.ChunkedArray) else pa.array(piece, pa.int64()), "docs": docs if isinstance(docs, pa.ChunkedArray) else pa.array(docs, pa.binary()), "base": pa.array(base, pa.binary()), "known": pa.array(known, pa.binary()), "rare": pa.array(rare, pa.binary())})

    def fragment(table: pa.Table) -> pa.Table:
        if table["frag"][0].as_py() < 0:
            return byte_fragment(table)
        rows = table.to_pylist()
        h = np.frombuffer(b"".join(r["words"] or b"" for r in rows), U64)
        raw = [np.frombuffer(r["counts"], np.uint32) for r in rows]
        counts = [(c & np.uint32(0x7FFFFFFF)).astype(np.int64) for c in raw]
        trains = np.concatenate([np.repeat(c >> np.uint32(31) == 0, m) for c, m in zip(raw, counts, strict=True)]) if rows else np.zeros(0, bool)
        _, inverse = np.unique(h, return_inverse=True)
        c = np.bincount(inverse, trains.astype(np.float64))[inverse] if len(h) else np.zeros(0)
        logs = np.concatenate([[0], np.cumsum(np.log10(c + 0.5))])
        known = np.concatenate([[0], np.cumsum(c > 0)])
        out_log, out_known, pos = [], [], 0
        for m in counts:
            ends = pos + np.cumsum(m)
            starts = ends - m
            out_log.append((logs[ends] - logs[starts]).tobytes())
            out_known.append((known[ends] - known[starts]).astype(np.int64).tobytes())
            pos = int(ends[-1]) if len(ends) else pos
        return out_of(table["piece"], table["docs"], out_log, out_known, [None] * len(rows))

    record = np.dtype([("id", np.int64), ("out", np.int8), ("n", np.int64), ("known", np.int64), ("base", np.float64), ("score", np.float64), ("bytes", np.int64)])
    n_train, unit = model["N"], math.log10(model["N"] + 0.5 * (model["V"] + 1))

    def collect(table: pa.Table) -> pa.Table:
        head, base, known = None, 0, 0
        rows = table.to_pylist()
        for r in rows:
            if r["rare"] is not None:
                continue
            head = np.frombuffer(r["docs"], record) if r["docs"] is not None else head
            base = base + np.frombuffer(r["base"], np.float64)
            known = known + np.frombuffer(r["known"], np.int64)
        base = base + head["base"] - head["n"] * unit
        score = head["score"].copy()
        for r in rows:
            if r["rare"] is not None:
                score[np.frombuffer(r["rare"], np.uint32)] += np.frombuffer(r["base"], np.float64)
        return pa.table({
            "doc_id": id_column(head["id"]), "held_out": pa.array(head["out"].astype(bool)), "n_tokens": pa.array(head["n"]), "n_known": pa.array(known + head["known"]),
            "train_tokens": pa.array(np.full(len(head), n_train)), "base_score": pa.array(base), "score": pa.array(score), "n_bytes": pa.array(head["bytes"]),
            "bits_per_byte": pa.array(-score / math.log10(2) / (head["bytes"] + 1)),
        })

    packed = frame.withColumn("out", crc_mod("doc_id", 5) == held_out_rest).mapInArrow(cut, schema)
    if grams is not None:
        packed = packed.unionByName(grams.select(F.lit(None).cast("long").alias("piece"), (F.lit(-1) - F.col("gram_frag")).cast("int").alias("frag"), F.lit(None).cast("binary").alias("docs"), F.col("ns").alias("counts"), F.col("keys").alias("words")))
    partial = packed.groupBy("frag").applyInArrow(fragment, "piece long, docs binary, base binary, known binary, rare binary")
    return partial.groupBy("piece").applyInArrow(collect, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double").hint("rebalance")
