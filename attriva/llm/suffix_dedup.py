"""Removal of repeated byte strings with a suffix array built by linear grouping.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (smaller doc_id, or same document, earlier
start).  Every window of ``length`` bytes has an anchor, its smallest k-gram hash (leftmost of equals); equal windows have
equal anchors at equal offsets, so only occurrences of one anchor key can hold equal windows.  Neighbouring windows with
one anchor position form an occurrence; its bytes are a string of at most 2 * length bytes.

1. Per run of documents occurrences are cut into hash fragments (occurrences of equal strings meet once per run).  In a
   fragment occurrences of equal strings form a class; all but the first lose all their windows.
2. For keys with several classes the first occurrence's bytes are fetched.  Strings are cut down to what some other
   class of the key can share, and equal ones merged.
3. The strings left are sorted by a suffix array: groups of suffixes with a common Lyndon prefix are processed in descending
   order, previous-smaller pointers name the suffixes to be split off, and a last pass emits each group's order.  Neighbours
   that agree in ``length`` bytes are equal windows; all but the earliest occurrence lose them.

Defined cases: null and empty texts have no bytes; texts shorter than ``length`` lose nothing; null doc_ids count as smaller
than all others; rows that repeat doc_id and text are one document and treated alike; of rows that repeat a doc_id with
other texts each is judged as its own text, and equal positions are not earlier; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import texts, written
from .textops import U64, _BASE, _BASE_INV, _power_table, gathered, id_column, int64s, mix, pieces, text_bytes

GRAM = 48
POSITION_BITS = 24
SEGMENT = 1 << 22
#: Random byte values of two independent polynomial hashes, from fixed seeds.
_BYTES = [np.random.default_rng(s).integers(1, 2**63, 256, dtype=np.int64).astype(U64) for s in (71, 72)]
OCCURRENCE = np.dtype([("key", "<u8"), ("string", "<u8"), ("doc", "<u2"), ("at", "<u4"), ("off", "u1"), ("run", "u1")])
RANGE = np.dtype([("doc", "<u2"), ("a", "<u4"), ("b", "<u4")])


# ---- the suffix array ----


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``symbols`` (integers of 1 or more; a smallest end symbol is added and left out again)."""
    text = np.append(symbols.astype(np.int64), 0)
    n = len(text)
    order = np.argsort(text, kind="stable")
    ordered = text[order]
    first = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
    start_of = np.empty(n, np.int64)
    start_of[order] = np.repeat(first, np.diff(np.append(first, n)))
    members, group = order.tolist(), start_of.tolist()  # suffixes by group; where a suffix's group begins
    slot = np.empty(n, np.int64)
    slot[order] = np.arange(n)
    slot = slot.tolist()
    stop = [0] * (n + 1)  # where the group that begins here ends
    for a, b in zip(first.tolist(), [*first[1:].tolist(), n], strict=True):
        stop[a] = b
    left = list(range(-1, n))  # left[i + 1]: nearest suffix at or before i whose group is not processed
    smaller = [-1] * n
    high = n
    while high > 0:
        low = group[members[high - 1]]
        if high - low == 1:
            s = members[low]
            left[s + 1] = s - 1
            p = s - 1
            while left[p + 1] != p:
                p = left[p + 1]
            q = s
            while q != p and q >= 0:  # shorten the path
                q, left[q + 1] = left[q + 1], p
            smaller[s] = p
            if p >= 0:
                g = group[p]
                end = stop[g] - 1
                if end != g:
                    x, y = members[end], slot[p]
                    members[y], slot[x] = x, y
                    members[end], slot[p] = p, end
                    stop[end], stop[g] = end + 1, end
                    group[p] = end
            high = low
            continue
        own = members[low:high]
        for s in own:
            left[s + 1] = s - 1
        times = defaultdict(int)
        for s in own:
            p = s - 1
            while left[p + 1] != p:
                p = left[p + 1]
            q = s
            while q != p and q >= 0:
                q, left[q + 1] = left[q + 1], p
            smaller[s] = p
            if p >= 0:
                times[p] += 1
        if times:
            levels = defaultdict(list)
            for p, t in times.items():
                levels[t].append(p)
            for t in sorted(levels, reverse=True):
                moved = defaultdict(int)
                for p in levels[t]:
                    g = group[p]
                    moved[g] += 1
                    end = stop[g] - moved[g]
                    x, y = members[end], slot[p]
                    members[y], slot[x] = x, y
                    members[end], slot[p] = p, end
                for g, k in moved.items():
                    new = stop[g] - k
                    if new != g:
                        stop[new], stop[g] = stop[g], new
                        for p in members[new : new + k]:
                            group[p] = new
        high = low
    out = [-1] * n
    out[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    free = list(range(n))
    for k in range(n):
        e = out[k] - 1
        while e >= 0 and not placed[e]:
            g = group[e]
            out[free[g]] = e
            free[g] += 1
            placed[e] = 1
            e = smaller[e]
    return np.array(out[1:], np.int64)


def equal_windows(strings: list[bytes], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Groups of equal windows of ``length`` bytes, as (string index, offset) pairs of arrays, from the suffix array."""
    out = []
    text = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 2
    sizes = np.array([len(x) for x in strings])
    ends = np.cumsum(sizes + 1)
    joined = np.ones(int(ends[-1]), np.int64)
    keep = np.ones(len(joined), bool)
    keep[ends - 1] = False
    joined[keep] = text
    order = suffix_array(joined)
    owner = np.searchsorted(ends, order, side="right")
    off = order - (ends - sizes - 1)[owner]
    whole = off + length <= sizes[owner]
    order, owner, off = order[whole], owner[whole], off[whole]
    if not len(order):
        return out
    same = np.zeros(len(order), bool)
    for a in range(1, len(order), 8192):
        i = np.arange(a, min(len(order), a + 8192))
        reach = np.arange(length)
        same[i] = (joined[order[i][:, None] + reach] == joined[order[i - 1][:, None] + reach]).all(1)
    cuts = np.flatnonzero(~same)
    for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        out.append((owner[a:b], off[a:b]))
    return out


# ---- anchors ----


def _sums(data: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, U64)
        np.cumsum(_BYTES[which][data] * _power_table("up", _BASE, n + 1)[:n], out=sums[1:])
    return sums, _power_table("down", _BASE_INV, n + 1)


def occurrences(data: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM):
    """(key, string hash, document, anchor, first window, last window) of every anchor of a run of documents."""
    n = len(data)
    if n < length:
        return None
    width = length - gram + 1
    with np.errstate(over="ignore"):
        sums, inverse = _sums(data, 0)
        m = n - gram + 1
        h = mix((sums[gram:] - sums[:m]) * inverse[:m])
        low = U64((1 << POSITION_BITS) - 1)
        best, have = (h & ~low) | np.arange(m, dtype=U64), 1
        while have * 2 <= width:
            best = np.minimum(best[:-have], best[have:])
            have *= 2
        if width > have:
            best = np.minimum(best[: len(best) - (width - have)], best[width - have :])
        at = (best & low).astype(np.int64)
        p = np.arange(len(at))
        doc = np.searchsorted(offsets, p, side="right") - 1
        ok = p + length <= offsets[doc + 1]
        p, at, doc = p[ok], at[ok], doc[ok]
        if not len(p):
            return None
        new = np.ones(len(p), bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        i = np.flatnonzero(new)
        j = np.append(i[1:], len(p)) - 1
        a, b, c = p[i], p[j], at[i]
        sums, _ = _sums(data, 1)
        string = mix((sums[b + length] - sums[a]) * inverse[a] + (b - a).astype(U64) * U64(0x9E3779B97F4A7C15) + (c - a).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    return mix(h[c]), string, doc[i], c, a, b  # minima are small: spread them over the fragments


def _run_occurrences(data, offsets, length):
    """As ``occurrences`` with positions inside documents; a very long document is cut into overlapping segments."""
    if len(data) <= SEGMENT:
        got = occurrences(data, offsets, length)
        if got is None:
            return None
        key, string, doc, c, a, b = got
        return key, string, doc, c - offsets[doc], a - offsets[doc], b - offsets[doc]
    parts = []
    for begin in range(0, len(data) - length + 1, SEGMENT):  # windows that start in [begin, begin + SEGMENT)
        part = data[begin : begin + SEGMENT + length - 1]
        got = occurrences(part, np.array([0, len(part)]), length)
        if got is not None:
            key, string, doc, c, a, b = got
            parts.append((key, string, doc, c + begin, a + begin, b + begin))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else None


def _merge(ranges: np.ndarray) -> np.ndarray:
    """Union of half-open intervals, sorted."""
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    top = np.maximum.accumulate(ranges[:, 1])
    new = np.ones(len(ranges), bool)
    new[1:] = ranges[1:, 0] > top[:-1]
    i = np.flatnonzero(new)
    return np.stack([ranges[i, 0], top[np.append(i[1:], len(ranges)) - 1]], 1)


def removed_ranges(docs: DataFrame, length: int = 100, per_fragment: int = 24_000_000, most_classes: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(documents with packed bytes, (uid, ranges)): the byte ranges that go, merged, of every document that has any.

    Keys of more than ``most_classes`` classes never meet in one group: their windows are compared by a 128-bit hash, in
    keyed aggregates that combine before the exchange.
    """
    frame = texts(docs)
    total = frame.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(12, max(6, math.ceil(math.log2(int(total) / per_fragment + 1))))
    frame = frame.withColumn("uid", F.xxhash64("doc_id", "text"))

    def cut(batches):
        part, k = TaskContext.get().partitionId(), 0
        for batch in gathered(batches, 1_200_000):
            data, offsets = text_bytes(batch.column(1))
            ids, uids = int64s(batch.column(0)), int64s(batch.column(2))
            for i, j in pieces(offsets, 1_500_000, 60_000):
                got = _run_occurrences(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length)
                if got is None:
                    continue
                key, string, doc, c, a, b = got
                order = np.lexsort((c, ids[i:j][doc], string, key))
                key, string, doc, c, a, b = (x[order] for x in (key, string, doc, c, a, b))
                later = np.zeros(len(key), bool)
                later[1:] = (key[1:] == key[:-1]) & (string[1:] == string[:-1])
                lead = np.maximum.accumulate(np.where(later, 0, np.arange(len(key))))
                same = (ids[i:j][doc] == ids[i:j][doc[lead]]) & (c == c[lead])  # repeated rows stand at one place
                gone = later & ~same
                local = np.zeros(int(gone.sum()), RANGE)
                local["doc"], local["a"], local["b"] = doc[gone], a[gone], b[gone] + length
                keep = ~gone
                key, string, doc, c, a, b = (x[keep] for x in (key, string, doc, c, a, b))
                rec = np.zeros(len(key), OCCURRENCE)
                rec["key"], rec["string"], rec["doc"], rec["at"], rec["off"], rec["run"] = key, string, doc, c, c - a, b - a
                edges = np.append(np.searchsorted(key, np.arange(1 << bits, dtype=U64) << U64(64 - bits)), len(key))
                rows = [(f, x, y) for f, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if y > x or f == 0]
                m = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([(part << 32) | k] * m, pa.int64()), pa.array([f for f, _, _ in rows], pa.int32()),
                        pa.array([ids[i:j].tobytes()] * m, pa.binary()), pa.array([uids[i:j].tobytes()] * m, pa.binary()),
                        pa.array([rec[x:y].tobytes() for _, x, y in rows], pa.binary()), pa.array([local.tobytes() if f == 0 else None for f, _, _ in rows], pa.binary()),
                    ],
                    names=["piece", "frag", "ids", "uids", "found", "ranges"],
                )
                k += 1

    def classes(table: pa.Table) -> pa.Table:
        raw, at = text_bytes(table["found"])
        rec = raw.view(OCCURRENCE)
        own = np.repeat(np.arange(table.num_rows), np.diff(at) // OCCURRENCE.itemsize)
        documents, first = {}, {}
        for name in ("ids", "uids"):
            raw, at = text_bytes(table[name])
            documents[name], first[name] = raw.view(np.int64), at[:-1] // 8
        ids = documents["ids"][first["ids"][own] + rec["doc"]]
        uids = documents["uids"][first["uids"][own] + rec["doc"]]
        order = np.argsort(rec["key"], kind="stable")
        key = rec["key"][order]
        twin = np.zeros(len(key), bool)
        twin[1:] |= key[1:] == key[:-1]
        twin[:-1] |= key[1:] == key[:-1]
        order = order[twin]
        rec, own, ids, uids = rec[order], own[order], ids[order], uids[order]
        order = np.lexsort((rec["at"], ids, rec["string"], rec["key"]))
        rec, own, ids, uids = rec[order], own[order], ids[order], uids[order]
        n = len(rec)
        new_key, new = np.ones(n, bool), np.ones(n, bool)
        new_key[1:] = rec["key"][1:] != rec["key"][:-1]
        new[1:] = new_key[1:] | (rec["string"][1:] != rec["string"][:-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, np.int64)
        gone = ~new & ~((ids == ids[lead]) & (rec["at"] == rec["at"][lead]))
        of_key = np.cumsum(new_key) - 1
        n_classes = np.bincount(of_key[new], minlength=int(of_key[-1]) + 1 if n else 0)[of_key]
        ask = new & (n_classes > 1)
        where = np.flatnonzero(gone)
        where = where[np.argsort(own[where], kind="stable")]
        edges = np.searchsorted(own[where], np.arange(table.num_rows + 1))
        pieces_, ranges, known = [], [], []
        for k in range(table.num_rows):
            x = rec[where[edges[k] : edges[k + 1]]]
            r = np.zeros(len(x), RANGE)
            r["doc"], r["a"], r["b"] = x["doc"], x["at"] - x["off"], x["at"] - x["off"].astype(np.int64) + x["run"] + length
            blob = r.tobytes() + (table["ranges"][k].as_py() or b"")
            if blob:
                pieces_.append(table["piece"][k].as_py())
                ranges.append(blob)
                known.append(table["uids"][k].as_py())
        p, q = len(pieces_), int(ask.sum())
        x = rec[ask]
        gap = lambda size: pa.nulls(size, pa.int64())
        return pa.table({
            "piece": pa.chunked_array([pa.array(pieces_, pa.int64()), gap(q)]), "uids": pa.chunked_array([pa.array(known, pa.binary()), pa.nulls(q, pa.binary())]), "ranges": pa.chunked_array([pa.array(ranges, pa.binary()), pa.nulls(q, pa.binary())]),
            "uid": pa.chunked_array([gap(p), pa.array(uids[ask])]), "doc_id": pa.chunked_array([gap(p), pa.array(ids[ask])]), "key": pa.chunked_array([gap(p), pa.array(x["key"].view(np.int64) if q else np.zeros(0, np.int64))]),
            "at": pa.chunked_array([gap(p), pa.array(x["at"].astype(np.int64))]), "off": pa.chunked_array([gap(p), pa.array(x["off"].astype(np.int64))]), "run": pa.chunked_array([gap(p), pa.array(x["run"].astype(np.int64))]), "n_classes": pa.chunked_array([gap(p), pa.array(n_classes[ask].astype(np.int64))]),
        })

    packed = frame.mapInArrow(cut, "piece long, frag int, ids binary, uids binary, found binary, ranges binary")
    step = written(packed.groupBy("frag").applyInArrow(classes, "piece long, uids binary, ranges binary, uid long, doc_id long, key long, at long, off long, run long, n_classes long"), "suffix-classes", gather=True)

    def pack(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([press.compress(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], names=["doc_id", "uid", "z"])

    press = frame.mapInArrow(pack, "doc_id long, uid long, z binary")

    # the bytes of each class's first occurrence
    asked = step.where(f"piece is null and n_classes <= {most_classes}").groupBy("uid").agg(F.collect_list(F.struct("doc_id", "key", "at", "off", "run")).alias("asked"))

    def fetch(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in range(batch.num_rows):
                text = open_.decompress(batch.column(1)[row].as_py())
                a = batch.column(2)[row].values
                doc, key, at, off, run = (a.field(x) for x in ("doc_id", "key", "at", "off", "run"))
                start = (at.to_numpy() - off.to_numpy()).tolist()
                own = [text[s : s + r + length] for s, r in zip(start, run.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[row], len(own)), doc, key, at, off, pa.array(own, pa.binary())], names=["uid", "doc_id", "key", "at", "off", "s"])

    strings = press.select("uid", "z").join(asked, "uid").mapInArrow(fetch, "uid long, doc_id long, key long, at long, off long, s binary")

    def compare(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["at"].to_numpy(), table["doc_id"].to_numpy(), table["key"].to_numpy()))
        key, ids, at, off, uid = (table[x].to_numpy()[order] for x in ("key", "doc_id", "at", "off", "uid"))
        text = table["s"].take(pa.array(order)).to_pylist()
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        out_uid, out_a, out_b = [], [], []
        block, size = [], 0

        def flush():
            nonlocal block, size
            if block:
                for index, offset in equal_windows([x[0] for x in block], length):
                    first = min(block[i][2][0] for i in index.tolist())
                    for i, o in zip(index.tolist(), offset.tolist(), strict=True):
                        _, shift, members = block[i]
                        for d, c, row in members:
                            if (d, c) > first:
                                out_uid.append(int(uid[row]))
                                out_a.append(int(at[row] - off[row]) + shift[row] + o)
                                out_b.append(int(at[row] - off[row]) + shift[row] + o + length)
            block, size = [], 0

        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = _cut_down(text[a:b], off[a:b].tolist(), length)
            merged: dict[tuple[bytes, int], list] = defaultdict(list)
            shift: dict[int, int] = {}
            for r, (lo, hi) in own:
                merged[text[a + r][lo:hi], int(off[a + r]) - lo].append((int(ids[a + r]), int(at[a + r]), a + r))
                shift[a + r] = lo
            new = [(s, shift, sorted(m)) for (s, _), m in merged.items()]
            block += new
            size += sum(len(x[0]) for x in new)
            if size >= 1 << 15:
                flush()
        flush()
        return pa.table({"uid": pa.array(out_uid, pa.int64()), "a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    buckets = 1 << bits + 2
    pairs = strings.groupBy(F.pmod("key", F.lit(buckets)).alias("bucket")).applyInArrow(compare, "uid long, a long, b long")

    def windows(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in range(batch.num_rows):
                text = open_.decompress(batch.column(1)[row].as_py())
                a = batch.column(2)[row].values
                doc, begin, run = (a.field(x).to_pylist() for x in ("doc_id", "begin", "run"))
                own = [(i, p) for i, b, r in zip(doc, begin, run, strict=True) for p in range(b, b + r + 1)]
                for k in range(0, len(own), 4096):
                    part = own[k : k + 4096]
                    h = pa.array([hashlib.blake2b(text[p : p + length], digest_size=16).digest() for _, p in part], pa.binary())
                    yield pa.RecordBatch.from_arrays([h, pa.repeat(batch.column(0)[row], len(part)), pa.array([i for i, _ in part], pa.int64()), pa.array([p for _, p in part], pa.int64())], names=["h", "uid", "doc_id", "a"])

    crowded = step.where(f"piece is null and n_classes > {most_classes}")
    if not crowded.isEmpty():
        wanted = crowded.groupBy("uid").agg(F.collect_list(F.struct("doc_id", (F.col("at") - F.col("off")).alias("begin"), "run")).alias("asked"))
        each = written(press.select("uid", "z").join(wanted, "uid").mapInArrow(windows, "h binary, uid long, doc_id long, a long"), "suffix-windows", gather=True)
        first = each.groupBy("h").agg(F.min(F.struct("doc_id", "a")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "first")
        later = each.join(first, "h").where(F.struct("doc_id", "a") > F.col("first"))
        pairs = pairs.unionByName(later.select("uid", "a", (F.col("a") + length).alias("b")))

    def spread(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                uids = np.frombuffer(batch.column(0)[row].as_py(), np.int64)
                r = np.frombuffer(batch.column(1)[row].as_py(), RANGE)
                r = r[np.argsort(r["doc"], kind="stable")]
                edges = np.searchsorted(r["doc"], np.arange(len(uids) + 1))
                use = [d for d in range(len(uids)) if edges[d + 1] > edges[d]]
                own = [_merge(np.stack([r["a"][edges[d] : edges[d + 1]], r["b"][edges[d] : edges[d + 1]]], 1).astype(np.int64)) for d in use]
                yield pa.RecordBatch.from_arrays([pa.array(uids[use]), pa.array([x.astype(np.uint32).tobytes() for x in own], pa.binary())], names=["uid", "ranges"])

    one = step.where("piece is not null").select("uids", "ranges").mapInArrow(spread, "uid long, ranges binary")
    two = pairs.groupBy("uid").agg(F.collect_list(F.struct("a", "b")).alias("ab"))

    def tight(batches):
        for batch in batches:
            own = []
            for row in range(batch.num_rows):
                v = batch.column(1)[row].values
                own.append(_merge(np.stack([v.field("a").to_numpy(), v.field("b").to_numpy()], 1)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["uid", "ranges"])

    two = two.mapInArrow(tight, "uid long, ranges binary")
    ranges = one.unionByName(two).groupBy("uid").agg(F.collect_list("ranges").alias("ranges"))
    return press, ranges


def _cut_down(strings: list[bytes], off: list[int], length: int) -> list[tuple[int, tuple[int, int]]]:
    """(index, (from, to)) of the strings that can share a window with another one: what lies within the longest match to
    the left and to the right of the anchor with any other string."""
    n = len(strings)
    reach = [[0] * n, [0] * n]
    for side, part in enumerate(([s[:o][::-1] for s, o in zip(strings, off, strict=True)], [s[o:] for s, o in zip(strings, off, strict=True)])):
        order = sorted(range(n), key=part.__getitem__)
        for x, y in zip(order[:-1], order[1:], strict=True):
            p, q = part[x], part[y]
            m = min(len(p), len(q))
            if p[:m] != q[:m]:
                lo, hi = 0, m  # first difference by halving
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    if p[lo:mid] == q[lo:mid]:
                        lo = mid
                    else:
                        hi = mid
                m = lo
            if m > reach[side][x]:
                reach[side][x] = m
            if m > reach[side][y]:
                reach[side][y] = m
    return [(k, (off[k] - reach[0][k], off[k] + reach[1][k])) for k in range(n) if reach[0][k] + reach[1][k] >= length]


def dedup(docs: DataFrame, length: int = 100, most_classes: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, kept, spans array<struct<start,end>>) of every row; kept: the remaining bytes."""
    press, ranges = removed_ranges(docs, length, most_classes=most_classes)

    def finish(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            size, kept, spans = [], [], []
            for row in range(batch.num_rows):
                text = open_.decompress(batch.column(1)[row].as_py())
                r = batch.column(2)[row].as_py()
                size.append(len(text))
                if not r:
                    kept.append(text)
                    spans.append([])
                    continue
                own = _merge(np.concatenate([np.frombuffer(x, np.uint32).reshape(-1, 2).astype(np.int64) for x in r]))
                mask = np.zeros(len(text) + 1, np.int32)
                mask[own[:, 0]] += 1
                mask[own[:, 1]] -= 1
                kept.append(np.frombuffer(text, np.uint8)[np.cumsum(mask[:-1]) == 0].tobytes())
                spans.append([{"start": a, "end": b} for a, b in own.tolist()])
            yield pa.RecordBatch.from_arrays([id_column(int64s(batch.column(0))), pa.array(size, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "n_bytes", "kept", "spans"])

    return press.join(ranges, "uid", "left").select("doc_id", "z", "ranges").mapInArrow(finish, "doc_id long, n_bytes long, kept binary, spans array<struct<start:bigint,end:bigint>>")


def digests(out: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")).hint("rebalance")


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
