"""Byte-level BPE encoding and decoding.

Each match of the split pattern is a word.  A word is an array of entries, one per symbol: the symbol's id and the rank of
the pair it makes with the next one.  Spark higher-order functions fold the merges over that array: ``aggregate`` takes the
entry of lowest rank, leftmost first, merges it with the next and looks up the ranks of the two new pairs, until no pair has
a rank.  Ranks come from one literal, a perfect hash table of pairs of ids, so a lookup takes constant time.  Only distinct
words are folded: the corpus' frequent words (a dictionary of bounded size) once, the other words once per stretch of a
task's documents with up to ``RARE_WORDS`` of them.  A word that is itself a token needs no fold.  Words of more than
``LONG`` bytes would take quadratic time in the fold; for these the same merges are made with a heap.

A run of about 1 MB of text becomes one row with its word numbers and the words that are new in it; the fold turns these
words into ids in the same row.  One exchange hands a task's rows, in their order, to a task that concatenates the ids and
pieces of each document's words: so no task needs two Python workers beside the fold.

Defined cases: a null or empty text has no tokens and decodes to nothing; every row gives a row, repeated or not; texts of
any length are encoded whole; extra columns take no part; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import texts, written
from .textops import gathered, give_back, id_column, int64s, pieces, text_bytes

LONG = 160
HOT_WORDS = 1 << 18
RARE_WORDS = 1 << 18
_SHIFT = 20
_MASK = (1 << _SHIFT) - 1
_NONE = _MASK
_ANY_LENGTH = "2147483632b"  # Spark's default of spark.sql.maxPlanStringLength
#: The code points of Unicode's White_Space.
_WHITE = r"\t-\r \x85\xa0  -     　"
#: The split pattern for which ``word_bounds`` needs no pattern matching.
_CLASSIC = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file; ``path`` is on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def split_pattern(pattern: str):
    r"""The compiled pattern, with ``\s`` meaning Unicode's White_Space as in the public library."""
    import regex

    out, inside, k = [], False, 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two == r"\s":
            out.append(_WHITE if inside else f"[{_WHITE}]")
        elif two == r"\S":
            out.append(f"[^{_WHITE}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            k -= 1
        k += 2
    return regex.compile("".join(out))


_classes: dict[str, np.ndarray] = {}


def _letter_classes() -> np.ndarray:
    """For each code point: 1 letter, 2 number, 3 white space, 0 other."""
    if "all" not in _classes:
        import regex

        points = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        out = np.zeros(0x110000, np.uint8)
        for kind, what in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, f"[{_WHITE}]+")):
            for m in regex.finditer(what, points):
                out[ord(points[m.start()]) : ord(points[m.end() - 1]) + 1] = kind
        out[0xD800:0xE000] = 0
        _classes["all"] = out
    return _classes["all"]


def _classic_starts(points: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """First places of the words of texts laid end to end, by the classic pattern; ``edge``: a text starts here.

    Words are runs of letters, numbers, white space or other characters.  The last character of white space before a word
    stands alone, or, if it is a blank, goes to that word; a lone apostrophe takes the letters of a contraction.
    """
    n = len(points)
    kind = _letter_classes()[points]
    first = edge[:n].copy()
    first[1:] |= kind[1:] != kind[:-1]
    white = kind == 3
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~edge[1:n])
    first[last] = True
    first[last[points[last] == 0x20] + 1] = False
    quote = np.flatnonzero((points == 0x27) & first)
    if len(quote):
        far, ends = np.concatenate([points, np.zeros(2, points.dtype)]), np.concatenate([edge, [True, True]])
        x = np.where(ends[quote + 1], 0, far[quote + 1])
        y = np.where(ends[quote + 1] | ends[quote + 2], 0, far[quote + 2])
        r, v, e, ll = ord("r"), ord("v"), ord("e"), ord("l")
        one = np.isin(x, [ord(c) for c in "sdmt"])
        two = ((x == r) | (x == v)) & (y == e) | (x == ll) & (y == ll)
        for at, size in ((quote[one], 2), (quote[two], 3)):
            first[at + 1] = False
            behind = at + size
            first[behind[behind < n]] = True
    return np.flatnonzero(first)


def word_bounds(run: list[str], pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points of the texts laid end to end, first and end place of each match of ``pattern``, matches of each text)."""
    points = np.frombuffer("".join(run).encode("utf-32-le"), np.uint32)
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, run), np.int64, len(run)))])
    if pattern == _CLASSIC:
        edge = np.zeros(len(points) + 1, bool)
        edge[ends] = True
        start = _classic_starts(points, edge) if len(points) else np.zeros(0, np.int64)
        return points, start, np.append(start[1:], len(points))[: len(start)], np.diff(np.searchsorted(start, ends))
    find, spans, counts = split_pattern(pattern).finditer, [], []
    for own, at in zip(run, ends.tolist(), strict=False):
        found = [(at + m.start(), at + m.end()) for m in find(own) if m.end() > m.start()]
        spans += found
        counts.append(len(found))
    both = np.array(spans, np.int64).reshape(-1, 2)
    return points, both[:, 0], both[:, 1], np.array(counts, np.int64)


def distinct_words(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(distinct words in the order of their first places, place of each word in that list).

    The words are cut out of the text's own bytes, where they stand one behind the other, and told apart there.
    """
    if not len(start):
        return [], np.zeros(0, np.int64)
    if not np.array_equal(start[1:], end[:-1]):  # gaps between the words
        size = end - start
        points = points[np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)]
        end = np.cumsum(size)
        start = end - size
    raw = points[start[0] : end[-1]].tobytes().decode("utf-32-le").encode()
    at = np.append(start, end[-1]) - start[0]
    if len(raw) > at[-1]:  # other places in bytes than in characters
        own = points[start[0] : end[-1]]
        width = (own > 0x7F).astype(np.int8) + (own > 0x7FF) + (own > 0xFFFF) + np.int8(1)
        at = np.concatenate([[0], np.cumsum(width, dtype=np.int32)])[at]
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)).dictionary_encode()
    return words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()


def rank_table(ranks: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """(slots, shifts, table): a perfect hash of all pairs of tokens that make a token.

    A pair is the number left * 2**20 + right; its slot is pair % slots + shifts[pair % len(shifts)], where the table has
    pair * 2**20 + rank.  Lists of pairs with an equal shift are placed from the longest on, at the first shift that fits.
    """
    if max(ranks.values(), default=0) >= _NONE >> 1:
        raise ValueError("ranks of 2**19 or more")
    found = [(ranks[w[:i]] << _SHIFT | ranks[w[i:]], r) for w, r in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks]
    pairs, rank = np.array(found, np.int64).reshape(-1, 2).T
    slots, lists = max(7, len(pairs) * 5 // 2) | 1, max(3, len(pairs) // 3) | 1
    while len(np.unique(pairs % slots * lists + pairs % lists)) < len(pairs):
        slots += 2
    member = pairs % lists
    size = np.bincount(member, minlength=lists)
    first = np.concatenate([[0], np.cumsum(size)])
    wanted = (pairs % slots)[np.argsort(member, kind="stable")].tolist()
    taken, shifts = bytearray(slots + len(pairs) + 1), np.zeros(lists, np.int64)
    for k in np.argsort(-size, kind="stable")[: np.count_nonzero(size)].tolist():
        own, by = wanted[first[k] : first[k + 1]], 0
        while any(taken[x + by] for x in own):
            by += 1
        shifts[k] = by
        for x in own:
            taken[x + by] = 1
    table = np.full(slots + int(shifts.max()) + 1, -1, np.int64)
    table[pairs % slots + shifts[member]] = pairs << _SHIFT | rank
    return slots, shifts, table


def fold(entries: Column, slots: int, lists: int, shifts: Column, table: Column) -> Column:
    """Ids (array<int>) of a word given as entries rank * 2**20 + id, with an entry that has no rank at either end."""

    def entry(pair):
        # what is no pair of the table is far from any, so its rank is cut to "none"
        at = (pair % slots + F.get(shifts, (pair % lists).cast("int"))).cast("int")
        return F.shiftleft(F.least(F.abs(F.get(table, at) - F.shiftleft(pair, _SHIFT)), F.lit(_NONE).cast("long")), _SHIFT) + F.shiftright(pair, _SHIFT)

    def symbol(e, at):
        return F.get(e, at).bitwiseAND(_MASK)

    def merged(e, low):
        at, new = low.bitwiseAND(_MASK).cast("int"), F.shiftright(low, _SHIFT)
        pairs = F.array(F.shiftleft(symbol(e, at - 1), _SHIFT) + new, F.shiftleft(new, _SHIFT) + symbol(e, at + 2))
        return F.flatten(F.array(F.slice(e, 1, at - 1), F.transform(pairs, entry), F.slice(e, at + 3, F.size(e))))

    def step(e, _):
        # the lowest rank with its first place, bound once
        low = F.array_min(F.transform(e, lambda x, at: F.shiftleft(F.shiftright(x, _SHIFT), _SHIFT) + at))
        return F.element_at(F.transform(F.array(low), lambda low: F.when(low >= _NONE >> 1 << _SHIFT, e).otherwise(merged(e, low))), 1)

    merges = F.slice(entries, 4, F.size(entries))
    return F.aggregate(merges, entries, step, lambda e: F.transform(F.slice(e, 2, F.greatest(F.size(e) - 2, F.lit(0))), lambda x: x.bitwiseAND(_MASK).cast("int")))


def rank_folder(spark: SparkSession, ranks: dict[bytes, int]):
    """A function that puts ids in place of a column of arrays of words; the rank table is a row that a subquery reads, bound for all words.

    As a literal its megabytes would be written out in every text and copy of a plan that the driver makes.
    """
    slots, shifts, table = rank_table(ranks)
    row = spark.createDataFrame(pa.table({"shifts": pa.array([shifts]), "table": pa.array([table])}))
    both = row.select(F.struct("shifts", "table")).scalar()

    def folded(rows: DataFrame, column: str) -> DataFrame:
        ids = F.transform(F.array("_ranks"), lambda t: F.transform(column, lambda w: fold(w, slots, len(shifts), t["shifts"], t["table"])))
        return rows.withColumn("_ranks", both).withColumn(column, F.element_at(ids, 1)).drop("_ranks")

    return folded


def first_entries(words: list[bytes], pair_ranks: np.ndarray, byte_ids: np.ndarray) -> pa.Array:
    """The entries of words before any merge."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 2)
    raw = np.frombuffer(b"".join(words), np.uint8)
    # two more places for each word: no id stands there, and no pair with it has a rank
    at = np.arange(len(raw)) + np.repeat(2 * np.arange(len(words)) + 1, size)
    ids = np.full(int(ends[-1]) if len(words) else 0, _MASK >> 1, np.int64)
    ids[at] = byte_ids[raw]
    rank = np.full(len(ids), _NONE, np.int64)
    inner = np.ones(len(raw), bool)
    inner[np.cumsum(size)[size > 0] - 1] = False
    inner = np.flatnonzero(inner)
    rank[at[inner]] = pair_ranks[raw[inner].astype(np.int64) << 8 | raw[inner + 1]]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(rank << _SHIFT | ids))


def long_fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long word in n log n time: lowest rank first, leftmost first, with a heap."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, nxt, prev = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i], nxt[i] = stop, nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
            if (r := ranks.get(word[i : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if prev[i] >= 0 and (r := ranks.get(word[prev[i] : stop])) is not None:
            heapq.heappush(heap, (r, prev[i], stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def _alphabet(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(ranks of pairs of bytes, ids of bytes)."""
    byte_ids = np.array([ranks[bytes([x])] for x in range(256)], np.int64)
    return np.array([ranks.get(bytes([x, y]), _NONE) for x in range(256) for y in range(256)], np.int64), byte_ids


def frequent_words(docs: DataFrame, pattern: str, limit: int = HOT_WORDS) -> DataFrame:
    """(word): up to ``limit`` frequent words of all texts: a cache, which decides nothing but where a word is folded."""

    def count(batches):
        seen: dict[str, int] = {}

        def flush():
            rows = [(w, n) for w, n in seen.items() if n > 1 and len(w) * 4 <= LONG]
            seen.clear()
            for a in range(0, len(rows), 50_000):
                words, counts = zip(*rows[a : a + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

        for batch in gathered(batches, 800_000):
            _, offsets = text_bytes(batch.column(0))
            for i, j in pieces(offsets, 1_000_000):
                points, start, end, _ = word_bounds([x or "" for x in batch.column(0).slice(i, j - i).to_pylist()], pattern)
                words, number = distinct_words(points, start, end)
                for w, n in zip(words, np.bincount(number, minlength=len(words)).tolist(), strict=True):
                    seen[w] = seen.get(w, 0) + n
                if len(seen) > 400_000:
                    yield from flush()
        yield from flush()
        give_back()

    counted = written(texts(docs).select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "bpe-words")
    # the smallest count that at most ``limit`` words reach
    sizes = sorted(((r[0], r[1]) for r in counted.groupBy(F.least("n", F.lit(100_000)).alias("n")).count().toLocalIterator()), reverse=True)
    total, least = 0, 1 << 62
    for n, words in sizes:
        if total + words > limit:
            break
        total, least = total + words, n
    return counted.where(F.col("n") >= least).select("word")


def dictionary(frequent: DataFrame, ranks: Broadcast, folded, pair_ranks: np.ndarray, byte_ids: np.ndarray, width: int = 1024) -> bytes:
    """The frequent words that are no tokens and their ids, folded where they stand: lists of words and of lists of ids, as an
    Arrow stream."""

    def entries(batches):
        for batch in gathered(batches, 1_000_000):
            words = [w for x in batch.column(0).to_pylist() if (w := x.encode()) not in ranks.value]
            for k in range(0, len(words), width):
                own = first_entries(words[k : k + width], pair_ranks, byte_ids)
                yield pa.RecordBatch.from_arrays([pa.array([words[k : k + width]], pa.list_(pa.binary())), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)], names=["words", "entries"])

    rows = frequent.repartition(16, "word").mapInArrow(entries, "words array<binary>, entries array<array<bigint>>")
    table = folded(rows, "entries").select("words", F.col("entries").alias("ids")).toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _opened(stream: bytes) -> tuple[list[str], pa.Array]:
    """(words, codes of their ids) of a dictionary."""
    words, codes = [], [pa.array([], pa.binary())]
    for batch in pa.ipc.open_stream(stream):
        for w, ids in zip(batch.column(0), batch.column(1), strict=True):
            words += [x.decode() for x in w.values.to_numpy(zero_copy_only=False).tolist()]
            codes.append(_codes(ids.values))
    return words, pa.concat_arrays(codes)


def _binary(offsets: np.ndarray, data) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), data if isinstance(data, pa.Buffer) else pa.py_buffer(data)])


def _offsets(x: pa.Array) -> np.ndarray:
    return np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1] if len(x) else np.zeros(1, np.int32)


def _joined(taken: pa.Array, ends: np.ndarray) -> pa.Array:
    """Stretches of items, each laid end to end to one item."""
    at = _offsets(taken)[ends]
    return _binary(at, taken.buffers()[2] if len(taken) and taken.buffers()[2] is not None else b"")


class _Codes:
    """Ids and bytes of numbered words: frequent words, then tokens, then the words of a task's documents as they come; each
    kind stands in one Arrow buffer, so a text is made by taking items that are laid end to end anyway."""

    def __init__(self, hot: pa.Array, ranks: dict[bytes, int]):
        table = sorted(ranks, key=ranks.get)
        every = [b""] * (max(ranks.values(), default=-1) + 1)
        for x in table:
            every[ranks[x]] = x
        self.pieces = pa.array(every, pa.binary())
        own = np.array([ranks[x] for x in table], "<u4")
        self.ids = pa.concat_arrays([hot, _binary(4 * np.arange(len(own) + 1), own.tobytes())])
        self.bytes = pa.concat_arrays([self.decoded(hot), pa.array(table, pa.binary())])
        self.fixed = len(self.ids)

    def decoded(self, ids: pa.Array) -> pa.Array:
        """The pieces of each item's ids, one behind the other."""
        at = _offsets(ids) // 4
        flat = np.frombuffer(ids.buffers()[2] or b"", "<u4")[at[0] : at[-1]] if len(ids) else np.zeros(0, "<u4")
        return _joined(self.pieces.take(pa.array(flat)), at - at[0])

    def add(self, more: pa.Array) -> None:
        if len(more):
            self.ids = pa.concat_arrays([self.ids, more])
            self.bytes = pa.concat_arrays([self.bytes, self.decoded(more)])

    def reset(self) -> None:
        if len(self.ids) > self.fixed:
            self.ids, self.bytes = (pa.concat_arrays([x.slice(0, self.fixed)]) for x in (self.ids, self.bytes))


def _codes(lists: pa.Array) -> pa.Array:
    """Each list of ids as little-endian unsigned 32-bit integers."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
    return _binary(np.concatenate([[0], 4 * np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)]), flat.tobytes())


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, ids binary, n_tokens, decoded binary) of every row: ids as little-endian unsigned 32-bit integers."""
    spark = docs.sparkSession
    # the texts of plans that the driver keeps are held short
    if spark.conf.get("spark.sql.maxPlanStringLength") == _ANY_LENGTH:
        spark.conf.set("spark.sql.maxPlanStringLength", "65536")
    pair_ranks, byte_ids = _alphabet(ranks)
    folded = rank_folder(spark, ranks)
    shared = spark.sparkContext.broadcast(ranks)
    frequent = spark.sparkContext.broadcast(dictionary(frequent_words(docs, pattern), shared, folded, pair_ranks, byte_ids))
    give_back()
    cache: dict = {}

    def number(batches):
        ranks = shared.value
        if "numbers" not in cache:
            hot, _ = _opened(frequent.value)
            cache["numbers"] = {w: k for k, w in enumerate(hot)}, {w: k for k, w in enumerate(sorted(ranks, key=ranks.get), len(hot))}
        numbers, tokens = cache["numbers"]
        fixed = len(numbers) + len(ranks)
        part, at_row = TaskContext.get().partitionId(), 0
        rare: list[str] = []
        reset = True
        for batch in gathered(batches, 800_000):
            ids, column = int64s(batch.column(0)), batch.column(1)
            _, offsets = text_bytes(column)
            for i, j in pieces(offsets, 1_000_000):
                points, start, end, sizes = word_bounds([x or "" for x in column.slice(i, j - i).to_pylist()], pattern)
                words, place = distinct_words(points, start, end)
                own, fresh = np.empty(len(words), np.int32), []
                for at, w in enumerate(words):
                    k = numbers.get(w)
                    if k is None:
                        raw = w.encode()
                        k = tokens.get(raw)
                        if k is None:
                            k = numbers[w] = fixed + len(rare)
                            rare.append(w)
                            fresh.append(raw)
                    own[at] = k
                short = [w if len(w) <= LONG else b"" for w in fresh]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i:j].tobytes()], pa.binary()), pa.array([sizes.astype(np.int64).tobytes()], pa.binary()), pa.array([own[place].tobytes()], pa.binary()),
                        pa.ListArray.from_arrays(pa.array([0, len(fresh)], pa.int32()), first_entries(short, pair_ranks, byte_ids)),
                        pa.array([[w if len(w) > LONG else b"" for w in fresh] if any(len(w) > LONG for w in fresh) else []], pa.list_(pa.binary())), pa.array([reset]),
                        pa.array([part], pa.int32()), pa.array([at_row], pa.int64()),
                    ],
                    names=["doc_ids", "sizes", "seq", "fresh", "long", "reset", "part", "at_row"],
                )
                at_row += 1
                reset = len(rare) > RARE_WORDS
                if reset:
                    for w in rare:
                        del numbers[w]
                    rare = []
        for w in rare:
            del numbers[w]
        give_back()

    def assemble(batches):
        if "codes" not in cache:
            cache["codes"] = _Codes(_opened(frequent.value)[1], shared.value)
        codes, ranks = cache["codes"], shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                ids, sizes, seq = (np.frombuffer(batch.column(k)[row].as_py(), kind) for k, kind in enumerate((np.int64, np.int64, np.int32)))
                got, long = batch.column(3)[row].values, batch.column(4)[row].as_py()
                if batch.column(5)[row].as_py():
                    codes.reset()
                more = _codes(got) if got is not None else pa.array([], pa.binary())
                if long:
                    more = pa.array([np.array(long_fold(w, ranks), "<u4").tobytes() if w else x for w, x in zip(long, more.to_pylist(), strict=True)], pa.binary())
                codes.add(more)
                ends, seq = np.concatenate([[0], np.cumsum(sizes)]), pa.array(seq)
                raw, text = (_joined(x.take(seq), ends) for x in (codes.ids, codes.bytes))
                yield pa.RecordBatch.from_arrays(
                    [id_column(ids), raw, pa.array(np.diff(_offsets(raw)).astype(np.int64) // 4), text],
                    names=["doc_id", "ids", "n_tokens", "decoded"],
                )
        codes.reset()
        give_back()

    numbered = texts(docs).mapInArrow(number, "doc_ids binary, sizes binary, seq binary, fresh array<array<bigint>>, long array<binary>, reset boolean, part int, at_row long")
    # an empty list stands for a long word and keeps its place
    words = folded(numbered, "fresh").select("doc_ids", "sizes", "seq", F.col("fresh").alias("got"), "long", "reset", "part", "at_row")
    # all rows of a task go to one task, so that a repeated task brings them in one piece
    ordered = words.repartition("part").sortWithinPartitions("part", "at_row")
    return ordered.select("doc_ids", "sizes", "seq", "got", "long", "reset").mapInArrow(assemble, "doc_id long, ids binary, n_tokens long, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def token_lists(encoded: DataFrame) -> DataFrame:
    """(doc_id, ids array<long>) of ``encode``'s rows."""

    def run(batches):
        for batch in batches:
            lists = [np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<long>")


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
