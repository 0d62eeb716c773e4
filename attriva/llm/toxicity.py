"""Toxicity: a convolutional text classifier in numpy.

Words are hashed into an embedding table, each as the sum of the vectors of the word and of its first 4, 5 and 6 bytes,
so that inflected forms share vectors; filters of widths 1, 2 and 3 slide over the whole text; each filter's maximum
over the text goes into a logistic output.  The first embedding coordinate starts at the smoothed log-odds of its
hash bucket in the training rows, the others at small random values; all is trained by Adagrad.  Thresholds are
calibrated per language, which is guessed from the text's own function words, never from a column; each score is
shifted so that its language's threshold lies at 0.5.

Defined cases: null, empty and wordless texts are one padding word and are scored like others; without labels of both
classes every score is 0.0 (nothing is rejected); every row gives a row; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_sample
from .shared import crc_mod, dropped, texts
from .textops import ALNUM_WORDS, Words, gathered, give_back, id_column, int64s, pieces, text_bytes

BUCKET_BITS = 17
DIM = 8
WIDTHS = (1, 2, 3)
PREFIXES = (4, 5, 6)
PARTS = 1 + len(PREFIXES)
FILTERS = 8
#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as was on be are this by",
    "de": "der die das und ist nicht von zu den mit ein eine auf im dem",
    "fr": "le les des et est une dans pour que qui sur pas par au du",
    "es": "el los las y es una por con para del se su como al lo",
}
LANGUAGES = (*FUNCTION_WORDS, "other")


def _hash_words(words: str) -> np.ndarray:
    data, offsets = text_bytes(pa.array([words]))
    return Words(data, offsets, ALNUM_WORDS).hash


_STOPS = {k: np.sort(_hash_words(v)) for k, v in FUNCTION_WORDS.items()}


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket ids with a padding 0 before each text and at the end, text starts, language index)."""
    w = Words(data, offsets, ALNUM_WORDS)
    n = len(offsets) - 1
    counts = w.per_doc()
    ids = np.zeros((len(w) + n + 1, PARTS), np.int32)
    place = np.arange(len(w)) + w.doc + 1
    for k, h in enumerate([w.hash, *(w.prefix(x) for x in PREFIXES)]):
        ids[place, k] = (h & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int32)
    starts = np.concatenate([[0], np.cumsum(counts + 1)])
    votes = np.zeros((n, len(LANGUAGES)))
    votes[:, -1] = 0.5
    for k, lang in enumerate(FUNCTION_WORDS):
        at = np.minimum(np.searchsorted(_STOPS[lang], w.hash), len(_STOPS[lang]) - 1)
        votes[:, k] = np.bincount(w.doc[_STOPS[lang][at] == w.hash], minlength=n)
    return ids, starts, votes.argmax(1)


class Net:
    """Embedding, filters and output weights."""

    def __init__(self, table: np.ndarray, filters: list[np.ndarray], out: np.ndarray, bias: float):
        self.table, self.filters, self.out, self.bias = table, filters, out, bias

    def pooled(self, ids: np.ndarray, starts: np.ndarray, places: bool = False):
        """Maximum of each filter over each text; with ``places`` also where. Windows may reach into padding only."""
        x = self.table[ids[:, 0]]
        for k in range(1, PARTS):
            x += self.table[ids[:, k]]
        n = len(starts) - 1
        top, where = [], []
        for k, f in zip(WIDTHS, self.filters, strict=True):
            # a text's windows: from its padding on, ending before the next text's words
            m = len(ids) - k + 1
            r = x[:m] @ f[0]
            for j in range(1, k):
                r += x[j : m + j] @ f[j]
            a = np.minimum(starts[:-1], m - 1)
            best = np.empty((n, FILTERS), np.float32)
            spot = np.zeros((n, FILTERS), np.int64)
            b = np.maximum(np.minimum(starts[1:] + 1 - k + 1, m), a + 1)
            if places:
                for t in range(n):
                    part = r[a[t] : b[t]]
                    spot[t] = part.argmax(0)
                    best[t] = part[spot[t], np.arange(FILTERS)]
                    spot[t] += a[t]
            else:
                cuts = np.stack([a, b], 1).ravel()
                safe = np.concatenate([r, np.full((1, FILTERS), -1e30, np.float32)])
                best = np.maximum.reduceat(safe, np.minimum(cuts, m), axis=0)[::2]
            top.append(np.maximum(best, 0))
            where.append(spot)
        return np.concatenate(top, 1), where

    def logits(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.pooled(ids, starts)[0] @ self.out + self.bias


def fit(texts: list[np.ndarray], y: np.ndarray, epochs: int = 4, seed: int = 11, rate: float = 0.1, smooth: float = 10.0) -> Net:
    """Train on texts given as bucket ids without padding."""
    rng = np.random.default_rng(seed)
    size = 1 << BUCKET_BITS
    pos, neg = np.zeros(size), np.zeros(size)
    for ids, label in zip(texts, y, strict=True):
        (pos if label else neg)[np.unique(ids)] += 1
    p, t = max(1, int(y.sum())), max(2, len(y))
    odds = np.log((pos + smooth * p / t) / p) - np.log((neg + smooth * (t - p) / t) / max(1, t - p))
    table = rng.normal(0, 0.05, (size, DIM)).astype(np.float32)
    table[:, 0] = odds / 2
    table[0] = 0
    filters = [rng.normal(0, 0.1, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
    for f in filters:
        f[:, 0] += 0.5 / len(f)
    out = np.full(FILTERS * len(WIDTHS), 0.3, np.float32)
    net = Net(table, filters, out, -2.0)
    g_table, g_filters, g_out, g_bias = np.full_like(table, 1e-2), [np.full_like(f, 1e-1) for f in filters], np.full_like(out, 1e-1), 1e-1
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), 32):
            own = order[a : a + 32]
            lens = np.array([len(texts[i]) for i in own])
            starts = np.concatenate([[0], np.cumsum(lens + 1)])
            ids = np.zeros((starts[-1] + 1, PARTS), np.int32)
            for k, i in enumerate(own):
                ids[starts[k] + 1 : starts[k + 1]] = texts[i]
            h, where = net.pooled(ids, starts, places=True)
            delta = ((1 / (1 + np.exp(-np.clip(h @ net.out + net.bias, -30, 30)))) - y[own]).astype(np.float32) / len(own)
            d_out, d_bias = h.T @ delta + 1e-4 * net.out, float(delta.sum())
            d_h = np.outer(delta, net.out) * (h > 0)
            rows, grads = [], []
            for k, (width, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
                part, spot = d_h[:, k * FILTERS : (k + 1) * FILTERS], where[k]
                d_f = np.zeros_like(f)
                for j in range(width):
                    word = ids[np.minimum(spot + j, len(ids) - 1)]
                    d_f[j] = np.einsum("tf,tfd->df", part, net.table[word].sum(2))
                    flow = (part[:, :, None] * f[j].T[None]).reshape(-1, DIM)
                    for q in range(PARTS):
                        rows.append(word[:, :, q].ravel())
                        grads.append(flow)
                g_filters[k] += d_f * d_f
                net.filters[k] = f - rate * d_f / np.sqrt(g_filters[k])
            rows, inverse = np.unique(np.concatenate(rows), return_inverse=True)
            grad = np.zeros((len(rows), DIM), np.float32)
            np.add.at(grad, inverse, np.concatenate(grads))
            grad[rows == 0] = 0
            g_table[rows] += grad * grad
            net.table[rows] -= rate * grad / np.sqrt(g_table[rows])
            g_out += d_out * d_out
            net.out = net.out - rate * d_out / np.sqrt(g_out)
            g_bias += d_bias * d_bias
            net.bias -= rate * d_bias / np.sqrt(g_bias)
    return net


def _threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The logit that makes the fewest weighted errors, midway between neighbours."""
    order = np.argsort(-z, kind="stable")
    z, y, weight = z[order], y[order], weight[order]
    errors = np.concatenate([[0], np.cumsum(weight * (y == 0))]) + np.concatenate([[0], np.cumsum((weight * (y == 1))[::-1])])[::-1]
    distinct = np.concatenate([[True], z[1:] < z[:-1], [True]])
    k = int(np.flatnonzero(distinct)[np.argmin(errors[distinct])])
    high = z[k - 1] if k > 0 else z[0] + 2
    low = z[k] if k < len(z) else z[-1] - 2
    return float((high + low) / 2)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 5_000, max_bytes: int = 60_000_000, seed: int = 11) -> tuple | None:
    """(net, threshold by language), from at most ``max_rows`` labelled rows of each class and about ``max_bytes`` of text.

    A quarter of the sample is kept from training the weights and calibrates the thresholds.
    """

    sample = labelled_sample(docs, labels, "toxic", max_rows, max_bytes).select("doc_id", "text", "y").toArrow()
    sample = sample.take(pc.sort_indices(sample, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))
    dropped(docs.sparkSession)  # what the JVM held of the sample goes before this process takes as much
    y = sample["y"].to_numpy().astype(np.int64)
    if len(set(y.tolist())) < 2:
        return None
    data, offsets = text_bytes(sample["text"])
    texts, lang = [], []
    for i, j in pieces(offsets, 1_000_000, 1000):
        ids, starts, own = encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        texts += [ids[a + 1 : b].copy() for a, b in zip(starts[:-1], starts[1:], strict=True)]
        lang.append(own)
    lang = np.concatenate(lang)
    del sample, data
    held = np.random.default_rng(seed).random(len(y)) < 0.25
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    net = fit([texts[i] for i in np.flatnonzero(~held)], y[~held], seed=seed)
    use = np.flatnonzero(held) if held.any() else np.arange(len(y))
    z = np.array([net.logits(np.concatenate([np.zeros((1, PARTS), np.int32), texts[i], np.zeros((1, PARTS), np.int32)]), np.array([0, len(texts[i]) + 1]))[0] for i in use])
    rows = labels.where("toxic is not null").groupBy("toxic").count().collect()
    real = {int(r[0]): r[1] for r in rows}
    weight = np.where(y[use] == 1, real.get(1, 1) / max(1, int(y.sum())), real.get(0, 1) / max(1, int((y == 0).sum())))
    general = _threshold(z, y[use], weight)
    cuts = np.full(len(LANGUAGES), general)
    for k in range(len(LANGUAGES)):
        of = lang[use] == k
        if (y[use][of] == 1).sum() >= 20 and (y[use][of] == 0).sum() >= 20:
            cuts[k] = _threshold(z[of], y[use][of], weight[of])
    del texts
    give_back()
    return net, cuts


def toxicity_scores(docs: DataFrame, model: tuple | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; the score sees nothing but the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in gathered(batches, 400_000):
            data, offsets = text_bytes(batch.column(1))
            ids = int64s(batch.column(0))
            for i, j in pieces(offsets, 500_000, 1000):
                z = np.full(j - i, -np.inf)
                if model is not None:
                    words, starts, lang = encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    z = model[0].logits(words, starts) - model[1][lang]
                yield pa.RecordBatch.from_arrays([id_column(ids[i:j]), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 40))))], names=["doc_id", "score"])

    out = texts(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier does not reject, with all their columns; rows of null id stay if their text does."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def keep(batches):
        model = shared.value
        for batch in gathered(batches, 400_000):
            data, offsets = text_bytes(batch.column(place))
            for i, j in pieces(offsets, 500_000, 1000):
                part = batch.slice(i, j - i)
                if model is not None:
                    words, starts, lang = encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    part = part.filter(pa.array(model[0].logits(words, starts) - model[1][lang] < 0))
                yield part

    return docs.mapInArrow(keep, docs.schema)
