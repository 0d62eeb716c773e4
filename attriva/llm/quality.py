"""Quality classifier: Bradley-Terry ranking.

Each text becomes a vector of surface statistics.  From labelled training rows preference pairs (a good text beats a
bad one) are drawn; the chance that i beats j is sigmoid(w.(x_i - x_j)), and w is fitted by logistic loss on these
differences.  w.x ranks all texts.  The threshold is a quantile of the training rows' scores, chosen among a grid of
quantiles; scores are shifted so that it lies at ``cut``.

Defined cases: null or empty texts have all statistics 0 and are scored like others; without labels of both classes
every score is 0.5; every row gives a row; rows with null id are no training rows; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_sample
from .shared import crc_mod, texts
from .textops import SPACE_WORDS, Words, gathered, id_column, int64s, pieces, text_bytes

_PRINT = list(range(0x21, 0x30)) + list(range(0x3A, 0x41)) + list(range(0x5B, 0x61)) + list(range(0x7B, 0x7F))
N_FEATURES = 0  # set below


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Surface statistics of a run of texts, one row each."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    hist = np.bincount(doc.astype(np.int64) * 256 + data, minlength=n * 256).reshape(n, 256).astype(np.float64)
    safe = np.maximum(size, 1)
    upper, lower, digit = hist[:, 65:91].sum(1), hist[:, 97:123].sum(1), hist[:, 48:58].sum(1)
    w = Words(data, offsets, SPACE_WORDS)
    words = w.per_doc().astype(np.float64)
    some = np.maximum(words, 1)

    def repeats(h, d):
        """Share of entries of a document that repeat an earlier one of it."""
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        same = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
        return np.bincount(d[1:][same], minlength=n) / np.maximum(np.bincount(d, minlength=n), 1)

    g, gd, _ = w.ngrams(3)
    lines = Words(data, offsets, _LINES)
    length = (w.end - w.start).astype(np.float64)
    mean = np.bincount(w.doc, length, n) / some
    square = np.bincount(w.doc, length * length, n) / some
    first_up = np.bincount(w.doc, (data[w.start] >= 65) & (data[w.start] <= 90), n) / some if len(w) else np.zeros(n)
    columns = [
        np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(square - mean * mean, 0)), first_up,
        upper / safe, lower / safe, digit / safe, hist[:, 0x80:].sum(1) / safe, hist[:, 0x20] / safe, hist[:, 0x0A] / safe, hist[:, :0x20].sum(1) / safe,
        upper / np.maximum(upper + lower, 1), hist[:, _PRINT].sum(1) / safe, repeats(w.hash, w.doc), repeats(g, gd), repeats(lines.hash, lines.doc), words / np.maximum(lines.per_doc(), 1) / 100,
        (size < 40).astype(float), (size < 100).astype(float), (size < 200).astype(float),
    ]
    dense = np.stack(columns, 1)
    marks = np.log1p(1000 * hist[:, _PRINT] / safe[:, None])
    return np.concatenate([dense, marks], 1).astype(np.float32)


_LINES = np.ones(256, dtype=bool)
_LINES[[0x0A, 0x0D]] = False
N_FEATURES = features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]


def _widen(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / std, -6, 6)
    return np.concatenate([z, z * z / 6], 1)


def fit(x: np.ndarray, y: np.ndarray, cut: float, pairs: int = 60_000, seed: int = 7, ridge: float = 1e-3) -> dict:
    """Bradley-Terry weights, the quantile threshold and the scale of the scores."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    mean, std = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    dim = 2 * x.shape[1]
    if not len(good) or not len(bad):
        return {"mean": mean, "std": std, "w": np.zeros(dim), "tau": 0.0, "scale": 1.0, "at": 0.0}
    z = _widen(x, mean, std).astype(np.float64)
    rng = np.random.default_rng(seed)
    diff = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(dim)
    for _ in range(25):  # Newton steps on the logistic loss of the differences
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        grad = diff.T @ (1 - p) / pairs - ridge * w
        v = p * (1 - p)
        hess = (diff * v[:, None]).T @ diff / pairs + ridge * np.eye(dim)
        step = np.linalg.solve(hess, grad)
        w = w + step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-5:
            break
    raw = z @ w
    best = (-1.0, 0.0, 0.0)
    base = len(bad) / len(raw)
    for q in np.unique(np.concatenate([np.linspace(0.005, 0.5, 100), [base]])):  # score quantiles
        tau = float(np.quantile(raw, q))
        keep = raw >= tau
        accuracy = float((keep == (y == 1)).mean())
        if accuracy > best[0]:
            best = (accuracy, tau, q)
    scale = max(float(np.std(raw)), 1e-6) / 2
    return {"mean": mean, "std": std, "w": w, "tau": best[1], "scale": scale, "at": float(np.log(cut / (1 - cut))), "quantile": best[2]}


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    raw = _widen(x, model["mean"], model["std"]) @ model["w"]
    return 1 / (1 + np.exp(-np.clip((raw - model["tau"]) / model["scale"] + model["at"], -40, 40)))


def _featured(frame: DataFrame) -> DataFrame:
    def run(batches):
        for batch in gathered(batches, 800_000):
            data, offsets = text_bytes(batch.column(0))
            for i, j in pieces(offsets, 1_000_000, 1000):
                x = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1).slice(i, j - i)], names=["x", "y"])

    return frame.select("text", "y").mapInArrow(run, "x binary, y int")


def train(docs: DataFrame, labels: DataFrame, cut: float = 0.3, max_rows: int = 12_000, max_bytes: int = 100_000_000) -> dict:
    """Fit on a bounded sample: at most ``max_rows`` labelled rows of each class and about ``max_bytes`` of text.

    The larger class is thinned by the bound alone, so its share is kept where the bound does not bind.
    """
    rows = _featured(labelled_sample(docs, labels, "quality", max_rows, max_bytes)).toArrow()
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, N_FEATURES)
    return fit(x, np.array(rows["y"].to_pylist(), np.int64), cut)


def quality_scores(docs: DataFrame, model: dict, cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; the score sees nothing but the text."""

    def run(batches):
        for batch in gathered(batches, 800_000):
            data, offsets = text_bytes(batch.column(1))
            ids = int64s(batch.column(0))
            for i, j in pieces(offsets, 1_000_000, 1000):
                x = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([id_column(ids[i:j]), pa.array(scores(model, x))], names=["doc_id", "score"])

    out = texts(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
