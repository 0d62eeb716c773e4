"""Fuzzy text scores from 0 to 100, written here because no library for them is at hand.

``ratio`` is the normalised indel similarity; the others are built on it in the customary way.  They are used on
distinct pairs through a vectorised UDF.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    row = (1 << len(a)) - 1
    full = row
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def ratio(a: str, b: str) -> float:
    """200 * LCS / total length; two empty texts: 100."""
    return 200 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text against windows of its length in the longer one, edges included."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    n = len(short)
    windows = [long[k : k + n] for k in range(max(1, len(long) - n + 1))] + [long[:k] for k in range(1, n)] + [long[-k:] for k in range(1, n)]
    return max(ratio(short, w) for w in dict.fromkeys(windows))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared words and the shared words with each side's own."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    one, two = (" ".join([*filter(None, [both]), *sorted(s)]).strip() for s in (x - y, y - x))
    if both and (not x - y or not y - x):
        return 100.0
    return max(ratio(one, two), ratio(both, one) if both else 0, ratio(both, two) if both else 0)


def weighted_ratio(a: str, b: str) -> float:
    """The best of the plain, token and (for texts of unlike length) partial scores, each with a fixed weight."""
    if not a or not b:
        return 0.0
    unlike = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if unlike < 1.5:
        return max(best, 0.95 * token_sort_ratio(a, b), 0.95 * token_set_ratio(a, b))
    scale = 0.9 if unlike <= 8 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), 0.95 * scale * (100.0 if set(a.split()) & set(b.split()) else 0))


def stem_affinity(a: str, b: str) -> float:
    """Common beginning over the shorter length; under four letters: 0."""
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k / min(len(a), len(b)) if k >= 4 else 0.0


SCORERS = {f.__name__: f for f in (ratio, partial_ratio, token_sort_ratio, token_set_ratio, weighted_ratio, stem_affinity)}


def score(name: str, a: Column, b: Column) -> Column:
    """A scorer over two columns; null for a null side."""
    scorer = SCORERS[name]

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else float(scorer(p, q)) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def letters(c: Column) -> Column:
    """Each letter with the number of its occurrence, so that two texts' common letters are an intersection of sets."""
    own = F.array_sort(F.split(c, ""))
    return F.transform(own, lambda x, k: F.concat(x, (k + 1 - F.array_position(own, x)).cast("string")))


def may_reach(name: str, a: Column, b: Column, a_letters: Column, b_letters: Column, least: float) -> Column:
    """Whether the score of two texts can be ``least``: false is a proof that it is not.

    A common subsequence has at most the common letters m; a text's words in another order have at least the length it
    has without surplus spaces.  So a ratio is at most 200 m over both lengths, and a partial one, whose window may be cut
    short at an end, at most 200 m over m and the shorter length.  Texts that share a word may score 100 by words.
    """
    m = F.size(F.array_intersect(a_letters, b_letters))
    spare = lambda c: F.length(F.trim(F.regexp_replace(c, r"\s+", " ")))
    la, lb = spare(a), spare(b)
    partial = F.least(F.lit(100.0), 200.0 * m / F.greatest(F.lit(1), F.least(la, lb) + m))
    if name == "partial_ratio":
        return (partial >= least - 1e-9) | (F.least(la, lb) == 0)
    whole = 200.0 * m / F.greatest(F.lit(1), la + lb)
    words = lambda c: F.split(F.trim(c), r"\s+")
    unlike = F.greatest(F.length(a), F.length(b)) / F.greatest(F.lit(1), F.least(F.length(a), F.length(b)))
    bound = F.when(unlike < 1.5, whole).when(unlike <= 8, F.greatest(whole, 0.9 * partial)).otherwise(F.greatest(whole, 0.6 * partial))
    return F.coalesce(F.arrays_overlap(words(a), words(b)), F.lit(False)) | (bound >= least - 1e-9)


def best_places(texts: Column, options: Column, scorer: Column, least: Column) -> Column:
    """For each text of an array the place (from 1) of the option that scores best by ``scorer``, the first of equals; null
    under ``least`` or for blank texts.  A null array of texts gives null and costs nothing.

    Declared as not deterministic, so that the engine runs it once: a filter on its result would else be pushed below, with
    a second run and all expressions of the arguments repeated.
    """

    @F.pandas_udf("array<int>")
    def run(xs: pd.Series, os: pd.Series, names: pd.Series, floors: pd.Series) -> pd.Series:
        known: dict = {}

        def place(text, listed, name, floor):
            key = text, listed, name
            if key not in known:
                scores = [SCORERS[name](text, o) if o else 0.0 for o in listed] if text else []
                best = max(range(len(scores)), key=lambda k: (scores[k], -k), default=None)
                known[key] = None if best is None or scores[best] < floor else best + 1
            return known[key]

        return pd.Series([None if x is None or o is None else [place(v, tuple(o), n, f) for v in x] for x, o, n, f in zip(xs, os, names, floors, strict=True)])

    return run.asNondeterministic()(texts, options, scorer, least)
