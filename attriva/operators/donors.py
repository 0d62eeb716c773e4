"""Which card a product takes its values from (J10, J11): scores of a pool of found cards, and the pick.

A pool row is a product with one card that a search found for it.  Scores depend on texts alone, so equal pairs of texts are
scored once, however many pool rows share them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import text as t
from . import predicates as p
from .joins import spread
from .windows import first_by

# By source, the least score of the same product and of the same line of a brand
THRESHOLDS = {"ozon_card": (78.0, 65.0), "wb_card": (78.0, 64.0), "yandex_market": (78.0, 60.0), "bestbuy": (78.0, 60.0), "onliner": (78.0, 60.0), "regard": (78.0, 60.0)}


def bonuses(query: Column, title: Column, category: Column, brand: Column | None, substring: bool = False) -> Column:
    """What is added to the mean of the partial and the token-sort score.

    5 for a shared article token, else 3 for a shared word that may name a model; -30 for a type that the title lacks, where
    the query has no article; -30 for the other gender; with ``brand``, -60 for another brand and -60 for another model.
    ``substring``: the type must be in the title as it is written, else by the first four letters of a word.
    """
    own, other = t.model_tokens(query), t.model_tokens(title)
    shares = lambda x, y: F.coalesce(F.arrays_overlap(x, y), F.lit(False))
    shared = F.when(shares(own, other), 5.0).when(shares(t.alpha_tokens(query), t.alpha_tokens(title)), 3.0).otherwise(0.0)
    leaf = F.lower(t.strip(category))
    typed = F.contains(F.lower(title), leaf) if substring else t.category_in_title(leaf, title)
    minus = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0)
    out = shared - minus((leaf != "") & (F.size(own) == 0) & ~typed, 30.0) - minus(p.gender_conflict(query, title), 30.0)
    if brand is None:
        return out
    return out - minus(p.brand_conflict(brand, query, title), 60.0) - minus(p.model_conflict(query, title), 60.0)


def scored(pool: DataFrame, query: str, title: str, category: str, brand: str | None = None, substring: bool = False) -> DataFrame:
    """``pool`` with ``score``; rows of blank titles go.  Each distinct tuple of texts is scored once, by all cores, and joined
    by a sort merge: sizes of files say nothing about the number of tuples."""
    texts = [c for c in (query, title, category, brand) if c]
    clean = pool.withColumn(title, t.strip(F.col(title))).where(F.col(title) != "")
    distinct = spread(clean.select(*texts).distinct())
    form = F.lower if substring else t.for_fuzzy
    a, b = form(F.col(query)), form(F.col(title))
    base = (fuzzy.score("partial_ratio", a, b) + fuzzy.score("token_sort_ratio", a, b)) / 2
    own = distinct.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(texts)], (base + bonuses(F.col(query), F.col(title), F.col(category), F.col(brand) if brand else None, substring)).alias("score"))
    same = [F.col(c).eqNullSafe(F.col(f"_{k}")) for k, c in enumerate(texts)]
    out = clean.join(own.hint("merge"), same)
    return out.drop(*[f"_{k}" for k in range(len(texts))])


def grade(score: Column, source: str) -> Column:
    """exact, brand_line or skip by the source's thresholds."""
    exact, line = THRESHOLDS[source]
    return F.when(score >= exact, "exact").when(score >= line, "brand_line").otherwise("skip")


def pick_donor(pool: DataFrame, key: str, place: str, source: str) -> DataFrame:
    """The best scored card of each product and its grade; scores of 0 and less never win, the first of equals does."""
    # cut behind the rank: a filter before it would be pushed below the scoring and repeat it
    best = first_by(pool, [key], [F.desc("score"), F.col(place)]).where("score > 0")
    return best.withColumn("grade", grade(F.col("score"), source))


def type_fits(type_word: Column, labels: Column) -> Column:
    """Whether a card's type labels hold the asked type word or a form of it: five equal first letters or more, over at
    least 70 % of the shorter word.  Cards without labels and products without a type are not judged."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(labels, F.lit(""))), F.lit("[а-яёa-z]+"), F.lit(0)), lambda x: F.length(x) >= 3)
    own = F.lower(t.strip(type_word))
    need = lambda x: F.greatest(F.lit(5), F.ceil(F.least(F.length(own), F.length(x)) * 0.7 - 1e-9)).cast("int")
    same = lambda x: (own == x) | ((F.least(F.length(own), F.length(x)) >= need(x)) & (F.left(own, need(x)) == F.left(x, need(x))))
    return F.coalesce(own == "", F.lit(True)) | (F.size(words) == 0) | F.exists(words, same)


def pick_rich_donor(pool: DataFrame, key: str, place: str, query: str, title: str, type_word: str, labels: str, options: str, source: str = "wb_card") -> DataFrame:
    """Cards of the asked type first; of those that score enough the one that shares the article, then with most
    options, then the best; where none scores enough, the best one, as "skip".  Products whose cards are all of other types
    get none."""
    own = t.model_tokens(F.col(query))
    gated = pool.where(type_fits(F.col(type_word), F.col(labels)))
    rated = gated.withColumn("model_match", (F.size(own) == 0) | F.coalesce(F.arrays_overlap(own, t.model_tokens(F.col(title))), F.lit(False))).withColumn("grade", grade(F.greatest("score", F.lit(0.0)), source))
    fits = F.col("grade") != "skip"
    order = [F.desc(fits), F.desc(F.when(fits, F.col("model_match"))), F.desc(F.when(fits, F.col(options))), F.desc("score"), F.col(place)]
    return first_by(rated, [key], order)
