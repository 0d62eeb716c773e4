"""The brand that a title names (G1): dictionary brands as runs of words, noise left out, the asked brand as a fall-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .predicates import is_brand_target
from .windows import first_by, maximal_spans

# Fixed value: adjective endings
ADJECTIVE = "(?:ые|ие|ая|яя|ое|ее|ый|ий|ой|ому|ему|ыми|ими|ых|их|ую|юю|ого|его|ым|им)$"
EVIDENCE, CONFIDENCE = "brand_from_name", 0.95


def is_adjective(word: Column) -> Column:
    """One Cyrillic word of six letters or more with an adjective's ending."""
    return (F.length(word) >= 6) & F.lower(word).rlike("^[а-яё]+$") & F.translate(F.lower(word), "ё", "е").rlike(ADJECTIVE)


def stems(words: Column) -> Column:
    """First five letters of the words of three letters or more."""
    return F.transform(F.filter(words, lambda w: F.length(w) >= 3), lambda w: F.left(w, F.lit(5)))


def title_brands(titles: DataFrame, brands: DataFrame) -> DataFrame:
    """(product_id, brand, value_id, origin) for (product_id, title, brand, category_path), ``brand`` being the asked one.

    Dictionary brands (brand, value_id, seq) of three letters or more are met by an equi-join on their first word, in their
    own form or without apostrophes and dashes; of nested matches the longest stays; single words that tell a gender, the
    leaf category or a property are no brands; the leftmost of the others wins (dictionary).  Where none is left, the asked
    brand stays if the title holds it and it is no category word, gender or adjective (needle).
    """
    words = t.brand_tokens(F.coalesce("title", F.lit("")))
    own = titles.select("product_id", F.col("brand").alias("_asked"), "category_path", words.alias("_w")).where(F.size("_w") > 0)
    form = lambda rank, c: F.struct(F.lit(rank).alias("rank"), c.alias("words"))
    forms = F.array(form(0, t.brand_tokens(F.col("brand"))), form(1, t.canon_tokens(F.col("brand"))))
    listed = brands.select("brand", "value_id", "seq", t.brand_tokens(F.col("brand")).alias("_key"), F.explode(forms).alias("_f")).select("brand", "value_id", "seq", "_key", "_f.rank", F.col("_f.words").alias("_b"))
    listed = listed.where((F.length(F.array_join("_b", "")) >= 3) & (F.length(F.array_join("_key", "")) >= 3) & ((F.col("rank") == 0) | (F.col("_b") != F.col("_key")))).withColumn("_first", F.element_at("_b", 1))
    asked = own.select("product_id", "_w", "category_path", F.explode(F.array_distinct("_w")).alias("_first"))
    hits = asked.join(listed, "_first").where(t.phrase_in(F.col("_b"), F.col("_w"))).withColumn("s", t.phrase_start(F.col("_b"), F.col("_w"))).withColumn("e", F.col("s") + F.size("_b"))
    formed = first_by(hits, ["product_id", "brand"], [F.col("rank"), F.col("seq")])
    spans = first_by(formed, ["product_id", "_key"], [F.col("s") - F.col("e"), F.col("seq")])
    leaf = stems(t.brand_tokens(F.coalesce(F.try_element_at("category_path", F.lit(-1)), F.lit(""))))
    marked = spans.withColumn("noise", (F.col("e") - F.col("s") == 1) & (F.coalesce(t.card_gender(F.element_at("_b", 1)).isNotNull() | is_adjective(F.element_at("_b", 1)), F.lit(False)) | F.array_contains(leaf, F.left(F.element_at("_b", 1), F.lit(5)))))
    per = marked.groupBy("product_id").agg(F.collect_list(F.struct("s", "e", "brand", "value_id", "seq", "noise")).alias("m"))
    kept = per.select("product_id", F.explode(maximal_spans(F.col("m"))).alias("x")).where("not x.noise").select("product_id", "x.s", "x.seq", "x.brand", "x.value_id")
    found = first_by(kept, ["product_id"], [F.col("s"), F.col("seq")]).select("product_id", "brand", "value_id", F.lit("dictionary").alias("origin"))
    name, canon = t.brand_tokens(F.col("_asked")), t.canon_tokens(F.col("_asked"))
    long_enough = F.length(F.array_join(name, "")) >= 2
    path = F.flatten(F.transform(F.coalesce("category_path", F.array().cast("array<string>")), t.brand_tokens))
    meant = stems(name)
    category = (F.size(meant) > 0) & F.forall(meant, lambda w: F.array_contains(stems(path), w))
    noise = category | t.card_gender(F.col("_asked")).isNotNull() | is_adjective(t.strip(F.col("_asked")))
    needle = own.where(long_enough & (t.phrase_in(name, F.col("_w")) | t.phrase_in(canon, F.col("_w"))) & ~F.coalesce(noise, F.lit(False))).join(found.select("product_id"), "product_id", "left_anti")
    return found.unionByName(needle.select("product_id", t.strip(F.col("_asked")).alias("brand"), F.lit(None).cast(dict(found.dtypes)["value_id"]).alias("value_id"), F.lit("needle").alias("origin")))


def brand_from_name(merged: DataFrame, targets: DataFrame, found: DataFrame) -> DataFrame:
    """G1: ``merged`` (product_id, attribute_id, value_str, value_id, confidence, source, evidence) with the title's brand in
    every brand target (product_id, attribute_id, target_name): empty ones are filled, other values overwritten; a value that
    is the brand but for its case stays as it is."""
    same = lambda c: F.translate(F.lower(t.strip(c)), "ё", "е")
    own = targets.where(is_brand_target(F.col("attribute_id"), F.col("target_name"))).select("product_id", "attribute_id").distinct().join(found.select("product_id", F.col("brand").alias("_brand"), F.col("value_id").alias("_id")), "product_id")
    joined = merged.join(own, ["product_id", "attribute_id"], "full")
    new = F.col("_brand").isNotNull() & ~F.coalesce(same(F.col("value_str")) == same(F.col("_brand")), F.lit(False))
    put = {"value_str": F.col("_brand"), "value_id": F.col("_id"), "confidence": F.lit(CONFIDENCE), "source": F.lit("description"), "evidence": F.lit(EVIDENCE)}
    return joined.select(*[F.when(new, put[c]).otherwise(F.col(c)).alias(c) if c in put else F.col(c) for c in merged.columns])
