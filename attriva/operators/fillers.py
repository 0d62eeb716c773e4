"""Row generators for empty targets.

Each takes targets with a product's texts (product_id, attribute_id, target_name, allowed_values, product_name, ...) that
have no value yet and returns candidates (product_id, attribute_id, value_str, confidence, source, evidence).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as n
from ..functions import text as t
from .windows import first_by, maximal_spans


def _filled(rows: DataFrame, value: Column, confidence: float, evidence: str, source: str = "description") -> DataFrame:
    return rows.where(value.isNotNull()).select("product_id", "attribute_id", value.alias("value_str"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"), F.lit(evidence).alias("evidence"))


def brand_in_title(titles: DataFrame, brands: DataFrame, key: str, title: str) -> DataFrame:
    """The dictionary brand in a title: longest of nested matches, then leftmost; one-word adjectives never.

    Brands are found by an equi-join on their first word, so titles and brands never meet all against all.
    """
    words = t.brand_tokens(F.col(title))
    dictionary = brands.select("brand", t.brand_tokens(F.col("brand")).alias("_b")).where((F.size("_b") > 0) & (F.length(F.array_join("_b", "")) >= 3)).withColumn("_first", F.element_at("_b", 1)).distinct()
    asked = titles.select(key, words.alias("_w")).withColumn("_first", F.explode(F.array_distinct("_w")))
    hits = asked.join(dictionary, "_first").where(t.phrase_in(F.col("_b"), F.col("_w")))
    spans = hits.select(key, "brand", t.phrase_start(F.col("_b"), F.col("_w")).alias("s"), F.size("_b").alias("_n"), "_b")
    adjective = (F.col("_n") == 1) & F.element_at("_b", 1).rlike("^[а-я]+(?:ый|ий|ой|ая|яя|ое|ее|ые|ие)$")
    per = spans.where(~adjective).groupBy(key).agg(F.collect_list(F.struct("s", (F.col("s") + F.col("_n")).alias("e"), "brand")).alias("m"))
    kept = per.select(key, F.explode(maximal_spans(F.col("m"))).alias("x")).select(key, "x.brand", "x.s")
    return first_by(kept, [key], [F.col("s"), F.col("brand")])


def brand_from_context(rows: DataFrame) -> DataFrame:
    """The product's own brand, where it is one of the target's values."""
    found = F.try_element_at(F.filter("allowed_values", lambda v: t.norm(v) == t.norm(F.col("brand"))), F.lit(1))
    return _filled(rows, found, 0.9, "brand_from_name")


def only(values: Column) -> Column:
    """The one distinct element; null for none or several."""
    return F.when(F.size(F.array_distinct(values)) == 1, F.element_at(values, 1))


def color_from_name(rows: DataFrame) -> DataFrame:
    """The one allowed colour all of whose stems stand in the title."""
    stems = F.transform(t.brand_tokens(F.col("product_name")), t.color_stem)
    found = F.filter("allowed_values", lambda v: (F.size(t.brand_tokens(v)) > 0) & F.forall(t.brand_tokens(v), lambda w: F.array_contains(stems, t.color_stem(w))))
    return _filled(rows, only(found), 0.80, "color_from_name")


def type_from_category(rows: DataFrame) -> DataFrame:
    """The one allowed type whose stems equal the category leaf's; stems stand in for lemmas."""
    stem = lambda c: F.transform(t.brand_tokens(c), lambda w: F.left(w, F.greatest(F.length(w) - 2, F.lit(3))))
    found = F.filter("allowed_values", lambda v: stem(v) == stem(F.col("category_leaf")))
    return _filled(rows, only(found), 0.90, "type_from_category")


def size_from_name(rows: DataFrame) -> DataFrame:
    """The allowed sizes that the title's size stands for, if that is one."""
    size = n.size_from_text(F.col("product_name"))
    found = F.filter("allowed_values", lambda v: F.array_contains(n.sizes(size), v) | (F.upper(v) == size))
    return _filled(rows, only(found), 0.80, "size_from_name")


def title_echo(rows: DataFrame) -> DataFrame:
    """The title itself for name targets."""
    return _filled(rows.where(F.lower("target_name").isin("название", "наименование", "name", "title")), F.col("product_name"), 0.95, "title_echo")


def model_from_title(rows: DataFrame) -> DataFrame:
    """The title without a leading brand."""
    rest = t.strip(F.when(F.startswith(F.lower("product_name"), F.lower("brand")), F.substring(F.col("product_name"), F.length("brand") + 1, F.lit(1000))))
    return _filled(rows, F.when(rest != "", rest), 0.90, "model_from_title")


def spec_from_title(rows: DataFrame) -> DataFrame:
    """The one allowed value of three letters or more that stands in the title as a phrase."""
    words = t.brand_tokens(F.col("product_name"))
    found = F.filter("allowed_values", lambda v: (F.length(v) >= 3) & t.phrase_in(t.brand_tokens(v), words))
    return _filled(rows, only(found), 0.90, "spec_from_title")


def number_from_text(rows: DataFrame) -> DataFrame:
    """The number before the target's unit within 40 characters after its keyword."""
    pattern = F.concat(F.lit("(?iu)"), F.col("keyword"), F.lit(r"[^0-9]{0,40}?([0-9]+(?:[.,][0-9]+)?)\s*"), F.col("unit"), F.lit("(?![а-яёa-z])"))
    got = F.call_function("regexp_extract", F.col("text"), pattern, F.lit(1))
    return _filled(rows, F.when(got != "", F.replace(got, F.lit(","), F.lit("."))), 0.97, "numspec:")


def stated_boolean(rows: DataFrame) -> DataFrame:
    """Yes where the text states the keyword unnegated; never no."""
    said = F.regexp_like(F.col("text"), F.concat(F.lit(r"(?iu)(?<!без )(?<!не )(?<!нет )(?<![\p{L}])"), F.col("keyword")))
    return _filled(rows, F.when(said, "Да"), 0.97, "bool:stated:")


def kit_contents(rows: DataFrame) -> DataFrame:
    """What follows a contents heading up to the end of the line."""
    got = F.regexp_extract("text", r"(?iu)(?:комплект(?:ация| поставки)?|в комплекте|package contents)\s*:\s*([^\n.]{3,300})", 1)
    return _filled(rows, F.when(got != "", t.strip(got)), 0.97, "kit:")


def cross_fill(rows: DataFrame, aliases: tuple[str, ...]) -> DataFrame:
    """Empty alias targets of a product take the value of the one alias that is filled; ``rows`` has value_str, null: empty."""
    own = rows.where(F.lower("target_name").isin(*aliases))
    known = own.where("value_str is not null").groupBy("product_id").agg(F.collect_set("value_str").alias("_v")).where(F.size("_v") == 1)
    return _filled(own.where("value_str is null").drop("value_str").join(known, "product_id"), F.element_at("_v", 1), 0.97, "alias:")


def defaults(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Category defaults; rules (category_id, attribute_id, when_contains, value, rule_no), the first that fits; they override."""
    joined = rows.join(rules, ["category_id", "attribute_id"]).where(F.col("when_contains").isNull() | F.contains(F.lower("product_name"), F.lower("when_contains")))
    best = first_by(joined.select("product_id", "attribute_id", "value", "when_contains", "rule_no"), ["product_id", "attribute_id"], [F.col("rule_no")])
    sure = F.when(F.col("when_contains").isNull(), 0.70).otherwise(0.85)
    return best.select("product_id", "attribute_id", F.col("value").alias("value_str"), sure.alias("confidence"), F.lit("description").alias("source"), F.lit("category_default").alias("evidence"))


def annotation_sentences(rows: DataFrame, text: str, grounding: str) -> DataFrame:
    """The text without sentences that hold a number the grounding text lacks."""
    numbers = lambda s: F.regexp_extract_all(s, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0))
    sentences = F.split(F.col(text), r"(?<=[.!?])\s+")
    kept = F.filter(sentences, lambda s: F.forall(numbers(s), lambda x: F.contains(F.col(grounding), x)))
    return rows.withColumn(text, F.array_join(kept, " "))


def gender_fallback(rows: DataFrame) -> DataFrame:
    """The dictionary form of the title's gender for required gender targets."""
    signal = t.gender_signal(F.col("product_name"))
    form = F.when(signal == "male", "Мужской").when(signal == "female", "Женский")
    return _filled(rows.where("is_required"), form, 0.75, "gender_from_name")


def backfill_options(targets: DataFrame, dictionary: DataFrame, most: int = 512) -> DataFrame:
    """Allowed values of targets without any, from dictionaries of fewer than ``most`` values."""
    sizes = dictionary.groupBy("attribute_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < most)
    options = dictionary.join(sizes, "attribute_id").groupBy("attribute_id").agg(F.array_sort(F.collect_set("value")).alias("_options"))
    joined = targets.join(options, "attribute_id", "left")
    return joined.withColumn("allowed_values", F.coalesce("allowed_values", "_options")).drop("_options")
