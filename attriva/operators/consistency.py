"""Defaults of a category and contradictions between a product's fields.

Both work on merged values (product_id, attribute_id, value_str, value_arr, is_list, value_id, confidence, source, evidence), one
row for each product and attribute.  The fields that a rule compares are brought together in one row a product, so a rule is
an expression and a product's rules need one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import text as t
from .windows import first_by

COLUMNS = ("product_id", "attribute_id", "value_str", "value_arr", "is_list", "value_id", "confidence", "source", "evidence")
# Pairs of fields that hold the same value, in order; the field by which sellers group cards
SAME_VALUE = ((4381, 9024), (9048, 12141), (9048, 9336))
CARD_GROUP = 8292
SURE, LIKELY = 0.85, 0.70


def _row(rows: DataFrame, merged: DataFrame, value: Column, value_id: Column, confidence: float, evidence: Column) -> DataFrame:
    put = {"value_str": value, "value_id": value_id, "confidence": F.lit(confidence), "source": F.lit("description"), "evidence": evidence, "value_arr": F.lit(None), "is_list": F.lit(False)}
    return rows.select(*[(put.get(c, F.col(c))).cast(kind).alias(c) for c, kind in merged.dtypes])


def category_defaults(merged: DataFrame, targets: DataFrame, products: DataFrame, defaults: DataFrame, conditional: DataFrame, pairs: tuple[tuple[int, int], ...] = SAME_VALUE, card_group: int = CARD_GROUP) -> DataFrame:
    """Merged values with the defaults of the product's category and with values that two fields share.

    ``targets``: (product_id, attribute_id, semantic_type); ``products``: (product_id, category_id, product_name);
    ``defaults``: (category_id, attribute_id, value, value_id) override what is there; ``conditional``: (category_id, rule_no,
    token, attribute_id, value), of the rules whose token stands in the form factor or the name the first fills what is
    empty; then each pair is filled in both directions, in order, each step seeing the ones before.  The card group is never
    kept.
    """
    wanted = targets.select("product_id", "attribute_id").distinct()
    category = products.select("product_id", "category_id", "product_name")
    fixed = wanted.join(category.select("product_id", "category_id").join(defaults, "category_id"), ["product_id", "attribute_id"]).select("product_id", "attribute_id", F.col("value").alias("_v"), F.col("value_id").alias("_i"))
    over = _row(fixed, merged, F.col("_v"), F.col("_i"), SURE, F.lit("category default (authoritative override)"))
    kept = merged.join(fixed.select("product_id", "attribute_id"), ["product_id", "attribute_id"], "left_anti")

    forms = targets.where("semantic_type = 'form_factor'").select("product_id", "attribute_id").distinct()
    said = kept.join(forms, ["product_id", "attribute_id"]).groupBy("product_id").agg(F.concat_ws(" ", F.collect_list(F.when(F.col("is_list"), F.array_join("value_arr", " ")).otherwise(F.col("value_str")))).alias("_said"))
    blob = category.join(said, "product_id", "left").select("product_id", "category_id", F.upper(F.concat_ws(" ", "_said", "product_name")).alias("_blob"))
    fits = blob.join(conditional.select("category_id", "rule_no", "token").distinct(), "category_id").where(F.contains("_blob", F.upper("token")))
    rule = first_by(fits.select("product_id", "category_id", "rule_no", "token"), ["product_id"], [F.col("rule_no")])
    put = rule.join(conditional.drop("token"), ["category_id", "rule_no"]).join(wanted, ["product_id", "attribute_id"])
    both = kept.unionByName(over)
    put = put.join(both.select("product_id", "attribute_id"), ["product_id", "attribute_id"], "left_anti")
    likely = _row(put.select("product_id", "attribute_id", F.col("value").alias("_v"), "token"), merged, F.col("_v"), F.lit(None), LIKELY, F.concat(F.lit("conditional default for form_factor="), F.col("token")))
    both = both.unionByName(likely)

    ids = sorted({x for pair in pairs for x in pair})
    value = F.struct(*[c for c in COLUMNS if c not in ("product_id", "attribute_id")])
    own = both.where(F.col("attribute_id").isin(*ids)).groupBy("product_id").agg(*[F.first(F.when(F.col("attribute_id") == x, value), True).alias(f"_v{x}") for x in ids])
    asked = wanted.where(F.col("attribute_id").isin(*ids)).groupBy("product_id").agg(*[F.max(F.col("attribute_id") == x).alias(f"_t{x}") for x in ids])
    wide = own.join(asked, "product_id")
    now = {x: F.col(f"_v{x}") for x in ids}
    for step, (a, b) in enumerate((s, e) for pair in pairs for s, e in (pair, pair[::-1])):
        copy = F.struct(*[(F.lit("cross-fill") if c == "evidence" else F.lit(None).cast(dict(merged.dtypes)[c]) if c == "value_id" else now[a][c]).alias(c) for c in COLUMNS if c not in ("product_id", "attribute_id")])
        has = now[a].isNotNull() & F.coalesce(now[a]["value_str"].isNotNull() | now[a]["value_arr"].isNotNull(), F.lit(False))
        wide = wide.withColumn(f"_s{step}", F.when(now[b].isNull() & F.col(f"_t{b}") & has, copy).otherwise(now[b]))
        now[b] = F.col(f"_s{step}")
    new = F.array_compact(F.array(*[F.when(F.col(f"_v{x}").isNull() & now[x].isNotNull(), F.struct(F.lit(x).cast(dict(merged.dtypes)["attribute_id"]).alias("attribute_id"), now[x].alias("v"))) for x in ids]))
    filled = wide.select("product_id", F.explode(new).alias("n")).select("product_id", "n.attribute_id", "n.v.*")
    return both.unionByName(filled.select(*merged.columns)).where(F.col("attribute_id") != card_group)


# How the compared fields are named, and what their values say
ROLES = {
    "bore": "диаметр.*бетон|бетон.*диаметр", "modes": r"режим\w*\s*работ", "kit": "комплектаци", "chuck": r"тип\s*патрон", "type": r"^\s*тип\*?\s*$",
    "size": "диагональ.*дюйм", "line": r"^линейка\b|линейка\s+(?:мобильных|устройств|товаров)",
}
IMPACT, IMPACT_MODE = "удар", "Сверление с ударом"
CHUCKS = (("ключевой", r"ключев\w*\s*патрон|патрон\w*\s*ключев|патрон\w*\s*ключ\b"), ("быстрозажимной", r"быстрозажимн\w*\s*патрон|патрон\w*\s*быстрозажимн"))
SDS, DRILL, HAMMER = r"\bsds\b", r"дрел\w*", r"перфоратор\w*|отбойн\w*\s*молот\w*"


def _has(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(f"(?iuU){pattern}"), F.lit(False))


def contradictions(merged: DataFrame, targets: DataFrame, products: DataFrame) -> DataFrame:
    """Merged values after five rules, each about the first target (by seq) of a name.

    A diameter in concrete means drilling with impact: the mode is added, or, where a model only knew the diameter, the modes
    go.  A chuck named in the kit decides over the chuck field, unless that has the better source.  A drill that is no hammer
    has no SDS chuck: the kit's one takes its place, or the value goes.  A display size or a line's generation that the
    product's name contradicts goes.
    """
    role = F.array_compact(F.array(*[F.when(_has(F.col("target_name"), pattern), F.lit(name)) for name, pattern in ROLES.items()]))
    first = first_by(targets.select("product_id", "attribute_id", "seq", F.explode(role).alias("role")), ["product_id", "role"], [F.col("seq")]).drop("seq")
    text = F.when(F.col("is_list"), F.array_join("value_arr", " ")).otherwise(F.col("value_str"))
    # sort merges: rows made from small files look small to the planner, which would send all of them through the driver
    found = first.join(merged.select("product_id", "attribute_id", text.alias("text"), "value_str", "value_arr", "is_list", "source", "evidence").hint("merge"), ["product_id", "attribute_id"])
    value = F.struct("attribute_id", "text", "value_str", "value_arr", "is_list", "source", "evidence")
    wide = found.groupBy("product_id").agg(*[F.first(F.when(F.col("role") == name, value), True).alias(name) for name in ROLES]).join(products.select("product_id", "product_name").hint("merge"), "product_id", "left")
    said = lambda name: F.when(F.col(name)["text"] != "", F.col(name)["text"])
    low = lambda c: F.translate(F.lower(c), "ё", "е")

    partial = said("bore").isNotNull() & said("modes").isNotNull() & ~_has(said("modes"), IMPACT)
    guess = F.col("bore")["source"] == "llm_knowledge"
    modes = F.concat(F.when(F.col("modes")["is_list"], F.col("modes")["value_arr"]).otherwise(F.array(F.col("modes")["value_str"])), F.array(F.lit(IMPACT_MODE)))

    named = F.array_compact(F.array(*[F.when(_has(low(said("kit")), pattern), F.lit(label)) for label, pattern in CHUCKS]))
    kit = F.when(F.size(named) == 1, named[0])
    lacks = lambda chuck: ~F.contains(low(chuck), F.left(kit, F.length(kit) - 2))
    chuck0 = F.col("chuck")["text"]
    outranked = model.priority(F.col("kit")["source"]) < model.priority(F.col("chuck")["source"])
    by_kit = F.coalesce(kit.isNotNull() & F.col("chuck").isNotNull() & lacks(F.coalesce(chuck0, F.lit(""))) & ~outranked, F.lit(False))
    chuck1 = F.when(by_kit, kit).otherwise(chuck0)
    plain_drill = _has(said("type"), DRILL) & ~_has(said("type"), HAMMER)
    no_sds = _has(chuck1, SDS) & plain_drill
    swapped = F.coalesce(no_sds & kit.isNotNull() & lacks(chuck1), F.lit(False))

    sizes = F.filter(F.transform(F.regexp_extract_all("product_name", F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int")), lambda x: (x >= 17) & (x <= 120))
    inch = F.regexp_extract(said("size"), r"^\s*(\d+)(?![.,]\d)", 1).try_cast("int")
    wrong_size = F.coalesce((F.size(sizes) > 0) & inch.isNotNull() & ~F.array_contains(sizes, inch), F.lit(False))

    parts = [F.regexp_extract(said("line"), r"(?s)^(.+?)\s*(\d{1,3})\s*$", k) for k in (1, 2)]
    line, own = low(t.strip(parts[0])), parts[1].try_cast("int")
    name = low(F.col("product_name"))
    # behind each occurrence of the line in the name, the first that a number follows
    behind = F.filter(F.transform(F.slice(F.split(name, F.concat(F.lit("\\Q"), line, F.lit("\\E"))), 2, 1000), lambda x: F.regexp_extract(x, r"(?U)^\s+(\d{1,3})", 1)), lambda x: x != "")
    wrong_line = F.coalesce((line != "") & own.isNotNull() & (F.try_element_at(behind, F.lit(1)).cast("int") != own), F.lit(False))

    note = lambda field, words: F.concat_ws(" | ", F.when(F.col(field)["evidence"] != "", F.col(field)["evidence"]), words if isinstance(words, Column) else F.lit(words))
    none, no_array = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    patch = lambda field, drop, text, array, words: F.struct(F.col(field)["attribute_id"].alias("attribute_id"), F.lit(drop).alias("drop"), text.alias("v"), array.alias("a"), note(field, words).alias("e"))
    patches = F.array_compact(F.array(
        F.when(partial & guess, patch("modes", True, none, no_array, "dropped")).when(partial, patch("modes", False, none, modes, "added the impact mode")),
        F.when(no_sds & ~swapped, patch("chuck", True, none, no_array, "dropped")).when(no_sds | by_kit, patch("chuck", False, kit, no_array, "corrected by the kit")),
        F.when(wrong_size, patch("size", True, none, no_array, "dropped")), F.when(wrong_line, patch("line", True, none, no_array, "dropped")),
    ))
    todo = wide.select("product_id", F.explode(patches).alias("p")).select("product_id", "p.*")
    joined = merged.join(todo.hint("merge"), ["product_id", "attribute_id"], "left").where("drop is null or not drop")
    is_new = F.col("drop").isNotNull()
    put = {"value_str": F.col("v"), "value_arr": F.col("a"), "is_list": F.col("a").isNotNull(), "evidence": F.col("e")}
    return joined.select(*[F.when(is_new, put[c]).otherwise(F.col(c)).alias(c) if c in put else F.col(c) for c in merged.columns])
