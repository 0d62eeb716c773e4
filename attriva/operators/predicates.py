"""Filters and guards over candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import model
from ..functions import fuzzy
from ..functions import text as t
from ..functions.numeric import trailing_unit

# Patterns of target names by kind
_MODEL = r"(?i)(название\s+модели|артикул|model\s*name|партномер|partnumber|sku|\bmodel\b|модел[ьяи])"
_DIMENSION = r"(?i)(длина|высота|ширина|глубина|размер|габарит|см\b|мм\b)"
_NUMERIC_TYPES = ("Integer", "Decimal", "numeric", "integer", "decimal", "Float", "float")
_BOOLEAN_TYPES = ("Boolean", "boolean", "bool")
_URL_TYPES = ("URL", "url", "Url")
# Leaves and their name patterns, in order of trial
NUMERIC_LEAVES = (
    ("capacity", r"объём|объем|ёмкость|емкость|capacity|памят[ьи]|memory|storage|содержим|нетто|наполнени|мл\b|литр|litre|liter"),
    ("composite_aggregation", r"суммарн|total|совокупн|общий\s+объём|общий\s+объем|комплект|набор\s+из|bundle|multipack"),
    ("angular_dimension", r"угол|angle|градус|degree|поворот|наклон|обзор|fov|field of view"),
    ("surface_area", r"площадь|area|поверхность|кв\.?\s*[мм]|м²|кв\s*м"),
    ("biometric_dimension", r"обхват|обхвата|охват|рост|размер\s+одежды|размер\s+обуви|голова|талия|бедра|грудь|биометр|ergono|wrist|waist|hip|chest|head"),
    ("radial_dimension", "диагональ|диаметр|радиус|diagonal|diameter|radius|дюйм\\b|inch\\b|\""),
    ("quantification", r"количество|кол-во|count|штук|число|шт\b|pcs\b|pieces|комплектация|в\s+комплекте|в\s+упаковке|в\s+наборе"),
    ("physical_magnitude", r"мощность|power|напряжение|voltage|ток\b|current|частота|frequency|давление|pressure|температур|luminance|яркость|luminosity|сила\s+света|интенсивность|интенс|вт\b|ватт|ампер|вольт|герц|дб\b|децибел|вт/кг|dbm\b|sar\b"),
)
TEXT_LEAVES = (
    ("material", r"материал|состав|ткань|fabric|material|substance|покрытие|наполнитель|сырьё|сырье|пропитка|отделка|подошва|подкладка|верх изделия|внешн|внутрен"),
    ("brand", r"бренд|brand|производитель|manufacturer|торговая марка|марка"),
    ("context_filter", r"совместим|compatible|подходит\s+для|подходящ|applies\s+to"),
    ("configuration", r"конфигурац|ориентац|интерфейс|разъём|разъем|connector|port\b|протокол|стандарт|format\b|форм-фактор|form.factor|режим|mode\b|ручной|левш|правш"),
)
# Signs of an objective specification
SPEC_SEMANTIC_TYPES = (
    "material", "material_composition", "composition", "fabric", "fabric_composition", "weight", "net_weight", "gross_weight", "dimensions", "temperature",
    "thermal", "frequency", "power", "voltage", "capacity", "volume", "resolution", "connectivity", "interface", "audio_config", "channel_config", "feature_bool", "boolean_feature",
)
SPEC_NAME_PARTS = (
    "материал", "состав", "подкладк", "интерфейс", "тип подключения", "разъём", "разъем", "звуковая схема", "звуковая система", "акустическая система",
    "количество каналов", "аудиоканал", "конфигурация каналов", "true wireless", "активное шумоподавление", "шумоподавлен",
)
# Names of customs-code fields, and of fields free of the membership guard
CUSTOMS_NAMES = ("тн вэд", "тнвэд", "еаэс")
GUARD_FREE_NAMES = (*CUSTOMS_NAMES, "бренд")
BRAND_ATTRIBUTE = 31


def _any(name: Column, pattern: str) -> Column:
    return F.coalesce(name.rlike(f"(?iuU)({pattern})"), F.lit(False))


def is_critical(semantic_type: Column) -> Column:
    return F.coalesce(F.lower(semantic_type).isin(*model.CRITICAL_SEMANTIC_TYPES), F.lit(False))


def is_confident(confidence: Column, source: Column, semantic_type: Column) -> Column:
    """at or over the source's threshold and not of a critical type; unknown types count as not critical."""
    return F.coalesce(confidence >= model.threshold(source), F.lit(False)) & ~is_critical(semantic_type)


def remaining_targets(targets: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """targets without a confident value."""
    done = candidates.where(is_confident(F.col("confidence"), F.col("source"), F.col("semantic_type"))).select(*keys).distinct()
    return targets.join(done, keys, "left_anti")


def unfilled_targets(targets: DataFrame, filled: DataFrame, keys: list[str], least: float = 0.85) -> DataFrame:
    """targets without a value of confidence ``least`` or more."""
    return targets.join(filled.where(F.col("confidence") >= least).select(*keys).distinct(), keys, "left_anti")


def target_kind(name: Column, kind: Column, has_values: Column) -> Column:
    """enum, model_name, url, boolean, dimensions, numeric or text."""
    number = kind.isin(*_NUMERIC_TYPES) | trailing_unit(name).isNotNull()
    return (
        F.when(has_values, "enum").when(_any(name, _MODEL[4:]), "model_name").when(kind.isin(*_URL_TYPES), "url").when(kind.isin(*_BOOLEAN_TYPES), "boolean")
        .when(number & _any(name, _DIMENSION[4:]), "dimensions").when(number, "numeric").otherwise("text")
    )


def target_leaf(name: Column, kind: Column) -> Column:
    """the routing leaf of a target of a given kind."""
    number = F.when(F.lit(False), "")
    for leaf, pattern in NUMERIC_LEAVES:
        number = number.when(_any(name, pattern), leaf)
    number = number.when(kind == "dimensions", "radial_dimension").otherwise("numeric")
    words = F.when(F.lit(False), "")
    for leaf, pattern in TEXT_LEAVES:
        words = words.when(_any(name, pattern), leaf)
    return F.when(kind.isin("numeric", "dimensions"), number).otherwise(words.otherwise("classification"))


def positive(candidates: DataFrame) -> DataFrame:
    """confidence over 0."""
    return candidates.where(F.col("confidence") > 0)


def is_brand_target(attribute_id: Column, name: Column) -> Column:
    """F11."""
    return (attribute_id == BRAND_ATTRIBUTE) | _any(name, r"бренд|brand|торгов\w*\s+марк")


def brand_guard(joined: DataFrame) -> DataFrame:
    """brand values of guessing sources go; ``joined`` has target_name."""
    return joined.where(~(is_brand_target(F.col("attribute_id"), F.col("target_name")) & F.col("source").isin(*model.BRAND_GUESSING)))


def is_color_target(semantic_type: Column, name: Column) -> Column:
    """F13."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.coalesce(F.lower(semantic_type) == "color", F.lit(False)) | (F.contains(low, F.lit("цвет")) & ~F.contains(low, F.lit("название")))


def is_palette(value: Column, values: Column, value_ids: Column) -> Column:
    """two colours or more, as list, as ids or in one text."""
    parts = F.filter(F.split(F.coalesce(value, F.lit("")), "[;,/]"), lambda x: F.trim(x) != "")
    return (F.coalesce(F.size(values), F.lit(0)) >= 2) | (F.coalesce(F.size(value_ids), F.lit(0)) >= 2) | (F.size(parts) >= 2)


def color_guard(joined: DataFrame) -> DataFrame:
    """colours come from the description only, and one at a time."""
    color = is_color_target(F.col("semantic_type"), F.col("target_name"))
    return joined.where(~(color & ((F.col("source") != "description") | is_palette(F.col("value_str"), F.col("value_arr"), F.col("value_ids")))))


def gender_guard(elements: DataFrame, guessing: tuple[str, ...]) -> DataFrame:
    """Gender elements (product_id, attribute_id, element, source, name_gender) that survive.

    A title of one gender drops elements of the other; a neutral title drops elements that only guessing sources back.
    """
    own = t.gender_signal(F.col("element"))
    support = elements.groupBy("product_id", "attribute_id", "element").agg(F.min(F.col("source").isin(*guessing).cast("int")).alias("_guessed"))
    joined = elements.join(support, ["product_id", "attribute_id", "element"]).withColumn("_own", own)
    name = F.col("name_gender")
    drop = F.col("_own").isin("male", "female") & F.when(name.isin("male", "female"), F.col("_own") != name).when(name.isNull(), F.col("_guessed") == 1).otherwise(False)
    return joined.where(~F.coalesce(drop, F.lit(False))).drop("_own", "_guessed")


def is_objective_spec(semantic_type: Column, kind: Column, name: Column) -> Column:
    """F15."""
    out = F.coalesce(F.lower(semantic_type).isin(*SPEC_SEMANTIC_TYPES), F.lit(False)) | F.coalesce(kind.isin("bool", "numeric"), F.lit(False))
    for part in SPEC_NAME_PARTS:
        out = out | F.coalesce(F.contains(F.lower(name), F.lit(part)), F.lit(False))
    return out


def corroborated(candidates: DataFrame, is_spec: Column, keys: list[str], value: str = "value_str") -> DataFrame:
    """Spec values of model knowledge and neighbours stay only with an authoritative source of equal value."""
    normal = candidates.withColumn("_norm", t.for_corroboration(F.col(value)))
    backed = normal.where(F.col("source").isin(*model.AUTHORITATIVE)).select(*keys, "_norm").distinct().withColumn("_backed", F.lit(True))
    joined = normal.join(backed, [*keys, "_norm"], "left")
    doubtful = is_spec & F.col("source").isin("llm_knowledge", "competitor_rag")
    return joined.where(~doubtful | F.coalesce("_backed", F.lit(False))).drop("_norm", "_backed")


def confirmed(candidates: DataFrame, verdicts: DataFrame, is_spec: Column, keys: list[str]) -> DataFrame:
    """non-spec values need a confirming verdict; none counts as no."""
    v = verdicts.groupBy(*keys).agg(F.max(F.col("confirmed").cast("int")).alias("_ok"))
    return candidates.join(v, keys, "left").where(is_spec | (F.coalesce("_ok", F.lit(0)) == 1)).drop("_ok")


def grounded(value: Column, evidence: Column) -> Column:
    """a token of three letters or more stands in the evidence; no evidence, yes/no values and short values pass."""
    low = t.for_corroboration(value)
    tokens = F.filter(t.brand_tokens(low), lambda x: F.length(x) >= 3)
    text = F.translate(F.lower(evidence), "ё", "е")
    passes = (F.coalesce(evidence, F.lit("")) == "") | low.isin("да", "нет") | (F.size(tokens) == 0)
    return F.coalesce(passes | F.exists(tokens, lambda x: F.contains(text, x)), F.lit(True))


def grounded_elements(values: Column, evidence: Column) -> Column:
    """F18 for lists: the elements that are grounded; null: none."""
    kept = F.filter(values, lambda x: grounded(x, evidence))
    return F.when(F.size(kept) > 0, kept)


def without_placeholders(joined: DataFrame) -> DataFrame:
    """scalar values that say nothing, of fields with options."""
    return joined.where(~(F.coalesce(F.size("allowed_values") > 0, F.lit(False)) & ~F.coalesce(F.col("is_list"), F.lit(False)) & F.coalesce(t.is_placeholder(F.col("value_str")), F.lit(False))))


def customs_guard(joined: DataFrame) -> DataFrame:
    """customs codes of model knowledge and web go unless the resolver marked them."""
    low, marked = F.lower(F.coalesce("target_name", F.lit(""))), F.startswith(F.coalesce("evidence", F.lit("")), F.lit("tnved_resolver:"))
    customs = F.lit(False)
    for name in CUSTOMS_NAMES:
        customs = customs | F.contains(low, F.lit(name))
    return joined.where(~(customs & F.col("source").isin("llm_knowledge", "web_search") & ~marked))


def abstain_lone_guesses(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """a collection value of model knowledge that is its attribute's only candidate goes."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return candidates.withColumn("_n", n).where(~((F.col("source") == "llm_knowledge") & F.col("is_collection") & (F.col("_n") == 1))).drop("_n")


def membership_guard(joined: DataFrame, scalar_least: float = 85.0, member_least: float = 80.0) -> DataFrame:
    """values of fields with a list of options become the option they name, or go.

    A scalar names an option by equal text, by equal strong form, or by the best weighted score of ``scalar_least`` or more; a
    list's elements by equal strong form or the best token-set score of ``member_least`` or more, each option once, and a list
    that changes loses its ids.  Customs codes, brands, resolver evidence and fields without options pass as they are.
    """
    name, options = F.lower(F.coalesce("target_name", F.lit(""))), F.col("allowed_values")
    free = (F.coalesce(F.size(options), F.lit(0)) <= 0) | F.startswith(F.coalesce("evidence", F.lit("")), F.lit("tnved_resolver:"))
    for part in GUARD_FREE_NAMES:
        free = free | F.contains(name, F.lit(part))
    trimmed = lambda x: F.lower(F.trim(x))
    is_list = F.coalesce("is_list", F.lit(False))
    shaped = joined.withColumns({"_free": free, "_list": is_list, "_vals": F.when(is_list, F.col("value_arr")).otherwise(F.array("value_str"))})
    strong = lambda xs: F.when(~F.col("_free"), F.transform(xs, lambda x: t.strong_token(trimmed(x))))
    shaped = shaped.withColumns({"_low": F.transform(options, trimmed), "_strong": strong(options), "_asked": strong("_vals")})
    place = lambda xs, v: F.nullif(F.array_position(xs, v), F.lit(0)).cast("int")
    exact = F.transform("_vals", lambda v, i: F.when(trimmed(v) != "", F.coalesce(F.when(~F.col("_list"), place(F.col("_low"), trimmed(v))), F.when(F.get("_asked", i) != "", place(F.col("_strong"), F.get("_asked", i))))))
    shaped = shaped.withColumn("_exact", exact)
    open_ = ~F.col("_free") & F.exists("_exact", lambda x: x.isNull())
    scorer, least = F.when(F.col("_list"), "token_set_ratio").otherwise("weighted_ratio"), F.when(F.col("_list"), member_least).otherwise(scalar_least)
    shaped = shaped.withColumn("_near", fuzzy.best_places(F.when(open_, F.col("_asked")), F.when(open_, F.col("_strong")), scorer, least))
    at = F.filter(F.transform("_exact", lambda x, i: F.coalesce(x, F.get("_near", i))), lambda x: x.isNotNull())
    # the first place of each option, whatever its case
    first = F.array_distinct(F.transform(at, lambda x: F.array_position("_low", F.get("_low", x - 1)).cast("int")))
    shaped = shaped.withColumn("_named", F.transform(first, lambda x: F.get(options, x - 1))).where(F.col("_free") | (F.size("_named") > 0))
    lists, scalars = ~F.col("_free") & F.col("_list"), ~F.col("_free") & ~F.col("_list")
    out = shaped.withColumn("value_ids", F.when(lists & (F.col("_named") != F.col("value_arr")), F.lit(None)).otherwise(F.col("value_ids")))
    out = out.withColumns({"value_arr": F.when(lists, F.col("_named")).otherwise(F.col("value_arr")), "value_str": F.when(scalars, F.get("_named", F.lit(0))).otherwise(F.col("value_str"))})
    return out.drop("_free", "_list", "_vals", "_low", "_strong", "_asked", "_exact", "_near", "_named")


# Names of hard facts, in order of trial, and sources that fetch what they report
HARD_FACTS = (
    ("COUNTRY", r"стран|изготовител|производител"),
    ("PERIOD", r"срок\s+годност|срок\s+служб|гарант"),
    ("COMPOSITION", r"состав|содержание|материал"),
    ("SPEC", r"процессор|чипсет|видеопроцессор|ёмкост|мач|мощност|вт\b|\bIP\b|степень\s+защит|bluetooth|wi.?fi|wifi|оборот|всасыван|паскал|разрешение\s+камер|питани|напряжени|вилка|обод|покрышк|тип\s+пронаци"),
)
RETRIEVAL = ("web_search", "icecat", "pdf_datasheet", "ozon_card", "wb_card", "competitor_rag", "lamoda", "yandex_market", "web_marketplace", "ugc", "vision")
CUSTOMS_ATTRIBUTE = 22232


def hard_fact_class(name: Column) -> Column:
    """country, period, composition or spec; null: none of them."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(HARD_FACTS):
        out = F.when(_words(name, pattern), kind).otherwise(out)
    return out


def salient(value: Column) -> Column:
    """The part of a value that must be found: its first number with the word behind it, else the whole; lower case, without
    blanks, dots and commas."""
    number = F.regexp_extract(value, r"(?iu)\d[\d.,\s]*[а-яёa-z]+", 0)
    return F.regexp_replace(F.lower(F.when(number != "", number).otherwise(value)), r"[\s,.]", "")


def hard_fact_guard(joined: DataFrame, text: Column, model_text: Column | None = None, keys: tuple[str, ...] = ("product_id",)) -> DataFrame:
    """drops hard facts that nothing supports; customs codes are exempt.

    Sources that infer must find the salient part of a hard fact in ``text``; a country that they name always goes.  Of the
    sources that fetch, only a web search's country is doubted: two hosts must name it (its evidence starts with the address
    in brackets), or its evidence must hold a word of ``model_text``.
    """
    name, source = F.coalesce("target_name", "semantic_type", F.lit("")), F.col("source")
    fact, token = hard_fact_class(name), salient(F.coalesce("value_str", F.lit("")))
    long_enough = F.length(token) >= 2
    found = long_enough & F.contains(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s,.]", ""), token)
    searched = (fact == "COUNTRY") & (source == "web_search")
    where = F.regexp_extract(F.coalesce("evidence", F.lit("")), r"^\[([^\]]+)\]", 1)
    host = F.when(searched & (where != ""), F.coalesce(F.nullif(F.regexp_extract(where, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")), where))
    same = Window.partitionBy(*keys, "attribute_id", "_token", "_searched")
    plain = lambda c: F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё", "е")
    words = F.regexp_extract_all(plain(model_text if model_text is not None else F.lit("")), F.lit(r"[а-яa-z0-9]{3,}"), F.lit(0))
    beside = F.exists(words, lambda w: F.contains(plain(F.col("evidence")), w))
    marked = joined.withColumns({"_fact": fact, "_token": token, "_searched": F.coalesce(searched, F.lit(False)), "_host": host, "_found": found, "_beside": beside})
    hosts = F.min("_host").over(same) < F.max("_host").over(same)
    keep = (
        F.when(F.col("attribute_id") == CUSTOMS_ATTRIBUTE, True)
        .when(F.col("_searched"), (F.length("_token") >= 2) & (F.coalesce(F.col("_hosts"), F.lit(False)) | F.col("_beside")))
        .when(F.col("_fact").isNull() | source.isin(*RETRIEVAL), True).when(F.col("_fact") == "COUNTRY", False).otherwise(F.col("_found"))
    )
    return marked.withColumn("_hosts", hosts).where(keep).drop("_fact", "_token", "_searched", "_host", "_hosts", "_found", "_beside")


def country_hosts(found: DataFrame, keys: list[str], url: str, least: int = 2) -> DataFrame:
    """Keys that distinct hosts name, at least ``least`` of them, with their number."""
    return found.withColumn("_host", t.host(F.col(url))).where("_host is not null").groupBy(*keys).agg(F.count_distinct("_host").alias("n_hosts")).where(F.col("n_hosts") >= least)


def drop_unresolved(joined: DataFrame, required: bool) -> DataFrame:
    """enum values without dictionary ids; lists are cut to the number of resolved ids; customs codes are exempt."""
    customs = F.lit(False)
    for name in CUSTOMS_NAMES:
        customs = customs | F.contains(F.lower(F.coalesce("target_name", F.lit(""))), F.lit(name))
    n = F.coalesce(F.size("value_ids"), F.lit(0))
    inside = F.coalesce(F.col("has_values"), F.lit(False)) & ~customs & (F.col("is_required") == required)
    kept = joined.where(~inside | F.when(F.col("is_list"), n > 0).otherwise(F.col("value_id").isNotNull()))
    cut = inside & F.col("is_list") & (n < F.size("value_arr"))
    return kept.withColumn("value_arr", F.when(cut, F.slice("value_arr", F.lit(1), n)).otherwise(F.col("value_arr")))


def reconcile_ids(df: DataFrame) -> DataFrame:
    """ids that do not fit the elements one to one are taken off."""
    n = F.when(F.col("is_list"), F.size("value_arr")).otherwise(1)
    off = F.col("value_ids").isNotNull() & ((F.size("value_ids") != n) | (~F.col("is_collection") & (F.size("value_ids") > 1)))
    return df.withColumn("value_id", F.when(off, F.lit(None)).otherwise(F.col("value_id"))).withColumn("value_ids", F.when(off, F.lit(None)).otherwise(F.col("value_ids")))


# Words by which evidence admits to know nothing, names of country, count and sub-name fields, groups of units
_NO_INFORMATION = (
    r"no information|not specified|not visible|cannot\s+(?:be\s+)?determin|uncertain|unknown|not mentioned|no\s+\S+\s+(?:information|data)|"
    r"не указан|нет данных|не найдено|не\s+вид(?:но|ен)|невозможно\s+определить|information not found|"
    r"skipping|skip\b|closest\s+in\s+(?:the\s+)?list|not\s+in\s+(?:the\s+)?list|no\s+\w+\s+match|not\s+confident|guess(?:ed|ing)?|inferred|"
    r"не\s+уверен|ближайш|нет\s+в\s+списке|предположительно"
)
_COUNTRY_FIELD = r"страна|country|изготовител|производител|origin"
_COUNT_FIELD = r"\b(?:число|количество|кол-во|кол\.?\s*во|count|number\s+of|qty)\b"
_ECHO_FIELD = r"аннотаци|название\s+вкуса|название\s+цвета|название\s+аромат|название\s+запах|модель\s+тс\b"
_YES_NO = ("да", "нет", "true", "false", "yes", "no")
UNIT_GROUPS = (
    ("г", "кг", "мг", "lb", "oz", "фунт"),
    ("шт", "штук", "pcs", "piece"),
    ("мл", "л", "ml", "l"),
    ("см", "мм", "м", "km", "дюйм", "in", "ft", "mm", "cm"),
)
UNVERIFIED = ("vision", "llm_knowledge", "web_search", "competitor_rag", "safe_enum_fill")


def self_admission(evidence: Column) -> Column:
    """F26-1: evidence that admits to know nothing or to guess."""
    return F.coalesce(evidence.rlike(f"(?iuU)(?:{_NO_INFORMATION})"), F.lit(False))


def foreign_unit(name: Column, value: Column) -> Column:
    """F26-3: the value has, as a word, a unit of another group than the field's own."""
    own, low = F.lower(trailing_unit(name)), F.lower(value)
    out = F.lit(False)
    for group in UNIT_GROUPS:
        others = "|".join(u for g in UNIT_GROUPS if g is not group for u in g)
        out = out | (own.isin(*group) & low.rlike(rf"(?iu)(?<![а-яёa-z])(?:{others})(?![а-яёa-z])"))
    return F.coalesce(out, F.lit(False))


def verification_gate(joined: DataFrame, text: Column) -> DataFrame:
    """the last gate.  Lists pass but for evidence that admits to know nothing and countries of competitors.

    Scalars go for yes and no in a field of numbers, units or counts, for the whole title in a field of a part of the name,
    for numbers of description and web search that stand neither in ``text`` nor in their evidence, and for foreign units.
    A boolean column ``verdict``, if there is one, drops what it denies (false) of unverified sources, where the value does not
    stand in the texts; customs codes are exempt from that.
    """
    from ..functions.numeric import equivalents

    name, value, source = F.coalesce("target_name", F.lit("")), F.trim("value_str"), F.col("source")
    scalar = ~F.coalesce(F.col("is_list"), F.lit(False)) if "is_list" in joined.columns else F.lit(True)
    kind = target_kind(name, F.col("type"), F.coalesce(F.col("has_values"), F.lit(False)))
    numeric = kind.isin("numeric", "dimensions")
    country = _any(name, _COUNTRY_FIELD) & (source == "competitor_rag")
    yes_no = F.lower(value).isin(*_YES_NO) & (numeric | trailing_unit(name).isNotNull() | F.coalesce(name.rlike(f"(?iuU)(?:{_COUNT_FIELD})"), F.lit(False)))
    echo = F.coalesce(name.rlike(f"(?iuU)(?:{_ECHO_FIELD})"), F.lit(False)) & (t.title_echo(F.col("product_name")) != "") & (t.title_echo(value) == t.title_echo(F.col("product_name")))
    grounds = F.lower(F.concat_ws(" ", "evidence", text))
    doubted = numeric & source.isin("description", "web_search") & value.rlike(r"\d") & (grounds != "")
    # only values in doubt reach the ways of writing a number, which Python makes
    ways = equivalents(F.when(doubted, value))
    number = doubted & ~F.exists(ways, lambda w: F.contains(grounds, w))
    drop = self_admission(F.col("evidence")) | country | (scalar & (yes_no | echo | number | foreign_unit(name, value)))
    if "verdict" in joined.columns:
        customs = F.lit(False)
        for part in CUSTOMS_NAMES:
            customs = customs | F.contains(F.lower(name), F.lit(part))
        drop = drop | (scalar & source.isin(*UNVERIFIED) & ~customs & ~F.contains(grounds, F.lower(value)) & (F.col("verdict") == F.lit(False)))
    return joined.where(~F.coalesce(drop, F.lit(False)))


def mud_gate(joined: DataFrame, text: Column) -> DataFrame:
    """required scalar enum values of description and vision that are not verbatim in the text need a verdict."""
    doubt = F.col("is_required") & F.col("has_values") & ~F.col("is_list") & F.col("source").isin("description", "vision") & ~F.contains(F.lower(text), F.lower("value_str"))
    return joined.where(~F.coalesce(doubt, F.lit(False)) | F.coalesce(F.col("confirmed"), F.lit(False)))


def safe_enum(joined: DataFrame, text_tokens: Column, most_options: int = 35) -> DataFrame:
    """short closed optional enums whose value stands as a phrase in the text, or has a verdict."""
    fits = ~F.col("is_required") & (F.size("allowed_values") <= most_options) & ~is_brand_target(F.col("attribute_id"), F.col("target_name"))
    return joined.where(fits & (t.phrase_in(t.brand_tokens(F.col("value_str")), text_tokens) | F.coalesce(F.col("confirmed"), F.lit(False))))


# Descriptions and names of fields of the platform
_PLATFORM_TEXT = r"https?://|\bmp4\b|\bmov\b|\bjson\b|sku через|seller-edu|соцсет|rich-контент|заводск\w*\s+упаковок"
_PLATFORM_NAME = (
    r"озон\.видео|объединить в похожие|\bуеи\b|нескольких упаковк|название файла|\bpdf\b|\bдокумент|код продавца|артикул продавца|рост модели|параметры модели|"
    r"размер на модели|модел\w*\s+на фото|на фото\s+модел|18\+|признак\s+18|тип ростовки|ростовк|размер производителя|размер на бирке"
)
# Systems as fields name them, brands by the systems of their phones, names of devices
SYSTEMS = (("ios", "ios"), ("macos", "macos"), ("mac os", "macos"), ("harmony os", "harmonyos"), ("harmonyos", "harmonyos"), ("windows", "windows"), ("android", "android"), ("ipados", "ipados"), ("watchos", "watchos"))
ANDROID_BRANDS = ("samsung", "xiaomi", "redmi", "poco", "realme", "oppo", "vivo", "oneplus", "huawei", "honor", "infinix", "tecno", "itel", "meizu", "nokia", "motorola")
TWO_SYSTEM_BRANDS = ("huawei", "honor")
APPLE_DEVICES = (
    ("watchos", r"\bapple\s+watch\b|\bwatch\s+series\b|\bwatch\s+ultra\b"), ("ipados", r"\bipad\b"), ("ios", r"\biphone\b|\bсмартфон apple\b"),
    ("macos", r"\bmacbook\b|\bimac\b|\bmac\s+mini\b|\bmac\s+pro\b|\bmac\s+studio\b"),
)


def _words(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?iuU)(?:{pattern})"), F.lit(False))


def platform_field(name: Column, required: Column, kind: Column, n_values: Column, description: Column) -> Column:
    """optional fields that the platform, not the product, fills: links, and fields without a dictionary whose name or
    description says so."""
    optional = ~F.coalesce(required, F.lit(False))
    closed = F.coalesce(n_values, F.lit(0)) > 0
    return optional & (F.coalesce(kind == "URL", F.lit(False)) | (~closed & (_words(name, _PLATFORM_NAME) | _words(description, _PLATFORM_TEXT))))


def product_system(product_name: Column, leaf: Column, filled: Column) -> Column:
    """The operating system that a product surely has; null: not known.  ``filled``: its own field's value, which decides
    alone; else the device of its name and leaf category, a brand of phones, or a notebook."""
    own, name, leaf = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (filled, product_name, leaf))
    both = F.concat_ws(" ", name, leaf)
    named, device = F.lit(None).cast("string"), F.lit(None).cast("string")
    for alias, system in reversed(SYSTEMS):
        named = F.when(F.contains(own, F.lit(alias)), system).otherwise(named)
    for system, pattern in reversed(APPLE_DEVICES):
        device = F.when(_words(both, pattern), system).otherwise(device)
    # the first brand of the list decides; one of two systems says nothing
    brand = F.element_at(F.concat(F.filter(F.array(*map(F.lit, ANDROID_BRANDS)), lambda b: F.contains(name, b) | F.contains(leaf, b)), F.array(F.lit(""))), 1)
    phone = _words(name, r"\bсмартфон\b") | _words(both, r"смартфон|android\s*телефон")
    return (
        F.when(own != "", named).when(F.contains(both, F.lit("apple")), device).when(brand.isin(*TWO_SYSTEM_BRANDS), F.lit(None))
        .when((brand != "") & phone, "android").when(_words(both, "ноутбук|laptop"), "windows")
    )


def not_applicable(name: Column, required: Column, product_name: Column, category_path: Column, filled_system: Column) -> Column:
    """optional fields that the product cannot have: versions of another system than its own, and drying on a washing
    machine that does not dry."""
    field = F.regexp_replace(F.regexp_extract(F.lower(F.trim(name)), r"(?u)^версия\s+(ios|macos|mac\s*os|harmonyos|harmony\s*os|windows|android|ipados|watchos)", 1), r"\s", "")
    system = product_system(product_name, F.try_element_at(category_path, F.lit(-1)), filled_system)
    words = F.concat_ws(" ", product_name, F.concat_ws(" ", category_path))
    washer = _words(words, r"стиральная\s+машин") & ~_words(words, r"стиральная\s+машин\w*\s+с\s+сушкой|с\s+функцией\s+сушки")
    out = ((field != "") & system.isNotNull() & (field != system)) | (_words(name, "сушк") & washer)
    return ~F.coalesce(required, F.lit(False)) & F.coalesce(out, F.lit(False))


def judged(candidates: DataFrame, verdict: Column) -> DataFrame:
    """Outcome per candidate: skipped when confident, else kept or dropped by threshold or verdict."""
    limit = model.judge_threshold(F.col("source"))
    passes = F.when(limit.isNotNull(), F.col("confidence") >= limit).otherwise(F.coalesce(verdict, F.lit(False)))
    confident = is_confident(F.col("confidence"), F.col("source"), F.col("semantic_type"))
    return candidates.withColumn("outcome", F.when(confident, "skipped").when(passes, "validated").otherwise("invalidated"))


# Words of scripts and style sheets
MARKUP_WORDS = ("function", "var ", "</", "px;", "rgba(", "@media", "script", "stylesheet")


def looks_like_markup(text: Column) -> Column:
    """too much markup, or a long text with hardly any digits and colons."""
    low, n = F.lower(text), F.length(text)
    count = lambda s: (n - F.length(F.replace(low, F.lit(s), F.lit("")))) / len(s)
    marks = count("<") + count("{") + count("}")
    for token in MARKUP_WORDS:
        marks = marks + 8 * count(token)
    digits, colons = F.length(F.regexp_replace(text, "[^0-9]", "")), count(":")
    poor = (n >= 400) & ((digits == 0) | (colons < 2) | ((digits / n < 0.004) & (colons < 4)))
    return (F.coalesce(n, F.lit(0)) == 0) | (marks / n > 0.06) | poor


# Marks of pages that block robots
BLOCK_MARKERS = ("captcha", "smartcaptcha", "datadome", "access denied", "just a moment", "cf-challenge", "cloudflare", "проверка", "подтвердите, что вы не робот", "are you a robot")


def looks_blocked(text: Column, markers: tuple[str, ...] = BLOCK_MARKERS) -> Column:
    """pages of blockers; empty pages count."""
    out = F.coalesce(text, F.lit("")) == ""
    for m in markers:
        out = out | F.contains(F.lower(text), F.lit(m))
    return F.coalesce(out, F.lit(True))


def visible_length(html: Column) -> Column:
    """F35."""
    return F.length(t.html_to_text(html))


def within_budget(cost: Column, most: Column) -> Column:
    """cost up to 70 % of the most."""
    return cost <= 0.7 * most


def model_conflict(a: Column, b: Column) -> Column:
    """Each text has a code that the other lacks, or they share a code and differ in their variant words."""
    x, y = t.conflict_codes(a), t.conflict_codes(b)
    both_own = (F.size(F.array_except(x, y)) > 0) & (F.size(F.array_except(y, x)) > 0)
    return both_own | (F.coalesce(F.arrays_overlap(x, y), F.lit(False)) & (t.variant_words(a) != t.variant_words(b)))


def gender_conflict(a: Column, b: Column) -> Column:
    """Whether one text is for men and the other for women."""
    judged = lambda x, y: (x != y) & (x != "unisex") & (y != "unisex")
    return F.coalesce(t.once(t.card_gender(a), lambda x: t.once(t.card_gender(b), lambda y: judged(x, y))), F.lit(False))


def brand_conflict(brand: Column, name: Column, title: Column) -> Column:
    """Whether a title lacks the asked Latin brand and holds another Latin word that the asked name does not hold."""
    latin = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit("(?i)[a-z][a-z0-9&]{2,}"), F.lit(0)), F.lower))
    own = t.brand_tokens(brand)
    judged = F.replace(t.strip(brand), F.lit(" "), F.lit("")).rlike("(?i)^[a-z][a-z0-9&]{2,}$") & (F.length(F.array_join(own, "")) >= 3)
    other = F.size(F.array_except(latin(title), F.concat(own, latin(name)))) > 0
    return F.coalesce(judged & ~t.phrase_in(own, t.brand_tokens(title)) & other, F.lit(False))


def strategy_targets(targets: DataFrame, skipped_types: tuple[str, ...], dictionary: DataFrame | None = None) -> DataFrame:
    """targets of supported types; where a category has a dictionary, only those in it (category_id, attribute_id)."""
    kept = targets.where(~F.coalesce(F.col("semantic_type").isin(*skipped_types), F.lit(False)) if skipped_types else F.lit(True))
    if dictionary is None:
        return kept
    known = dictionary.select("category_id").distinct().withColumn("_has", F.lit(True))
    listed = dictionary.select("category_id", "attribute_id").distinct().withColumn("_in", F.lit(True))
    joined = kept.join(known, "category_id", "left").join(listed, ["category_id", "attribute_id"], "left")
    return joined.where(F.col("_has").isNull() | F.col("_in")).drop("_has", "_in")


def applicable(products: DataFrame, source: str) -> DataFrame:
    """products for which a source has something to go by."""
    present = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    tests = {
        "description": present("description"), "llm_knowledge": present("name"), "vision": F.coalesce(F.size("image_urls"), F.lit(0)) > 0, "web_search": present("name"),
        "barcode": present("ean") | present("description"), "icecat": present("ean") | present("brand"), "competitor_rag": present("name"),
    }
    return products.where(tests[source])
