"""Text normalisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Boolean words
YES, NO = ("true", "да", "yes", "1"), ("false", "нет", "no", "0")
# Values that say nothing
PLACEHOLDERS = ("нет", "-", "—", "none", "n/a", "без", "не указано", "нет данных")
# Names of features that mean nothing, whole-string patterns
VAGUE_NAMES = (
    r"new[\s_-]*feature\s*\d*", r"feature[\s_-]*\d+", r"field[\s_-]*\d*", r"attr(?:ibute)?[\s_-]*\d*", r"[a-z]", r"\d+",
    "none", "null", "undefined", "placeholder", "todo", "tbd",
)
# Adjective endings, longest first
COLOR_ENDINGS = (
    "ого", "его", "ыми", "ими", "ому", "ему", "ый", "ий", "ой", "ая", "яя", "ое", "ее", "ые", "ие",
    "ым", "им", "ых", "их", "ую", "юю", "ом", "ем", "о", "е",
)
# Latin letters that look like Cyrillic ones
HOMOGLYPHS = ("ABCEHKMOPTXYaceopxy", "АВСЕНКМОРТХУасеорху")
# Technical aliases, in order
TECH_ALIASES = (
    ("fully-modular", "полностью модульный"), ("fully modular", "полностью модульный"), ("semi-modular", "полумодульный"), ("semi modular", "полумодульный"),
    ("non-modular", "немодульный"), ("non modular", "немодульный"), ("modular", "модульный"), (" pin ", " пин "), (" pin", " пин"),
    (r"\bv\b", "в"), (r"\bw\b", "вт"), (r"\bcm\b", "см"), (r"\bmm\b", "мм"),
    ("ocp", "защита от перегрузки по току"), ("ovp", "защита от перенапряжения"), ("uvp", "защита от пониженного напряжения"),
    ("scp", "защита от короткого замыкания"), ("opp", "защита от перегрузки по мощности"), ("otp", "защита от перегрева"),
)
# Gender words by dictionary form; children stay apart from adults
GENDER_FORMS = {
    "Девочки": ("девочки", "девочка", "для девочек", "girls", "girl"),
    "Мальчики": ("мальчики", "мальчик", "для мальчиков", "boys", "boy"),
    "Мужской": ("муж", "мужской", "мужская", "мужское", "мужские", "мужчинам", "мужчины", "для мужчин", "men", "men's", "mens", "male"),
    "Женский": ("жен", "женский", "женская", "женское", "женские", "женщинам", "женщины", "для женщин", "women", "women's", "womens", "female"),
}
WHITE = r"[\s\x1c-\x1f\x85   -     　]"


def once(c: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it, in lambdas too."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{WHITE}+", " "))


def norm(c: Column) -> Column:
    """Stripped and lower-cased."""
    return F.lower(strip(c))


def norm_elements(value: Column, values: Column, is_list: Column) -> Column:
    """The normalised elements of a scalar or list value, blanks dropped."""
    every = F.when(is_list, values).otherwise(F.array(value))
    return F.filter(F.transform(F.coalesce(every, F.array().cast("array<string>")), norm), lambda x: x.isNotNull() & (x != ""))


def for_corroboration(c: Column) -> Column:
    """Form in which values of different sources are compared."""
    low = norm(c)
    return F.when(low.isin(*YES), "да").when(low.isin(*NO), "нет").otherwise(collapse(F.regexp_replace(low, "ё", "е")))


def strong_token(c: Column, translations: dict[str, str] | None = None) -> Column:
    """Strong normalisation of a value: whole-value translation, aliases, homoglyphs, ё, dashes, punctuation."""
    low = F.lower(c)
    if translations:
        table = F.create_map(*[F.lit(x) for kv in translations.items() for x in kv])
        low = F.coalesce(F.lower(F.try_element_at(table, strip(low))), low)
    named = low
    for source, target in TECH_ALIASES:
        named = F.regexp_replace(named, source, target)
    # every alias holds a Latin letter, so texts without one keep their form
    low = F.when(low.rlike("[a-z]"), named).otherwise(low)
    low = F.translate(F.translate(low, *HOMOGLYPHS), "ё", "е")
    low = F.regexp_replace(F.regexp_replace(low, "-", " "), r"\+", " + ")
    return F.regexp_replace(F.regexp_replace(low, f"{WHITE}+", " "), r"""^[ .,;:!?"'()\[\]]+|[ .,;:!?"'()\[\]]+$""", "")


def brand_tokens(c: Column) -> Column:
    """T4: Latin and Cyrillic words and digits of the lower-cased text."""
    return F.regexp_extract_all(F.translate(F.lower(c), "ё", "е"), F.lit("[а-яa-z0-9]+"), F.lit(0))


def canon_tokens(c: Column) -> Column:
    """T4: as ``brand_tokens``, apostrophes and dashes taken out first."""
    return brand_tokens(F.regexp_replace(c, "['’-]", ""))


def padded(tokens: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def phrase_in(phrase_tokens: Column, tokens: Column) -> Column:
    """T5: whether the tokens hold the phrase as a contiguous run."""
    return (F.size(phrase_tokens) > 0) & F.contains(padded(tokens), padded(phrase_tokens))


def phrase_start(phrase_tokens: Column, tokens: Column) -> Column:
    """Token index of the phrase's first occurrence, from 0; null: none."""
    pos = F.position(padded(phrase_tokens), padded(tokens))
    before = F.substring(padded(tokens), F.lit(1), pos)
    return F.when((F.size(phrase_tokens) > 0) & (pos > 0), F.length(F.regexp_replace(before, "[^ ]", "")) - 1)


def color_stem(c: Column) -> Column:
    """Without the longest agreement ending that leaves three letters or more."""
    w = F.translate(norm(c), "ё", "е")
    out = w
    for end in reversed(COLOR_ENDINGS):
        out = F.when(F.endswith(w, F.lit(end)) & (F.length(w) - len(end) >= 3), F.substring(w, F.lit(1), F.length(w) - len(end))).otherwise(out)
    return out


def char_name(c: Column, leading: tuple[str, ...] = ()) -> Column:
    """Words of a characteristic's name, split at spaces, dashes and slashes, without leading classifier words."""
    words = F.filter(F.split(norm(c), r"[\s\-–—/]+"), lambda x: x != "")
    text = F.array_join(words, " ")
    return F.regexp_replace(text, f"^(?:(?:{'|'.join(leading)}) )+", "") if leading else text


# Words that open a title and name no model
LEADING_WORDS = (
    "для", "и", "с", "со", "в", "на", "к", "по", "из", "от", "под", "при", "мужской", "мужская", "мужское", "мужские", "женский", "женская", "женское", "женские",
    "детский", "детская", "детское", "детские", "унисекс", "городской", "городская", "городское", "спортивный", "спортивная", "спортивное", "модель", "худи",
)
# Words that classify a characteristic
CLASSIFIERS = ("тип", "вид", "количество", "число", "наличие", "способ", "метод", "класс", "степень")
# Units that stand alone as a word of four letters or more
LONG_UNITS = ("дюйм", "дюйма", "дюймов", "дюйме", "inch", "inches", "ампер")
# Words that tell one variant of a model from another
VARIANT_WORDS = ("pro", "max", "plus", "ultra", "lite", "mini", "neo", "note", "air", "se", "fe", "prime")


def for_fuzzy(c: Column) -> Column:
    """T9."""
    return F.lower(F.translate(c, "\u2019\u02bc", ""))


def model_tokens(c: Column) -> Column:
    """Article tokens: Latin letters, digits, dots and dashes, with a digit behind the first sign, three signs or more."""
    found = F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9][A-Za-z0-9.\-]*[0-9][A-Za-z0-9.\-]*"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, F.lower), lambda x: F.length(x) >= 3))


def alpha_tokens(c: Column) -> Column:
    """Words of four letters or more that may name a model, without opening words, classifiers and units."""
    found = F.transform(F.regexp_extract_all(c, F.lit("[A-Za-zА-Яа-яёЁ]{4,}"), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(found, lambda x: ~x.isin(*LEADING_WORDS, *CLASSIFIERS, *LONG_UNITS)))


def _latin_tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def conflict_codes(c: Column) -> Column:
    """Tokens with both letters and digits."""
    return F.filter(_latin_tokens(c), lambda x: x.rlike("[a-z]") & x.rlike("[0-9]"))


def variant_words(c: Column) -> Column:
    return F.array_sort(F.filter(_latin_tokens(c), lambda x: x.isin(*VARIANT_WORDS)))


def card_gender(c: Column) -> Column:
    """Male, female or unisex by a card's words; null for none, and for both."""
    has = lambda pattern: c.rlike(f"(?iu){pattern}")
    male = has(r"мужск|мужчин|мальчик|парн(?:ой|ям|и|ь)|\bmale\b|\bmen('?s)?\b|\bman\b|\bboy")
    female = has(r"женск|женщин|девочк|девуш|\bfemale\b|\bwomen('?s)?\b|\bwoman\b|\bgirl")
    one = lambda both: F.when(both["male"] & ~both["female"], "male").when(both["female"] & ~both["male"], "female")
    return F.when(has("унисекс|unisex"), "unisex").otherwise(once(F.struct(male.alias("male"), female.alias("female")), one))


def category_in_title(category: Column, title: Column) -> Column:
    """Whether a word of the category and one of the title, each of four letters or more, begin with the same four."""
    heads = lambda c: F.transform(F.filter(F.split(F.lower(c), r"[\s\-–—/]+"), lambda x: F.length(x) >= 4), lambda x: F.left(x, F.lit(4)))
    return F.coalesce(F.arrays_overlap(heads(category), heads(title)), F.lit(False))


def search_query(name: Column, brand: Column, stop: tuple[str, ...] = (), words: int = 5) -> Column:
    """Brand and the first tokens of a title, stop words left out."""
    tokens = brand_tokens(name)
    if stop:
        tokens = F.filter(tokens, lambda x: ~x.isin(*stop))
    head = F.array_join(F.slice(tokens, 1, words), " ")
    return F.when(brand.isNull() | F.contains(head, F.lower(brand)), head).otherwise(F.concat_ws(" ", F.lower(brand), head))


def split_values(c: Column) -> Column:
    """Parts between semicolons and commas, trimmed, case-insensitive duplicates dropped; no part: the value itself."""
    parts = F.filter(F.transform(F.split(c, "[;,]"), strip), lambda x: x != "")
    kept = dedup_ci(parts)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(c))


def dedup_ci(values: Column) -> Column:
    """Order-preserving, case-insensitive distinct."""
    return F.filter(values, lambda x, i: F.array_position(F.transform(values, norm), norm(x)) == i + 1)


def unwrap_list(c: Column) -> Column:
    """The items of a text that looks like a list."""
    inner = F.regexp_extract(strip(c), r"(?s)^\[(.*)\]$", 1)
    parts = F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(strip(x), "^['\"]+|['\"]+$", "")), lambda x: x != "")
    return F.when(strip(c).rlike(r"(?s)^\[.*\]$") & (F.size(parts) > 0), parts).otherwise(F.array(c))


def without_pixels(c: Column) -> Column:
    """Without a trailing pixel word; null: nothing to strip."""
    out = strip(F.regexp_replace(c, r"(?iu)\s+(?:pixels|pixel|px|точек|пикселей|пикс)\s*$", ""))
    return F.when((out != "") & (out != c), out)


def without_parens(c: Column) -> Column:
    """Without a trailing parenthesis."""
    return strip(F.regexp_replace(c, r"\s*\([^)]*\)\s*$", ""))


def digits_agree(query: Column, other: Column) -> Column:
    """A query without digits agrees with all; else the sorted digit groups are equal."""
    groups = [F.sort_array(F.regexp_extract_all(x, F.lit(r"\d+"), F.lit(0))) for x in (query, other)]
    return (F.size(groups[0]) == 0) | (groups[0] == groups[1])


def gender_form(c: Column) -> Column:
    """The dictionary form of a gender word; null: none."""
    out = F.lit(None).cast("string")
    for form, words in reversed(GENDER_FORMS.items()):
        out = F.when(norm(c).isin(*words), form).otherwise(out)
    return out


def gender_signal(c: Column) -> Column:
    """Male, female, unisex or null, from word stems of a text."""
    low = F.lower(c)
    male, female = low.rlike(r"(?<![а-яa-z])(?:муж|мальч|men\b|boy|male\b)"), low.rlike(r"(?<![а-яa-z])(?:жен|девоч|women|girl|female)")
    return F.when(low.rlike("унисекс|unisex") | (male & female), "unisex").when(male, "male").when(female, "female")


def title_echo(c: Column) -> Column:
    """T20."""
    return strip(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))


def html_to_text(c: Column) -> Column:
    """Scripts, styles and tags out, frequent entities resolved, white space collapsed."""
    text = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return collapse(text)


def window_around(text: Column, keyword: Column, before: int = 200, after: int = 800) -> Column:
    """The text around the first occurrence of a keyword; none: the beginning."""
    at = F.greatest(F.position(F.lower(keyword), F.lower(text)) - before, F.lit(1))
    return F.substring(text, at, F.lit(before + after))


def spec_snippet(c: Column) -> Column:
    """Whether a snippet holds a number with a unit, or a comparison."""
    return c.rlike(r"(?iu)\d+(?:[.,]\d+)?\s*(?:мм|см|м|кг|г|вт|в|л|мл|гц|mm|cm|kg|g|w|v|hz|gb|mah)(?![а-яa-z])|[<>≤≥]|\bvs\b")


def host(url: Column) -> Column:
    """Lower-cased host without www."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def truncated(c: Column, size: int = 1000) -> Column:
    """T25."""
    return F.when(F.length(c) > size, F.concat(F.left(c, F.lit(size)), F.lit("..."))).otherwise(c)


def banned(c: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a text holds one of the phrases."""
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(F.lower(c), F.lit(p.lower()))
    return out


def is_vague(name: Column) -> Column:
    """names shorter than two letters and placeholder names."""
    low = norm(name)
    return low.isNull() | (F.length(low) < 2) | low.rlike(f"^(?:{'|'.join(VAGUE_NAMES)})$")


def is_empty(value: Column, values: Column) -> Column:
    """F8: null, blank, or a list of blanks."""
    blank = value.isNull() | (strip(value) == "")
    blanks = values.isNull() | F.forall(values, lambda x: x.isNull() | (strip(x) == ""))
    return blank & blanks


def is_placeholder(value: Column) -> Column:
    """F9."""
    return norm(value).isin(*PLACEHOLDERS)


def pairs_from_dl(c: Column) -> Column:
    """Array of (name, value) of <dt> and <dd> elements."""
    names, values = (F.regexp_extract_all(c, F.lit(r"(?is)<dt[^>]*>(.*?)</dt>\s*<dd[^>]*>(.*?)</dd>"), F.lit(k)) for k in (1, 2))
    return F.arrays_zip(F.transform(names, html_to_text).alias("name"), F.transform(values, html_to_text).alias("value"))


def json_island(c: Column) -> Column:
    """The first JSON text in a page's ld+json script, data-state attribute or __NEXT_DATA__ script; null: none."""
    found = [F.regexp_extract(c, p, 1) for p in (r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>', r"(?is)data-state='([^']*)'", r'(?is)<script[^>]*__NEXT_DATA__[^>]*>(.*?)</script>')]
    return F.coalesce(*[F.when(x != "", strip(x)) for x in found])


def free_text_gate(c: Column, translations: dict[str, str] | None = None) -> Column:
    """A neighbour's free text: codes joined by slashes or dashes go, foreign words are translated or go, measures stay."""
    clean = collapse(c)
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in (translations or {"": ""}).items() for x in kv]), F.lower(clean))
    foreign = ~clean.rlike(r"[Ѐ-ӿ]") & ~clean.rlike(r"^\d[\d.,]*\s*[A-Za-z]{0,5}$")
    return F.when((clean == "") | clean.rlike(r"^[A-Za-z0-9]+(?:[/\-][A-Za-z0-9]+)+$"), F.lit(None)).when(foreign, known).otherwise(clean)
