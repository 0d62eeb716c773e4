"""Fabric compositions in pages and texts: a material word and a second signal, a label or a percentage next to it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .islands import unescaped
from .text import once, strip

# Materials by name with the forms they occur in; the order decides between forms
MATERIALS = (
    ("хлопок", r"хлопок|хлопка|хлопок[а-я]*|cotton"), ("полиэстер", r"полиэстер[а-я]*|polyester"), ("эластан", r"эластан[а-я]*|elastane|spandex|эластан"), ("вискоза", r"вискоз[а-я]*|viscose|rayon"),
    ("шерсть", r"шерст[а-я]*|wool|merino"), ("полиамид", r"полиамид[а-я]*|polyamide|nylon|найлон[а-я]*"), ("лиоцелл", r"лиоцел[а-я]*|lyocell|tencel|тенсел[а-я]*"), ("акрил", r"акрил[а-я]*|acrylic"),
    ("лён", r"лён|льн[а-я]*|linen|флакс"), ("кашемир", r"кашемир[а-я]*|cashmere"), ("модал", r"модал[а-я]*|modal"), ("бамбук", r"бамбук[а-я]*|bamboo"), ("шёлк", r"шёлк|шелк[а-я]*|silk"),
    ("кожа", r"натуральная\s+кожа|кожа|leather"), ("флис", r"флис[а-я]*|fleece"), ("трикотаж", r"трикотаж[а-я]*|jersey|knit"), ("микрофибра", r"микрофибр[а-я]*|microfiber|microfibre"), ("металл", r"металл[а-я]*|metal"),
    ("полипропилен", r"полипропилен[а-я]*|polypropylene"), ("тактель", r"тактель|tactel"), ("кевлар", r"кевлар[а-я]*|kevlar|aramid|арамид[а-я]*"), ("купро", r"купро[а-я]*|cupro"), ("дралон", r"дралон[а-я]*|dralon"), ("сатин", r"сатин[а-я]*|satin"),
)
# Fixed value: words next to which a percentage is no part of a composition
NOISE = r"(?iuU)\b(?:скидк[аеи]?|скидку|sale|off|discount|распродаж[а-я]?|оригинал[а-я]?|original|рассрочк[аеи]?|кредит[а-я]?|installment|кэшбэк|cashback|предоплат[аеи]?|акц[ия][а-я]?|размер[а-я]?|size)\b"
# Fixed value: labels before a composition
LABEL = (
    r"(?imuUd)(?:^|[;,.\n\r]|\s{2,}|&[a-z]+;)\s*(?:Состав\s+(?:изделия|материала)?|Состав|Материал\s+(?:верха|подкладки|подошвы|основной|изделия)?|Материал|Ткань|"
    r"Fabric\s+(?:content|composition)?|Composition|Material\s+(?:content|composition)?|Material|Содержание\s*волокн[а-я]*)\s*[:\-–—]\s*([^\n\r;|]{5,150})"
)
_ANY = "|".join(pattern for _, pattern in MATERIALS)
_WORD, _SHARE = rf"(?iuU)\b(?:{_ANY})\b", r"\d{1,3}\s*%"
_PAIR = rf"(?iuU)(?:\d{{1,3}}\s*%\s*(?:{_ANY})|(?:{_ANY})\s*\d{{1,3}}\s*%)"
#: The signs that a pair consists of: no pair goes beyond a run of them
_SIGNS = r"а-яёa-z\s\d%"
_MATCHES = "array<struct<s:int,e:int>>"


def flat_text(html: Column) -> Column:
    """Text without tags, block elements as line ends, white space but for line ends collapsed."""
    text = F.regexp_replace(html, r"(?i)<(?:br|p|div|li|tr|td|th|h\d)(?:\s[^>]*)?>", "\n")
    text = unescaped(F.regexp_replace(text, r"<[^>]{0,300}>", " "))
    return F.regexp_replace(F.regexp_replace(text, r"(?U)[^\S\n]+", " "), r"\n{3,}", "\n\n")


def places(text: Column, pattern: str) -> Column:
    """Start and end, from 0, of a pattern's matches: the lengths of matches and of what is between them, added up."""
    between = F.split(text, pattern, -1)
    sizes = lambda found: F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("own")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_MATCHES).alias("all"))

    def step(state, x):
        start = state["at"] + x["gap"]
        return F.struct((start + x["own"]).alias("at"), F.concat(state["all"], F.array(F.struct(start.alias("s"), (start + x["own"]).alias("e")))).alias("all"))

    return once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, F.aggregate(sizes(found), begin, step)["all"]).otherwise(F.array().cast(_MATCHES)))


def _pair_places(text: Column) -> Column:
    """``places`` of pairs; only runs of their signs that hold a percentage are searched, as the many names are slow to try."""
    runs = F.regexp_extract_all(text, F.lit(f"(?iuU)[{_SIGNS}]++|[^{_SIGNS}]++"), F.lit(0))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_MATCHES).alias("all"))

    def step(state, x):
        found = F.transform(places(x, _PAIR), lambda m: F.struct((state["at"] + m["s"]).alias("s"), (state["at"] + m["e"]).alias("e")))
        return F.struct((state["at"] + F.length(x)).alias("at"), F.when(F.contains(x, F.lit("%")), F.concat(state["all"], found)).otherwise(state["all"]).alias("all"))

    return F.aggregate(runs, begin, step)["all"]


def _noisy(text: Column, at: Column, window: int = 30) -> Column:
    low = F.greatest(at - window, F.lit(0))
    return F.substring(text, low + 1, at + window - low).rlike(NOISE)


def plausible(value: Column) -> Column:
    """A material word, no noise next to a percentage, and percentages that add up to 20 or more, if there are any."""
    total = F.aggregate(F.regexp_extract_all(value, F.lit(r"(\d{1,3})\s*%"), F.lit(1)), F.lit(0), lambda a, x: a + x.cast("int"))
    return value.rlike(_WORD) & ~F.exists(places(value, _SHARE), lambda m: _noisy(value, m["s"])) & ~once(total, lambda n: (n > 0) & (n < 20))


def _clean(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(raw), r"[.,;:—–\-|/\\]+$", ""), r"(?U)\s+", " ")


def _tidy(c: Column) -> Column:
    """Separators as commas, the percentage before its material."""
    c = F.regexp_replace(c, r"(?U)\s*[/|;]\s*", ", ")
    c = F.regexp_replace(c, rf"(?iuU)({_ANY})\s+(\d{{1,3}})\s*%", "$2% $1")
    return strip(F.regexp_replace(c, r"(\d)%([A-Za-zА-Яа-яёЁ])", "$1% $2"))


def _runs(flat: Column) -> Column:
    """Spans of pairs of a percentage and a material that lie at most 80 signs apart, with the number of pairs."""
    kind = "array<struct<s:int,e:int,n:int>>"
    pairs = F.filter(_pair_places(flat), lambda m: ~_noisy(flat, m["s"]))

    def step(runs, m):
        last = F.try_element_at(runs, F.lit(-1))
        near = F.coalesce(m["s"] - last["e"] <= 80, F.lit(False))
        longer = F.struct(last["s"].alias("s"), m["e"].alias("e"), (last["n"] + 1).alias("n"))
        return F.when(near, F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(runs, F.array(F.struct(m["s"].alias("s"), m["e"].alias("e"), F.lit(1).alias("n"))))).cast(kind)

    return F.aggregate(pairs, F.array().cast(kind), step)


def compositions(html: Column) -> Column:
    """The distinct compositions of a page or text, in order: labelled values, and only where there are none, runs of pairs.

    A single pair counts only if no pair stands in the last 60 signs of its surroundings, the pair itself included.
    """
    return F.coalesce(once(flat_text(html), _of_flat), F.array().cast("array<string>"))


def _of_flat(flat: Column) -> Column:
    labelled = F.filter(F.transform(F.regexp_extract_all(flat, F.lit(LABEL), F.lit(1)), _clean), lambda v: (v != "") & plausible(v))

    def alone(m):
        low = F.greatest(m["s"] - 5, F.lit(0))
        wider = strip(F.substring(flat, low + 1, m["e"] + 60 - low))
        return ~F.right(wider, F.lit(60)).rlike(_PAIR)

    spans = F.filter(_runs(flat), lambda m: once(strip(F.substring(flat, m["s"] + 1, m["e"] - m["s"])), plausible) & ((m["n"] > 1) | alone(m)))
    free = F.transform(spans, lambda m: _clean(F.substring(flat, m["s"] + 1, m["e"] - m["s"])))
    distinct = lambda tidy, low: F.filter(tidy, lambda x, k: F.array_position(low, F.lower(x)) == k + 1)
    tidy = F.transform(once(labelled, lambda found: F.when(F.size(found) > 0, found).otherwise(free)), _tidy)
    return once(tidy, lambda every: once(F.transform(every, F.lower), lambda low: distinct(every, low)))


def material_name(c: Column) -> Column:
    """A material's name by the form in which it occurs; an unknown word stays."""
    word = strip(c)
    return F.coalesce(*[F.when(F.lower(word).rlike(f"(?iuU)^(?:{pattern})$"), name) for name, pattern in MATERIALS], word)


def main_material(listed: Column) -> Column:
    """The material of the highest percentage over all compositions, the first of equals; null for none."""
    kind = "array<struct<share:int,name:string>>"
    shares = lambda c, g: F.regexp_extract_all(c, F.lit(rf"(?iuU)(\d{{1,3}})\s*%\s*({_ANY})"), F.lit(g))
    pairs = F.flatten(F.transform(listed, lambda c: F.zip_with(shares(c, 1), shares(c, 2), lambda p, m: F.struct(p.cast("int").alias("share"), material_name(m).alias("name"))))).cast(kind)
    best = F.aggregate(pairs, F.struct(F.lit(-1).alias("share"), F.lit(None).cast("string").alias("name")), lambda a, p: F.when(p["share"] > a["share"], p).otherwise(a))
    return best["name"]
