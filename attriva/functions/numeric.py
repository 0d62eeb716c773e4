"""Numbers, units, barcodes and sizes as Column expressions."""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit, dimension, factor to the dimension's base unit
UNITS = (
    ("мм", "length", 1.0), ("см", "length", 10.0), ("м", "length", 1000.0), ("дюйм", "length", 25.4),
    ("мкг", "mass", 0.000001), ("мг", "mass", 0.001), ("г", "mass", 1.0), ("кг", "mass", 1000.0), ("т", "mass", 1000000.0),
    ("мл", "volume", 1.0), ("л", "volume", 1000.0), ("вт", "power", 1.0), ("квт", "power", 1000.0),
)
# Clothing sizes by letter
LETTER_SIZES = {
    "XS": ("40", "42"), "S": ("42", "44"), "M": ("46", "48"), "L": ("48", "50"), "XL": ("50", "52"), "XXL": ("52", "54"), "XXXL": ("54", "56"),
    "2XL": ("52", "54"), "3XL": ("54", "56"), "4XL": ("56", "58"), "5XL": ("58", "60"), "6XL": ("60", "62"),
}


def _units(place: int) -> Column:
    return F.create_map(*[F.lit(x) for row in UNITS for x in (row[0], row[place])])


def field_unit(name: Column) -> Column:
    """The unit after a name's last comma; null: none that is known."""
    tail = F.lower(F.trim(F.regexp_extract(name, r"(?s),([^,]*)$", 1)))
    return F.when(F.contains(name, F.lit(",")) & tail.isin(*[u[0] for u in UNITS]), tail)


def trailing_unit(name: Column) -> Column:
    """the word after a name's last comma; null: none."""
    got = F.regexp_extract(name, r"(?U),\s*(\w+(?:/\w+)?)\s*$", 1)
    return F.when(got != "", got)


def value_units(value: Column) -> Column:
    """All known units that stand as words in a value."""
    low = F.lower(value)
    known = F.array(*[F.when(low.rlike(f"(?<![а-яёa-z]){u[0]}(?![а-яёa-z])"), u[0]) for u in UNITS])
    return F.filter(known, lambda x: x.isNotNull())


def formatted(x: Column) -> Column:
    """Six decimals at most, trailing zeros dropped."""
    text = F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", "")
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(text)


def to_field_unit(name: Column, value: Column) -> Column:
    """The value in the unit its field names, where value and field name different units of one dimension."""
    text = F.trim(value)
    numbers = F.regexp_extract_all(text, F.lit(r"-?\d+(?:[.,]\d+)?"), F.lit(0))
    units, want = value_units(text), field_unit(name)
    unit = F.try_element_at(units, F.lit(1))
    one = (F.size(numbers) == 1) & (F.size(units) == 1) & ~text.rlike(r"\d\s*[-–—]\s*\d")
    same = F.try_element_at(_units(1), unit) == F.try_element_at(_units(1), want)
    amount = F.replace(F.try_element_at(numbers, F.lit(1)), F.lit(","), F.lit(".")).cast("double")
    out = formatted(F.bround(amount * F.try_element_at(_units(2), unit) / F.try_element_at(_units(2), want), 6))
    return F.when(one & want.isNotNull() & same & (unit != want), out).otherwise(text)


def equivalents(value: Column) -> Column:
    """The ways to write a number: plain, with comma, as integer, as fraction and mixed fraction."""

    @F.pandas_udf("array<string>")
    def ways(values: pd.Series) -> pd.Series:
        def of(v):
            if v is None:
                return []
            text = v.strip()
            try:
                x = float(text.replace(",", "."))
            except ValueError:
                return [text]
            if x != x or x in (float("inf"), float("-inf")):
                return [text]
            plain = f"{x:g}"
            out = {plain, plain.replace(".", ",")}
            if x == int(x):
                out.add(str(int(x)))
            else:
                f = Fraction(x).limit_denominator(100)
                out.add(f"{f.numerator}/{f.denominator}")
                if x > 1:
                    rest = Fraction(x - int(x)).limit_denominator(100)
                    out |= {f"{int(x)} {rest.numerator}/{rest.denominator}", f"{int(x)}-{rest.numerator}/{rest.denominator}"}
            return sorted(out)

        return values.map(of)

    return ways(value)


def number_in_text(ways: Column, text: Column) -> Column:
    """Plain substring test, without word borders, as "5" in "15"."""
    return F.exists(ways, lambda w: F.contains(F.lower(text), w))


def check_digit_ok(code: Column) -> Column:
    """GS1 check digit of 8, 12 or 13 digits: from the right, weights 3 and 1 in turn (12 digits: 1 and 3)."""
    digits = F.transform(F.split(code, ""), lambda c: c.cast("int"))
    body = F.slice(F.reverse(digits), 2, F.length(code) - 1)
    first = F.when(F.length(code) == 12, 1).otherwise(3)
    total = F.aggregate(F.transform(body, lambda x, i: x * F.when(i % 2 == 0, first).otherwise(4 - first)), F.lit(0), lambda a, b: a + b)
    return F.coalesce(code.rlike("^(?:[0-9]{8}|[0-9]{12}|[0-9]{13})$"), F.lit(False)) & ((10 - total % 10) % 10 == F.element_at(digits, -1))


def barcodes(text: Column) -> Column:
    """Distinct runs of 8, 12 or 13 digits, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d{8}|\d{12}|\d{13})(?!\d)"), F.lit(1)))


# Words for one size for all
ONE_SIZE = ("one size", "onesize", "os", "универсальный", "универс", "free size", "freesize", "no size")


def sizes(value: Column) -> Column:
    """The sizes a word names: a letter's sizes, both ends of a range, a number as it is, or the one-size word."""
    word = F.trim(value)
    table = F.create_map(*[y for k, v in LETTER_SIZES.items() for y in (F.lit(k), F.array(*[F.lit(x) for x in v]))])
    letter = F.when(F.upper(word) == "XXS", "XS").otherwise(F.upper(word))
    return (
        F.when(word.rlike(r"^\d+$"), F.array(word))
        .when(word.rlike(r"^\d+[-–—]\d+$"), F.array_distinct(F.regexp_extract_all(word, F.lit(r"\d+"), F.lit(0))))
        .when(F.lower(word).isin(*ONE_SIZE), F.array(F.lit("универсальный")))
        .otherwise(F.coalesce(F.try_element_at(table, letter), F.array().cast("array<string>")))
    )


def size_from_text(text: Column) -> Column:
    """A size word with its size, else a standalone letter size, else an even number from 38 to 72; null: none."""
    up = F.upper(text)
    named = F.regexp_extract(up, r"(?:РАЗМЕР|SIZE)[ .:]*([0-9]{2}|X{0,3}[SL]|M)(?![A-ZА-Я0-9])", 1)
    letter = F.regexp_extract(up, r"(?<![A-ZА-Я0-9])(X{1,3}[SL]|S|M|L)(?![A-ZА-Я0-9])", 1)
    number = F.filter(F.regexp_extract_all(up, F.lit(r"(?<![A-ZА-Я0-9.,])([0-9]{2})(?![A-ZА-Я0-9.,])"), F.lit(1)), lambda x: (x.cast("int") % 2 == 0) & x.cast("int").between(38, 72))
    return F.coalesce(F.when(named != "", named), F.when(letter != "", letter), F.try_element_at(number, F.lit(1)))


def leading_number_agrees(a: Column, b: Column) -> Column:
    """Equal leading numbers (to 1e-6) and equal rests."""
    num = r"^\s*(-?\d+(?:[.,]\d+)?)"
    x, y = (F.replace(F.regexp_extract(c, num, 1), F.lit(","), F.lit(".")).try_cast("double") for c in (a, b))
    rest = [F.lower(F.trim(F.regexp_replace(c, num, ""))) for c in (a, b)]
    return F.when(x.isNotNull() & y.isNotNull(), (F.abs(x - y) <= 1e-6) & (rest[0] == rest[1])).otherwise(F.lower(F.trim(a)) == F.lower(F.trim(b)))


def composition(text: Column) -> Column:
    """Array of (percent, material) from "95% cotton" or "cotton 95%" parts."""
    one = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(r"(\d{1,3})\s*%\s*([\p{L}]{3,})"), F.lit(k)) for k in (1, 2)])
    two = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(r"([\p{L}]{3,})\s*[:-]?\s*(\d{1,3})\s*%"), F.lit(k)) for k in (2, 1)])
    as_pair = lambda xs: F.transform(xs, lambda x: F.struct(x["0"].cast("int").alias("percent"), F.lower(x["1"]).alias("material")))
    return F.when(F.size(one) > 0, as_pair(one)).otherwise(as_pair(two))


def majority_material(parts: Column) -> Column:
    """The material with the largest percentage, the first of equals; null for totals under 20 %."""
    total = F.aggregate(parts, F.lit(0), lambda a, p: a + p["percent"])
    best = F.aggregate(parts, F.struct(F.lit(-1).alias("percent"), F.lit("").alias("material")), lambda a, p: F.when(p["percent"] > a["percent"], F.struct(p["percent"].alias("percent"), p["material"].alias("material"))).otherwise(a))
    return F.when((F.size(parts) > 0) & (total >= 20), best["material"])


# The last volume of each shard, from shard 1 on
SHARD_ENDS = (
    143, 287, 431, 719, 1007, 1061, 1115, 1169, 1313, 1601, 1655, 1919, 2045, 2189, 2405, 2621, 2837, 3053, 3473, 3793, 4050, 4306, 4563, 4820, 5076, 5333, 5590, 5846, 6103,
    6359, 6616, 6873, 7129, 7386, 7643, 7899, 8156,
)


def shard_volume(card_id: Column) -> tuple[Column, Column]:
    """(volume, part) of a card id."""
    return F.floor(card_id / 100000), F.floor(card_id / 1000)


def shard(card_id: Column) -> Column:
    """The two digits of the shard that holds a card; volumes behind the last one are in the last shard."""
    before = F.size(F.filter(F.array(*[F.lit(x) for x in SHARD_ENDS[:-1]]), lambda end: end < shard_volume(card_id)[0]))
    return F.when(card_id.isNotNull(), F.lpad((before + 1).cast("string"), 2, "0"))


def word_confidence(word: Column) -> Column:
    """N18."""
    low = F.lower(F.trim(word))
    return F.when(low == "high", 0.9).when(low == "medium", 0.6).when(low == "low", 0.3).otherwise(0.5)


def year_of(text: Column) -> Column:
    """The first four-digit year from 1900 to 2099; null: none."""
    got = F.regexp_extract(text, r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1)
    return F.when(got != "", got.cast("int"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of doubles; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


# Rounding digits and conversions of supplier specifications
_SPEC_DIGITS = {"inch": 1, "kg": 3, "g": 1}
_SPEC_FACTORS = {("cm", "inch"): 1 / 2.54, ("mm", "inch"): 1 / 25.4, ("g", "kg"): 1 / 1000, ("kg", "g"): 1000.0}
# Unit words, in order of trial
_SPEC_UNITS = (
    ("inch", "дюйм|inch|диагональ"), ("hz", "гц|hz"), ("ms", "мс"), ("min", r"мин(?![\p{L}])"), ("kg", "кг|kg"), ("g", r"(?<![\p{L}])(?:г|g)(?![\p{L}])"),
    ("mm", "мм|mm"), ("cm", "см|cm"), ("m", r"(?<![\p{L}])(?:м|m)(?![\p{L}])"), ("w", r"вт|(?<![\p{L}])w(?![\p{L}])"), ("v", r"(?<![\p{L}])(?:в|v)(?![\p{L}])"), ("mah", "мах|mah"),
)


def spec_unit(c: Column) -> Column:
    """The first unit that a name or value holds; null: none."""
    out = F.lit(None).cast("string")
    for unit, pattern in reversed(_SPEC_UNITS):
        out = F.when(F.lower(c).rlike(f"(?iu){pattern}"), unit).otherwise(out)
    return out


def spec_number(name: Column, value: Column) -> Column:
    """A supplier's number in the unit that the attribute's name tells; ambiguous values stay as they are.

    An inch number in parentheses wins for inch attributes; values of several numbers and unknown conversions stay.
    """
    raw = F.trim(value)
    want, have = spec_unit(name), spec_unit(raw)
    inch = F.replace(F.regexp_extract(raw, r"\(\s*(\d+(?:[.,]\d+)?)\s*(?:\"|''|″|inch|дюйм)", 1), F.lit(","), F.lit(".")).try_cast("double")
    numbers = F.regexp_extract_all(raw, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0))
    number = F.replace(F.try_element_at(numbers, F.lit(1)), F.lit(","), F.lit("."))
    factor = F.when(have == want, 1.0)
    for (a, b), f in _SPEC_FACTORS.items():
        factor = factor.when((have == a) & (want == b), f)
    def shown(x):
        digits = F.when(F.lit(False), x)
        for unit, n in _SPEC_DIGITS.items():
            digits = digits.when(want == unit, F.bround(x, n))
        return formatted(digits.otherwise(F.bround(x, 2)))

    several = raw.rlike(r"(?iu)\d\s*[xх×*]\s*\d")
    return (
        F.when(several | want.isNull(), raw).when((want == "inch") & inch.isNotNull(), shown(inch)).when(F.size(numbers) != 1, raw)
        .when(have.isNull(), number).when(factor.isNotNull(), shown(number.cast("double") * factor)).otherwise(raw)
    )


def card_sizes(props: Column, rows: Column) -> Column:
    """Distinct sizes of a card's table: the column headed RU, else the technical size; rows are structs of details, tech_size."""
    place = F.array_position(F.transform(props, lambda p: F.upper(F.trim(p))), "RU").cast("int")
    none = F.array().cast("array<string>")

    def own(row):
        named = sizes(F.when(place > 0, F.try_element_at(row["details"], F.greatest(place, F.lit(1)))))
        return F.when(F.size(F.coalesce(named, none)) > 0, named).otherwise(F.coalesce(sizes(row["tech_size"]), none))

    return F.array_distinct(F.flatten(F.transform(rows, own)))
