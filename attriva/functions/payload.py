"""Checks of a product before it is sent (N19) and of answers that come back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# What a field may hold
VATS, WEIGHT_UNITS, DIMENSION_UNITS = ("0", "0.10", "0.20"), ("g", "kg"), ("mm", "cm", "in")
MOST_IMAGES, OFFER, NAME, DESCRIPTION = 15, 50, 500, 4000


def positive_number(c: Column) -> Column:
    """Whether a text is a number over 0."""
    return F.coalesce(strip(c).try_cast("double") > 0, F.lit(False))


def product_errors(row: dict[str, Column]) -> Column:
    """The names of the fields that break a rule, in order; ``row``: a Column for each field.

    Texts keep their lengths, price and, if given, old price are numbers over 0, vat and units are known ones, there are 1 to
    15 images, weight and dimensions are over 0.
    """
    size = lambda c, most: (F.length(c) >= 1) & (F.length(c) <= most)
    tests = {
        "offer_id": size(row["offer_id"], OFFER), "name": size(row["name"], NAME), "description": row["description"].isNull() | (F.length(row["description"]) <= DESCRIPTION), "price": positive_number(row["price"]),
        "old_price": row["old_price"].isNull() | positive_number(row["old_price"]), "vat": F.coalesce(row["vat"], F.lit("0.20")).isin(*VATS), "images": (F.size(row["images"]) >= 1) & (F.size(row["images"]) <= MOST_IMAGES),
        "weight": row["weight"] > 0, "weight_unit": F.coalesce(row["weight_unit"], F.lit("g")).isin(*WEIGHT_UNITS), "depth": row["depth"] > 0, "width": row["width"] > 0, "height": row["height"] > 0,
        "dimension_unit": F.coalesce(row["dimension_unit"], F.lit("mm")).isin(*DIMENSION_UNITS),
    }
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in tests.items()]))


def unfenced(c: Column) -> Column:
    """An answer's text without a code fence around it."""
    text = strip(c)
    inner = F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*(?:\n|$)", ""), r"\n?[ \t]*```[^\n]*$", "")
    return F.when(F.startswith(text, F.lit("```")), inner).otherwise(text)


def parsed_answer(c: Column, schema: str, required: tuple[str, ...] = ()) -> Column:
    """An answer as a struct of ``schema``; null where it is no JSON object or lacks a required field."""
    got = F.from_json(unfenced(c), f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    whole = got.isNotNull() & got["_broken"].isNull()
    for name in required:
        whole = whole & got[name].isNotNull()
    return F.when(whole, got.dropFields("_broken"))
