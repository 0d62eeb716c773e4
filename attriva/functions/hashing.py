"""Identifiers and cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm


def description_hash(text: Column) -> Column:
    """md5 over the sorted words of a description without tags and punctuation; "empty" for no text."""
    low = F.regexp_replace(F.lower(text), "<[^>]+>", " ")
    for mark in ('"', "”", "inch", "дюйм"):
        low = F.replace(low, F.lit(mark), F.lit(" inch "))
    words = F.filter(F.split(F.regexp_replace(low, r"[^\p{L}\p{N}_\s]", ""), r"\s+"), lambda x: x != "")
    return F.when(F.coalesce(text, F.lit("")) == "", "empty").otherwise(F.md5(F.array_join(F.array_sort(words), "").cast("binary")))


def prompt_key(*parts: Column) -> Column:
    """sha256 over the parts, joined by the zero character."""
    return F.sha2(F.array_join(F.array(*parts), "\u0000"), 256)


def product_hash(name: Column) -> Column:
    """The first 16 characters of the sha1 of the normalised name."""
    return F.left(F.sha1(norm(name).cast("binary")), F.lit(16))


def stable_uuid(namespace: bytes, name: Column) -> Column:
    """Name-based UUID, version 5, in a namespace of 16 bytes."""
    h = F.sha1(F.concat(F.lit(namespace), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
