"""Schemas of the catalog relations, as DDL text, and the sources dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRODUCTS = (
    "product_id long, category_id long, id_path string, name string, description string, price decimal(18,4), brand string, ean string, languages array<string>, source_urls array<string>, image_urls array<string>"
)
TARGETS = (
    "category_id long, attribute_id long, name string, type string, allowed_values array<string>, semantic_type string, is_collection boolean, is_required boolean"
)
CANDIDATES = (
    "product_id long, seq long, attribute_id long, value_str string, value_arr array<string>, is_list boolean, confidence double, source string, evidence string, "
    "judge_validated boolean, semantic_type string, is_collection boolean, value_id long, value_ids array<long>"
)
DICT_VALUES = (
    "cat_id long, type_id long, attribute_id long, value_id long, value string"
)
CORRECTIONS = (
    "run_id string, created_at timestamp, product_name_hash string, product_name string, brand string, category_path string, attribute_id long, attribute_name string, "
    "ai_value string, ai_confidence double, ai_source string, corrected_value string, corrected_at timestamp"
)

# Source, priority, confidence threshold, judge threshold (null: judged by verdict), legacy priority (lower wins)
SOURCES = (
    ("description", 4, 0.95, None, 1),
    ("llm_knowledge", 1, 0.92, None, 4),
    ("vision", 3, 0.85, None, 3),
    ("web_search", 2, 0.88, None, 2),
    ("competitor_rag", 2, 0.80, 0.60, None),
    ("icecat", 3, 0.90, 0.85, None),
    ("pdf_datasheet", 4, 0.90, 0.85, None),
    ("ozon_card", 4, 0.90, 0.80, None),
    ("wb_card", 4, 0.90, 0.80, None),
    ("ugc", 2, 0.75, 0.70, None),
    ("safe_enum_fill", 1, 0.82, None, None),
    ("lamoda", 4, 0.90, None, None),
    ("yandex_market", 3, 0.82, None, None),
    ("web_marketplace", 3, 0.82, None, None),
)
# Semantic types whose values are never confident
CRITICAL_SEMANTIC_TYPES = ("ean", "upc", "gtin", "barcode", "article", "sku", "serial", "imei", "model_code")
# Classes of sources
CARD_SOURCES = ("wb_card", "ozon_card")
AUTHORITATIVE = ("wb_card", "ozon_card", "lamoda", "icecat", "pdf_datasheet", "description")
OVERRIDE = ("wb_card", "ozon_card", "icecat", "pdf_datasheet")
INFERENCE = ("llm_knowledge", "web_search")
BRAND_GUESSING = ("vision", "web_search", "llm_knowledge", "competitor_rag")

SOURCES_SCHEMA = "source string, priority int, threshold double, judge_threshold double, legacy_priority int"


def sources(spark: SparkSession) -> DataFrame:
    """The sources dimension: 14 rows."""
    return spark.createDataFrame(list(SOURCES), SOURCES_SCHEMA)


def _lookup(source: Column, place: int, kind: str) -> Column:
    pairs = [x for row in SOURCES for x in (F.lit(row[0]), F.lit(row[place]).cast(kind))]
    return F.try_element_at(F.create_map(*pairs), source)


def priority(source: Column) -> Column:
    return _lookup(source, 1, "int")


def threshold(source: Column) -> Column:
    return _lookup(source, 2, "double")


def judge_threshold(source: Column) -> Column:
    return _lookup(source, 3, "double")


def legacy_priority(source: Column) -> Column:
    return _lookup(source, 4, "int")
