"""Scans (S1 to S18): files in, relations out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model


def requests(spark: SparkSession, path: str, most_urls: int = 5, most_images: int = 10) -> tuple[DataFrame, DataFrame]:
    """Product requests from JSON: rows that keep the limits (https only, number of links), and the others."""
    rows = spark.read.schema(model.PRODUCTS).json(path)
    return valid_requests(rows, most_urls, most_images)


def valid_requests(rows: DataFrame, most_urls: int = 5, most_images: int = 10) -> tuple[DataFrame, DataFrame]:
    none = F.array().cast("array<string>")
    urls = F.coalesce("source_urls", none)
    ok = (F.size(urls) <= most_urls) & F.forall(urls, lambda u: F.startswith(u, F.lit("https://"))) & (F.size(F.coalesce("image_urls", none)) <= most_images)
    return rows.where(ok), rows.where(~ok)


def products_csv(spark: SparkSession, path: str, optional: tuple[str, ...] = ("description", "brand", "ean", "category_path")) -> DataFrame:
    """Products from CSV: product_name is needed, missing optional columns are null."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if "product_name" not in rows.columns:
        raise ValueError("product_name is missing")
    return rows.select("*", *[F.lit(None).cast("string").alias(c) for c in optional if c not in rows.columns])


def template(rows: DataFrame, system: tuple[str, ...]) -> DataFrame:
    """S3: a sheet with one column for each characteristic as (system columns, name, value); rows without a key go."""
    other = [c for c in rows.columns if c not in system]
    kept = rows.where(F.col(system[0]).isNotNull())
    return kept.unpivot(list(system), other, "name", "value") if other else kept.select(*system, F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("value"))


def allowed_values(sheet: DataFrame) -> DataFrame:
    """Sorted distinct values of each column of a validation sheet, as (name, allowed_values)."""
    long = sheet.unpivot([], sheet.columns, "name", "value").where("value is not null and trim(value) <> ''")
    return long.groupBy("name").agg(F.array_sort(F.collect_set("value")).alias("allowed_values"))


def derived_targets(columns: list[str], system: tuple[str, ...], allowed: DataFrame) -> DataFrame:
    """Targets numbered from 1 for the columns that are not of the system; enum if there is a value list."""
    spark = allowed.sparkSession
    names = spark.createDataFrame([(i + 1, c) for i, c in enumerate(c for c in columns if c not in system)], "attribute_id long, name string")
    return names.join(allowed, "name", "left").withColumn("type", F.when(F.col("allowed_values").isNotNull(), "enum").otherwise("text"))


def parquet(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """The wanted columns of files whose schemas differ; missing ones are null, broken files are left out."""
    rows = spark.read.option("mergeSchema", True).option("ignoreCorruptFiles", True).parquet(path)
    return rows.select(*[(F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t)).alias(c) for c, t in columns.items()])


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, packed or not, one file or a pattern; broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def delimited(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Delimited text with a header, packed or not, in any encoding."""
    return spark.read.option("header", True).option("sep", sep).option("encoding", encoding).csv(path)


def tree(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents over several lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def page_text(pages: DataFrame, keys: list[str], order: str, text: str, source: str) -> DataFrame:
    """A product's fetched texts in order, each under its source; empty ones left out."""
    part = F.struct(F.col(order), F.concat(F.lit("["), F.col(source), F.lit("] "), F.col(text)).alias("t"))
    kept = pages.where((F.col(text).isNotNull()) & (F.trim(text) != ""))
    return kept.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n").alias("text"))


def payload(id_: Column, name: Column, categories: Column, characteristics: Column, source: str) -> list[Column]:
    """The common payload of all datasets: texts cut to their lengths, characteristics as JSON."""
    return [id_.alias("id"), F.left(name, F.lit(300)).alias("name"), F.left(categories, F.lit(300)).alias("categories"), F.to_json(characteristics).alias("characteristics"), F.lit(source).alias("source")]
