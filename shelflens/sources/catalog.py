"""Catalogue import: header spellings, row checks, upsert and audit (S1 to S4), product dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelflens.functions import fixed_values as fv
from shelflens.functions.money import import_price_to_minor
from shelflens.functions.text import first_text
from shelflens.sources.records import read_fields


def _aliased(columns: list[str], field: str) -> Column:
    """First non-blank value among the header spellings present."""
    present = {c.strip().lower(): c for c in columns}
    found = [F.col(f"`{present[a]}`").cast("string") for a in fv.CATALOG_HEADERS[field] if a in present]
    return first_text(*found) if found else F.lit(None).cast("string")


def normalize_catalog(raw: DataFrame, row_number: str = "row_number") -> DataFrame:
    """Named catalogue columns from any known header spelling; fully blank rows are left out."""
    data = [c for c in raw.columns if c != row_number]
    filled = F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in data])
    rows = raw.where(filled.isNotNull())
    return rows.select(F.col(row_number), _aliased(data, "external_sku").alias("external_sku"),
                       _aliased(data, "name").alias("name"), _aliased(data, "brand").alias("brand"),
                       _aliased(data, "size_text").alias("size_text"),
                       import_price_to_minor(_aliased(data, "price")).alias("own_price_minor"))


def read_catalog(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """All catalogue files under ``path``, each with its own header and (unless ``sep`` is given) delimiter, with file and row number.

    Row numbers are those of the file: 1 is the header, every record after it counts, also one that spans several lines; rows with
    no field filled are left out.
    """
    rows = read_fields(spark, path, sep).withColumn("filled", F.exists("fields", lambda f: f != "")).where("filled")

    def named(field: str) -> Column:
        at = [F.array_position("header", alias) for alias in fv.CATALOG_HEADERS[field]]
        return first_text(*[F.when(p > 0, F.get("fields", (p - 1).cast("int"))) for p in at])

    return rows.select("file", (F.col("record") + 1).alias("row_number"), *[named(f).alias(f) for f in ("external_sku", "name", "brand", "size_text")],
                       import_price_to_minor(named("price")).alias("own_price_minor"))


def check_rows(rows: DataFrame) -> DataFrame:
    """The error of a row, null when it is fine."""
    error = (F.when(F.col("external_sku").isNull(), fv.ERROR_NO_SKU).when(F.col("name").isNull(), fv.ERROR_NO_NAME))
    return rows.withColumn("error", error)


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = check_rows(rows)
    return checked.where(F.col("error").isNull()).drop("error"), checked.where(F.col("error").isNotNull())


def upsert_catalog(current: DataFrame, valid: DataFrame) -> DataFrame:
    """S3: new catalogue state; the last row per SKU wins. ``change`` tells created, updated and kept apart."""
    batch = valid.groupBy("external_sku").agg(F.max_by(
        F.struct("name", "brand", "size_text", "own_price_minor"), "row_number").alias("b"))
    known = current.select("external_sku", "product_id", F.struct("name", "brand", "size_text", "own_price_minor").alias("c"))
    out = known.join(batch, "external_sku", "full_outer")
    row = F.when(F.col("b").isNotNull(), F.col("b")).otherwise(F.col("c"))
    change = (F.when(F.col("b").isNull(), "kept").when(F.col("product_id").isNull(), "created").otherwise("updated"))
    return out.select(
        F.coalesce(F.col("product_id").cast("string"), F.concat(F.lit("sku-"), F.col("external_sku"))).alias("product_id"),
        "external_sku", *[row[f].alias(f) for f in ("name", "brand", "size_text", "own_price_minor")],
        change.alias("change"))


def upsert_stats(state: DataFrame) -> DataFrame:
    return state.agg(F.count_if(F.col("change") == "created").alias("created"),
                     F.count_if(F.col("change") == "updated").alias("updated"))


def import_audit(checked: DataFrame, state: DataFrame) -> DataFrame:
    """One record per input row: its error or the product it went to."""
    ids = state.select("external_sku", F.col("product_id").alias("_id"))
    return checked.join(ids, "external_sku", "left").select(
        "row_number", "external_sku", "error", F.when(F.col("error").isNull(), F.col("_id")).alias("product_id"))


def import_status(audit: DataFrame) -> DataFrame:
    errors = F.count_if(F.col("error").isNotNull())
    return audit.agg(F.count("*").alias("row_count"), errors.alias("error_count"),
                     F.when(errors > 0, "completed_with_errors").otherwise("completed").alias("status"))


def upsert_products(current: DataFrame | None, seen: DataFrame) -> DataFrame:
    """Source products with their newest attributes, first and last time seen."""
    key = ["company_id", "source_id", "source_product_id"]
    attributes = ["title", "brand", "size_text", "barcode", "url"]
    fresh = seen.select(*key, *attributes, F.col("observed_at").alias("first_seen_at"), F.col("observed_at").alias("last_seen_at"))
    rows = fresh.unionByName(current.select(*fresh.columns)) if current is not None else fresh
    out = rows.groupBy(*key).agg(
        F.max_by(F.struct(*attributes), F.struct("last_seen_at", *attributes)).alias("a"),
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))
    return out.select(*key, "a.*", "first_seen_at", "last_seen_at")
