"""Retail sources: eligibility, detection from store names, overview, catalogue search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from shelflens.functions import fixed_values as fv
from shelflens.functions.text import store_name_norm


def eligible_sources(sources: DataFrame, source_stores: DataFrame) -> DataFrame:
    """enabled, legally allowed sources with an enabled store link."""
    ok = sources.where(F.col("enabled") & (F.col("legal_status") == "allowed"))
    return ok.join(source_stores.where("link_enabled"), "source_id")


def detect_sources(stores: DataFrame, competitors: DataFrame) -> DataFrame:
    """Retailers recognised in competitor store names (high), else in competitor names (medium).

    The patterns are a fixed list, so containment is a row expression; the first name per source is an aggregate.
    """
    names = stores.where(~F.col("is_own") & F.col("competitor_id").isNotNull()).select(
        "name", F.lit("high").alias("confidence"), F.lit(0).alias("_order")).unionByName(
        competitors.select("name", F.lit("medium").alias("confidence"), F.lit(1).alias("_order")))
    norm = store_name_norm(F.col("name"))
    hits = F.array_compact(F.array(*[
        F.when(F.exists(F.array(*[store_name_norm(F.lit(p)) for p in patterns]), lambda p: norm.contains(p)), key)
        for key, patterns in fv.SOURCE_PATTERNS.items()]))
    found = names.select("name", "confidence", "_order", F.explode(hits).alias("source_key"))
    first = found.groupBy("source_key").agg(F.min(F.struct("_order", "name", "confidence")).alias("m"))
    return first.select("source_key", F.col("m.confidence").alias("confidence"), F.col("m.name").alias("found_in"))


def source_overview(sources: DataFrame, runs: DataFrame, source_stores: DataFrame, stores: DataFrame) -> DataFrame:
    """Source with its latest run and its enabled stores by name."""
    last = runs.groupBy("source_id").agg(
        F.max("started_at").alias("last_run_at"), F.max_by("status", F.struct("started_at", "run_id")).alias("last_run_status"))
    linked = (source_stores.where("link_enabled").select("source_id", "store_id")
              .join(stores.select("store_id", "name"), "store_id", "left").groupBy("source_id")
              .agg(F.array_sort(F.collect_list(F.struct("store_id", "name"))).alias("stores")))
    return sources.join(last, "source_id", "left").join(linked, "source_id", "left")


def search_catalog(catalog: DataFrame, query: str | None = None, price: str | None = None, page: int = 1,
                   page_size: int = 50) -> tuple[DataFrame, DataFrame]:
    """(one page of the catalogue, newest first; the total number of hits).

    The text is taken literally, so % and _ need no escaping. The page size is the caller's.
    """
    rows = catalog
    text = (query or "").strip().lower()
    if text:
        fields = ("external_sku", "name", "brand", "size_text")
        hit = None
        for f in fields:
            one = F.coalesce(F.lower(F.col(f)).contains(text), F.lit(False))
            hit = one if hit is None else hit | one
        rows = rows.where(hit)
    if price in ("missing", "present"):
        rows = rows.where(F.col("own_price_minor").isNull() if price == "missing" else F.col("own_price_minor").isNotNull())
    size = max(page_size, 1)
    total = rows.agg(F.count("*").alias("total_count"))
    shown = rows.orderBy(F.col("created_at").desc(), "product_id").offset((max(page, 1) - 1) * size).limit(size)
    return shown, total


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
