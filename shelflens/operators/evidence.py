"""Evidence rows put together from OCR text, parsed price and product text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelflens.functions.text import blank_to_null, has_text


def _unknown(name: Column) -> Column:
    return ~has_text(name) | (F.lower(F.trim(name)) == "unknown")


def _clamp(value: Column) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def _one_per_item(df: DataFrame, side: str) -> DataFrame:
    """The last result per item wins; columns get a prefix so sides cannot mix."""
    keep = [c for c in df.columns if c not in ("item_id", "result_no")]
    row = F.max_by(F.struct(*keep), F.col("result_no"))
    return df.groupBy("item_id").agg(row.alias(f"_{side}"))


def assemble_evidence(drafts: DataFrame, ocr: DataFrame, prices: DataFrame, names: DataFrame) -> DataFrame:
    """A result overrides the draft where it says something; each side counts as merged when present."""
    rows = drafts
    for side, df in (("ocr", ocr), ("price", prices), ("name", names)):
        rows = rows.join(_one_per_item(df, side), "item_id", "left")
    c = F.col
    has_ocr, has_price, has_name = c("_ocr").isNotNull(), c("_price").isNotNull(), c("_name").isNotNull()
    ocr_text = blank_to_null(c("_ocr.text"))
    name = blank_to_null(c("_name.raw_name"))
    after_ocr = F.when(ocr_text.isNotNull() & _unknown(c("raw_name")), ocr_text).otherwise(c("raw_name"))
    tag = F.coalesce(blank_to_null(c("price_tag_text")), ocr_text, blank_to_null(c("_name.price_tag_text")),
                     c("price_tag_text"))
    currency = F.upper(F.trim(c("_price.currency")))
    return rows.select(
        "item_id", F.coalesce(name, after_ocr).alias("raw_name"),
        F.when(has_ocr, ocr_text).otherwise(c("ocr_text")).alias("ocr_text"),
        F.when(has_ocr, _clamp(c("_ocr.confidence"))).otherwise(c("ocr_confidence")).alias("ocr_confidence"),
        tag.alias("price_tag_text"),
        *[F.when(has_price, c(f"_price.{p}")).otherwise(c(p)).alias(p)
          for p in ("price_minor", "old_price_minor", "promo_price_minor")],
        F.when(has_price, F.when(currency.rlike("^[A-Z]{3}$"), currency).otherwise("RUB"))
        .otherwise(c("currency")).alias("currency"),
        F.when(has_price, _clamp(c("_price.confidence"))).otherwise(c("parsed_price_confidence"))
        .alias("parsed_price_confidence"),
        F.coalesce(blank_to_null(c("_name.normalized")), c("normalized_product_text")).alias("normalized_product_text"),
        has_ocr.alias("ocr_merged"), has_price.alias("price_merged"), has_name.alias("name_merged"))


def assembly_metrics(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("drafts"), F.count_if("ocr_merged").alias("ocr_merged"),
        F.count_if("price_merged").alias("price_merged"), F.count_if("name_merged").alias("name_merged"),
        F.count_if(F.col("price_minor").isNotNull()).alias("priced"),
        F.count_if(F.col("old_price_minor").isNotNull()).alias("old_priced"),
        F.count_if(F.col("promo_price_minor").isNotNull()).alias("promo_priced"),
        F.count_if(~_unknown(F.col("raw_name"))).alias("named"),
        F.count_if(has_text(F.col("normalized_product_text"))).alias("normalized"))
