"""Recognition payloads (loose JSON) to item rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelflens.functions.boxes import bbox_norm
from shelflens.functions.money import round_half_up
from shelflens.sources import json_fields as jf

# Where the item list and the warnings may be, and field spellings in order.
ITEM_PATHS = ["$", "$.items", "$.products", "$.results", "$.data", "$.data.items", "$.data.products"]
WARNING_PATHS = ["$.warnings", "$.data.warnings", "$.warning"]
NAME_FIELDS = ["$.raw_name", "$.name", "$.product_name", "$.product", "$.title", "$.price_tag_text", "$.product_visible_text"]
PRICE_FIELDS = ["$.price", "$.price_text", "$.current_price_minor", "$.current_price"]
OLD_FIELDS = ["$.old_price", "$.old_price_text"]
PROMO_FIELDS = ["$.promo_price", "$.promo_price_text"]
VISIBLE_FIELDS = ["$.product_visible_text", "$.packaging_text", "$.visible_text"]
ERROR_MALFORMED = "malformed JSON"
ERROR_EMPTY = "Пустой ответ от AI"


def strip_fence(text: Column) -> Column:
    trimmed = F.trim(text)
    inner = F.regexp_extract(trimmed, r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1)
    return F.when(inner != "", inner).otherwise(trimmed)


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """One row per payload: items, warnings and what went wrong; a bad payload is a row, not a failure."""
    rows = payloads.withColumn("_doc", F.try_parse_json(strip_fence(F.col("payload"))))
    rows = jf.spread(rows, "_doc", WARNING_PATHS).withColumn("_shape", jf.kind(F.col("_doc"))).withColumn(
        "_raw", jf.first_at(*WARNING_PATHS)).withColumn(
        "_items", F.coalesce(*[jf.array_field(F.col("_doc"), p) for p in ITEM_PATHS]))
    shape, raw = F.col("_shape"), F.col("_raw")
    structured = shape.startswith("ARRAY") | shape.startswith("OBJECT")
    error = F.when(F.col("_doc").isNull(), ERROR_MALFORMED).when(~structured, ERROR_EMPTY)
    listed = F.filter(F.transform(F.try_variant_get(raw, "$", "array<variant>"), jf.only_text), lambda w: w.isNotNull())
    single = F.when(jf.only_text(raw).isNotNull(), F.array(jf.only_text(raw)))
    warnings = F.when(shape.startswith("OBJECT"), F.coalesce(listed, single))
    none = F.array().cast("array<string>")
    no_list = F.when(error.isNull() & F.col("_items").isNull(), F.array(F.lit("JSON without an item array"))).otherwise(none)
    return rows.select(*payloads.columns, F.when(error.isNull(), F.col("_items")).alias("items"),
                       F.concat(F.coalesce(warnings, none), no_list).alias("warnings"), error.alias("error"))


# Spellings of box numbers.
BOX_FIELDS = {"x": ["$.bbox.x", "$.bbox.left", "$.bbox.xmin", "$.bbox.x_min"],
              "y": ["$.bbox.y", "$.bbox.top", "$.bbox.ymin", "$.bbox.y_min"],
              "right": ["$.bbox.xmax", "$.bbox.x_max", "$.bbox.right"],
              "bottom": ["$.bbox.ymax", "$.bbox.y_max", "$.bbox.bottom"],
              "width": ["$.bbox.width", "$.bbox.w"], "height": ["$.bbox.height", "$.bbox.h"]}
OWN_FIELDS = ["$.price_minor", "$.old_price_minor", "$.promo_price_minor", "$.brand", "$.size_text", "$.review_reason",
              "$.position_hint", "$.location", "$.confidence", "$.link_confidence", "$.price_tag_text"]


def _with_box(rows: DataFrame) -> DataFrame:
    """Corner list or named numbers, then side lengths, then the checked box; each step reads the one before."""
    four = F.coalesce(F.size("_corners") == 4, F.lit(False))
    top, left, low, far = (F.get("_corners", F.lit(i)) for i in range(4))
    n = {name: jf.number_at(*paths) for name, paths in BOX_FIELDS.items()}
    rows = rows.select("*", four.alias("_four"), *[c.alias(f"_{name}") for name, c in n.items()])
    rows = rows.select(
        "*", F.when(F.col("_four"), left).otherwise(F.col("_x")).alias("_bx"),
        F.when(F.col("_four"), top).otherwise(F.col("_y")).alias("_by"),
        F.when(F.col("_four"), far - left).otherwise(F.coalesce("_width", F.col("_right") - F.col("_x"))).alias("_bw"),
        F.when(F.col("_four"), low - top).otherwise(F.coalesce("_height", F.col("_bottom") - F.col("_y"))).alias("_bh"))
    return rows.withColumn("bbox", bbox_norm(F.col("_bx"), F.col("_by"), F.col("_bw"), F.col("_bh")))


def _share(path: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(jf.number_at(path), F.lit(0.0))))


def normalize_recognition(payloads: DataFrame) -> DataFrame:
    """Item rows; an item without name, texts and price is dropped."""
    kept = [c for c in payloads.columns if c != "payload"]
    rows = parse_payloads(payloads).select(*kept, F.posexplode("items").alias("item_no", "item"))
    paths = OWN_FIELDS + NAME_FIELDS + PRICE_FIELDS + OLD_FIELDS + PROMO_FIELDS + VISIBLE_FIELDS
    paths += [p for spellings in BOX_FIELDS.values() for p in spellings]
    rows = rows.select("*", F.try_variant_get("item", "$.bbox", "array<double>").alias("_corners"),
                       F.try_variant_get("item", "$.needs_review", "string").alias("_review"))
    rows = _with_box(jf.typed(jf.spread(rows, "item", paths), paths))

    def minor(whole: str, *prices: str) -> Column:
        return F.coalesce(round_half_up(jf.number_at(whole)), *[jf.recognition_price_at(p) for p in prices])
    out = rows.select(
        *kept, "item_no", jf.text_at(*NAME_FIELDS).alias("raw_name"), jf.text_at("$.brand").alias("brand"),
        jf.text_at("$.size_text").alias("size_text"), minor("$.price_minor", *PRICE_FIELDS).alias("price_minor"),
        minor("$.old_price_minor", *OLD_FIELDS).alias("old_price_minor"),
        minor("$.promo_price_minor", *PROMO_FIELDS).alias("promo_price_minor"), F.lit("RUB").alias("currency"),
        jf.text_at("$.price_tag_text").alias("price_tag_text"), jf.text_at(*VISIBLE_FIELDS).alias("product_visible_text"),
        _share("$.confidence").alias("confidence"), _share("$.link_confidence").alias("link_confidence"),
        F.coalesce(~F.col("_review").isin("false", "0", ""), F.lit(False)).alias("needs_review"),
        jf.text_at("$.review_reason").alias("review_reason"), jf.text_at("$.position_hint", "$.location").alias("position_hint"), "bbox")
    return out.where(F.col("raw_name").isNotNull() | F.col("product_visible_text").isNotNull() | F.col("price_minor").isNotNull())
