"""Box arithmetic for price tags on photos."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def bbox_norm(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Box as shares of the image; per-mille input is scaled, boxes outside the image are null."""
    x, y, width, height = (c.cast("double") for c in (x, y, width, height))
    largest = F.greatest(x, y, width, height, x + width, y + height)
    scale = F.when((largest > 2) & (largest <= 1000), F.lit(1000.0)).otherwise(F.lit(1.0))
    x, y, width, height = x / scale, y / scale, width / scale, height / scale
    inside = ((x >= 0) & (y >= 0) & (width > 0) & (height > 0)
              & (x + width <= 1.001) & (y + height <= 1.001))
    cx, cy = F.least(F.lit(1.0), x), F.least(F.lit(1.0), y)
    return F.when(inside, _box(cx, cy, F.least(width, 1 - x), F.least(height, 1 - y)))


def padded_box(x: Column, y: Column, width: Column, height: Column, image_width: Column, image_height: Column,
               pixels: float = 0, ratio: float = 0.0) -> Column:
    """Box grown by the larger padding, cut to the image; null when nothing is left."""
    padding = F.greatest(F.lit(max(0, int(pixels))), F.floor(F.greatest(width, height) * F.lit(max(0.0, ratio))))
    raw = [F.floor(x - padding), F.floor(y - padding), F.ceil(x + width + padding), F.ceil(y + height + padding)]
    limits = [image_width, image_height, image_width, image_height]
    cut = [F.greatest(F.lit(0), F.least(r, m)).cast("bigint") for r, m in zip(raw, limits)]
    clamped = (cut[0] != raw[0]) | (cut[1] != raw[1]) | (cut[2] != raw[2]) | (cut[3] != raw[3])
    usable = ((width > 0) & (height > 0) & (image_width > 0) & (image_height > 0)
              & (cut[2] > cut[0]) & (cut[3] > cut[1]))
    return F.when(usable, F.struct(
        cut[0].alias("x"), cut[1].alias("y"), (cut[2] - cut[0]).alias("width"), (cut[3] - cut[1]).alias("height"),
        padding.cast("bigint").alias("padding_px"), clamped.alias("was_clamped")))
