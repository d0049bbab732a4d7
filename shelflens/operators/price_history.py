"""Latest price, source precedence, and change against the previous observation.

Two shapes are used throughout:

* "newest row per key" is an aggregate (``max_by``): each task reduces its own rows first, so a key that holds a
  third of the data leaves every task as one row;
* "previous row per key" is a window over the key, for which rows move once. Keys that may have more than ``BUSY_ROWS`` rows are ordered
  by key and time over range partitions of even size instead, so a busy key or a busy day is split. Only one row per
  key and partition crosses over to the next partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelflens.session import materialize

PAIR = ["product_id", "store_id"]
BUSY_ROWS, KEY_BUCKETS = 1_000_000, 1 << 16
MODES = ("photo_only", "online_only", "online_preferred", "latest", "freshest")


def newest_per_key(df: DataFrame, keys: list[str], order: list[str], keep: list[str] | None = None) -> DataFrame:
    """One row per key: the greatest by ``order``; ``order`` must end in a unique column."""
    keep = keep or [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in keep])


def latest_prices(observations: DataFrame, keys: list[str] = PAIR, order: list[str] | None = None) -> DataFrame:
    """Newest priced observation per (product, store); rows without product or price do not count."""
    order = order or ["observed_at", "obs_id"]
    usable = observations.where(F.col("product_id").isNotNull() & F.col("price_minor").isNotNull())
    keep = [c for c in ("price_minor", "observed_at", "source", "obs_id") if c in observations.columns]
    return newest_per_key(usable, keys, order, keep)


def latest_photo_prices(shelf_items: DataFrame, week: int, keys: list[str] = PAIR) -> DataFrame:
    """W1 for photos: one week, by capture day, then creation time, then id."""
    rows = shelf_items.where(F.col("week") == week)
    return latest_prices(rows, keys, ["captured_date", "created_at", "obs_id"])


def merge_sources(observations: DataFrame, mode: str, keys: list[str] = PAIR) -> DataFrame:
    """One price per (product, store) from rows tagged ``source`` = online or photo.

    ``latest`` follows the behaviour the reports were built on (online first, photo fills gaps); ``freshest`` takes
    the newest row whatever its source.
    """
    if mode not in MODES:
        raise ValueError(f"unknown price mode: {mode}")
    rows = observations.where(F.col("product_id").isNotNull() & F.col("price_minor").isNotNull())
    if mode.endswith("_only"):
        rows = rows.where(F.col("source") == mode.removesuffix("_only"))
    if mode in ("online_preferred", "latest"):
        rows = rows.withColumn("_priority", (F.col("source") == "online").cast("int"))
        order = ["_priority", "observed_at", "obs_id"]
    else:
        order = ["observed_at", "obs_id"]
    return newest_per_key(rows, keys, order, ["price_minor", "source", "observed_at"])


def in_ranges(df: DataFrame, keys: list[str], order: list[str], slot: str) -> DataFrame:
    """``df`` with the number of its range partition by (``keys``, ``order``) as ``slot``: along a key's order it never decreases.

    Partitions hold about the same number of rows, however many of them share a key or a day. The rows are written down, so
    that a lost task does not draw other bounds.
    """
    return materialize(df.repartitionByRange(*keys, *order).withColumn(slot, F.spark_partition_id()), "ranges")


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on equal keys, where null equals null; the keys of the left side stay."""
    other = right.select(*[F.col(k).alias(f"_same_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys])
    return left.join(other, on, how).drop(*[f"_same_{k}" for k in keys])


def _busy(df: DataFrame, keys: list[str]) -> Column | None:
    """Whether a row's key may have more than ``BUSY_ROWS`` rows, or None if no key has. Rows are counted by the key's hash."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS))
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    busy = [r.bucket for r in counts.where(F.col("n") > BUSY_ROWS).collect()]  # few: each stands for so many rows
    return bucket.isin(busy) if busy else None


def with_previous(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Adds ``previous_<value>`` from the row before in ``order`` within ``keys``, and whether there is one as ``has_previous``."""
    busy = _busy(df, keys)
    usual = df if busy is None else df.where(~busy)
    out = usual.withColumn("_prev", F.lag(F.struct(*values)).over(Window.partitionBy(*keys).orderBy(*order)))
    if busy is not None:
        out = out.unionByName(_previous_of_busy(df.where(busy), keys, order, values))
    return out.select(*df.columns, *[F.col("_prev")[v].alias(f"previous_{v}") for v in values],
                      F.col("_prev").isNotNull().alias("has_previous"))


def _previous_of_busy(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The row before as ``_prev``, for keys of any number of rows.

    A key's rows are cut into slots, range partitions of even size.
    Rows after the first of a slot get their value in a window over the slot; the first row of each slot gets the last row of
    the key's slot before, which is an aggregate: one row per key and slot is ordered across slots.
    """
    rows = in_ranges(df, keys, order, "_slot")
    in_slot = Window.partitionBy(*keys, "_slot").orderBy(*order)
    payload = F.struct(*values)
    placed = rows.withColumn("_prev", F.lag(payload).over(in_slot)).withColumn("_nth", F.row_number().over(in_slot))
    ends = rows.groupBy(*keys, "_slot").agg(F.max_by(payload, F.struct(*order)).alias("_end"))
    across = Window.partitionBy(*keys).orderBy("_slot")
    ends = ends.select(*keys, "_slot", F.lag("_end").over(across).alias("_before")).where(F.col("_before").isNotNull())
    heads = placed.where(F.col("_nth") == 1).drop("_prev")
    heads = join_same(heads, ends, [*keys, "_slot"]).select(*df.columns, F.col("_before").alias("_prev"))
    return placed.where(F.col("_nth") > 1).select(*df.columns, "_prev").unionByName(heads)


def price_changes(observations: DataFrame, keys: list[str] = PAIR, order: list[str] | None = None) -> DataFrame:
    """Absolute change in percent against the previous observation; null without a usable previous price."""
    order = order or ["observed_at", "obs_id"]
    rows = with_previous(observations.where(F.col("price_minor").isNotNull()), keys, order, ["price_minor"])
    previous = F.col("previous_price_minor")
    change = F.abs((F.col("price_minor") - previous).cast("double") / previous) * 100
    return rows.withColumn("change_pct", F.when(previous != 0, change))


def stock_transitions(observations: DataFrame, keys: list[str] = PAIR, order: list[str] | None = None) -> DataFrame:
    """All rows, with whether a product seen before as not out of stock is out of stock now, as ``went_out_of_stock``."""
    order = order or ["observed_at", "obs_id"]
    rows = with_previous(observations, keys, order, ["availability"])
    before = F.col("previous_availability")
    gone = (F.col("availability") == "out_of_stock") & F.col("has_previous") & (before.isNull() | (before != "out_of_stock"))
    return rows.withColumn("went_out_of_stock", F.coalesce(gone, F.lit(False)))


def out_of_stock_transitions(observations: DataFrame, keys: list[str] = PAIR,
                             order: list[str] | None = None) -> DataFrame:
    """Rows where a product seen before as not out of stock is out of stock now."""
    return stock_transitions(observations, keys, order).where("went_out_of_stock").drop("went_out_of_stock")


def carry_forward(df: DataFrame, keys: list[str], position: str, value: str, name: str,
                  block_rows: int = 10_000) -> DataFrame:
    """Last non-null ``value`` at or before each row's ``position`` within ``keys``.

    Positions are cut into blocks; each block is filled on its own and the first rows of a block, which have no value
    yet, take the last one of the blocks before. Only one row per block is ordered across a key.
    """
    rows = df.withColumn("_block", F.floor(F.col(position) / block_rows))
    inside = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_filled", F.last(value, ignorenulls=True).over(inside))
    ends = (rows.groupBy(*keys, "_block")
            .agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(position))).alias("_end")))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_block", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    joined = rows.join(ends, [*keys, "_block"], "left")
    return joined.select(*df.columns, F.coalesce("_filled", "_carried").alias(name))


def compare_with_own(latest: DataFrame, catalog: DataFrame) -> DataFrame:
    """J16 + N17: latest competitor price next to the own price of the product."""
    from shelflens.functions.money import diff_minor, diff_ratio
    own = catalog.select("product_id", "own_price_minor")
    joined = latest.join(own, "product_id")
    competitor, mine = F.col("price_minor"), F.col("own_price_minor")
    return joined.withColumn("diff_minor", diff_minor(competitor, mine)).withColumn(
        "diff_ratio", diff_ratio(competitor, mine))


def price_rollup(observations: DataFrame, bucket: str = "day") -> DataFrame:
    """Price roll-up per product, store and period (the batch side of the live roll-up)."""
    return (observations.where(F.col("price_minor").isNotNull())
            .groupBy("product_id", "store_id", F.date_trunc(bucket, "observed_at").alias("period"))
            .agg(F.count("*").alias("observations"), F.min("price_minor").alias("min_price_minor"),
                 F.max("price_minor").alias("max_price_minor")))
