"""Source runs: failure streaks, statistics, stale runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelflens.operators.price_history import in_ranges, join_same

def failure_streaks(runs: DataFrame, recent: int | None = None) -> DataFrame:
    """Per source, how many of its newest runs failed without a break; ``recent`` (alert screens use 10) bounds the count.

    This is the summary of one stretch that holds everything: two aggregates, reduced in each task, so a source with most of the
    runs is never ordered in one task.
    """
    whole = streak_summary(runs, ["source_id"])
    streak = F.col("tail") if recent is None else F.least("tail", F.lit(recent))
    return whole.select("source_id", streak.cast("bigint").alias("streak"), F.col("_end.run_id").alias("last_run_id"), "last_status")


def streak_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """What a stretch of runs says about failures in a row, per ``by``: how many runs, how many failures after the last good one.

    Summaries of neighbouring stretches add up (:func:`joined_summaries`), so stretches may be tasks, days or batches.
    """
    place = F.struct("started_at", "run_id")
    rows = runs.select(*by, "status", place.alias("_place"))
    last = rows.groupBy(*by).agg(F.max(F.when(F.col("status") != "failed", F.col("_place"))).alias("_ok"), F.count("*").alias("runs"),
                                 F.max("_place").alias("_end"), F.max_by("status", "_place").alias("last_status"))
    joined = join_same(rows.select(*by, "_place"), last, by)
    return joined.groupBy(*by).agg(
        F.count_if(F.col("_ok").isNull() | (F.col("_place") > F.col("_ok"))).alias("tail"), F.first("runs").alias("runs"),
        F.first("_end").alias("_end"), F.first("last_status").alias("last_status")).withColumn("all_failed", F.col("tail") == F.col("runs"))


def joined_summaries(summaries: DataFrame, by: list[str], slot: str) -> DataFrame:
    """Summaries of a key's stretches in the order of ``slot``, with ``carried``: the failures in a row before each stretch.

    Tails add up from the last stretch that holds a good run; one row per key and stretch is ordered, no runs.
    """
    before = Window.partitionBy(*by).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum("tail").over(before), F.lit(0))
    rows = summaries.withColumn("_total", total)
    base = F.last(F.when(~F.col("all_failed"), F.col("_total")), ignorenulls=True).over(before)
    return rows.withColumn("carried", F.col("_total") - F.coalesce(base, F.lit(0))).drop("_total")


def streaks_per_run(runs: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Every run with ``streak``, the failures in a row up to it; ``earlier`` (source_id, streak) is where the sources stand before.

    Runs are cut into range partitions of even size. A run counts inside its partition; if no good run comes first there, what the
    partitions before carry is added.
    """
    rows = in_ranges(runs, ["source_id"], ["started_at", "run_id"], "_slot")
    key = ["source_id", "_slot"]
    summaries = streak_summary(rows, key).select(*key, "tail", "all_failed")
    if earlier is not None:
        summaries = summaries.unionByName(earlier.select(
            "source_id", F.lit(-1).alias("_slot"), F.col("streak").alias("tail"), F.lit(False).alias("all_failed")))
    carried = joined_summaries(summaries, ["source_id"], "_slot").where("carried > 0").select(*key, "carried")
    inside = Window.partitionBy(*key).orderBy("started_at", "run_id")
    failed = (F.col("status") == "failed").cast("int")
    placed = rows.withColumn("_island", F.sum(1 - failed).over(inside))
    counted = placed.withColumn("_count", F.sum(failed).over(Window.partitionBy(*key, "_island").orderBy("started_at", "run_id")))
    first = F.when((F.col("_island") == 0) & (F.col("status") == "failed"), F.coalesce("carried", F.lit(0))).otherwise(0)
    return join_same(counted, carried, key).select(
        *runs.columns, (F.col("_count") + first).cast("bigint").alias("streak"))


def run_stats(results: DataFrame) -> DataFrame:
    """A1: counters per run over result rows (one per fetched product)."""
    matched = F.col("product_id").isNotNull() & (F.col("match_status") != "needs_review")
    return results.groupBy("run_id").agg(
        F.count("*").alias("fetched"),
        F.count_if(F.col("source_product_id").isNotNull()).alias("products_upserted"),
        F.count_if(F.col("price_minor").isNotNull()).alias("prices_inserted"),
        F.count_if(matched).alias("matched"),
        F.count_if(F.col("match_status") == "needs_review").alias("unmatched"),
        F.count_if(F.col("error").isNotNull()).alias("errors"))


def stale_action(started: Column, now: Column, timeout_minutes: float = 30.0) -> Column:
    """Ok, requeue at the timeout, fail at twice the timeout; a missing start is ok."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))) / F.lit(60e6)
    return (F.when(age >= 2 * timeout_minutes, "fail").when(age >= timeout_minutes, "requeue").otherwise("ok"))


def stale_runs(runs: DataFrame, now: Column, timeout_minutes: float = 30.0) -> DataFrame:
    running = runs.where(F.col("status") == "running")
    return running.withColumn("action", stale_action(F.col("started_at"), now, timeout_minutes))


def fail_stuck(rows: DataFrame, now: Column, minutes: float = 20.0, busy: str = "processing") -> DataFrame:
    """R11 for jobs and photos: busy longer than ``minutes`` becomes failed."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / F.lit(60e6)
    stuck = (F.col("status") == busy) & (age > minutes)
    return rows.withColumn("status", F.when(stuck, "failed").otherwise(F.col("status")))


def run_rollup(runs: DataFrame, bucket: str = "hour") -> DataFrame:
    return (runs.groupBy("source_id", F.date_trunc(bucket, "started_at").alias("period"))
            .agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failed")))
