"""Review queue: task filters, counters and badges per item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelflens.functions import fixed_values as fv
from shelflens.functions.text import has_text

TASKS = ("all", "todo", "without_candidate", "size_risk", "missing_own_price", "ready")


def review_flags(items: DataFrame, active_matches: DataFrame, candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """F5 flags per item: suggestions are reduced to three flags before they meet the items."""
    facts = catalog.select("product_id", F.col("own_price_minor").isNull().alias("_no_price"),
                           has_text(F.col("size_text")).alias("_has_size"))
    hints = candidates.select("item_id", "product_id").join(facts, "product_id").groupBy("item_id").agg(
        F.count("*").alias("_hints"), F.max("_no_price").alias("_hint_no_price"), F.max("_has_size").alias("_hint_size"))
    active = active_matches.where("is_active").select("item_id", "product_id", "decision").join(
        facts.select("product_id", F.col("_no_price").alias("_active_no_price")), "product_id", "left")
    rows = items.join(active.select("item_id", "decision", "_active_no_price",
                                    F.lit(True).alias("_active")), "item_id", "left").join(hints, "item_id", "left")
    todo = F.col("status").isin("recognized", "needs_review")
    no_hints = F.coalesce("_hints", F.lit(0)) == 0
    unsized = ~has_text(F.col("size_text"))
    missing = F.coalesce("_active_no_price", "_hint_no_price", F.lit(False))
    return (rows.withColumn("is_todo", todo)
            .withColumn("is_ready", F.col("status").isin("matched", "confirmed", "unmatched"))
            .withColumn("is_without_candidate", todo & F.col("_active").isNull() & no_hints)
            .withColumn("is_size_risk", unsized & F.coalesce("_hint_size", F.lit(False)))
            .withColumn("is_missing_own_price", missing)
            .withColumn("badges", _badges(unsized, missing, todo & F.col("_active").isNull() & no_hints))
            .drop("_hints", "_hint_no_price", "_hint_size", "_active", "_active_no_price"))


def _badges(unsized: Column, missing: Column, without: Column) -> Column:
    return F.array_compact(F.array(
        F.when(without, fv.BADGE_NO_CANDIDATE),
        F.when(unsized & F.coalesce("_hint_size", F.lit(False)), fv.BADGE_SIZE_RISK),
        F.when(missing, fv.BADGE_NO_OWN_PRICE),
        F.when(unsized, fv.BADGE_NO_OCR_SIZE),
        F.when(F.col("confidence") < fv.LOW_OCR_CONFIDENCE, fv.BADGE_CHECK_OCR),
        F.when(F.col("decision") == "ai_review", fv.BADGE_AI_REVIEW),
        F.when(F.col("status") == "unmatched", fv.BADGE_NOT_SOLD)))


def filter_task(flags: DataFrame, task: str, department: str | None = None) -> DataFrame:
    """one task list, optionally of one department ('none' = items without one)."""
    if task not in TASKS:
        raise ValueError(f"unknown review task: {task}")
    rows = flags if task == "all" else flags.where(f"is_{task}")
    if department == "none":
        return rows.where(F.col("department").isNull())
    return rows.where(F.col("department") == department) if department else rows


def task_rows(flags: DataFrame, tasks: list[str]) -> DataFrame:
    """each item once per task list it belongs to, as ``task``, in one pass."""
    lists = F.array_compact(F.array(*[F.when(F.lit(True) if t == "all" else F.col(f"is_{t}"), t) for t in tasks]))
    return flags.withColumn("task", F.explode(lists))


def review_counters(flags: DataFrame) -> DataFrame:
    """How many items each task list holds."""
    return flags.agg(
        F.count("*").alias("all_items"),
        *[F.count_if(F.col(f"is_{t}")).alias(t) for t in TASKS if t != "all"])


def review_queue(flags: DataFrame, n: int | None = None) -> DataFrame:
    """Newest first; a screen shows the first ``n``."""
    ordered = flags.orderBy(F.col("created_at").desc(), "item_id")
    return ordered if n is None else ordered.limit(n)
