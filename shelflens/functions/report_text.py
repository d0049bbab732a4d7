"""Report columns: attention flag, comment ladder, labels and number formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelflens.functions import fixed_values as fv
from shelflens.functions.money import round_half_up


def large_diff(ratio: Column) -> Column:
    return F.coalesce(F.abs(ratio) >= fv.LARGE_DIFF, F.lit(False))


def needs_attention(status: Column, has_product: Column, ratio: Column, own: Column | None = None) -> Column:
    """Pass ``own`` for the detailed report, which also flags a product without own price."""
    flag = status.isin("unmatched", "needs_review") | ~has_product | large_diff(ratio)
    return flag | (has_product & own.isNull()) if own is not None else flag


def comment(status: Column, has_product: Column, ratio: Column, reason: Column, own: Column | None = None) -> Column:
    """The first rung that applies; ``own`` adds the detailed report's rung."""
    reason = F.when(reason != "", reason)
    ladder = (F.when(status == "unmatched", F.lit(fv.COMMENT_NOT_FOUND))
              .when(~has_product, F.coalesce(reason, F.lit(fv.COMMENT_NO_PRODUCT))))
    if own is not None:
        ladder = ladder.when(own.isNull(), F.lit(fv.COMMENT_NO_OWN_PRICE))
    return (ladder.when(status == "needs_review", F.coalesce(reason, F.lit(fv.COMMENT_REVIEW)))
            .when(ratio <= -fv.LARGE_DIFF, F.lit(fv.COMMENT_CHEAPER))
            .when(ratio >= fv.LARGE_DIFF, F.lit(fv.COMMENT_DEARER)).otherwise(F.lit("")))


def money_value(minor: Column) -> Column:
    return minor / F.lit(100.0)


def percent_tenths(ratio: Column) -> Column:
    """Tenths of a percent, as whole number."""
    return round_half_up(ratio * 1000)


def percent_text(ratio: Column) -> Column:
    """One decimal at most, '12.5%' or '12%'; '' when missing."""
    tenths = percent_tenths(ratio)
    digits = F.abs(tenths)
    whole = F.concat(F.when(tenths < 0, "-").otherwise(""), F.floor(digits / 10).cast("bigint").cast("string"))
    fraction = F.when(digits % 10 != 0, F.concat(F.lit("."), (digits % 10).cast("string"))).otherwise("")
    return F.coalesce(F.concat(whole, fraction, F.lit("%")), F.lit(""))


def department_label(department: Column) -> Column:
    out = None
    for key, label in fv.DEPARTMENT_LABELS.items():
        out = F.when(department == key, label) if out is None else out.when(department == key, label)
    return out.otherwise(fv.NO_DEPARTMENT_LABEL)


def run_duration_text(started: Column, completed: Column) -> Column:
    """Rounded seconds; above a minute, rounded minutes and the second remainder."""
    seconds = round_half_up((F.unix_micros(completed.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))) / 1e6)
    minutes = round_half_up(seconds / 60)
    text = (F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit(" сек")))
            .otherwise(F.concat(minutes.cast("string"), F.lit(" мин "), (seconds % 60).cast("string"), F.lit(" сек"))))
    return F.coalesce(text, F.lit("—"))
