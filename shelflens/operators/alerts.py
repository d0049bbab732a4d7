"""Alert rules over price changes, availability, own-price gaps and run failures.

A rule applies to one source or, without ``source_id``, to all of them. The thresholds of a scope are sorted once and packed into
blocks; a row meets blocks whose least threshold it reaches and finds the rules it reaches in one by binary search. Blocks come in
copies, one per task, and rows are dealt to them by hash, so neither a source with most rows nor the rules for
all sources are one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ALERT_COLUMNS = ["alert_type", "rule_id", "source_id", "run_id", "product_id", "store_id", "severity", "value",
                 "threshold", "previous_price_minor", "current_price_minor"]
BLOCK_RULES = 1000


def active_rules(rules: DataFrame, alert_type: str) -> DataFrame:
    return rules.where((F.col("alert_type") == alert_type) & F.col("enabled"))


def _blocks(rules: DataFrame, copies: int) -> DataFrame:
    """(_source, _copy, _least, _rules): up to about ``BLOCK_RULES`` rules of one scope by rising threshold; a null source means all."""
    parts = -(-rules.count() // BLOCK_RULES) or 1
    sorted_rules = rules.select(F.col("source_id").alias("_source"), F.struct(F.col("threshold").cast("double").alias("threshold"), "rule_id").alias("_rule"))
    packed = (sorted_rules.repartitionByRange(parts, "_source", "_rule").groupBy("_source", F.spark_partition_id().alias("_part"))
              .agg(F.sort_array(F.collect_list("_rule")).alias("_rules")))
    return packed.select("_source", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_copy"),
                         F.get("_rules", F.lit(0))["threshold"].alias("_least"), "_rules")


def _reached(rules: Column, value: Column) -> Column:
    """How many of the rules, sorted by threshold, have a threshold of ``value`` or less: binary search."""
    span = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")

    def halved(s: Column, _: Column) -> Column:
        fits = F.get(rules, middle(s))["threshold"] <= value
        return F.when(s["lo"] >= s["hi"], s).when(fits, span(middle(s) + 1, s["hi"])).otherwise(span(s["lo"], middle(s)))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(rules) + 1)).cast("int"))
    return F.aggregate(steps, span(F.lit(0), F.size(rules)), halved, lambda s: s["lo"])


def with_rules(rows: DataFrame, rules: DataFrame, value: str) -> DataFrame:
    """One row per (row, rule in scope whose threshold ``value`` reaches) with ``rule_id`` and ``threshold``."""
    copies = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = _blocks(rules.where(F.col("threshold").isNotNull()), copies)
    v = F.col(value).cast("double")
    dealt = rows.where(v.isNotNull()).withColumn("_seat", F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith("map")]), F.lit(copies)).cast("int"))
    reach = (F.col("_seat") == F.col("_copy")) & (v >= F.col("_least"))
    own = dealt.join(blocks.where("_source is not null"), (F.col("source_id") == F.col("_source")) & reach)
    every = dealt.join(blocks.where("_source is null"), reach)
    hits = own.unionByName(every).withColumn("_hit", F.explode(F.slice("_rules", F.lit(1), _reached(F.col("_rules"), v))))
    return hits.select(*rows.columns, "_hit.rule_id", "_hit.threshold")


def _severity(value: Column, threshold: Column) -> Column:
    return F.when(value >= threshold * 2, "critical").otherwise("warning")


def _alerts(rows: DataFrame, alert_type: str, severity: Column, value: Column) -> DataFrame:
    present = {c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
               for c in ("rule_id", "source_id", "run_id", "product_id", "store_id")}
    prices = {new: (F.col(c) if c in rows.columns else F.lit(None)).cast("bigint").alias(new)
              for new, c in (("previous_price_minor", "previous_price_minor"), ("current_price_minor", "price_minor"))}
    return rows.select(F.lit(alert_type).alias("alert_type"),
                       *[c.cast("string").alias(n) for n, c in present.items()],
                       severity.alias("severity"), value.cast("double").alias("value"),
                       F.col("threshold").cast("double").alias("threshold"), *prices.values()).select(*ALERT_COLUMNS)


def price_change_alerts(changes: DataFrame, rules: DataFrame) -> DataFrame:
    """One alert per observation and rule whose threshold the change reaches."""
    moved = changes.where(F.col("change_pct").isNotNull())
    hits = with_rules(moved, active_rules(rules, "price_change"), "change_pct")
    return _alerts(hits, "price_change", _severity(F.col("change_pct"), F.col("threshold")), F.col("change_pct"))


def out_of_stock_alerts(transitions: DataFrame, rules: DataFrame) -> DataFrame:
    """One alert per transition, under the first rule in scope by id; equal rows are alerts of their own."""
    active = active_rules(rules, "out_of_stock")
    first = active.groupBy("source_id").agg(F.min(F.struct("rule_id", F.col("threshold").cast("double").alias("threshold"))).alias("_own"))
    common = first.where("source_id is null").select("_own.rule_id", "_own.threshold").first()  # one row
    every = F.struct(F.lit(common.rule_id).alias("rule_id"), F.lit(common.threshold).cast("double").alias("threshold")) if common else F.lit(None)
    joined = transitions.join(first.where("source_id is not null"), "source_id", "left").withColumn("_rule", F.least("_own", every.cast(first.schema["_own"].dataType)))
    hits = joined.where("_rule is not null").select(*transitions.columns, "_rule.rule_id", "_rule.threshold")
    return _alerts(hits, "out_of_stock", F.lit("info"), F.lit(None).cast("double"))


def run_failure_alerts(streaks: DataFrame, rules: DataFrame, open_alerts: DataFrame | None = None) -> DataFrame:
    """Sources whose newest run failed and whose streak reaches a rule; none while an alert is still open."""
    failing = streaks.where(F.col("last_status") == "failed").withColumnRenamed("last_run_id", "run_id")
    if open_alerts is not None:
        still_open = open_alerts.where((F.col("alert_type") == "run_failure") & (F.col("status") == "new"))
        failing = failing.join(still_open.select("source_id"), "source_id", "left_anti")
    hits = with_rules(failing, active_rules(rules, "run_failure"), "streak")
    return _alerts(hits, "run_failure", _severity(F.col("streak"), F.col("threshold")), F.col("streak"))


def competitor_cheaper_alerts(compared: DataFrame, rules: DataFrame) -> DataFrame:
    """Competitor below the own price by at least the threshold percent."""
    gap = (F.col("own_price_minor") - F.col("price_minor")).cast("double") / F.col("own_price_minor") * 100
    rows = compared.where(F.col("own_price_minor") > 0).withColumn("gap_pct", gap)
    hits = with_rules(rows, active_rules(rules, "competitor_cheaper"), "gap_pct")
    return _alerts(hits, "competitor_cheaper", _severity(F.col("gap_pct"), F.col("threshold")), F.col("gap_pct"))


def all_alerts(*kinds: DataFrame) -> DataFrame:
    """The alert kinds as one table."""
    out = kinds[0]
    for other in kinds[1:]:
        out = out.unionByName(other)
    return out


def apply_alert_actions(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Newest action per alert decides the status; each status keeps the time it was reached."""
    taken = actions.groupBy("alert_id").agg(
        F.max_by("action", F.struct("acted_at", "action")).alias("_status"),
        F.max(F.when(F.col("action") == "ack", F.col("acted_at"))).alias("acknowledged_at"),
        F.max(F.when(F.col("action") == "resolved", F.col("acted_at"))).alias("resolved_at"))
    joined = alerts.join(taken, "alert_id", "left")
    return joined.withColumn("status", F.coalesce("_status", "status")).drop("_status")


def alert_counts(alerts: DataFrame) -> DataFrame:
    """Alerts per status."""
    return alerts.groupBy("status").agg(F.count("*").alias("alerts"))


def acknowledge_all(alerts: DataFrame, at: Column) -> DataFrame:
    """Every new alert becomes acknowledged; count the changed rows with ``acknowledged_at = at``."""
    new = F.col("status") == "new"
    return alerts.withColumn("acknowledged_at", F.when(new, at)).withColumn(
        "status", F.when(new, "ack").otherwise(F.col("status")))
