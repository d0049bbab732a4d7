"""Latest prices, source precedence, changes, runs and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelflens.functions import report_text as rt
from shelflens.functions.money import round_half_up
from shelflens.operators import alerts, price_history as ph, runs as rn
from shelflens.plans.domain import with_tables
from shelflens.plans.registry import query

DAY = "yyyy-MM-dd"

LATEST = """latest AS (SELECT product_id, store_id, price_minor, observed_at, source, obs_id FROM (SELECT *, row_number() OVER (
  PARTITION BY product_id, store_id ORDER BY observed_at DESC, obs_id DESC) AS n FROM obs) WHERE n = 1)"""
CHANGES = """changes AS (SELECT *, CASE WHEN prev <> 0 THEN abs(CAST(price_minor - prev AS DOUBLE) / prev) * 100 END AS change_pct
  FROM (SELECT *, lag(price_minor) OVER w AS prev, lag(availability) OVER w AS prev_stock, row_number() OVER w AS nth FROM obs
  WINDOW w AS (PARTITION BY product_id, store_id ORDER BY observed_at, obs_id)))"""


def _four(column):
    return round_half_up(column * 10000) / 10000


@query("w1_latest_price", f"""{with_tables('obs')}, {LATEST}
SELECT product_id, store_id, price_minor, strftime(observed_at, '%Y-%m-%d') AS observed_on, source FROM latest""")
def w1_latest_price(t):
    return ph.latest_prices(t.domain.observations).select(
        "product_id", "store_id", "price_minor", F.date_format("observed_at", DAY).alias("observed_on"), "source")


@query("w1_latest_photo_week", f"""{with_tables('obs')}
SELECT product_id, store_id, price_minor, strftime(observed_at, '%Y-%m-%d') AS captured_on FROM (SELECT *, row_number() OVER (
  PARTITION BY product_id, store_id ORDER BY observed_at DESC, obs_id DESC) AS n FROM obs WHERE week = 1 AND source = 'photo') WHERE n = 1""")
def w1_latest_photo_week(t):
    shelf = t.domain.observations.where("source = 'photo'").withColumn("captured_date", F.to_date("observed_at")).withColumn(
        "created_at", F.col("observed_at"))
    return ph.latest_photo_prices(shelf, 1).select(
        "product_id", "store_id", "price_minor", F.date_format("observed_at", DAY).alias("captured_on"))


OWN = f"""{with_tables('obs', 'cat')}, {LATEST}, own AS (SELECT l.product_id, store_id, price_minor, own_price_minor,
  price_minor - own_price_minor AS diff_minor,
  CASE WHEN own_price_minor > 0 THEN CAST(price_minor - own_price_minor AS DOUBLE) / own_price_minor END AS diff_ratio
  FROM latest l JOIN cat USING (product_id))"""


@query("j16_price_vs_own", f"{OWN} SELECT product_id, store_id, price_minor, own_price_minor, diff_minor, "
                           "floor(diff_ratio * 10000 + 0.5) / 10000 AS diff_ratio FROM own")
def j16_price_vs_own(t):
    rows = ph.compare_with_own(ph.latest_prices(t.domain.observations), t.domain.catalog)
    return rows.select("product_id", "store_id", "price_minor", "own_price_minor", "diff_minor",
                       _four(F.col("diff_ratio")).alias("diff_ratio"))


@query("n17_competitor_cheaper", f"{OWN} SELECT product_id, store_id, price_minor, own_price_minor, diff_minor FROM own "
                                 "WHERE diff_ratio <= -0.05::DOUBLE")
def n17_competitor_cheaper(t):
    rows = ph.compare_with_own(ph.latest_prices(t.domain.observations), t.domain.catalog)
    return rows.where(F.col("diff_ratio") <= -0.05).select(
        "product_id", "store_id", "price_minor", "own_price_minor", "diff_minor")


MODE_SQL = {
    "photo_only": ("WHERE source = 'photo'", ""), "online_only": ("WHERE source = 'online'", ""),
    "online_preferred": ("", "(source = 'online') DESC, "), "latest": ("", "(source = 'online') DESC, "), "freshest": ("", ""),
}


def _mode_query(mode: str) -> None:
    where, first = MODE_SQL[mode]

    @query(f"u1_merge_{mode}", f"""{with_tables('obs')} SELECT product_id, store_id, price_minor, source FROM (SELECT *, row_number() OVER (
  PARTITION BY product_id, store_id ORDER BY {first}observed_at DESC, obs_id DESC) AS n FROM obs {where}) WHERE n = 1""")
    def merged(t):
        return ph.merge_sources(t.domain.observations, mode).select("product_id", "store_id", "price_minor", "source")


for _mode in ph.MODES:
    _mode_query(_mode)


@query("w2_price_changes", f"""{with_tables('obs')}, {CHANGES} SELECT product_id, store_id, obs_id, price_minor,
  prev AS previous_price_minor, floor(change_pct * 10000 + 0.5) / 10000 AS change_pct FROM changes""")
def w2_price_changes(t):
    return ph.price_changes(t.domain.observations).select(
        "product_id", "store_id", "obs_id", "price_minor", "previous_price_minor", _four(F.col("change_pct")).alias("change_pct"))


@query("w2_price_changes_by_product", f"""{with_tables('obs')} SELECT product_id, obs_id, store_id, price_minor, lag(price_minor) OVER (
  PARTITION BY product_id ORDER BY observed_at, obs_id, store_id) AS previous_price_minor FROM obs""")
def w2_price_changes_by_product(t):
    return ph.price_changes(t.domain.observations, ["product_id"], ["observed_at", "obs_id", "store_id"]).select(
        "product_id", "obs_id", "store_id", "price_minor", "previous_price_minor")


@query("w10_out_of_stock", f"""{with_tables('obs')}, {CHANGES} SELECT product_id, store_id, obs_id FROM changes
  WHERE availability = 'out_of_stock' AND nth > 1 AND coalesce(prev_stock, '') <> 'out_of_stock'""")
def w10_out_of_stock(t):
    return ph.out_of_stock_transitions(t.domain.observations).select("product_id", "store_id", "obs_id")


STREAKS = """recent AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS n FROM runs),
streaks AS (SELECT source_id, coalesce(min(CASE WHEN status <> 'failed' THEN n END) - 1, max(n)) AS streak,
  max(CASE WHEN n = 1 THEN run_id END) AS last_run_id, max(CASE WHEN n = 1 THEN status END) AS last_status
  FROM recent GROUP BY source_id)"""


@query("w3_failure_streaks", f"{with_tables('runs')}, {STREAKS} SELECT source_id, CAST(streak AS BIGINT) AS streak, last_run_id, last_status FROM streaks")
def w3_failure_streaks(t):
    return rn.failure_streaks(t.domain.runs)


@query("a1_run_stats", f"""{with_tables('obs')} SELECT run_id, count(*) AS fetched, count(*) AS products_upserted,
  CAST(count(*) AS BIGINT) AS prices_inserted, count(*) FILTER (WHERE product_id % 9 <> 0 AND source = 'online') AS matched,
  count(*) FILTER (WHERE source = 'photo') AS unmatched, count(*) FILTER (WHERE availability = 'out_of_stock') AS errors FROM obs GROUP BY run_id""")
def a1_run_stats(t):
    c = F.col
    rows = t.domain.observations.withColumn("source_product_id", c("product_id")).withColumn(
        "product_id", F.when(c("product_id") % 9 != 0, c("product_id"))).withColumn(
        "match_status", F.when(c("source") == "online", "auto").otherwise("needs_review")).withColumn(
        "error", F.when(c("availability") == "out_of_stock", "gone"))
    return rn.run_stats(rows)


NOW = "2024-01-15 12:00:00"


@query("r11_stale_runs", f"""{with_tables('runs')} SELECT run_id, CASE WHEN age >= 20160 THEN 'fail' WHEN age >= 10080 THEN 'requeue' ELSE 'ok' END AS action
  FROM (SELECT run_id, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(started_at)) / 60e6 AS age FROM runs WHERE status = 'running')""")
def r11_stale_runs(t):
    return rn.stale_runs(t.domain.runs, F.lit(NOW), 10080).select("run_id", "action")


@query("r11_stuck_rows", f"""{with_tables('runs')} SELECT run_id, CASE WHEN status = 'running' AND
  (epoch_us(TIMESTAMP '{NOW}') - epoch_us(started_at)) / 60e6 > 20 THEN 'failed' ELSE status END AS status FROM runs""")
def r11_stuck_rows(t):
    rows = t.domain.runs.withColumn("updated_at", F.col("started_at"))
    return rn.fail_stuck(rows, F.lit(NOW), busy="running").select("run_id", "status")


@query("n20_run_duration", f"""{with_tables('runs')} SELECT run_id, CASE WHEN s < 60 THEN CAST(s AS VARCHAR) || ' сек'
  ELSE CAST(CAST(floor(s / 60.0::DOUBLE + 0.5) AS BIGINT) AS VARCHAR) || ' мин ' || CAST(s % 60 AS VARCHAR) || ' сек' END AS duration
  FROM (SELECT run_id, CAST(floor(floor(seconds * 1e6) / 1e6 + 0.5) AS BIGINT) AS s FROM runs)""")
def n20_run_duration(t):
    start = F.col("started_at")
    end = F.timestamp_micros(F.unix_micros(start) + F.floor(F.col("seconds") * 1e6).cast("bigint"))
    return t.domain.runs.select("run_id", rt.run_duration_text(start, end).alias("duration"))


ALERT_VIEW = "alert_type, rule_id, source_id, run_id, product_id, store_id, severity, value, threshold"
SCOPED = "(r.source_id IS NULL OR r.source_id = x.source_id) AND r.enabled"


def _shown(df):
    return df.withColumn("value", _four(F.col("value")))


R6 = f"""SELECT 'price_change' AS alert_type, rule_id, CAST(x.source_id AS VARCHAR) AS source_id, CAST(run_id AS VARCHAR) AS run_id,
  CAST(product_id AS VARCHAR) AS product_id, CAST(store_id AS VARCHAR) AS store_id,
  CASE WHEN change_pct >= threshold * 2 THEN 'critical' ELSE 'warning' END AS severity,
  floor(change_pct * 10000 + 0.5) / 10000 AS value, threshold, prev AS previous_price_minor, price_minor AS current_price_minor FROM changes x JOIN rules r ON {SCOPED}
  AND r.alert_type = 'price_change' AND change_pct >= threshold"""
R7 = f"""SELECT 'out_of_stock' AS alert_type, rule_id, CAST(source_id AS VARCHAR) AS source_id, CAST(run_id AS VARCHAR) AS run_id,
  CAST(product_id AS VARCHAR) AS product_id, CAST(store_id AS VARCHAR) AS store_id, 'info' AS severity, CAST(NULL AS DOUBLE) AS value, threshold, CAST(NULL AS BIGINT) AS previous_price_minor, price_minor AS current_price_minor
  FROM (SELECT x.*, r.rule_id, r.threshold, row_number() OVER (PARTITION BY x.product_id, x.store_id, x.obs_id ORDER BY r.rule_id) AS k
  FROM changes x JOIN rules r ON {SCOPED} AND r.alert_type = 'out_of_stock' WHERE availability = 'out_of_stock' AND nth > 1
  AND coalesce(prev_stock, '') <> 'out_of_stock') WHERE k = 1"""
R8 = f"""SELECT 'run_failure' AS alert_type, rule_id, CAST(x.source_id AS VARCHAR) AS source_id, CAST(last_run_id AS VARCHAR) AS run_id,
  CAST(NULL AS VARCHAR) AS product_id, CAST(NULL AS VARCHAR) AS store_id,
  CASE WHEN streak >= threshold * 2 THEN 'critical' ELSE 'warning' END AS severity, CAST(streak AS DOUBLE) AS value, threshold, CAST(NULL AS BIGINT) AS previous_price_minor, CAST(NULL AS BIGINT) AS current_price_minor
  FROM streaks x JOIN rules r ON {SCOPED} AND r.alert_type = 'run_failure' AND streak >= threshold
  WHERE last_status = 'failed' AND x.source_id % 5 <> 0"""
R9 = f"""SELECT 'competitor_cheaper' AS alert_type, rule_id, CAST(x.source_id AS VARCHAR) AS source_id, CAST(NULL AS VARCHAR) AS run_id,
  CAST(product_id AS VARCHAR) AS product_id, CAST(store_id AS VARCHAR) AS store_id,
  CASE WHEN gap >= threshold * 2 THEN 'critical' ELSE 'warning' END AS severity, floor(gap * 10000 + 0.5) / 10000 AS value, threshold, CAST(NULL AS BIGINT) AS previous_price_minor, price_minor AS current_price_minor
  FROM (SELECT *, store_id % 8 AS source_id, CAST(own_price_minor - price_minor AS DOUBLE) / own_price_minor * 100 AS gap FROM own WHERE own_price_minor > 0) x
  JOIN rules r ON {SCOPED} AND r.alert_type = 'competitor_cheaper' AND gap >= threshold"""


def _price_change(t):
    return alerts.price_change_alerts(ph.price_changes(t.domain.observations), t.domain.rules)


def _out_of_stock(t):
    return alerts.out_of_stock_alerts(ph.out_of_stock_transitions(t.domain.observations), t.domain.rules)


def _run_failure(t):
    streaks = rn.failure_streaks(t.domain.runs)
    open_alerts = t.domain.runs.where(F.col("source_id") % 5 == 0).select(
        "source_id", F.lit("run_failure").alias("alert_type"), F.lit("new").alias("status"))
    return alerts.run_failure_alerts(streaks, t.domain.rules, open_alerts)


def _cheaper(t):
    compared = ph.compare_with_own(ph.latest_prices(t.domain.observations), t.domain.catalog)
    return alerts.competitor_cheaper_alerts(compared.withColumn("source_id", F.col("store_id") % 8), t.domain.rules)


@query("r6_price_change_alerts", f"{with_tables('obs', 'rules')}, {CHANGES} {R6}")
def r6_price_change_alerts(t):
    return _shown(_price_change(t))


@query("r7_out_of_stock_alerts", f"{with_tables('obs', 'rules')}, {CHANGES} {R7}")
def r7_out_of_stock_alerts(t):
    return _shown(_out_of_stock(t))


@query("r8_run_failure_alerts", f"{with_tables('runs', 'rules')}, {STREAKS} {R8}")
def r8_run_failure_alerts(t):
    return _shown(_run_failure(t))


@query("r9_competitor_cheaper_alerts", f"{OWN.replace('WITH ', with_tables('rules') + ', ', 1)} {R9}")
def r9_competitor_cheaper_alerts(t):
    return _shown(_cheaper(t))


@query("u3_alerts_by_kind", f"""{OWN.replace('WITH ', with_tables('rules', 'runs') + ', ', 1)}, {CHANGES}, {STREAKS}
SELECT alert_type, severity, count(*) AS alerts FROM (({R6}) UNION ALL ({R7}) UNION ALL ({R8}) UNION ALL ({R9})) GROUP BY alert_type, severity""")
def u3_alerts_by_kind(t):
    rows = alerts.all_alerts(_price_change(t), _out_of_stock(t), _run_failure(t), _cheaper(t))
    return rows.groupBy("alert_type", "severity").agg(F.count("*").alias("alerts"))


ALERT_TABLE = """alerts AS (SELECT event_id AS alert_id, 'new' AS status FROM events WHERE event_type = 'error'),
actions AS (SELECT o_orderkey % 500 AS alert_id, CASE WHEN o_orderstatus = 'F' THEN 'resolved' ELSE 'ack' END AS action, o_orderdate AS acted_at FROM orders)"""


def _alert_table(t):
    return t.events.where("event_type = 'error'").select(F.col("event_id").alias("alert_id"), F.lit("new").alias("status"))


@query("r10_alert_lifecycle", f"""WITH {ALERT_TABLE}, taken AS (SELECT alert_id, arg_max(action, {{'a': acted_at, 'b': action}}) AS st,
  max(CASE WHEN action = 'ack' THEN acted_at END) AS a, max(CASE WHEN action = 'resolved' THEN acted_at END) AS r FROM actions GROUP BY alert_id)
SELECT alert_id, coalesce(st, status) AS status, strftime(a, '%Y-%m-%d') AS acknowledged_on, strftime(r, '%Y-%m-%d') AS resolved_on
FROM alerts LEFT JOIN taken USING (alert_id)""")
def r10_alert_lifecycle(t):
    actions = t.orders.select((F.col("o_orderkey") % 500).alias("alert_id"), F.when(
        F.col("o_orderstatus") == "F", "resolved").otherwise("ack").alias("action"), F.col("o_orderdate").alias("acted_at"))
    return alerts.apply_alert_actions(_alert_table(t), actions).select(
        "alert_id", "status", F.date_format("acknowledged_at", DAY).alias("acknowledged_on"),
        F.date_format("resolved_at", DAY).alias("resolved_on"))


@query("a17_alert_counts", """SELECT CASE WHEN event_type = 'error' THEN 'ack' WHEN event_type = 'click' THEN 'resolved' ELSE 'ack' END AS status,
  count(*) AS alerts, count(*) FILTER (WHERE event_type = 'error') AS newly_acknowledged FROM events GROUP BY 1""")
def a17_alert_counts(t):
    table = t.events.select(F.col("event_id").alias("alert_id"), F.when(F.col("event_type") == "error", "new").when(
        F.col("event_type") == "click", "resolved").otherwise("ack").alias("status"))
    done = alerts.acknowledge_all(table, F.lit(NOW).cast("timestamp"))
    fresh = done.groupBy("status").agg(F.count("acknowledged_at").alias("newly_acknowledged"))
    return alerts.alert_counts(done).join(fresh, "status")


@query("t2_recent_runs", f"""{with_tables('runs')} SELECT run_id, source_id, status FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 100""")
def t2_recent_runs(t):
    from shelflens.operators.sessions import recent
    return recent(t.domain.runs, "started_at", 100, "run_id").select("run_id", "source_id", "status")


@query("a15_ai_usage", """SELECT model, operation, count(*) AS calls, count(*) FILTER (WHERE is_error) AS errors, count(*) FILTER (WHERE fb) AS fallbacks,
  CAST(floor(CAST(sum(duration_ms) AS DOUBLE) / count(*) + 0.5) AS BIGINT) AS avg_duration_ms, CAST(sum(cost) AS BIGINT) AS cost_microusd FROM (
  SELECT *, CASE model WHEN 'gpt-5.4-nano' THEN greatest(0, CAST(floor((i / 1e6 * 0.2::DOUBLE + o / 1e6 * 1.25::DOUBLE) * 1e6 + 0.5) AS BIGINT))
    WHEN 'gpt-5.4-mini' THEN greatest(0, CAST(floor((i / 1e6 * 0.75::DOUBLE + o / 1e6 * 4.5::DOUBLE) * 1e6 + 0.5) AS BIGINT)) ELSE 0 END AS cost FROM (
  SELECT CASE event_type WHEN 'purchase' THEN 'gpt-5.4-nano' WHEN 'view' THEN 'gpt-5.4-mini' ELSE 'other' END AS model,
    CASE WHEN user_id % 2 = 0 THEN 'image' ELSE 'text' END AS operation, CAST(floor(value * 100) AS BIGINT) AS i, user_id AS o,
    CAST(floor(value * 10) AS BIGINT) AS duration_ms, event_type = 'error' AS is_error, event_id % 7 = 0 AS fb FROM events)) GROUP BY model, operation""")
def a15_ai_usage(t):
    from shelflens.operators.quality import ai_usage
    c = F.col
    jobs = t.events.select(
        F.when(c("event_type") == "purchase", "gpt-5.4-nano").when(c("event_type") == "view", "gpt-5.4-mini").otherwise("other").alias("model"),
        F.when(c("user_id") % 2 == 0, "image").otherwise("text").alias("operation"),
        F.floor(c("value") * 100).alias("input_tokens"), c("user_id").alias("output_tokens"),
        F.floor(c("value") * 10).alias("duration_ms"), (c("event_type") == "error").alias("is_error"),
        (c("event_id") % 7 == 0).alias("used_fallback"))
    return ai_usage(jobs)
