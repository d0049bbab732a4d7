"""Streaming jobs over the driver tables, run to the end of the data and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from shelflens.functions.money import round_half_up
from shelflens.plans.domain import Domain, with_tables
from shelflens.plans.registry import query
from shelflens.session import job_folder
from shelflens.streaming import jobs, state


class StreamedTables:
    """Driver tables as file streams, under the names the domain projections read."""

    def __init__(self, t) -> None:
        self._t = t

    def __getattr__(self, name: str) -> DataFrame:
        schema = getattr(self._t, name).schema
        return jobs.read_observations(self._t.spark, self._t.folder, schema, pattern=f"{name}.parquet")


def _stream(t) -> Domain:
    return Domain(StreamedTables(t))


def _run_folder(t, name: str) -> str:
    return f"{job_folder(t.spark)}/{uuid.uuid4().hex}/{name}"


def _finished(t, stream: DataFrame, name: str) -> DataFrame:
    folder = _run_folder(t, name)
    jobs.append_parquet(stream, f"{folder}/data", f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/data")


@query("x1_ingest", f"""{with_tables('obs')} SELECT product_id, store_id, obs_id, sha256(product_id || '-' || price_minor || '-' || 'товар ' || product_id) AS payload_hash, 'товар ' || product_id AS title,
  CAST(product_id + 4600000000000 AS VARCHAR) AS barcode FROM obs""")
def x1_ingest(t):
    c = F.col
    rows = _stream(t).observations.select(
        "product_id", "store_id", "obs_id", "price_minor", c("product_id").cast("string").alias("source_product_id"),
        F.concat(F.lit(" Товар, "), c("product_id").cast("string")).alias("title"),
        F.concat(F.lit("ean "), (c("product_id") + 4600000000000).cast("string")).alias("barcode"), F.lit("1 kg").alias("size_text"))
    return _finished(t, jobs.normalize_observations(rows), "ingest").select(
        "product_id", "store_id", "obs_id", "payload_hash", "title", "barcode")


@query("x2_dedup", f"{with_tables('obs')} SELECT product_id, store_id, strftime(observed_at, '%Y-%m-%d %H:%M:%S') AS at, count(*) AS rows FROM (SELECT DISTINCT product_id, store_id, observed_at FROM obs) GROUP BY ALL")
def x2_dedup(t):
    rows = _stream(t).observations.select("product_id", "store_id", "observed_at")
    deduped = jobs.dedup_observations(rows, ["product_id", "store_id", "observed_at"])
    kept = _finished(t, deduped, "dedup")
    return kept.groupBy("product_id", "store_id", F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss").alias("at")).agg(F.count("*").alias("rows"))


@query("x3_price_state", f"""{with_tables('obs')}, daily AS (SELECT product_id, source_id AS store_id, observed_at, obs_id * 2000 + store_id AS o, price_minor, availability FROM obs)
SELECT product_id, store_id, o AS obs_no, lag(price_minor) OVER w AS previous_price_minor, floor(abs(CAST(price_minor - lag(price_minor) OVER w AS DOUBLE) / lag(price_minor) OVER w) * 100 * 100 + 0.5) / 100 AS change_pct,
  row_number() OVER w > 1 AND availability = 'out_of_stock' AND lag(availability) OVER w <> 'out_of_stock' AS went_out_of_stock FROM daily
  WINDOW w AS (PARTITION BY product_id, store_id ORDER BY observed_at, lpad(CAST(o AS VARCHAR), 20, '0'))""")
def x3_price_state(t):
    c = F.col
    rows = _stream(t).observations.select(
        "product_id", c("source_id").alias("store_id"), "observed_at", "price_minor", "availability",
        F.lpad((c("obs_id") * 2000 + c("store_id")).cast("string"), 20, "0").alias("obs_id"))
    folder = _run_folder(t, "price_state")
    state.price_state(rows, folder, f"{folder}/checkpoint", buckets=8).awaitTermination()
    out = state.read_changes(t.spark, folder)
    return out.select("product_id", "store_id", c("obs_id").cast("bigint").alias("obs_no"), "previous_price_minor",
                      (round_half_up(c("change_pct") * 100) / 100).alias("change_pct"),
                      F.coalesce("went_out_of_stock", F.lit(False)).alias("went_out_of_stock"))


@query("x4_failure_state", f"""{with_tables('runs')}, isl AS (SELECT *, count(*) FILTER (WHERE status <> 'failed') OVER (PARTITION BY source_id ORDER BY started_at, run_id) AS island FROM runs),
len AS (SELECT *, count(*) FILTER (WHERE status = 'failed') OVER (PARTITION BY source_id, island ORDER BY started_at, run_id) AS streak FROM isl)
SELECT source_id, run_id, streak, streak = 2 AND status = 'failed' AS alert FROM len""")
def x4_failure_state(t):
    folder = _run_folder(t, "streaks")
    state.failure_state(_stream(t).runs, folder, f"{folder}/checkpoint", buckets=8, threshold=2).awaitTermination()
    return state.read_changes(t.spark, folder).select("source_id", "run_id", "streak", "alert")


@query("x5_stale_state", f"""{with_tables('runs')}, ends AS (SELECT max(started_at) - INTERVAL 1 MINUTE AS mark FROM runs),
r AS (SELECT run_id, started_at, age FROM (SELECT run_id, started_at, date_diff('microsecond', started_at, mark) / 60e6 AS age FROM runs, ends WHERE status = 'running'))
SELECT run_id, 'requeue' AS action FROM r WHERE age >= 2880 UNION ALL SELECT run_id, 'fail' FROM r WHERE age >= 5760""")
def x5_stale_state(t):
    folder = _run_folder(t, "stale")
    rows = _stream(t).runs.select("run_id", "status", F.col("started_at").alias("event_at"))
    state.stale_state(rows, folder, f"{folder}/checkpoint", buckets=8, timeout_minutes=2880).awaitTermination()
    return state.read_changes(t.spark, folder).select("run_id", "action")


@query("x6_price_rollup", f"""{with_tables('obs')} SELECT product_id, store_id, strftime(date_trunc('day', observed_at), '%Y-%m-%d') AS day, count(*) AS observations, min(price_minor) AS min_price_minor, max(price_minor) AS max_price_minor
  FROM obs WHERE date_trunc('day', observed_at) + INTERVAL 1 DAY <= (SELECT max(observed_at) - INTERVAL 1 DAY FROM obs) GROUP BY product_id, store_id, date_trunc('day', observed_at)""")
def x6_price_rollup(t):
    out = _finished(t, jobs.price_rollup_stream(_stream(t).observations), "rollup")
    return out.select("product_id", "store_id", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "observations",
                      "min_price_minor", "max_price_minor")


@query("x6_run_rollup", f"""{with_tables('runs')} SELECT source_id, strftime(date_trunc('hour', started_at), '%Y-%m-%d %H') AS hour, count(*) AS runs, count(*) FILTER (WHERE status = 'failed') AS failed FROM runs
  WHERE date_trunc('hour', started_at) + INTERVAL 1 HOUR <= (SELECT max(started_at) - INTERVAL 1 HOUR FROM runs) GROUP BY 1, 2""")
def x6_run_rollup(t):
    out = _finished(t, jobs.run_rollup_stream(_stream(t).runs), "runs")
    return out.select("source_id", F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "runs", "failed")


@query("x6_batch_rollups", f"""{with_tables('obs', 'runs')} SELECT 'price' AS kind, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM obs GROUP BY product_id, store_id, date_trunc('month', observed_at))
  UNION ALL SELECT 'run', count(*), CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM runs GROUP BY source_id, date_trunc('hour', started_at))""")
def x6_batch_rollups(t):
    from shelflens.operators.price_history import price_rollup
    from shelflens.operators.runs import run_rollup
    prices = price_rollup(t.domain.observations, "month").agg(F.count("*").alias("groups"), F.sum("observations").alias("rows"))
    runs = run_rollup(t.domain.runs).agg(F.count("*").alias("groups"), F.sum("runs").alias("rows"))
    return prices.select(F.lit("price").alias("kind"), "*").unionByName(runs.select(F.lit("run").alias("kind"), "*"))


@query("x7_enrich", f"""{with_tables('obs', 'cat')} SELECT obs_id, store_id, o.product_id AS seen_product, CASE WHEN c.is_active THEN c.product_id END AS product_id FROM obs o LEFT JOIN cat c ON c.external_sku = CAST(o.product_id + 4600000000000 AS VARCHAR)""")
def x7_enrich(t):
    rows = _stream(t).observations.select(
        "obs_id", "store_id", F.col("product_id").alias("seen_product"), (F.col("product_id") + 4600000000000).cast("string").alias("barcode"))
    return _finished(t, jobs.enrich_stream(rows, t.domain.catalog), "enrich").select("obs_id", "store_id", "seen_product", "product_id")


@query("x8_latest_table", f"""{with_tables('obs')} SELECT product_id, store_id, price_minor FROM obs QUALIFY row_number() OVER (PARTITION BY product_id, store_id ORDER BY observed_at DESC, obs_id DESC) = 1""")
def x8_latest_table(t):
    folder = _run_folder(t, "latest")
    rows = _stream(t).observations.select("product_id", "store_id", "price_minor", "observed_at", "obs_id")
    jobs.maintain_latest(rows, f"{folder}/table", f"{folder}/checkpoint", ["product_id", "store_id"], ["observed_at", "obs_id"],
                         buckets=8).awaitTermination()
    return jobs.read_latest(t.spark, f"{folder}/table").select("product_id", "store_id", "price_minor")


@query("s12_run_sink", f"""{with_tables('obs')} SELECT week AS run_id, count(*) AS rows, CAST(sum(price_minor) AS BIGINT) AS total FROM obs GROUP BY week""")
def s12_run_sink(t):
    from shelflens.sources.sinks import write_run
    path = _run_folder(t, "runs")
    rows = t.domain.observations.select(F.col("week").alias("run_id"), "product_id", "store_id", "price_minor")
    write_run(rows, path)
    write_run(rows.where("run_id = 2"), path)
    return t.spark.read.parquet(path).groupBy(F.col("run_id").cast("bigint").alias("run_id")).agg(
        F.count("*").alias("rows"), F.sum("price_minor").alias("total"))
