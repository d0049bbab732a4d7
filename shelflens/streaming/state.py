"""State over streams: price and stock changes (X3), failure streaks (X4), stale runs.

X3 and X4 keep the newest row of every key in a versioned table, X5 the open runs. A batch is united with the rows of the keys it may touch and goes
through the batch operators, which cut a busy key into even ranges; so a key may hold most of a batch. Rows not newer than
the state are dropped, which is the only difference from the batch operators when data comes late. A batch that is run again reads
the versions before it and writes its own once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from shelflens.operators.price_history import PAIR, join_same, newest_per_key, price_changes, stock_transitions
from shelflens.operators.runs import streaks_per_run
from shelflens.session import materialize
from shelflens.streaming.tables import BucketTable, _numbers

STALE = "run_id long, started_at timestamp, action string"


def _newer(rows: DataFrame, state: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows that come after the state of their key."""
    last = state.select(*keys, F.struct(*[F.col(c).alias(c) for c in order]).alias("_last"))
    return join_same(rows, last, keys).where(F.col("_last").isNull() | (F.struct(*order) > F.col("_last"))).drop("_last")


def _started(stream: DataFrame, merge, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def price_state(stream: DataFrame, base: str, checkpoint: str, buckets: int) -> StreamingQuery:
    """Changes of price and stock per batch under ``base``; batch twins are ``price_changes`` and ``out_of_stock_transitions``.

    The state of a (product, store) is its newest row, with the last price known.
    """
    order = ["observed_at", "obs_id"]
    table = BucketTable(f"{base}/state", PAIR, buckets)

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = materialize(table.bucketed(batch.select(*PAIR, *order, "price_minor", "availability")), "batch")
        touched = table.touched(rows)
        state = table.before(batch.sparkSession, batch_id, touched, rows.schema)
        fresh = _newer(rows, state, ["bucket", *PAIR], order)
        united = fresh.withColumn("fresh", F.lit(True)).unionByName(state.withColumn("fresh", F.lit(False)))
        if not state.isEmpty():  # without a state the batch is all there is, and it is written already
            united = materialize(united, "united")
        seen = stock_transitions(united, PAIR, order).drop("previous_availability", "has_previous")
        priced = price_changes(seen, PAIR, order).drop("has_previous")
        bare = seen.where("price_minor is null").withColumn("previous_price_minor", F.lit(None).cast("long")).withColumn(
            "change_pct", F.lit(None).cast("double"))
        columns = [*PAIR, *order, "price_minor", "previous_price_minor", "change_pct", "went_out_of_stock"]
        changes = priced.unionByName(bare).where("fresh").select(*columns)
        changes.write.mode("overwrite").parquet(f"{base}/changes/batch={batch_id}")
        place = F.struct(*order)
        last = united.groupBy("bucket", *PAIR).agg(
            F.max_by(F.struct(*order, "availability"), place).alias("last"),
            F.max_by("price_minor", F.when(F.col("price_minor").isNotNull(), place)).alias("price_minor"))
        if touched:
            table.write(batch_id, last.select("bucket", *PAIR, "last.*", "price_minor"), touched, (rows, state))

    return _started(stream, merge, checkpoint)


def failure_state(stream: DataFrame, base: str, checkpoint: str, buckets: int, threshold: int = 3) -> StreamingQuery:
    """Failures in a row per run under ``base``; a run that brings a series to the ``threshold`` raises its one alert.

    The state of a source is its newest run and the streak there, the summary that ``failure_streaks`` gives for all runs.
    """
    order = ["started_at", "run_id"]
    table = BucketTable(f"{base}/state", ["source_id"], buckets)

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = materialize(table.bucketed(batch.select("source_id", *order, "status")), "batch")
        touched = table.touched(rows)
        schema = rows.withColumn("streak", F.lit(0).cast("long")).drop("status").schema
        state = table.before(batch.sparkSession, batch_id, touched, schema)
        fresh = _newer(rows, state, ["bucket", "source_id"], order)
        counted = materialize(streaks_per_run(fresh, state), "counted")
        alert = (F.col("status") == "failed") & (F.col("streak") == threshold)
        counted.select("source_id", "run_id", "started_at", "streak", alert.alias("alert")).write.mode("overwrite").parquet(
            f"{base}/changes/batch={batch_id}")
        newest = newest_per_key(counted.select(*schema.names).unionByName(state), ["bucket", "source_id"], order)
        if touched:
            table.write(batch_id, newest, touched, (counted, state))

    return _started(stream, merge, checkpoint)


def stale_state(stream: DataFrame, base: str, checkpoint: str, buckets: int, timeout_minutes: int = 30, delay_minutes: int = 1) -> StreamingQuery:
    """X5 by whole batches under ``base``: what ``stale_run_stream`` does per run, for batches of millions of runs.

    The state holds the open runs, with a row without a run per bucket so that none is ever empty. Limits are judged by the newest
    event time so far less the delay; rows older than this mark of the batches before come too late and are dropped.
    """
    table = BucketTable(f"{base}/state", ["run_id"], buckets)
    limit = timeout_minutes * 60_000_000

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = [n for n in _numbers(spark, f"{base}/marks", "batch") if n < batch_id]
        before = spark.read.parquet(f"{base}/marks/batch={earlier[-1]}").first()["mark"] if earlier else None
        rows = materialize(table.bucketed(batch.select("run_id", "status", "event_at")), "batch")
        if before is not None:
            rows = rows.where(F.unix_micros("event_at") > before)
        newest = rows.agg(F.max(F.unix_micros("event_at"))).first()[0]
        if newest is None and before is None:
            return
        mark = max(x for x in (before, newest and newest - delay_minutes * 60_000_000) if x is not None)

        running = F.col("status").eqNullSafe("running")
        fresh = rows.select("bucket", "run_id", F.when(running, F.col("event_at")).alias("started_at"), F.lit(False).alias("requeued"),
                            F.lit(False).alias("held"), (~running).alias("ended"))
        schema = rows.select("bucket", "run_id", F.col("event_at").alias("started_at"), F.lit(False).alias("requeued")).schema
        state = table.before(spark, batch_id, list(range(buckets)), schema).where("started_at is not null")
        united = fresh.unionByName(state.withColumn("held", F.lit(True)).withColumn("ended", F.lit(False)))
        runs = united.groupBy("bucket", "run_id").agg(
            F.bool_or("ended").alias("ended"), F.bool_or("requeued").alias("requeued"),
            F.coalesce(F.min(F.when(F.col("held"), F.col("started_at"))), F.min("started_at")).alias("started_at"))
        age = F.lit(mark) - F.unix_micros("started_at")
        runs = runs.where("not ended and started_at is not null").withColumn("late", age >= limit).withColumn("over", age >= 2 * limit)
        runs = materialize(runs.drop("ended"), "open")
        actions = F.array_compact(F.array(F.when(F.col("late") & ~F.col("requeued"), "requeue"), F.when(F.col("over"), "fail")))
        runs.select("run_id", "started_at", F.explode(actions).alias("action")).write.mode("overwrite").parquet(f"{base}/changes/batch={batch_id}")
        none = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), *[
            F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name != "bucket"])
        kept = runs.where("not over").select("bucket", "run_id", "started_at", (F.col("requeued") | F.col("late")).alias("requeued"))
        table.write(batch_id, kept.unionByName(none), list(range(buckets)), (runs,))
        spark.range(1).select(F.lit(mark).alias("mark")).write.mode("overwrite").parquet(f"{base}/marks/batch={batch_id}")

    return _started(stream, merge, checkpoint)


def read_changes(spark: SparkSession, base: str) -> DataFrame:
    """What the batches of a state under ``base`` have put out."""
    return spark.read.option("basePath", f"{base}/changes").parquet(f"{base}/changes/batch=*").drop("batch")


class StaleRunState(StatefulProcessor):
    """A run that has not ended by its timeout is reported when event time passes it."""

    def __init__(self, timeout_minutes: int) -> None:
        self.timeout_ms = timeout_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.started = handle.getValueState("started", "at timestamp, fails_next boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ended, at = False, None
        for part in rows:  # a part at a time: only the earliest time is kept
            ended = ended or bool((part["status"] != "running").any())
            at = part["event_at"].min() if at is None else min(at, part["event_at"].min())
        if ended:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if self.started.exists():
                self.started.clear()
        elif not self.started.exists():
            self.started.update((at, False))
            self.handle.registerTimer(int(at.timestamp() * 1000) + self.timeout_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.started.exists():
            return
        at, fails_next = self.started.get()
        actions = ["fail"] if fails_next else ["requeue"]
        fails_at = expiredTimerInfo.getExpiryTimeInMs() + self.timeout_ms
        if not fails_next and timerValues.getCurrentWatermarkInMs() >= fails_at:
            actions.append("fail")  # both limits were passed between two batches
        if actions[-1] == "fail":
            self.started.clear()
        else:
            self.started.update((at, True))
            self.handle.registerTimer(fails_at)
        yield pd.DataFrame({"run_id": [key[0]] * len(actions), "started_at": [at] * len(actions), "action": actions})

    def close(self) -> None:
        pass


def stale_run_stream(events: DataFrame, timeout_minutes: int = 30, delay: str = "1 minute") -> DataFrame:
    """``events`` are run status changes (run_id, status, event_at); batch twin is ``stale_runs``."""
    rows = events.select("run_id", "status", "event_at").withWatermark("event_at", delay)
    return rows.groupBy("run_id").transformWithStateInPandas(
        StaleRunState(timeout_minutes), outputStructType=STALE, outputMode="append", timeMode="eventtime")
