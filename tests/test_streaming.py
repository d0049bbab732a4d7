"""Streams fed in several steps against their batch twins."""

import random

from pyspark.sql import functions as F

from shelflens.operators import price_history as ph
from shelflens.operators import runs as rn
from shelflens.streaming import jobs, state, tables

OBS = "product_id bigint, store_id bigint, observed_at timestamp, obs_id string, price_minor bigint, availability string"


def observations(spark, n=400):
    return spark.range(n).select(
        (F.col("id") % 7).alias("product_id"), (F.col("id") % 2).alias("store_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).alias("observed_at"), F.lpad(F.col("id").cast("string"), 6, "0").alias("obs_id"),
        F.pmod(F.xxhash64("id"), F.lit(500)).alias("price_minor"),
        F.when(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(3)) == 0, "out_of_stock").otherwise("in_stock").alias("availability"))


def run(stream, path, name):
    jobs.append_parquet(stream, f"{path}/{name}", f"{path}/{name}-checkpoint").awaitTermination()


def feed(rows, path, parts):
    for low, high in parts:
        rows.where((F.col("obs_id") >= f"{low:06d}") & (F.col("obs_id") < f"{high:06d}")).coalesce(1).write.mode("append").parquet(path)
        yield


def test_price_state_equals_batch_over_steps(spark, tmp_path):
    rows, source, out = observations(spark), str(tmp_path / "in"), str(tmp_path)
    for _ in feed(rows, source, [(0, 150), (150, 160), (160, 400)]):
        state.price_state(jobs.read_observations(spark, source, rows.schema), f"{out}/changes", f"{out}/checkpoint", 4).awaitTermination()
    got = {r["obs_id"]: (r["previous_price_minor"], r["went_out_of_stock"]) for r in state.read_changes(spark, f"{out}/changes").collect()}
    gone = {r["obs_id"] for r in ph.out_of_stock_transitions(rows).collect()}
    expected = {r["obs_id"]: (r["previous_price_minor"], r["obs_id"] in gone) for r in ph.price_changes(rows).collect()}
    assert got == expected


def test_rows_older_than_the_state_are_dropped(spark, tmp_path):
    rows, source, out = observations(spark, 40), str(tmp_path / "in"), str(tmp_path)
    for _ in feed(rows, source, [(20, 40), (0, 20)]):
        state.price_state(jobs.read_observations(spark, source, rows.schema), f"{out}/late", f"{out}/checkpoint", 4).awaitTermination()
    assert state.read_changes(spark, f"{out}/late").count() == 20


def test_redelivered_rows_are_dropped(spark, tmp_path):
    rows, source, out = observations(spark, 30), str(tmp_path / "in"), str(tmp_path)
    for _ in feed(rows, source, [(0, 20), (10, 30)]):
        run(jobs.dedup_observations(jobs.read_observations(spark, source, rows.schema), ["product_id", "store_id", "observed_at"], delay="30 days"), out, "dedup")
    assert spark.read.parquet(f"{out}/dedup").count() == 30


def test_streaks_alert_once_per_series(spark, tmp_path):
    marks = "ffsfff" + "ff" + "sf"
    runs = spark.createDataFrame([(1, n, "failed" if m == "f" else "succeeded", 1704067200 + n) for n, m in enumerate(marks)],
                                 "source_id bigint, run_id bigint, status string, at bigint").withColumn("started_at", F.timestamp_seconds("at")).drop("at")
    source, out = str(tmp_path / "in"), str(tmp_path)
    for low, high in ((0, 5), (5, 8), (8, 10)):
        runs.where(F.col("run_id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(source)
        state.failure_state(jobs.read_observations(spark, source, runs.schema), f"{out}/streaks", f"{out}/checkpoint", 2, threshold=3).awaitTermination()
    rows = state.read_changes(spark, f"{out}/streaks").orderBy("run_id").collect()
    assert [r["streak"] for r in rows] == [1, 2, 0, 1, 2, 3, 4, 5, 0, 1]
    assert [r["run_id"] for r in rows if r["alert"]] == [5]


def test_latest_table_over_steps(spark, tmp_path):
    rows, source, base = observations(spark), str(tmp_path / "in"), str(tmp_path / "latest")
    for _ in feed(rows, source, [(0, 300), (300, 320), (320, 400)]):
        stream = jobs.read_observations(spark, source, rows.schema)
        jobs.maintain_latest(stream, base, str(tmp_path / "latest-checkpoint"), ["product_id", "store_id"], ["observed_at", "obs_id"], buckets=4).awaitTermination()
    got = {(r["product_id"], r["store_id"]): r["obs_id"] for r in jobs.read_latest(spark, base).collect()}
    expected = {(r["product_id"], r["store_id"]): r["obs_id"] for r in ph.latest_prices(rows).collect()}
    assert got == expected


def test_latest_table_drops_versions_nobody_needs(spark, tmp_path):
    rows, source, base = observations(spark), str(tmp_path / "in"), str(tmp_path / "latest")
    steps = [(n * 40, n * 40 + 40) for n in range(6)]
    for _ in feed(rows, source, steps):
        stream = jobs.read_observations(spark, source, rows.schema)
        jobs.maintain_latest(stream, base, str(tmp_path / "latest-checkpoint"), ["product_id", "store_id"], ["observed_at", "obs_id"], buckets=2,
                             files_per_bucket=2, keep_versions=2).awaitTermination()
    assert len(tables._numbers(spark, base, "manifest")) == 2
    named = set(tables._manifest(spark, base).values()) | set(tables._manifest(spark, base, tables._numbers(spark, base, "manifest")[0]).values())
    left = [v for v in tables._numbers(spark, base, "version") if tables._numbers(spark, f"{base}/version={v}", "bucket")]
    assert set(left) == named
    assert jobs.read_latest(spark, str(tmp_path / "nothing")) is None


def test_stale_runs_fire_on_event_time(spark, tmp_path):
    events = [(1, "running", "2024-01-01 00:00:00"), (2, "running", "2024-01-01 00:00:00"), (2, "succeeded", "2024-01-01 00:10:00"), (9, "queued", "2024-01-01 03:00:00")]
    df = spark.createDataFrame(events, "run_id bigint, status string, at string").select("run_id", "status", F.col("at").cast("timestamp").alias("event_at"))
    source, out = str(tmp_path / "in"), str(tmp_path)
    df.coalesce(1).write.parquet(source)
    run(state.stale_run_stream(jobs.read_observations(spark, source, df.schema), 30), out, "stale")
    df.withColumn("event_at", F.expr("event_at + interval 5 hours")).where("run_id = 9").coalesce(1).write.mode("append").parquet(source)
    run(state.stale_run_stream(jobs.read_observations(spark, source, df.schema), 30), out, "stale")
    assert sorted((r["run_id"], r["action"]) for r in spark.read.parquet(f"{out}/stale").collect()) == [(1, "fail"), (1, "requeue")]


def test_a_key_with_most_of_a_batch_and_prices_that_miss(spark, tmp_path):
    rows = observations(spark, 600).withColumn("product_id", F.when(F.col("obs_id") % 3 > 0, 1).otherwise(F.col("product_id"))).withColumn(
        "price_minor", F.when(F.col("obs_id") % 7 > 0, F.col("price_minor")))
    source, out = str(tmp_path / "in"), str(tmp_path)
    for _ in feed(rows, source, [(0, 50), (50, 420), (420, 425), (425, 600)]):
        state.price_state(jobs.read_observations(spark, source, rows.schema), f"{out}/changes", f"{out}/checkpoint", 3).awaitTermination()
    got = {r["obs_id"]: (r["previous_price_minor"], r["went_out_of_stock"]) for r in state.read_changes(spark, f"{out}/changes").collect()}
    gone = {r["obs_id"] for r in ph.out_of_stock_transitions(rows).collect()}
    previous = {r["obs_id"]: r["previous_price_minor"] for r in ph.price_changes(rows).collect()}
    assert got == {r["obs_id"]: (previous.get(r["obs_id"]), r["obs_id"] in gone) for r in rows.collect()}


def plain_streaks(marks):
    out, streak = [], 0
    for m in marks:
        streak = streak + 1 if m == "f" else 0
        out.append(streak)
    return out


def test_streaks_of_random_cuts_agree(spark, tmp_path):
    rng = random.Random(3)
    marks = {s: "".join(rng.choice("ffffs" if s else "f") for _ in range(60)) for s in (0, 1, 2)}
    marks[2] = marks[2][:7]
    order = [(s, n) for s in marks for n in range(len(marks[s]))]
    rows = spark.createDataFrame([(s or None, n * 3 + s, "failed" if marks[s][n] == "f" else "succeeded", 1_704_067_200 + n) for s, n in order],
                                 "source_id bigint, run_id bigint, status string, at bigint").withColumn("started_at", F.timestamp_seconds("at")).drop("at")
    expected = {n * 3 + s: v for s in marks for n, v in enumerate(plain_streaks(marks[s]))}
    assert {r.run_id: r.streak for r in rn.streaks_per_run(rows).collect()} == expected
    last = {r.source_id: r.streak for r in rn.failure_streaks(rows).collect()}
    assert last == {s or None: plain_streaks(marks[s])[-1] for s in marks}
    cuts = sorted(rng.sample(range(1, 60), 3))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for low, high in zip([0, *cuts], [*cuts, 60]):
        seconds = F.unix_timestamp("started_at") - 1_704_067_200
        rows.where((seconds >= low) & (seconds < high)).write.mode("append").parquet(source)
        state.failure_state(jobs.read_observations(spark, source, rows.schema), out, f"{out}-checkpoint", 2, threshold=3).awaitTermination()
    got = state.read_changes(spark, out).collect()
    assert {r.run_id: r.streak for r in got} == expected
    assert {r.run_id for r in got if r.alert} == {i for i, v in expected.items() if v == 3}
    # summaries of any stretches add up to that of the whole
    cut = rows.withColumn("part", F.when(F.unix_timestamp("started_at") < 1_704_067_200 + cuts[0], 0).when(F.unix_timestamp("started_at") < 1_704_067_200 + cuts[2], 1).otherwise(2))
    joined = rn.joined_summaries(rn.streak_summary(cut, ["source_id", "part"]), ["source_id"], "part")
    newest = joined.withColumn("streak", F.col("tail") + F.when(F.col("all_failed"), F.col("carried")).otherwise(0)).groupBy("source_id").agg(
        F.max_by("streak", "part").alias("streak"))
    assert {r.source_id: r.streak for r in newest.collect()} == last


def test_stale_runs_by_batches_without_python_per_run(spark, tmp_path):
    schema = "run_id bigint, status string, at string"
    batches = [[(1, "running", "2024-01-01 00:00:00"), (2, "running", "2024-01-01 00:00:00"), (3, "running", "2024-01-01 00:05:00"), (9, "queued", "2024-01-01 00:40:00")],
               [(2, "succeeded", "2024-01-01 00:50:00"), (3, "running", "2024-01-01 00:45:00"), (5, "running", "2024-01-01 00:01:00")],
               [(9, "queued", "2024-01-01 05:00:00")], [(9, "queued", "2024-01-01 06:00:00")]]
    seen = []
    for rows in batches:
        df = spark.createDataFrame(rows, schema).select("run_id", "status", F.col("at").cast("timestamp").alias("event_at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.read_observations(spark, str(tmp_path / "in"), df.schema)
        state.stale_state(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), buckets=2, timeout_minutes=30).awaitTermination()
        seen.append(sorted((r["run_id"], r["action"]) for r in state.read_changes(spark, str(tmp_path / "out")).collect()))
    first = [(1, "requeue"), (2, "requeue"), (3, "requeue")]  # late limit at 00:39; run 5 of the second batch comes behind it
    assert seen == [first, first, sorted([*first, (1, "fail"), (3, "fail")]), sorted([*first, (1, "fail"), (3, "fail")])]


def test_a_large_table_is_written_in_more_tasks(spark, tmp_path, monkeypatch):
    """No task writes a bucket whole when it holds very many rows, and small tables keep one file per bucket."""
    written = {}
    for limit in (100, 1_000_000):
        monkeypatch.setattr(tables, "ROWS_PER_FILE", limit)
        table = tables.BucketTable(str(tmp_path / f"table{limit}"), ["id"], 2)
        rows = table.bucketed(spark.range(2000))
        table.write(0, rows, [0, 1], (rows,))
        stored = table.read(spark)
        assert sorted(r["id"] for r in stored.collect()) == list(range(2000))
        written[limit] = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
    assert len(written[1_000_000]) == 2 and max(written[100]) < 600


def test_a_table_without_versions_moves_nothing(spark, tmp_path):
    table = tables.BucketTable(str(tmp_path / "table"), ["id"], 2)
    rows = table.bucketed(spark.range(10).withColumn("at", F.col("id")))
    fresh = state._newer(rows, table.before(spark, 0, [0, 1], rows.schema), ["bucket", "id"], ["at"])
    assert fresh.count() == 10
    assert "Exchange" not in fresh._jdf.queryExecution().executedPlan().toString()
