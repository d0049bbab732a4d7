"""Latest prices, changes, streaks, alerts, templates: edge cases that the tables do not show."""

import pytest
from pyspark.sql import functions as F

from shelflens.operators import alerts as al, price_history as ph, quality as ql, runs as rn, template as tp

OBS = "product_id string, store_id string, price_minor bigint, observed_at timestamp, obs_id bigint, source string, availability string"


def observations(spark, rows):
    return spark.createDataFrame(rows, OBS.replace("timestamp", "string")).withColumn("observed_at", F.col("observed_at").cast("timestamp"))


def prices(df):
    return {(r["product_id"], r["store_id"]): r["price_minor"] for r in df.collect()}


def test_source_modes(spark):
    rows = observations(spark, [
        ("milk", "spar", 8990, "2024-01-01", 1, "online", "in_stock"), ("milk", "spar", 9500, "2024-01-05", 2, "photo", "in_stock"),
        ("milk", "photo-only", 8000, "2024-01-01", 3, "photo", "in_stock"), (None, "spar", 1, "2024-01-01", 4, "online", "in_stock"),
        ("tea", "spar", None, "2024-01-01", 5, "online", "in_stock")])
    merged = {("milk", "spar"): 8990, ("milk", "photo-only"): 8000}
    assert prices(ph.merge_sources(rows, "online_preferred")) == merged == prices(ph.merge_sources(rows, "latest"))
    assert prices(ph.merge_sources(rows, "freshest")) == {**merged, ("milk", "spar"): 9500}
    assert prices(ph.merge_sources(rows, "online_only")) == {("milk", "spar"): 8990}
    with pytest.raises(ValueError):
        ph.merge_sources(rows, "newest")


def test_ties_are_broken_by_id_whatever_the_partitioning(spark):
    rows = observations(spark, [("p", "s", n, "2024-01-01", n, "online", "in_stock") for n in range(50)])
    assert {prices(ph.latest_prices(rows.repartition(n)))[("p", "s")] for n in (1, 3, 8)} == {49}


def test_previous_crosses_days_and_zero_prices(spark):
    rows = observations(spark, [
        ("p", "s", 100, "2024-01-01 08:00:00", 1, "online", "in_stock"), ("p", "s", 0, "2024-01-01 09:00:00", 2, "online", "in_stock"),
        ("p", "s", 50, "2024-01-04 09:00:00", 3, "online", "out_of_stock"), ("p", "s", 75, "2024-01-05 09:00:00", 4, "online", "out_of_stock")])
    got = {r["obs_id"]: (r["previous_price_minor"], r["change_pct"]) for r in ph.price_changes(rows).collect()}
    assert got == {1: (None, None), 2: (100, 100.0), 3: (0, None), 4: (50, 50.0)}
    assert [r["obs_id"] for r in ph.out_of_stock_transitions(rows).collect()] == [3]


def test_a_busy_day_of_one_key_stays_linear(spark):
    rows = spark.range(300_000).select(
        F.lit("p").alias("product_id"), F.lit("s").alias("store_id"), F.col("id").alias("price_minor"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 3600).alias("observed_at"), F.col("id").alias("obs_id"))
    got = ph.with_previous(rows, ["product_id", "store_id"], ["observed_at", "obs_id"], ["price_minor"])
    assert got.agg(F.count_if("has_previous"), F.count("*")).first()[:] == (299_999, 300_000)
    parts = ph.in_ranges(rows, ["product_id", "store_id"], ["observed_at", "obs_id"], "slot").groupBy("slot").count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 120_000  # spread over all tasks


def test_rows_of_usual_keys_move_once_and_busy_keys_are_split(spark, monkeypatch):
    """Without a busy key one window over the key does; rows of a busy key go through ranges, and both give the same."""
    rows = spark.range(3000).select(
        F.when(F.col("id") < 2000, "busy").otherwise(F.concat(F.lit("p"), F.col("id") % 300)).alias("product_id"), F.lit(None).cast("string").alias("store_id"),
        F.when(F.col("id") % 7 != 0, F.col("id")).alias("price_minor"), F.timestamp_seconds(F.col("id") % 50).alias("observed_at"), F.col("id").alias("obs_id"))
    get = lambda: ph.with_previous(rows, ph.PAIR, ["observed_at", "obs_id"], ["price_minor"])
    plan = get()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "parquet" not in plan
    expected = sorted(get().collect(), key=lambda r: r["obs_id"])
    split, ranged = [], ph.in_ranges
    monkeypatch.setattr(ph, "BUSY_ROWS", 1000)
    monkeypatch.setattr(ph, "in_ranges", lambda df, *rest: split.append(df) or ranged(df, *rest))
    assert sorted(get().collect(), key=lambda r: r["obs_id"]) == expected
    assert [df.where("product_id = 'busy'").count() for df in split] == [2000] and split[0].count() < 2100
    assert sum(not r["has_previous"] for r in expected) == 301


def test_rules_meet_rows_by_equality_and_threshold(spark):
    changes = spark.createDataFrame([(n, n % 3, float(n), "p", "s") for n in range(30)], "obs_id int, source_id int, change_pct double, product_id string, store_id string")
    rules = spark.createDataFrame([("a", None, "price_change", 20.0, True), ("b", 1, "price_change", 5.0, True), ("c", 1, "price_change", 5.0, False)],
                                  "rule_id string, source_id int, alert_type string, threshold double, enabled boolean")
    alerts = al.price_change_alerts(changes, rules)
    got = sorted((r["rule_id"], int(r["value"])) for r in alerts.collect())
    assert got == sorted([("a", n) for n in range(20, 30)] + [("b", n) for n in range(30) if n % 3 == 1 and n >= 5])
    plan = alerts._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_an_emptied_report_set_is_gone_after_the_next_export(spark, tmp_path, monkeypatch):
    from shelflens.operators import sessions as se
    monkeypatch.setattr(se, "report_sets", lambda rows: rows)
    path = str(tmp_path / "sets")
    se.write_report_sets(spark.createDataFrame([("1", "a"), ("2", "b")], "item_id string, report_set string"), path)
    se.write_report_sets(spark.createDataFrame([("1", "a")], "item_id string, report_set string"), path)
    assert [r["report_set"] for r in spark.read.parquet(path).collect()] == ["a"]


def test_one_hot_key_agrees_with_a_plain_window(spark):
    from pyspark.sql import Window
    rows = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("product_id"), F.lit(1).alias("store_id"),
        F.pmod(F.xxhash64("id"), F.lit(5000)).alias("price_minor"), F.timestamp_seconds(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(86400 * 20))).alias("observed_at"),
        F.col("id").alias("obs_id"))
    w = Window.partitionBy("product_id", "store_id").orderBy("observed_at", "obs_id")
    plain = rows.withColumn("expected", F.lag("price_minor").over(w)).select("obs_id", "expected")
    split = ph.price_changes(rows).select("obs_id", "previous_price_minor")
    joined = split.join(plain, "obs_id")
    assert joined.count() == 20000 and joined.where("NOT (previous_price_minor <=> expected)").count() == 0


def test_carry_forward_across_blocks(spark):
    rows = spark.createDataFrame([("s", n, "c" if n == 0 else ("d" if n == 7 else None)) for n in range(20)], "sheet string, row int, head string")
    got = [r["category"] for r in ph.carry_forward(rows, ["sheet"], "row", "head", "category", block_rows=3).orderBy("row").collect()]
    assert got == ["c"] * 7 + ["d"] * 13


def test_streak_counts_all_failed_runs_unless_bounded(spark):
    rows = [(1, n, "failed", n) for n in range(15)] + [(2, 1, "failed", 1), (2, 2, "succeeded", 2), (2, 3, "failed", 3)]
    df = spark.createDataFrame(rows, "source_id bigint, run_id bigint, status string, started_at bigint")
    assert {r["source_id"]: r["streak"] for r in rn.failure_streaks(df).collect()} == {1: 15, 2: 1}
    assert {r["source_id"]: r["streak"] for r in rn.failure_streaks(df, recent=10).collect()} == {1: 10, 2: 1}


def test_stale_actions(spark):
    df = spark.createDataFrame([(None,), ("2024-01-01 11:31:00",), ("2024-01-01 11:30:00",), ("2024-01-01 11:00:00",)], "s string")
    now = F.lit("2024-01-01 12:00:00")
    assert [r[0] for r in df.select(rn.stale_action(F.col("s"), now)).collect()] == ["ok", "ok", "requeue", "fail"]


RULES = "rule_id string, source_id bigint, alert_type string, threshold double, enabled boolean"


def test_rules_scope_severity_and_suppression(spark):
    rules = spark.createDataFrame([("a", None, "price_change", 10.0, True), ("b", 7, "price_change", 5.0, True), ("c", None, "price_change", 1.0, False),
                                   ("f", None, "run_failure", 2.0, True), ("o2", None, "out_of_stock", 0.0, True), ("o1", 1, "out_of_stock", 0.0, True)], RULES)
    changes = spark.createDataFrame([(1, 20.0), (7, 6.0), (1, 9.0), (1, None)], "source_id bigint, change_pct double")
    got = sorted((r["rule_id"], r["severity"], r["value"]) for r in al.price_change_alerts(changes, rules).collect())
    assert got == [("a", "critical", 20.0), ("b", "warning", 6.0)]
    gone = spark.createDataFrame([(1, "x"), (2, "y")], "source_id bigint, product_id string")
    assert sorted(r["rule_id"] for r in al.out_of_stock_alerts(gone, rules).collect()) == ["o1", "o2"]
    streaks = spark.createDataFrame([(1, 4, 10, "failed"), (2, 2, 11, "failed"), (3, 5, 12, "succeeded")], "source_id bigint, streak bigint, last_run_id bigint, last_status string")
    opened = spark.createDataFrame([(2, "run_failure", "new")], "source_id bigint, alert_type string, status string")
    got = [(r["source_id"], r["severity"]) for r in al.run_failure_alerts(streaks, rules, opened).collect()]
    assert got == [("1", "critical")]


def template(spark):
    cells = [(0, 2, "Наша ТТ (Розница)"), (1, 0, "Наименование"), (1, 1, "Штрихкод"), (1, 2, "Наша цена"), (1, 3, "Спар, Ленина 60"), (1, 4, "Магнит"), (1, 5, "Без блока"),
             (2, 0, "Молочное"), (3, 0, "Молоко"), (3, 1, "111.0"), (4, 0, "Молоко"), (4, 1, "111"), (5, 0, "Чай"), (5, 1, "999"), (6, 0, "Бакалея"), (6, 1, "0"), (7, 0, "Рис"), (7, 1, "222")]
    df = spark.createDataFrame([("t", "Продукты", *c) for c in cells], "template_id string, sheet string, row int, col int, text string")
    merges = spark.createDataFrame([("t", "Продукты", 0, 2, 4)], "template_id string, sheet string, row int, col_start int, col_end int")
    return df, merges


def test_template_end_to_end(spark):
    cells, merges = template(spark)
    products = tp.template_products(cells)
    assert {r["barcode"]: (r["category"], r["row"]) for r in products.collect()} == {"111": ("Молочное", 3), "999": ("Молочное", 5), "222": ("Бакалея", 7)}
    columns = tp.template_columns(cells, merges)
    assert sorted((r["col"], r["price_kind"]) for r in columns.collect()) == [(2, "own"), (3, "competitor"), (4, "competitor")]
    stores = spark.createDataFrame([("s1", "спар", "ленина 60", False), ("s2", "Спар", "Мира 1", False), ("s3", "Магнит", "а", False), ("s4", "Магнит", "б", False)],
                                   "store_id string, name string, address string, is_own boolean")
    resolved = tp.resolve_columns(columns, stores)
    assert {r["store_label"]: r["store_id"] for r in resolved.collect()} == {"Спар, Ленина 60": "s1", "Магнит": None}
    catalog = spark.createDataFrame([("p1", "111", "A"), ("p2", None, "222")], "product_id string, barcode string, external_sku string")
    rows = tp.resolve_products(products, catalog)
    latest = spark.createDataFrame([("p1", "s1", 8990), ("p2", "s2", 1)], "product_id string, store_id string, price_minor bigint")
    filled = {r["barcode"]: r["products:3"] for r in tp.fill_template(rows, resolved, latest, ["products:3", "products:4"]).collect()}
    assert filled == {"111": 89.9, "222": None, "999": None}
    shelf = spark.createDataFrame([("p1", "s1", "x", 0.5, 1), ("p1", "s1", None, None, 2), (None, "s1", "y", 0.1, 3)],
                                  "product_id string, store_id string, raw_name string, match_confidence double, obs_id bigint")
    coverage = tp.column_coverage(rows, resolved, latest, tp.low_confidence(shelf))
    report = tp.coverage_report(coverage, rows).first()
    assert (report["filled_cells"], report["total_cells"], report["coverage_pct"], report["unresolved_columns"], report["unmapped_rows"]) == (1, 2, 50, 1, 1)
    assert report["low_confidence_rows"] == 2 and report["warnings"] == [
        "unresolved_columns: 1 — Магнит", "unknown_barcodes: 1", "low_confidence: 2 (< 0.7)"]


def test_golden_accuracy_of_no_samples(spark):
    empty = spark.createDataFrame([], "is_correct_match boolean, match_score double, verification_status string")
    assert tuple(ql.golden_accuracy(empty).first()) == (0, 0, None, None)
