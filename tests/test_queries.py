"""Registered queries next to their SQL on the smallest tables, and rules the code keeps to."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

ROOT = Path(__file__).resolve().parents[1]
CHECKED = [
    "w1_latest_price", "u1_merge_latest", "w2_price_changes", "w10_out_of_stock", "w3_failure_streaks", "r6_price_change_alerts",
    "r7_out_of_stock_alerts", "r9_competitor_cheaper_alerts", "n8_tokens", "n11_features", "r3_online_cascade", "j15_manual_search",
    "r13_review_badges", "a6_session_summary", "a7_detailed_summary", "u2_report_sets", "r12_photo_failures", "q1_constraints",
    "s3_catalog_upsert", "s5_page_cards", "s7_api_payload", "s8_recognition", "n13_shelf_prices", "s9_template_products",
    "s17_fill_template", "a9_coverage_report", "s15_snapshot_read", "x2_dedup", "x6_price_rollup", "x8_latest_table",
]


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_sql(spark, small, sql, name):
    df = entry.queries()[name](spark, small)
    got, columns = rows_of(df.columns, df.collect())
    cur = sql.execute(entry.oracle_sql()[name])
    expected, names = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert columns == names and got == expected


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_names_carry_operator_ids():
    ids = {m.group(0).upper() for n in entry.queries() if (m := re.match(r"[a-z]\d+", n))}
    wanted = {f"{k}{n}" for k, last in {"S": 18, "N": 25, "F": 7, "J": 16, "A": 18, "W": 10, "T": 3, "U": 3, "R": 13, "Q": 2, "X": 8}.items()
              for n in range(1, last + 1)} - {"J9"}
    # N17 is the competitor comparison; W5 and the rest carry their own names.
    assert wanted - ids == set()


def test_no_driver_side_or_fragile_steps():
    for path in (ROOT / "shelflens").rglob("*.py"):
        code = path.read_text(encoding="utf8")
        assert "localCheckpoint" not in code and "crossJoin" not in code and ".toPandas(" not in code, path


def test_plans_push_down_and_prune(spark, small):
    """A latest-price plan reads only the columns it needs."""
    df = entry.queries()["u1_merge_online_only"](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "l_tax" not in plan and "l_discount" not in plan
