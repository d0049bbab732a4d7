"""Price templates: cells to products and columns, store and product resolution, filling, coverage, snapshots.

A template is a long cell table (template_id, sheet, row, col, text). ``template_id`` keeps any number of templates
apart, so nothing here depends on one template fitting a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelflens.functions import fixed_values as fv
from shelflens.functions import text as tx
from shelflens.functions.money import round_half_up
from shelflens.operators.price_history import carry_forward

SHEET = ["template_id", "sheet"]


def _department(sheet: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in fv.SHEET_DEPARTMENTS.items() for x in p]), sheet)


def _known_sheets(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("sheet").isin(*fv.SHEET_DEPARTMENTS)).withColumn("text", F.trim("text"))


def template_products(cells: DataFrame) -> DataFrame:
    """S9 + W7: product rows with the category above them; the first row per sheet and barcode stays."""
    body = _known_sheets(cells).where((F.col("row") >= 2) & F.col("col").isin(0, 1))
    rows = body.groupBy(*SHEET, "row").agg(
        F.max(F.when(F.col("col") == 0, F.col("text"))).alias("name"),
        F.max(F.when(F.col("col") == 1, F.col("text"))).alias("code")).where(tx.has_text(F.col("name")))
    barcode = tx.template_barcode(F.col("code"))
    rows = rows.withColumn("barcode", barcode).withColumn("_category", F.when(barcode.isNull(), F.col("name")))
    filled = carry_forward(rows, SHEET, "row", "_category", "category").where(F.col("barcode").isNotNull())
    first = filled.groupBy(*SHEET, "barcode").agg(
        F.min("row").alias("row"), F.min_by(F.struct("name", "category"), "row").alias("r"))
    return first.select("template_id", "sheet", _department(F.col("sheet")).alias("department"), "barcode",
                        "r.name", "r.category", "row")


def template_columns(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Price columns from the two header rows.

    An own-store label covers its merged range; ranges are spelled out column by column, so the join is an equality.
    """
    head = _known_sheets(cells).where((F.col("col") >= 2) & (F.col("text") != ""))
    own = head.where(F.col("row") == 0).select(*SHEET, F.col("col").alias("col_start"), F.col("text").alias("own_label"))
    spans = merges.where(F.col("row") == 0).select(*SHEET, "col_start", "col_end")
    covered = own.join(spans, [*SHEET, "col_start"], "left").withColumn(
        "col", F.explode(F.sequence("col_start", F.coalesce("col_end", "col_start")))).select(*SHEET, "col", "own_label")
    labels = head.where(F.col("row") == 1).select(*SHEET, "col", F.col("text").alias("cell_label"))
    out = labels.join(covered, [*SHEET, "col"])
    is_own = F.lower("cell_label") == fv.OWN_PRICE_LABEL
    return out.select(
        "template_id", "sheet", _department(F.col("sheet")).alias("department"), "col", "own_label",
        F.when(is_own, F.col("own_label")).otherwise(F.col("cell_label")).alias("store_label"),
        F.when(is_own, "own").otherwise("competitor").alias("price_kind"))


def column_stores(columns: DataFrame) -> DataFrame:
    """Stores named by a template, own stores marked."""
    own = columns.where(F.col("price_kind") == "own").select(F.col("store_label").alias("label"), F.lit(True).alias("is_own"))
    named = columns.select(F.col("own_label").alias("label"), F.lit(False).alias("is_own")).unionByName(
        columns.select(F.col("store_label").alias("label"), F.lit(False).alias("is_own")))
    stores = own.unionByName(named).groupBy("label").agg(F.bool_or("is_own").alias("is_own"))
    return stores.select("label", tx.split_store_label(F.col("label")).alias("s"), "is_own").select(
        "label", "s.name", "s.address", "is_own")


def upsert_stores(current: DataFrame, labels: DataFrame) -> DataFrame:
    """Stores by (name, address); is_own can be switched on, never off."""
    fresh = labels.groupBy(tx.store_key(F.col("name"), F.col("address")).alias("_key")).agg(
        F.min_by(F.struct("name", "address"), "name").alias("n"), F.bool_or("is_own").alias("_own"))
    old = current.withColumn("_key", tx.store_key(F.col("name"), F.col("address")))
    out = old.join(fresh, "_key", "full_outer")
    new_id = F.concat(F.lit("store-"), F.substring(F.sha2("_key", 256), 1, 16))
    return out.select(
        F.coalesce(F.col("store_id").cast("string"), new_id).alias("store_id"),
        F.coalesce("name", "n.name").alias("name"), F.coalesce("address", "n.address").alias("address"),
        (F.coalesce("is_own", F.lit(False)) | F.coalesce("_own", F.lit(False))).alias("is_own"),
        F.col("store_id").isNull().alias("created"))


def resolve_columns(columns: DataFrame, stores: DataFrame) -> DataFrame:
    """Competitor column -> store by name and address, else by a name only one competitor store has."""
    rivals = stores.where(~F.col("is_own"))
    exact = rivals.groupBy(tx.store_key(F.col("name"), F.col("address")).alias("_key")).agg(
        F.max("store_id").alias("_exact"))
    by_name = rivals.groupBy(F.lower(F.trim("name")).alias("_name")).agg(
        F.count("*").alias("_n"), F.min("store_id").alias("_named")).where("_n = 1").drop("_n")
    label = tx.split_store_label(F.col("store_label"))
    wanted = (columns.where(F.col("price_kind") == "competitor")
              .withColumn("_key", tx.store_key(label["name"], label["address"]))
              .withColumn("_name", F.lower(label["name"])))
    out = wanted.join(exact, "_key", "left").join(by_name, "_name", "left")
    return out.select(*columns.columns, F.coalesce("_exact", "_named").alias("store_id"))


def resolve_products(products: DataFrame, catalog: DataFrame) -> DataFrame:
    """Template row -> product by barcode or SKU; the first catalogue row wins a code."""
    codes = catalog.select("product_id", F.explode(F.array(
        tx.template_barcode(F.col("barcode")), tx.template_barcode(F.col("external_sku")))).alias("barcode"))
    first = codes.where(F.col("barcode").isNotNull()).groupBy("barcode").agg(F.min("product_id").alias("product_id"))
    return products.join(first, "barcode", "left")


def column_key(columns: DataFrame) -> DataFrame:
    return columns.withColumn("col_key", F.concat_ws(":", "department", F.col("col").cast("string")))


def template_prices(products: DataFrame, columns: DataFrame, prices: DataFrame) -> DataFrame:
    """The long form behind filling and coverage: (product row, column, price).

    Prices meet the resolved stores first and the template's products second; both are equality joins.
    """
    wanted = column_key(columns).where(F.col("store_id").isNotNull()).select(
        "template_id", "department", "col_key", "store_id")
    rows = products.where(F.col("product_id").isNotNull()).select("template_id", "department", "row", "product_id")
    return (prices.select("product_id", "store_id", "price_minor").join(wanted, "store_id")
            .join(rows, ["template_id", "department", "product_id"])
            .select("template_id", "department", "row", "product_id", "col_key", "price_minor"))


def fill_template(products: DataFrame, columns: DataFrame, prices: DataFrame, col_keys: list[str]) -> DataFrame:
    """One row per template product, one column per listed column key, in currency units.

    ``col_keys`` comes from the template header (spreadsheets end at 16 384 columns), so no extra job looks for it.
    """
    filled = template_prices(products, columns, prices)
    wide = filled.groupBy("template_id", "department", "row").pivot("col_key", col_keys).agg(
        F.min("price_minor") / F.lit(100.0))
    return products.select("template_id", "department", "row", "barcode", "name").join(
        wide, ["template_id", "department", "row"], "left")


def low_confidence(shelf_items: DataFrame, samples: int = 3) -> DataFrame:
    """A10: per store, matched rows without or with low confidence, and the first ``samples`` of them to look at."""
    low = shelf_items.where(F.col("product_id").isNotNull() & (
        F.col("match_confidence").isNull() | (F.col("match_confidence") < fv.LOW_CONFIDENCE)))
    counts = low.groupBy("store_id").agg(F.count("*").alias("low_confidence_rows"))
    w = Window.partitionBy("store_id").orderBy("obs_id")
    first = low.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= samples)
    named = first.groupBy("store_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_n", F.coalesce("raw_name", F.lit("(без названия)")).alias("raw_name"),
                                             "match_confidence"))),
        lambda r: F.struct(r["raw_name"].alias("raw_name"), r["match_confidence"].alias("match_confidence"))
    ).alias("samples"))
    return counts.join(named, "store_id", "left")


def low_confidence_samples(shelf_items: DataFrame, samples: int = 10) -> DataFrame:
    """A10 overall: the first ``samples`` matched rows without or with low confidence; each task keeps that many at most."""
    low = shelf_items.where(F.col("product_id").isNotNull() & (
        F.col("match_confidence").isNull() | (F.col("match_confidence") < fv.LOW_CONFIDENCE)))
    return low.orderBy("obs_id").limit(samples).select(
        "store_id", F.coalesce("raw_name", F.lit("(без названия)")).alias("raw_name"), "match_confidence")


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, round_half_up(part / whole * 100)).otherwise(F.lit(0).cast("bigint"))


def column_coverage(products: DataFrame, columns: DataFrame, prices: DataFrame, low: DataFrame) -> DataFrame:
    """A9 per competitor column: filled and fillable cells, percent, low-confidence rows."""
    keyed = column_key(columns)
    total = (products.where(F.col("product_id").isNotNull()).groupBy("template_id", "department")
             .agg(F.countDistinct("product_id").alias("total_rows")))
    filled = (template_prices(products, columns, prices).groupBy("template_id", "col_key")
              .agg(F.countDistinct("product_id").alias("filled")))
    out = (keyed.join(total, ["template_id", "department"], "left").join(filled, ["template_id", "col_key"], "left")
           .join(low.select("store_id", "low_confidence_rows"), "store_id", "left"))
    resolved = F.col("store_id").isNotNull()
    n, whole = F.coalesce("filled", F.lit(0)), F.coalesce("total_rows", F.lit(0))
    return out.select(
        "template_id", "department", "col", "store_label", "store_id", resolved.alias("resolved"),
        n.alias("filled"), whole.alias("total_rows"),
        F.when(resolved, _pct(n, whole)).otherwise(F.lit(0).cast("bigint")).alias("coverage_pct"),
        F.when(resolved, F.coalesce("low_confidence_rows", F.lit(0))).otherwise(F.lit(0)).alias("low_confidence_rows"))


def coverage_by_problem(coverage: DataFrame) -> DataFrame:
    """Worst coverage first."""
    return coverage.orderBy("coverage_pct", "template_id", "department", "col")


def coverage_report(coverage: DataFrame, products: DataFrame) -> DataFrame:
    """A9 overall: totals, percent and warnings per template. Unresolved columns are not in the denominator."""
    c = F.col
    unmapped = products.groupBy("template_id").agg(F.count_if(c("product_id").isNull()).alias("unmapped_rows"))
    lost = F.when(~c("resolved"), F.struct("department", "col", "store_label"))
    totals = coverage.groupBy("template_id").agg(
        F.count("*").alias("competitor_columns"), F.count_if("resolved").alias("resolved_stores"),
        F.transform(F.array_sort(F.collect_list(lost)), lambda s: s["store_label"]).alias("unresolved_labels"),
        F.coalesce(F.sum(F.when(c("resolved"), c("filled"))), F.lit(0)).alias("filled_cells"),
        F.coalesce(F.sum(F.when(c("resolved"), c("total_rows"))), F.lit(0)).alias("total_cells"),
        F.sum("low_confidence_rows").alias("low_confidence_rows"))
    out = totals.join(unmapped, "template_id", "left").withColumn("unmapped_rows", F.coalesce("unmapped_rows", F.lit(0)))
    out = out.withColumn("coverage_pct", _pct(c("filled_cells"), c("total_cells")))
    n = F.size("unresolved_labels")
    labels = F.array_join("unresolved_labels", ", ")
    warnings = F.array_compact(F.array(
        F.when(c("resolved_stores") == 0,
               "no_store_resolved"),
        F.when((c("resolved_stores") > 0) & (c("coverage_pct") < fv.LOW_COVERAGE_PCT), F.concat(
            F.lit("low_coverage: "), c("coverage_pct").cast("string"), F.lit(" %"))),
        F.when(n > 0, F.concat(F.lit("unresolved_columns: "), n.cast("string"), F.lit(" — "), labels)),
        F.when(c("unmapped_rows") > 0, F.concat(
            F.lit("unknown_barcodes: "), c("unmapped_rows").cast("string"))),
        F.when(c("low_confidence_rows") > 0, F.concat(
            F.lit("low_confidence: "), c("low_confidence_rows").cast("string"), F.lit(f" (< {fv.LOW_CONFIDENCE})")))))
    return out.withColumn("unresolved_columns", n).withColumn("warnings", warnings)


def snapshot_id(at: Column) -> Column:
    return F.concat(F.lit("export-"), F.date_format(at, "yyyyMMdd-HHmmss"))


def build_snapshot(prices: DataFrame, at: Column) -> DataFrame:
    """Product -> store -> price under one snapshot id.

    The outer map is a row per product, so a snapshot of any size stays spread over the cluster; the inner map is
    bounded by the store list.
    """
    entry = F.struct(F.col("store_id").cast("string"), F.col("price_minor"))
    return prices.groupBy(F.col("product_id").cast("string").alias("product_id")).agg(
        F.map_from_entries(F.collect_list(entry)).alias("store_prices")).select(
        snapshot_id(at).alias("snapshot_id"), at.cast("timestamp").alias("created_at"), "product_id", "store_prices")


def snapshot_header(report: DataFrame, at: Column) -> DataFrame:
    """The coverage figures and warnings kept with a snapshot."""
    return report.select(snapshot_id(at).alias("snapshot_id"), at.cast("timestamp").alias("created_at"), "template_id",
                         "total_cells", "filled_cells", "coverage_pct", "resolved_stores", "unresolved_columns", "warnings")


def read_snapshot(snapshots: DataFrame, wanted: Column) -> DataFrame:
    """A snapshot as long prices again."""
    rows = snapshots.where(F.col("snapshot_id") == wanted)
    return rows.select("snapshot_id", "product_id", F.explode("store_prices").alias("store_id", "price_minor"))


def recent_snapshots(snapshots: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n`` snapshots, one row each."""
    heads = snapshots.groupBy("snapshot_id").agg(F.max("created_at").alias("created_at"), F.count("*").alias("products"))
    return heads.orderBy(F.col("created_at").desc(), "snapshot_id").limit(n)
