"""Sessions: enrichment, status counts, lifecycle, report rows, KPIs and report sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelflens.functions import fixed_values as fv
from shelflens.functions import report_text as rt
from shelflens.functions.money import diff_minor, diff_ratio, effective_price

REPORT_SETS = ("all", "comparison", "competitor_cheaper", "own_cheaper", "review", "ai_candidates",
               "without_candidate", "missing_own_price", "not_found", "products", "chemistry")
PHOTO_STATUSES = ["uploaded", "queued", "processing", "processed", "failed", "expired"]
ITEM_STATUSES = ["recognized", "matched", "needs_review", "unmatched", "confirmed", "rejected"]


def tenant_rows(rows: DataFrame, memberships: DataFrame, user_id: Column) -> DataFrame:
    """rows of the companies the user belongs to."""
    return rows.join(memberships.where(F.col("user_id") == user_id).select("company_id"), "company_id", "left_semi")


def exportable(items: DataFrame) -> DataFrame:
    """items that go into reports."""
    return items.where(F.col("status").isin(*fv.EXPORT_STATUSES))


def auto_match_ready(items: DataFrame) -> DataFrame:
    """confident enough to be matched without a person."""
    return items.where((F.col("confidence") >= 0.8) & (F.col("link_confidence") >= 0.8)
                       & F.col("price_minor").isNotNull() & F.col("bbox").isNotNull())


def expire(rows: DataFrame, now: Column) -> DataFrame:
    """photos and evidence past their date are expired; their prices stay."""
    due = F.col("expires_at") <= now
    return rows.withColumn("status", F.when(due, "expired").otherwise(F.col("status")))


def inherit_department(items: DataFrame, photos: DataFrame) -> DataFrame:
    """An item without department takes its photo's."""
    own = photos.select("photo_id", F.col("department").alias("_photo_department"))
    return items.join(own, "photo_id", "left").withColumn(
        "department", F.coalesce("department", "_photo_department")).drop("_photo_department")


def enrich_items(items: DataFrame, matches: DataFrame, catalog: DataFrame, evidence: DataFrame,
                 sessions: DataFrame, photos: DataFrame | None = None) -> DataFrame:
    """Item with its active match, product, first evidence, photo and session.

    Items are the widest rows, so they move once for their id: products go to the matches, and sessions come first, where items
    that were joined by session lie already.
    """
    active = matches.where("is_active").select(
        "item_id", "product_id", F.col("score").alias("match_score"), F.col("decision").alias("match_decision"))
    product = catalog.select("product_id", F.col("external_sku").alias("product_sku"), F.col("name").alias("product_name"),
                             F.col("brand").alias("product_brand"), F.col("size_text").alias("product_size"),
                             "own_price_minor", F.lit(True).alias("_found"))
    first = F.min(F.when(F.col("evidence_id").isNotNull(), F.struct("evidence_id", "storage_path"))).alias("_first")  # each text once
    proof = evidence.groupBy("item_id").agg(first).select(
        "item_id", F.col("_first.evidence_id").alias("evidence_id"), F.col("_first.storage_path").alias("evidence_path"))
    matched = active.join(product, "product_id", "left")
    out = items.join(sessions, "session_id", "left").join(matched, "item_id", "left").join(proof, "item_id", "left")
    if photos is not None:
        out = out.join(photos.select("photo_id", F.col("storage_path").alias("photo_path")), "photo_id", "left")
    return out.withColumn("has_product", F.col("_found").isNotNull()).drop("_found")


def report_rows(enriched: DataFrame, detailed: bool = False) -> DataFrame:
    """The report columns of exportable items."""
    c = F.col
    own = c("own_price_minor") if detailed else None
    rows = exportable(enriched).withColumn("competitor_minor", effective_price(c("price_minor"), c("promo_price_minor")))
    rows = (rows.withColumn("diff_minor", diff_minor(c("competitor_minor"), c("own_price_minor")))
            .withColumn("diff_ratio", diff_ratio(c("competitor_minor"), c("own_price_minor"))))
    return (rows.withColumn("needs_attention", rt.needs_attention(c("status"), c("has_product"), c("diff_ratio"), own))
            .withColumn("not_found", c("status") == "unmatched")
            .withColumn("comment", rt.comment(c("status"), c("has_product"), c("diff_ratio"), c("review_reason"), own))
            .withColumn("department_label", rt.department_label(c("department")))
            .withColumn("diff_pct_text", rt.percent_text(c("diff_ratio"))))


def session_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The KPI counters of the plain report."""
    review = F.col("status") == "needs_review"
    candidate = F.col("match_score").isNotNull()
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("status").isin("matched", "confirmed")).alias("matched"),
        F.count_if(F.col("status") == "unmatched").alias("unmatched"),
        F.count_if(review).alias("needs_review"),
        F.count_if(review & candidate).alias("needs_review_with_candidate"),
        F.count_if(review & ~candidate).alias("needs_review_without_candidate"),
        F.count_if(rt.large_diff(F.col("diff_ratio"))).alias("large_price_diff"),
        F.count_if(F.col("evidence_id").isNotNull()).alias("with_evidence"),
        F.count_if(F.col("evidence_id").isNull()).alias("without_evidence"))


def detailed_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The detailed report counts on the printed percent, so 4.95 % already counts as 5.0 %."""
    c = F.col
    named = F.coalesce(c("product_name") != "", F.lit(False))
    comparable = named & c("own_price_minor").isNotNull() & c("competitor_minor").isNotNull()
    review = c("status") == "needs_review"
    printed = F.abs(rt.percent_tenths(c("diff_ratio")))
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("rows"),
        F.count_if(c("department") == "products").alias("products"),
        F.count_if(c("department") == "chemistry").alias("chemistry"),
        F.count_if(c("status").isin("matched", "confirmed")).alias("matched"),
        F.count_if(c("status") == "unmatched").alias("unmatched"),
        F.count_if(review).alias("needs_review"),
        F.count_if(review & named).alias("needs_review_with_candidate"),
        F.count_if(review & ~named).alias("needs_review_without_candidate"),
        F.count_if(c("match_decision") == "ai_review").alias("ai_candidates"),
        F.count_if(comparable).alias("comparable_prices"),
        F.count_if(comparable & (c("diff_minor") < 0)).alias("competitor_cheaper"),
        F.count_if(comparable & (c("diff_minor") > 0)).alias("own_cheaper"),
        F.count_if(printed >= fv.LARGE_DIFF * 1000).alias("large_price_diff"),
        F.count_if(named & c("own_price_minor").isNull()).alias("missing_own_price"))


def json_summary(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The four counters of the JSON report."""
    return items.groupBy(*(by or [])).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status").isin("matched", "confirmed")).alias("matched"),
        F.count_if(F.col("status") == "needs_review").alias("needs_review"),
        F.count_if(F.col("status") == "unmatched").alias("unmatched"))


def report_sets(rows: DataFrame) -> DataFrame:
    """Each detailed row once per report set it belongs to, in one pass."""
    c = F.col
    named = F.coalesce(c("product_name") != "", F.lit(False))
    comparable = named & c("own_price_minor").isNotNull() & c("competitor_minor").isNotNull()
    review = c("status") == "needs_review"
    labels = F.array_compact(F.array(
        F.lit("all"), F.when(comparable, "comparison"),
        F.when(comparable & (c("diff_minor") < 0), "competitor_cheaper"),
        F.when(comparable & (c("diff_minor") > 0), "own_cheaper"),
        F.when(c("needs_attention") | review, "review"),
        F.when(c("match_decision") == "ai_review", "ai_candidates"),
        F.when(review & ~named, "without_candidate"),
        F.when(named & c("own_price_minor").isNull(), "missing_own_price"),
        F.when(c("not_found"), "not_found"),
        F.when(c("department") == "products", "products"),
        F.when(c("department") == "chemistry", "chemistry")))
    return rows.withColumn("report_set", F.explode(labels))


def write_report_sets(rows: DataFrame, path: str) -> None:
    """Replaces the whole export: a set that is empty now has no folder afterwards."""
    (report_sets(rows).repartition("report_set", F.pmod(F.xxhash64("item_id"), F.lit(16))).write.mode("overwrite")
     .option("partitionOverwriteMode", "static").partitionBy("report_set").parquet(path))


def session_report_json(rows: DataFrame) -> DataFrame:
    """One nested JSON document per item."""
    c = F.col
    doc = F.struct(
        c("item_id").alias("id"), c("status"),
        F.struct(c("product_sku").alias("sku"), c("product_name").alias("name"),
                 F.coalesce("product_brand", "brand").alias("brand"), F.coalesce("product_size", "size_text").alias("size"),
                 c("raw_name").alias("recognized_name")).alias("product"),
        F.struct(c("competitor_minor"), c("price_minor").alias("competitor_regular_minor"),
                 c("old_price_minor").alias("competitor_old_minor"), c("own_price_minor").alias("own_minor"),
                 c("diff_minor").alias("difference_minor"), c("diff_ratio").alias("difference_percent"),
                 F.coalesce(c("currency") if "currency" in rows.columns else F.lit(None), F.lit("RUB")).alias("currency")
                 ).alias("prices"),
        F.struct(c("confidence").alias("ocr"), c("link_confidence").alias("price_tag_link"),
                 c("match_score").alias("catalog_match")).alias("confidence"),
        F.struct((c("status") == "needs_review").alias("required"), c("review_reason").alias("reason")).alias("review"),
        F.struct(c("evidence_path").alias("price_tag_crop_path")).alias("evidence"))
    return rows.select("session_id", "item_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))


def status_counts(rows: DataFrame, key: str, statuses: list[str]) -> DataFrame:
    """A2: rows per status and key, one column per known status."""
    return rows.groupBy(key).agg(F.count("*").alias("total"),
                                 *[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def session_progress(photos: DataFrame, items: DataFrame) -> DataFrame:
    """A2 derived: waiting, queueable, review and ready-for-export counts per session."""
    p = status_counts(photos, "session_id", PHOTO_STATUSES).select(
        "session_id", F.col("total").alias("photos"), F.col("processed"),
        (F.col("uploaded") + F.col("failed") + F.col("queued")).alias("waiting"),
        (F.col("uploaded") + F.col("failed")).alias("queueable"))
    i = status_counts(items, "session_id", ITEM_STATUSES).select(
        "session_id", F.col("total").alias("items"),
        (F.col("recognized") + F.col("needs_review") + F.col("unmatched")).alias("review"))
    out = p.join(i, "session_id", "full_outer").na.fill(0)
    return out.withColumn("ready_for_export", F.greatest(F.col("items") - F.col("review"), F.lit(0)))


def department_matrix(rows: DataFrame, statuses: list[str]) -> DataFrame:
    """A3: department x status with totals; unknown departments count as none."""
    department = F.when(F.col("department").isin("products", "chemistry"), F.col("department")).otherwise("none")
    return status_counts(rows.withColumn("department", department), "department", statuses)


def photo_counts(sessions: DataFrame, photos: DataFrame) -> DataFrame:
    """A4: photos per session, zero included."""
    n = photos.groupBy("session_id").agg(F.count("*").alias("photos"))
    return sessions.join(n, "session_id", "left").withColumn("photos", F.coalesce("photos", F.lit(0)))


def session_lifecycle(photos: DataFrame, jobs: DataFrame) -> DataFrame:
    """A5: failed jobs, all photos failed, any processed, ready for review."""
    s = F.col("status")
    p = photos.groupBy("session_id").agg(
        F.bool_and(s == "failed").alias("all_failed"), F.bool_or(s == "processed").alias("any_processed"),
        F.bool_and(~s.isin("uploaded", "queued", "processing")).alias("ready_for_review"))
    j = jobs.groupBy("session_id").agg(F.bool_or(s == "failed").alias("has_failed_jobs"))
    return p.join(j, "session_id", "left").withColumn(
        "has_failed_jobs", F.coalesce("has_failed_jobs", F.lit(False)))


def shelf_progress(shelf_items: DataFrame) -> DataFrame:
    """Matched and unmatched shelf rows per store and week."""
    matched = F.col("product_id").isNotNull()
    return shelf_items.groupBy("store_id", "week").agg(
        F.count_if(matched).alias("matched"), F.count_if(~matched).alias("unmatched"))


def build_items(recognized: DataFrame) -> DataFrame:
    """Item rows from recognised ones; a row without any text is dropped."""
    from shelflens.functions.text import first_text

    def clamp(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    name = first_text(F.col("raw_name"), F.col("price_tag_text"), F.col("product_visible_text"))
    return (recognized.withColumn("raw_name", name).where(F.col("raw_name").isNotNull())
            .withColumn("confidence", clamp(F.least("confidence", "link_confidence")))
            .withColumn("link_confidence", clamp(F.col("link_confidence")))
            .withColumn("currency", F.lit("RUB")).withColumn("status", F.lit("needs_review")))


def recent(rows: DataFrame, at: str, n: int, tie: str) -> DataFrame:
    """The newest ``n`` rows."""
    return rows.orderBy(F.col(at).desc(), F.col(tie).desc()).limit(n)
