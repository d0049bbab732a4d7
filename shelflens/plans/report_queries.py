"""Sessions, reports, sources, quality and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelflens.functions import fixed_values as fv
from shelflens.functions import report_text as rt
from shelflens.operators import evidence as ev, quality as ql, retail_sources as rs, sessions as ss
from shelflens.plans.domain import with_tables
from shelflens.plans.registry import query
from shelflens.sources.sinks import dedup_photos

ENRICHED = f"""{with_tables('items', 'matches', 'evidence', 'cat')}, proof AS (SELECT item_id, min(evidence_id) AS evidence_id, min(storage_path) AS evidence_path FROM evidence GROUP BY item_id),
enr AS (SELECT i.*, m.product_id, m.score AS match_score, m.decision AS match_decision, c.product_id IS NOT NULL AS has_product, c.external_sku AS product_sku, c.name AS product_name,
  c.brand AS product_brand, c.size_text AS product_size, c.own_price_minor, p.evidence_id, p.evidence_path, o.o_custkey AS customer_id FROM items i LEFT JOIN (SELECT * FROM matches WHERE is_active) m USING (item_id)
  LEFT JOIN cat c ON m.product_id = c.product_id LEFT JOIN proof p USING (item_id) LEFT JOIN orders o ON i.session_id = o.o_orderkey),
rows0 AS (SELECT *, coalesce(promo_price_minor, price_minor) AS competitor_minor FROM enr WHERE status IN ('matched', 'confirmed', 'unmatched', 'needs_review')),
rows1 AS (SELECT *, competitor_minor - own_price_minor AS diff_minor, CASE WHEN own_price_minor > 0 THEN CAST(competitor_minor - own_price_minor AS DOUBLE) / own_price_minor END AS diff_ratio FROM rows0)"""


def _enriched(t):
    d = t.domain
    return ss.enrich_items(d.session_items(), d.matches_of(d.lines), d.catalog, d.evidence_of(d.lines), d.sessions)


def _rows(t, detailed=False):
    return ss.report_rows(_enriched(t), detailed)


@query("j7_session_enrichment", f"{ENRICHED} SELECT item_id, product_sku, product_name, own_price_minor, match_score, match_decision, evidence_id, evidence_path, has_product, customer_id FROM enr")
def j7_session_enrichment(t):
    return _enriched(t).select("item_id", "product_sku", "product_name", "own_price_minor", "match_score", "match_decision",
                               "evidence_id", "evidence_path", "has_product", "customer_id")


LARGE = "coalesce(abs(diff_ratio) >= 0.05::DOUBLE, false)"


@query("n18_attention", f"""{ENRICHED} SELECT item_id, status IN ('unmatched', 'needs_review') OR NOT has_product OR {LARGE} AS plain,
  status IN ('unmatched', 'needs_review') OR NOT has_product OR {LARGE} OR (has_product AND own_price_minor IS NULL) AS detailed FROM rows1""")
def n18_attention(t):
    return _rows(t).select("item_id", F.col("needs_attention").alias("plain"), rt.needs_attention(
        F.col("status"), F.col("has_product"), F.col("diff_ratio"), F.col("own_price_minor")).alias("detailed"))


def _comment_sql(extra: str) -> str:
    return f"""CASE WHEN status = 'unmatched' THEN '{fv.COMMENT_NOT_FOUND}' WHEN NOT has_product THEN coalesce(review_reason, '{fv.COMMENT_NO_PRODUCT}') {extra}
  WHEN status = 'needs_review' THEN coalesce(review_reason, '{fv.COMMENT_REVIEW}') WHEN diff_ratio <= -0.05::DOUBLE THEN '{fv.COMMENT_CHEAPER}'
  WHEN diff_ratio >= 0.05::DOUBLE THEN '{fv.COMMENT_DEARER}' ELSE '' END"""


@query("n19_comment", f"""{ENRICHED} SELECT item_id, {_comment_sql('')} AS plain, {_comment_sql(f"WHEN own_price_minor IS NULL THEN '{fv.COMMENT_NO_OWN_PRICE}'")} AS detailed FROM rows1""")
def n19_comment(t):
    c = F.col
    return _rows(t).select("item_id", c("comment").alias("plain"), rt.comment(
        c("status"), c("has_product"), c("diff_ratio"), c("review_reason"), c("own_price_minor")).alias("detailed"))


@query("n20_formats", f"""{ENRICHED} SELECT item_id, competitor_minor / 100.0::DOUBLE AS price, CASE WHEN tenths IS NULL THEN '' WHEN tenths % 10 = 0 THEN CAST(tenths // 10 AS VARCHAR) || '%'
  ELSE CASE WHEN tenths < 0 THEN '-' ELSE '' END || CAST(abs(tenths) // 10 AS VARCHAR) || '.' || CAST(abs(tenths) % 10 AS VARCHAR) || '%' END AS diff_text,
  CASE department WHEN 'products' THEN 'Продукты' WHEN 'chemistry' THEN 'Химия' ELSE 'Без отдела' END AS department_label
  FROM (SELECT *, CAST(floor(diff_ratio * 1000 + 0.5) AS BIGINT) AS tenths FROM rows1)""")
def n20_formats(t):
    return _rows(t).select("item_id", rt.money_value(F.col("competitor_minor")).alias("price"),
                           F.col("diff_pct_text").alias("diff_text"), "department_label")


A6 = f"""count(*) AS rows, count(*) FILTER (WHERE status IN ('matched', 'confirmed')) AS matched, count(*) FILTER (WHERE status = 'unmatched') AS unmatched,
  count(*) FILTER (WHERE status = 'needs_review') AS needs_review, count(*) FILTER (WHERE status = 'needs_review' AND match_score IS NOT NULL) AS needs_review_with_candidate,
  count(*) FILTER (WHERE status = 'needs_review' AND match_score IS NULL) AS needs_review_without_candidate, count(*) FILTER (WHERE {LARGE}) AS large_price_diff,
  count(*) FILTER (WHERE evidence_id IS NOT NULL) AS with_evidence, count(*) FILTER (WHERE evidence_id IS NULL) AS without_evidence"""


@query("a6_session_summary", f"{ENRICHED} SELECT session_id, {A6} FROM rows1 GROUP BY session_id")
def a6_session_summary(t):
    return ss.session_summary(_rows(t), ["session_id"])


COMPARABLE = "product_name IS NOT NULL AND own_price_minor IS NOT NULL AND competitor_minor IS NOT NULL"


@query("a7_detailed_summary", f"""{ENRICHED} SELECT customer_id, count(*) AS rows, count(*) FILTER (WHERE department = 'products') AS products, count(*) FILTER (WHERE department = 'chemistry') AS chemistry,
  count(*) FILTER (WHERE status IN ('matched', 'confirmed')) AS matched, count(*) FILTER (WHERE status = 'unmatched') AS unmatched, count(*) FILTER (WHERE status = 'needs_review') AS needs_review,
  count(*) FILTER (WHERE status = 'needs_review' AND product_name IS NOT NULL) AS needs_review_with_candidate, count(*) FILTER (WHERE status = 'needs_review' AND product_name IS NULL) AS needs_review_without_candidate,
  count(*) FILTER (WHERE match_decision = 'ai_review') AS ai_candidates, count(*) FILTER (WHERE {COMPARABLE}) AS comparable_prices, count(*) FILTER (WHERE {COMPARABLE} AND diff_minor < 0) AS competitor_cheaper,
  count(*) FILTER (WHERE {COMPARABLE} AND diff_minor > 0) AS own_cheaper, count(*) FILTER (WHERE abs(floor(diff_ratio * 1000 + 0.5)) >= 50) AS large_price_diff,
  count(*) FILTER (WHERE product_name IS NOT NULL AND own_price_minor IS NULL) AS missing_own_price FROM rows1 GROUP BY customer_id""")
def a7_detailed_summary(t):
    return ss.detailed_summary(_rows(t, True), ["customer_id"])


@query("a8_json_summary", f"""{with_tables('items')} SELECT session_id, count(*) AS total, count(*) FILTER (WHERE status IN ('matched', 'confirmed')) AS matched,
  count(*) FILTER (WHERE status = 'needs_review') AS needs_review, count(*) FILTER (WHERE status = 'unmatched') AS unmatched FROM items WHERE status <> 'recognized' GROUP BY session_id""")
def a8_json_summary(t):
    return ss.json_summary(ss.exportable(t.domain.session_items()), ["session_id"])


ATTENTION = f"(status IN ('unmatched', 'needs_review') OR NOT has_product OR {LARGE} OR (has_product AND own_price_minor IS NULL))"


@query("u2_report_sets", f"""{ENRICHED} SELECT report_set, count(*) AS rows, CAST(sum(competitor_minor) AS BIGINT) AS total_minor FROM (SELECT *, unnest(list_filter(['all', CASE WHEN {COMPARABLE} THEN 'comparison' END,
  CASE WHEN {COMPARABLE} AND diff_minor < 0 THEN 'competitor_cheaper' END, CASE WHEN {COMPARABLE} AND diff_minor > 0 THEN 'own_cheaper' END, CASE WHEN {ATTENTION} THEN 'review' END,
  CASE WHEN match_decision = 'ai_review' THEN 'ai_candidates' END, CASE WHEN status = 'needs_review' AND product_name IS NULL THEN 'without_candidate' END,
  CASE WHEN product_name IS NOT NULL AND own_price_minor IS NULL THEN 'missing_own_price' END, CASE WHEN status = 'unmatched' THEN 'not_found' END,
  CASE WHEN department = 'products' THEN 'products' END, CASE WHEN department = 'chemistry' THEN 'chemistry' END], lambda s: s IS NOT NULL)) AS report_set FROM rows1) GROUP BY report_set""")
def u2_report_sets(t):
    return ss.report_sets(_rows(t, True)).groupBy("report_set").agg(
        F.count("*").alias("rows"), F.sum("competitor_minor").alias("total_minor"))


@query("s16_report_json", f"""{ENRICHED} SELECT item_id, status, product_sku AS sku, coalesce(product_size, size_text) AS size, CAST(competitor_minor AS VARCHAR) AS competitor,
  CASE WHEN status = 'needs_review' THEN 'true' ELSE 'false' END AS review, evidence_path AS crop FROM rows1""")
def s16_report_json(t):
    docs = ss.session_report_json(_rows(t))
    paths = {"status": "$.status", "sku": "$.product.sku", "size": "$.product.size", "competitor": "$.prices.competitor_minor",
             "review": "$.review.required", "crop": "$.evidence.price_tag_crop_path"}
    return docs.select("item_id", *[F.get_json_object("document", p).alias(n) for n, p in paths.items()])


@query("a2_session_progress", f"""{with_tables('photos', 'items')}, p AS (SELECT session_id, count(*) AS photos, count(*) FILTER (WHERE status = 'processed') AS processed,
  count(*) FILTER (WHERE status IN ('uploaded', 'failed', 'queued')) AS waiting, count(*) FILTER (WHERE status IN ('uploaded', 'failed')) AS queueable FROM photos GROUP BY session_id),
i AS (SELECT o_custkey AS session_id, count(*) AS items, count(*) FILTER (WHERE status IN ('recognized', 'needs_review', 'unmatched')) AS review FROM items JOIN orders ON session_id = o_orderkey GROUP BY o_custkey)
SELECT session_id, coalesce(photos, 0) AS photos, coalesce(processed, 0) AS processed, coalesce(waiting, 0) AS waiting, coalesce(queueable, 0) AS queueable, coalesce(items, 0) AS items,
  coalesce(review, 0) AS review, greatest(coalesce(items, 0) - coalesce(review, 0), 0) AS ready_for_export FROM p FULL JOIN i USING (session_id)""")
def a2_session_progress(t):
    items = t.domain.session_items().join(t.domain.sessions, "session_id").select(F.col("customer_id").alias("session_id"), "status")
    return ss.session_progress(t.domain.photos, items)


def _counts(statuses) -> str:
    return ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in statuses)


@query("a3_department_matrix", f"""{with_tables('items')} SELECT coalesce(department, 'none') AS department, count(*) AS total, {_counts(ss.ITEM_STATUSES)} FROM items GROUP BY 1""")
def a3_department_matrix(t):
    return ss.department_matrix(t.domain.session_items(), ss.ITEM_STATUSES)


@query("a4_photo_counts", "SELECT c_custkey AS session_id, coalesce(n, 0) AS photos FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def a4_photo_counts(t):
    return ss.photo_counts(t.customer.select(F.col("c_custkey").alias("session_id")), t.domain.photos)


@query("a5_session_lifecycle", f"""{with_tables('photos')} SELECT session_id, bool_and(status = 'failed') AS all_failed, bool_or(status = 'processed') AS any_processed,
  bool_and(status NOT IN ('uploaded', 'queued', 'processing')) AS ready_for_review, bool_or(status = 'failed' AND photo_id % 2 = 0) AS has_failed_jobs FROM photos GROUP BY session_id""")
def a5_session_lifecycle(t):
    jobs = t.domain.photos.select("session_id", F.when(F.col("photo_id") % 2 == 0, F.col("status")).otherwise("done").alias("status"))
    return ss.session_lifecycle(t.domain.photos, jobs)


@query("a18_shelf_progress", f"{with_tables('obs')} SELECT store_id, CAST(week AS INTEGER) AS week, count(*) FILTER (WHERE product_id % 4 <> 0) AS matched, count(*) FILTER (WHERE product_id % 4 = 0) AS unmatched FROM obs GROUP BY 1, 2")
def a18_shelf_progress(t):
    rows = t.domain.observations.withColumn("product_id", F.when(F.col("product_id") % 4 != 0, F.col("product_id")))
    return ss.shelf_progress(rows)


@query("n24_item_rows", """SELECT doc_id, trim(coalesce(CASE WHEN doc_id % 3 = 0 THEN lang END, CASE WHEN doc_id % 3 = 1 THEN source END)) AS raw_name, greatest(0, least(1, least(n_chars / 1000.0::DOUBLE, 0.9::DOUBLE))) AS confidence, 'needs_review' AS status
  FROM documents WHERE doc_id % 3 < 2""")
def n24_item_rows(t):
    c = F.col
    rows = t.documents.select(
        "doc_id", F.when(c("doc_id") % 3 == 0, F.concat(F.lit(" "), c("lang"))).alias("raw_name"),
        F.when(c("doc_id") % 3 == 1, c("source")).alias("price_tag_text"), F.lit("  ").alias("product_visible_text"),
        (c("n_chars") / 1000.0).alias("confidence"), F.lit(0.9).alias("link_confidence"))
    return ss.build_items(rows).select("doc_id", "raw_name", "confidence", "status")


@query("f1_catalog_search", f"""{with_tables('cat')} SELECT product_id, name FROM cat WHERE (contains(lower(name), 'ring') OR contains(lower(external_sku), 'ring') OR contains(lower(coalesce(brand, '')), 'ring')
  OR contains(lower(coalesce(size_text, '')), 'ring')) AND own_price_minor IS NOT NULL ORDER BY created_day DESC, product_id LIMIT 20 OFFSET 20""")
def f1_catalog_search(t):
    catalog = t.domain.catalog.withColumn("created_at", F.col("created_day"))
    return rs.search_catalog(catalog, " Ring ", "present", 2, 20)[0].select("product_id", "name")


@query("f1_catalog_search_total", f"{with_tables('cat')} SELECT count(*) AS total_count FROM cat WHERE contains(lower(name), 'ring') AND own_price_minor IS NULL")
def f1_catalog_search_total(t):
    return rs.search_catalog(t.domain.catalog.withColumn("created_at", F.col("created_day")), "ring", "missing")[1]


@query("f2_auto_match_ready", f"{with_tables('items')} SELECT item_id FROM items WHERE confidence >= 0.8::DOUBLE AND link_confidence >= 0.8::DOUBLE AND line % 2 = 0")
def f2_auto_match_ready(t):
    rows = t.domain.items.withColumn("bbox", F.when(F.col("_line") % 2 == 0, F.struct(F.lit(0.1).alias("x"))))
    return ss.auto_match_ready(rows).select("item_id")


@query("f3_exportable", f"{with_tables('items')} SELECT status, count(*) AS items FROM items WHERE status <> 'recognized' GROUP BY status")
def f3_exportable(t):
    return ss.exportable(t.domain.session_items()).groupBy("status").agg(F.count("*").alias("items"))


@query("f4_tenant_rows", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def f4_tenant_rows(t):
    members = t.customer.select(F.col("c_custkey").alias("company_id"), F.col("c_nationkey").alias("user_id"))
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("company_id"))
    return ss.tenant_rows(rows, members, F.lit(3)).select("o_orderkey")


@query("f6_expire", f"{with_tables('photos')} SELECT photo_id, CASE WHEN created_at + INTERVAL 90 DAY <= TIMESTAMP '1998-01-01' THEN 'expired' ELSE status END AS status FROM photos")
def f6_expire(t):
    rows = t.domain.photos.withColumn("expires_at", F.col("created_at") + F.expr("interval 90 days"))
    return ss.expire(rows, F.lit("1998-01-01").cast("timestamp")).select("photo_id", "status")


@query("f7_eligible_sources", "SELECT n_nationkey AS source_id, s_suppkey AS store_id FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey % 4 <> 0 AND n_nationkey % 3 = 0 AND s_suppkey % 2 = 0")
def f7_eligible_sources(t):
    c = F.col
    sources = t.nation.select(c("n_nationkey").alias("source_id"), (c("n_nationkey") % 4 != 0).alias("enabled"),
                              F.when(c("n_nationkey") % 3 == 0, "allowed").otherwise("pending").alias("legal_status"))
    links = t.supplier.select(c("s_nationkey").alias("source_id"), c("s_suppkey").alias("store_id"), (c("s_suppkey") % 2 == 0).alias("link_enabled"))
    return rs.eligible_sources(sources, links).select("source_id", "store_id")


@query("j8_source_overview", f"""{with_tables('runs', 'stores')}, last AS (SELECT source_id, strftime(max(started_at), '%Y-%m-%d %H:%M:%S') AS last_run_at, arg_max(status, started_at) AS last_run_status FROM runs GROUP BY 1)
SELECT c_custkey AS source_id, last_run_at, last_run_status, names FROM customer LEFT JOIN last ON c_custkey = source_id LEFT JOIN (SELECT store_id % 50 AS sid, string_agg(name, '|' ORDER BY store_id) AS names FROM stores WHERE store_id % 3 > 0 GROUP BY 1) ON c_custkey = sid""")
def j8_source_overview(t):
    links = t.domain.stores.select((F.col("store_id") % 50).alias("source_id"), "store_id", (F.col("store_id") % 3 > 0).alias("link_enabled"))
    rows = rs.source_overview(t.customer.select(F.col("c_custkey").alias("source_id")), t.domain.runs, links, t.domain.stores)
    return rows.select("source_id", F.date_format("last_run_at", "yyyy-MM-dd HH:mm:ss").alias("last_run_at"), "last_run_status",
                       F.array_join(F.transform("stores", lambda s: s["name"]), "|").alias("names"))


@query("j12_source_detection", f"""{with_tables('stores')}, named AS (SELECT name, 'high' AS confidence, 0 AS o FROM stores WHERE NOT is_own AND competitor_id IS NOT NULL UNION ALL SELECT c_name || ' x5', 'medium', 1 FROM customer),
n AS (SELECT *, replace(regexp_replace(lower(name), '[^а-яa-z0-9]', '', 'g'), 'пятерочка', 'пятёрочка') AS k FROM named),
hits AS (SELECT *, 'spar_online' AS source_key FROM n WHERE contains(k, 'спар') OR contains(k, 'spar') UNION ALL SELECT *, 'metro_online' FROM n WHERE contains(k, 'метро') OR contains(k, 'metro')
  UNION ALL SELECT *, 'magnit' FROM n WHERE contains(k, 'магнит') OR contains(k, 'magnit') UNION ALL SELECT *, 'x5_5ka' FROM n WHERE contains(k, 'пятрочка') OR contains(k, 'пятёрочка') OR contains(k, '5ка') OR contains(k, '5ka') OR contains(k, 'x5'))
SELECT source_key, confidence, name AS found_in FROM hits QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY o, name) = 1""")
def j12_source_detection(t):
    competitors = t.customer.select(F.concat(F.col("c_name"), F.lit(" x5")).alias("name"))
    return rs.detect_sources(t.domain.stores, competitors)


@query("j14_department", f"""{with_tables('items', 'photos')} SELECT item_id, coalesce(i.department, p.department) AS department FROM (SELECT item_id, department, session_id FROM items) i LEFT JOIN photos p ON i.session_id = p.photo_id""")
def j14_department(t):
    rows = t.domain.session_items().withColumn("photo_id", F.col("session_id"))
    return ss.inherit_department(rows, t.domain.photos).select("item_id", "department")


EVID = """drafts AS (SELECT doc_id AS item_id, CASE WHEN doc_id % 4 = 0 THEN 'Unknown' ELSE lang END AS raw_name, CASE WHEN doc_id % 5 = 0 THEN source END AS tag, n_chars FROM documents),
names AS (SELECT doc_id, quality FROM labels)"""


def _evidence(t):
    c = F.col
    none = F.lit(None)
    drafts = t.documents.select(
        c("doc_id").alias("item_id"), F.when(c("doc_id") % 4 == 0, "Unknown").otherwise(c("lang")).alias("raw_name"),
        none.cast("string").alias("ocr_text"), none.cast("double").alias("ocr_confidence"),
        F.when(c("doc_id") % 5 == 0, c("source")).alias("price_tag_text"), c("n_chars").alias("price_minor"),
        none.cast("bigint").alias("old_price_minor"), none.cast("bigint").alias("promo_price_minor"), F.lit("RUB").alias("currency"),
        none.cast("double").alias("parsed_price_confidence"), none.cast("string").alias("normalized_product_text"))
    some = lambda n: F.when(c("doc_id") % n == 0, c("doc_id")).otherwise(-1 - c("doc_id")).alias("item_id")  # noqa: E731 - below 0: drafts nobody has
    ocr = t.documents.select(some(3), F.concat(F.lit(" "), c("source"), F.lit(" ")).alias("text"),
                                                     F.lit(1.5).alias("confidence"), F.lit(1).alias("result_no"))
    prices = t.documents.select(
        some(2), F.when(c("doc_id") % 8 != 0, c("n_chars") * 2).alias("price_minor"), (c("n_chars") * 3).alias("old_price_minor"),
        none.cast("bigint").alias("promo_price_minor"), F.lit("usd").alias("currency"), F.lit(0.5).alias("confidence"), F.lit(1).alias("result_no"))
    names = t.labels.select(c("doc_id").alias("item_id"), F.when(c("quality") == 1, "good").alias("raw_name"), F.lit("tag").alias("price_tag_text"),
                            F.when(c("quality") == 1, "good").alias("normalized"), F.lit(1).alias("result_no"))
    return ev.assemble_evidence(drafts, ocr, prices, names)


J10 = f"""WITH {EVID}, joined AS (SELECT item_id, coalesce(CASE WHEN quality = 1 THEN 'good' END, CASE WHEN item_id % 3 = 0 AND lower(raw_name) = 'unknown' THEN (SELECT source FROM documents WHERE doc_id = item_id) ELSE raw_name END) AS raw_name,
  coalesce(tag, CASE WHEN item_id % 3 = 0 THEN (SELECT source FROM documents WHERE doc_id = item_id) END, CASE WHEN quality IS NOT NULL THEN 'tag' END) AS price_tag_text,
  CASE WHEN item_id % 8 = 0 THEN NULL WHEN item_id % 2 = 0 THEN n_chars * 2 ELSE n_chars END AS price_minor, CASE WHEN item_id % 2 = 0 THEN n_chars * 3 END AS old_price_minor,
  CASE WHEN item_id % 2 = 0 THEN 'USD' ELSE 'RUB' END AS currency, CASE WHEN item_id % 3 = 0 THEN 1.0::DOUBLE END AS ocr_confidence, quality FROM drafts LEFT JOIN names ON item_id = doc_id)"""


@query("j10_evidence", f"{J10} SELECT item_id, raw_name, price_tag_text, price_minor, old_price_minor, currency, ocr_confidence FROM joined")
def j10_evidence(t):
    return _evidence(t).select("item_id", "raw_name", "price_tag_text", "price_minor", "old_price_minor", "currency", "ocr_confidence")


@query("j10_evidence_metrics", f"""{J10} SELECT count(*) AS drafts, count(*) FILTER (WHERE item_id % 3 = 0) AS ocr_merged, count(*) FILTER (WHERE item_id % 2 = 0) AS price_merged, count(quality) AS name_merged,
  count(price_minor) AS priced, count(old_price_minor) AS old_priced, CAST(0 AS BIGINT) AS promo_priced, count(*) FILTER (WHERE lower(raw_name) <> 'unknown') AS named, count(*) FILTER (WHERE quality = 1) AS normalized FROM joined""")
def j10_evidence_metrics(t):
    return ev.assembly_metrics(_evidence(t))


@query("a11_golden_accuracy", """SELECT count(*) AS total_samples, count(*) FILTER (WHERE quality = 1) AS correct_matches, floor(count(*) FILTER (WHERE quality = 1) / CAST(count(*) AS DOUBLE) * 10000 + 0.5) / 10000 AS accuracy,
  floor(CAST(sum(n_chars % 100) AS DOUBLE) / count(*) * 10000 + 0.5) / 10000 AS avg_confidence FROM labels JOIN documents USING (doc_id) WHERE toxic = 0""")
def a11_golden_accuracy(t):
    return ql.golden_accuracy(_samples(t))


def _samples(t):
    c = F.col
    return t.labels.join(t.documents, "doc_id").select(
        c("doc_id").alias("sample_id"), (c("quality") == 1).alias("is_correct_match"), (c("n_chars") % 100).alias("match_score"),
        F.when(c("toxic") == 0, "verified").otherwise("pending").alias("verification_status"), c("n_chars").alias("created_at"))


@query("a12_pending_samples", "SELECT doc_id AS sample_id, n_chars % 100 AS match_score FROM labels JOIN documents USING (doc_id) WHERE toxic <> 0 ORDER BY n_chars, doc_id LIMIT 10")
def a12_pending_samples(t):
    return ql.pending_samples(_samples(t)).select("sample_id", "match_score")


FUN = """f AS (SELECT CAST(o_orderkey AS VARCHAR) AS photo, o_orderkey AS k, o_custkey % 6 AS detected, o_custkey % 5 AS draft, o_orderkey % 4 AS ocr_text, o_orderkey % 3 AS priced, o_custkey % 3 AS named,
  o_orderkey % 2 AS matched, o_custkey % 2 AS needs_review, o_custkey % 4 AS write_plan FROM orders)"""


def _photo_counters(t):
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    item = F.struct(F.concat(F.lit("i"), k.cast("string")).alias("item_id"), (k % 10 / F.lit(10.0)).alias("confidence"),
                    (k % 7 == 0).alias("review"), F.when(k % 2 == 0, "size").alias("reason"))
    return t.orders.select(
        k.cast("string").alias("photo"), (u % 6).alias("detected"), (u % 5).alias("draft"), (k % 4).alias("ocr_text"), (k % 3).alias("priced"),
        (u % 3).alias("named"), (k % 2).alias("matched"), (u % 2).alias("needs_review"), (u % 4).alias("write_plan"), F.array(item).alias("match_items"))


@query("a14_pipeline_funnel", f"WITH {FUN} SELECT count(*) AS photos, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ql.FUNNEL) + " FROM f")
def a14_pipeline_funnel(t):
    return ql.pipeline_funnel(_photo_counters(t))


@query("a14_draft_funnel", f"""{J10} SELECT count(*) AS draft, count(*) FILTER (WHERE item_id % 3 = 0) AS ocr_text, count(*) FILTER (WHERE item_id % 2 = 0) AS parsed, count(price_minor) AS priced,
  count(old_price_minor) AS old_priced, CAST(0 AS BIGINT) AS promo_priced, count(*) FILTER (WHERE lower(raw_name) <> 'unknown') AS named, count(*) FILTER (WHERE lower(raw_name) = 'unknown') AS unnamed FROM joined""")
def a14_draft_funnel(t):
    return ql.draft_funnel(_evidence(t))


R12 = f"""WITH {FUN}, fails AS (SELECT photo, 'detector_no_detections' AS kind, 'blocking' AS severity, CAST(NULL AS VARCHAR) AS item_id, 0.0::DOUBLE AS value FROM f WHERE detected = 0
  UNION ALL SELECT photo, 'detector_low_count', 'warning', NULL, detected FROM f WHERE detected > 0 AND detected < 2 UNION ALL SELECT photo, 'ocr_empty', 'blocking', NULL, 0 FROM f WHERE draft > 0 AND ocr_text = 0
  UNION ALL SELECT photo, 'price_not_parsed', 'warning', NULL, 0 FROM f WHERE ocr_text > 0 AND priced = 0 UNION ALL SELECT photo, 'product_text_missing', 'warning', NULL, 0 FROM f WHERE ocr_text > 0 AND named = 0
  UNION ALL SELECT photo, 'match_missing', 'warning', NULL, 0 FROM f WHERE named > 0 AND matched = 0 UNION ALL SELECT photo, 'match_needs_review', 'info', 'i' || photo, 1 FROM f WHERE k % 7 = 0
  UNION ALL SELECT photo, 'match_low_confidence', 'warning', 'i' || photo, (k % 10) / 10.0::DOUBLE FROM f WHERE (k % 10) / 10.0::DOUBLE < 0.7::DOUBLE UNION ALL SELECT photo, 'write_plan_empty', 'blocking', NULL, 0 FROM f WHERE detected > 0 AND write_plan = 0)"""


@query("r12_photo_failures", f"{R12} SELECT photo, kind, severity, item_id, value FROM fails")
def r12_photo_failures(t):
    return ql.photo_failures(_photo_counters(t), 2).select("photo", "kind", "severity", "item_id", "value")


@query("r12_failure_counts", f"{R12} SELECT severity, count(*) AS failures FROM fails GROUP BY severity")
def r12_failure_counts(t):
    return ql.failure_counts(ql.photo_failures(_photo_counters(t), 2))


@query("r12_next_actions", f"""{R12} SELECT step, CAST(count(DISTINCT kind) > 0 AS BOOLEAN) AS needed FROM (SELECT DISTINCT kind FROM fails) JOIN (VALUES ('detector_no_detections', 1), ('detector_low_count', 1), ('ocr_empty', 2), ('price_not_parsed', 3),
  ('product_text_missing', 4), ('match_missing', 5), ('match_low_confidence', 5), ('match_needs_review', 5), ('write_plan_empty', 6)) v(k, step) ON kind = k GROUP BY step""")
def r12_next_actions(t):
    return ql.next_actions(ql.photo_failures(_photo_counters(t), 2)).select("step", F.col("action").isNotNull().alias("needed"))


@query("q1_constraints", f"""{with_tables('obs', 'items')} SELECT 'prices' AS table_name, 'domain' AS rule, 'availability' AS column_name, CAST(0 AS BIGINT) AS violations
  UNION ALL SELECT 'prices', 'domain', 'week', count(*) FILTER (WHERE week NOT IN (1, 2)) FROM obs UNION ALL SELECT 'items', 'domain', 'status', CAST(0 AS BIGINT)
  UNION ALL SELECT 'prices', 'non_negative', 'price_minor', count(*) FILTER (WHERE price_minor < 0) FROM obs UNION ALL SELECT 'items', 'required', 'department', count(*) FILTER (WHERE department IS NULL) FROM items
  UNION ALL SELECT 'items', 'required', 'item_id', CAST(0 AS BIGINT) UNION ALL SELECT 'prices', 'unique', 'obs_id', count(*) FROM (SELECT obs_id FROM obs GROUP BY obs_id HAVING count(*) > 1)
  UNION ALL SELECT 'items', 'unique', 'item_id', count(*) FROM (SELECT item_id FROM items GROUP BY item_id HAVING count(*) > 1)""")
def q1_constraints(t):
    prices, items = t.domain.observations, t.domain.session_items()
    return ql.constraint_report(
        ql.domain_violations(prices, "prices", {"availability": "availability", "week": "week"}),
        ql.domain_violations(items, "items", {"status": "item_status"}), ql.negative_values(prices, "prices", ["price_minor"]),
        ql.missing_required(items, "items", ["department", "item_id"]), ql.duplicate_keys(prices, "prices", ["obs_id"]),
        ql.duplicate_keys(items, "items", ["item_id"]))


@query("q2_completeness", f"""{ENRICHED} SELECT count(*) AS rows, count(*) FILTER (WHERE has_product AND own_price_minor IS NULL) AS missing_own_price, count(*) FILTER (WHERE NOT has_product) AS missing_product,
  count(*) FILTER (WHERE evidence_id IS NULL) AS missing_evidence, floor(count(evidence_id) / CAST(count(*) AS DOUBLE) * 10000 + 0.5) / 10000 AS evidence_coverage,
  floor(count(*) FILTER (WHERE status IN ('matched', 'confirmed') AND match_decision = 'auto') / CAST(count(*) AS DOUBLE) * 10000 + 0.5) / 10000 AS automation_rate,
  floor(count(*) FILTER (WHERE status = 'needs_review') / CAST(count(*) AS DOUBLE) * 10000 + 0.5) / 10000 AS review_rate FROM rows1""")
def q2_completeness(t):
    return ql.completeness(_rows(t))


@query("s18_photo_dedup", "SELECT conv_id AS session_id, sha256(text) AS sha256, min(turn) AS turn FROM conversations GROUP BY 1, 2")
def s18_photo_dedup(t):
    photos = t.conversations.select(F.col("conv_id").alias("session_id"), F.sha2("text", 256).alias("sha256"), "turn")
    return dedup_photos(photos)
