"""Logical tables as Spark schemas, for readers and streams. Money is whole minor units; keys are strings or longs."""

from __future__ import annotations

BOX = "struct<x:double,y:double,width:double,height:double>"
RUN_STATS = ("struct<fetched:bigint,products_upserted:bigint,prices_inserted:bigint,matched:bigint,unmatched:bigint,"
             "errors:bigint>")

TABLES = {
    "catalog_products": "company_id string, product_id string, external_sku string, barcode string, name string, brand string, "
                        "size_text string, own_price_minor bigint, currency string, department string, category string, "
                        "is_active boolean, created_at timestamp",
    "stores": "company_id string, store_id string, competitor_id string, name string, address string, is_own boolean",
    "catalog_imports": "import_id string, filename string, status string, row_count bigint, error_count bigint, created_at timestamp",
    "catalog_import_rows": "import_id string, row_number bigint, raw_data string, error string, product_id string",
    "monitoring_sessions": "company_id string, session_id string, store_id string, status string, created_at timestamp",
    "monitoring_photos": "session_id string, photo_id string, sha256 string, storage_path string, department string, "
                         "status string, expires_at timestamp",
    "recognized_items": f"item_id string, session_id string, photo_id string, raw_name string, brand string, size_text string, "
                        f"price_minor bigint, old_price_minor bigint, promo_price_minor bigint, currency string, "
                        f"confidence double, link_confidence double, bbox {BOX}, price_tag_text string, "
                        f"product_visible_text string, review_reason string, position_hint string, department string, "
                        f"status string, created_at timestamp",
    "matches": "match_id string, item_id string, product_id string, score double, decision string, is_active boolean, decided_at timestamp",
    "aliases": "company_id string, normalized_key string, product_id string, confirmations bigint, last_confirmed_at timestamp",
    "evidence": f"evidence_id string, item_id string, photo_id string, storage_path string, bbox {BOX}, expires_at timestamp",
    "shelf_items": "obs_id string, week smallint, store_id string, product_id string, raw_name string, price_minor bigint, "
                   "match_confidence double, captured_date date, created_at timestamp",
    "capture_runs": "run_id string, store_id string, week smallint, status string, detected int, draft int, ocr_text int, "
                    "priced int, named int, matched int, needs_review int, write_plan int, ai_cost_microusd bigint",
    "online_sources": "source_id string, source_key string, display_name string, enabled boolean, legal_status string",
    "online_source_stores": "source_id string, store_id string, price_context string, link_enabled boolean",
    "online_source_runs": f"run_id string, source_id string, trigger string, status string, started_at timestamp, "
                          f"completed_at timestamp, stats {RUN_STATS}",
    "online_source_products": "company_id string, source_id string, source_product_id string, title string, brand string, "
                              "size_text string, barcode string, url string, first_seen_at timestamp, last_seen_at timestamp",
    "online_product_matches": "match_id string, source_product_id string, product_id string, confidence double, method string, "
                              "status string, reason string, matched_at timestamp",
    "online_prices": "obs_id string, run_id string, source_id string, store_id string, source_product_id string, "
                     "product_id string, price_minor bigint, old_price_minor bigint, promo_price_minor bigint, "
                     "availability string, observed_at timestamp, payload_hash string",
    "alert_rules": "rule_id string, source_id string, alert_type string, threshold decimal(8,2), enabled boolean",
    "alerts": "alert_id string, alert_type string, rule_id string, source_id string, run_id string, product_id string, "
              "store_id string, severity string, value double, threshold double, status string, triggered_at timestamp, "
              "acknowledged_at timestamp, resolved_at timestamp",
    "export_snapshots": "snapshot_id string, created_at timestamp, product_id string, store_prices map<string,bigint>",
    "golden_samples": "sample_id string, item_id string, is_correct_match boolean, match_score double, "
                      "verification_status string, created_at timestamp",
    "jobs": "job_id string, session_id string, model string, operation string, input_tokens bigint, output_tokens bigint, "
            "duration_ms bigint, is_error boolean, used_fallback boolean, status string, updated_at timestamp",
    "template_cells": "template_id string, sheet string, row int, col int, text string",
    "template_merges": "template_id string, sheet string, row int, col_start int, col_end int",
    "pages": "page_id string, source_key string, price_context string, observed_at timestamp, html string",
}
