"""Catalogue import, pages and payloads, recognition, shelf text, templates and snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelflens.operators import price_history as ph, shelf_text as st, template as tp
from shelflens.plans.domain import with_tables
from shelflens.plans.registry import query
from shelflens.session import job_folder
from shelflens.sources import catalog as cs, pages as pg, recognition as rc

RAW = """raw AS (SELECT p_partkey + 2 AS row_number, CASE WHEN p_partkey % 13 = 0 THEN '  ' ELSE 'S' || (p_partkey % 500) END AS sku, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS name,
  p_brand AS brand, p_size AS size, floor(p_retailprice) AS price FROM part),
imp AS (SELECT row_number, nullif(trim(sku), '') AS external_sku, name, brand, size || ' г' AS size_text, CAST(price * 100 + 50 AS BIGINT) AS own_price_minor,
  CASE WHEN trim(sku) = '' THEN 'external_sku обязателен' WHEN name IS NULL THEN 'name обязателен' END AS error FROM raw)"""


def _import(t):
    c = F.col
    raw = t.part.select(
        (c("p_partkey") + 2).alias("row_number"),
        F.when(c("p_partkey") % 13 == 0, "  ").otherwise(F.concat(F.lit("S"), (c("p_partkey") % 500).cast("string"))).alias(" Артикул"),
        F.when(c("p_partkey") % 2 == 0, F.when(c("p_partkey") % 7 != 0, c("p_name"))).alias("NAME"),
        F.when(c("p_partkey") % 2 == 1, F.when(c("p_partkey") % 7 != 0, F.concat(c("p_name"), F.lit(" ")))).alias("Название"),
        c("p_brand").alias("Бренд"), F.concat(c("p_size").cast("string"), F.lit(" г")).alias("Размер"),
        F.concat(F.lit("1 "), F.lpad((F.floor("p_retailprice") - 1000 + 1000).cast("string"), 3, "0"), F.lit(",5")).alias("_unused"),
        F.concat(F.floor("p_retailprice").cast("string"), F.lit(",5")).alias("Цена_руб")).drop("_unused")
    return cs.normalize_catalog(raw)


@query("s1_catalog_import", f"WITH {RAW} SELECT row_number, external_sku, name, brand, size_text, own_price_minor FROM imp")
def s1_catalog_import(t):
    return _import(t)


# Catalogue files of four shops, each with headers, a delimiter and line ends of its own; every fifth name has two lines and quotes.
SHOP_FILES = [(";", ["Артикул", "Название", "Бренд", "Размер", "Цена_руб"], "\n"), (",", ["SKU", "Name", "Brand", "Size", "Price"], "\r\n"),
              ("\t", ["external_sku", "наименование", "brand", "size_text", "price_rub"], "\n"), ("|", ["sku", "NAME", "бренд", "size", "Цена"], "\r\n")]
FILE_ROWS = 50_000

FILES_SQL = """f AS (SELECT p_partkey % 4 AS shop, p_partkey // 50000 AS chunk, row_number() OVER (PARTITION BY p_partkey % 4, p_partkey // 50000 ORDER BY p_partkey) + 1 AS row_number,
  CASE WHEN p_partkey % 13 <> 0 THEN 'S' || p_partkey END AS external_sku, CASE WHEN p_partkey % 5 = 0 THEN p_name || CASE WHEN p_partkey % 2 = 1 THEN chr(13) ELSE '' END || chr(10) || 'вид "' || p_brand || '"; 1|2,' || chr(9) || 'x' ELSE p_name END AS name,
  p_brand AS brand, p_size || ' г' AS size_text, CAST(floor(p_retailprice) * 100 + 50 AS BIGINT) AS own_price_minor FROM part)"""


def _write_shop_files(t, folder):
    c = F.col
    second = F.concat(F.lit('\nвид "'), c("p_brand"), F.lit('"; 1|2,\tx'))
    rows = t.part.select(
        c("p_partkey"), (c("p_partkey") % 4).alias("shop"), F.floor(c("p_partkey") / FILE_ROWS).alias("chunk"),
        F.when(c("p_partkey") % 13 != 0, F.concat(F.lit("S"), c("p_partkey").cast("string"))),
        F.when(c("p_partkey") % 5 == 0, F.concat(c("p_name"), second)).otherwise(c("p_name")), c("p_brand"),
        F.concat(c("p_size").cast("string"), F.lit(" г")), F.concat(F.floor("p_retailprice").cast("string"), F.lit(",5")))
    for shop, (delimiter, header, line_end) in enumerate(SHOP_FILES):
        own = rows.toDF("p_partkey", "shop", "chunk", *header).where(c("shop") == shop)
        # a file is one task's, so that its rows have an order; files are bounded. The order starts with the folders: else rows are sorted by them again, and lose it
        own = own.repartition("chunk").sortWithinPartitions("shop", "chunk", "p_partkey").drop("p_partkey")
        own.write.mode("append").partitionBy("shop", "chunk").options(header=True, sep=delimiter, lineSep=line_end, escape='"').csv(folder)


@query("s1_catalog_files", f"WITH {FILES_SQL} SELECT shop, chunk, row_number, external_sku, name, brand, size_text, own_price_minor, CASE WHEN external_sku IS NULL THEN 'external_sku обязателен' END AS error FROM f")
def s1_catalog_files(t):
    folder = f"{job_folder(t.spark)}/{uuid.uuid4().hex}/shops"
    _write_shop_files(t, folder)
    part = lambda name: F.regexp_extract("file", rf"{name}=(\d+)", 1).cast("bigint").alias(name)
    return cs.check_rows(cs.read_catalog(t.spark, folder)).select(
        part("shop"), part("chunk"), F.col("row_number").cast("bigint").alias("row_number"), "external_sku", "name", "brand", "size_text", "own_price_minor", "error")


@query("s2_row_errors", f"WITH {RAW} SELECT row_number, error FROM imp")
def s2_row_errors(t):
    return cs.check_rows(_import(t)).select("row_number", "error")


STATE = """cur AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'S' ELSE 'other-' END || p_partkey AS external_sku, CAST(p_partkey AS VARCHAR) AS product_id, p_name AS name, p_brand AS brand, CAST(p_size AS VARCHAR) AS size_text, CAST(p_size * 100 AS BIGINT) AS own_price_minor FROM part),
last AS (SELECT * FROM imp WHERE error IS NULL QUALIFY row_number() OVER (PARTITION BY external_sku ORDER BY row_number DESC) = 1),
state AS (SELECT coalesce(c.product_id, 'sku-' || external_sku) AS product_id, external_sku, CASE WHEN l.row_number IS NULL THEN c.name ELSE l.name END AS name,
  CASE WHEN l.row_number IS NULL THEN c.own_price_minor ELSE l.own_price_minor END AS own_price_minor, CASE WHEN l.row_number IS NULL THEN 'kept' WHEN c.product_id IS NULL THEN 'created' ELSE 'updated' END AS change
  FROM cur c FULL JOIN last l USING (external_sku))"""


def _state(t):
    c = F.col
    current = t.part.select(
        F.concat(F.when(c("p_partkey") % 3 == 0, "S").otherwise("other-"), c("p_partkey").cast("string")).alias("external_sku"), c("p_partkey").cast("string").alias("product_id"),
        c("p_name").alias("name"), c("p_brand").alias("brand"), c("p_size").cast("string").alias("size_text"),
        (c("p_size") * 100).cast("bigint").alias("own_price_minor"))
    return cs.upsert_catalog(current, cs.split_valid(_import(t))[0])


@query("s3_catalog_upsert", f"WITH {RAW}, {STATE} SELECT product_id, external_sku, name, own_price_minor, change FROM state")
def s3_catalog_upsert(t):
    return _state(t).select("product_id", "external_sku", "name", "own_price_minor", "change")


@query("s3_upsert_stats", f"WITH {RAW}, {STATE} SELECT count(*) FILTER (WHERE change = 'created') AS created, count(*) FILTER (WHERE change = 'updated') AS updated FROM state")
def s3_upsert_stats(t):
    return cs.upsert_stats(_state(t))


@query("s4_import_audit", f"WITH {RAW}, {STATE} SELECT row_number, error, CASE WHEN error IS NULL THEN product_id END AS product_id FROM imp LEFT JOIN state USING (external_sku)")
def s4_import_audit(t):
    return cs.import_audit(cs.check_rows(_import(t)), _state(t)).select("row_number", "error", "product_id")


@query("s4_import_status", f"WITH {RAW} SELECT count(*) AS row_count, count(error) AS error_count, 'completed_with_errors' AS status FROM imp")
def s4_import_status(t):
    return cs.import_status(cs.import_audit(cs.check_rows(_import(t)), _state(t)))


@query("s13_product_dimension", """SELECT l_suppkey % 8 AS source_id, l_partkey AS source_product_id, arg_max('t' || l_linenumber, {'a': l_shipdate, 'b': 't' || l_linenumber}) AS title,
  strftime(min(l_shipdate), '%Y-%m-%d') AS first_seen, strftime(max(l_shipdate), '%Y-%m-%d') AS last_seen FROM lineitem GROUP BY 1, 2""")
def s13_product_dimension(t):
    c = F.col
    seen = t.lineitem.select(
        F.lit(1).alias("company_id"), (c("l_suppkey") % 8).alias("source_id"), c("l_partkey").alias("source_product_id"),
        F.concat(F.lit("t"), c("l_linenumber").cast("string")).alias("title"), F.lit("b").alias("brand"), F.lit("s").alias("size_text"),
        F.lit("1").alias("barcode"), F.lit("u").alias("url"), c("l_shipdate").alias("observed_at"))
    early, late = seen.where("observed_at < '1998-01-01'"), seen.where("observed_at >= '1998-01-01'")
    state = cs.upsert_products(cs.upsert_products(None, early), late)
    return state.select("source_id", "source_product_id", "title", F.date_format("first_seen_at", "yyyy-MM-dd").alias("first_seen"),
                        F.date_format("last_seen_at", "yyyy-MM-dd").alias("last_seen"))


# Pages: 20 products each, as cards or as an embedded document.
PRICES = "floor(p_retailprice) AS whole"


def _page_parts(t):
    c = F.col
    key, whole = c("p_partkey").cast("string"), F.floor("p_retailprice").cast("string")
    stock = F.when(c("p_partkey") % 4 == 0, "Нет в наличии").otherwise("В наличии")
    price = F.when(c("p_partkey") % 9 != 0, F.concat(F.lit(' data-price="'), whole, F.lit('.50"'))).otherwise("")
    old = F.when(c("p_partkey") % 3 == 0, F.concat(F.lit('<div class="old-price">'), whole, F.lit(',90 ₽</div>'))).otherwise("")
    card = F.concat(F.lit('<div class="product-card" data-id="'), key, F.lit('"'), price, F.lit(' data-ean="'),
                    (c("p_partkey") + 4600000000000).cast("string"), F.lit('"><a href="/product/'), key, F.lit('/" title="'), c("p_name"),
                    F.lit('"><span class="product-title">'), c("p_name"), F.lit('</span></a>'), old, F.lit('<div class="availability">'), stock, F.lit("</div></div>\n"))
    item = F.to_json(F.struct(
        c("p_partkey").alias("id"), c("p_name").alias("name"), c("p_brand").alias("brand"),
        F.when(c("p_partkey") % 2 == 0, F.concat(whole, F.lit(".50"))).alias("price"),
        F.when(c("p_partkey") % 2 == 1, F.concat(whole, F.lit(".50"))).alias("current_price"), F.concat(whole, F.lit(".90")).alias("old_price"),
        F.when(c("p_partkey") % 5 == 0, F.lit("10.00")).alias("store_price"),
        F.concat(c("p_size").cast("string"), F.lit(" ml")).alias("size"), (c("p_partkey") + 4600000000000).cast("string").alias("barcode"),
        (c("p_partkey") % 4 != 0).alias("available"), (c("p_partkey") % 6).alias("stock")))
    return t.part.select(F.floor(c("p_partkey") / 20).cast("bigint").alias("page_id"), c("p_partkey").alias("k"), card.alias("card"), item.alias("item"))


def _joined(rows, column, sep):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", column))), lambda r: r[column]), sep)


def _with_page_columns(pages):
    source = F.element_at(F.array(*[F.lit(s) for s in ("spar_online", "magnit", "metro_online")]), (F.col("page_id") % 3 + 1).cast("int"))
    return pages.withColumn("source_key", source).withColumn("price_context", F.lit("online_delivery")).withColumn(
        "observed_at", F.lit("2024-01-01").cast("timestamp"))


def _card_pages(t):
    rows = _page_parts(t)
    pages = rows.groupBy("page_id").agg(F.concat(F.lit("<html><body>"), _joined(rows, "card", ""), F.lit("</body></html>")).alias("html"))
    return _with_page_columns(pages)


def _json_pages(t, api=False):
    rows = _page_parts(t)
    listed = F.concat(F.lit("["), _joined(rows, "item", ","), F.lit("]"))
    if api:
        return _with_page_columns(rows.groupBy("page_id").agg(F.concat(F.lit('{"data": {"items": '), listed, F.lit("}}")).alias("payload")))
    doc = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">{"props": {"pageProps": {"initialState": {"catalog": {"products": {"items": '),
                   listed, F.lit('}}}}}}</script></html>'))
    return _with_page_columns(rows.groupBy("page_id").agg(doc.alias("html")))


SEEN_COLUMNS = ["source_product_id", "url", "title", "barcode", "price_minor", "old_price_minor", "availability"]
BASE = "['https://spar-online.ru', 'https://magnit.ru', 'https://online.metro-cc.ru'][(p_partkey // 20) % 3 + 1]"


@query("s5_page_cards", f"""SELECT CAST(p_partkey AS VARCHAR) AS source_product_id, {BASE} || '/product/' || p_partkey || '/' AS url, p_name AS title, CAST(p_partkey + 4600000000000 AS VARCHAR) AS barcode,
  CAST(CASE WHEN p_partkey % 9 <> 0 THEN floor(p_retailprice) * 100 + 50 ELSE floor(p_retailprice) * 100 + 90 END AS BIGINT) AS price_minor,
  CASE WHEN p_partkey % 3 = 0 THEN CAST(floor(p_retailprice) * 100 + 90 AS BIGINT) END AS old_price_minor, CASE WHEN p_partkey % 4 = 0 THEN 'out_of_stock' ELSE 'in_stock' END AS availability
  FROM part WHERE p_partkey % 9 <> 0""")
def s5_page_cards(t):
    return pg.extract_cards(_card_pages(t)).select(*SEEN_COLUMNS)


EMBEDDED = f"""SELECT CAST(p_partkey AS VARCHAR) AS source_product_id, {BASE} || '/product/' || p_partkey || '/' AS url, p_name AS title, p_brand AS brand, p_size || 'мл' AS size_text,
  CASE WHEN (p_partkey // 20) % 3 = 2 AND p_partkey % 2 = 1 THEN 0 ELSE CAST(floor(p_retailprice) * 100 + 50 AS BIGINT) END AS price_minor, CAST(floor(p_retailprice) * 100 + 90 AS BIGINT) AS old_price_minor,
  CASE WHEN p_partkey % 4 = 0 OR p_partkey % 6 = 0 THEN 'out_of_stock' ELSE 'in_stock' END AS availability FROM part"""
EMBEDDED_COLUMNS = ["source_product_id", "url", "title", "brand", "size_text", "price_minor", "old_price_minor", "availability"]


@query("s6_embedded_json", EMBEDDED)
def s6_embedded_json(t):
    return pg.extract_embedded_json(_json_pages(t)).select(*EMBEDDED_COLUMNS)


@query("s6_pages_with_fallback", f"""SELECT CASE WHEN page % 2 = 0 THEN 'json' ELSE 'cards' END AS read_through, count(*) AS products FROM (SELECT p_partkey // 20 AS page, p_partkey FROM part) WHERE page % 2 = 0 OR p_partkey % 9 <> 0 GROUP BY 1""")
def s6_pages_with_fallback(t):
    pages = _json_pages(t).where("page_id % 2 = 0").unionByName(_card_pages(t).where("page_id % 2 = 1"))
    rows = pg.extract_pages(pages)
    return rows.groupBy(F.when(F.col("page_id") % 2 == 0, "json").otherwise("cards").alias("read_through")).agg(F.count("*").alias("products"))


@query("s7_api_payload", EMBEDDED)
def s7_api_payload(t):
    return pg.flatten_api(_json_pages(t, api=True)).select(*EMBEDDED_COLUMNS)


@query("s5_stored_pages", r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, 'href="([^"]+)"')) AS BIGINT) AS links,
  CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS paragraphs, regexp_matches(lower(html), 'pagination|load-more|has-more|next-page|следующая') AS has_more FROM pages""")
def s5_stored_pages(t):
    rows = pg.page_titles(t.wide("pages"))
    return rows.withColumn("links", F.col("links").cast("bigint")).withColumn("paragraphs", F.col("paragraphs").cast("bigint"))


@query("s8_recognition", """SELECT o_orderkey, 0 AS item_no, 'товар ' || o_custkey AS raw_name, o_custkey * 100 + 90 AS price_minor, CASE WHEN o_orderkey % 2 = 0 THEN 20000 END AS old_price_minor,
  floor(least(1.0::DOUBLE, o_custkey / 1000.0::DOUBLE) * 1e6 + 0.5) / 1e6 AS confidence, CASE WHEN o_orderkey % 4 <> 1 THEN floor(o_custkey % 400 / 1000.0::DOUBLE * 1e6 + 0.5) / 1e6 END AS box_x FROM orders WHERE o_orderkey % 4 <> 3""")
def s8_recognition(t):
    c = F.col
    price = F.concat(c("o_custkey").cast("string"), F.lit(",90"))
    box = F.when(c("o_orderkey") % 4 == 1, F.struct(F.lit(0.9).alias("x"), F.lit(0.1).alias("y"), F.lit(0.5).alias("w"), F.lit(0.2).alias("h"))).otherwise(
        F.struct((c("o_custkey") % 400).cast("double").alias("x"), F.lit(100.0).alias("y"), F.lit(300.0).alias("w"), F.lit(200.0).alias("h")))
    item = F.to_json(F.struct(F.concat(F.lit("товар "), c("o_custkey").cast("string")).alias("name"), price.alias("price"),
                              F.when(c("o_orderkey") % 2 == 0, 200).alias("old_price"), (c("o_custkey") / 1000.0).alias("confidence"), box.alias("bbox")))
    body = (F.when(c("o_orderkey") % 4 == 0, F.concat(F.lit("```json\n["), item, F.lit("]\n```")))
            .when(c("o_orderkey") % 4 == 1, F.concat(F.lit('{"items": ['), item, F.lit(', {"brand": "x"}]}')))
            .when(c("o_orderkey") % 4 == 2, F.concat(F.lit('{"data": {"products": ['), item, F.lit("]}}"))).otherwise(F.concat(F.lit("{broken "), item)))
    rows = rc.normalize_recognition(t.wide("orders").select("o_orderkey", body.alias("payload")))

    def six(column):
        return F.floor(column * 1e6 + 0.5) / 1e6
    return rows.select("o_orderkey", "item_no", "raw_name", "price_minor", "old_price_minor", six(F.col("confidence")).alias("confidence"),
                       six(F.col("bbox.x")).alias("box_x"))


@query("s8_payload_status", """SELECT CASE WHEN event_id % 5 = 0 THEN 'malformed JSON' WHEN event_id % 5 = 1 THEN 'Пустой ответ от AI' END AS error, CASE WHEN event_id % 5 = 2 THEN 'blurred' WHEN event_id % 5 >= 3 THEN 'JSON without an item array' ELSE '' END AS warnings,
  count(*) AS payloads FROM events GROUP BY 1, 2""")
def s8_payload_status(t):
    k = F.col("event_id") % 5
    body = (F.when(k == 0, F.concat(F.lit("{broken "), F.col("props"))).when(k == 1, "42")
            .when(k == 2, F.concat(F.lit('{"items": [], "warnings": ["blurred", 1], "p": '), F.col("props"), F.lit("}"))).otherwise(F.col("props")))
    rows = rc.parse_payloads(t.events.select("event_id", body.alias("payload")))
    return rows.groupBy("error", F.array_join("warnings", "|").alias("warnings")).agg(F.count("*").alias("payloads"))


def _shelf_texts(t):
    c = F.col
    whole = (c("l_partkey") % 900 + 100).cast("string")
    cents = F.lpad((c("l_linenumber") * 9 + 10).cast("string"), 2, "0")
    old = (c("l_partkey") % 900 + 1100).cast("string")
    name = F.concat(F.lit("Кофе Жокей "), c("l_suppkey").cast("string"), F.lit(" 250 г"))
    k = c("l_orderkey") % 4
    body = (F.when(k == 0, F.concat(name, F.lit("\nЦена "), whole, F.lit(" "), cents, F.lit(" руб")))
            .when(k == 1, F.concat(name, F.lit("\nСтарая цена "), old, F.lit(",50\nНовая цена акция "), whole, F.lit(","), cents))
            .when(k == 2, F.concat(name, F.lit("\nАкция "), whole, F.lit(":"), cents, F.lit("\n"), name))
            .otherwise(F.concat(name, F.lit("\nСкидка 15%"))))
    return t.wide("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", body.alias("text"))


LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
SHELF_PRICE = "CASE WHEN l_orderkey % 4 <> 3 THEN (l_partkey % 900 + 100) * 100 + l_linenumber * 9 + 10 END"


@query("n13_shelf_prices", f"""SELECT {LINE}, {SHELF_PRICE} AS price_minor, CASE WHEN l_orderkey % 4 = 1 THEN (l_partkey % 900 + 1100) * 100 + 50 END AS old_price_minor,
  CASE WHEN l_orderkey % 4 IN (1, 2) THEN {SHELF_PRICE} END AS promo_price_minor, CASE l_orderkey % 4 WHEN 0 THEN 'regular' WHEN 3 THEN NULL ELSE 'promo' END AS kind FROM lineitem""")
def n13_shelf_prices(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = st.prices_from_text(_shelf_texts(t))
    # A supplier number in the product line may itself look like a price; the labelled price outranks it.
    return rows.select(*keys, "price_minor", "old_price_minor", "promo_price_minor", "kind")


@query("n13_document_prices")
def n13_document_prices(t):
    return st.prices_from_text(t.wide("documents").select("doc_id", "text")).drop("text")


@query("n14_shelf_names", f"""SELECT {LINE}, 'Кофе Жокей ' || l_suppkey || ' 250 г' AS raw_name, 'кофе жокей ' || l_suppkey || ' 250 г' AS normalized FROM lineitem""")
def n14_shelf_names(t):
    rows = st.product_names_from_text(st.prices_from_text(_shelf_texts(t)))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "raw_name", "normalized")


@query("n14_document_names")
def n14_document_names(t):
    return st.product_names_from_text(st.prices_from_text(t.wide("documents").select("doc_id", "text"))).drop("text", "price_tag_text")


# Templates: four templates with two sheets each; rows from parts, columns from nations and suppliers.
SHEETS = "CASE WHEN p_size % 2 = 0 THEN 'Продукты' ELSE 'Химия' END"
BODY = f"""body AS (SELECT p_partkey % 4 AS template_id, {SHEETS} AS sheet, p_partkey + 2 AS row, p_name AS name,
  CASE WHEN p_partkey % 40 < 4 THEN NULL ELSE CAST(4600000000000 + p_partkey - CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 24 ELSE 0 END + CASE WHEN p_partkey % 19 = 0 THEN 900000000 ELSE 0 END AS VARCHAR) END AS barcode FROM part),
filled AS (SELECT *, max(CASE WHEN barcode IS NULL THEN row END) OVER (PARTITION BY template_id, sheet ORDER BY row) AS cat_row FROM body),
tprod AS (SELECT f.template_id, f.sheet, CASE f.sheet WHEN 'Продукты' THEN 'products' ELSE 'chemistry' END AS department, f.barcode, f.name, c.name AS category, f.row FROM filled f
  LEFT JOIN body c ON c.template_id = f.template_id AND c.sheet = f.sheet AND c.row = f.cat_row WHERE f.barcode IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY f.template_id, f.sheet, f.barcode ORDER BY f.row) = 1)"""
COLUMNS = """tcol AS (SELECT t AS template_id, d AS department, 2 + 3 * n_nationkey + o AS col, 'Наш ' || n_name AS own_label,
  CASE o WHEN 0 THEN 'Наш ' || n_name WHEN 1 THEN s1.name || ', ' || s1.address ELSE s2.name END AS store_label, CASE o WHEN 0 THEN 'own' ELSE 'competitor' END AS price_kind
  FROM nation, (VALUES (0), (1), (2), (3)) tt(t), (VALUES ('products'), ('chemistry')) dd(d), (VALUES (0), (1), (2)) oo(o), stores s1, stores s2
  WHERE s1.store_id = (n_nationkey * 3 + 1) % (SELECT count(*) FROM supplier) AND s2.store_id = (n_nationkey * 2 + 7) % (SELECT count(*) FROM supplier))"""
RESOLVED = """rival AS (SELECT * FROM stores WHERE NOT is_own), exact AS (SELECT lower(name) || '|' || lower(address) AS k, max(store_id) AS sid FROM rival GROUP BY 1),
uniq AS (SELECT lower(name) AS k, min(store_id) AS sid FROM rival GROUP BY 1 HAVING count(*) = 1),
rcol AS (SELECT c.*, coalesce(e.sid, u.sid) AS store_id, department || ':' || col AS col_key FROM tcol c LEFT JOIN exact e ON e.k = lower(trim(split_part(store_label, ',', 1))) || '|' || lower(trim(split_part(store_label, ',', 2)))
  LEFT JOIN uniq u ON u.k = lower(trim(split_part(store_label, ',', 1))) WHERE price_kind = 'competitor')"""
CODES = """codes AS (SELECT code, min(product_id) AS product_id FROM (SELECT product_id, barcode AS code FROM cat UNION ALL SELECT product_id, external_sku FROM cat) WHERE code IS NOT NULL GROUP BY code),
rprod AS (SELECT t.*, product_id FROM tprod t LEFT JOIN codes ON code = barcode)"""
LATEST = """latest AS (SELECT product_id, store_id, price_minor FROM obs QUALIFY row_number() OVER (PARTITION BY product_id, store_id ORDER BY observed_at DESC, obs_id DESC) = 1),
lng AS (SELECT p.template_id, p.department, p.row, p.product_id, c.col_key, l.price_minor FROM rprod p JOIN rcol c USING (template_id, department) JOIN latest l ON l.product_id = p.product_id AND l.store_id = c.store_id)"""
TEMPLATE = f"{with_tables('stores', 'cat', 'obs')}, {BODY}, {COLUMNS}, {RESOLVED}, {CODES}, {LATEST}"


def _cells(t):
    c = F.col
    sheet = F.when(c("p_size") % 2 == 0, "Продукты").otherwise("Химия")
    code = (F.lit(4600000000000) + c("p_partkey") - F.when(c("p_partkey") % 3 == 0, c("p_partkey") % 24).otherwise(0)
            + F.when(c("p_partkey") % 19 == 0, 900000000).otherwise(0)).cast("string")
    shown = F.when(c("p_partkey") % 40 < 2, "0").when(c("p_partkey") % 40 < 4, "").otherwise(F.concat(code, F.lit(".0")))
    body = t.part.select(
        (c("p_partkey") % 4).alias("template_id"), sheet.alias("sheet"), (c("p_partkey") + 2).alias("row"),
        F.explode(F.array(F.struct(F.lit(0).alias("col"), c("p_name").alias("text")), F.struct(F.lit(1).alias("col"), shown.alias("text")))).alias("x")).select(
        "template_id", "sheet", "row", "x.col", "x.text")
    n = t.supplier.count()
    stores = t.domain.stores
    first = stores.select(c("store_id").alias("s1"), F.concat_ws(", ", "name", "address").alias("l1"))
    second = stores.select(c("store_id").alias("s2"), c("name").alias("l2"))
    heads = (t.nation.withColumn("s1", (c("n_nationkey") * 3 + 1) % n).withColumn("s2", (c("n_nationkey") * 2 + 7) % n)
             .join(first, "s1").join(second, "s2"))
    at = 2 + 3 * c("n_nationkey")
    head = heads.select(
        F.explode(F.sequence(F.lit(0), F.lit(3))).alias("template_id"), at.alias("at"), "n_name", "l1", "l2").withColumn(
        "sheet", F.explode(F.array(F.lit("Продукты"), F.lit("Химия"))))
    cell = lambda row, col, text: F.struct(F.lit(row).alias("row"), col.alias("col"), text.alias("text"))
    header = head.select("template_id", "sheet", F.explode(F.array(
        cell(0, c("at"), F.concat(F.lit("Наш "), c("n_name"))), cell(1, c("at"), F.lit("Наша цена")), cell(1, c("at") + 1, c("l1")),
        cell(1, c("at") + 2, c("l2")))).alias("x")).select("template_id", "sheet", "x.row", "x.col", "x.text")
    merges = head.select("template_id", "sheet", F.lit(0).alias("row"), c("at").alias("col_start"), (c("at") + 2).alias("col_end"))
    return body.unionByName(header), merges


def _resolved(t):
    cells, merges = _cells(t)
    columns = tp.resolve_columns(tp.template_columns(cells, merges), t.domain.stores)
    products = tp.resolve_products(tp.template_products(cells), t.domain.catalog)
    return products, columns, ph.latest_prices(t.domain.observations)


@query("s9_template_products", f"WITH {BODY} SELECT template_id, department, barcode, name, category, row FROM tprod")
def s9_template_products(t):
    return tp.template_products(_cells(t)[0]).select("template_id", "department", "barcode", "name", "category", "row")


@query("w7_category_fill", f"""WITH {BODY} SELECT f.template_id, f.sheet, f.row, c.name AS category FROM filled f LEFT JOIN body c ON c.template_id = f.template_id AND c.sheet = f.sheet AND c.row = f.cat_row""")
def w7_category_fill(t):
    rows = t.part.select(
        (F.col("p_partkey") % 4).alias("template_id"), F.when(F.col("p_size") % 2 == 0, "Продукты").otherwise("Химия").alias("sheet"),
        (F.col("p_partkey") + 2).alias("row"), F.when(F.col("p_partkey") % 40 < 4, F.col("p_name")).alias("head"))
    return ph.carry_forward(rows, ["template_id", "sheet"], "row", "head", "category", block_rows=64).drop("head")


@query("w6_first_per_barcode", f"WITH {BODY} SELECT barcode, min(row) AS row FROM body WHERE barcode IS NOT NULL GROUP BY barcode")
def w6_first_per_barcode(t):
    from shelflens.operators.retail_sources import first_per_key
    rows = tp.template_products(_cells(t)[0])
    return first_per_key(rows, ["barcode"], ["row", "sheet"]).select("barcode", "row")


@query("s10_template_columns", f"{with_tables('stores')}, {COLUMNS} SELECT * FROM tcol")
def s10_template_columns(t):
    cells, merges = _cells(t)
    return tp.template_columns(cells, merges).drop("sheet")


@query("s11_store_upsert", f"""{with_tables('stores')}, {COLUMNS}, labels AS (SELECT store_label AS label, bool_or(price_kind = 'own') AS own FROM tcol GROUP BY 1),
fresh AS (SELECT trim(split_part(label, ',', 1)) AS name, nullif(trim(split_part(label, ',', 2)), '') AS address, own FROM labels),
cur AS (SELECT * REPLACE (CASE WHEN store_id % 2 = 0 THEN name ELSE name || ' (прежний)' END AS name) FROM stores)
SELECT coalesce(c.name, f.name) AS name, coalesce(c.address, f.address) AS address, coalesce(c.is_own, false) OR coalesce(f.own, false) AS is_own, c.store_id IS NULL AS created
FROM cur c FULL JOIN fresh f ON lower(c.name) || '|' || lower(c.address) = lower(f.name) || '|' || coalesce(lower(f.address), '')""")
def s11_store_upsert(t):
    cells, merges = _cells(t)
    labels = tp.column_stores(tp.template_columns(cells, merges))
    renamed = F.when(F.col("store_id") % 2 == 0, F.col("name")).otherwise(F.concat("name", F.lit(" (прежний)")))
    return tp.upsert_stores(t.domain.stores.withColumn("name", renamed), labels).select("name", "address", "is_own", "created")


@query("j5_column_stores", f"{with_tables('stores')}, {COLUMNS}, {RESOLVED} SELECT template_id, department, col, store_label, store_id FROM rcol")
def j5_column_stores(t):
    return _resolved(t)[1].select("template_id", "department", "col", "store_label", "store_id")


@query("j6_row_products", f"{with_tables('cat')}, {BODY}, {CODES} SELECT template_id, department, row, barcode, product_id FROM rprod")
def j6_row_products(t):
    return _resolved(t)[0].select("template_id", "department", "row", "barcode", "product_id")


KEYS = [f"{d}:{2 + 3 * n + o}" for d in ("products", "chemistry") for n in range(25) for o in (1, 2)]


@query("s17_fill_template", f"""{TEMPLATE} SELECT template_id, department, row, {', '.join(f'''min(CASE WHEN col_key = '{k}' THEN price_minor END) / 100.0::DOUBLE AS "{k}"''' for k in KEYS)}
  FROM rprod LEFT JOIN lng USING (template_id, department, row) GROUP BY template_id, department, row""")
def s17_fill_template(t):
    return tp.fill_template(*_resolved(t), KEYS).drop("barcode", "name")


LOW = """low AS (SELECT store_id, count(*) AS low_rows FROM (SELECT l_suppkey AS store_id, CASE WHEN l_linenumber <> 2 THEN l_discount * 10 END AS conf FROM lineitem WHERE l_partkey % 5 <> 0) WHERE conf IS NULL OR conf < 0.7::DOUBLE GROUP BY 1)"""


def _shelf(t):
    c = F.col
    return t.lineitem.select(
        F.when(c("l_partkey") % 5 != 0, c("l_partkey")).alias("product_id"), c("l_suppkey").alias("store_id"),
        F.when(c("l_linenumber") != 3, F.concat(F.lit("item "), c("l_partkey").cast("string"))).alias("raw_name"),
        F.when(c("l_linenumber") != 2, c("l_discount") * 10).alias("match_confidence"),
        F.struct(c("l_orderkey"), c("l_linenumber"), c("l_partkey"), c("l_shipdate")).alias("obs_id"))


@query("a10_low_confidence", f"""WITH {LOW}, s AS (SELECT l_suppkey AS store_id, coalesce(CASE WHEN l_linenumber <> 3 THEN 'item ' || l_partkey END, '(без названия)') AS nm, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate) AS n
  FROM lineitem WHERE l_partkey % 5 <> 0 AND (l_linenumber = 2 OR l_discount * 10 < 0.7::DOUBLE))
SELECT store_id, low_rows AS low_confidence_rows, names FROM low JOIN (SELECT store_id, string_agg(nm, '|' ORDER BY n) AS names FROM s WHERE n <= 3 GROUP BY 1) USING (store_id)""")
def a10_low_confidence(t):
    rows = tp.low_confidence(_shelf(t))
    return rows.select("store_id", "low_confidence_rows", F.array_join(F.transform("samples", lambda s: s["raw_name"]), "|").alias("names"))


@query("a10_samples_overall", """SELECT l_suppkey AS store_id, coalesce(CASE WHEN l_linenumber <> 3 THEN 'item ' || l_partkey END, '(без названия)') AS raw_name,
  CASE WHEN l_linenumber <> 2 THEN l_discount * 10 END AS match_confidence FROM lineitem WHERE l_partkey % 5 <> 0 AND (l_linenumber = 2 OR l_discount * 10 < 0.7::DOUBLE)
  ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate LIMIT 10""")
def a10_samples_overall(t):
    return tp.low_confidence_samples(_shelf(t))


COVERAGE = f"""{TEMPLATE}, {LOW}, tot AS (SELECT template_id, department, count(DISTINCT product_id) AS n FROM rprod WHERE product_id IS NOT NULL GROUP BY 1, 2),
fil AS (SELECT template_id, col_key, count(DISTINCT product_id) AS n FROM lng GROUP BY 1, 2),
cov AS (SELECT c.template_id, c.department, c.col, c.store_label, c.store_id, c.store_id IS NOT NULL AS resolved, coalesce(f.n, 0) AS filled, coalesce(t.n, 0) AS total_rows,
  CASE WHEN c.store_id IS NULL OR coalesce(t.n, 0) = 0 THEN 0 ELSE CAST(floor(coalesce(f.n, 0) / CAST(t.n AS DOUBLE) * 100 + 0.5) AS BIGINT) END AS coverage_pct,
  CASE WHEN c.store_id IS NULL THEN 0 ELSE coalesce(low_rows, 0) END AS low_confidence_rows
  FROM rcol c LEFT JOIN tot t USING (template_id, department) LEFT JOIN fil f ON f.template_id = c.template_id AND f.col_key = c.col_key LEFT JOIN low ON low.store_id = c.store_id)"""


def _coverage(t):
    products, columns, prices = _resolved(t)
    return tp.column_coverage(products, columns, prices, tp.low_confidence(_shelf(t))), products


@query("a9_column_coverage", f"{COVERAGE} SELECT * FROM cov")
def a9_column_coverage(t):
    return _coverage(t)[0]


@query("a9_coverage_report", f"""{COVERAGE}, un AS (SELECT template_id, count(*) FILTER (WHERE product_id IS NULL) AS unmapped_rows FROM rprod GROUP BY 1),
agg AS (SELECT template_id, count(*) AS competitor_columns, count(*) FILTER (WHERE resolved) AS resolved_stores, count(*) FILTER (WHERE NOT resolved) AS unresolved_columns,
  CAST(sum(CASE WHEN resolved THEN filled ELSE 0 END) AS BIGINT) AS filled_cells, CAST(sum(CASE WHEN resolved THEN total_rows ELSE 0 END) AS BIGINT) AS total_cells,
  CAST(sum(low_confidence_rows) AS BIGINT) AS low_confidence_rows FROM cov GROUP BY 1)
SELECT a.*, unmapped_rows, CAST(floor(filled_cells / CAST(total_cells AS DOUBLE) * 100 + 0.5) AS BIGINT) AS coverage_pct, (resolved_stores = 0)::INT + (resolved_stores > 0 AND floor(filled_cells / CAST(total_cells AS DOUBLE) * 100 + 0.5) < 50)::INT
  + (unresolved_columns > 0)::INT + (unmapped_rows > 0)::INT + (low_confidence_rows > 0)::INT AS warning_count FROM agg a JOIN un USING (template_id)""")
def a9_coverage_report(t):
    rows = tp.coverage_report(*_coverage(t))
    return rows.select("template_id", "competitor_columns", "resolved_stores", F.col("unresolved_columns").cast("bigint").alias("unresolved_columns"),
                       "filled_cells", "total_cells", "low_confidence_rows", "unmapped_rows", "coverage_pct",
                       F.size("warnings").alias("warning_count"))


@query("s14_snapshot_header", f"""{COVERAGE}, un AS (SELECT template_id, count(*) FILTER (WHERE product_id IS NULL) AS unmapped_rows FROM rprod GROUP BY 1),
agg AS (SELECT template_id, count(*) FILTER (WHERE resolved) AS resolved_stores, count(*) FILTER (WHERE NOT resolved) AS unresolved_columns,
  string_agg(CASE WHEN NOT resolved THEN store_label END, ', ' ORDER BY department, col, store_label) AS labels, CAST(sum(low_confidence_rows) AS BIGINT) AS low,
  CAST(sum(CASE WHEN resolved THEN filled ELSE 0 END) AS BIGINT) AS filled_cells, CAST(sum(CASE WHEN resolved THEN total_rows ELSE 0 END) AS BIGINT) AS total_cells FROM cov GROUP BY 1),
pct AS (SELECT *, CAST(floor(filled_cells / CAST(total_cells AS DOUBLE) * 100 + 0.5) AS BIGINT) AS coverage_pct FROM agg JOIN un USING (template_id))
SELECT 'export-20240305-060708' AS snapshot_id, template_id, total_cells, filled_cells, coverage_pct, resolved_stores, unresolved_columns, concat_ws('|', CASE WHEN resolved_stores = 0 THEN 'no_store_resolved' END,
  CASE WHEN resolved_stores > 0 AND coverage_pct < 50 THEN 'low_coverage: ' || coverage_pct || ' %' END, CASE WHEN unresolved_columns > 0 THEN 'unresolved_columns: ' || unresolved_columns || ' — ' || labels END,
  CASE WHEN unmapped_rows > 0 THEN 'unknown_barcodes: ' || unmapped_rows END, CASE WHEN low > 0 THEN 'low_confidence: ' || low || ' (< 0.7)' END) AS warnings FROM pct""")
def s14_snapshot_header(t):
    header = tp.snapshot_header(tp.coverage_report(*_coverage(t)), F.lit("2024-03-05 06:07:08").cast("timestamp"))
    return header.select("snapshot_id", "template_id", "total_cells", "filled_cells", "coverage_pct", "resolved_stores",
                         F.col("unresolved_columns").cast("bigint").alias("unresolved_columns"), F.array_join("warnings", "|").alias("warnings"))


@query("t3_worst_coverage", f"{COVERAGE} SELECT template_id, department, col, coverage_pct FROM cov ORDER BY coverage_pct, template_id, department, col")
def t3_worst_coverage(t):
    return tp.coverage_by_problem(_coverage(t)[0]).select("template_id", "department", "col", "coverage_pct")


AT = "2024-03-05 06:07:08"


@query("s14_snapshot", f"""{with_tables('obs')}, latest AS (SELECT product_id, store_id, price_minor FROM obs QUALIFY row_number() OVER (PARTITION BY product_id, store_id ORDER BY observed_at DESC, obs_id DESC) = 1)
SELECT 'export-20240305-060708' AS snapshot_id, CAST(product_id AS VARCHAR) AS product_id, count(*) AS stores, CAST(sum(price_minor) AS BIGINT) AS total FROM latest GROUP BY product_id""")
def s14_snapshot(t):
    snap = tp.build_snapshot(ph.latest_prices(t.domain.observations), F.lit(AT).cast("timestamp"))
    return snap.select("snapshot_id", "product_id", F.size("store_prices").cast("bigint").alias("stores"),
                       F.aggregate(F.map_values("store_prices"), F.lit(0).cast("bigint"), lambda a, p: a + p).alias("total"))


@query("s15_snapshot_read", f"""{with_tables('obs')} SELECT 'export-20240305-060708' AS snapshot_id, CAST(product_id AS VARCHAR) AS product_id, CAST(store_id AS VARCHAR) AS store_id, price_minor FROM obs
  QUALIFY row_number() OVER (PARTITION BY product_id, store_id ORDER BY observed_at DESC, obs_id DESC) = 1""")
def s15_snapshot_read(t):
    prices = ph.latest_prices(t.domain.observations)
    snaps = tp.build_snapshot(prices, F.lit(AT).cast("timestamp")).unionByName(
        tp.build_snapshot(prices, F.lit("2024-03-06 00:00:00").cast("timestamp")))
    return tp.read_snapshot(snaps, F.lit("export-20240305-060708"))


@query("s15_recent_snapshots", f"{with_tables('obs')} SELECT 'export-' || strftime(observed_at, '%Y%m%d-%H%M%S') AS snapshot_id, count(DISTINCT product_id) AS products FROM obs GROUP BY observed_at ORDER BY observed_at DESC LIMIT 10")
def s15_recent_snapshots(t):
    rows = t.domain.observations.groupBy("observed_at", "product_id").agg(
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct(F.col("obs_id").cast("string"), F.col("price_minor"))))).alias("store_prices"))
    snaps = rows.select(tp.snapshot_id(F.col("observed_at")).alias("snapshot_id"), F.col("observed_at").alias("created_at"), "product_id", "store_prices")
    return tp.recent_snapshots(snaps, 10).select("snapshot_id", "products")
