"""Stored retailer pages and API payloads to product observations.

Input pages: page_id, source_key, price_context, observed_at, html. Everything is a row expression on the page, so a
page is read where it lies and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelflens.functions import fixed_values as fv
from shelflens.functions import text as tx
from shelflens.functions.money import price_text_to_minor
from shelflens.sources import json_fields as jf

OBSERVATION = ["page_id", "source_key", "source_product_id", "url", "title", "brand", "size_text", "barcode",
               "price_minor", "old_price_minor", "promo_price_minor", "availability", "observed_at", "payload_hash"]

# Page patterns.
CARD = (r"(?is)<div[^>]*class=[\"'][^\"']*product[^\"']*[\"'][^>]*data-id=[\"'][^\"']+[\"'][^>]*>"
        r".*?(?=<div[^>]*class=[\"'][^\"']*product[^\"']*[\"'][^>]*data-id=|\z)")
OUT_OF_STOCK = r"(?iu)out-of-stock|unavailable|нет\s+в\s+наличии"
MORE_PAGES = r"(?iu)pagination|load-more|has-more|next-page|Следующая"
SCRIPT_JSON = r"(?is)<script[^>]*(?:type=[\"']application/json[\"']|id=[\"']__NEXT_DATA__[\"'])[^>]*>([^<]+)</script>"
NUXT_JSON = r"(?s)window\.__NUXT__\s*=\s*(\{.*?\});"
ITEM_PATHS = ["$.products", "$.items", "$.data.items", "$.results",
              "$.props.pageProps.initialState.catalog.products.items", "$.props.pageProps.catalog.products.items",
              "$.props.pageProps.products", "$.state.catalog.products", "$.data[0].catalog.products"]
API_PATHS = ["$.data.items", "$.products", "$.items", "$.results", "$.data"]
MORE_PATHS = ["$.data.has_more", "$.has_more", "$.pagination.has_next",
              "$.props.pageProps.initialState.catalog.products.hasMore", "$.props.pageProps.catalog.products.hasMore"]

# Field spellings per source; the first one present is used.
FIELDS = {
    "default": {
        "id": ["$.id", "$.product_id", "$.sku", "$.offer_id", "$.code"],
        "price": ["$.price.value", "$.price", "$.regular_price", "$.current_price"],
        "old": ["$.price.old_value", "$.old_price", "$.regular_price"],
        "promo": ["$.price.promo_value", "$.promo_price", "$.discount_price"],
    },
    "x5_5ka": {"price": ["$.price", "$.regular_price", "$.current_price"], "old": ["$.old_price", "$.prev_price"],
               "promo": ["$.promo_price", "$.discount_price", "$.sale_price"]},
    "metro_online": {"price": ["$.price"], "old": ["$.old_price"], "promo": ["$.promo_price"]},
    "metro_store": {"price": ["$.store_price"], "old": ["$.store_old_price"], "promo": ["$.store_promo_price"]},
}
SHARED = {
    "title": ["$.name", "$.title", "$.product_name"], "brand": ["$.brand", "$.brand_name"],
    "size": ["$.size", "$.weight", "$.volume", "$.package", "$.unit"],
    "barcode": ["$.barcode", "$.ean", "$.gtin", "$.upc"], "url": ["$.url", "$.link"],
}


def _base_url(source: Column) -> Column:
    urls = F.create_map(*[F.lit(x) for p in fv.SOURCE_BASE_URL.items() for x in p])
    return F.coalesce(F.try_element_at(urls, source), F.lit(""))


def _absolute(source: Column, url: Column, product_id: Column) -> Column:
    base = _base_url(source)
    return (F.when(url.isNull(), F.concat(base, F.lit("/product/"), product_id, F.lit("/")))
            .when(url.startswith("http"), url).otherwise(F.concat(base, url)))


def _positive(price: Column) -> Column:
    return F.when(price > 0, price)


def _finish(rows: DataFrame) -> DataFrame:
    out = rows.withColumn("size_text", tx.size_text_norm(F.col("size_text"))).withColumn(
        "barcode", tx.barcode_norm(F.col("barcode"))).withColumn(
        "payload_hash", tx.payload_fingerprint(F.col("source_product_id"), F.col("price_minor"), F.col("title")))
    return out.select(*OBSERVATION)


def extract_cards(pages: DataFrame) -> DataFrame:
    """Product cards in attribute form. A card runs to the next card; without id, title or price it is left out."""
    card = F.col("card")

    def attribute(*names: str) -> Column:
        return F.coalesce(*[tx.blank_to_null(F.regexp_extract(card, rf"(?is)\b{n}=[\"']([^\"']+)[\"']", 1)) for n in names])

    def element(css: str) -> Column:
        return tx.blank_to_null(F.regexp_extract(card, rf"(?is)<[^>]*class=[\"'](?:[^\"']*[\s])?{css}[^\"']*[\"'][^>]*>([^<]+)<", 1))

    rows = pages.withColumn("card", F.explode(F.regexp_extract_all("html", F.lit(CARD), F.lit(0))))
    title_attribute, title_element = attribute("title"), element("product-title")
    title = F.when(F.col("source_key") == "magnit", F.coalesce(title_element, title_attribute, attribute("alt"))).otherwise(
        F.coalesce(title_attribute, title_element, attribute("alt")))
    rows = (rows.withColumn("source_product_id", attribute("data-id")).withColumn("title", title)
            .withColumn("_price", F.coalesce(attribute("data-price"), element("price")))
            .where(F.col("source_product_id").isNotNull() & F.col("title").isNotNull() & F.col("_price").isNotNull()))
    return _finish(
        rows.withColumn("url", _absolute(F.col("source_key"), attribute("href"), F.col("source_product_id")))
        .withColumn("brand", F.lit(None).cast("string")).withColumn("size_text", F.lit(None).cast("string"))
        .withColumn("barcode", attribute("data-barcode", "data-ean", "data-gtin"))
        .withColumn("price_minor", price_text_to_minor(F.col("_price")))
        .withColumn("old_price_minor", _positive(price_text_to_minor(F.coalesce(attribute("data-old-price"), element("old-price")))))
        .withColumn("promo_price_minor", _positive(price_text_to_minor(F.coalesce(attribute("data-promo-price"), element("promo-price")))))
        .withColumn("availability", F.when(card.rlike(OUT_OF_STOCK), "out_of_stock").otherwise("in_stock")))


def has_more(html: Column) -> Column:
    """Whether a page points to a further page."""
    return html.rlike(MORE_PAGES)


def _chosen(name: str) -> Column:
    """A price field under its source's spellings; store prices where the page shows a store."""
    metro = F.when(F.col("price_context") == "store_visit", jf.first_at(*FIELDS["metro_store"][name])).otherwise(
        jf.first_at(*FIELDS["metro_online"][name]))
    return (F.when(F.col("source_key") == "metro_online", metro)
            .when(F.col("source_key") == "x5_5ka", jf.first_at(*FIELDS["x5_5ka"][name]))
            .otherwise(jf.first_at(*FIELDS["default"][name])))


def _flatten_items(rows: DataFrame) -> DataFrame:
    """Rows with a variant ``item`` to observations, in steps: fields, price values, prices, observation."""
    paths = [p for fields in FIELDS.values() for spellings in fields.values() for p in spellings]
    paths += [p for spellings in SHARED.values() for p in spellings] + ["$.stock", "$.available"]
    rows = rows.withColumn("_product", F.coalesce(jf.field(F.col("item"), "$.product"), F.col("item")))
    rows = jf.spread(rows, "_product", paths)
    rows = rows.select(
        "page_id", "source_key", "observed_at", jf.as_text(jf.first_at(*FIELDS["default"]["id"])).alias("source_product_id"),
        *[_chosen(n).alias(f"_{n}") for n in ("price", "old", "promo")],
        *[jf.as_text(jf.first_at(*SHARED[n])).alias(f"_{n}") for n in SHARED],
        jf.only_number(jf.at("$.stock")).alias("_stock"), jf.at("$.available").cast("string").alias("_available"))
    rows = rows.where(F.col("source_product_id").isNotNull()).select(
        "*", F.coalesce(jf.online_price(F.col("_price")), F.lit(0).cast("bigint")).alias("price_minor"),
        _positive(jf.online_price(F.col("_old"))).alias("_old_minor"), _positive(jf.online_price(F.col("_promo"))).alias("_promo_minor"))
    metro_in = F.coalesce((F.col("_available") == "true") & (F.col("_stock") > 0), F.lit(False))
    gone = F.when(F.col("source_key") == "metro_online", ~metro_in).otherwise(
        F.coalesce(F.col("_available") == "false", F.lit(False)) | F.coalesce(F.col("_stock") == 0, F.lit(False)))
    return _finish(rows.select(
        "*", _absolute(F.col("source_key"), F.col("_url"), F.col("source_product_id")).alias("url"),
        F.coalesce("_title", F.lit("")).alias("title"), F.col("_brand").alias("brand"), F.col("_size").alias("size_text"),
        F.col("_barcode").alias("barcode"), F.nullif("_old_minor", "price_minor").alias("old_price_minor"),
        F.nullif("_promo_minor", "price_minor").alias("promo_price_minor"),
        F.when(gone, "out_of_stock").otherwise("in_stock").alias("availability")))


def _embedded_items(html: Column) -> Column:
    """Items of the first embedded document that has any, null when none has."""
    scripts = F.concat(F.regexp_extract_all(html, F.lit(SCRIPT_JSON), F.lit(1)),
                       F.regexp_extract_all(html, F.lit(NUXT_JSON), F.lit(1)))
    found = F.transform(scripts, lambda s: F.coalesce(*[jf.array_field(F.try_parse_json(s), p) for p in ITEM_PATHS]))
    return F.get(F.filter(found, lambda a: a.isNotNull()), F.lit(0))


def extract_embedded_json(pages: DataFrame) -> DataFrame:
    """Items of embedded JSON documents."""
    rows = pages.withColumn("_items", _embedded_items(F.col("html"))).where(F.col("_items").isNotNull())
    return _flatten_items(rows.withColumn("item", F.explode("_items")))


def extract_pages(pages: DataFrame) -> DataFrame:
    """S6 with S5 as fallback: a page without usable embedded items is read through its cards."""
    marked = pages.withColumn("_items", _embedded_items(F.col("html")))
    through_json = marked.where(F.col("_items").isNotNull()).withColumn("item", F.explode("_items"))
    through_cards = marked.where(F.col("_items").isNull()).select(*pages.columns)
    return _flatten_items(through_json).unionByName(extract_cards(through_cards))


def flatten_api(payloads: DataFrame) -> DataFrame:
    """API payload column ``payload`` (JSON text) to observations."""
    doc = F.try_parse_json("payload")
    rows = payloads.withColumn("_doc", doc).withColumn(
        "item", F.explode(F.coalesce(*[jf.array_field(F.col("_doc"), p) for p in API_PATHS])))
    return _flatten_items(rows)


def api_has_more(payload: Column) -> Column:
    doc = F.try_parse_json(payload)
    flag = F.coalesce(*[F.try_variant_get(doc, p, "boolean") for p in MORE_PATHS])
    return F.coalesce(flag, jf.only_text(jf.field(doc, "$.next")).isNotNull())


ADAPTERS = {key: extract_pages for key in fv.SOURCE_BASE_URL}


def page_titles(pages: DataFrame) -> DataFrame:
    """Title, number of links and of paragraphs of a stored page."""
    html = F.col("html")
    return pages.select(
        "page_id", F.regexp_extract(html, r"<title>([^<]*)</title>", 1).alias("title"),
        F.size(F.regexp_extract_all(html, F.lit(r"href=\"([^\"]+)\""), F.lit(1))).alias("links"),
        F.size(F.regexp_extract_all(html, F.lit(r"<p>"), F.lit(0))).alias("paragraphs"), has_more(html).alias("has_more"))
