"""Domain tables derived from the driver tables, in Spark and, for the checks, in SQL.

Each table is a projection (at most one join) of a driver table, so every query grows with the data given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelflens.functions import fixed_values as fv
from shelflens.functions.money import round_half_up

# Words given to derived products and stores.
BRAND_WORDS = ["nivea", "ariel", "palmolive", "dove", "colgate", "persil", "milka", "nescafe", "Яшкино", "Splat",
               "Президент", "Мартин"]
VARIANT_WORDS = ["кокос", "алоэ", "лимон", "лаванда", "мята", "тыква", "яблоко", "ромашка"]
STORE_WORDS = ["Спар", "Metro", "Магнит", "Пятёрочка", "Лента", "Spar Express", "Ашан"]
DECISIONS = ["auto", "accepted", "ai_review", "corrected"]


def _pick(words: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (index + 1).cast("int"))


def _sql_pick(words: list[str], index: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + f"][({index}) + 1]"


class Domain:
    def __init__(self, tables) -> None:
        self.t = tables

    @property
    def observations(self) -> DataFrame:
        c = F.col
        return self.t.lineitem.select(
            c("l_partkey").alias("product_id"), c("l_suppkey").alias("store_id"), c("l_orderkey").alias("run_id"),
            (c("l_suppkey") % 8).alias("source_id"),
            round_half_up(c("l_extendedprice") / c("l_quantity") * 100).alias("price_minor"),
            c("l_shipdate").cast("timestamp").alias("observed_at"),
            (c("l_orderkey") * 8 + c("l_linenumber")).alias("obs_id"),
            F.when(c("l_returnflag") == "R", "out_of_stock").otherwise("in_stock").alias("availability"),
            F.when(c("l_linestatus") == "O", "online").otherwise("photo").alias("source"),
            (c("l_orderkey") % 2 + 1).cast("int").alias("week"))

    @property
    def catalog(self) -> DataFrame:
        return self._catalog(self.t.part)

    @property
    def _dealt_catalog(self) -> DataFrame:
        """For work that is heavy per row: rows are dealt out before any text is made, as small files are few tasks."""
        return self._catalog(self.t.part.repartition("p_partkey"))

    def _catalog(self, part: DataFrame) -> DataFrame:
        c = F.col
        n = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
        brand = F.when(n <= len(BRAND_WORDS), _pick(BRAND_WORDS, F.least(n, F.lit(len(BRAND_WORDS))) - 1)).otherwise(
            F.concat(F.lit("Brand"), n.cast("string")))
        size = F.concat((c("p_size") * 10).cast("string"), F.when(c("p_size") % 2 == 0, "мл").otherwise("г"))
        name = F.concat_ws(" ", brand, _pick(fv.FAMILIES, c("p_partkey") * 7 % len(fv.FAMILIES)),
                           F.replace(c("p_name"), F.lit(" "), F.lit("")), _pick(VARIANT_WORDS, c("p_size") % 8), size)
        return part.select(
            c("p_partkey").alias("product_id"), (c("p_partkey") + 4600000000000).cast("string").alias("external_sku"),
            F.when(c("p_partkey") % 2 == 0, (c("p_partkey") + 4800000000000).cast("string")).alias("barcode"),
            name.alias("name"), F.when(c("p_partkey") % 5 != 0, brand).alias("brand"),
            F.when(c("p_partkey") % 3 != 0, size).alias("size_text"),
            F.when(c("p_partkey") % 11 != 0, round_half_up(c("p_retailprice") * 100 * (1 + c("p_size") / 10.0))
                   ).alias("own_price_minor"),
            F.when(c("p_size") % 3 == 0, "chemistry").when(c("p_size") % 3 == 1, "products").alias("department"),
            (c("p_partkey") % 17 != 0).alias("is_active"), (c("p_partkey") % 365).cast("int").alias("created_day"))

    @property
    def stores(self) -> DataFrame:
        c = F.col
        named = self.t.supplier.join(self.t.nation, c("s_nationkey") == c("n_nationkey"))
        word = _pick(STORE_WORDS, c("s_suppkey") % 7)
        return named.select(
            c("s_suppkey").alias("store_id"),
            F.when(c("s_suppkey") % 3 == 0, word).otherwise(F.concat_ws(" ", word, c("s_suppkey").cast("string"))).alias("name"),
            c("n_name").alias("address"), (c("s_suppkey") % 5 == 0).alias("is_own"),
            F.when(c("s_suppkey") % 4 != 0, c("s_suppkey") % 7).alias("competitor_id"))

    @property
    def items(self) -> DataFrame:
        c = F.col
        price = round_half_up(c("l_extendedprice") / c("l_quantity") * 100)
        rows = self.t.lineitem.join(self.t.orders.select("o_orderkey", "o_orderstatus"), c("l_orderkey") == c("o_orderkey"))
        status = (F.when(c("l_returnflag") == "R", "needs_review").when(c("l_returnflag") == "A", "matched")
                  .when(c("o_orderstatus") == "F", "confirmed").when(c("o_orderstatus") == "O", "unmatched")
                  .otherwise("recognized"))
        return rows.select(
            *self._line_columns(), c("l_orderkey").alias("session_id"),
            (c("l_orderkey") * 10 + c("l_linenumber") % 2).alias("photo_id"), status.alias("status"),
            price.alias("price_minor"),
            F.when(c("l_discount") >= 0.05, round_half_up(price * (1 + c("l_discount")))).alias("old_price_minor"),
            F.when(c("l_discount") >= 0.08, round_half_up(price * (1 - c("l_discount")))).alias("promo_price_minor"),
            (F.floor((0.6 + c("l_tax") * 5) * 10000 + 0.5) / 10000).alias("confidence"),
            (F.floor((0.5 + c("l_quantity") / 100) * 10000 + 0.5) / 10000).alias("link_confidence"),
            F.when(c("l_linenumber") % 3 == 0, None).when(c("l_partkey") % 2 == 0, "products").otherwise("chemistry").alias("department"),
            F.concat(F.lit("товар "), c("l_partkey").cast("string")).alias("raw_name"), F.lit(None).cast("string").alias("brand"),
            F.when(c("l_linenumber") % 2 == 1, "10 мл").alias("size_text"),
            F.when(c("l_linenumber") % 4 == 1, "проверить цену").alias("review_reason"))

    @staticmethod
    def _line_columns() -> list[Column]:
        """What an item has from its line alone."""
        c = F.col
        item = F.concat_ws("-", *[c(x).cast("string") for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                           F.date_format("l_shipdate", "yyyyMMdd"))
        return [item.alias("item_id"), c("l_shipdate").cast("timestamp").alias("created_at"), c("l_partkey").alias("_part"),
                c("l_linenumber").alias("_line"), c("l_discount").alias("_discount"), c("l_quantity").alias("_quantity")]

    @property
    def lines(self) -> DataFrame:
        """Lines as items without what their orders tell, for tables that only join ``items``: a line without an order meets none."""
        return self.t.lineitem.where("l_orderkey is not null").select(*self._line_columns())

    def session_items(self) -> DataFrame:
        return self.items.drop("_part", "_line", "_discount", "_quantity")

    @property
    def matches(self) -> DataFrame:
        return self.matches_of(self.items)

    def matches_of(self, items: DataFrame) -> DataFrame:
        c = F.col
        rows = items.where((c("_part") + c("_line")) % 4 != 0)
        return rows.select(
            F.concat(c("item_id"), F.lit("-m")).alias("match_id"), "item_id", c("_part").alias("product_id"),
            (F.floor((0.5 + c("_discount") * 5) * 10000 + 0.5) / 10000).alias("score"),
            _pick(DECISIONS, c("_line") % 4).alias("decision"), (c("_line") % 6 != 5).alias("is_active"),
            c("created_at").alias("decided_at"))

    @property
    def evidence(self) -> DataFrame:
        return self.evidence_of(self.items)

    def evidence_of(self, items: DataFrame) -> DataFrame:
        c = F.col
        n = F.when(c("_quantity") > 40, 2).when(c("_quantity") > 10, 1).otherwise(0)
        rows = items.where(n > 0).select("item_id", F.explode(F.sequence(F.lit(1), n)).alias("k"))
        key = F.concat_ws("-e", "item_id", c("k").cast("string"))
        return rows.select(key.alias("evidence_id"), "item_id", F.concat(F.lit("crops/"), key, F.lit(".jpg")).alias("storage_path"))

    @property
    def sessions(self) -> DataFrame:
        return self.t.orders.select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("customer_id"))

    @property
    def photos(self) -> DataFrame:
        c = F.col
        p = F.substring("o_orderpriority", 1, 1)
        status = (F.when(c("o_orderstatus") == "F", "processed").when(c("o_orderstatus") == "P", "failed")
                  .when(p == "1", "uploaded").when(p == "2", "queued").when(p == "3", "processing").otherwise("processed"))
        return self.t.orders.select(
            c("o_custkey").alias("session_id"), c("o_orderkey").alias("photo_id"), status.alias("status"),
            F.when(c("o_orderkey") % 3 == 0, "products").when(c("o_orderkey") % 3 == 1, "chemistry").alias("department"),
            c("o_orderdate").cast("timestamp").alias("created_at"))

    @property
    def runs(self) -> DataFrame:
        c = F.col
        status = F.when(c("event_type") == "error", "failed").when(c("event_type") == "click", "running").otherwise("succeeded")
        return self.t.events.select(c("event_id").alias("run_id"), c("user_id").alias("source_id"), status.alias("status"),
                                    c("ts").cast("timestamp").alias("started_at"), c("value").alias("seconds"))

    @property
    def rules(self) -> DataFrame:
        c = F.col
        kinds = fv.DOMAINS["alert_type"]
        return self.t.nation.select(
            F.lpad(c("n_nationkey").cast("string"), 3, "0").alias("rule_id"),
            F.when(c("n_nationkey") % 3 != 0, (c("n_nationkey") % 8).cast("bigint")).alias("source_id"),
            _pick(kinds, c("n_nationkey") % 4).alias("alert_type"),
            F.when(c("n_nationkey") % 4 == 3, c("n_nationkey") % 3 + 1).otherwise(c("n_nationkey") * 2 + 5)
            .cast("decimal(8,2)").alias("threshold"), (c("n_nationkey") % 6 != 5).alias("enabled"))

    @property
    def source_products(self) -> DataFrame:
        """Retailer spelling of each catalogue product: some lose the brand, the size or a word."""
        c = F.col
        parts = F.split("name", " ")
        kept = F.filter(parts, lambda w, i: ~(((c("product_id") % 3 == 0) & (i == 0)) | ((c("product_id") % 4 == 1) & (i == 4))
                                              | ((c("product_id") % 5 == 2) & (i == 3))))
        return self._dealt_catalog.select(c("product_id").alias("item_id"), F.array_join(kept, " ").alias("text"))

    @property
    def match_products(self) -> DataFrame:
        from shelflens.functions.text import match_text
        return self._dealt_catalog.withColumn("text", match_text(F.col("name"), F.col("brand"), F.col("size_text")))


# The same tables in SQL, written on their own as common table expressions.
SQL = {
    "obs": """obs AS (SELECT l_partkey AS product_id, l_suppkey AS store_id, l_orderkey AS run_id, l_suppkey % 8 AS source_id,
  CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT) AS price_minor, l_shipdate AS observed_at,
  l_orderkey * 8 + l_linenumber AS obs_id, CASE WHEN l_returnflag = 'R' THEN 'out_of_stock' ELSE 'in_stock' END AS availability,
  CASE WHEN l_linestatus = 'O' THEN 'online' ELSE 'photo' END AS source, l_orderkey % 2 + 1 AS week FROM lineitem)""",
    "cat": f"""cat0 AS (SELECT *, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS bn,
  CAST(p_size * 10 AS VARCHAR) || CASE WHEN p_size % 2 = 0 THEN 'мл' ELSE 'г' END AS sz FROM part),
cat1 AS (SELECT *, CASE WHEN bn <= 12 THEN {_sql_pick(BRAND_WORDS, 'least(bn, 12) - 1')} ELSE 'Brand' || bn END AS bw FROM cat0),
cat AS (SELECT p_partkey AS product_id, CAST(p_partkey + 4600000000000 AS VARCHAR) AS external_sku,
  CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey + 4800000000000 AS VARCHAR) END AS barcode,
  bw || ' ' || {_sql_pick(fv.FAMILIES, 'p_partkey * 7 % 22')} || ' ' || replace(p_name, ' ', '') || ' '
  || {_sql_pick(VARIANT_WORDS, 'p_size % 8')} || ' ' || sz AS name,
  CASE WHEN p_partkey % 5 <> 0 THEN bw END AS brand, CASE WHEN p_partkey % 3 <> 0 THEN sz END AS size_text,
  CASE WHEN p_partkey % 11 <> 0 THEN CAST(floor(p_retailprice * 100 * (1 + p_size / 10.0::DOUBLE) + 0.5) AS BIGINT) END AS own_price_minor,
  CASE p_size % 3 WHEN 0 THEN 'chemistry' WHEN 1 THEN 'products' END AS department,
  p_partkey % 17 <> 0 AS is_active, CAST(p_partkey % 365 AS INTEGER) AS created_day FROM cat1)""",
    "stores": f"""stores AS (SELECT s_suppkey AS store_id, {_sql_pick(STORE_WORDS, 's_suppkey % 7')}
  || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE ' ' || s_suppkey END AS name, n_name AS address, s_suppkey % 5 = 0 AS is_own,
  CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 7 END AS competitor_id FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    "items": """items0 AS (SELECT *, CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT) AS price FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey),
items AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS item_id,
  l_orderkey AS session_id, l_orderkey * 10 + l_linenumber % 2 AS photo_id,
  CASE WHEN l_returnflag = 'R' THEN 'needs_review' WHEN l_returnflag = 'A' THEN 'matched' WHEN o_orderstatus = 'F' THEN 'confirmed'
    WHEN o_orderstatus = 'O' THEN 'unmatched' ELSE 'recognized' END AS status, price AS price_minor,
  CASE WHEN l_discount >= 0.05::DOUBLE THEN CAST(floor(price * (1::DOUBLE + l_discount) + 0.5) AS BIGINT) END AS old_price_minor,
  CASE WHEN l_discount >= 0.08::DOUBLE THEN CAST(floor(price * (1::DOUBLE - l_discount) + 0.5) AS BIGINT) END AS promo_price_minor,
  floor((0.6::DOUBLE + l_tax * 5) * 10000 + 0.5) / 10000 AS confidence,
  floor((0.5::DOUBLE + l_quantity / 100) * 10000 + 0.5) / 10000 AS link_confidence,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_partkey % 2 = 0 THEN 'products' ELSE 'chemistry' END AS department,
  'товар ' || l_partkey AS raw_name, CASE WHEN l_linenumber % 2 = 1 THEN '10 мл' END AS size_text,
  CASE WHEN l_linenumber % 4 = 1 THEN 'проверить цену' END AS review_reason, l_shipdate AS created_at,
  l_partkey AS part, l_linenumber AS line, l_discount AS discount, l_quantity AS quantity FROM items0)""",
    "matches": f"""matches AS (SELECT item_id || '-m' AS match_id, item_id, part AS product_id,
  floor((0.5::DOUBLE + discount * 5) * 10000 + 0.5) / 10000 AS score, {_sql_pick(DECISIONS, 'line % 4')} AS decision,
  line % 6 <> 5 AS is_active, created_at AS decided_at FROM items WHERE (part + line) % 4 <> 0)""",
    "evidence": """evidence AS (SELECT item_id || '-e' || k AS evidence_id, item_id, 'crops/' || item_id || '-e' || k || '.jpg' AS storage_path
  FROM items, (VALUES (1), (2)) v(k) WHERE (k = 1 AND quantity > 10) OR (k = 2 AND quantity > 40))""",
    "photos": """photos AS (SELECT o_custkey AS session_id, o_orderkey AS photo_id, CASE WHEN o_orderstatus = 'F' THEN 'processed'
  WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_orderpriority LIKE '1%' THEN 'uploaded' WHEN o_orderpriority LIKE '2%' THEN 'queued'
  WHEN o_orderpriority LIKE '3%' THEN 'processing' ELSE 'processed' END AS status,
  CASE o_orderkey % 3 WHEN 0 THEN 'products' WHEN 1 THEN 'chemistry' END AS department, o_orderdate AS created_at FROM orders)""",
    "runs": """runs AS (SELECT event_id AS run_id, user_id AS source_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running'
  ELSE 'succeeded' END AS status, ts AS started_at, value AS seconds FROM events)""",
    "rules": f"""rules AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS rule_id, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey % 8 END AS source_id,
  {_sql_pick(fv.DOMAINS['alert_type'], 'n_nationkey % 4')} AS alert_type,
  CAST(CASE WHEN n_nationkey % 4 = 3 THEN n_nationkey % 3 + 1 ELSE n_nationkey * 2 + 5 END AS DOUBLE) AS threshold,
  n_nationkey % 6 <> 5 AS enabled FROM nation)""",
    "src": """src AS (SELECT product_id AS item_id, array_to_string(list_filter([
    CASE WHEN product_id % 3 <> 0 THEN split_part(name, ' ', 1) END, split_part(name, ' ', 2), split_part(name, ' ', 3),
    CASE WHEN product_id % 5 <> 2 THEN split_part(name, ' ', 4) END,
    CASE WHEN product_id % 4 <> 1 THEN split_part(name, ' ', 5) END], lambda w: w IS NOT NULL), ' ') AS text FROM cat)""",
}
NEEDS = {"matches": ["items"], "evidence": ["items"], "src": ["cat"]}


def with_tables(*names: str) -> str:
    """``WITH`` clause of the named tables and what they build on."""
    order: list[str] = []
    for name in names:
        for part in [*NEEDS.get(name, []), name]:
            if part not in order:
                order.append(part)
    return "WITH " + ",\n".join(SQL[n] for n in order)
