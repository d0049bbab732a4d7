"""Text normalisers, catalogue matching and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelflens.functions import boxes, fixed_values as fv, money, text as tx
from shelflens.operators import candidates as cj, decisions as dc, review as rv
from shelflens.plans.domain import with_tables
from shelflens.plans.registry import query
from shelflens.session import materialize


def _map_sql(pairs: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"


def _list_sql(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


BRAND_SET = list(dict.fromkeys(fv.BRANDS.values()))


def norm_sql(e: str) -> str:
    return f"trim(regexp_replace(replace(lower({e}), 'ё', 'е'), '[^a-zа-я0-9]+', ' ', 'g'))"


def tokens_sql(e: str) -> str:
    """N8 in SQL: brand, alias, stem, filters, first occurrence order."""
    spell = _map_sql({**fv.TOKEN_ALIASES, **fv.BRANDS})
    stem = (f"CASE WHEN regexp_full_match(w, '[а-я]{{5,}}') THEN regexp_replace(w, '({fv.STEM_ENDINGS})$', '') ELSE w END")
    mapped = f"list_transform(string_split({norm_sql(e)}, ' '), lambda w: coalesce({spell}[w], {stem}))"
    kept = (f"list_filter({mapped}, lambda w: length(w) > 1 AND NOT regexp_full_match(w, '\\d+') "
            f"AND NOT list_contains({_list_sql(fv.STOP_WORDS)}, w))")
    return f"list_filter({kept}, lambda w, i: list_position({kept}, w) = i)"


def size_sql(e: str) -> str:
    p = r"(\d+(?:[.,]\d+)?)\s*(кг|kg|г|гр|g|л|l|мл|ml|шт)"
    s = f"replace(lower({e}), 'ё', 'е')"
    unit = f"regexp_extract({s}, '{p}', 2)"
    n = f"CAST(replace(regexp_extract({s}, '{p}', 1), ',', '.') AS DOUBLE)"
    return (f"CASE WHEN {unit} IN ('кг','kg') THEN CAST(CAST(floor({n} * 1000 + 0.5) AS BIGINT) AS VARCHAR) || 'g' "
            f"WHEN {unit} IN ('г','гр','g') THEN CAST(CAST(floor({n} + 0.5) AS BIGINT) AS VARCHAR) || 'g' "
            f"WHEN {unit} IN ('л','l') THEN CAST(CAST(floor({n} * 1000 + 0.5) AS BIGINT) AS VARCHAR) || 'ml' "
            f"WHEN {unit} IN ('мл','ml') THEN CAST(CAST(floor({n} + 0.5) AS BIGINT) AS VARCHAR) || 'ml' "
            f"WHEN {unit} <> '' THEN CAST(CAST(floor({n} + 0.5) AS BIGINT) AS VARCHAR) || 'pc' END")


def fold_sql(e: str) -> str:
    """N6 as the chain of replacements: every latin spelling, then every Cyrillic letter."""
    out = f"lower({e})"
    for lat, ru in [("a", "а"), ("b", "б"), ("v", "в"), ("g", "г"), ("d", "д"), ("e", "е"), ("zh", "ж"), ("z", "з"),
                    ("i", "и"), ("y", "й"), ("k", "к"), ("l", "л"), ("m", "м"), ("n", "н"), ("o", "о"), ("p", "п"),
                    ("r", "р"), ("s", "с"), ("t", "т"), ("u", "у"), ("f", "ф"), ("kh", "х"), ("ts", "ц"), ("ch", "ч"),
                    ("sh", "ш"), ("sch", "щ"), ("yu", "ю"), ("ya", "я")]:
        out = f"replace({out}, '{lat}', '{ru}')"
    for ru, lat in fv.RU_TO_LAT_FOLD.items():
        out = f"replace({out}, '{ru}', '{lat}')"
    return out


PRICE_TEXT = "CAST(floor(l_extendedprice) AS BIGINT) || ',' || lpad(CAST(l_linenumber * 7 AS VARCHAR), 2, '0') || ' ₽'"


@query("n1_price_to_minor", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(floor(CAST(floor(l_extendedprice) AS BIGINT) * 100 + l_linenumber * 7 + 0.0) AS BIGINT) AS rub_minor,
  CAST(floor(CAST(CAST(floor(l_extendedprice) AS BIGINT) || '.' || lpad(CAST(l_linenumber * 7 AS VARCHAR), 2, '0') AS DOUBLE) * 0.17::DOUBLE * 100 + 0.5) AS BIGINT) AS kzt_minor,
  CASE WHEN l_extendedprice > 10000 THEN CAST(floor(l_extendedprice + 0.5) AS BIGINT) ELSE CAST(floor(l_extendedprice * 1.0::DOUBLE * 100 + 0.5) AS BIGINT) END AS number_minor,
  CAST(0 AS BIGINT) AS junk_minor FROM lineitem""")
def n1_price_to_minor(t):
    c = F.col
    whole = F.floor("l_extendedprice").cast("bigint").cast("string")
    cents = F.lpad((c("l_linenumber") * 7).cast("string"), 2, "0")
    label = F.concat(whole, F.lit(","), cents, F.lit(" ₽"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", money.price_text_to_minor(label).alias("rub_minor"),
        money.price_text_to_minor(F.concat(whole, F.lit("."), cents), F.lit("KZT")).alias("kzt_minor"),
        money.price_number_to_minor(c("l_extendedprice")).alias("number_minor"),
        money.price_text_to_minor(F.concat(F.lit("нет цены "), c("l_returnflag"))).alias("junk_minor"))


@query("n1b_recognition_price", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(floor(l_extendedprice) AS BIGINT) * 100 + l_linenumber * 10 AS text_minor,
  CASE WHEN l_extendedprice > 9999 THEN CAST(floor(l_extendedprice + 0.5) AS BIGINT) ELSE CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) END AS number_minor,
  CAST(floor(l_extendedprice) AS BIGINT) * 100 + 50 AS import_minor, CAST(NULL AS BIGINT) AS form_minor FROM lineitem""")
def n1b_recognition_price(t):
    c = F.col
    whole = F.floor("l_extendedprice").cast("bigint").cast("string")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        money.recognition_text_to_minor(F.concat(F.lit("цена "), whole, F.lit(" , "), c("l_linenumber").cast("string"), F.lit(" руб"))).alias("text_minor"),
        money.recognition_number_to_minor(c("l_extendedprice")).alias("number_minor"),
        money.import_price_to_minor(F.concat(F.lit(" "), whole, F.lit(",5 "))).alias("import_minor"),
        money.form_price_to_minor(F.concat(F.lit("-"), whole)).alias("form_minor"))


@query("n2_price_with_currency", """SELECT o_orderkey, cur AS currency, CAST(floor(CAST(amount AS DOUBLE) * rate * 100 + 0.5) AS BIGINT) AS price_minor FROM (
  SELECT o_orderkey, CAST(o_custkey + 1 AS VARCHAR) || '.5' AS amount, ['RUB','USD','EUR','KZT','UAH'][o_orderkey % 5 + 1] AS cur,
  [1.0::DOUBLE, 90.0::DOUBLE, 100.0::DOUBLE, 0.17::DOUBLE, 2.5::DOUBLE][o_orderkey % 5 + 1] AS rate FROM orders)""")
def n2_price_with_currency(t):
    c = F.col
    names = F.array(*[F.lit(x) for x in ("₽", "usd", "EUR", "KZT", "UAH")])
    label = F.concat((c("o_custkey") + 1).cast("string"), F.lit(",5 "), F.element_at(names, (c("o_orderkey") % 5 + 1).cast("int")))
    return t.orders.select("o_orderkey", money.price_with_currency(label).alias("p")).select("o_orderkey", "p.currency", "p.price_minor")


@query("n3_size_text", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size || 'мл' WHEN 1 THEN p_size || 'г' WHEN 2 THEN p_size || 'л'
  WHEN 3 THEN p_size || 'kг' ELSE p_size || 'шт' END AS size_text FROM part""")
def n3_size_text(t):
    units = F.array(*[F.lit(x) for x in (" ML", " gramm", " l", " kg", " pcs")])
    raw = F.concat(F.col("p_size").cast("string"), F.element_at(units, (F.col("p_partkey") % 5 + 1).cast("int")))
    return t.part.select("p_partkey", tx.size_text_norm(raw).alias("size_text"))


@query("n4_barcode", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey + 4600000000000 AS VARCHAR) WHEN p_partkey % 3 = 1 THEN NULL
  ELSE CAST(p_partkey + 10000000 AS VARCHAR) END AS barcode, CASE WHEN p_partkey % 3 = 1 THEN NULL ELSE CAST(p_partkey + 10000000 AS VARCHAR) END AS cell_code FROM part""")
def n4_barcode(t):
    k = F.col("p_partkey")
    raw = (F.when(k % 3 == 0, F.concat(F.lit("EAN "), (k + 4600000000000).cast("string"))).when(k % 3 == 1, "12-34")
           .otherwise(F.concat_ws(" ", (k + 10000000).cast("string"))))
    cell = F.when(k % 3 == 1, F.lit("0")).otherwise(F.concat(F.lit(" "), (k + 10000000).cast("string"), F.lit(".0 ")))
    return t.part.select("p_partkey", tx.barcode_norm(raw).alias("barcode"), tx.template_barcode(cell).alias("cell_code"))


def _one_way_sql(e: str) -> str:
    out = f"lower({e})"
    for ru, lat in fv.RU_TO_LAT_ONE_WAY.items():
        out = f"replace({out}, '{ru}', '{lat}')"
    return out


@query("n5_translit", f"{with_tables('cat')} SELECT product_id, {_one_way_sql('name')} AS latin FROM cat")
def n5_translit(t):
    return t.domain.catalog.select("product_id", tx.translit_ru_lat(F.col("name")).alias("latin"))


@query("n6_translit_fold", f"{with_tables('cat')} SELECT product_id, {fold_sql('name')} AS folded FROM cat")
def n6_translit_fold(t):
    return t.domain.catalog.select("product_id", tx.translit_fold(F.col("name")).alias("folded"))


@query("n7_title_norm", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^а-яёa-z0-9\s-]', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM documents""")
def n7_title_norm(t):
    return t.wide("documents").select("doc_id", tx.title_norm(F.col("text")).alias("title"))


@query("n8_tokens", f"""WITH words AS (SELECT doc_id, unnest(string_split({norm_sql('text')}, ' ')) AS w, generate_subscripts(string_split({norm_sql('text')}, ' '), 1) AS i FROM documents),
base AS (SELECT doc_id, i, coalesce({_map_sql({**fv.TOKEN_ALIASES, **fv.BRANDS})}[w], CASE WHEN regexp_full_match(w, '[а-я]{{5,}}') THEN regexp_replace(w, '({fv.STEM_ENDINGS})$', '') ELSE w END) AS w FROM words),
firsts AS (SELECT doc_id, w, min(i) AS i FROM base WHERE length(w) > 1 AND NOT regexp_full_match(w, '\\d+') AND NOT list_contains({_list_sql(fv.STOP_WORDS)}, w) GROUP BY doc_id, w)
SELECT d.doc_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS tokens FROM documents d LEFT JOIN firsts f ON d.doc_id = f.doc_id GROUP BY d.doc_id""")
def n8_tokens(t):
    return t.wide("documents").select("doc_id", F.array_join(tx.tokenize(F.col("text")), " ").alias("tokens"))


@query("n9_stem", f"""SELECT product_id, CASE WHEN regexp_full_match(w, '[а-я]{{5,}}') THEN regexp_replace(w, '({fv.STEM_ENDINGS})$', '') ELSE w END AS stem
  FROM ({with_tables('cat')} SELECT product_id, lower(split_part(name, ' ', 2)) AS w FROM cat)""")
def n9_stem(t):
    return t.domain.catalog.select("product_id", tx.stem(F.lower(F.get(F.split("name", " "), F.lit(1)))).alias("stem"))


@query("n10_size_canon", f"{with_tables('cat')} SELECT product_id, {size_sql('name')} AS size FROM cat")
def n10_size_canon(t):
    return t.domain.catalog.select("product_id", tx.size_canon(F.col("name")).alias("size"))


FEATURES = f"""feats AS (SELECT *, list_filter(toks, lambda w: list_contains({_list_sql(BRAND_SET)}, w))[1] AS b,
  list_filter({_list_sql(fv.FAMILIES)}, lambda w: list_contains(toks, w))[1] AS f,
  list_filter({_list_sql(fv.VARIANT_WORDS)}, lambda w: list_contains(toks, w)) AS v,
  list_filter({_list_sql(fv.PACKAGING_WORDS)}, lambda w: list_contains(toks, w)) AS pk FROM src_tokens)"""


@query("n11_features", f"""{with_tables('cat')}, src_tokens AS (SELECT product_id, {tokens_sql('name')} AS toks, {size_sql('name')} AS sz FROM cat), {FEATURES}
  SELECT product_id, b AS brand, f AS family, b || ':' || f AS base_family, array_to_string(v, ' ') AS variants, array_to_string(pk, ' ') AS packaging, sz AS size FROM feats""")
def n11_features(t):
    f = tx.match_features(F.col("tokens"), F.col("size"))
    rows = t.domain.catalog.select("product_id", tx.tokenize(F.col("name")).alias("tokens"), tx.size_canon(F.col("name")).alias("size"))
    return rows.select("product_id", f.alias("f")).select(
        "product_id", "f.brand", "f.family", "f.base_family", F.array_join("f.variants", " ").alias("variants"),
        F.array_join("f.packaging", " ").alias("packaging"), "f.size")


def key_sql(name: str) -> str:
    strong = f"list_sort(list_filter({tokens_sql(name)}, lambda w: NOT list_contains({_list_sql(fv.WEAK_WORDS)}, w)))"
    return (f"CASE WHEN len({strong}) >= 2 THEN array_to_string(({strong}), ' ') || coalesce(' |' || {size_sql(name)}, '') ELSE '' END")


@query("n12_match_key", f"{with_tables('cat', 'src')} SELECT item_id, {key_sql('text')} AS match_key FROM src")
def n12_match_key(t):
    none = F.lit(None).cast("string")
    return t.domain.source_products.select("item_id", tx.match_key(F.col("text"), none, none, none, none).alias("match_key"))


@query("n15_product_text_norm", r"""SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(lower(text), '["''`´«»“”]', '', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')), '') AS norm FROM documents""")
def n15_product_text_norm(t):
    return t.wide("documents").select("doc_id", tx.product_text_norm(F.col("text")).alias("norm"))


@query("n16_store_label", f"""{with_tables('stores')} SELECT store_id, trim(name) AS name, nullif(trim(address), '') AS address,
  lower(trim(name)) || '|' || coalesce(lower(trim(address)), '') AS store_key FROM stores""")
def n16_store_label(t):
    label = tx.split_store_label(F.concat(F.lit(" "), F.col("name"), F.lit(" , "), F.col("address")))
    rows = t.domain.stores.select("store_id", label.alias("s"))
    return rows.select("store_id", "s.name", "s.address", tx.store_key(F.col("s.name"), F.col("s.address")).alias("store_key"))


@query("n21_payload_hash", f"{with_tables('cat')} SELECT product_id, sha256(product_id || '-' || coalesce(CAST(own_price_minor AS VARCHAR) || '-', '') || name) AS fingerprint FROM cat")
def n21_payload_hash(t):
    return t.domain.catalog.select("product_id", tx.payload_fingerprint(
        F.col("product_id").cast("string"), F.col("own_price_minor"), F.col("name")).alias("fingerprint"))


@query("n22_bbox", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE x END AS x, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE w END AS width FROM (
  SELECT p_partkey, p_size / 1000.0::DOUBLE AS x, (p_size + 100) / 1000.0::DOUBLE AS w FROM part)""")
def n22_bbox(t):
    c = F.col
    x = F.when(c("p_partkey") % 4 == 3, F.lit(950)).otherwise(c("p_size"))
    box = boxes.bbox_norm(x, F.lit(10), c("p_size") + 100, F.lit(50))
    return t.part.select("p_partkey", box["x"].alias("x"), box["width"].alias("width"))


@query("n23_padded_box", """SELECT p_partkey, CAST(x0 AS BIGINT) AS x, CAST(x1 - x0 AS BIGINT) AS width, CAST(pad AS BIGINT) AS padding_px,
  (x0 <> r0 OR x1 <> r1 OR y0 <> q0 OR y1 <> q1) AS was_clamped FROM (SELECT *, greatest(0, least(r0, 120)) AS x0, greatest(0, least(r1, 120)) AS x1,
  greatest(0, least(q0, 80)) AS y0, greatest(0, least(q1, 80)) AS y1 FROM (SELECT p_partkey, pad, floor(p_size - pad) AS r0, ceil(p_size + w + pad) AS r1,
  floor(10 - pad) AS q0, ceil(10 + 30 + pad) AS q1 FROM (SELECT p_partkey, p_size, p_size + 20.5::DOUBLE AS w, greatest(4, floor(greatest(p_size + 20.5::DOUBLE, 30) * 0.1::DOUBLE)) AS pad FROM part)))""")
def n23_padded_box(t):
    c = F.col
    box = boxes.padded_box(c("p_size"), F.lit(10), c("p_size") + 20.5, F.lit(30), F.lit(120), F.lit(80), 4, 0.1)
    return t.part.select("p_partkey", box.alias("b")).select("p_partkey", "b.x", "b.width", "b.padding_px", "b.was_clamped")


@query("n25_ai_cost", """SELECT event_id, CASE WHEN event_type = 'purchase' THEN CAST(floor((user_id * 100 / 1e6 * 0.2::DOUBLE + user_id / 1e6 * 1.25::DOUBLE) * 1e6 + 0.5) AS BIGINT)
  WHEN event_type = 'view' THEN CAST(floor((user_id * 100 / 1e6 * 0.75::DOUBLE + user_id / 1e6 * 4.5::DOUBLE) * 1e6 + 0.5) AS BIGINT) END AS cost FROM events""")
def n25_ai_cost(t):
    model = F.when(F.col("event_type") == "purchase", "gpt-5.4-nano").when(F.col("event_type") == "view", "gpt-5.4-mini").otherwise("unknown")
    return t.events.select("event_id", money.ai_cost_microusd(model, F.col("user_id") * 100, F.col("user_id")).alias("cost"))


# Candidates in SQL: every distinct item text against every distinct product text.
SCORES = f"""ptext AS (SELECT product_id, name, concat_ws(' ', name, brand, size_text) AS text FROM cat WHERE is_active),
itok AS (SELECT DISTINCT text, {tokens_sql('text')} AS toks, {size_sql('text')} AS sz FROM src),
ptok AS (SELECT DISTINCT text, {tokens_sql('text')} AS toks, {size_sql('text')} AS sz FROM ptext),
ifeat AS (SELECT *, list_filter(toks, lambda w: list_contains({_list_sql(BRAND_SET)}, w))[1] AS b,
  list_filter({_list_sql(fv.FAMILIES)}, lambda w: list_contains(toks, w))[1] AS f,
  list_filter({_list_sql(fv.VARIANT_WORDS)}, lambda w: list_contains(toks, w)) AS v,
  list_filter({_list_sql(fv.PACKAGING_WORDS)}, lambda w: list_contains(toks, w)) AS pk,
  list_filter(toks, lambda w: list_contains({_list_sql(fv.WEAK_WORDS)}, w)) AS weak,
  list_filter(toks, lambda w: list_contains({_list_sql(fv.FAMILIES + BRAND_SET)}, w)) AS strong FROM itok),
pfeat AS (SELECT *, list_filter(toks, lambda w: list_contains({_list_sql(BRAND_SET)}, w))[1] AS b,
  list_filter({_list_sql(fv.FAMILIES)}, lambda w: list_contains(toks, w))[1] AS f,
  list_filter({_list_sql(fv.VARIANT_WORDS)}, lambda w: list_contains(toks, w)) AS v,
  list_filter({_list_sql(fv.PACKAGING_WORDS)}, lambda w: list_contains(toks, w)) AS pk FROM ptok),
ivoc AS (SELECT DISTINCT unnest(toks) AS rt FROM itok), pvoc AS (SELECT DISTINCT unnest(toks) AS pt FROM ptok),
ifold AS (SELECT rt, {fold_sql('rt')} AS k FROM ivoc), pfold AS (SELECT pt, {fold_sql('pt')} AS k FROM pvoc),
contain AS (SELECT rt, list(pt) AS pts FROM ivoc JOIN pvoc ON rt <> pt AND length(pt) >= 3 AND (contains(rt, pt) OR contains(pt, rt))
  WHERE NOT list_contains({_list_sql(fv.WEAK_WORDS + fv.VARIANT_WORDS + fv.PACKAGING_WORDS)}, rt) GROUP BY rt),
folds AS (SELECT rt, list(pt) AS pts FROM ifold JOIN pfold USING (k) WHERE rt <> pt GROUP BY rt),
isub AS (SELECT text, list({{'rt': c.rt, 'pts': c.pts}}) AS subs FROM (SELECT text, b, unnest(toks) AS rt FROM ifeat) x JOIN contain c USING (rt)
  WHERE b IS NULL OR rt <> b GROUP BY text),
ifol AS (SELECT text, flatten(list(c.pts)) AS fols FROM (SELECT text, unnest(toks) AS rt FROM ifeat) x JOIN folds c USING (rt) GROUP BY text),
ifull AS (SELECT i.*, coalesce(s.subs, []) AS subs, coalesce(o.fols, []) AS fols FROM ifeat i LEFT JOIN isub s USING (text) LEFT JOIN ifol o USING (text) WHERE len(i.toks) > 0),
raw AS (SELECT i.text AS itext, p.text AS ptext, len(i.toks) AS n, i.sz AS isz, p.sz AS psz,
  len(list_intersect(i.toks, p.toks)) AS cm, len(list_intersect(i.weak, p.toks)) AS cw, len(list_intersect(i.strong, p.toks)) AS cs,
  len(i.weak) AS nw, len(i.strong) AS ns,
  CASE WHEN len(i.subs) = 0 THEN 0 ELSE list_sum(list_transform(i.subs, lambda s: CASE WHEN list_contains(p.toks, s.rt) THEN 0 ELSE len(list_intersect(s.pts, p.toks)) END)) END AS su,
  CASE WHEN len(i.fols) = 0 THEN 0 ELSE len(list_filter(i.fols, lambda w: list_contains(p.toks, w))) END AS fo,
  coalesce(i.b = p.b, false) AS be, coalesce(i.b = p.b AND i.f = p.f, false) AS fe,
  len(list_intersect(i.v, p.v)) AS va, len(list_intersect(i.pk, p.pk)) AS pa,
  len(i.v) > 0 AND len(p.v) > 0 AS bv, len(i.pk) > 0 AND len(p.pk) > 0 AS bp FROM ifull i, pfeat p),
pts AS (SELECT *, coalesce(isz = psz, false) AS se, coalesce(isz <> psz, false) AS sm, isz IS NULL AND psz IS NOT NULL AS sn,
  7000.0::DOUBLE * ((cm - cw - cs) * 100 + cw * 35 + cs * 120) / ((n - nw - ns) * 100 + nw * 35 + ns * 120) + su * 1500 + fo * 4000
  + be::INT * 1600 + fe::INT * 1200 + coalesce(isz = psz, false)::INT * 1800 - coalesce(isz <> psz, false)::INT * 800
  - (isz IS NULL AND psz IS NOT NULL)::INT * 200 + least((va + pa) * 400, 800) - (fe AND bv AND va = 0)::INT * 500 AS s0 FROM raw),
fin AS (SELECT *, n <= 2 AND be::INT + fe::INT + se::INT < 2 AS part, CASE WHEN bp AND pa = 0 THEN least(s0 - 800, 8900) ELSE s0 END AS s1 FROM pts),
scored AS (SELECT itext, ptext, floor(greatest(0, least(CASE WHEN part THEN least(s1, 6500) ELSE s1 END, 9900)) + 0.5) / 10000 AS score,
  array_to_string(list_filter([CASE WHEN su > 0 THEN 'substring_match' END, CASE WHEN fo > 0 THEN 'transliteration' END, CASE WHEN be THEN 'brand' END,
  CASE WHEN fe THEN 'product_family' END, CASE WHEN se THEN 'size' WHEN sm THEN 'size_mismatch_review' WHEN sn THEN 'missing_size_review' END,
  CASE WHEN va + pa > 0 THEN 'variant' END, CASE WHEN fe AND bv AND va = 0 THEN 'different_variant_same_base_review' END,
  CASE WHEN bp AND pa = 0 THEN 'packaging_mismatch_review' END, CASE WHEN cm > 0 THEN 'name_tokens' END, CASE WHEN part THEN 'partial_ocr_review' END],
  lambda w: w IS NOT NULL), '|') AS reasons FROM fin WHERE s1 > 0),
ranked AS (SELECT s.item_id, p.product_id, p.name, i.sz AS isz, c.score, c.reasons, row_number() OVER (PARTITION BY s.item_id ORDER BY c.score DESC, p.product_id) AS rank
  FROM scored c JOIN src s ON s.text = c.itext JOIN itok i ON i.text = c.itext JOIN ptext p ON p.text = c.ptext WHERE c.score > 0 QUALIFY rank <= 30),
named AS (SELECT *, {tokens_sql('name')} AS nt, {size_sql('name')} AS nsz FROM ranked),
fam AS (SELECT *, list_filter(nt, lambda w: list_contains({_list_sql(BRAND_SET)}, w))[1] || ':' || list_filter({_list_sql(fv.FAMILIES)}, lambda w: list_contains(nt, w))[1] AS bf FROM named),
cand AS MATERIALIZED (SELECT item_id, product_id, rank, score, reasons || CASE WHEN isz IS NULL AND bf IS NOT NULL AND count(DISTINCT CASE WHEN score >= 0.45::DOUBLE THEN nsz END)
  OVER (PARTITION BY item_id, bf) > 1 THEN '|multiple_catalog_sizes_review' ELSE '' END AS reasons FROM fam)"""
CAND = f"{with_tables('cat', 'src')}, {SCORES}"


def _candidates(t, k=fv.DEFAULT_CANDIDATES):
    return cj.catalog_candidates(t.domain.source_products, t.domain.match_products, k)


def _flat(df):
    return df.withColumn("reasons", F.array_join("reasons", "|"))


@query("j3_candidates", f"{CAND} SELECT item_id, product_id, CAST(rank AS BIGINT) AS rank, score, reasons FROM cand WHERE rank <= 5")
def j3_candidates(t):
    return _flat(_candidates(t, 5)).withColumn("rank", F.col("rank").cast("bigint"))


@query("t1_top_candidates", f"{CAND} SELECT item_id, count(*) AS candidates, min(score) AS lowest, CAST(sum(product_id) AS BIGINT) AS ids FROM cand GROUP BY item_id")
def t1_top_candidates(t):
    return _candidates(t).groupBy("item_id").agg(F.count("*").alias("candidates"), F.min("score").alias("lowest"),
                                                 F.sum("product_id").alias("ids"))


@query("w4_ambiguous_sizes", f"{CAND} SELECT item_id, product_id FROM cand WHERE contains(reasons, 'multiple_catalog_sizes_review')")
def w4_ambiguous_sizes(t):
    return _candidates(t).where(F.array_contains("reasons", "multiple_catalog_sizes_review")).select("item_id", "product_id")


BEST = """best AS (SELECT item_id, max(CASE WHEN rank = 1 THEN product_id END) AS product_id, max(CASE WHEN rank = 1 THEN score END) AS score,
  max(CASE WHEN rank = 2 THEN score END) AS second_score, max(CASE WHEN rank = 1 THEN reasons END) AS reasons FROM cand WHERE rank <= 2 GROUP BY item_id)"""
TENK = "CAST(floor(score * 10000 + 0.5) AS BIGINT) - CAST(floor(second_score * 10000 + 0.5) AS BIGINT)"


@query("w5_best_and_margin", f"{CAND}, {BEST} SELECT item_id, product_id, score, second_score, reasons FROM best")
def w5_best_and_margin(t):
    return _flat(dc.best_and_margin(_candidates(t)))


@query("r1_photo_decision", f"""{CAND}, {BEST} SELECT item_id, product_id, CASE WHEN NOT (score >= 0.66::DOUBLE OR (score >= 0.52::DOUBLE AND contains('|' || reasons || '|', '|product_family|')))
  THEN 'no_candidate' WHEN score >= 0.9::DOUBLE AND NOT regexp_matches(reasons, '_review(\\||$)') AND (second_score IS NULL OR {TENK} >= 800) THEN 'auto' ELSE 'suggested' END AS decision FROM best""")
def r1_photo_decision(t):
    return dc.photo_decision(dc.best_and_margin(_candidates(t))).select("item_id", "product_id", "decision")


EVIDENCE = f"""decided AS (SELECT *, CASE WHEN score < 0.7::DOUBLE THEN 'low_confidence_review' WHEN contains(reasons, 'review') THEN 'catalog_candidate_review'
  WHEN {TENK} <= 400 THEN 'ambiguous_catalog_candidates_review' END AS rr FROM best)"""


@query("r2_evidence_decision", f"""{CAND}, {BEST}, {EVIDENCE} SELECT item_id, CASE WHEN score >= 0.82::DOUBLE AND rr IS NULL THEN product_id END AS selected_product_id,
  score AS match_confidence, concat_ws('|', rr, reasons) AS match_reason, NOT (score >= 0.82::DOUBLE AND rr IS NULL) AS review_required FROM decided""")
def r2_evidence_decision(t):
    return dc.evidence_decision(dc.best_and_margin(_candidates(t)))


@query("a13_decision_metrics", f"""{CAND}, {BEST}, {EVIDENCE} SELECT count(*) AS items, count(d.item_id) AS matched, count(*) FILTER (WHERE score >= 0.82::DOUBLE AND rr IS NULL) AS selected,
  count(*) FILTER (WHERE NOT coalesce(score >= 0.82::DOUBLE AND rr IS NULL, false)) AS needs_review, count(*) FILTER (WHERE d.item_id IS NULL) AS no_candidate
  FROM src LEFT JOIN decided d USING (item_id)""")
def a13_decision_metrics(t):
    return dc.decision_metrics(t.domain.source_products, dc.evidence_decision(dc.best_and_margin(_candidates(t))))


# Online decisions over source products: history from shipped lines, barcodes from the catalogue, choices from orders.
HISTORY = """hist AS (SELECT l_partkey AS source_product_id, l_suppkey AS product_id, l_discount AS confidence, 'fuzzy' AS method,
  CASE WHEN l_partkey % 4 <> 0 THEN 'rejected' WHEN l_returnflag = 'R' THEN 'confirmed' WHEN l_returnflag = 'A' THEN 'needs_review' ELSE 'auto' END AS status, l_shipdate AS matched_at,
  l_orderkey * 8 + l_linenumber AS match_id FROM lineitem),
accepted AS (SELECT source_product_id, product_id, confidence, method, status FROM (SELECT *, row_number() OVER (PARTITION BY source_product_id
  ORDER BY matched_at DESC, match_id DESC, product_id DESC, confidence DESC) AS n FROM hist WHERE status IN ('auto', 'confirmed')) WHERE n = 1)"""
SEEN = """seen AS (SELECT product_id AS source_product_id, CASE WHEN product_id % 3 = 0 THEN external_sku ELSE barcode END AS barcode FROM cat)"""
SKUS = """skus AS (SELECT external_sku, min(product_id) AS product_id FROM cat WHERE is_active GROUP BY external_sku HAVING count(*) = 1)"""


def _history(t):
    c = F.col
    status = F.when(c("l_partkey") % 4 != 0, "rejected").when(c("l_returnflag") == "R", "confirmed").when(
        c("l_returnflag") == "A", "needs_review").otherwise("auto")
    return t.lineitem.select(
        c("l_partkey").alias("source_product_id"), c("l_suppkey").alias("product_id"), c("l_discount").alias("confidence"),
        F.lit("fuzzy").alias("method"), status.alias("status"), c("l_shipdate").alias("matched_at"),
        (c("l_orderkey") * 8 + c("l_linenumber")).alias("match_id"))


def _seen(t):
    return t.domain.catalog.select(F.col("product_id").alias("source_product_id"), F.when(
        F.col("product_id") % 3 == 0, F.col("external_sku")).otherwise(F.col("barcode")).alias("barcode"))


@query("w8_latest_accepted", f"WITH {HISTORY} SELECT * FROM accepted")
def w8_latest_accepted(t):
    return dc.latest_accepted(_history(t).withColumn("match_id", F.struct("match_id", "product_id", "confidence")))


@query("j1_barcode", f"{with_tables('cat')}, {SEEN}, {SKUS} SELECT source_product_id, skus.product_id, 1.0::DOUBLE AS confidence, 'barcode' AS method FROM seen JOIN skus ON barcode = external_sku")
def j1_barcode(t):
    return dc.barcode_matches(_seen(t), t.domain.catalog).select("source_product_id", "product_id", "confidence", "method")


@query("j2_reuse_or_open", f"{with_tables('cat')}, {SEEN}, {HISTORY} SELECT CASE WHEN a.source_product_id IS NULL THEN 'open' ELSE 'cached' END AS state, count(*) AS products FROM seen LEFT JOIN accepted a USING (source_product_id) GROUP BY 1")
def j2_reuse_or_open(t):
    reused, open_rows = dc.split_known(_seen(t), _history(t))
    both = reused.select(F.lit("cached").alias("state")).unionByName(open_rows.select(F.lit("open").alias("state")))
    return both.groupBy("state").agg(F.count("*").alias("products"))


@query("r3_online_cascade", f"""{with_tables('cat')}, {SEEN}, {HISTORY}, {SKUS}, chosen AS (SELECT p_partkey AS source_product_id, CASE WHEN p_size % 2 = 0 THEN p_partkey END AS product_id,
  p_size / 100.0::DOUBLE AS confidence, 'choice' AS reason FROM part)
SELECT s.source_product_id, CASE WHEN a.source_product_id IS NOT NULL THEN a.product_id WHEN k.product_id IS NOT NULL THEN k.product_id ELSE c.product_id END AS product_id,
  CASE WHEN a.source_product_id IS NOT NULL THEN a.confidence WHEN k.product_id IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(c.confidence, 0) END AS confidence,
  CASE WHEN a.source_product_id IS NOT NULL THEN a.method WHEN k.product_id IS NOT NULL THEN 'barcode' WHEN c.reason IS NULL THEN 'fuzzy' ELSE 'llm' END AS method,
  CASE WHEN a.source_product_id IS NOT NULL THEN a.status WHEN k.product_id IS NOT NULL OR c.product_id IS NOT NULL THEN 'auto' ELSE 'needs_review' END AS status
FROM seen s LEFT JOIN accepted a USING (source_product_id) LEFT JOIN skus k ON s.barcode = k.external_sku LEFT JOIN chosen c ON s.source_product_id = c.source_product_id""")
def r3_online_cascade(t):
    c = F.col
    chosen = t.part.select(
        c("p_partkey").alias("source_product_id"), F.when(c("p_size") % 2 == 0, c("p_partkey")).alias("product_id"),
        (c("p_size") / 100.0).alias("confidence"), F.lit("choice").alias("reason"))
    history = _history(t).withColumn("match_id", F.struct("match_id", "product_id", "confidence"))
    return dc.online_cascade(_seen(t), history, t.domain.catalog, dc.table_decider(chosen)).select(
        "source_product_id", "product_id", "confidence", "method", "status")


ALIASES = f"""keyed AS (SELECT item_id, {key_sql('text')} AS match_key FROM src), al AS (SELECT CASE WHEN item_id % 2 = 0 THEN match_key ELSE 'other ' || match_key END AS match_key, item_id AS product_id, item_id % 5 AS confirmations
  FROM keyed WHERE match_key <> ''), alias AS (SELECT item_id, product_id FROM keyed JOIN (SELECT match_key, product_id FROM al QUALIFY row_number() OVER (PARTITION BY match_key
  ORDER BY confirmations DESC, product_id) = 1) USING (match_key) JOIN cat USING (product_id) WHERE is_active)"""


@query("r3_rule_cascade", f"""{CAND}, {BEST}, {EVIDENCE}, {SEEN}, {HISTORY}, {SKUS}, {ALIASES}
SELECT s.source_product_id, CASE WHEN a.source_product_id IS NOT NULL THEN a.product_id WHEN k.product_id IS NOT NULL THEN k.product_id WHEN l.product_id IS NOT NULL THEN l.product_id
    WHEN score >= 0.82::DOUBLE AND rr IS NULL THEN d.product_id END AS product_id,
  CASE WHEN a.source_product_id IS NOT NULL THEN a.confidence WHEN k.product_id IS NOT NULL THEN 1.0::DOUBLE WHEN l.product_id IS NOT NULL THEN 0.99::DOUBLE ELSE coalesce(score, 0) END AS confidence,
  CASE WHEN a.source_product_id IS NOT NULL THEN a.method WHEN k.product_id IS NOT NULL THEN 'barcode' ELSE 'fuzzy' END AS method,
  CASE WHEN a.source_product_id IS NOT NULL THEN a.status WHEN k.product_id IS NOT NULL OR l.product_id IS NOT NULL OR (score >= 0.82::DOUBLE AND rr IS NULL) THEN 'auto' ELSE 'needs_review' END AS status,
  CASE WHEN a.source_product_id IS NOT NULL THEN 'Existing match (cached)' WHEN k.product_id IS NOT NULL THEN 'Barcode match' WHEN l.product_id IS NOT NULL THEN 'learned_alias'
    WHEN d.item_id IS NULL THEN 'No candidates found' ELSE concat_ws('|', rr, reasons) END AS reason
FROM seen s LEFT JOIN accepted a USING (source_product_id) LEFT JOIN skus k ON s.barcode = k.external_sku LEFT JOIN alias l ON l.item_id = s.source_product_id LEFT JOIN decided d ON d.item_id = s.source_product_id""")
def r3_rule_cascade(t):
    history = _history(t).withColumn("match_id", F.struct("match_id", "product_id", "confidence"))
    texts = t.domain.source_products.select(F.col("item_id").alias("source_product_id"), "text")
    decide = dc.rule_decider(t.domain.match_products, _aliases(_match_keys(t)))
    return dc.online_cascade(_seen(t).join(texts, "source_product_id"), history, t.domain.catalog, decide).select(
        "source_product_id", "product_id", "confidence", "method", "status", "reason")


@query("j4_aliases", f"""{with_tables('cat', 'src')}, keyed AS (SELECT item_id, {key_sql('text')} AS match_key FROM src),
al AS (SELECT CASE WHEN item_id % 2 = 0 THEN match_key ELSE 'other ' || match_key END AS match_key, item_id AS product_id, item_id % 5 AS confirmations FROM keyed WHERE match_key <> '')
SELECT item_id, product_id, 0.99::DOUBLE AS score FROM keyed JOIN (SELECT match_key, product_id FROM al QUALIFY row_number() OVER (PARTITION BY match_key
  ORDER BY confirmations DESC, product_id) = 1) USING (match_key)""")
def j4_aliases(t):
    keys = _match_keys(t)
    return dc.learned_aliases(keys, _aliases(keys)).select("item_id", "product_id", "score")


def _match_keys(t):
    """Keys made once per item: written down, so that no filter on a key makes it again, from texts dealt out over all tasks."""
    none = F.lit(None).cast("string")
    texts = t.domain.source_products.repartition("text")
    return materialize(texts.select("item_id", tx.match_key(F.col("text"), none, none, none, none).alias("match_key")), "match_keys")


def _aliases(keys):
    return keys.where("match_key <> ''").select(
        F.when(F.col("item_id") % 2 == 0, F.col("match_key")).otherwise(F.concat(F.lit("other "), "match_key")).alias("normalized_key"),
        F.col("item_id").alias("product_id"), (F.col("item_id") % 5).alias("confirmations"))


@query("a16_learn_aliases", f"""{with_tables('items', 'matches', 'cat')}, keyed AS (SELECT product_id, {key_sql('name')} AS k FROM cat)
SELECT k AS normalized_key, product_id, count(*) AS confirmations, strftime(max(decided_at), '%Y-%m-%d') AS last_confirmed_on FROM matches JOIN keyed USING (product_id)
WHERE decision IN ('accepted', 'corrected') AND k <> '' GROUP BY k, product_id""")
def a16_learn_aliases(t):
    none = F.lit(None).cast("string")
    names = t.domain.catalog.select("product_id", "name").repartition("name")
    keyed = materialize(names.select("product_id", tx.match_key(F.col("name"), none, none, none, none).alias("match_key")), "match_keys")
    learned = dc.learn_aliases(t.domain.matches.join(keyed, "product_id"))
    return learned.select("normalized_key", "product_id", "confirmations", F.date_format("last_confirmed_at", "yyyy-MM-dd").alias("last_confirmed_on"))


CHOICES = """choices AS (SELECT CASE WHEN p_partkey % 7 <> 0 THEN p_partkey ELSE -1 - p_partkey END AS item_id, CASE WHEN p_partkey % 3 <> 2 THEN CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE p_partkey + 1 END END AS product_id,
  p_size / 40.0::DOUBLE AS confidence, 'because ' || p_size AS reason, CASE WHEN p_size % 4 = 0 THEN 'none' ELSE 'match' END AS answer FROM part)"""


def _choices(t):
    c = F.col
    return t.part.select(
        F.when(c("p_partkey") % 7 != 0, c("p_partkey")).otherwise(-1 - c("p_partkey")).alias("item_id"), F.when(c("p_partkey") % 3 == 0, c("p_partkey")).when(c("p_partkey") % 3 == 1, c("p_partkey") + 1).alias("product_id"),
        (c("p_size") / 40.0).alias("confidence"), F.concat(F.lit("because "), c("p_size").cast("string")).alias("reason"),
        F.when(c("p_size") % 4 == 0, "none").otherwise("match").alias("answer"), F.lit(1).alias("choice_no"))


@query("j11_apply_decisions", f"""{CAND}, {CHOICES} SELECT s.item_id, c2.product_id, CASE WHEN c.item_id IS NULL THEN 0 ELSE greatest(0, least(1, c.confidence)) END::DOUBLE AS confidence,
  CASE WHEN c.item_id IS NOT NULL THEN c.reason WHEN h.item_id IS NULL THEN 'no_candidates' ELSE 'no_result' END AS reason,
  CASE WHEN c2.product_id IS NULL THEN 'needs_review' ELSE 'auto' END AS status FROM src s LEFT JOIN choices c USING (item_id)
  LEFT JOIN (SELECT DISTINCT item_id FROM cand) h ON s.item_id = h.item_id
  LEFT JOIN (SELECT c.item_id, c.product_id FROM choices c JOIN cand USING (item_id, product_id)) c2 ON s.item_id = c2.item_id""")
def j11_apply_decisions(t):
    return dc.apply_decisions(t.domain.source_products, _candidates(t), _choices(t))


@query("r5_outside_review", f"{CAND}, {CHOICES} SELECT item_id, product_id, greatest(0, least(confidence, 0.89::DOUBLE)) AS score, 'ai_review' AS decision FROM choices JOIN cand USING (item_id, product_id) WHERE answer = 'match'")
def r5_outside_review(t):
    return dc.outside_review(_choices(t), _candidates(t)).select("item_id", "product_id", "score", "decision")


@query("j13_unmatched_queue", f"""{CAND}, hist AS (SELECT l_partkey AS source_product_id, CASE l_returnflag WHEN 'A' THEN 'needs_review' ELSE 'auto' END AS status, l_shipdate AS matched_at,
  l_orderkey * 8 + l_linenumber AS match_id, l_suppkey AS sup FROM lineitem),
queue AS (SELECT source_product_id FROM (SELECT *, row_number() OVER (PARTITION BY source_product_id ORDER BY matched_at DESC, match_id DESC, sup DESC) AS n FROM hist) WHERE n = 1 AND status = 'needs_review')
SELECT source_product_id, coalesce(n, 0) AS candidate_count, ids AS candidate_ids FROM queue LEFT JOIN (SELECT item_id, count(*) AS n,
  string_agg(CAST(product_id AS VARCHAR), ',' ORDER BY rank) AS ids FROM cand WHERE rank <= 5 GROUP BY item_id) c ON source_product_id = c.item_id""")
def j13_unmatched_queue(t):
    c = F.col
    history = t.lineitem.select(
        c("l_partkey").alias("source_product_id"), F.when(c("l_returnflag") == "A", "needs_review").otherwise("auto").alias("status"),
        c("l_shipdate").alias("matched_at"), F.struct(c("l_orderkey") * 8 + c("l_linenumber"), c("l_suppkey")).alias("match_id"))
    products = t.domain.source_products.withColumnRenamed("item_id", "source_product_id")
    queue = dc.unmatched_queue(history, products, _candidates(t, 5))
    ids = F.array_join(F.transform("candidates", lambda x: x["product_id"].cast("string")), ",")
    return queue.select("source_product_id", F.col("candidate_count").cast("bigint").alias("candidate_count"), ids.alias("candidate_ids"))


@query("j15_manual_search", f"""{with_tables('cat')}, q AS (SELECT p_partkey AS item_id, CASE p_partkey % 4 WHEN 0 THEN external_sku WHEN 1 THEN upper(name)
  WHEN 2 THEN split_part(name, ' ', 3) ELSE 'zzz' || p_partkey END AS query FROM part JOIN cat ON p_partkey = product_id),
dq AS (SELECT DISTINCT query FROM q), act AS (SELECT * FROM cat WHERE is_active),
bysku AS (SELECT query, min(product_id) AS pid FROM dq JOIN act ON query = external_sku GROUP BY query HAVING count(*) = 1),
byname AS (SELECT query, count(*) AS n, min(product_id) AS pid FROM dq JOIN act ON contains(lower(name), lower(query)) WHERE query NOT IN (SELECT query FROM bysku) GROUP BY query)
SELECT item_id, q.query, coalesce(s.pid, CASE WHEN n = 1 THEN b.pid END) AS product_id,
  CASE WHEN s.pid IS NOT NULL THEN 'sku' WHEN n = 1 THEN 'name' WHEN n > 1 THEN 'ambiguous' ELSE 'not_found' END AS found_by FROM q LEFT JOIN bysku s USING (query) LEFT JOIN byname b USING (query)""")
def j15_manual_search(t):
    c = F.col
    queries = t.domain.catalog.select(c("product_id").alias("item_id"), F.when(c("product_id") % 4 == 0, c("external_sku")).when(
        c("product_id") % 4 == 1, F.upper("name")).when(c("product_id") % 4 == 2, F.get(F.split("name", " "), F.lit(2))).otherwise(
        F.concat(F.lit("zzz"), c("product_id").cast("string"))).alias("query"))
    return dc.manual_search(queries, t.domain.catalog).select("item_id", "query", "product_id", "found_by")


@query("w9_one_active", f"""{with_tables('items', 'matches')} SELECT match_id, row_number() OVER (PARTITION BY item_id ORDER BY decided_at DESC, match_id DESC) = 1 AS is_active
  FROM (SELECT match_id, split_part(item_id, '-', 1) AS item_id, decided_at FROM matches)""")
def w9_one_active(t):
    rows = t.domain.matches.withColumn("item_id", F.get(F.split("item_id", "-"), F.lit(0)))
    return dc.enforce_one_active(rows).select("match_id", "is_active")


@query("r4_bulk_accept", f"""{with_tables('items', 'matches', 'cat')} SELECT match_id, m.item_id, product_id, score,
  CASE WHEN i.size_text IS NULL AND c.size_text IS NOT NULL THEN 'skipped_missing_size' ELSE 'accepted' END AS outcome
  FROM matches m JOIN items i USING (item_id) LEFT JOIN cat c USING (product_id) WHERE is_active_m AND score >= 0.9::DOUBLE AND decision <> 'ai_review' AND i.status IN ('needs_review', 'recognized')""".replace("is_active_m", "m.is_active"))
def r4_bulk_accept(t):
    return dc.bulk_accept(t.domain.matches, t.domain.session_items(), t.domain.catalog)


REVIEW = """hints AS (SELECT item_id, bool_or(own_price_minor IS NULL) AS np, bool_or(size_text IS NOT NULL) AS hs FROM (
  SELECT item_id, CASE WHEN line % 5 < 3 THEN (part * 3 + 1) % (SELECT count(*) FROM part) ELSE -1 END AS product_id FROM items) JOIN cat USING (product_id) GROUP BY item_id),
act AS (SELECT item_id, decision, c.own_price_minor IS NULL AS np FROM matches m LEFT JOIN cat c USING (product_id) WHERE m.is_active),
flags AS (SELECT i.*, a.decision, status IN ('recognized', 'needs_review') AS todo, status IN ('matched', 'confirmed', 'unmatched') AS ready,
  status IN ('recognized', 'needs_review') AND a.item_id IS NULL AND h.item_id IS NULL AS wc, i.size_text IS NULL AND coalesce(h.hs, false) AS sr,
  coalesce(a.np, h.np, false) AS mp FROM items i LEFT JOIN act a USING (item_id) LEFT JOIN hints h USING (item_id))"""


def _review_flags(t):
    products = t.part.count()
    hinted = F.when(F.col("_line") % 5 < 3, (F.col("_part") * 3 + 1) % products).otherwise(-1)  # -1: a product nobody has
    d = t.domain
    hints = d.lines.select("item_id", hinted.alias("product_id"))
    return rv.review_flags(d.session_items(), d.matches_of(d.lines), hints, d.catalog)


@query("r13_review_counters", f"""{with_tables('items', 'matches', 'cat')}, {REVIEW} SELECT count(*) AS all_items, count(*) FILTER (WHERE todo) AS todo, count(*) FILTER (WHERE wc) AS without_candidate,
  count(*) FILTER (WHERE sr) AS size_risk, count(*) FILTER (WHERE mp) AS missing_own_price, count(*) FILTER (WHERE ready) AS ready FROM flags""")
def r13_review_counters(t):
    return rv.review_counters(_review_flags(t))


@query("r13_review_badges", f"""{with_tables('items', 'matches', 'cat')}, {REVIEW} SELECT item_id, array_to_string(list_filter([CASE WHEN wc THEN 'Без кандидата' END, CASE WHEN sr THEN 'Риск размера' END,
  CASE WHEN mp THEN 'Нет нашей цены' END, CASE WHEN size_text IS NULL THEN 'Нет размера OCR' END, CASE WHEN confidence < 0.75::DOUBLE THEN 'Проверь OCR' END,
  CASE WHEN decision = 'ai_review' THEN 'Кандидат требует проверки' END, CASE WHEN status = 'unmatched' THEN 'Нет в ассортименте' END], lambda b: b IS NOT NULL), '|') AS badges FROM flags""")
def r13_review_badges(t):
    return _review_flags(t).select("item_id", F.array_join("badges", "|").alias("badges"))


@query("f5_review_tasks", f"""{with_tables('items', 'matches', 'cat')}, {REVIEW} SELECT item_id, task FROM (SELECT item_id, 'size_risk' AS task, department FROM flags WHERE sr UNION ALL
  SELECT item_id, 'without_candidate', department FROM flags WHERE wc UNION ALL SELECT item_id, 'missing_own_price', department FROM flags WHERE mp) WHERE department = 'products'""")
def f5_review_tasks(t):
    rows = rv.filter_task(_review_flags(t), "all", "products")
    return rv.task_rows(rows, ["size_risk", "without_candidate", "missing_own_price"]).select("item_id", "task")


@query("t3_review_queue", f"{with_tables('items')} SELECT item_id, status FROM items ORDER BY created_at DESC, item_id")
def t3_review_queue(t):
    return rv.review_queue(t.domain.session_items()).select("item_id", "status")
