"""The operators as queries over the whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelflens.llm import align, decontaminate, embeddings, langid, minhash, pieces, pii, secrets, suffix, toxicity, urls, warc, whiten
from shelflens.llm.common import split_remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query("op9_language_id")
def language_id(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    known = langid.profiles(docs.where(split_remainder(F.col("doc_id"), 4) != 2))
    rows = docs.select("doc_id", (split_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return langid.predict(rows, known).drop("text")


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3])) END AS sh
      FROM w),
p AS MATERIALIZED (SELECT doc_id, unnest(sh) AS g FROM s),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM met JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 80 * (len(x.sh) + len(y.sh) - c)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, x.b FROM reach r JOIN edges x ON r.b = x.a),
low AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM s LEFT JOIN low ON low.a = s.doc_id
"""


@query("op8_minhash_near_dedup", NEAR_SQL)
def minhash_near_dedup(spark, folder):
    return minhash.near_duplicates(table(spark, folder, "documents"))


LEAKS_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS MATERIALIZED (SELECT DISTINCT item_id, array_to_string(ws[i : least(i + 9, len(ws))], ' ') AS g, least(10, len(ws)) AS n
     FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM w),
occ AS MATERIALIZED (SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS g
     FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
met AS MATERIALIZED (SELECT doc_id, i, occ.n, item_id FROM occ JOIN w ON w.g = occ.g AND w.n = occ.n),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM met) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query("op10_benchmark_decontamination", LEAKS_SQL)
def benchmark_decontamination(spark, folder):
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def _joined(spans, *kinds):
    """kind:start:end of the spans of some kinds, comma-joined in their order."""
    from_kinds = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else F.col(spans)
    return F.array_join(F.transform(from_kinds, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op7_pii")
def personal_data(spark, folder):
    found = pii.find(table(spark, folder, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    found = found.select("doc_id", "pii")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(_joined("pii", *pii.KINDS), 256).alias("base_sha256"),
                        _joined("pii").alias("spans"), F.aggregate("pii", F.lit(0.0), lambda s, x: F.greatest(s, x["score"])).alias("top_score"))


def _encoded(docs):
    """Samples of every text, as pieces and decoded again; a text without segmentation stays as a row without pieces."""
    made = pieces.sample(docs, decoded="decoded", keep_empty=True)
    return made.withColumn("n_pieces", F.size("pieces").cast("long")).withColumn("pieces_hash", F.when(F.col("pieces").isNotNull(), F.xxhash64("pieces")))


@query("op2_sentencepiece")
def sentencepiece_samples(spark, folder):
    return _encoded(table(spark, folder, "documents").select("doc_id", "text"))


VECTORS_SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT r.a, x.b FROM reach r JOIN links x ON r.b = x.a),
low AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON low.a = vec_id
"""


@query("op5_embedding_near_dedup", VECTORS_SQL)
def embedding_near_dedup(spark, folder):
    return embeddings.near_vectors(table(spark, folder, "embeddings"))


@query("op1_secret_scan")
def secret_scan(spark, folder):
    found = secrets.find(table(spark, folder, "documents").select("doc_id", "text"), out="spans_found")
    count = lambda k: F.size(F.filter("spans_found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(_joined("spans_found", *secrets.KINDS[:3]), 256).alias("base_sha256"), _joined("spans_found").alias("spans"))


@query("op3_toxicity")
def toxicity_scores(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").where(split_remainder(F.col("doc_id"), 5) != 0)
    model = toxicity.learn(toxicity.training_rows(docs, labels))
    rows = docs.select("doc_id", (split_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return toxicity.score(rows, model)


@query("op4_suffix_dedup")
def suffix_dedup(spark, folder):
    return suffix.without_repeats(table(spark, folder, "documents")).drop("kept")


def archive_records(pages):
    """WARC texts made of ``pages``: each page as a response and, from a day before to eleven days after, a revisit of its URL.

    Revisits switch the scheme; every seventh has another ETag, every fifth has only Last-Modified, every eleventh no validator;
    every ninth response is no full one.
    """
    i = F.col("page_id")
    stamp = lambda s: F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    seen, again = F.lit(1_700_000_000) + i * 60, F.lit(1_700_000_000) + i * 60 + (i % 13 - 1) * 86_400
    etag, modified = F.substring(F.md5("html"), 1, 16), F.lit(1_690_000_000) + i * 7
    html = F.coalesce("html", F.lit(""))
    status = F.when(i % 9 == 0, "206 Partial Content").otherwise("200 OK")
    response = text("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: ", F.col("url"), "\r\nWARC-Date: ", stamp(seen), "\r\n\r\nHTTP/1.1 ", status,
                    "\r\nContent-Type: text/html\r\nETag: \"", etag, "\"\r\nLast-Modified: ", stamp(modified), "\r\nCache-Control: max-age=60\r\nContent-Length: ",
                    F.octet_length(html).cast("string"), "\r\n\r\n", html)
    own = F.when(i % 11 == 0, "").when(i % 5 == 0, text("Last-Modified: ", stamp(modified), "\r\n")).when(
        i % 7 == 0, text("ETag: \"", etag, "x\"\r\n")).otherwise(text("ETag: W/\"", etag, "\"\r\n"))
    other = F.when(F.col("url").startswith("https:"), F.concat(F.lit("http:"), F.substr("url", F.lit(7)))).otherwise(
        F.concat(F.lit("https:"), F.substr("url", F.lit(6))))
    revisit = text("WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Target-URI: ", other, "\r\nWARC-Date: ", stamp(again), "\r\n\r\nHTTP/1.1 304 Not Modified\r\n", own,
                   "cache-control: max-age=", (i % 4 * 100).cast("string"), "\r\nContent-Length: 0\r\n\r\n")
    made = F.array(F.struct((i * 2).alias("record_id"), response.alias("record")), F.struct((i * 2 + 1).alias("record_id"), revisit.alias("record")))
    return pages.select(F.explode(made).alias("x")).select("x.*")


REVISITS_SQL = r"""
WITH p AS (SELECT page_id AS i, url, coalesce(html, '') AS html, 1700000000 + page_id * 60 AS seen, 1700000000 + page_id * 60 + (page_id % 13 - 1) * 86400 AS again,
       '"' || substr(md5(html), 1, 16) || '"' AS etag, 1690000000 + page_id * 7 AS modified FROM pages),
b AS (SELECT *, regexp_replace(regexp_replace(url, '^https?://', ''), '#.*$', '') AS bare FROM p),
u AS (SELECT *, regexp_replace(regexp_extract(bare, '^[^/?]*'), '^www\.', '') || regexp_replace(regexp_extract(bare, '^[^/?]*(/[^?]*)?', 1), '/+$', '') AS base,
       list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|ref)='))) AS q FROM b),
k AS MATERIALIZED (SELECT *, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS c FROM u),
j AS (SELECT r.i, r.c, r.again, x.i AS ri, x.etag AS re, x.modified AS rm, x.html AS rh, r.etag, r.modified,
       row_number() OVER (PARTITION BY r.i ORDER BY x.seen DESC, x.i DESC) AS n
       FROM k r LEFT JOIN k x ON x.c = r.c AND x.seen < r.again AND x.i % 9 <> 0),
o AS (SELECT *, CASE WHEN ri IS NULL THEN 'missing' WHEN i % 11 = 0 THEN 'unverified'
       WHEN i % 5 = 0 THEN CASE WHEN rm = modified THEN 'resolved' ELSE 'mismatch' END
       WHEN i % 7 = 0 THEN 'mismatch' WHEN re = etag THEN 'resolved' ELSE 'mismatch' END AS outcome FROM j WHERE n = 1)
SELECT i * 2 + 1 AS record_id, c AS url, again AS date, ri * 2 AS response_id, outcome,
       CASE WHEN outcome = 'resolved' THEN 'cache-control=max-age=' || (i % 4 * 100)::VARCHAR || ';content-length=' || strlen(rh)::VARCHAR || ';content-type=text/html;etag='
            || CASE WHEN i % 5 = 0 THEN re ELSE 'W/' || re END || ';last-modified=' || strftime(make_timestamp(rm * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS headers,
       CASE WHEN outcome = 'resolved' AND rh <> '' THEN 'sha256:' || sha256(rh) END AS digest
FROM o
"""


@query("op6_warc_revisits", REVISITS_SQL)
def warc_revisits(spark, folder):
    found = warc.resolve(warc.parse(archive_records(table(spark, folder, "pages"))))
    lines = F.array_join(F.transform("headers", lambda h: F.concat_ws("=", h["name"], h["value"])), ";")
    return found.withColumn("headers", lines)


def tokenizer(spark: SparkSession, name: str) -> str:
    """The path of a public tokenizer's file; ``spark.shelflens.tokenizers`` names the folder."""
    return f"{spark.conf.get('spark.shelflens.tokenizers', '/opt/tokenizers')}/{name}"


@query("op13_cross_tokenizer_alignment")
def cross_tokenizer_alignment(spark, folder):
    return align.alignments(table(spark, folder, "documents"), tokenizer(spark, "byte_bpe_50k.json"), tokenizer(spark, "piece_bpe_32k.model"))


@query("op11_url_filter")
def url_filter(spark, folder):
    return urls.judge(table(spark, folder, "pages"))


@query("op12_embedding_whitening")
def embedding_whitening(spark, folder):
    found = whiten.whiten(table(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
