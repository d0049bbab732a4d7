"""Not-modified revisits in web archives: each gets the latest earlier full response of its URL.

Records are WARC texts (record headers, HTTP headers, body, parted by empty lines). ``parse`` takes them apart with column
functions; ``resolve`` joins every revisit as of its date to the latest response with status 200 of the same canonical URL,
checks the validators and merges the headers a 304 may update into the response's.

The as-of join needs no range join: a URL's history is cut into slots of ``SLOT`` seconds; inside a slot a running window finds
the last response, across slots a window over one row per slot does. So a URL with very many captures is spread over its slots.

Outcomes: ``resolved``, ``mismatch`` (the latest earlier response has another validator), ``unverified`` (nothing to compare),
``missing`` (no earlier full response). A response at the revisit's own second is not earlier; among responses of one second the
greater id counts. ETags are compared weakly (without W/), Last-Modified only where either side lacks an ETag, a payload digest
must agree where both have one.

Defined results: a null or malformed record parses to nulls and joins nothing; a revisit without URL or date is missing; header
names are matched without case, the first of repeated ones counts; records of any length are read whole; repeated rows are resolved
each; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelflens.session import materialize

SLOT = 7 * 86_400
#: Headers that a 304 response may update, in the order they are written.
UPDATED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)(?:=|$)"
BREAK = "\r\n\r\n"


def canonical_url(url: Column) -> Column:
    """Without scheme, user, default port, www., fragment, tracking parameters and trailing slash; host in lower case, parameters sorted."""
    bare = F.regexp_replace(F.trim(url), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?", "")
    bare = F.regexp_replace(bare, "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r":(?:80|443)$", ""), r"^www[0-9]?\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*(/[^?]*)?", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def _headers(block: Column) -> Column:
    """array<struct<name, value>> of the lines after the first; names in lower case."""
    lines = F.filter(F.split(F.regexp_replace(block, r"^[^\r\n]*(?:\r\n|$)", ""), "\r\n"), lambda line: F.instr(line, ":") > 1)
    return F.transform(lines, lambda line: F.struct(
        F.lower(F.trim(F.substring_index(line, ":", 1))).alias("name"),
        F.trim(F.regexp_replace(line, r"^[^:]*:", "")).alias("value")))


def header(headers: Column, name: str) -> Column:
    return F.get(F.filter(headers, lambda h: h["name"] == name), F.lit(0))["value"]


def parse(records: DataFrame, record: str = "record") -> DataFrame:
    """``records`` with type, url, date (seconds), status, http (its headers), digest (of the body) and stated_digest."""
    text = F.col(record)
    parts = F.split(text, BREAK, 3)
    made = records.withColumn("__p", parts).withColumn("__w", _headers(F.get("__p", F.lit(0)))).withColumn("http", _headers(F.get("__p", F.lit(1))))
    body = F.get("__p", F.lit(2))
    stated = header(F.col("__w"), "warc-payload-digest")
    return (made.withColumn("type", header(F.col("__w"), "warc-type"))
            .withColumn("url", canonical_url(header(F.col("__w"), "warc-target-uri")))
            .withColumn("date", F.unix_timestamp(F.try_to_timestamp(header(F.col("__w"), "warc-date"), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))))
            .withColumn("status", F.regexp_extract(F.get("__p", F.lit(1)), r"^HTTP/[0-9.]+ ([0-9]{3})", 1))
            .withColumn("digest", F.when(F.length(body) > 0, F.concat(F.lit("sha256:"), F.sha2(body, 256))))
            .withColumn("stated_digest", stated).drop("__p", "__w"))


def _agrees(one: Column, two: Column) -> Column:
    """1 equal, 0 different, null not comparable."""
    return (one == two).cast("int")


def resolve(records: DataFrame, id: str = "record_id", slot: int = SLOT) -> DataFrame:
    """(id, url, date, response_id, outcome, headers, digest) of every revisit in parsed ``records``."""
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    rows = records.where("type in ('response', 'revisit')").select(
        F.col(id).alias("id"), "url", "date", "type", "http", F.floor(F.col("date") / slot).alias("slot"), (F.col("type") == "revisit").alias("late"),
        F.coalesce("digest", "stated_digest").alias("digest"), "status")
    full = (F.col("type") == "response") & (F.col("status") == "200")
    rows = rows.where(full | F.col("late"))
    response = F.when(full, F.struct("date", "id", "http", "digest"))
    rows = materialize(rows.withColumn("response", response), "records")  # bodies are read once
    known = rows.where("url is not null and date is not null")
    order = [F.col("date"), F.desc("late"), F.col("id")]  # at one second revisits come first: only earlier responses count
    inside = Window.partitionBy("url", "slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = known.withColumn("found", F.last("response", ignorenulls=True).over(inside)).where("late")
    ends = known.groupBy("url", "slot").agg(F.max_by("response", F.when(full, F.struct("date", "id"))).alias("end"))
    before = Window.partitionBy("url").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("url", "slot", F.last("end", ignorenulls=True).over(before).alias("carried")).where("carried is not null")
    met = near.join(carried, ["url", "slot"], "left").withColumn("r", F.coalesce("found", "carried"))
    met = met.select("id", "url", "date", "http", "digest", "r").unionByName(
        rows.where("late and (url is null or date is null)").select("id", "url", "date", "http", "digest", F.lit(None).cast(met.schema["r"].dataType).alias("r")))
    etag = _agrees(weak(header(F.col("http"), "etag")), weak(header(F.col("r.http"), "etag")))
    modified = _agrees(header(F.col("http"), "last-modified"), header(F.col("r.http"), "last-modified"))
    payload = _agrees(F.col("digest"), F.col("r.digest"))
    validator = F.coalesce(etag, modified)
    outcome = (F.when(F.col("r").isNull(), "missing").when((validator == 0) | (payload == 0), "mismatch")
               .when(F.coalesce(validator, payload).isNull(), "unverified").otherwise("resolved"))
    updates = F.filter("http", lambda h: h["name"].isin(*UPDATED))
    stays = F.filter("r.http", lambda h: ~F.exists(updates, lambda u: u["name"] == h["name"]))
    merged = F.array_sort(F.array_distinct(F.concat(stays, updates)))
    good = F.col("outcome") == "resolved"
    return met.withColumn("outcome", outcome).select(
        F.col("id").alias(id), "url", "date", F.col("r.id").alias("response_id"), "outcome", F.when(good, merged).alias("headers"),
        F.when(good, F.col("r.digest")).alias("digest"))
