"""Benchmark decontamination by a distributed positional index of the training text.

1. The benchmark becomes windows of ``width`` consecutive words (an item of fewer words is one window).
2. Corpus counts of the benchmark's terms are added up; each window gets its rarest terms as anchors.
3. The index holds a posting (term, document, position) for every occurrence of an anchor term, in the shared folder.
4. The list of a window's rarest term is intersected, offset-adjusted, with the list of its next one: equal starts are phrase
   candidates, terms within the window's length of each other are proximity matches.
5. Phrase candidates are verified word by word on the whole texts of their documents, and hit words are marked there.
Bitmaps of fixed size keep other terms and documents away from the shuffles; they never decide a match.

Defined results: words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters; null or wordless texts have
no words and no hits, null or wordless items no windows; an item without an id marks words but is not listed; repeated rows
and rows with a null id are judged each on its own text; texts of any length are read whole; an empty benchmark leaves every row
clean, an empty table gives an empty one; terms equally rare are taken by hash; other columns are ignored, whatever their names; ids keep
their type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from shelflens.llm.common import bit_filter, mix, passes, released, text_blocks, word_hashes, word_spans
from shelflens.session import materialize

WIDTH = 10
FOLDED = 1 << 20
_U = np.uint64


def _word_bytes() -> np.ndarray:
    word = np.zeros(256, bool)
    word[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    return word


def _words(column: pa.Array) -> Iterator[tuple]:
    """Per block: first row, end row, bytes, word starts, word ends, first word of each row, word hashes (int64)."""
    word = _word_bytes()
    for lo, hi, data, offsets in text_blocks(column):
        starts, ends, first = word_spans(data, offsets, word)
        yield lo, hi, data, starts, ends, first, word_hashes(data, starts, ends, 23)


def windows(items: DataFrame, id: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(item, window, words, terms) of every window: a key, its words joined by spaces, their hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for lo, hi, data, starts, ends, first, terms in _words(batch.column(1)):
                raw = data.tobytes().lower()
                words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
                for row in range(lo, hi):
                    a, b = int(first[row - lo]), int(first[row - lo + 1])
                    for at in range(a, max(a + 1, b - width + 1)) if b > a else ():
                        to = min(b, at + width)
                        place = np.arange(1, to - at + 1, dtype=_U)
                        key = mix(np.array([(mix(terms[at:to] + place) * (place | _U(1))).sum(dtype=_U)], _U)).view(np.int64)[0]
                        out.append((ids[row], int(key), b" ".join(words[at:to]).decode("utf8", "replace"), terms[at:to].view(np.int64).tolist()))
            columns = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64())))],
                names=["item", "window", "words", "terms"])

    return items.select(F.col(id).cast("string").alias("i"), F.col(text).cast("string").alias("t")).mapInArrow(
        released(run), "item string, window long, words string, terms array<long>")


def _term_counts(docs: DataFrame, bitmap) -> DataFrame:
    """Corpus counts (term, n) of the terms in the bitmap, added up in each task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0

        def folded() -> pa.RecordBatch:
            terms, counts = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts.astype(np.int64))], names=["term", "n"])

        for batch in batches:
            for *_, terms in _words(batch.column(0)):
                found = terms[passes(bitmap.value, terms)]
                waiting.append(found)
                held += len(found)
                if held > FOLDED:
                    yield folded()
                    waiting, held = [], 0
        if held:
            yield folded()

    return docs.select("t").mapInArrow(released(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _postings(docs: DataFrame, bitmap) -> DataFrame:
    """(own, doc, term, pos): a posting per occurrence of an anchor term, and per row one with its id, a null term and its number of words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).to_numpy()
            for lo, hi, _, _, _, first, terms in _words(batch.column(2)):
                at = np.flatnonzero(passes(bitmap.value, terms))
                row = np.searchsorted(first, at, "right") - 1
                lengths = np.diff(first)
                none = np.ones(len(at) + hi - lo, bool)
                none[:len(at)] = False
                own = pa.concat_arrays([pa.nulls(len(at), batch.column(0).type), batch.column(0).slice(lo, hi - lo)])
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(np.concatenate((ids[lo + row], ids[lo:hi]))),
                     pa.array(np.concatenate((terms[at].view(np.int64), np.zeros(hi - lo, np.int64))), mask=none),
                     pa.array(np.concatenate((at - first[row], lengths)).astype(np.int64))], names=["own", "doc", "term", "pos"])

    fields = [T.StructField("own", docs.schema["own"].dataType), *[T.StructField(c, T.LongType()) for c in ("doc", "term", "pos")]]
    return docs.select("own", "doc", "t").mapInArrow(released(run), T.StructType(fields))


def _marked(rows: DataFrame) -> DataFrame:
    """Rows (own, doc, t, found: array of (start, window, words)) to (own, doc, n_words, n_hit, windows) by comparing whole words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, seen = [], [], []
            for lo, hi, data, starts, ends, first, _ in _words(batch.column(2)):
                raw = data.tobytes().lower()
                for row in range(lo, hi):
                    a, b = int(first[row - lo]), int(first[row - lo + 1])
                    hit, keys = np.zeros(b - a, bool), set()
                    for x in batch.column(3)[row].as_py():
                        wanted = x["words"].encode()
                        at, to = a + x["start"], a + x["start"] + x["width"]
                        if to <= b and b" ".join(raw[s:e] for s, e in zip(starts[at:to].tolist(), ends[at:to].tolist())) == wanted:
                            hit[at - a:to - a] = True
                            keys.add(x["window"])
                    n_words.append(b - a)
                    n_hit.append(int(hit.sum()))
                    seen.append(sorted(keys))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(seen, pa.list_(pa.int64()))],
                names=["own", "doc", "n_words", "n_hit", "windows"])

    fields = [T.StructField(c, T.LongType()) for c in ("doc", "n_words", "n_hit")] + [T.StructField("windows", T.ArrayType(T.LongType()))]
    return rows.select("own", "doc", "t", "found").mapInArrow(released(run), T.StructType([rows.schema["own"], *fields]))


def contamination(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, n_words, n_hit, n_items, items, n_near, contaminated) for every row of ``docs``.

    items: sorted ids (as text) of the items with a window in the text; n_near: windows whose two rarest terms stand within
    the window's length of each other although the window itself starts at none of these places.
    """
    spark = docs.sparkSession
    own, t = F.col(f"`{id}`"), F.col(f"`{text}`").cast("string")
    source = docs.select(own.alias("own"), F.xxhash64(own.isNull(), own, t).alias("doc"), t.alias("t"))  # rows equal in both share a key
    made = materialize(windows(items, item_id, item_text, width), "windows")
    distinct = made.groupBy("window").agg(F.first("words").alias("words"), F.first("terms").alias("terms"))
    at = distinct.select("window", F.size("terms").alias("width"), F.posexplode("terms").alias("off", "term"))
    terms = at.groupBy("window", "width", "term").agg(F.min("off").alias("off"))
    vocabulary = spark.sparkContext.broadcast(bit_filter(made.select(F.explode("terms").alias("term")), "term"))
    counts = _term_counts(source, vocabulary)
    ranked = (terms.join(counts, "term", "left").groupBy("window", "width")
              .agg(F.sort_array(F.collect_list(F.struct("n", "term", "off"))).alias("a"))  # at most ``width`` terms
              .where(F.col("a")[0].n.isNotNull()))  # a term the corpus lacks sorts first: the window cannot occur
    anchors = materialize(ranked.select("window", "width", F.col("a")[0].alias("one"), F.coalesce(F.get("a", F.lit(1)), F.col("a")[0]).alias("two")),
                          "anchors")
    rare = anchors.select(F.explode(F.array("one.term", "two.term")).alias("term"))
    listed = materialize(_postings(source, spark.sparkContext.broadcast(bit_filter(rare, "term"))), "postings")
    rows = listed.where("term is null").select("own", "doc", F.col("pos").alias("n_words"))
    postings = materialize(listed.where("term is not null").select("doc", "term", "pos").distinct(), "distinct-postings")

    starts = (postings.join(anchors, postings.term == F.col("one.term"))
              .select("doc", "window", "width", "pos", (F.col("pos") - F.col("one.off")).alias("start"), F.col("two.term").alias("term"),
                      F.col("two.off").alias("off")))
    near = (starts.withColumn("slot", F.explode(F.sequence(F.greatest(F.lit(0), F.floor(F.col("pos") / width) - 1).cast("long"),
                                                           (F.floor(F.col("pos") / width) + 1).cast("long"))))
            .join(postings.select("doc", "term", F.col("pos").alias("p2"), F.floor(F.col("pos") / width).cast("long").alias("slot")),
                  ["doc", "term", "slot"])
            .where(F.abs(F.col("p2") - F.col("pos")) < F.col("width"))
            .groupBy("doc", "window", "width", "start").agg(F.max((F.col("p2") == F.col("start") + F.col("off")) & (F.col("start") >= 0)).alias("phrase")))
    near = materialize(near, "met")
    found = (near.where("phrase").join(distinct.select("window", "words"), "window")
             .groupBy("doc").agg(F.collect_list(F.struct("start", "window", "width", "words")).alias("found")))  # a document's places
    found = materialize(found, "found")
    wanted = spark.sparkContext.broadcast(bit_filter(found.select(F.xxhash64("doc").alias("h")), "h"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(passes(wanted.value, batch.column(1).to_numpy().view(_U))))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3)], names=["doc", "own", "t"])

    keyed = source.select("doc", F.xxhash64("doc").alias("h"), "own", "t")
    texts = keyed.mapInArrow(released(named), keyed.select("doc", "own", "t").schema)
    marked = materialize(_marked(texts.join(found, "doc")).withColumn("row", F.monotonically_increasing_id()), "marked")
    hits = marked.select("row", F.explode("windows").alias("window")).join(made.where("item is not null").select("item", "window").distinct(), "window")
    listed_items = hits.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))  # the items of one text
    judged = (marked.join(listed_items, "row", "left")
              .select("own", "doc", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items")))
    clean = rows.join(found.select("doc"), "doc", "left_anti").select(
        "own", "doc", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    close = near.where("not phrase").groupBy("doc").agg(F.countDistinct("window").alias("n_near"))
    every = judged.unionByName(clean).join(close, "doc", "left")
    return every.select(F.col("own").alias(id), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        "items", F.coalesce("n_near", F.lit(0)).alias("n_near"), (F.col("n_hit") > 0).alias("contaminated"))
