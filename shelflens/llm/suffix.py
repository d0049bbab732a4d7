"""Removal of byte strings that occur more than once, by LCP values from a Burrows-Wheeler transform.

A window is a string of ``length`` bytes inside one text. Windows that start anywhere else too are repeated; every byte of a
repeated window is removed.

1. Each window is filed under its leftmost minimal gram (``gram`` bytes, by hash). Equal windows have the same gram at the same
   place, so they are filed alike. Consecutive windows under one gram are a run; its bytes are the run's context.
2. Grams that occur once cannot repeat and drop out (a bitmap of fixed size keeps most of them from the shuffle).
3. A context that occurs twice is repeated as a whole. What is left are contexts that differ from all others under their gram.
4. Those are put together per gram with one copy of the other contexts, and their common prefixes are derived: breadth-first
   backward extension on the BWT of a batch finds the boundaries by increasing LCP (those below 16 are known from the sort) and
   stops at ``length``. Boundaries without a value by then are common prefixes of ``length`` or more.
5. A gram whose contexts hold more than ``GROUP_BYTES`` is divided exactly: its windows fall into classes by where the gram stands in
   them (``SPREADS`` places to a class), and the bytes that all windows of a class share around the gram are its new key. Equal windows
   have equal keys. Keys that are still too large are divided again, down to one place, where the key is the whole window.
6. The marked spans of a text are joined to it and cut out.

Defined results: a null text is an empty text; texts shorter than a window are kept whole; matches never cross texts; rows that
repeat an id and text repeat each other, and all copies of a window go, none is kept; texts of any length are read whole; an empty table
gives an empty one; extra columns are ignored, whatever their names; ids keep their type. Rows are told apart by a 64-bit hash of id
and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from shelflens.llm.common import bit_filter, byte_values, mix, passes, prefix_hash, released, span_hash, text_blocks
from shelflens.session import materialize

LENGTH = 200
GRAM = 48
CHUNK = 60_000  # bytes of contexts put together; with 16-bit ranks a batch sorts and ranks fastest
GROUP_BYTES = 1 << 17  # bytes of contexts under one key; a batch takes about 100 to 300 times its bytes of memory
SPREADS = (39, 10, 3, 1)
BITS = 26
_U = np.uint64
_PLACE = _U((1 << 31) - 1)


def _runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple:
    """Runs of a block: text number, gram hash, context hash, first window, last window (places inside the text)."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    n, width = len(data), length - gram + 1
    if n < length:
        return none
    sums = prefix_hash(data, byte_values(37, False))
    at = np.arange(n - gram + 1)
    grams = span_hash(sums, at, at + gram)
    low = (grams & ~_PLACE) | at.astype(_U)  # ties go to the left
    reach = 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[:len(low) - (width - reach)], low[width - reach:])
    least = (low & _PLACE).astype(np.int64)
    # windows inside one text
    sizes = np.diff(offsets)
    count = np.maximum(sizes - length + 1, 0)
    starts = np.repeat(offsets[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    if not len(starts):
        return none
    text = np.repeat(np.arange(len(sizes)), count)
    least = least[starts]
    first = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (text[1:] != text[:-1]))))
    last = np.append(first[1:], len(starts)) - 1
    a, b = starts[first], starts[last]
    base = offsets[text[first]]
    return text[first], grams[least[first]].view(np.int64), span_hash(sums, a, b + length).view(np.int64), a - base, b - base


def _gram_counts(source: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0

        def folded() -> pa.RecordBatch:
            grams, counts = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(grams), pa.array(counts.astype(np.int64))], names=["gram", "c"])

        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                grams = _runs(data, offsets, length, gram)[1]
                waiting.append(grams)
                held += len(grams)
                if held > 1 << 20:
                    yield folded()
                    waiting, held = [], 0
        if held:
            yield folded()

    return source.select("t").mapInArrow(released(run), "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def _candidate_runs(source: DataFrame, bitmap, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for lo, _, data, offsets in text_blocks(batch.column(1)):
                text, grams, contexts, first, last = _runs(data, offsets, length, gram)
                keep = passes(bitmap.value, grams.view(_U))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[keep]), pa.array(contexts[keep]), pa.array(keys[lo + text[keep]]), pa.array(first[keep].astype(np.int32)),
                     pa.array(last[keep].astype(np.int32))], names=["gram", "context", "doc", "first", "last"])

    return source.select("doc", "t").mapInArrow(released(run), "gram long, context long, doc long, first int, last int")


def _order(*keys: np.ndarray) -> np.ndarray:
    """Stable order by the last key, then the one before, ...: radix sort over 16 bits at a time."""
    order = None
    for key in keys:
        for shift in (0, 16) if len(key) > 65_536 else (0,):
            part = (key >> shift).astype(np.uint16)
            order = np.argsort(part, kind="stable") if order is None else order[np.argsort(part[order], kind="stable")]
    return order


def repeated_starts(contexts: list[bytes], length: int) -> np.ndarray:
    """For the contexts one after another (each followed by a separator): which positions start a string of ``length`` bytes that
    occurs at another position too."""
    raw = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int64) + 1
    raw[np.cumsum([len(c) + 1 for c in contexts]) - 1] = 0
    n = len(raw)
    mark = np.zeros(n + 1, np.int64)
    present = np.zeros(257, np.int64)
    present[raw] = 1
    size = int(present.sum())
    symbol = (np.cumsum(present) - 1)[raw]
    # order of the rotations by their first 1, 2, 4, ... symbols, until ``length`` are covered
    rank, depth, known = symbol, 1, {}
    while True:
        behind = np.concatenate((rank[depth % n:], rank[:depth % n]))
        order = _order(behind, rank)
        one, two = rank[order], behind[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate(([0], np.cumsum((one[1:] != one[:-1]) | (two[1:] != two[:-1]))))
        rank, depth = fresh, depth * 2
        if depth in (8, 16):
            known[depth] = rank
        if depth > length or rank[order[-1]] == n - 1:
            break
    bwt = symbol[order - 1]
    counts = np.bincount(symbol, minlength=size)
    before = np.concatenate(([0], np.cumsum(counts)[:-1]))  # where each symbol's rotations begin
    # row c: where a rotation that begins with c and goes on with the first i of the order would stand
    occurs = np.empty((size, n + 1), np.uint16 if n < 65_535 else np.uint32)
    occurs[:, 0] = before
    for c in range(size):
        np.cumsum(bwt == c, dtype=occurs.dtype, out=occurs[c, 1:])
        occurs[c, 1:] += occurs.dtype.type(before[c])
    # unset[i]: no common prefix of rotations i - 1 and i was found below the level reached
    unset = np.ones(n + 1, bool)
    unset[[0, n]] = False
    unset[before] = False
    level, now = 1, np.flatnonzero(~unset)
    if length > 16 and 16 in known:
        # the sort tells which prefixes are shorter than 8 and than 16; those from 8 on lead to all that have 16
        shorter = {d: np.flatnonzero(np.diff(known[d][order])) + 1 for d in (8, 16)}
        unset[shorter[16]] = False
        level, now = 16, np.setdiff1d(shorter[16], shorter[8], assume_unique=True)
    for _ in range(level, length):
        reached = occurs.take(now, axis=1).ravel()
        reached = reached[np.flatnonzero(unset.take(reached))]
        if not len(reached):
            break
        unset[reached] = False
        place = np.arange(len(reached))  # each once: a place is kept by whoever wrote it last
        mark[reached] = place
        now = reached[mark[reached] == place]
    found = np.zeros(n, bool)
    found[order] = unset[:-1] | unset[1:]
    return found


def _compared(rows: DataFrame, length: int) -> DataFrame:
    """Repeated spans (doc, start, end) of the contexts that occur once; rows: (gram, once, doc, first, bytes), by gram."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group: list[tuple] = []  # the gram being read
        size, grown, at = 0, 0, None

        def solved() -> pa.RecordBatch:
            found = repeated_starts([r[3] for r in held], length)
            doc, start, end, begin = [], [], [], 0
            for once, d, first, raw in held:
                if once:
                    hit = np.flatnonzero(found[begin:begin + len(raw) - length + 1])
                    if len(hit):
                        cut = np.flatnonzero(np.diff(hit) > length)
                        for a, b in zip(hit[np.concatenate(([0], cut + 1))].tolist(), hit[np.append(cut, len(hit) - 1)].tolist()):
                            doc.append(d)
                            start.append(first + a)
                            end.append(first + b + length)
                begin += len(raw) + 1
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                                              names=["doc", "start", "end"])

        for batch in batches:
            grams, once, docs, firsts = (batch.column(i).to_pylist() for i in range(4))
            for g, o, d, f, raw in zip(grams, once, docs, firsts, batch.column(4)):
                if g != at and group:
                    if held and size + grown > CHUNK:
                        yield solved()
                        held, size = [], 0
                    held += group
                    size += grown
                    group, grown = [], 0
                at = g
                raw = raw.as_py()
                group.append((o, d, f, raw))
                grown += len(raw) + 1
        if held and size + grown > CHUNK:
            yield solved()
            held = []
        held += group
        if held:
            yield solved()

    return rows.select("gram", "once", "doc", "first", "bytes").mapInArrow(released(run), "doc long, start long, end long")


def _divided(rows: DataFrame, length: int, spread: int) -> DataFrame:
    """Parts of contexts, (gram, once, doc, first, place, bytes), whose windows hold the gram within the same ``spread`` places.

    ``place`` is where the gram stands in the bytes. The part's ``gram`` is the hash of its class and of the bytes all its windows share.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, seeds = byte_values(41, False), mix(np.arange(1, length + 2, dtype=_U))
        for batch in batches:
            out: list[tuple] = []
            for once, doc, first, place, raw in zip(*[c.to_pylist() for c in batch.columns]):
                sums = prefix_hash(np.frombuffer(raw, np.uint8), values)
                last = len(raw) - length  # the last window; window k holds the gram at place - k
                for low in range((place - last) // spread * spread, place + 1, spread):
                    high = low + spread - 1
                    key = span_hash(sums, np.array([place - low]), np.array([place - high + length])) + seeds[low]
                    a, b = max(0, place - high), min(last, place - low)
                    out.append((int(mix(key).view(np.int64)[0]), once, doc, first + a, place - a, raw[a:b + length]))
            columns = list(zip(*out)) if out else [[]] * 6
            types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["gram", "once", "doc", "first", "place", "bytes"])

    return rows.select("once", "doc", "first", "place", "bytes").mapInArrow(released(run), "gram long, once boolean, doc long, first long, place long, bytes binary")


def _within_large(large: DataFrame, length: int) -> list[DataFrame]:
    """Repeated spans (doc, start, end) of contexts whose gram holds too many bytes for one task."""
    found = []
    for spread in SPREADS:
        parts = materialize(_divided(large, length, spread), "parts")
        sizes = parts.groupBy("gram").agg(F.count("*").alias("c"), F.sum(F.length("bytes") + 1).alias("size"), F.max("once").alias("open"))
        live = materialize(sizes.where("c > 1 and open").select("gram", (F.col("size") > GROUP_BYTES).alias("large")), "live")
        if spread == 1:  # the key is the window
            found.append(parts.where("once").join(live, "gram", "left_semi").select("doc", F.col("first").alias("start"), (F.col("first") + length).alias("end")))
            break
        known = materialize(parts.join(live, "gram"), "known")
        found.append(_compared(known.where("not large").repartition("gram").sortWithinPartitions("gram"), length))
        large = known.where("large")
        if large.isEmpty():
            break
    return found


def _named(source: DataFrame, docs: DataFrame, keep: bool = True) -> DataFrame:
    """Rows of ``source`` whose doc may be (keep) or is certainly not (not keep) among ``docs``, by a bitmap of fixed size."""
    bitmap = source.sparkSession.sparkContext.broadcast(bit_filter(docs.select("doc").distinct(), "doc", 24))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = passes(bitmap.value, batch.column(batch.schema.get_field_index("doc")).to_numpy().view(_U))
            yield batch.filter(pa.array(hit == keep))

    return source.mapInArrow(released(run), source.schema)


def _cut(rows: DataFrame) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) from (id, t, spans); kept is the text that is left."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                raw = b"" if not text.is_valid else text.as_buffer().to_pybytes()
                parts, removed, runs, at = [], 0, 0, 0
                marks = spans.values if spans.is_valid else None
                if marks is not None and len(marks):
                    start, end = marks.field(0).to_numpy(), marks.field(1).to_numpy()
                    order = np.argsort(start, kind="stable")
                    start, end = start[order], np.maximum.accumulate(end[order])
                    fresh = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
                    for a, b in zip(start[fresh].tolist(), end[np.append(fresh[1:], len(start)) - 1].tolist()):
                        parts.append(raw[at:a])
                        removed += b - a
                        runs += 1
                        at = b
                parts.append(raw[at:])
                kept = b"".join(parts)
                out.append((len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out)) if out else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]],
                                             names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    made = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    made += [T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())]
    return rows.select("id", "t", "spans").mapInArrow(released(run), T.StructType([rows.schema["id"], *made]))


def repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, start, end): spans of repeated bytes, which may overlap; doc is the row's hash."""
    source = _source(docs, id, text)
    spark = docs.sparkSession
    repeated = materialize(_gram_counts(source, length, gram).where("c > 1").select("gram"), "grams")
    bitmap = spark.sparkContext.broadcast(bit_filter(repeated, "gram", BITS))
    runs = materialize(_candidate_runs(source, bitmap, length, gram).join(repeated, "gram", "left_semi"), "runs")
    contexts = materialize(runs.groupBy("gram", "context").agg(F.count("*").alias("c"), F.max("doc").alias("rep"),
                                                                   F.max(F.col("last") - F.col("first")).alias("reach")), "contexts")
    groups = contexts.groupBy("gram").agg(F.count("*").alias("m"), F.sum((F.col("c") == 1).cast("int")).alias("once"),
                                          F.sum(F.col("reach") + length + 1).alias("size"))
    open_groups = materialize(groups.where("m > 1 and once > 0").select("gram", "m", (F.col("size") > GROUP_BYTES).alias("large")), "open")
    judged = contexts.join(open_groups, "gram", "left").where("c > 1 or m is not null")
    placed = materialize(
        runs.join(judged, ["gram", "context"]).select(
            "gram", "doc", "first", "last", (F.col("c") > 1).alias("whole"), (F.col("m").isNotNull() & (F.col("doc") == F.col("rep"))).alias("fetch"),
            F.coalesce("large", F.lit(False)).alias("large")), "placed")
    whole = placed.where("whole").select("doc", F.col("first").cast("long").alias("start"), (F.col("last") + length).cast("long").alias("end"))

    wanted = (placed.where("fetch").groupBy("doc")
              .agg(F.collect_list(F.struct("first", "last", "gram", "whole", "large")).alias("places")))  # places of one text
    wanted = materialize(wanted, "wanted")

    def gram_place(context: bytes, reach: int, key: int) -> int:
        """Where the gram of all windows of a context stands: the leftmost place of its hash that all of them cover."""
        sums, at = prefix_hash(np.frombuffer(context, np.uint8), byte_values(37, False)), np.arange(reach, length - gram + 1)
        return reach + int(np.argmax(span_hash(sums, at, at + gram).view(np.int64) == key))

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        names = ["gram", "once", "large", "doc", "first", "place", "bytes"]
        for batch in batches:
            out: list[tuple] = []
            for doc, t, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                raw = t.as_buffer()
                for p in places.as_py():
                    context = raw[p["first"]:p["last"] + length].to_pybytes()
                    place = gram_place(context, p["last"] - p["first"], p["gram"]) if p["large"] else None
                    out.append((p["gram"], not p["whole"], p["large"], doc, p["first"], place, context))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    texts = _named(source.select("doc", "t"), wanted).dropDuplicates(["doc"])
    pieces = materialize(texts.join(wanted, "doc").select("doc", "t", "places").mapInArrow(
        released(sliced), "gram long, once boolean, large boolean, doc long, first long, place long, bytes binary"), "pieces")
    found = whole.unionByName(_compared(pieces.where("not large").repartition("gram").sortWithinPartitions("gram"), length))
    large = pieces.where("large")
    for part in [] if large.isEmpty() else _within_large(large, length):
        found = found.unionByName(part)
    return found


def _source(docs: DataFrame, id: str, text: str) -> DataFrame:
    t = F.col(f"`{text}`").cast("string")
    return docs.select(F.xxhash64(F.col(f"`{id}`"), t).alias("doc"), F.col(f"`{id}`").alias("id"), t.alias("t"))


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row of ``docs``."""
    source = _source(docs, id, text)
    spans = repeated_spans(docs, id, text, length, gram)
    by_doc = materialize(spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")  # spans of one text
    cut = _named(source, by_doc).join(by_doc, "doc", "left").select("id", "t", "spans")
    clean = _named(source, by_doc, keep=False).select("id", "t", F.lit(None).cast(by_doc.schema["spans"].dataType).alias("spans"))
    return _cut(cut.unionByName(clean)).withColumnRenamed("id", id)
