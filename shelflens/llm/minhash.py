"""Near-duplicate documents by bottom-k sketches of word shingles under one hash function.

1. Every text becomes its set of shingle hashes; documents with equal sets fall into one class, represented by its smallest id.
2. The k smallest hashes of a class are its sketch. Two sets with similarity 0.8 keep at least ``shared`` common values among
   their sketches (for k = 32 and shared = 12 all but one pair in about 10**8 at exactly 0.8, none lost where both sets fit
   into their sketches), so they also meet on one of the ``k - shared + 1`` rarest values of each: only these are listed.
3. Per listed value every class meets the most central class of the list (whose values are the most frequent ones), and goes
   on with the one it meets most often. What the union sketch leaves is verified on the full sets.
4. Lists that overlap form clusters, so every pair that can be linked lies in one cluster. Clusters that are not yet one
   component are compared in blocks: a task counts all intersections of two blocks of full sets as matrix products and gives
   only edges enough to connect what is linked. Blocks that lie in one component are not compared.
So a group of n copies costs about n verified pairs, no step emits all pairs of a group, and a pair is left out only if its
sketches rule it out or if it is already connected.

Defined results: words are runs of anything but space and \\t-\\r, A-Z lower-cased; a text of fewer words than a shingle is one
shingle, an empty or null text has none and links with nothing; rows of one id are one document, which links if any of its
texts does; a null id is returned unlinked and kept; texts of any length are read whole; ties between ids go to the smallest; an
empty table gives an empty one; extra columns are ignored, whatever their names; ids may be of any type that can be ordered. ``shared`` is
right for ``percent`` 80 and ``k`` 32; other values of these need their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shelflens.llm.common import bit_filter, has_long_id, id_key, mix, passes, released, text_blocks, word_hashes, word_spans
from shelflens.llm.graph import components
from shelflens.session import materialize

WIDTH = 4
PERCENT = 80
SKETCH = 32
SHARED = 12
SALT_ROWS = 128
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 1 << 20
_U = np.uint64


def _word_bytes() -> np.ndarray:
    word = np.ones(256, bool)
    word[[32, *range(9, 14)]] = False
    return word


def _shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes as non-negative int64) of every text."""
    word = _word_bytes()
    weights = mix(np.arange(1, width + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
    for lo, hi, data, offsets in text_blocks(column):
        starts, ends, first = word_spans(data, offsets, word)
        words = word_hashes(data, starts, ends, 11)
        n = max(0, len(words) - width + 1)
        rolled = np.zeros(n, _U)
        for j in range(width):
            rolled += words[j:j + n] * weights[j]
        rolled = (mix(rolled) >> _U(1)).view(np.int64)
        for row in range(lo, hi):
            a, b = first[row - lo], first[row - lo + 1]
            if b - a >= width:
                yield row, np.unique(rolled[a:b - width + 1])
            elif b > a:
                short = (words[a:b] * weights[:b - a]).sum(dtype=_U) + _U(int(b - a))
                yield row, (mix(np.array([short], _U)) >> _U(1)).view(np.int64)
            else:
                yield row, np.zeros(0, np.int64)


def sketches(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, k: int = SKETCH) -> DataFrame:
    """(id, n, s1, s2, sketch): set size, two sums that identify the set, and its k smallest hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s1, s2, kept = [], [], [], []
            for _, found in _shingle_sets(batch.column(1), width):
                n.append(len(found))
                s1.append(int(found.sum(dtype=np.int64)))
                s2.append(int(mix(found.view(_U)).sum(dtype=_U).view(np.int64)))
                kept.append(found[:k])
            lengths = np.concatenate(([0], np.cumsum([len(x) for x in kept]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), lists],
                names=["id", "n", "s1", "s2", "sketch"])

    return docs.select(id_key(docs, id).alias("id"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(
        released(run), "id long, n long, s1 long, s2 long, sketch array<long>")


def _listed(classes: DataFrame, k: int, shared: int, percent: int) -> DataFrame:
    """(value, id, n, weight): the rarest sketch values of each class that it may meet others on; weight: how common all are."""
    flat = classes.select("id", "n", F.explode("sketch").alias("value"))
    common = flat.groupBy("value").agg(F.count("*").alias("c")).where("c > 1")
    whole = F.ceil(F.col("n") * percent / 100)
    places = F.when(F.col("n") <= k * percent // 100, F.col("n") - whole + 1).otherwise(F.least("n", F.lit(k)) - shared + 1)
    per_class = (flat.join(common, "value").groupBy("id", "n")
                 .agg(F.sort_array(F.collect_list(F.struct("c", "value"))).alias("seen")))  # at most k of them
    alone = F.least("n", F.lit(k)) - F.size("seen")
    return (per_class.withColumn("left", (places - alone).cast("int")).where("left > 0")
            .select("id", "n", F.aggregate("seen", F.lit(0).cast("long"), lambda s, x: s + x.c).alias("weight"),
                    F.explode(F.slice("seen", 1, F.col("left"))).alias("x"))
            .select(F.col("x.value").alias("value"), "id", "n", "weight"))


def _passing(pairs: DataFrame, classes: DataFrame, k: int, shared: int, percent: int) -> DataFrame:
    """The pairs (a, b) that set sizes and the union sketch do not rule out."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
    union = F.array_sort(F.array_union("s_a", "s_b"))
    whole = F.greatest("n_a", "n_b") <= k
    sketch = F.when(whole, union).otherwise(F.slice(union, 1, k))
    met = F.size(F.array_intersect(F.array_intersect("s_a", "s_b"), "union"))
    least = F.when(F.col("whole"), F.ceil(F.size("union") * percent / 100)).otherwise(F.lit(shared))
    return (both.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
            .withColumn("union", sketch).withColumn("whole", whole).where(met >= least).select("a", "b"))


def _similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    few, many = (one, two) if len(one) <= len(two) else (two, one)
    if not len(few) or 100 * len(few) < percent * len(many):
        return False
    place = np.searchsorted(many, few)
    place[place == len(many)] = 0
    both = int((many[place] == few).sum())
    return 100 * both >= percent * (len(few) + len(many) - both)


def _full_sets(ids: DataFrame, docs: DataFrame, id: str, text: str, width: int) -> DataFrame:
    """(id, hashes) of the documents in ``ids`` (and a few more): a bitmap of fixed size drops the rest before any shuffle."""
    bitmap = docs.sparkSession.sparkContext.broadcast(bit_filter(ids.select(F.xxhash64("id").alias("h")), "h"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = passes(bitmap.value, batch.column(1).to_numpy(zero_copy_only=False).view(_U))
            part = batch.filter(pa.array(keep))
            if part.num_rows:
                sets = [found.tobytes() for _, found in _shingle_sets(part.column(2), width)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["id", "hashes"])

    return (docs.select(id_key(docs, id).alias("id"), F.col(f"`{text}`").cast("string").alias("t")).where("id is not null")
            .select("id", F.xxhash64("id").alias("h"), "t").mapInArrow(released(named), "id long, hashes binary"))


def _verified(pairs: DataFrame, docs: DataFrame, id: str, text: str, width: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity.

    Pairs meet by (b, salt), SALT_ROWS of a hub at a time; a task holds one set of b and streams the sets of a.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    sets = materialize(_full_sets(ids, docs, id, text, width), f"{name}-sets")
    salts = pairs.groupBy("b").agg(F.count("*").alias("c")).select("b", F.ceil(F.col("c") / SALT_ROWS).cast("int").alias("salts"))
    salted = pairs.join(salts, "b").select("a", "b", (F.pmod(F.xxhash64("a"), F.col("salts"))).cast("int").alias("salt"))
    members = salted.join(sets.withColumnRenamed("id", "a"), "a").select("b", "salt", F.col("a").alias("member"), "hashes")
    hubs = (salts.join(sets.withColumnRenamed("id", "b"), "b")
            .select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("member"), "hashes"))
    met = hubs.unionByName(members).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("member").asc_nulls_first())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, reading = None, [], False
        for batch in batches:
            a, b = [], []
            for hub, member, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = np.frombuffer(raw.as_buffer(), np.int64)
                if member is None:
                    held = [*held, found] if reading and at == hub else [found]
                    at, reading = hub, True
                    continue
                reading = False
                if any(_similar(found, other, percent) for other in held):
                    a.append(member)
                    b.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return materialize(met.select("b", "member", "hashes").mapInArrow(released(check), "a long, b long"), f"{name}-links").distinct()


def _joined_blocks(clusters: DataFrame, docs: DataFrame, id: str, text: str, width: int, percent: int) -> DataFrame:
    """Edges (a, b) that connect the linked documents of each cluster; rows: (cluster, id, n, g), g the component so far.

    Members of one large component get blocks of their own, the others share blocks.
    """
    mixed = clusters.groupBy("cluster").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 <> g1").select("cluster")
    rows = materialize(clusters.join(mixed, "cluster"), "mixed")
    sizes = rows.groupBy("cluster", "g").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    sizes = sizes.withColumn("own", (F.col("m") * 2 > BLOCK_ROWS) | (F.col("s") * 2 > BLOCK_SHINGLES))
    sizes = sizes.withColumn("pool", F.when(F.col("own"), F.col("g")))
    pools = sizes.groupBy("cluster", "pool").agg(F.greatest(F.ceil(F.sum("m") / BLOCK_ROWS), F.ceil(F.sum("s") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    placed = (rows.join(sizes.select("cluster", "g", "pool"), ["cluster", "g"])
              .join(pools.withColumnRenamed("pool", "p").withColumnRenamed("cluster", "c"), (F.col("cluster") == F.col("c")) & F.col("pool").eqNullSafe(F.col("p")))
              .select("cluster", "id", "g", "pool", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")))
    placed = materialize(placed, "placed")
    blocks = placed.select("cluster", "pool", "part").distinct()
    other = blocks.select("cluster", F.col("pool").alias("pool2"), F.col("part").alias("part2"))
    number = lambda pool, part: F.struct(F.coalesce(pool, F.lit(-1)).alias("pool"), part.alias("part"))
    # a block meets every other block of its cluster, but no block of the same single component
    meets = blocks.join(other, "cluster").where("pool is null or pool2 is null or pool <> pool2")
    units = (placed.join(meets.withColumnRenamed("pool", "p").withColumnRenamed("part", "q").withColumnRenamed("cluster", "c"),
                         (F.col("cluster") == F.col("c")) & F.col("pool").eqNullSafe(F.col("p")) & (F.col("part") == F.col("q")))
             .withColumn("x", number(F.col("pool"), F.col("part"))).withColumn("y", number(F.col("pool2"), F.col("part2")))
             .select("cluster", "id", "g", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), (F.col("x") <= F.col("y")).alias("left"),
                     (F.col("x") == F.col("y")).alias("both")))
    sets = materialize(_full_sets(placed.select("id"), docs, id, text, width), "block-sets")

    def compare(part: pa.Table) -> pa.Table:
        ids, g, left, both = (part[c].to_numpy() for c in ("id", "g", "left", "both"))
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part["hashes"]]
        n = np.array([len(x) for x in sets])
        one, two = np.flatnonzero(left | both), np.flatnonzero(~left | both)
        row = np.repeat(np.arange(len(ids)), n)
        _, code, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        keep = seen[code] > 1
        _, code = np.unique(code[keep], return_inverse=True)
        row = row[keep]
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        place = np.zeros(len(ids), np.int64)
        place[two] = np.arange(len(two))
        met = np.zeros((len(one), len(two)), np.float32)
        for at in range(0, int(code[-1]) + 1 if len(code) else 0, 2048):
            a, b = np.searchsorted(code, (at, at + 2048))
            hits = np.zeros((len(ids), 2048), np.float32)
            hits[row[a:b], code[a:b] - at] = 1
            met += hits[one] @ hits[two].T
        linked = (100 * met >= percent * (n[one][:, None] + n[two][None, :] - met)) & (g[one][:, None] != g[two][None, :]) & (met > 0)
        x, y = np.nonzero(linked)
        x, y = one[x], two[y]
        low = np.arange(len(ids))
        while len(x):
            before, m = low.copy(), np.minimum(low[x], low[y])
            np.minimum.at(low, x, m)
            np.minimum.at(low, y, m)
            low = low[low]
            if (low == before).all():
                break
        moved = np.flatnonzero(low != np.arange(len(ids)))
        return pa.table({"a": ids[moved], "b": ids[low[moved]]})

    return units.join(sets, "id").groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long")


def _named(docs: DataFrame, id: str, text: str, judge) -> DataFrame:
    """What ``judge`` gives for documents known by a hash of their id, with the ids themselves."""
    keyed = docs.select(id_key(docs, id).alias("id"), F.col(f"`{id}`").alias("own"), F.col(f"`{text}`").alias("text"))
    found = materialize(judge(keyed.select("id", "text")), "judged")
    names = materialize(keyed.select("id", "own").where("id is not null").distinct(), "names")
    least = found.join(names, "id").groupBy("component_id").agg(F.min("own").alias("least"))
    joined = found.join(names, "id", "left").join(least, "component_id", "left")
    return joined.select(F.col("own").alias(id), "n_shingles", F.col("least").alias("component_id"),
                         F.coalesce(F.col("own") == F.col("least"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT,
                    k: int = SKETCH, shared: int = SHARED) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Ids that are no whole numbers are compared as they are: the component is the smallest in their own order.
    """
    if not has_long_id(docs, id):
        return _named(docs, id, text, lambda keyed: near_duplicates(keyed, "id", "text", width, percent, k, shared))
    all_rows = materialize(sketches(docs, id, text, width, k), "sketches")
    known = all_rows.where("id is not null and n > 0")
    classes = materialize(known.groupBy("n", "s1", "s2").agg(F.min("id").alias("id"), F.any_value("sketch").alias("sketch")), "classes")
    members = materialize(known.select("id", "n", "s1", "s2").join(
        classes.select(F.col("id").alias("rep"), "n", "s1", "s2"), ["n", "s1", "s2"]).select("id", "rep"), "members")
    lists = materialize(_listed(classes, k, shared, percent), "lists")

    hub = lists.groupBy("value").agg(F.max(F.struct("weight", F.negative("id").alias("o"), "n")).alias("hub"))
    star = (lists.join(hub, "value").select(F.col("id").alias("a"), F.negative("hub.o").alias("b"), "n", F.col("hub.n").alias("m"))
            .groupBy("a", "b", "n", "m").agg(F.count("*").alias("c")).where("a <> b"))
    star = materialize(star, "stars")
    close = star.where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    first = close.groupBy("a").agg(F.max(F.struct("c", F.negative("b").alias("o"))).alias("x")).select("a", F.negative("x.o").alias("b"))
    pairs = materialize(_passing(first, classes, k, shared, percent), "pairs")
    links = _verified(pairs, docs, id, text, width, percent, "first")
    # so far every class hangs on one hub at most; that is enough to tell which clusters are done
    hung = links.groupBy("a").agg(F.min("b").alias("hub")).withColumnRenamed("a", "id")
    clusters = components(star.select("a", "b"), "clusters").withColumnRenamed("node", "id").withColumnRenamed("component", "cluster")
    clusters = (lists.select("id", "n").distinct().join(clusters, "id").join(hung, "id", "left")
                .select("cluster", "id", "n", F.coalesce("hub", "id").alias("g")))
    more = materialize(_joined_blocks(materialize(clusters, "clustered"), docs, id, text, width, percent), "more")
    groups = materialize(components(links.unionByName(more), "linked"), "groups")
    if members.distinct().groupBy("id").count().where("count > 1").isEmpty():
        placed = members.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    else:
        same = members.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
        placed = components(links.unionByName(more).unionByName(same), "classes").withColumnRenamed("node", "id")
    placed = placed.groupBy("id").agg(F.min("component").alias("component"))
    placed = all_rows.select(F.col("id"), F.col("n").alias("n_shingles")).join(placed, "id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return placed.select(F.col("id").alias(id), "n_shingles", component.alias("component_id"),
                         F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
