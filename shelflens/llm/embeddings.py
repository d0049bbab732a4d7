"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside them.

1. Vectors are scaled to length 1 in double precision; equal vectors become one with a number of copies.
2. Spherical k-means on a bounded sample (``SAMPLE_ROWS`` rows by hash) gives the cells' centres; every vector has a home cell.
3. A cell is cut into blocks of ``BLOCK`` vectors, each packed as one row. Every two blocks are compared but those that the centres
   rule out: a block lies at least ``gap`` from the plane between its own centre and another one, and vectors at cosine
   ``least`` are at most sqrt(2 - 2 least) apart, so two blocks whose gaps add up to more hold no link. No link is missed.
4. Blocks meet in a nested loop over partitions, which streams them: no vector is shuffled a second time, and a task holds one
   partition of blocks and one Arrow batch. Each pair of blocks is one matrix product. It gives the number of links per vector,
   and edges enough to connect what is linked, not all pairs. Directions that fill all dimensions have small gaps: their work
   grows with the square of their number.
5. Components are contracted from these edges; one vector of each is kept.

Defined results: null, empty or zero vectors and vectors with null or non-finite components link with nothing (also not with
their copies); vectors of different lengths never link; repeated rows of one id are one vector each way: they count as links
of one another only under different ids; a null id is returned unlinked; ties between ids go to the smallest; an empty table gives
an empty one; extra columns are ignored, whatever their names; ids may be of any type that can be ordered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelflens.llm.common import has_long_id, id_key
from shelflens.llm.graph import components
from shelflens.session import materialize

LEAST = 0.95
SAMPLE_ROWS = 20_000
CELLS = 64
ROUNDS = 8
BLOCK = 1024


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat doubles scaled to length 1, lengths, and which rows are usable."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)  # a null component is a NaN
    row = np.repeat(np.arange(len(lengths)), lengths)
    with np.errstate(all="ignore"):
        top = np.zeros(len(lengths))
        np.maximum.at(top, row, np.abs(flat))
        flat = flat / top[row]  # so that no square overflows or vanishes
        norm = np.sqrt(np.bincount(row, flat * flat, len(lengths)))
        flat = flat / norm[row]
    return flat, lengths, (lengths > 0) & np.isfinite(norm) & (norm > 0)


def _scaled(vectors: DataFrame, id: str, column: str) -> DataFrame:
    """(id, dim, v): v the scaled vector's bytes, null where it cannot link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, lengths, ok = _unit(batch.column(1))
            ends = np.cumsum(lengths)
            raw = [(np.ascontiguousarray(flat[e - n:e]) + 0.0).tobytes() if good else None for n, e, good in zip(lengths.tolist(), ends.tolist(), ok.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths.astype(np.int32)), pa.array(raw, pa.binary())], names=["id", "dim", "v"])

    return vectors.select(id_key(vectors, id).alias("id"), F.col(f"`{column}`").cast("array<double>").alias("x")).mapInArrow(run, "id long, dim int, v binary")


def _centres(distinct: DataFrame, cells: int, rounds: int, sample_rows: int) -> dict[int, np.ndarray]:
    """Centres per vector length, from a sample of at most ``sample_rows`` rows taken by hash: the only rows the driver sees."""
    sample = distinct.select("dim", "v").orderBy(F.xxhash64("v")).limit(sample_rows).toArrow()
    dims, out = sample["dim"].to_numpy(), {}
    for dim in np.unique(dims).tolist():
        x = np.frombuffer(b"".join(sample["v"].take(np.flatnonzero(dims == dim)).to_pylist()), float).reshape(-1, dim)
        centres = x[:max(1, min(cells, len(x) // 16))].copy()
        for _ in range(rounds):
            near = np.argmax(x @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            norm = np.linalg.norm(sums, axis=1)
            centres = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-300)[:, None], centres)
        out[int(dim)] = centres
    return out


def _placed(distinct: DataFrame, centres) -> DataFrame:
    """(node, dim, cell, copies, v): every vector in its home cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            cell = np.zeros(len(dims), np.int32)  # a length the sample lacks: one cell
            for dim in np.unique(dims):
                c = centres.value.get(int(dim))
                if c is not None:
                    rows = np.flatnonzero(dims == dim)
                    x = np.frombuffer(b"".join(batch.column(3).take(pa.array(rows)).to_pylist()), float).reshape(-1, dim)
                    cell[rows] = (x @ c.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell), batch.column(2), batch.column(3)],
                                             names=["node", "dim", "cell", "copies", "v"])

    return distinct.select("node", "dim", "copies", "v").mapInArrow(run, "node long, dim int, cell int, copies long, v binary")


def _gaps(x: np.ndarray, cell: int, c: np.ndarray | None) -> np.ndarray:
    """Per centre, how far all of ``x`` stay on the own side of the plane between it and the own centre; 0 for the own one."""
    if c is None:
        return np.zeros(1)
    apart = np.linalg.norm(c[cell] - c, axis=1)
    near = x @ c.T
    return np.where(apart > 0, (near[:, [cell]] - near).min(axis=0) / np.maximum(apart, 1e-300), 0.0)


def _packed(placed: DataFrame, centres, block: int) -> DataFrame:
    """(dim, cell, block, gap, node, copies, v): one row per block, the last three as the bytes of its vectors' values."""
    sizes = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    units = placed.join(sizes, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("node", "v"), F.col("blocks")).cast("int"))

    def pack(keys: tuple, part: pa.Table) -> pa.Table:
        dim, cell, number = (k.as_py() for k in keys)
        v = b"".join(part["v"].to_pylist())
        gap = _gaps(np.frombuffer(v, float).reshape(-1, dim), cell, centres.value.get(dim))
        return pa.table({"dim": pa.array([dim], pa.int32()), "cell": pa.array([cell], pa.int32()), "block": pa.array([number], pa.int32()),
                         "gap": pa.array([gap.tolist()], pa.list_(pa.float64())),
                         **{c: pa.array([part[c].to_numpy().tobytes()], pa.binary()) for c in ("node", "copies")}, "v": pa.array([v], pa.binary())})

    return units.select("dim", "cell", "block", "node", "copies", "v").groupBy("dim", "cell", "block").applyInArrow(
        pack, "dim int, cell int, block int, gap array<double>, node binary, copies binary, v binary")


def _meetings(blocks: DataFrame, least: float, margin: float | None) -> DataFrame:
    """Every two blocks of one vector length that may hold a link, each pair once, a block also with itself."""
    one, two = (blocks.select([F.col(c).alias(f"{c}_{side}") for c in blocks.columns]) for side in "ab")
    c = F.col
    gap_a, gap_b = F.get("gap_a", c("cell_b")), F.get("gap_b", c("cell_a"))
    # lengths are compared by two bounds: as an equality they would be a join key, and one length one task
    may = ((c("dim_a") <= c("dim_b")) & (c("dim_a") >= c("dim_b"))
           & ((c("cell_a") < c("cell_b")) | ((c("cell_a") == c("cell_b")) & (c("block_a") <= c("block_b"))))
           & (gap_a + gap_b <= max(0.0, 2 - 2 * least) ** 0.5 + 1e-9))
    if margin is not None:
        may = may & (F.least(gap_a, gap_b) <= margin)
    return one.join(two, may).select(c("dim_a").alias("dim"), ((c("cell_a") == c("cell_b")) & (c("block_a") == c("block_b"))).alias("same"),
                                     *[f"{x}_{side}" for x in ("node", "copies", "v") for side in "ab"])


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewer edges with the same components: each vertex to the smallest one it reaches inside the block pair."""
    low = np.arange(n)
    while True:
        before = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        low = low[low]
        if (low == before).all():
            break
    x = np.flatnonzero(low != np.arange(n))
    return x, low[x]


def _named(vectors: DataFrame, id: str, column: str, judge) -> DataFrame:
    """What ``judge`` gives for vectors known by a hash of their id, with the ids themselves; the component is the smallest id."""
    keyed = vectors.select(id_key(vectors, id).alias("id"), F.col(f"`{id}`").alias("own"), F.col(f"`{column}`").alias("vector"))
    found = materialize(judge(keyed.select("id", "vector")), "judged")
    names = materialize(keyed.select("id", "own").where("id is not null").distinct(), "names")
    smallest = found.join(names, "id").groupBy("component_id").agg(F.min("own").alias("smallest"))
    joined = found.join(names, "id", "left").join(smallest, "component_id", "left")
    return joined.select(F.col("own").alias(id), "n_links", F.col("smallest").alias("component_id"),
                         F.coalesce(F.col("own") == F.col("smallest"), F.lit(True)).alias("kept"))


def near_vectors(vectors: DataFrame, id: str = "vec_id", column: str = "embedding", least: float = LEAST, cells: int = CELLS,
                 sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS, block: int = BLOCK,
                 margin: float | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``.

    With a ``margin``, blocks that both lie farther than it from the plane between their cells are left out, and links may be missed.
    """
    if not has_long_id(vectors, id):
        return _named(vectors, id, column, lambda keyed: near_vectors(keyed, "id", "vector", least, cells, sample_rows, rounds, block, margin))
    spark = vectors.sparkSession
    rows = materialize(_scaled(vectors, id, column), "scaled")
    usable = rows.where("v is not null and id is not null").select("id", "dim", "v").distinct()
    distinct = materialize(usable.groupBy("dim", "v").agg(F.min("id").alias("node"), F.count("*").alias("copies")), "distinct")
    centres = spark.sparkContext.broadcast(_centres(distinct, cells, rounds, sample_rows))
    placed = materialize(_placed(distinct, centres), "placed")
    blocks = materialize(_packed(placed, centres, block), "blocks")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, same, *raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *batch.columns[2:]):
                node_a, node_b, copies_a, copies_b = (np.frombuffer(r.as_buffer(), np.int64) for r in raw[:4])
                x, y = (np.frombuffer(r.as_buffer(), float).reshape(-1, dim) for r in raw[4:])
                links_a, links_b = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
                a, b = [], []
                for at in range(0, len(x), 512):
                    u, v = np.nonzero(x[at:at + 512] @ y.T >= least)
                    u = u + at
                    keep = (node_a[u] < node_b[v]) if same else (node_a[u] != node_b[v])
                    u, v = u[keep], v[keep]
                    np.add.at(links_a, u, copies_b[v])
                    np.add.at(links_b, v, copies_a[u])
                    a.append(u)
                    b.append(v)
                if same:
                    node, links, shift = node_a, links_a + links_b, 0
                else:
                    node, links, shift = np.concatenate((node_a, node_b)), np.concatenate((links_a, links_b)), len(x)
                some = np.flatnonzero(links)
                if len(some):
                    p, q = _forest(np.concatenate(a), np.concatenate(b) + shift, len(node))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate((node[p], node[some]))), pa.array(np.concatenate((node[q], node[some]))),
                         pa.array(np.concatenate((np.zeros(len(p), np.int64), links[some])))], names=["a", "b", "n"])

    met = materialize(_meetings(blocks, least, margin).mapInArrow(compare, "a long, b long, n long"), "met")
    counts = met.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    groups = components(met.where("n = 0").select("a", "b"))
    classes = (distinct.join(counts, "node", "left").join(groups, "node", "left")
               .select("dim", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")))
    classes = materialize(classes, "classes")
    joined = rows.join(classes, ["dim", "v"], "left")
    known = F.col("id").isNotNull()
    return joined.select(F.col("id").alias(id), F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
                         F.when(known, F.coalesce("component_id", "id")).alias("component_id")).withColumn(
                             "kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True)))
