"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k without replacement.

A text's lattice has an edge for every vocabulary piece that stands in it; a character without a piece of its own is an edge
of its UTF-8 bytes. Pieces never hold a space after another character, so the lattice falls into units (spaces and what
follows them) and sums over it are exact: the sum of a text is the product over its units.

The model file ranks pieces by merge order, without probabilities: piece number r weighs 1 / (r + ``SHIFT``), the usual
rank-frequency law; a byte weighs as much as the last piece. The weight of a segmentation is the product of its pieces'.

Search: a region is a set of segmentations (a fixed prefix of units, one unit with excluded choices, a free rest). Its best
perturbed log-probability is a Gumbel variable around the region's exact log-mass, cut off at its parent's. The queue pops the
highest region, a segmentation is drawn from it, and what is left of it is split at the first unit that differs. So
segmentations come out distinct, in order of their perturbed log-probability; the value of the next region in the queue is
the threshold from which the inclusion probability of each follows.

Random numbers are hashes of (seed, row key, sample, unit, step): a row's samples do not depend on partitions or retries.

Defined results: a null or empty text has no segmentation and yields no row from ``sample`` (one row without pieces from the
query, the pipeline and with ``keep_empty``); a text with a single segmentation yields one with inclusion 1; texts that hold U+2581 decode to a space there;
repeated rows and rows with null keys are encoded each, a null key counts as 0, a key that is no whole number by its hash; texts of any
length are encoded whole; samples come by falling perturbed log-probability, equal ones in the order the queue gives; an empty table gives an
empty one; extra columns stay, but for those named like the results, which are replaced.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from shelflens.llm.common import id_key, mix, released

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SHIFT = 2.7
SAMPLES = 2
BLOCK_CHARS = 1 << 19
_U = np.uint64
_SPACE = "▁"
_UNIT = re.compile("▁+[^▁]*")


class Pieces:
    """The model's pieces as lookup tables."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = len(library)
        names = [library.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))]
        self.frequent: tuple[dict[str, int], Lattice] | None = None
        self.byte0 = library.piece_to_id("<0x00>")
        weight = np.log(1 / (np.arange(len(plain) + 1) + SHIFT))
        weight -= np.log(np.exp(weight).sum() + 255 * math.exp(weight[-1]))
        self.byte_weight = float(weight[-1])
        self.width = max(len(names[i]) for i in plain)
        self.values = mix(np.arange(1, 0x110001, dtype=_U) * _U(0xD1342543DE82EF95))
        points, length = self._points([names[i] for i in plain])
        keys, h, starts = np.zeros(len(plain), _U), np.zeros(len(plain), _U), []
        for k in range(self.width):
            h = (h + self.values[points[:, k]]) * _U(0x9E3779B97F4A7C15)
            at = mix(h)
            keys[length == k + 1] = at[length == k + 1]
            starts.append(at[length > k + 1])  # what a longer piece starts with
        order = np.argsort(keys)
        self.keys, self.ids, self.weights = keys[order], np.array(plain, np.int32)[order], weight[:-1][order].astype(np.float64)
        slot = (self.keys >> _U(43)).astype(np.int64)
        self.slots, self.longer = np.full(1 << 21, -1, np.int32), np.zeros(1 << 21, bool)
        self.slots[slot] = np.arange(len(slot))
        self.slots[slot[np.flatnonzero(slot[1:] == slot[:-1])]] = -2  # more than one piece: searched for
        self.longer[np.concatenate(starts) >> _U(43)] = True
        texts = [b""] * size
        for i in plain:
            texts[i] = names[i].replace(_SPACE, " ").encode()
        for b in range(256):
            texts[self.byte0 + b] = bytes([b])
        self.text_length = np.array([len(t) for t in texts], np.int64)
        self.text_start = np.concatenate(([0], np.cumsum(self.text_length)))
        self.text_bytes = np.frombuffer(b"".join(texts), np.uint8)

    def _points(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters of the names, a row each and filled up with zeros, and how many each has."""
        length = np.array([len(x) for x in names])
        out = np.zeros((len(names), self.width), np.int64)
        out[np.arange(self.width) < length[:, None]] = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32)
        return out, length

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        """UTF-8 bytes of the pieces, one after another, and nothing taken off."""
        length = self.text_length[ids]
        ends = np.cumsum(length)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length)
        return self.text_bytes[np.repeat(self.text_start[ids], length) + at]


def _text(spelled: bytes) -> str:
    """The text of decoded pieces: the space before the first word is taken off, bytes that are no UTF-8 become U+FFFD."""
    return spelled.decode("utf8", "replace").removeprefix(" ")


class Lattice:
    """Edges and exact sums of a set of distinct units, each with the space before it; positions count characters of all units,
    one after another, and one end per unit. ``earlier`` is a lattice whose units come first."""

    def __init__(self, pieces: Pieces, units: list[str], earlier: "Lattice | None" = None) -> None:
        self.pieces = pieces
        length = np.fromiter(map(len, units), np.int64, len(units)) + 2
        points = np.frombuffer((_SPACE + ("\0" + _SPACE).join(units) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if not len(units):
            points = points[:0]
        n = len(points)
        stop = np.cumsum(length) - 1
        left = np.repeat(stop, length) - np.arange(n)
        count = np.zeros(n, np.int64)
        levels = []
        values = pieces.values[points]
        live = np.flatnonzero(left)
        h = np.zeros(len(live), _U)
        for k in range(pieces.width):
            if k:
                inside = left[live] > k
                live, h = live[inside], h[inside]
            h = (h + values[live + k]) * _U(0x9E3779B97F4A7C15)
            key = mix(h)
            slot = (key >> _U(43)).astype(np.int64)
            place, on = pieces.slots[slot], pieces.longer[slot]
            some = place != -1
            where, key, place = live[some], key[some], place[some]
            twice = np.flatnonzero(place == -2)
            place[twice] = np.minimum(np.searchsorted(pieces.keys, key[twice]), len(pieces.keys) - 1)
            same = pieces.keys[place] == key
            where, place = where[same], place[same]
            count[where] += 1
            levels.append((where, k + 1, pieces.ids[place], pieces.weights[place]))
            if not k:
                bare = left > 0
                bare[where] = False
                bare = np.flatnonzero(bare)  # characters without a piece
                size = 1 + (points[bare] > 0x7F) + (points[bare] > 0x7FF) + (points[bare] > 0xFFFF)
                count[bare] += 1
                levels.append((bare, 1, (-points[bare] - 1).astype(np.int32), size * pieces.byte_weight))
            live, h = live[on], h[on]
        first = np.concatenate(([0], np.cumsum(count)))
        edges = int(first[-1])
        ids, steps, weight = np.zeros(edges, np.int32), np.zeros(edges, np.int32), np.zeros(edges)
        free = first[:-1].copy()
        for where, k, found, w in levels:
            at = free[where]
            ids[at], steps[at], weight[at] = found, k, w
            free[where] += 1
        # sums from each position to its unit's end, by distance from the end
        total, ways, share = np.zeros(n), np.ones(n), np.zeros(edges, np.float32)
        by_left = np.argsort(left.astype(np.uint16) if n and left.max() < 65536 else left, kind="stable")
        bounds = np.searchsorted(left[by_left], np.arange(1, (int(left.max()) if n else 0) + 2))
        for d in range(1, len(bounds)):
            at = by_left[bounds[d - 1]:bounds[d]]
            c = count[at]
            ends = np.cumsum(c)
            e = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[at] - (ends - c), c)
            to = np.repeat(at, c) + steps[e]
            w = weight[e] + total[to]
            starts = ends - c
            top = np.maximum.reduceat(w, starts)
            p = np.exp(w - np.repeat(top, c))
            s = np.add.reduceat(p, starts)
            total[at] = top + np.log(s)
            ways[at] = np.minimum(np.add.reduceat(ways[to], starts), 1e300)
            run = np.cumsum(p)
            share[e] = (run - np.repeat(run[starts] - p[starts], c)) / np.repeat(s, c)
            share[e[ends - 1]] = 2.0
        start = stop - length + 1
        if earlier is not None:
            moved, behind = len(earlier.total), len(earlier.ids)
            start = np.concatenate((earlier.start, start + moved))
            first = np.concatenate((earlier.first[:-1], first + behind))
            left, total, ways = (np.concatenate((a, b)) for a, b in ((earlier.left, left), (earlier.total, total), (earlier.ways, ways)))
            ids, steps, weight, share = (np.concatenate((a, b)) for a, b in (
                (earlier.ids, ids), (earlier.steps, steps), (earlier.weight, weight), (earlier.share, share)))
        self.start, self.first, self.left, self.total, self.ways = start, first, left, total, ways
        self.ids, self.steps, self.weight, self.share = ids, steps, weight, share

    def draw(self, unit: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A segmentation for every occurrence of a unit: pieces one after another, pieces per occurrence, log-weights."""
        n = len(unit)
        at, weight, live, step = self.start[unit], np.zeros(n), np.arange(n), 0
        rows, found = [], []
        while len(live):
            u = (mix(key + _U((step + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1)) >> _U(40)).astype(np.float32) * np.float32(2 ** -24)
            e = self.first[at]
            later = np.flatnonzero(self.share[e] <= u)
            while len(later):
                e[later] += 1
                later = later[self.share[e[later]] <= u[later]]
            rows.append(live)
            found.append(self.ids[e])
            weight[live] += self.weight[e]
            at = at + self.steps[e]
            on = self.left[at] > 0
            live, at, key = live[on], at[on], key[on]
            step += 1
        count = np.zeros(n, np.int64)
        for r in rows:
            count[r] += 1
        free = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int32)
        for r, f in zip(rows, found):
            out[free[r]] = f
            free[r] += 1
        return out, count, weight

    def draw_other(self, unit: int, excluded: list[tuple[int, ...]], key: int) -> tuple[np.ndarray, float]:
        """A segmentation of one unit (its edges) that is none of ``excluded``, by exact remaining mass."""
        at, live, made, weight = int(self.start[unit]), excluded, [], 0.0
        while self.left[at] > 0:
            step, a, b = len(made), int(self.first[at]), int(self.first[at + 1])
            to = at + self.steps[a:b]
            here, own = float(self.total[at]), self.weight[a:b].tolist()
            p = [math.exp(w + t - here) for w, t in zip(own, self.total[to].tolist())]
            inside = [0] * (b - a)
            for path in live:
                p[path[step] - a] -= math.exp(sum(self.weight[list(path[step:])].tolist()) - here)
                inside[path[step] - a] += 1
            p = [0.0 if m and m >= w else max(x, 1e-300) for x, m, w in zip(p, inside, self.ways[to].tolist())]
            u = _unit_float(key, step) * sum(p)
            k = next((i for i, c in enumerate(itertools.accumulate(p)) if c > u), max(i for i, x in enumerate(p) if x > 0))
            made.append(a + k)
            weight += own[k]
            live = [path for path in live if path[step] == a + k]
            at = int(to[k])
        return np.array(made), weight

    def path(self, unit: int, ids: np.ndarray) -> tuple[int, ...]:
        """The edges that the pieces ``ids`` of a unit are."""
        at, out = int(self.start[unit]), []
        for i in ids.tolist():
            a = int(self.first[at])
            out.append(a + self.ids[a:self.first[at + 1]].tolist().index(i))
            at += int(self.steps[out[-1]])
        return tuple(out)


def _unit_float(key: int, step: int) -> float:
    """A number in [0, 1) from a key and a step."""
    x = np.array([(key + (step + 1) * 0xD1342543DE82EF95) & (1 << 64) - 1], _U)
    return float(mix(x)[0] >> _U(11)) * 2.0 ** -53


def _spelled(pieces: Pieces, ids: np.ndarray) -> np.ndarray:
    """Characters without a piece (negative codes) spelled out in byte pieces."""
    bare = np.flatnonzero(ids < 0)
    if not len(bare):
        return ids
    if ids.min() >= -128:  # one byte each
        out = ids.copy()
        out[bare] = pieces.byte0 - ids[bare] - 1
        return out
    spelled = {int(c): list(chr(-int(c) - 1).encode("utf8", "surrogatepass")) for c in np.unique(ids[bare])}
    count = np.ones(len(ids), np.int64)
    count[bare] = [len(spelled[int(c)]) for c in ids[bare]]
    out = np.repeat(ids, count)
    first = (np.cumsum(count) - count)[bare]
    for code, raw in spelled.items():
        for j, b in enumerate(raw):
            out[first[ids[bare] == code] + j] = pieces.byte0 + b
    return out


def _gumbel(key: np.ndarray) -> np.ndarray:
    u = ((mix(key) >> _U(11)).astype(np.float64) + 0.5) * 2.0 ** -53
    return -np.log(-np.log(u))


class _Doc:
    """One text's queue of regions."""

    def __init__(self, lattice: Lattice, units: np.ndarray, key: int, ids: np.ndarray, first: np.ndarray, weight: np.ndarray) -> None:
        self.lattice, self.units, self.key = lattice, units, key
        self.mass = lattice.total[lattice.start[units]]
        self.after = np.concatenate((np.cumsum(self.mass[::-1])[::-1][1:], [0.0]))
        self.norm = float(self.mass.sum())
        self.regions: list[tuple] = []  # (values per first differing unit, sample they come from, exclusions of the first unit)
        self.samples: list[dict] = []
        self.add(ids, first, weight, self.norm + float(_gumbel(np.array([key], _U))[0]), 0, [])

    def add(self, ids, first, weight, value, start, excluded) -> None:
        """Emits a segmentation and puts what is left of its region into the queue, split at the first differing unit."""
        lattice, units = self.lattice, self.units
        number = len(self.samples)
        before = np.concatenate(([0.0], np.cumsum(weight)[:-1]))
        rest = np.where(lattice.ways[lattice.start[units]] > 1, self.mass + np.log(np.maximum(-np.expm1(np.minimum(weight - self.mass, -1e-300)), 1e-300)),
                        -np.inf)
        if excluded:
            at = int(units[start])
            share = math.exp(weight[start] - self.mass[start]) + sum(math.exp(float(lattice.weight[list(p)].sum()) - self.mass[start]) for p in excluded)
            full = len(excluded) + 1 >= lattice.ways[lattice.start[at]]
            rest[start] = -np.inf if full else self.mass[start] + math.log(max(1e-300, 1 - share))
        mass = (before + rest + self.after)[start:]
        with np.errstate(over="ignore", divide="ignore"):
            free = mass + _gumbel(np.arange(start, len(units), dtype=_U) * _U(0x9E3779B97F4A7C15)
                                  + _U(self.key + (number + 1) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1))
            values = -np.logaddexp(-value, -free)
        values[np.isinf(mass)] = -np.inf
        self.regions.append((values, number, start, excluded))
        self.samples.append({"ids": ids, "first": first, "weight": weight, "value": value})

    def best(self) -> tuple[float, int, int]:
        """The highest region: its value, its place in the list, its first differing unit."""
        tops = [float(v.max()) if len(v) else -math.inf for v, *_ in self.regions]
        which = int(np.argmax(tops))
        return tops[which], which, int(np.argmax(self.regions[which][0]))

    def pop(self, free: np.ndarray, count: np.ndarray, weights: np.ndarray, value: float, which: int, place: int) -> None:
        """Draws from the highest region; ``free`` is a fresh segmentation of the units after the one that differs."""
        values, number, start, gone = self.regions[which]
        values[place] = -np.inf
        at = start + place
        parent = self.samples[number]
        unit = int(self.units[at])
        own = self.lattice.path(unit, parent["ids"][parent["first"][at]:parent["first"][at + 1]])
        excluded = [*gone, own] if place == 0 else [own]
        path, weight = self.lattice.draw_other(unit, excluded, self.key ^ (len(self.samples) * 0x94D049BB133111EB & (1 << 64) - 1))
        ids = np.concatenate((parent["ids"][:parent["first"][at]], self.lattice.ids[path], free))
        counts = np.concatenate((np.diff(parent["first"][:at + 1]), [len(path)], count))
        self.add(ids, np.concatenate(([0], np.cumsum(counts))), np.concatenate((parent["weight"][:at], [weight], weights)), value, at, excluded)


def _units(text: str) -> list[str]:
    """A text's units without the space that each begins with."""
    if "  " in text or _SPACE in text or text[:1] == " " or text[-1:] == " ":
        return [u[1:] for u in _UNIT.findall(_SPACE + text.replace(" ", _SPACE))]
    return text.split(" ")


def _lattice(pieces: Pieces, codes: np.ndarray, distinct: np.ndarray) -> tuple[np.ndarray, Lattice]:
    """The lattice of a block's units. Units that were frequent in a task's first block are kept for its later ones."""
    kept = pieces.frequent
    if kept is None:
        common = np.flatnonzero(np.bincount(codes, minlength=len(distinct)) > 2)
        words = distinct[common].tolist()
        kept = pieces.frequent = ({w: i for i, w in enumerate(words)}, Lattice(pieces, words))
    known, earlier = kept
    number = np.array([known.get(w, -1) for w in distinct.tolist()], np.int64)
    new = np.flatnonzero(number < 0)
    number[new] = len(known) + np.arange(len(new))
    return number[codes], Lattice(pieces, distinct[new].tolist(), earlier)


def segmentations(pieces: Pieces, texts: list[str], keys: np.ndarray, samples: int, seed: int) -> Iterator[list[dict]]:
    """For each non-empty text the samples: ids, log_prob, perturbed, inclusion."""
    lists = [_units(t) for t in texts]
    sizes = np.array([len(x) for x in lists])
    codes, distinct = pd.factorize(np.array([u for x in lists for u in x], object))
    codes, lattice = _lattice(pieces, codes, distinct)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    place = np.arange(len(codes)) - np.repeat(bounds[:-1], sizes)
    row_key = mix(keys.view(_U) * _U(0x9E3779B97F4A7C15) + _U(seed + 1))
    base = np.repeat(row_key, sizes) + place.astype(_U) * _U(0xD6E8FEB86659FD93)
    ids, count, weight = lattice.draw(codes, mix(base))
    ends = np.concatenate(([0], np.cumsum(count)))
    docs = [_Doc(lattice, codes[lo:hi], int(k), ids[ends[lo]:ends[hi]], ends[lo:hi + 1] - ends[lo], weight[lo:hi])
            for lo, hi, k in zip(bounds[:-1], bounds[1:], row_key)]
    tops = [doc.best() for doc in docs]
    for number in range(1, samples):
        # only what follows the unit that differs is drawn anew
        after = np.array([hi if top[0] == -math.inf else lo + doc.regions[top[1]][2] + top[2] + 1
                          for lo, hi, doc, top in zip(bounds[:-1], bounds[1:], docs, tops)])
        size = bounds[1:] - after
        begin = np.cumsum(size) - size
        units = np.arange(int(size.sum())) + np.repeat(after - begin, size)
        ids, count, weight = lattice.draw(codes[units], mix(base[units] + _U(number * 0xA0761D6478BD642F & (1 << 64) - 1)))
        ends = np.concatenate(([0], np.cumsum(count)))
        for d, doc in enumerate(docs):
            if tops[d][0] > -math.inf:
                lo, hi = begin[d], begin[d] + size[d]
                doc.pop(ids[ends[lo]:ends[hi]], count[lo:hi], weight[lo:hi], *tops[d])
                tops[d] = doc.best()
    for doc, (threshold, *_) in zip(docs, tops):
        out = []
        for s in doc.samples:
            log_prob = float(s["weight"].sum()) - doc.norm
            inclusion = 1.0 if threshold == -math.inf else -math.expm1(-math.exp(min(700.0, log_prob - (threshold - doc.norm))))
            out.append({"ids": _spelled(pieces, s["ids"]), "log_prob": log_prob, "perturbed": s["value"] - doc.norm, "inclusion": inclusion})
        yield out


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES, model: str = MODEL, seed: int = 0,
           decoded: str | None = None, keep_empty: bool = False) -> DataFrame:
    """One row per text and sample: the columns of ``docs`` but the text, then sample, pieces, log_prob, perturbed, inclusion,
    round_trip (whether the pieces decode to the text) and, if ``decoded`` names it, a column with what ``decode`` makes of the pieces.
    With ``keep_empty`` a null or empty text yields a row with nulls.

    The model file, whose size is fixed by its vocabulary, is read on the driver and sent once to each executor.
    """
    with open(model, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    added = [T.StructField("sample", T.IntegerType()), T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("log_prob", T.DoubleType()),
             T.StructField("perturbed", T.DoubleType()), T.StructField("inclusion", T.DoubleType()), T.StructField("round_trip", T.BooleanType())]
    if decoded is not None:
        added.append(T.StructField(decoded, T.StringType()))
    names = {f.name for f in added} | {text}
    kept = [f for f in docs.schema.fields if f.name not in names]
    kinds = [pa.int32(), pa.list_(pa.int32()), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value)

        def made(batch: pa.RecordBatch, row: list[int], columns: list[pa.Array]) -> pa.RecordBatch:
            own = [batch.column(2 + j).take(pa.array(row)) for j in range(len(kept))]
            return pa.RecordBatch.from_arrays([*own, *columns], names=[f.name for f in kept + added])

        for batch in batches:
            keys = batch.column(0).to_numpy()
            sizes = batch.column(1).cast(pa.binary()).fill_null(b"")
            sizes = np.diff(np.frombuffer(sizes.buffers()[1], np.int32)[sizes.offset:sizes.offset + len(sizes) + 1])
            rows = np.flatnonzero(sizes)
            ends = np.cumsum(sizes[rows], dtype=np.int64)
            lo = 0
            if keep_empty and len(rows) < len(sizes):
                empty = np.flatnonzero(sizes == 0).tolist()
                yield made(batch, empty, [pa.nulls(len(empty), kind) for _, kind in zip(added, kinds)])
            while lo < len(rows):
                # a block of texts becomes Python strings at a time; a longer text is a block of its own
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK_CHARS, "right")))
                part = rows[lo:hi].tolist()
                texts = dict(zip(part, batch.column(1).take(pa.array(part)).to_pylist()))
                lo = hi
                row, flat, numbers = [], [], []
                for i, found in zip(part, segmentations(pieces, [texts[i] for i in part], keys[part], samples, seed)):
                    row += [i] * len(found)
                    flat += [s["ids"] for s in found]
                    numbers += [(j, s["log_prob"], s["perturbed"], s["inclusion"]) for j, s in enumerate(found)]
                stops = np.concatenate(([0], np.cumsum([len(x) for x in flat]))).astype(np.int32)
                ids = np.concatenate(flat)
                spelled = pieces.decoded(ids).tobytes()
                bounds = np.concatenate(([0], np.cumsum(pieces.text_length[ids])[stops[1:] - 1])).tolist()
                wanted = {i: (" " + x).encode("utf8", "surrogatepass") for i, x in texts.items()}
                ok = [spelled[a:b] == wanted[i] for i, a, b in zip(row, bounds, bounds[1:])]
                number, log_prob, perturbed, inclusion = zip(*numbers)
                columns = [pa.array(number, pa.int32()), pa.ListArray.from_arrays(pa.array(stops), pa.array(ids)), pa.array(log_prob),
                           pa.array(perturbed), pa.array(inclusion), pa.array(ok)]
                if decoded is not None:
                    columns.append(pa.array([texts[i] if same else _text(spelled[a:b]) for i, same, a, b in zip(row, ok, bounds, bounds[1:])], pa.string()))
                yield made(batch, row, columns)

    keyed = docs.select(F.coalesce(id_key(docs, key), F.lit(0)).alias("__key"), F.col(text).cast("string").alias("__text"),
                        *[F.col(f"`{f.name}`") for f in kept])
    return keyed.mapInArrow(released(run), T.StructType([*kept, *added]))


def decode(rows: DataFrame, pieces: str = "pieces", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """``rows`` with the text of their pieces; the space before the first word is taken off, bytes that are no UTF-8 become U+FFFD."""
    with open(model, "rb") as f:
        shared = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Pieces(shared.value)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(pieces))
            out = [_text(known.decoded(x.values.to_numpy()).tobytes()) if x.is_valid else None for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, text])

    return rows.mapInArrow(released(run), T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())]))
