"""Helpers shared by the operators: byte blocks of Arrow text, word hashes, fixed-size filters."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

BLOCK_BYTES = 1 << 18
_U = np.uint64
_STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_STEP, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(0, _U), np.ones(0, _U))


def released(run: Callable) -> Callable:
    """``run`` over batches, giving its memory back to the system when the task ends.

    Python workers are kept for later tasks, also of other stages; what an idle one holds on to is missing there.
    """
    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _powers
        try:
            yield from run(batches)
        finally:
            _powers = (np.ones(0, _U), np.ones(0, _U))
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)
    return wrapped


def split_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole texts of a string array in blocks of about ``block_bytes`` UTF-8 bytes: (first row, end row, bytes, offsets).

    A null is an empty text. A text longer than a block is a block of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + block_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over 64 bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        tables = []
        for base in (_STEP, _INVERSE):
            p = np.full(size, base, _U)
            p[0] = 1
            tables.append(np.cumprod(p, dtype=_U))
        _powers = tuple(tables)
    return _powers


def byte_values(seed: int, fold_case: bool) -> np.ndarray:
    """A pseudo-random 64-bit value per byte; with ``fold_case`` A-Z share the values of a-z."""
    values = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95) + _U(seed))
    if fold_case:
        values[65:91] = values[97:123]
    return values


def prefix_hash(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Running sums from which :func:`span_hash` takes the hash of any span."""
    up, _ = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(values[data] * up[:len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _power_tables(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of word bytes that never cross a text: starts, ends, and for each text the index of its first word."""
    inside = is_word[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1] | cut[1:-1]
        last[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash per word, A-Z taken as a-z. Words of up to 16 bytes are mixed as two numbers, longer ones hashed one by one.

    No sum over bytes: words that differ in many places at once do not cancel out.
    """
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    size = ends - starts
    lower = np.zeros(len(data) + 16, np.uint8)
    lower[:len(data)] = table[data]
    eights = np.ndarray(len(data) + 9, _U, lower, strides=(1,))  # the 8 bytes from every place on
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)
    low = eights[starts] & masks[np.minimum(size, 8)]
    high = eights[np.minimum(starts + 8, len(data))] & masks[np.clip(size - 8, 0, 8)]
    hashes = mix(mix(low + _U(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) ^ high) + size.astype(_U) * _U(0xD1342543DE82EF95)
    for i in np.flatnonzero(size > 16).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(lower[starts[i]:ends[i]], seed)
    return mix(hashes)


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def has_long_id(docs: DataFrame, id: str) -> bool:
    return isinstance(docs.schema[id].dataType, _WHOLE)


def id_key(docs: DataFrame, id: str) -> Column:
    """The id as a long: itself if it is a whole number, a 64-bit hash of it otherwise, null for null."""
    own = F.col(f"`{id}`")
    return own.cast("long") if has_long_id(docs, id) else F.when(own.isNotNull(), F.xxhash64(own))


def bit_filter(keys: DataFrame, column: str, log2_bits: int = 24) -> "np.ndarray":
    """A bitmap of 2**log2_bits bits with a bit set for the top bits of every 64-bit key of ``column``.

    Its size is fixed, whatever the number of keys: at most 2**(log2_bits - 6) words come to the driver. A full bitmap
    only lets more rows pass; whatever passes is joined exactly afterwards.
    """
    place = F.shiftrightunsigned(F.col(column), 64 - log2_bits)
    words = keys.select(place.alias("place")).select(
        F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
    table = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (log2_bits - 6), _U)
    bitmap[table["word"].to_numpy()] = table["bits"].to_numpy().view(_U)
    return bitmap


def passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the unsigned 64-bit ``keys`` may be in the bitmap."""
    place = keys >> _U(64 - (int(len(bitmap)).bit_length() + 5))
    return (bitmap[place >> _U(6)] >> (place & _U(63))) & _U(1) == 1
