"""Cross-tokenizer alignment by diagonal run skipping, and corpus-wide counts of linked token pairs.

Two tokenizers, a byte-level BPE (A) and a SentencePiece model with byte fallback (B), cut the same bytes: a space and the text.
Every token is known by the byte where it ends.

1. Alignment: while both end arrays agree at the current index shift, probes of doubling length jump over the one-to-one stretch
   and halving probes find where it stops. From there the tokens of one irregular group are paired one by one, always stepping
   on the side whose token ends first, until both sides end at the same byte; the shift is updated and probing starts anew.
   A block of texts is aligned as one sequence, as no group can cross the end of a text.
2. Links: in a one-to-one stretch the tokens opposite each other, in an irregular group the pairs of the local walk.
3. Texts are put in units of about ``UNIT_LINKS`` links. A unit keeps its distinct id pairs once; its texts hold positions in that
   list. So counts travel as one row per unit and pair, added up in each task before the shuffle, and come back the same way.

Defined results: null and empty texts, texts that are no UTF-8, and texts whose tokens do not spell the space and the text again
(U+2581, for instance, which B cannot tell from a space) have no tokens: zeros and an empty digest. A text of any length is encoded whole
and is a unit of its own if need be. Repeated rows and rows with null ids are aligned each and all count. Ties: every pair that has its
B id's highest count is a best one. An empty table gives an empty table. Other columns are ignored, whatever their names; ids keep
their type. Strings of special tokens are plain text.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from shelflens.session import materialize

BLOCK_BYTES = 1 << 18
UNIT_LINKS = 1 << 20
_B_BITS = 32  # an id pair is one long: A's id above B's
#: Fixed value: how byte-level vocabularies split text before the merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LATIN_END = "\u0250"  # below it, all versions of Unicode agree on what a letter, digit or space is


@dataclass(frozen=True)
class Tokenizers:
    """Both tokenizers with the bytes of every id; ``words`` are the ids as the digest spells them.

    ``latin`` is A over the same merges in a library that is four times as fast, None if A is not of the plain byte-level kind.
    Both give the same ids as long as they agree on classes of characters, so it encodes texts without characters from ``LATIN_END`` on.
    """

    a: object
    latin: object
    b: object
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    a_sizes: np.ndarray
    b_sizes: np.ndarray
    words: list[str]


def _byte_alphabet() -> dict[str, int]:
    """Characters of byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _latin(model: dict, a_bytes: list[bytes]):
    """The same byte-level merges in the faster library, if ids follow the merges' order and nothing else happens to a text."""
    import tiktoken
    kind, split, vocabulary = model["model"], model["pre_tokenizer"], model["model"]["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in kind["merges"]]
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if (model["normalizer"] or kind["type"] != "BPE" or {k: split.get(k) for k in plain} != plain or kind["ignore_merges"] or kind["byte_fallback"]
            or any(vocabulary[x + y] != 256 + i for i, (x, y) in enumerate(merges))):
        return None
    return tiktoken.Encoding("merges", pat_str=SPLIT, mergeable_ranks={a_bytes[i]: i for i in range(256 + len(merges))}, special_tokens={})


@functools.lru_cache(maxsize=1)
def _load(byte_model: bytes, piece_model: bytes) -> Tokenizers:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    import sentencepiece
    import tokenizers
    a = tokenizers.Tokenizer.from_buffer(byte_model)
    a.encode_special_tokens = True
    alphabet = _byte_alphabet()
    a_bytes = [b""] * (max(a.get_vocab(with_added_tokens=True).values()) + 1)
    for token, i in a.get_vocab(with_added_tokens=True).items():
        a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
    b_bytes = []
    for i in range(len(b)):
        piece = b.id_to_piece(i)
        b_bytes.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
    words = [f"{i}{end}" for ids, ends in ((a_bytes, ",|"), (b_bytes, ",;")) for end in ends for i in range(len(ids))]
    sizes = [np.array([len(x) for x in ids], np.int64) for ids in (a_bytes, b_bytes)]
    return Tokenizers(a, _latin(json.loads(byte_model), a_bytes), b, a_bytes, b_bytes, *sizes, words)


def _encoded(known: Tokenizers, texts: list[str]) -> list[list[int]]:
    """A's ids of every text."""
    found: list = [known.latin.encode_ordinary(t) if known.latin and (t.isascii() or max(t) < LATIN_END) else None for t in texts]
    rest = [i for i, ids in enumerate(found) if ids is None]
    for i, e in zip(rest, known.a.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
        found[i] = e.ids
    return found


def align(a: list[int], b: list[int]) -> tuple[list[tuple[int, int, int]], list[int], list[int]]:
    """One-to-one runs and the links between them, for two strictly increasing lists of ends with the same last end.

    Runs are (first A token, first B token, length); between two neighbours lies exactly one irregular group, so a run may be
    empty. The other two lists are the A and B tokens of the links inside irregular groups, in order.
    """
    n = len(a)
    runs, odd_a, odd_b = [], [], []
    i = j = 0
    while True:
        first, shift, single = i, j - i, min(i + 3, n)
        while i < single and a[i] == b[j]:  # the first probes are of single tokens
            i += 1
            j += 1
        if i == single:
            step = 4
            while i < n and a[i:i + step] == b[j:j + step]:
                i = min(i + step, n)
                j = i + shift
                step *= 2
            while step > 1 and i < n:
                step //= 2
                if a[i:i + step] == b[j:j + step]:
                    i = min(i + step, n)
                    j = i + shift
        runs.append((first, first + shift, i - first))
        if i >= n:
            return runs, odd_a, odd_b
        x, y = a[i], b[j]
        while x != y:
            odd_a.append(i)
            odd_b.append(j)
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        odd_a.append(i)
        odd_b.append(j)
        i += 1
        j += 1


@dataclass
class Block:
    """Aligned texts: rows of the batch, token and group numbers where each text starts (and the last one ends)."""

    rows: list[int]
    a: np.ndarray
    b: np.ndarray
    a_starts: np.ndarray
    b_starts: np.ndarray
    a_last: np.ndarray  # whether a token ends a group
    b_last: np.ndarray
    a_links: np.ndarray  # the tokens of each link
    b_links: np.ndarray

    def groups(self) -> np.ndarray:
        done = np.concatenate(([0], np.cumsum(self.a_last)))
        return np.diff(done[self.a_starts])

    def spelled(self, words: list[str], n_a: int, n_b: int) -> Iterator[str]:
        """The groups of each text as ``a1,a2|b1;a3|b2,b3``."""
        starts = lambda last: np.concatenate(([0], np.flatnonzero(last) + 1))
        group_a, group_b = (np.cumsum(last) - last for last in (self.a_last, self.b_last))
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + starts(self.b_last)[group_a]] = self.a + n_a * self.a_last
        order[np.arange(len(self.b)) + starts(self.a_last)[group_b + 1]] = 2 * n_a + self.b + n_b * self.b_last
        stops = self.a_starts + self.b_starts
        for lo, hi in zip(stops[:-1], stops[1:]):
            yield "".join(map(words.__getitem__, order[lo:hi].tolist()))[:-1]


def _blocks(known: Tokenizers, texts: list[bytes | None]) -> Iterator[Block]:
    """Blocks of about ``BLOCK_BYTES`` of the texts that both tokenizers spell again; a longer text is a block of its own."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or b"") <= BLOCK_BYTES):
            size += len(texts[hi] or b"")
            hi += 1
        rows, plain = [], []
        for i in range(lo, hi):
            if texts[i]:
                try:
                    plain.append(texts[i].decode("utf8"))
                    rows.append(i)
                except UnicodeDecodeError:
                    pass
        lo = hi
        if not rows:
            continue
        a = _encoded(known, [" " + t for t in plain])
        b = known.b.encode(plain, num_threads=1)
        good = [k for k, i in enumerate(rows)
                if b"".join(map(known.a_bytes.__getitem__, a[k])) == b" " + texts[i] == b"".join(map(known.b_bytes.__getitem__, b[k]))]
        if good:
            yield _block([rows[k] for k in good], [a[k] for k in good], [b[k] for k in good], known)


def _block(rows: list[int], a_ids: list[list[int]], b_ids: list[list[int]], known: Tokenizers) -> Block:
    a, b = (np.concatenate([np.array(x, np.int64) for x in ids]) for ids in (a_ids, b_ids))
    a_starts, b_starts = (np.concatenate(([0], np.cumsum([len(x) for x in ids]))) for ids in (a_ids, b_ids))
    runs, odd_a, odd_b = align(np.cumsum(known.a_sizes[a]).tolist(), np.cumsum(known.b_sizes[b]).tolist())
    first_a, first_b, length = (np.array(x, np.int64) for x in zip(*runs))
    odd_a, odd_b = np.array(odd_a, np.int64), np.array(odd_b, np.int64)
    lasts = []
    for tokens, odd, first in ((a, odd_a, first_a), (b, odd_b, first_b)):
        last = np.ones(len(tokens), bool)
        last[odd] = False
        last[first[1:] - 1] = True  # a run follows the last token of an irregular group
        lasts.append(last)
    inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    a_links = np.concatenate((np.repeat(first_a, length) + inside, odd_a))
    b_links = np.concatenate((np.repeat(first_b, length) + inside, odd_b))
    return Block(rows, a, b, a_starts, b_starts, *lasts, a_links, b_links)


def _models(spark, byte_model: str, piece_model: str):
    """Both model files, whose size their vocabularies fix, as one broadcast; tasks need no file."""
    found = []
    for path in (byte_model, piece_model):
        with open(path, "rb") as f:
            found.append(f.read())
    return spark.sparkContext.broadcast(tuple(found))


def _read(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))


def _id_field(docs: DataFrame, id: str) -> T.StructField:
    return T.StructField(id, docs.schema[id].dataType)


def token_groups(docs: DataFrame, byte_model: str, piece_model: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its A and B tokens and how many of each form each group: id, a_ids, b_ids, a_sizes, b_sizes."""
    shared = _models(docs.sparkSession, byte_model, piece_model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _load(*shared.value)
        for batch in batches:
            found: list[tuple] = [([], [], [], [])] * batch.num_rows
            for block in _blocks(known, batch.column(1).to_pylist()):
                for k, row in enumerate(block.rows):
                    sides = []
                    for tokens, starts, last in ((block.a, block.a_starts, block.a_last), (block.b, block.b_starts, block.b_last)):
                        part = slice(starts[k], starts[k + 1])
                        sides.append((tokens[part], np.diff(np.concatenate(([0], np.flatnonzero(last[part]) + 1)))))
                    (a, a_sizes), (b, b_sizes) = sides
                    found[row] = (a, b, a_sizes, b_sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.list_(pa.int32())) for x in zip(*found)]],
                                             names=[id, "a_ids", "b_ids", "a_sizes", "b_sizes"])

    fields = [T.StructField(name, T.ArrayType(T.IntegerType())) for name in ("a_ids", "b_ids", "a_sizes", "b_sizes")]
    return _read(docs, id, text).mapInArrow(run, T.StructType([_id_field(docs, id), *fields]))


class _Unit:
    """Texts whose links share one list of distinct id pairs."""

    def __init__(self, unit: int) -> None:
        self.unit, self.n_links = unit, 0
        self.ids: list[pa.Array] = []
        self.numbers: list[np.ndarray] = []
        self.digests: list[str] = []
        self.texts: list[np.ndarray] = []
        self.pairs: list[np.ndarray] = []

    def add(self, ids: pa.Array, numbers: np.ndarray, digests: list[str], texts: np.ndarray, pairs: np.ndarray) -> None:
        self.texts.append(texts + len(self.digests))
        self.pairs.append(pairs)
        self.ids.append(ids)
        self.numbers.append(numbers)
        self.digests += digests
        self.n_links += len(pairs)

    def rows(self, names: list[str]) -> pa.RecordBatch:
        """One row per text; the first one also carries the unit's pairs and how often each is linked."""
        n = len(self.digests)
        pairs, place, times = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        key, links = np.unique(np.concatenate(self.texts) * max(1, len(pairs)) + place, return_counts=True)
        stops = np.searchsorted(key, np.arange(n + 1) * max(1, len(pairs)))
        place = (key % max(1, len(pairs))).astype(np.int32)
        links = links.astype(np.int32)
        cut = lambda x: pa.array([x[lo:hi].tobytes() for lo, hi in zip(stops[:-1], stops[1:])], pa.binary())
        once = lambda x: pa.array([x.astype(np.int64).tobytes()] + [None] * (n - 1), pa.binary())
        numbers = np.concatenate(self.numbers)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, self.unit)), pa.concat_arrays(self.ids), *[pa.array(numbers[:, k]) for k in range(4)],
             pa.array(self.digests, pa.string()), cut(place), cut(links), once(pairs), once(times)], names=names)


def _linked(docs: DataFrame, byte_model: str, piece_model: str, id: str, text: str, unit_links: int) -> DataFrame:
    shared = _models(docs.sparkSession, byte_model, piece_model)
    long, binary = T.LongType(), T.BinaryType()
    schema = T.StructType([
        T.StructField("unit", long), _id_field(docs, id), *[T.StructField(c, long) for c in ("n_a", "n_b", "n_groups", "n_links")],
        T.StructField("groups_sha256", T.StringType()), *[T.StructField(c, binary) for c in ("place", "links", "pairs", "times")]])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _load(*shared.value)
        n_a, n_b = len(known.a_bytes), len(known.b_bytes)
        base = TaskContext.get().partitionId() << 33
        unit = _Unit(base)
        for batch in batches:
            sizes = np.diff(_offsets(batch.column(1)))
            lo = 0
            while lo < batch.num_rows:
                # rows of a few blocks at a time become Python bytes
                hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(sizes[lo:]), 4 * BLOCK_BYTES, "right")))
                part = batch.slice(lo, hi - lo)
                lo = hi
                numbers = np.zeros((part.num_rows, 4), np.int64)
                digests = [""] * part.num_rows
                texts, pairs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for block in _blocks(known, part.column(1).to_pylist()):
                    rows = np.array(block.rows)
                    n = np.stack((np.diff(block.a_starts), np.diff(block.b_starts), block.groups()), axis=1)
                    numbers[rows, :3] = n
                    numbers[rows, 3] = n[:, 0] + n[:, 1] - n[:, 2]
                    for row, spelled in zip(block.rows, block.spelled(known.words, n_a, n_b)):
                        digests[row] = hashlib.sha256(spelled.encode()).hexdigest()
                    texts.append(rows[np.searchsorted(block.a_starts, block.a_links, "right") - 1])
                    pairs.append(block.a[block.a_links] << _B_BITS | block.b[block.b_links])
                unit.add(part.column(0), numbers, digests, np.concatenate(texts), np.concatenate(pairs))
                if unit.n_links >= unit_links:
                    yield unit.rows(names)
                    unit = _Unit(unit.unit + 1)
        if unit.digests:
            yield unit.rows(names)

    return _read(docs, id, text).mapInArrow(run, schema)


def _offsets(column: pa.Array) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))))


def _unit_pairs(linked: DataFrame) -> DataFrame:
    """(unit, pair, n): how often each unit links each id pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, pairs, times in zip(*[c.to_pylist() for c in batch.columns]):
                pairs, times = np.frombuffer(pairs, np.int64), np.frombuffer(times, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), unit)), pa.array(pairs), pa.array(times)], names=["unit", "pair", "n"])

    return linked.where("pairs is not null").select("unit", "pairs", "times").mapInArrow(run, "unit long, pair long, n long")


def _best(counts: DataFrame) -> DataFrame:
    """(pair, count) with whether no other pair of the same B id is linked more often."""
    b = F.col("pair").bitwiseAND((1 << _B_BITS) - 1)
    top = counts.groupBy(b.alias("b")).agg(F.max("count").alias("top"))
    return counts.withColumn("b", b).join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def pair_counts(docs: DataFrame, byte_model: str, piece_model: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """a_id, b_id, count, best: how many links hold each pair of ids, over all documents."""
    counts = _unit_pairs(_linked(docs, byte_model, piece_model, id, text, UNIT_LINKS)).groupBy("pair").agg(F.sum("n").alias("count"))
    return _best(materialize(counts, "pair_counts")).select(
        F.shiftright("pair", _B_BITS).cast("int").alias("a_id"), F.col("pair").bitwiseAND((1 << _B_BITS) - 1).cast("int").alias("b_id"), "count", "best")


def alignments(docs: DataFrame, byte_model: str, piece_model: str, id: str = "doc_id", text: str = "text", unit_links: int = UNIT_LINKS) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    linked = materialize(_linked(docs, byte_model, piece_model, id, text, unit_links), "linked")
    pairs = _unit_pairs(linked)
    counts = materialize(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "pair_counts")
    known = pairs.select("unit", "pair").join(materialize(_best(counts), "pair_best"), "pair")
    columns = [id, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def scored(texts: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(found["pair"].to_numpy())
        count, best = found["count"].to_numpy()[order], found["best"].to_numpy(zero_copy_only=False)[order]
        n_best, count_sum = [], []
        for place, links in zip(texts["place"].to_pylist(), texts["links"].to_pylist()):
            place, links = np.frombuffer(place, np.int32), np.frombuffer(links, np.int32).astype(np.int64)
            n_best.append(int(links[best[place].astype(bool)].sum()) if len(place) else 0)
            count_sum.append(int((links * count[place]).sum()) if len(place) else 0)
        made = texts.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
        return made.select(columns)

    texts = linked.drop("pairs", "times")
    schema = T.StructType([texts.schema[c] if c in texts.columns else T.StructField(c, T.LongType()) for c in columns])
    return texts.groupBy("unit").cogroup(known.groupBy("unit")).applyInArrow(scored, schema)
