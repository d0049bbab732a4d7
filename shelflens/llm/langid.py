"""Language identification by rank-order profiles of character n-grams.

A text's letters (lower case) are taken with one space between words; its 1- to 3-grams are ranked by frequency, ties by
code. A profile is the same ranking over all training texts of a language. The distance of a text to a language is the sum
of how far each of its ``top`` n-grams is out of place, ``top`` for one the profile lacks; the nearest language wins, ties
go to the language that sorts first.

Defined results: a null or letterless text is ``und`` with score 0; rows whose language is null teach nothing; without
any training text every row is ``und``; texts of any length are read whole; repeated rows are predicted each; an empty table gives an
empty one; other columns stay, but for those named like the prediction and its score, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelflens.llm.common import released

UNDETERMINED = "und"
TOP = 300
FOLDED_ROWS = 1 << 21


def _letters() -> np.ndarray:
    """For code points below 65536 the point itself if a letter, else a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x10000)], np.int64)


def _grams(text: str, letters: np.ndarray) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) and points.max() >= 0x10000:
        high = points >= 0x10000
        known = {int(c): int(c) if chr(c).isalpha() else 32 for c in np.unique(points[high])}
        mapped = letters[np.where(high, 32, points)]
        mapped[high] = [known[int(c)] for c in points[high]]
    else:
        mapped = letters[points]
    line = np.full(len(mapped) + 2, 32, np.int64)
    line[1:-1] = mapped
    gap = line == 32
    line = line[~(gap & np.concatenate(([False], gap[:-1])))]
    if len(line) < 2:
        return np.zeros(0, np.int64)
    pairs = line[:-1] | line[1:] << 21
    return np.concatenate((line[line != 32], pairs, pairs[:-1] | line[2:] << 42))


def _fold(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    return grams[first], np.add.reduceat(counts, first)


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> list[tuple[str, list[int]]]:
    """The ``top`` n-grams of every language over all rows of ``docs``, most frequent first.

    Counts are added up in each task before they are shuffled. What comes to the driver is ``top`` codes per language.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, seen = _letters(), {}
        waiting: dict[str, list[np.ndarray]] = {}

        def fold(key: str) -> None:
            grams = np.sort(np.concatenate(waiting.pop(key)))
            first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
            grams, counts = grams[first], np.diff(np.append(first, len(grams)))
            if key in seen:
                grams, counts = _fold(np.concatenate((seen[key][0], grams)), np.concatenate((seen[key][1], counts)))
            seen[key] = grams, counts

        for batch in batches:
            for value, key in zip(batch.column(0), batch.column(1).to_pylist()):
                grams = _grams(value.as_py(), letters)
                if len(grams):
                    waiting.setdefault(key, []).append(grams)
                    if len(grams) > FOLDED_ROWS or sum(map(len, waiting[key][-64:])) > FOLDED_ROWS or len(waiting[key]) >= 64:
                        fold(key)
        for key in list(waiting):
            fold(key)
        for key, (grams, counts) in seen.items():
            for at in range(0, len(grams), 50_000):
                part = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(grams[part]), pa.string()), pa.array(grams[part]), pa.array(counts[part].astype(np.int64))],
                    names=["lang", "gram", "n"])

    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    counted = rows.mapInArrow(released(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    kept = counted.withColumn("rank", rank).where(F.col("rank") <= top).orderBy("lang", "rank").select("lang", "gram").toArrow()
    out: dict[str, list[int]] = {}
    for key, gram in zip(kept["lang"].to_pylist(), kept["gram"].to_pylist()):
        out.setdefault(key, []).append(gram)
    return sorted(out.items())


def predict(docs: DataFrame, known: list[tuple[str, list[int]]], text: str = "text", top: int = TOP,
            prediction: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the nearest language and a score: how much nearer it is than the second, from 0 to 1."""
    names = [k for k, _ in known]
    table = np.unique(np.array([g for _, grams in known for g in grams], np.int64))
    ranks = np.full((len(known), len(table) + 1), 2 * top, np.int32)
    for i, (_, grams) in enumerate(known):
        ranks[i, np.searchsorted(table, np.array(grams, np.int64))] = np.arange(len(grams))
    shared = docs.sparkSession.sparkContext.broadcast((table, ranks))

    def nearest(value: str | None, letters: np.ndarray, table: np.ndarray, ranks: np.ndarray) -> tuple[str, float]:
        grams = _grams(value, letters) if value and names else ()
        if not len(grams):
            return UNDETERMINED, 0.0
        codes, counts = np.unique(grams, return_counts=True)
        if len(codes) > top:  # all with the count of the last place stay in the running; ties go by code
            least = np.partition(counts, len(counts) - top)[len(counts) - top]
            codes, counts = codes[counts >= least], counts[counts >= least]
        codes = codes[np.argsort(-counts, kind="stable")][:top]
        place = np.searchsorted(table, codes)
        place[place == len(table)] = len(table) - 1
        place = np.where(table[place] == codes, place, len(table))
        away = np.minimum(np.abs(ranks[:, place] - np.arange(len(codes))), top).sum(axis=1)
        best = int(np.argmin(away))
        if len(names) == 1:
            return names[0], float(1 - away[0] / (top * len(codes)))
        second = int(np.partition(away, 1)[1])
        return names[best], float((second - away[best]) / second) if second else 0.0

    @F.arrow_udf("struct<lang:string,score:double>")
    def judged(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        letters = _letters()
        table, ranks = shared.value
        for part in texts:
            found = [nearest(v.as_py(), letters, table, ranks) for v in part]
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang", "score"])

    # only the texts go to Python; the other columns wait in the JVM
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (prediction, score)]
    found = docs.select(*kept, judged.asNondeterministic()(F.col(f"`{text}`").cast("string")).alias("__found"))  # evaluated once
    return found.select(*kept, F.col("__found.lang").alias(prediction), F.col("__found.score").alias(score))


def identify(docs: DataFrame, training: Column, text: str = "text", lang: str = "lang", top: int = TOP) -> DataFrame:
    """Profiles from the rows of ``docs`` where ``training`` holds, predictions for all rows."""
    return predict(docs, profiles(docs.where(training), text, lang, top), text, top)
