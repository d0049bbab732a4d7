"""Toxicity by a weighted finite-state grammar over clauses.

Tokens are classed by a lexicon (insult, threat, target, negation, reported speech, rest); insult terms and their weights are
learned from labelled documents: words and word beginnings (``lowe*``) that set toxic documents apart. Three small transducers
read a clause, each with its own states:

* negation: for ``NEGATED`` tokens after a negation an insult or threat counts ``NEGATION`` of its weight;
* reported speech: after a reporting word or inside quotation marks it counts ``REPORTED``;
* target: a clause that addresses somebody multiplies its sum by ``TARGETED``, one with a threat besides by ``THREATENED``.

They are composed into one table of states, so a clause costs one step per token. A document's evidence is its strongest clause
plus half of the second strongest and so on; a line fitted to the training documents turns evidence into a score.

Defined results: null, empty and wordless texts have evidence 0 and the score of that; labels of documents that occur twice are
toxic if one of them is; null labels teach nothing; without toxic training documents every score is 0; repeated rows and rows
without an id are scored each; texts of any length are read whole; clauses of equal weight count alike; an empty table gives an empty one;
extra columns stay, but for those named like the results, which are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from shelflens.session import materialize

#: At most so many labelled documents are read for training, taken by hash of their id.
TRAINING_ROWS = 40_000
LEAST_DOCS, LEAST_SHARE = 4, 0.01  # toxic training documents that must hold a term
LEAST_WEIGHT = 2.5
PREFIXES = (4, 5)
NEGATED, NEGATION, REPORTED, TARGETED, THREATENED = 3, 0.3, 0.5, 1.3, 1.2

#: Closed word classes of the grammar.
OTHER, INSULT, THREAT, TARGET, NEGATE, REPORT, QUOTE = range(7)
THREATS = "kill hurt destroy beat punch shoot burn stab attack die".split()
TARGETS = "you your yours yourself he she they him her them du dich ihr sie tu toi vous te ti usted ustedes".split()
NEGATIONS = "not no never isn't aren't don't wasn't nicht kein keine pas jamais nunca".split()
REPORTS = "said says wrote writes called claimed quoted sagte schrieb disait dijo".split()
CLOSED = {w: c for words, c in ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATE), (REPORTS, REPORT)) for w in words}
TOKEN = re.compile(r"\w+(?:'\w+)?|[.!?;:\n]|[\"“”«»]")
THREAT_WEIGHT = 1.0


def _negation(state: int, token: int) -> tuple[int, float]:
    return (NEGATED if token == NEGATE else max(0, state - 1)), (NEGATION if state else 1.0)


def _reported(state: int, token: int) -> tuple[int, float]:
    # bit 0: a reporting word was read, bit 1: inside quotation marks
    after = state | 1 if token == REPORT else state ^ 2 if token == QUOTE else state
    return after, (REPORTED if state else 1.0)


def _addressed(state: int, token: int) -> tuple[int, float]:
    return (state | 1 if token == TARGET else state | 2 if token == THREAT else state), 1.0


def compose(*machines) -> tuple[list[list[tuple[int, float]]], list[tuple[int, ...]]]:
    """One table state -> token class -> (next state, weight factor) for machines that read the same tokens side by side."""
    states, table = [tuple(0 for _ in machines)], []
    number = {states[0]: 0}
    for state in states:
        row = []
        for token in range(7):
            steps = [m(s, token) for m, s in zip(machines, state)]
            after = tuple(s for s, _ in steps)
            if after not in number:
                number[after] = len(states)
                states.append(after)
            row.append((number[after], math.prod(f for _, f in steps)))
        table.append(row)
    return table, states


GRAMMAR, STATES = compose(_negation, _reported, _addressed)


def classed(tokens: list[str], insults: dict[str, float]) -> list[tuple[int, float]]:
    """(class, weight) of every token."""
    out = []
    for t in tokens:
        w = insults.get(t)
        if w is None and len(t) > 3:
            w = insults.get(t[:5] + "*") if len(t) > 4 else None
            if w is None:
                w = insults.get(t[:4] + "*")
        if w is not None:
            out.append((INSULT, w))
        elif t in CLOSED:
            out.append((CLOSED[t], THREAT_WEIGHT if CLOSED[t] == THREAT else 0.0))
        else:
            out.append((QUOTE if t in "\"“”«»" else OTHER, 0.0))
    return out


def clause_weight(tokens: list[tuple[int, float]]) -> float:
    """Weight of a clause read by the composed grammar; a threat counts only against somebody."""
    state, insult, threat = 0, 0.0, 0.0
    for token, w in tokens:
        after, factor = GRAMMAR[state][token]
        if token == INSULT:
            insult += w * factor
        elif token == THREAT:
            threat += w * factor
        state = after
    addressed = STATES[state][2]
    if addressed & 1:
        return (insult + threat) * (TARGETED if insult else 1.0) * (THREATENED if addressed & 2 and insult else 1.0)
    return insult


def evidence(text: str | None, insults: dict[str, float]) -> float:
    """Strongest clause, half of the next, and so on."""
    tokens = TOKEN.findall(text.lower()) if text else []
    if not tokens:
        return 0.0
    four = {t[:4] + "*" for t in tokens}
    if not (four & insults.keys() or not insults.keys().isdisjoint(tokens) or {t[:5] + "*" for t in tokens} & insults.keys()
            or not _THREATS.isdisjoint(tokens)):
        return 0.0
    weights, clause = [], []
    for t in [*tokens, "."]:
        if t in ".!?;:\n":
            if clause:
                w = clause_weight(classed(clause, insults))
                if w:
                    weights.append(w)
            clause = []
        else:
            clause.append(t)
    weights.sort(reverse=True)
    return sum(math.ldexp(w, -i) for i, w in enumerate(weights))


_THREATS = frozenset(THREATS)


def _features(text: str) -> set[str]:
    words = {t for t in TOKEN.findall(text.lower()) if t[0].isalpha()}
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) >= k}


def training_rows(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
                  rows: int = TRAINING_ROWS) -> DataFrame:
    """(t, y) of at most ``rows`` labelled documents; the labels' side of the join is bounded by that number and broadcast."""
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("k")).agg(F.max(label).cast("int").alias("y"))
    sample = materialize(known.orderBy(F.xxhash64("k")).limit(rows), "labelled")
    return (docs.select(F.col(id).alias("k"), F.col(text).cast("string").alias("t")).where("t is not null")
            .join(F.broadcast(sample), "k").select("t", "y"))


def learn(training: DataFrame) -> tuple[dict[str, float], float, float]:
    """Insult terms with their weights, and slope and middle of the line from evidence to score.

    Documents per term and label are counted in each task, then added up; what the driver gets is one number per training row and the
    terms that ``LEAST_SHARE`` of the toxic rows hold: at most 1 / ``LEAST_SHARE`` times what such a row holds on average.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            for y, counter in enumerate(seen):
                if counter:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counter)), pa.array([y] * len(counter), pa.int32()),
                                                      pa.array(list(counter.values()), pa.int64())], names=["term", "y", "n"])
                counter.clear()

        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[1 if y else 0].update(_features(t))
            if len(seen[0]) + len(seen[1]) > 400_000:
                yield from flush()
        yield from flush()

    sizes = {r.y: r.n for r in training.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return {}, 1.0, math.inf
    by_term = (training.mapInArrow(count, "term string, y int, n long").groupBy("term")
               .agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("n0")))
    weight = F.log((F.col("n1") + 0.5) / (toxic + 1.0)) - F.log((F.col("n0") + 0.5) / (clean + 1.0))
    kept = (by_term.withColumn("w", weight).where((F.col("n1") >= max(LEAST_DOCS, LEAST_SHARE * toxic)) & (F.col("w") >= LEAST_WEIGHT))
            .orderBy(F.desc(F.col("n1") * F.col("w")), "term").select("term", "w").toArrow())
    insults = dict(zip(kept["term"].to_pylist(), kept["w"].to_pylist()))
    scored = scored_evidence(training, insults, "t").select("evidence", "y").toArrow()
    x, y = scored["evidence"].to_numpy(), scored["y"].to_numpy() > 0
    # the middle is the split with the fewest errors, halfway between the neighbours; ties go to the widest gap
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    wrong = np.concatenate(([0], np.cumsum(y))) + (np.sum(~y) - np.concatenate(([0], np.cumsum(~y))))
    edge = np.concatenate(([x[0] - 1], x, [x[-1] + 1]))
    gap = np.diff(edge)
    wrong = np.where(gap > 0, wrong, len(x) + 1)
    best = np.flatnonzero(wrong == wrong.min())
    best = best[np.argmax(gap[best])]
    middle = float((edge[best] + edge[best + 1]) / 2)
    return insults, 4.0 / max(middle, 1e-9), middle


def scored_evidence(docs: DataFrame, insults: dict[str, float], text: str = "text", out: str = "evidence") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(insults)
    kept = [f for f in docs.schema.fields if f.name not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        for batch in batches:
            found = [evidence(t.as_py(), terms) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.float64())], names=[*batch.schema.names[1:], out])

    rows = docs.select(F.col(text).cast("string").alias("__text"), *[F.col(f"`{f.name}`") for f in kept])
    return rows.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.DoubleType())]))


def score(docs: DataFrame, model: tuple[dict[str, float], float, float], text: str = "text") -> DataFrame:
    """``docs`` without the text, with evidence, score and predicted."""
    insults, slope, middle = model
    line = F.lit(0.0) if math.isinf(middle) else 1 / (1 + F.exp(-F.lit(slope) * (F.col("evidence") - F.lit(middle))))
    return scored_evidence(docs, insults, text).withColumn("score", line).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
