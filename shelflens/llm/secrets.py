"""Secrets in source and configuration text.

Base kinds are plain patterns (assign, access, hex). The method reads the text as a series of bindings, name op literal, in
one pass: names may be dotted, quoted or dashed; operators are = : := =>; literals are quoted strings, bare words
or names bound earlier, whose constant they take over, and sums (+) of strings and names; a name not bound adds nothing. A literal is scored by how sensitive its target name is and by how much
it looks like a credential; ``literal`` spans are the literals of score ``LEAST`` or more that no base span covers.

Defined results: a null text is an empty text; offsets are code points, the end exclusive; spans come by start, then by kind in
the order of KINDS, so ties have one order; a name bound twice has its later constant from there on; texts of any length are read whole, constants
may grow without bound; extra columns stay, but for one named like the output, which is replaced; repeated rows are scanned each; an empty
table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

KINDS = ("assign", "access", "hex", "literal")
LEAST = 0.5

#: The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST = 8

#: What parts of a name say about the value bound to it.
NAME_WEIGHT = {
    "password": 0.9, "passwd": 0.9, "pwd": 0.8, "passphrase": 0.9, "pass": 0.5, "secret": 0.9, "token": 0.7, "apikey": 0.9, "credential": 0.8,
    "credentials": 0.8, "auth": 0.5, "bearer": 0.7, "private": 0.4, "key": 0.4, "access": 0.3, "api": 0.3, "client": 0.1, "signature": 0.4,
    "salt": 0.4, "cookie": 0.4, "session": 0.3, "connection": 0.2, "dsn": 0.4,
}
#: Parts of a name whose value may be a phrase of several words.
PHRASE = {"password", "passwd", "pwd", "passphrase"}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|change_?me|example|placeholder|your[_-].*|test|none|null|true|false|todo|redacted|<.*>|\$\{.*\}|\{\{.*\}\})$")

_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
_STRING = r'"(?:[^"\\\n]|\\.)*+"' + r"|'(?:[^'\\\n]|\\.)*+'"
BINDING = re.compile(
    rf"""(?<![A-Za-z0-9_.\-])(?P<name>{_NAME})["']?[ \t]*(?::=|=>|=(?!=)|:(?!:))[ \t]*(?P<value>(?:{_STRING})(?:[ \t]*\+[ \t]*(?:{_STRING}|{_NAME}))*+|{_NAME}(?:[ \t]*\+[ \t]*(?:{_STRING})|[ \t]++\+[ \t]++{_NAME})++|[^\s"',;(){{}}\[\]<>]++)""",
    re.A)
_SUM = re.compile(r"[ \t]*\+[ \t]*[\"']|[ \t]+\+[ \t]+[A-Za-z_]")
_PART = re.compile(rf"{_STRING}|{_NAME}", re.A)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def _parts(name: str) -> set[str]:
    parts = [p.lower() for p in _WORDS.findall(name)]
    return {a + b for a, b in zip(parts, parts[1:])} | set(parts)


def name_score(name: str) -> float:
    """How sensitive a target name is, from the weights of its parts (camel case, dots, dashes and underscores part them)."""
    return 1 - math.prod(1 - NAME_WEIGHT.get(p, 0.0) for p in _parts(name))


class Constant:
    """A constant by its length, how often each character stands in it, and its ends: all that a score needs.

    Sums add up, so constants that double or grow with every binding cost no more than their alphabet. Numbers are
    ``value * 2**shift``; they are exact up to 2^53 and keep their proportions beyond.
    """

    __slots__ = ("counts", "size", "shift", "head", "tail")
    KEPT = 24

    def __init__(self, counts: dict[str, float], size: float, shift: int, head: str, tail: str) -> None:
        self.counts, self.size, self.shift, self.head, self.tail = counts, size, shift, head, tail

    @classmethod
    def of(cls, text: str) -> Constant:
        return cls(Counter(text), len(text), 0, text[:cls.KEPT], text[-2:])

    def __add__(self, other: Constant) -> Constant:
        shift = max(self.shift, other.shift)
        mine, its = math.ldexp(1.0, self.shift - shift), math.ldexp(1.0, other.shift - shift)
        counts = {c: n * mine for c, n in self.counts.items()}
        for c, n in other.counts.items():
            counts[c] = counts.get(c, 0.0) + n * its
        size = self.size * mine + other.size * its
        if size > 2.0 ** 900:
            counts, size, shift = {c: n * 2.0 ** -800 for c, n in counts.items()}, size * 2.0 ** -800, shift + 800
        head = self.head if self.shift or self.size >= self.KEPT else (self.head + other.head)[:self.KEPT]
        return Constant(counts, size, shift, head, (self.tail + other.tail)[-2:])

    def has(self, character: str) -> bool:
        return character in self.counts

    def placeholder(self) -> bool:
        if not self.shift and self.size <= self.KEPT:
            return PLACEHOLDER.match(self.head) is not None
        # of the longer ones, those of one character or between two ends
        return (any(self.counts.keys() <= set(one) for one in ("xX", "*", ".")) or re.match(r"(?i)your[_-]", self.head) is not None
                or any(self.head.startswith(left) and self.tail.endswith(right) for left, right in (("<", ">"), ("${", "}"), ("{{", "}}"))))


def value_score(value: str | Constant, phrase: bool = False) -> float:
    """How much a literal looks like a credential: length, characters spread evenly, letters mixed with digits; spaces only in a phrase."""
    value = Constant.of(value) if isinstance(value, str) else value
    if (value.size < 8 and not value.shift) or value.placeholder() or (value.has(" ") and not phrase):
        return 0.0
    bits = -sum(c / value.size * math.log2(c / value.size) for c in value.counts.values() if c)
    mixed = any(c.isdigit() for c in value.counts) and any(c.isalpha() for c in value.counts)
    return min(1.0, bits / 4 + (0.2 if mixed else -0.2))


_NOTHING = Constant({}, 0, 0, "", "")


def _sum(raw: str, known: dict[str, Constant]) -> Constant:
    """The strings and bound names of a sum, added up pairwise."""
    parts = [Constant.of(p[1:-1]) if p[0] in "\"'" else known.get(p, _NOTHING) for p in _PART.findall(raw)]
    while len(parts) > 1:
        parts = [x + y for x, y in zip(parts[::2], parts[1::2])] + parts[len(parts) & ~1:]
    return parts[0]


def literals(text: str) -> list[tuple[int, int, str, Constant, float]]:
    """(start, end, name, constant, score) of every binding's literal; a name bound to a known constant scores at its own use."""
    if "=" not in text and ":" not in text:
        return []
    known: dict[str, Constant] = {}
    out = []
    at = 0
    while m := BINDING.search(text, at):
        name, raw, at = m["name"], m["value"], m.end()
        start, end = m.span("value")
        first = _PART.match(raw)
        if raw[0] not in "\"'" and first and _SUM.match(raw, first.end()):
            at = start + first.end()  # the strings of a sum that begins with a name are read for bindings of their own, too
            value = _sum(raw, known)
            phrase = value.has(" ") and not PHRASE.isdisjoint(_parts(name))
            if first[0] in known or value_score(value, phrase) >= value_score(first[0]):
                known[name] = value
                out.append((start, end, name, value, name_score(name) * value_score(value, phrase)))
                continue
            raw = first[0]  # an unquoted literal and something added
        if raw[0] in "\"'":
            value = _sum(raw, known)
            if _PART.match(raw).end() == len(raw):
                start, end = start + 1, end - 1
        else:
            raw = raw.rstrip(".")
            end = start + len(raw)
            value = known.get(raw) or Constant.of(raw)
        known[name] = value
        score = name_score(name) * value_score(value, value.has(" ") and not PHRASE.isdisjoint(_parts(name)))
        out.append((start, end, name, value, score))
    return out


def spans(text: str) -> list[tuple[str, int, int, str | None, float]]:
    """(kind, start, end, name, score) of all spans, by start and then by kind."""
    base = [("assign", m.start(), m.end(), m[1], 0.9) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST] if "=" in text or ":" in text else []
    base += [("access", m.start(), m.end(), None, 0.9) for m in ACCESS.finditer(text)]
    base += [("hex", m.start(), m.end(), None, 0.6) for m in HEX.finditer(text)]
    found = sorted(base, key=lambda s: (s[1], KINDS.index(s[0])))
    more, at, reach = [], 0, -1  # base spans that start no later than the literal, and how far they reach
    for start, end, name, _, score in literals(text):
        while at < len(found) and found[at][1] <= start:
            reach = max(reach, found[at][2])
            at += 1
        if score >= LEAST and reach < end and end > start:
            more.append(("literal", start, end, name, score))
    return sorted([*found, *more], key=lambda s: (s[1], KINDS.index(s[0])))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                                  T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))


def find(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` without the text, with an array of (kind, start, end, name, score)."""
    kept = [f for f in docs.schema.fields if f.name not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "name", "score"), s)) for s in spans(t.as_py() or "")] for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, _ARROW)], names=[*batch.schema.names[1:], out])

    rows = docs.select(F.col(text).cast("string").alias("__text"), *[F.col(f"`{f.name}`") for f in kept])
    return rows.mapInArrow(run, T.StructType([*kept, T.StructField(out, SPANS)]))
