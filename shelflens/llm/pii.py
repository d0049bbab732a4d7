"""Personal data as column expressions: patterns propose spans, checksums confirm them, nearby words adjust their score.

Everything is DataFrame functions; a row's spans are found in its whole text without a shuffle.

Kinds of the base: email, ip (parts up to 255), card (16 to 19 digits, Luhn), phone (8 to 15 digits). Added by the method:
iban (mod 97) and ssn-like national numbers, each only where its check or a context word confirms it. Base spans are always
kept; a context word within ``REACH`` characters before a span, and after the span before it, raises its score.

Patterns give the same leftmost, non-overlapping matches as their plain forms and stay linear on long runs: a run is entered
at its first character or where the last match ended, and is never given back.

Defined results: a null text is an empty text without spans; offsets are code points, the end exclusive; spans of one place come in
the order of the kinds; texts of any length are read whole; repeated rows are read each; an empty table gives an empty one; extra columns
stay, but for one named like the output, which is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

REACH = 40
KINDS = ("email", "ip", "card", "phone")

#: The patterns of the base kinds.
LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Added kinds.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
NATIONAL = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: Words that speak for a kind when they stand shortly before a span, and the weight they add.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|reply|write to)\b",
    "ip": r"(?i)\b(?:ip|host|address|server|login|client)\b",
    "card": r"(?i)\b(?:card|visa|credit|debit|payment|pan)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|whatsapp)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
    "ssn": r"(?i)\b(?:ssn|social security|tax id)\b",
}


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    prior: float  # score without context


FOUND = (Kind("email", EMAIL, 0.9), Kind("ip", IP, 0.6), Kind("card", CARD, 0.8), Kind("phone", PHONE, 0.6),
         Kind("iban", IBAN, 0.9), Kind("ssn", NATIONAL, 0.4))


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    """Whether an IBAN's rearranged digits leave 1 modulo 97; letters stand for 10 to 35."""
    plain = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    step = lambda s, c: F.when(c.between("0", "9"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda s, c: F.when(c == "", s).otherwise(step(s, c))) == 1


def _confirmed(kind: str, m: Column, score: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.concat(F.lit("0"), F.substring(part(p), 1, 3)).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(_digits(m)).between(16, 19), F.call_function("luhn_check", _digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "iban":
        return _mod97(m)
    if kind == "ssn":
        return score > 0.5
    return F.lit(True)


def _running(lengths: Column) -> Column:
    """Sums of all earlier entries plus the own one, for an array of any length: blocks of about its root keep it short."""
    def blocks(x: Column) -> Column:
        step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x))).cast("int"))
        cut = F.transform(F.sequence(F.lit(0), F.size(x) - 1, step), lambda s: F.slice(x, s + 1, step))
        add = lambda a: F.aggregate(a, F.lit(0), lambda s, v: s + v)
        return _bind(cut, lambda parts: _bind(F.transform(parts, add), lambda sums: F.flatten(F.transform(
            parts, lambda part, j: _bind(add(F.slice(sums, 1, j)), lambda base: F.transform(
                part, lambda _, i: base + add(F.slice(part, 1, i + 1))))))))
    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(_bind(lengths, blocks))


def _spans(text: Column, kind: Kind) -> Column:
    """array<struct<kind, start, end, score>> of one kind, unconfirmed matches left out."""
    def placed(matches: Column) -> Column:
        # gaps[i] stands before matches[i]
        return _bind(F.split(text, kind.pattern, -1), lambda gaps: _bind(
            _running(F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("g"), matches.alias("m")),
                                 lambda x: F.length(x["g"]) + F.length(x["m"]))),
            lambda ends: F.transform(matches, lambda m, i: F.struct(
                F.lit(kind.name).alias("kind"), (F.element_at(ends, i + 1) - F.length(m)).alias("start"), F.element_at(ends, i + 1).alias("end"),
                F.when(F.right(F.element_at(gaps, i + 1), F.lit(REACH)).rlike(CONTEXT[kind.name]), F.lit(min(1.0, kind.prior + 0.3)))
                .otherwise(F.lit(kind.prior)).alias("score"), m.alias("m")))))

    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    found = _bind(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)),
                  lambda ms: F.when(F.size(ms) == 0, none).otherwise(F.transform(
                      F.filter(placed(ms), lambda s: _confirmed(kind.name, s["m"], s["score"])),
                      lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))))
    likely = {"email": text.contains("@"), "phone": text.contains("+"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
              "iban": text.rlike("[A-Z]{2}[0-9]{2}"), "ssn": text.rlike("[0-9]{3}-[0-9]{2}-")}[kind.name]
    return F.when(likely, found).otherwise(none)


def find(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with an array of (kind, start, end, score): base kinds in the order of KINDS, then the added ones, each by start."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.withColumn(out, F.concat(*[_spans(whole, k) for k in FOUND]))


def redact(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """Replaces every span of score ``least`` or more by <KIND>; spans that overlap become one tag, that of the first of them.

    The text is cut at the spans in order of their start, so each character is copied once.
    """
    ordered = F.array_sort(F.transform(F.filter("__pii", lambda s: s["score"] >= least),
                                       lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    first = F.aggregate(
        ordered, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts"))).otherwise(F.struct(
            s["end"].alias("at"), F.concat(acc["parts"], F.array(
                F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))).alias("parts"))),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text)))))
    return find(docs, text, "__pii").withColumn(text, F.when(F.size("__pii") > 0, first).otherwise(F.col(text))).drop("__pii")
