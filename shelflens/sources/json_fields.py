"""Reading loose JSON through the variant type: first field that is there, by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelflens.functions import money


def spread(df: DataFrame, doc: str, paths: list[str]) -> DataFrame:
    """Every path as a column of its own name, so each is looked up once; a JSON null counts as absent."""
    names = list(dict.fromkeys(paths))
    found = df.select("*", *[F.try_variant_get(F.col(doc), p, "variant").alias(p) for p in names])
    return found.select(*df.columns, *[F.when(~F.is_variant_null(at(p)), at(p)).alias(p) for p in names])


def at(path: str) -> Column:
    return F.col(f"`{path}`")


def typed(df: DataFrame, paths: list[str]) -> DataFrame:
    """Spread paths split by kind: ``number of <path>`` and ``text of <path>``; the variants themselves go."""
    names = list(dict.fromkeys(paths))
    kinds = df.select("*", *[kind(at(p)).alias(f"kind of {p}") for p in names])
    number = r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"
    return kinds.select(
        *[c for c in df.columns if c not in names],
        *[F.when(at(f"kind of {p}").rlike(number), at(p).cast("string").try_cast("double")).alias(f"number of {p}") for p in names],
        *[F.when(at(f"kind of {p}") == "STRING", as_text(at(p))).alias(f"text of {p}") for p in names])


def number_at(*paths: str) -> Column:
    return F.coalesce(*[at(f"number of {p}") for p in paths])


def text_at(*paths: str) -> Column:
    return F.coalesce(*[at(f"text of {p}") for p in paths])


def first_at(*paths: str) -> Column:
    return F.coalesce(*[at(p) for p in paths])


def field(doc: Column, path: str) -> Column:
    """The value at a path; a JSON null counts as absent."""
    value = F.try_variant_get(doc, path, "variant")
    return F.when(~F.is_variant_null(value), value)


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_number(value: Column) -> Column:
    return kind(value).rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)")


def as_text(value: Column) -> Column:
    """Any scalar as text, blank as null."""
    text = F.trim(value.cast("string"))
    return F.when(text != "", text)


def only_text(value: Column) -> Column:
    """A JSON string, trimmed; anything else is null."""
    return F.when(kind(value) == "STRING", as_text(value))


def only_number(value: Column) -> Column:
    return F.when(is_number(value), value.cast("string").try_cast("double"))


def online_price(value: Column) -> Column:
    """N1 on a loose value: text and number follow their own rules; absent stays null."""
    return F.when(is_number(value), money.price_number_to_minor(only_number(value))).when(
        value.isNotNull(), money.price_text_to_minor(value.cast("string")))


def recognition_price_at(path: str) -> Column:
    """N1b on a typed path."""
    return F.coalesce(money.recognition_number_to_minor(at(f"number of {path}")),
                      money.recognition_text_to_minor(at(f"text of {path}")))


def array_field(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "array<variant>")
