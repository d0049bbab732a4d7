"""Records of delimited text files, read by byte range, with their true numbers in the file.

A large file is read by many tasks, so no task sees where quotes opened or how many lines came before. Each byte range is summed up
first: how many lines it holds and whether it holds an odd number of quotes. A scan over the ranges of a file (one small row each) tells
each range whether it starts inside a quoted field; a second one, how many records start before it. Only records that span
several lines are put together in a shuffle; all others stay where they were read.

Lines end in \\n or \\r\\n. A quote inside a field stands doubled inside a quoted field. Empty lines outside of quotes are no records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from shelflens.session import materialize

DELIMITERS = (",", ";", "\t", "|")
GUESS_RECORDS = 10
RANGE = ["file", "range_start"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, range_start, line (rising inside a range), text and the number of its quotes."""
    text = spark.read.option("lineSep", "\n").text(path)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range_start"),
                       F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))
    mark = (F.col("range_start") == 0) & F.col("text").startswith("﻿")
    rows = rows.withColumn("text", F.when(mark, F.substr("text", F.lit(2))).otherwise(F.col("text")))
    return rows.withColumn("quotes", F.length("text") - F.length(F.translate("text", '"', "")))


def _before(column: str) -> Column:
    """The sum of a column over the ranges of the file before this one."""
    return F.coalesce(F.sum(column).over(Window.partitionBy("file").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """file, record (0 for the first one of a file) and its text, of all files under ``path``."""
    lines = materialize(_lines(spark, path), "lines")
    parity = lines.groupBy(*RANGE).agg(F.sum("quotes").alias("quotes"))
    parity = parity.select(*RANGE, (_before("quotes") % 2).alias("open"))
    inside = Window.partitionBy(*RANGE).orderBy("line")
    upto = F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("open")
    rows = lines.join(parity, RANGE).withColumn("upto", upto)
    rows = rows.withColumn("goes_on", (F.col("upto") - F.col("quotes")) % 2 == 1).withColumn("stays_open", F.col("upto") % 2 == 1)
    starts = ~F.col("goes_on") & ~F.col("text").isin("", "\r")
    rows = materialize(rows.select(*RANGE, "line", "text", "goes_on", "stays_open", starts.cast("int").alias("starts")), "marked")
    counts = rows.groupBy(*RANGE).agg(F.sum("starts").alias("starts")).select(*RANGE, _before("starts").alias("earlier"))
    own = F.sum("starts").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.join(counts, RANGE).withColumn("record", F.col("earlier") + own - 1)
    whole = placed.where("starts = 1 and not stays_open").select("file", "record", "text")
    # ranges of a file follow each other, so do the lines inside one; the lines of one record
    parts = placed.where("goes_on or stays_open").groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("range_start", "line", "text"))).alias("parts"))
    split = parts.select("file", "record", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    return whole.unionByName(split).withColumn("text", F.regexp_replace("text", r"\r$", ""))


def _pattern(delimiter: str) -> str:
    d = "\\" + delimiter if delimiter == "|" else delimiter
    return f'{d}(?: *+"(?:[^"]++|"")*+"[^{d}]*+|[^{d}]*+)'


def split_fields(text: Column, delimiter: Column) -> Column:
    """The fields of a record, trimmed, without their quotes."""
    raw = F.lit(None).cast("array<string>")
    for d in DELIMITERS:
        raw = F.when(delimiter == d, F.regexp_extract_all(F.concat(F.lit(d), text), F.lit(_pattern(d)), 0)).otherwise(raw)

    def bare(field: Column) -> Column:
        value = F.trim(F.substr(field, F.lit(2)))
        return F.when(value.startswith('"'), F.trim(F.replace(F.regexp_replace(value, r'(?s)^"(.*)"[^"]*$', "$1"), F.lit('""'), F.lit('"')))).otherwise(value)

    return F.transform(raw, bare)


def guess_delimiters(records: DataFrame) -> DataFrame:
    """(file, delimiter): the one that cuts the first records of the file into the same number of fields, two or more.

    Among several the one with most fields is taken, then the one listed first; without any, the comma.
    """
    first = records.where(F.col("record") < GUESS_RECORDS)
    sizes = F.array(*[F.struct(F.size(split_fields(F.col("text"), F.lit(d))).alias("n"), F.lit(-i).alias("rank"), F.lit(d).alias("delimiter"))
                      for i, d in enumerate(DELIMITERS)])
    counted = first.select("file", F.explode(sizes).alias("x")).select("file", "x.*").groupBy("file", "rank", "delimiter").agg(
        F.min("n").alias("least"), F.max("n").alias("most"))
    fit = F.struct((F.col("least") > 1) & (F.col("least") == F.col("most")), F.when(F.col("most") > 1, F.col("least")).otherwise(0), "rank")
    return counted.groupBy("file").agg(F.max_by("delimiter", fit).alias("delimiter"))


def read_fields(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """file, record, header and fields of every record after the header of its file; without a delimiter it is guessed per file."""
    if delimiter is not None and delimiter not in DELIMITERS:
        raise ValueError(f"unknown delimiter: {delimiter!r}")
    records = materialize(read_records(spark, path), "records")
    delimiters = records.where("record = 0").select("file", F.lit(delimiter).alias("delimiter")) if delimiter else guess_delimiters(records)
    header = F.transform(split_fields(F.col("text"), F.col("delimiter")), lambda h: F.lower(h))
    heads = records.where("record = 0").join(delimiters, "file").select("file", "delimiter", header.alias("header"))
    rows = records.where("record > 0").join(heads, "file")
    return rows.select("file", "record", "header", split_fields(F.col("text"), F.col("delimiter")).alias("fields"))
