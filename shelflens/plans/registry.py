"""Query registry: each entry is a job over the driver tables, most with an independent SQL statement to check it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def wide(self, name: str) -> DataFrame:
        """A table for work that is heavy per row. It is read as its files are cut.

        A caller whose files hold a single row group each can ask for ``spark.shelflens.textPartitions`` pieces.
        """
        rows = getattr(self, name)
        pieces = int(self.spark.conf.get("spark.shelflens.textPartitions", "0"))
        return rows.repartition(pieces) if pieces else rows

    @cached_property
    def domain(self):
        from shelflens.plans.domain import Domain
        return Domain(self)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query: {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register
