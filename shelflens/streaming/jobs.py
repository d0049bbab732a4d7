"""Structured Streaming jobs over price observations and source runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from shelflens.functions import text as tx
from shelflens.operators.price_history import newest_per_key
from shelflens.session import materialize
from shelflens.streaming.tables import BucketTable


def read_observations(spark: SparkSession, path: str, schema: StructType, max_files: int = 1000,
                      pattern: str = "*") -> DataFrame:
    """X1 source: a folder of Parquet files, a bounded number per trigger."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files)
            .parquet(path))


def normalize_observations(observations: DataFrame) -> DataFrame:
    """The same row expressions as the batch jobs."""
    return (observations.withColumn("title", tx.title_norm(F.col("title")))
            .withColumn("barcode", tx.barcode_norm(F.col("barcode")))
            .withColumn("size_text", tx.size_text_norm(F.col("size_text")))
            .withColumn("payload_hash", tx.payload_fingerprint(
                F.col("source_product_id"), F.col("price_minor"), F.col("title"))))


def dedup_observations(observations: DataFrame, keys: list[str], at: str = "observed_at", delay: str = "1 day") -> DataFrame:
    """Re-delivered rows go, as long as they come within the watermark delay."""
    return observations.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def price_rollup_stream(observations: DataFrame, size: str = "1 day", slide: str | None = None,
                        delay: str = "1 day") -> DataFrame:
    """Price roll-up per product, store and event-time window; rows later than the watermark are dropped."""
    window = F.window("observed_at", size, slide) if slide else F.window("observed_at", size)
    return (observations.withWatermark("observed_at", delay).groupBy("product_id", "store_id", window)
            .agg(F.count("*").alias("observations"), F.min("price_minor").alias("min_price_minor"),
                 F.max("price_minor").alias("max_price_minor")))


def run_rollup_stream(runs: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Runs and failures per source and window."""
    window = F.window("started_at", size, slide) if slide else F.window("started_at", size)
    return (runs.withWatermark("started_at", delay).groupBy("source_id", window)
            .agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failed")))


def enrich_stream(observations: DataFrame, catalog: DataFrame) -> DataFrame:
    """Stream joined to the catalogue by barcode; a barcode of several products matches none."""
    unique = (catalog.where(F.col("is_active") & F.col("external_sku").isNotNull())
              .groupBy(F.col("external_sku").alias("barcode"))
              .agg(F.count("*").alias("_n"), F.min("product_id").alias("product_id")).where("_n = 1").drop("_n"))
    return observations.join(unique, "barcode", "left")


def append_parquet(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> StreamingQuery:
    """Everything there is, then stop; run again to go on from the checkpoint."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.start()


def maintain_latest(stream: DataFrame, base: str, checkpoint: str, keys: list[str], order: list[str],
                    buckets: int, files_per_bucket: int = 1, keep_versions: int = 3) -> StreamingQuery:
    """Latest price per key, kept as a :class:`BucketTable` with one version per batch."""
    table = BucketTable(base, keys, buckets, files_per_bucket, keep_versions)

    def merge(batch: DataFrame, batch_id: int) -> None:
        fresh = materialize(table.bucketed(newest_per_key(batch, keys, order)), "fresh")
        touched = table.touched(fresh)
        if touched:
            old = table.before(batch.sparkSession, batch_id, touched, fresh.schema)
            table.write(batch_id, newest_per_key(fresh.unionByName(old), ["bucket", *keys], order), touched, (fresh, old))

    return (stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_latest(spark: SparkSession, base: str) -> DataFrame | None:
    """The rows of the newest manifest, or None while there is none."""
    return BucketTable(base, [], 0).read(spark)
