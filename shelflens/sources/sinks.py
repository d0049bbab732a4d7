"""Sinks and files: idempotent run writes, versioned tables, photo files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

FILES_PER_FOLDER = 16


def write_run(df: DataFrame, path: str) -> None:
    """Writing a run again replaces that run only. A run's rows are brought together, so it gets a few files."""
    spread = F.pmod(F.xxhash64(*[c for c in df.columns if c != "run_id"][:4]), F.lit(FILES_PER_FOLDER))
    (df.repartition("run_id", spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path))


def write_prices(df: DataFrame, path: str) -> None:
    """Price facts by observation day, so time filters prune folders."""
    spread = F.pmod(F.xxhash64("product_id"), F.lit(FILES_PER_FOLDER))
    (df.withColumn("observed_date", F.to_date("observed_at")).repartition("observed_date", spread).write.mode("append")
     .partitionBy("observed_date").parquet(path))


def write_version(df: DataFrame, base: str, version: str) -> str:
    """A dimension goes to a new folder; readers switch when it is complete. Nothing is read and overwritten at once."""
    target = f"{base.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(target)
    return target


def write_documents(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Rows (session, JSON document) in a fixed number of folders by the session's hash; an export replaces the last one."""
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int")
    (df.select("session_id", "document", bucket.alias("bucket")).repartition("bucket", "session_id").write.mode("overwrite")
     .option("partitionOverwriteMode", "static").partitionBy("bucket").json(path))


def read_photos(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Photo files with their content hash; the bytes themselves are not kept."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


def dedup_photos(photos: DataFrame) -> DataFrame:
    """The first photo per session and content hash."""
    keep = [c for c in photos.columns if c not in ("session_id", "sha256")]
    return photos.groupBy("session_id", "sha256").agg(F.min(F.struct(*keep)).alias("_p")).select(
        "session_id", "sha256", "_p.*")
