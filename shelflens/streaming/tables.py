"""A keyed table kept by a stream: folders of buckets, versioned by batch, with a manifest per batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def _numbers(spark: SparkSession, base: str, kind: str) -> list[int]:
    """The versions for which ``base`` has a folder of this kind."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [f.getPath().getName() for f in files.listStatus(path)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}="))


def _manifest(spark: SparkSession, base: str, up_to: int | None = None) -> dict[int, int]:
    """Bucket -> version of the newest manifest (of batch ``up_to`` at most): one small row per bucket."""
    known = [v for v in _numbers(spark, base, "manifest") if up_to is None or v <= up_to]
    return {r.bucket: r.version for r in spark.read.parquet(f"{base}/manifest={known[-1]}").collect()} if known else {}


def _bucket_rows(spark: SparkSession, base: str, versions: dict[int, int], schema: StructType | None = None) -> DataFrame | None:
    paths = [f"{base}/version={v}/bucket={b}" for b, v in sorted(versions.items())]
    if not paths:
        return None
    reader = spark.read.option("basePath", base)
    return (reader.schema(schema) if schema is not None else reader).parquet(*paths).drop("version")


def _drop_versions(spark: SparkSession, base: str, batch_id: int, keep: int) -> None:
    manifests = [v for v in _numbers(spark, base, "manifest") if v <= batch_id]
    kept = manifests[-keep:]
    named = {(b, v) for m in kept for b, v in _manifest(spark, base, m).items()}
    folder = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
    files = folder("").getFileSystem(spark._jsc.hadoopConfiguration())
    for old in manifests[:-keep]:
        files.delete(folder(f"manifest={old}"), True)
    for version in _numbers(spark, base, "version"):
        if version < batch_id:
            for bucket in _numbers(spark, f"{base}/version={version}", "bucket"):
                if (bucket, version) not in named:
                    files.delete(folder(f"version={version}/bucket={bucket}"), True)


ROWS_PER_FILE = 500_000


@dataclass(frozen=True)
class BucketTable:
    """One row per key in ``buckets`` folders.

    ``buckets`` comes from the expected size of the table (a bucket should fit a few tasks); ``files_per_bucket`` splits the
    writing of each, into more files when more than about ``ROWS_PER_FILE`` rows may come to one. A batch rewrites only the buckets it touches, into its own version folder, and then writes a manifest:
    the version each bucket is at. Readers open the newest manifest and just the folders it names. A batch that is run again
    writes the same folder and manifest once more. Bucket folders that none of the last ``keep_versions`` manifests names are
    deleted.
    """

    base: str
    keys: list[str]
    buckets: int
    files_per_bucket: int = 1
    keep_versions: int = 3

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of bucketed rows: at most ``buckets`` numbers."""
        return sorted(r.bucket for r in rows.select("bucket").distinct().collect())

    def before(self, spark: SparkSession, batch_id: int, touched: list[int], schema: StructType) -> DataFrame:
        """The rows of some buckets as they were before a batch."""
        versions = _manifest(spark, self.base, batch_id - 1)
        rows = _bucket_rows(spark, self.base, {b: versions[b] for b in touched if b in versions}, schema)
        return rows.select(*schema.names) if rows is not None else spark.createDataFrame([], schema).limit(0)  # known to be empty: nothing moves for joins

    def write(self, batch_id: int, rows: DataFrame, touched: list[int], sources: tuple[DataFrame, ...] = ()) -> None:
        """Bucketed ``rows`` as the new content of the touched buckets; there are no more of them than in the written ``sources``."""
        spark = rows.sparkSession
        most = sum(source.count() for source in sources)
        files = max(self.files_per_bucket, -(-most // (ROWS_PER_FILE * max(1, len(touched)))))
        spread = F.pmod(F.xxhash64(*self.keys, F.lit("file")), F.lit(files))
        (rows.repartition(max(1, len(touched) * files), "bucket", spread).write.mode("overwrite")
         .partitionBy("bucket").parquet(f"{self.base}/version={batch_id}"))
        now = {**_manifest(spark, self.base, batch_id - 1), **{b: batch_id for b in touched}}
        spark.createDataFrame(sorted(now.items()), "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(
            f"{self.base}/manifest={batch_id}")
        _drop_versions(spark, self.base, batch_id, self.keep_versions)

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The rows of the newest manifest, or None while there is none."""
        return _bucket_rows(spark, self.base, _manifest(spark, self.base))
