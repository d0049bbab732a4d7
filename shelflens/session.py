"""Session defaults and the few cluster-facing helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}
# State beyond executor memory, with changelog checkpoints: given to the session that runs keyed state, when it is built.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_JOB = "spark.shelflens.job"


def build_session(app_name: str = "shelflens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; on a cluster the master and sizes come from spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; only an unset local session gets its own folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before cutting lineage on a cluster")
        folder = tempfile.mkdtemp(prefix="run-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def job_folder(spark: SparkSession) -> str:
    """The folder of the current job inside the shared one; it lasts until :func:`end_job`."""
    job = spark.conf.get(_JOB, None)
    if not job:
        job = uuid.uuid4().hex
        spark.conf.set(_JOB, job)
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/shelflens-{job}"


def end_job(spark: SparkSession) -> None:
    """Deletes what the job has written to the shared folder. Frames that read it must have been stored or collected before."""
    if spark.conf.get(_JOB, None):
        path = spark._jvm.org.apache.hadoop.fs.Path(job_folder(spark))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        spark.conf.unset(_JOB)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame that several branches read to the shared folder and reads it back.

    It is computed once, survives lost executors, and its size on disk tells the optimizer how to join it.
    """
    path = f"{job_folder(df.sparkSession)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
