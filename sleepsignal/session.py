"""Spark session with the settings the library is tuned for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "sleepsignal", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution; pass ``master`` for local runs only."""
    b = SparkSession.builder.appName(app)
    if master is not None:
        b = b.master(master).config("spark.ui.enabled", "false")
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only where none is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="sleepsignal-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


_stages: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Write a stage that several later steps read as Parquet in the shared folder, and read it back."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/stage-{uuid.uuid4().hex}"
    _stages.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def run_folder(spark: SparkSession, kind: str) -> str:
    """A folder of one run's files in the shared folder, deleted with the stages."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _stages.append(path)
    return path


def discard_stages(spark: SparkSession) -> int:
    """Delete the stage tables and run folders this process has written, at the end of a run; nothing may read them any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _stages:
        path = hadoop.Path(_stages.pop())
        n += path.getFileSystem(conf).delete(path, True)
    return n
