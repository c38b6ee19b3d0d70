"""Session settings that the engine's semantics rely on, and tables in the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {"spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
ROOT = str(Path(__file__).resolve().parents[1])
_own: list[str] = []


def session(**more: str) -> SparkSession:
    """The active session or a new one, with the engine's settings."""
    spark = SparkSession.builder.config(map=SETTINGS | more).getOrCreate()
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it isn't installed."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode
    (tests, one machine); on a cluster that is an error, as executors couldn't see each other's files."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="framewright-"))
        spark.sparkContext.setCheckpointDir(_own[0])
    return _own[0]


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """df written to the shared folder and read again. What hangs on row order or partition numbers is fixed then: a
    lost executor's tasks can't number rows anew. `stored_at` is where."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
