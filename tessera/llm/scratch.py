"""Intermediate tables in the folder that the cluster shares, so that lost executors cost a reread and no lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The shared folder; only where none is set and all runs in one process (as in tests) one of our own."""
    there = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not there:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError(f"{_SETTING} names no folder that the executors share")
        there = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set(_SETTING, there)
    return there.rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: its lineage ends there. Gone when the driver ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    # What was shuffled for a table that is written is of no more use.
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _made:
        try:
            drop(spark, path)
        except Exception:  # noqa: S112  the session may have ended first; another's table may still go
            continue
