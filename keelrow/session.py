"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# What the jobs rely on.  Broadcasts stay with Spark's own size check
# (spark.sql.autoBroadcastJoinThreshold); hot keys with AQE's split of skewed partitions.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

# an option of Spark 4.1
_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# paths of the scopes that are open, the innermost last
_scopes: list[list[str]] = []


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RECOMMENDED_CONF.items():
        spark.conf.set(key, value)
    return spark


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="keelrow-checkpoint-")
    context.setCheckpointDir(shared)


def pin_partitions(df: DataFrame) -> DataFrame:
    """Checkpoint the rows: later jobs see the same rows in the same partitions, also after
    executors are lost."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str, outlive: bool = False) -> str:
    """A new path under the shared checkpoint folder; with ``outlive`` it belongs to the scope around the innermost one."""
    _ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/keelrow/{name}-{uuid.uuid4().hex}"
    owners = _scopes[:-1] if outlive else _scopes
    if owners:
        owners[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what was written under scratch paths inside.

    Results are lazy and read those paths, so write or collect them inside the scope.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries inside remove their shuffle files when they end, not when the driver happens to collect its garbage.

    For queries that write their rows: what is executed again would have to be shuffled again.
    """
    before = spark.conf.get(_REMOVE_SHUFFLES, None)
    spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_REMOVE_SHUFFLES) if before is None else spark.conf.set(_REMOVE_SHUFFLES, before)


def cut_lineage(df: DataFrame, outlive: bool = False) -> DataFrame:
    """Write the rows as parquet under the shared checkpoint folder and read them back.

    Unlike a checkpoint the result has its true size, so Spark can decide on broadcasts, and
    it can be read by column.  :func:`scratch_scope` removes it (with ``outlive`` the scope around
    the innermost one does); without one the folder is the caller's to clean, like any checkpoint folder.

    Key sets that rows are joined with go through here when they come from an aggregate: Spark
    splits a skewed partition of the rows only if the other side of the join is a plain scan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "rows", outlive)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
