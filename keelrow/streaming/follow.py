"""New log rows as they are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelrow import fixed_values as fv
from keelrow.plans.ledger import LOG_SCHEMA


def follow_log(spark: SparkSession, base: str, levels: tuple[str, ...] = ()) -> DataFrame:
    """Stream of the log's files; every row once, also after a restart from a checkpoint."""
    rows = spark.readStream.schema(LOG_SCHEMA).parquet(f"{base.rstrip('/')}/{fv.LOG_TABLE}")
    return rows.filter(F.col("level").isin(*levels)) if levels else rows
