"""Imports whose parents may arrive after their children.

Children and parents are two streams.  A child whose parent is not there waits; it goes on when the parent arrives, in
whatever order and batch, and is given up when its time is over.  Time is event time: the newest arrival that either
stream has shown, so it stands still while nothing arrives.

What waits and which parents are known are tables under the checkpoint, a version for each batch, so that a batch that
is replayed starts from the same state.  New children are joined with all known parents, waiting ones with the new
parents only; the joins are Spark's own, which splits the children of a hot parent.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from keelrow.contract import TableContract
from keelrow.session import cut_lineage, scratch_scope
from keelrow.streaming.importing import BATCH, CORRUPT, batch_name, import_batch

FOUND = "parent_found"
# beside the columns of a child: what it refers to, when it arrived, whether the row announces a parent instead
_REF, _AT, _PARENT = "__ref", "__at", "__parent"
_KNOWN = T.StructType([T.StructField(_REF, T.StringType())])


def _both(children: DataFrame, parents: DataFrame, column: str, parent_column: str, arrived: str) -> DataFrame:
    """Children and announced parents as one stream."""
    kind = parents.schema[parent_column].dataType
    names = [c for c in children.columns if c != arrived]
    rows = children.select(
        *names, F.col(column).try_cast(kind).cast("string").alias(_REF), F.col(arrived).cast("timestamp").alias(_AT), F.lit(False).alias(_PARENT))
    return rows.unionByName(parents.filter(F.col(parent_column).isNotNull()).select(
        F.col(parent_column).cast("string").alias(_REF), F.col(arrived).cast("timestamp").alias(_AT), F.lit(True).alias(_PARENT)),
        allowMissingColumns=True)


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows there; none if nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _marked(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """Add ``FOUND``; each parent stands once.  A child that refers to nothing waits for nothing."""
    held = parents.withColumn(FOUND, F.lit(True))
    return rows.join(held, _REF, "left").withColumn(FOUND, F.col(FOUND).isNotNull() | F.col(_REF).isNull())


def _settle(batch: DataFrame, number: int, state: str, patience: str) -> tuple[DataFrame, DataFrame]:
    """The children that go on and those that are given up in a batch; the state after it is written.

    Parents of the batch come first, then its newest arrival is the time.
    """
    spark = batch.sparkSession
    fixed = cut_lineage(batch)
    shape = T.StructType([f for f in fixed.schema.fields if f.name != _PARENT])
    known = _read(spark, f"{state}/known", T.StructType([*_KNOWN.fields, T.StructField(BATCH, T.LongType())])).filter(
        F.col(BATCH) < number).select(_REF)
    fresh = fixed.filter(_PARENT).select(_REF).distinct().join(known, _REF, "left_anti")
    fresh.write.mode("overwrite").parquet(f"{state}/known/{BATCH}={number}")
    fresh = spark.read.schema(_KNOWN).parquet(f"{state}/known/{BATCH}={number}")
    waited = _read(spark, f"{state}/waiting/{number - 1}", shape)
    before = _read(spark, f"{state}/clock/{number - 1}", T.StructType([T.StructField(_AT, T.TimestampType())]))
    clock = fixed.select(_AT).unionByName(before).agg(F.max(_AT).alias(_AT))
    clock.write.mode("overwrite").parquet(f"{state}/clock/{number}")
    now = spark.read.schema(clock.schema).parquet(f"{state}/clock/{number}").select(F.col(_AT).alias("__now"))
    came = _marked(fixed.filter(~F.col(_PARENT)).select(*shape.names), known.unionByName(fresh))
    rows = came.unionByName(_marked(waited, fresh))
    # one row, so it may be broadcast
    over = F.col(_AT) + F.expr(f"interval {patience}") <= F.col("__now")
    rows = cut_lineage(rows.join(F.broadcast(now)).withColumn("__over", F.coalesce(over, F.lit(False))).select(*shape.names, FOUND, "__over"))
    rows.filter(~F.col(FOUND) & ~F.col("__over")).select(*shape.names).write.mode("overwrite").parquet(f"{state}/waiting/{number}")
    # the version before is kept for a replay of this batch
    for table in ("waiting", "clock"):
        _remove(spark, f"{state}/{table}/{number - 2}")
    names = [n for n in shape.names if n not in (_REF, _AT)]
    return rows.filter(FOUND).select(*names), rows.filter(~F.col(FOUND) & F.col("__over")).select(*names)


def stream_import_late_parents(children: DataFrame, parents: DataFrame, base: str, contract: TableContract, column: str,
                               parent_column: str, arrived: str = "arrived", patience: str = "1 hour",
                               others: Callable[[], Mapping[str, DataFrame]] | None = None) -> StreamingQuery:
    """Import what can be imported of everything that has arrived, and stop; run again for what comes later.

    As :func:`keelrow.streaming.importing.stream_import`, but ``column`` may refer to parents of the second stream that
    arrive later.  Both streams have a timestamp ``arrived``.  A child that is given up is set aside under
    ``foreign_key:<column>``.  ``others`` are the parents of other references.  All waiting children and the place in both
    streams are in the checkpoint.
    """
    base = base.rstrip("/")
    checkpoint = f"{base}/{contract.name}_checkpoint"
    known = contract.with_column(replace(contract.column(column), foreign_key=None))

    def each(batch: DataFrame, number: int) -> None:
        name = batch_name(batch, number)
        with scratch_scope(batch.sparkSession):
            rows, late = _settle(batch, number, f"{checkpoint}/late_parents", patience)
            import_batch(rows, name, f"{base}/{contract.name}", f"{base}/{contract.name}_rejects", f"{base}/{contract.name}_files",
                         known, others, once=False)
            texts = [c for c in rows.columns if c not in (CORRUPT, "source_file") and known.has(c)]
            late.select(
                *texts, F.array(F.lit(f"foreign_key:{column}")).alias("violations"), F.lit(None).cast("string").alias("record")
            ).write.mode("overwrite").parquet(f"{base}/{contract.name}_rejects/{BATCH}={name}-late")

    return _both(children, parents, column, parent_column, arrived).writeStream.foreachBatch(each).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
