"""Importing files as they arrive.

Each micro-batch is a batch import in quarantine mode: accepted rows and rejected rows go to
folders named by the stream and its batch number, which are replaced as a whole.  A batch that is
replayed after a failure therefore writes the same folders again instead of adding rows twice.

A file is imported once, by its name: what an earlier batch has read is left out, also by a stream that
starts anew after its checkpoint was lost.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from keelrow.contract import TableContract
from keelrow.operators import changes
from keelrow.session import cut_lineage
from keelrow.sources.csv_files import CORRUPT, OPTIONS, check_columns, csv_schema

BATCH = "batch"
# keys of an object that are no column of the stream
UNKNOWN = "_unknown_keys"
_FILE_ROWS = T.StructType([T.StructField("source_file", T.StringType()), T.StructField("n_rows", T.LongType())])


def arriving_csv(spark: SparkSession, folder: str, contract: TableContract, columns: Sequence[str],
                 multi_line: bool = True, files_per_batch: int = 1000) -> DataFrame:
    """Stream of text rows with the file each came from; the columns are those of the header."""
    check_columns(columns, contract)
    return (
        spark.readStream.schema(csv_schema(columns)).options(**OPTIONS).option("header", True)
        .option("multiLine", multi_line).option("enforceSchema", False).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT).option("maxFilesPerTrigger", files_per_batch)
        .csv(folder).withColumn("source_file", F.col("_metadata.file_name"))
    )


def arriving_json(spark: SparkSession, folder: str, contract: TableContract, columns: Sequence[str],
                  files_per_batch: int = 1000) -> DataFrame:
    """Stream of JSON Lines as text rows; objects with other keys than ``columns`` are marked and will be rejected."""
    check_columns(columns, contract)
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", "map<string,string>").alias("m"),
                          F.col("_metadata.file_name").alias("source_file"))
    foreign = F.coalesce(
        F.array_sort(F.array_except(F.map_keys("m"), F.array(*map(F.lit, columns)))), F.array().cast("array<string>"))
    return parsed.select(
        *[F.try_element_at("m", F.lit(c)).alias(c) for c in columns],
        F.when(F.col("m").isNull() | (F.size(foreign) > 0), F.col("value")).alias(CORRUPT), foreign.alias(UNKNOWN), "source_file",
    )


def import_batch(rows: DataFrame, number: int | str, target_path: str, reject_path: str, file_path: str,
                 contract: TableContract, parents: Callable[[], Mapping[str, DataFrame]] | None = None, once: bool = True) -> None:
    """Validate one micro-batch against what is there and write both outcomes and the list of files.

    ``once``: rows of files that another batch has listed are left out; not where the rows of a file come in parts.
    """
    spark = rows.sparkSession
    new = rows
    if once:
        seen = _rows_of_others(spark, file_path, _FILE_ROWS, number).select("source_file").distinct()
        new = rows.join(seen, "source_file", "left_anti").select(*rows.columns)
    fixed = cut_lineage(new)
    columns = [c for c in fixed.columns if c not in (CORRUPT, UNKNOWN, "source_file")]
    # rows written by an earlier try of this batch do not count as there
    target = _rows_before(spark, target_path, contract, number)
    known = parents() if parents else {}
    good = fixed.filter(F.col(CORRUPT).isNull())
    next_ids = {c.name: changes.next_id(target, c.name)
                for c in contract.columns if c.serial and c.name not in columns}
    done = changes.insert(target, good.select(*columns), contract, known, "quarantine", next_ids)
    reasons = F.array(F.lit("malformed"))
    if UNKNOWN in fixed.columns:
        named = F.transform(UNKNOWN, lambda k: F.concat(F.lit("unknown_key:"), k))
        reasons = F.when(F.size(UNKNOWN) > 0, named).otherwise(reasons)
    malformed = fixed.filter(F.col(CORRUPT).isNotNull()).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in done.rejected.schema.fields if f.name != "violations"],
        reasons.alias("violations"), F.col(CORRUPT).alias("record"),
    )
    rejected = done.rejected.withColumn("record", F.lit(None).cast("string")).unionByName(malformed)
    done.accepted.write.mode("overwrite").parquet(f"{target_path}/{BATCH}={number}")
    rejected.write.mode("overwrite").parquet(f"{reject_path}/{BATCH}={number}")
    fixed.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_rows")).write.mode("overwrite").parquet(
        f"{file_path}/{BATCH}={number}")


def _rows_before(spark: SparkSession, path: str, contract: TableContract, number: int | str) -> DataFrame:
    """Imported rows of all other batches; none before the first."""
    return _rows_of_others(spark, path, T.StructType([T.StructField(f.name, f.dataType) for f in contract.struct().fields]), number)


def _rows_of_others(spark: SparkSession, path: str, schema: T.StructType, number: int | str) -> DataFrame:
    try:
        rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.StringType())])).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return rows.filter(F.col(BATCH) != str(number)).drop(BATCH)


def batch_name(batch: DataFrame, number: int) -> str:
    """The stream and the number: a stream that starts anew counts from 0 again, but has another name."""
    stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{stream}-{number}" if stream else str(number)


def stream_import(rows: DataFrame, base: str, contract: TableContract,
                  parents: Callable[[], Mapping[str, DataFrame]] | None = None) -> StreamingQuery:
    """Import everything that has arrived and stop; run again for what comes later.

    ``parents`` is called per batch, so references are checked against current parent rows.
    """
    base = base.rstrip("/")

    def each(batch: DataFrame, number: int) -> None:
        import_batch(batch, batch_name(batch, number), f"{base}/{contract.name}", f"{base}/{contract.name}_rejects",
                     f"{base}/{contract.name}_files", contract, parents)

    return rows.writeStream.foreachBatch(each).option(
        "checkpointLocation", f"{base}/{contract.name}_checkpoint"
    ).trigger(availableNow=True).start()
