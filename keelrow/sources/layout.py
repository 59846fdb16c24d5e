"""Writing tables so that later reads skip data or avoid shuffles."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelrow.contract import Index, TableContract
from keelrow.operators.numbering import range_sorted


def new_version(base: str, table: str, run_id: str | None = None) -> str:
    """A path no reader uses yet."""
    return f"{base}/{table}/run={run_id or uuid.uuid4().hex}"


def write_version(df: DataFrame, path: str) -> DataFrame:
    """Write rows once and read them back; an existing path is an error, never overwritten."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_clustered(df: DataFrame, path: str, columns: Sequence[str]) -> DataFrame:
    """Range-clustered files: a filter on the columns skips most row groups."""
    return write_version(range_sorted(df, columns), path)


def _measure(column: Column, dtype: T.DataType) -> Column:
    """A number in the order of the values; of a text its first characters."""
    if isinstance(dtype, T.StringType):
        head = F.rpad(F.substring(F.hex(column), 1, 12), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp")).cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return (column.cast("int") if isinstance(dtype, T.BooleanType) else column).cast("double")
    raise ValueError(f"columns of type {dtype.simpleString()} have no place on a curve")


def _at_most(measure: Column):
    return lambda cut: cut <= measure


def curve_place(df: DataFrame, columns: Sequence[str], bits: int = 6) -> Column:
    """The place of a row on a curve through all columns alike (bits of their ranks, interleaved).

    The ranks are counted among 2^bits quantiles of each column, which one aggregate estimates; nulls have the first.
    """
    shares = [i / 2**bits for i in range(1, 2**bits)]
    measures = [_measure(F.col(c), df.schema[c].dataType) for c in columns]
    bounds = df.agg(*[F.percentile_approx(m, shares, 1_000).alias(f"q{i}") for i, m in enumerate(measures)]).first()
    place = F.lit(0).cast("long")
    for i, m in enumerate(measures):
        cuts = sorted(set(bounds[i] or []))
        rank = F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), _at_most(m))), F.lit(0)) if cuts else F.lit(0)
        for bit in range(bits):
            place = place + F.shiftleft(F.shiftright(rank, bit).bitwiseAND(F.lit(1)).cast("long"), bit * len(columns) + i)
    return place


def write_zordered(df: DataFrame, path: str, columns: Sequence[str], partitions: int | None = None, bits: int = 6) -> DataFrame:
    """Files that are narrow in every one of the columns: a filter on any of them skips most files and row groups.

    A file is a whole cell of the curve (its leading bits), as many cells as partitions; a cell with more than twice its
    share of the rows is dealt over several files.  Only the sizes of the cells reach the driver.
    """
    files = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leading = min(max(files - 1, 1).bit_length(), bits * len(columns))
    placed = df.withColumn("__place", curve_place(df, columns, bits)).withColumn(
        "__cell", F.shiftright("__place", bits * len(columns) - leading))
    sizes = {r["__cell"]: r["count"] for r in placed.groupBy("__cell").count().collect()}
    share = max(1, 2 * sum(sizes.values()) // max(1, len(sizes)))
    parts = {cell: -(-n // share) for cell, n in sizes.items() if n > share}
    split = F.lit(1)
    for cell, n in sorted(parts.items()):
        split = F.when(F.col("__cell") == cell, n).otherwise(split)
    dealt = placed.withColumn("__part", F.monotonically_increasing_id() % split)
    keys = ["__cell", "__part"]
    ranged = dealt.repartitionByRange(max(1, len(sizes) + sum(parts.values()) - len(parts)), *keys).sortWithinPartitions(*keys, "__place")
    return write_version(ranged.drop(*keys, "__place"), path)


def write_bucketed(df: DataFrame, table: str, columns: Sequence[str], buckets: int, path: str | None = None) -> DataFrame:
    """Bucketed table: joins and aggregates on the columns need no shuffle.  ``path``: where its files lie."""
    writer = df.write.bucketBy(buckets, *columns).sortBy(*columns).mode("errorifexists")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def write_indexed(df: DataFrame, path: str, index: Index) -> DataFrame:
    """The layout that stands for an index: several columns of a btree serve alike, none before the others.

    Hash methods need a table name, see write_bucketed; gin ones lie beside a version, see
    :func:`keelrow.operators.file_index.build_trigrams`.
    """
    if index.method != "btree":
        raise ValueError(f"index method {index.method!r} is a table layout; use write_bucketed or build_trigrams")
    if len(index.columns) == 1 or index.unique:
        return write_clustered(df, path, index.columns)
    return write_zordered(df, path, index.columns)


def create_table(spark: SparkSession, path: str, contract: TableContract) -> DataFrame:
    """A typed, empty table."""
    return write_version(spark.createDataFrame([], contract.struct()), path)


def publish(spark: SparkSession, table: str, path: str) -> None:
    """Point a catalog table at a version; readers of the old one are not disturbed."""
    name = ".".join(f"`{p}`" for p in table.split("."))
    location = path.replace("'", "\\'")
    if spark.catalog.tableExists(table):
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{location}'")
        spark.catalog.refreshTable(table)
    else:
        spark.catalog.createTable(table, path=path, source="parquet")
