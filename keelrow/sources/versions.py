"""Versions of a table as lists of Parquet files, so that a change rewrites the files it touches and keeps the rest.

A version is a folder with a list of files: one row for each, with its place in the table's order, its rows and bytes, and the
lowest and highest value of some columns.  Data files are written once, under folders of their own, and shared by all versions that
list them.  A version is complete when its list is written, so a run that breaks off leaves the one before as it was.
What reaches the driver is the names of the files to be read, as with any folder that Spark lists.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelrow.functions.values import constant
from keelrow.operators.numbering import range_sorted
from keelrow.session import cut_lineage

FILE = "__file"
_RANK = "__rank"
_FILES = "folder string, name string, position array<long>, n_rows long, n_bytes long"
_SETTINGS = "schema string, bounds array<string>, sorted_by array<string>"


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Version:
    """One state of a table.  ``bounds``: columns whose ranges are kept; ``order``: columns whose order the files follow."""

    spark: SparkSession
    path: str
    schema: T.StructType
    bounds: tuple[str, ...]
    order: tuple[str, ...]

    def files(self) -> DataFrame:
        """``folder, name, position, n_rows, n_bytes`` and a struct ``low_high`` of ``low_i, high_i`` for each bound."""
        return self.spark.read.schema(_files_schema(self.schema, self.bounds)).parquet(f"{self.path}/files")

    def rows(self, files: DataFrame | None = None, with_file: bool = False) -> DataFrame:
        """The rows of the whole version, or of some of its files; ``with_file`` adds the file's name as ``FILE``."""
        listed = [f"{r['folder']}/{r['name']}" for r in (self.files() if files is None else files).select("folder", "name").collect()]
        if not listed:
            empty = self.spark.createDataFrame([], self.schema)
            return empty.withColumn(FILE, F.lit("")) if with_file else empty
        df = self.spark.read.schema(self.schema).parquet(*listed)
        return df.select("*", F.col("_metadata.file_name").alias(FILE)) if with_file else df

    def count(self) -> int:
        return self.files().agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]

    def near(self, keys: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
        """The files that a key may be in: ``columns`` pairs a bound with a column of ``keys``, and the ranges must meet
        for one of the pairs.  One row of lowest and highest keys is read."""
        found = F.lit(False)
        for bound, column in columns:
            if bound not in self.bounds:
                return self.files()
            at, kind = self.bounds.index(bound), self.schema[bound].dataType
            low, high = keys.agg(F.min(_col(column).cast(kind)), F.max(_col(column).cast(kind))).first()
            if low is not None:
                low_high = F.col("low_high")
                found |= (low_high[f"high_{at}"] >= constant(low, kind)) & (low_high[f"low_{at}"] <= constant(high, kind))
        return self.files().filter(found)


def _files_schema(schema: T.StructType, bounds: Sequence[str]) -> T.StructType:
    ends = [T.StructField(f"{end}_{i}", schema[c].dataType) for i, c in enumerate(bounds) for end in ("low", "high")]
    # a struct without a field cannot be stored
    ends = ends or [T.StructField("none", T.BooleanType())]
    return T.StructType([*T.StructType.fromDDL(_FILES).fields, T.StructField("low_high", T.StructType(ends))])


def _described(spark: SparkSession, folder: str, schema: T.StructType, bounds: Sequence[str], base: DataFrame | None = None) -> DataFrame:
    """List the files of a folder: one aggregate over the bounds.  ``base`` gives the place of the files they replace."""
    read = T.StructType([*schema.fields, T.StructField(_RANK, T.LongType())]) if base is not None else schema
    rows = spark.read.schema(read).parquet(folder)
    keys = [F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("n_bytes")]
    keys.append(F.col(_RANK) if base is not None else F.lit(None).cast("long").alias(_RANK))
    ends = [f(_col(c)).alias(f"{end}_{i}") for i, c in enumerate(bounds) for end, f in (("low", F.min), ("high", F.max))]
    held = rows.select(*keys, *[_col(c) for c in bounds]).groupBy("name", "n_bytes", _RANK).agg(F.count(F.lit(1)).alias("n_rows"), *ends)
    # tasks number their files in the order of their ranges
    own = F.array(*[F.regexp_extract("name", p, 1).cast("long") for p in (r"^part-(\d+)", r"[-.]c(\d+)\.")])
    if base is None:
        held = held.withColumn("folder", F.lit(folder)).withColumn("position", own)
    else:
        held = held.join(base.select(_RANK, F.col("position").alias("before")), _RANK).withColumn(
            "folder", F.concat(F.lit(f"{folder}/{_RANK}="), F.col(_RANK))).withColumn("position", F.concat("before", own))
    low_high = F.struct(*[f"{end}_{i}" for i in range(len(bounds)) for end in ("low", "high")]) if bounds else F.struct(F.lit(None).cast("boolean").alias("none"))
    return held.select("folder", "name", "position", "n_rows", "n_bytes", low_high.alias("low_high"))


def _finished(spark: SparkSession, base: str, files: DataFrame, schema: T.StructType, bounds: Sequence[str], order: Sequence[str]) -> Version:
    path = f"{base}/version={uuid.uuid4().hex}"
    # a version has few files: its list is one file
    files.coalesce(1).write.parquet(f"{path}/files")
    spark.createDataFrame([(json.dumps(schema.jsonValue()), list(bounds), list(order))], _SETTINGS).coalesce(1).write.parquet(f"{path}/settings")
    return Version(spark, path, schema, tuple(bounds), tuple(order))


def create_version(df: DataFrame, base: str, order: Sequence[str] = (), bounds: Sequence[str] = (), n_files: int | None = None) -> Version:
    """Write all rows.  With ``order`` the files are range partitions in that order, each sorted; ``n_files`` at most."""
    spark, folder = df.sparkSession, f"{base}/data={uuid.uuid4().hex}"
    if order:
        df = range_sorted(df, order, partitions=n_files)
    elif n_files:
        df = df.repartition(n_files)
    df.write.parquet(folder)
    schema = _plain(df.schema)
    return _finished(spark, base, _described(spark, folder, schema, bounds), schema, bounds, order)


def _plain(schema: T.StructType) -> T.StructType:
    """Files hold no NOT NULL."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])


def open_version(spark: SparkSession, path: str) -> Version:
    settings = spark.read.schema(_SETTINGS).parquet(f"{path}/settings").first()
    schema = T.StructType.fromJson(json.loads(settings["schema"]))
    return Version(spark, path, schema, tuple(settings["bounds"]), tuple(settings["sorted_by"]))


def append_rows(version: Version, base: str, rows: DataFrame) -> Version:
    """A version with more files behind the others; the ones before are listed again, not written."""
    folder = f"{base}/data={uuid.uuid4().hex}"
    (range_sorted(rows, version.order) if version.order else rows).select(*map(_col, version.schema.names)).write.parquet(folder)
    last = version.files().agg(F.max("position")).first()[0] or [-1]
    added = _described(version.spark, folder, version.schema, version.bounds).withColumn(
        "position", F.concat(F.array(F.lit(last[0] + 1).cast("long")), "position"))
    # appended files overlap the others, so the whole is in order only if nothing was there
    order = version.order if last == [-1] else ()
    return _finished(version.spark, base, version.files().unionByName(added), version.schema, version.bounds, order)


def rewrite_files(version: Version, base: str, touched: DataFrame, change, keeps_order: bool = True) -> Version:
    """A version in which ``touched``, some of its files, are replaced by ``change`` of their rows.

    ``change`` takes and returns rows with ``FILE``.  The new files of an old one take its place.
    """
    spark, folder = version.spark, f"{base}/data={uuid.uuid4().hex}"
    ranked = cut_lineage(touched.select("name", "position").withColumn(_RANK, F.xxhash64("name")))
    new = change(version.rows(touched, with_file=True)).withColumn(_RANK, F.xxhash64(FILE)).drop(FILE)
    keys = [_RANK, *version.order]
    new.repartition(_RANK).sortWithinPartitions(*map(_col, keys)).select(*map(_col, version.schema.names), _RANK).write.partitionBy(_RANK).parquet(folder)
    kept = version.files().join(ranked.select("name"), "name", "left_anti")
    kept = kept.unionByName(_described(spark, folder, version.schema, version.bounds, ranked))
    return _finished(spark, base, kept, version.schema, version.bounds, version.order if keeps_order else ())


def holding(version: Version, near: DataFrame, keys: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Those of the ``near`` files that hold a key: only the key columns of those files are read.

    ``columns`` pairs columns of the rows with columns of ``keys``; all must be equal.
    """
    rows = version.rows(near, with_file=True).select(FILE, *[_col(c) for c, _ in columns])
    wanted = keys.select(*[_col(k).alias(c) for c, k in columns])
    names = rows.join(wanted, [c for c, _ in columns], "left_semi").select(F.col(FILE).alias("name")).distinct()
    return cut_lineage(near.join(names, "name", "left_semi"))


def either(*files: DataFrame) -> DataFrame:
    """Files that are in one of the lists, each once."""
    return reduce(DataFrame.unionByName, files).dropDuplicates(["name"])
