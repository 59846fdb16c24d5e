"""JSON files: import with validation, export."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelrow.contract import TableContract
from keelrow.operators import changes
from keelrow.operators.numbering import range_sorted
from keelrow.session import cut_lineage
from keelrow.sources.csv_files import Batch, insert_batch
from keelrow.sources.split_records import json_records


def read_objects(spark: SparkSession, path: str, array_files: bool = False) -> DataFrame:
    """One row per object: ``fields`` (NULL if it is not an object) and its ``record`` text.

    JSON Lines split into many tasks; so do files that are one array, of any size (see :func:`json_records`).
    """
    if array_files:
        records = json_records(spark, path)
        return records.select(F.from_json("record", "map<string,string>").alias("fields"), "record")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", "map<string,string>").alias("fields"), F.col("value").alias("record"))


def unknown_keys(objects: DataFrame, contract: TableContract) -> DataFrame:
    """Keys that are no column of the table, with the number of objects that have them."""
    known = F.array(*[F.lit(n) for n in contract.names])
    return objects.select(F.explode(F.array_except(F.map_keys("fields"), known)).alias("key")).groupBy("key").agg(
        F.count(F.lit(1)).alias("n_objects")
    )


def read_json(spark: SparkSession, path: str, contract: TableContract, array_files: bool = False) -> Batch:
    """Text rows of JSON objects.

    The columns are those that any object has, not only the first; a key that is missing from
    an object is NULL, a column that no object has gets its default on insert.  Objects with
    unknown keys refuse the import; the message names twenty and counts the rest, :func:`unknown_keys` lists all.
    """
    objects = cut_lineage(read_objects(spark, path, array_files))
    foreign = unknown_keys(objects, contract)
    unknown = sorted(r["key"] for r in foreign.orderBy("key").limit(20).collect())
    if unknown:
        rest = foreign.count() - len(unknown)
        more = f" and {rest} more" if rest else ""
        raise ValueError(f"columns not found in table {contract.name}: {', '.join(unknown)}{more}")
    seen = objects.agg(*[
        F.coalesce(F.bool_or(F.map_contains_key("fields", n)), F.lit(False)).alias(n) for n in contract.names
    ]).first()
    present = [n for n in contract.names if seen[n]]
    good = objects.filter(F.col("fields").isNotNull())
    return Batch(
        good.select(*[F.try_element_at("fields", F.lit(n)).alias(n) for n in present]),
        objects.filter(F.col("fields").isNull()).select("record"),
    )


def import_json(spark: SparkSession, path: str, target: DataFrame, contract: TableContract,
                parents: Mapping[str, DataFrame] | None = None, mode: str = "strict",
                array_files: bool = False) -> changes.Insert:
    return insert_batch(read_json(spark, path, contract, array_files), target, contract, parents, mode)


def export_json(df: DataFrame, path: str) -> None:
    """One object per line, in the order of the first column; NULL values are kept."""
    range_sorted(df, df.columns[:1]).write.option("ignoreNullFields", False).json(path)
