"""INSERT dumps: one statement per row and line."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelrow.contract import TableContract
from keelrow.functions.text import read_literal, render_literal
from keelrow.operators import changes
from keelrow.operators.numbering import range_sorted
from keelrow.session import cut_lineage
from keelrow.sources.csv_files import Batch, check_columns, insert_batch


def insert_statement(df: DataFrame, table: str) -> Column:
    """The INSERT of each row."""
    names = ", ".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    values = F.concat_ws(", ", *[render_literal(F.col(f.name), f.dataType) for f in df.schema.fields])
    return F.concat(F.lit(f"INSERT INTO {table} ({names}) VALUES ("), values, F.lit(");"))


def render_inserts(df: DataFrame, table: str) -> DataFrame:
    return df.select(insert_statement(df, table).alias("statement"))


def export_sql(df: DataFrame, path: str, table: str) -> None:
    render_inserts(range_sorted(df, df.columns[:1]), table).write.text(path)


def _literals(values: Column) -> Column:
    """Split a VALUES list.

    Between quotes the pieces of a split by quote are literal text, outside they hold the
    separators (a doubled quote leaves an empty piece outside).  A line has no line break, so
    one can stand for the separators that count.
    """
    pieces = F.transform(
        F.split(values, "'"),
        lambda piece, i: F.when(i % 2 == 0, F.replace(piece, F.lit(", "), F.lit("\n"))).otherwise(piece),
    )
    return F.split(F.array_join(pieces, "'"), "\n")


def read_dump(spark: SparkSession, path: str, contract: TableContract) -> Batch:
    """Text rows of a dump; lines that are no INSERT into the table are set aside."""
    head = f"INSERT INTO {contract.name} ("
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith("--"))
    names = F.split(F.substring_index(F.substring_index("value", ") VALUES (", 1), "(", -1), ", ")
    start = F.locate(") VALUES (", F.col("value")) + len(") VALUES (")
    body = F.substring(F.col("value"), start, F.length("value") - start - 1)
    valid = F.col("value").startswith(head) & F.col("value").endswith(");") & F.col("value").contains(") VALUES (")
    parsed = lines.select(
        F.col("value").alias("record"),
        F.when(valid, F.transform(names, lambda n: F.replace(F.trim(n, F.lit('"')), F.lit('""'), F.lit('"')))).alias("names"),
        F.when(valid, _literals(body)).alias("literals"),
    )
    fits = F.coalesce(F.size("names") == F.size("literals"), F.lit(False))
    parsed = cut_lineage(parsed.withColumn("fits", fits))
    # column lists are few, whatever the number of statements
    lists = parsed.filter("fits").select("names").distinct().collect()
    present = sorted({n for r in lists for n in r["names"]}, key=lambda n: contract.names.index(n) if contract.has(n) else -1)
    check_columns(present, contract)
    good = parsed.filter("fits").withColumn("m", F.map_from_arrays("names", "literals"))
    return Batch(
        good.select(*[read_literal(F.try_element_at("m", F.lit(n))).alias(n) for n in present]),
        parsed.filter("NOT fits").select("record"),
    )


def import_sql(spark: SparkSession, path: str, target: DataFrame, contract: TableContract,
               parents: Mapping[str, DataFrame] | None = None, mode: str = "strict") -> changes.Insert:
    return insert_batch(read_dump(spark, path, contract), target, contract, parents, mode)
