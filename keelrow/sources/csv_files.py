"""CSV files: import with validation, ordered export."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelrow.contract import TableContract
from keelrow.operators import changes
from keelrow.operators.numbering import range_sorted
from keelrow.session import cut_lineage, scratch_scope, shuffles_removed
from keelrow.sources.split_records import csv_records

CORRUPT = "_corrupt_record"
# The CSV form that is read and written.
OPTIONS = {"quote": '"', "escape": '"', "sep": ",", "encoding": "UTF-8",
           "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


@dataclass(frozen=True)
class Batch:
    rows: DataFrame         # text columns named by the file
    malformed: DataFrame    # records that could not be read, as text


def check_columns(names: Sequence[str], contract: TableContract) -> None:
    unknown = [n for n in names if not contract.has(n)]
    if unknown:
        raise ValueError(f"columns not found in table {contract.name}: {', '.join(unknown)}")
    repeated = sorted({n for n in names if list(names).count(n) > 1})
    if repeated:
        raise ValueError(f"columns occur more than once: {', '.join(repeated)}")


def csv_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])


def _texts(names: Sequence[str], empty: str | None) -> list[Column]:
    """The columns; where the reader was told to put ``empty`` for a quoted empty field, that is the empty text."""
    held = [F.col(f"`{n}`") for n in names]
    return held if empty is None else [F.when(c == empty, "").otherwise(c).alias(n) for n, c in zip(names, held)]


def read_csv(spark: SparkSession, path: str, contract: TableContract, multi_line: bool = True, split: bool = False,
             empty_text: bool = False) -> Batch:
    """Text rows of CSV files that share one header.

    Empty fields are NULL, with ``empty_text`` only those without quotes; blank lines are skipped, records with a wrong
    number of fields are set aside.  ``multi_line`` reads line breaks inside quotes; such files are read whole by
    one task each, unless ``split`` finds the records first, for files of any size.
    """
    reader = spark.read.options(**OPTIONS).option("header", True).option("multiLine", multi_line)
    names = reader.option("inferSchema", False).csv(path).columns
    check_columns(names, contract)
    # a text of its own for quoted empty fields, which no file can hold
    empty = f"\x01{uuid.uuid4().hex}" if empty_text else None
    if split and multi_line:
        return _read_split(spark, path, names, empty)
    reader = reader if empty is None else reader.option("emptyValue", empty)
    raw = (
        reader.schema(csv_schema(names)).option("enforceSchema", False).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    )
    # all columns must be parsed for the field count to be checked, so the rows are written once
    parsed = cut_lineage(raw)
    return Batch(parsed.filter(F.col(CORRUPT).isNull()).select(*_texts(names, empty)),
                 parsed.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("record")))


def _read_split(spark: SparkSession, path: str, names: Sequence[str], empty: str | None) -> Batch:
    schema = ", ".join(f"`{n}` string" for n in [*names, CORRUPT])
    options = {**OPTIONS, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    options |= {} if empty is None else {"emptyValue": empty}
    header = F.array(*map(F.lit, names))
    # what the records were put together from is not needed any more once they are parsed
    with scratch_scope(spark), shuffles_removed(spark):
        records = csv_records(spark, path)
        parsed = cut_lineage(records.select("first", F.from_csv("record", schema, options).alias("r")), outlive=True)
    other = parsed.filter("first").filter(~F.array(*[F.col(f"r.`{n}`") for n in names]).eqNullSafe(header))
    if not other.isEmpty():
        raise ValueError("the files do not share one header")
    rows = parsed.filter("NOT first").select("r.*")
    return Batch(rows.filter(F.col(CORRUPT).isNull()).select(*_texts(names, empty)),
                 rows.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("record")))


def import_csv(spark: SparkSession, path: str, target: DataFrame, contract: TableContract,
               parents: Mapping[str, DataFrame] | None = None, mode: str = "strict",
               multi_line: bool = True, split: bool = False, empty_text: bool = False) -> changes.Insert:
    """Validate CSV files and append their rows.  ``strict`` refuses all for one bad record."""
    batch = read_csv(spark, path, contract, multi_line, split, empty_text)
    return insert_batch(batch, target, contract, parents, mode)


def insert_batch(batch: Batch, target: DataFrame, contract: TableContract,
                 parents: Mapping[str, DataFrame] | None, mode: str) -> changes.Insert:
    if batch.rows.isEmpty() and batch.malformed.isEmpty():
        raise ValueError("the file must have at least one data row")
    if mode == "strict":
        broken = batch.malformed.count()
        if broken:
            raise changes.Refused(f"batch for {contract.name} refused", {"malformed": broken})
    next_ids = {
        c.name: changes.next_id(target, c.name)
        for c in contract.columns if c.serial and c.name not in batch.rows.columns
    }
    done = changes.insert(target, batch.rows, contract, parents, mode, next_ids)
    if mode == "strict":
        return done
    # malformed records join the rejected rows, under a rule of their own
    lost = batch.malformed.select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in done.rejected.schema.fields if f.name != "violations"],
        F.array(F.lit("malformed")).alias("violations"), "record",
    )
    rejected = done.rejected.withColumn("record", F.lit(None).cast("string")).unionByName(lost)
    return changes.Insert(done.rows, done.accepted, rejected)


def export_csv(df: DataFrame, path: str, order: Sequence[str] | None = None, max_records: int = 0, empty_text: bool = False) -> None:
    """Write CSV with a header, ordered by the first column unless told otherwise.

    The order runs through the files by name.  Fields are quoted when they hold a comma, a
    quote or a line break; NULL is empty, and so is the empty text unless ``empty_text`` puts it in quotes.
    """
    texts = [
        F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        else F.lower(F.hex(F.col(f.name))).alias(f.name) if isinstance(f.dataType, T.BinaryType)
        else F.col(f.name)
        for f in df.schema.fields
    ]
    ordered = range_sorted(df, list(order or df.columns[:1]))
    writer = ordered.select(*texts).write.options(**OPTIONS).option("header", True).option(
        "emptyValue", '""' if empty_text else "")
    with shuffles_removed(df.sparkSession):
        writer.option("timestampFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]XXX").option(
            "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
        ).option("maxRecordsPerFile", max_records).csv(path)
