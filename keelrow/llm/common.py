"""What the operators of this folder share: carrying a table's own columns past an operator, and
Arrow columns as Python bytes.

Operators see only an id and a text; every other column travels in one struct, so extra columns can
have any name.  A column that an operator adds replaces one of that name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ID, TEXT, ROW = "__id", "__text", "__row"
# stands for a missing id wherever ids are compared: it comes after all others
LAST_ID = (1 << 63) - 1

Batches = Iterable[pa.RecordBatch]


def carried(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text and all columns but the text in one struct."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias(ID), F.col(f"`{text_col}`").cast("string").alias(TEXT),
        F.struct(*rest).alias(ROW),
    )


def uncarried(df: DataFrame, docs: DataFrame, text_col: str, text: Column, added: dict[str, Column]) -> DataFrame:
    """The columns of ``docs`` with the given text, then the added ones."""
    own = [
        (text if c == text_col else F.col(ROW).getField(c)).alias(c) for c in docs.columns if c not in added
    ]
    return df.select(*own, *(value.alias(name) for name, value in added.items()))


def with_row(rows: DataFrame, more: str) -> StructType:
    """The struct of a table's own columns, whatever their names, and further columns."""
    return StructType([rows.schema[ROW], *StructType.fromDDL(more).fields])


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    return [value or b"" for value in column.cast(pa.large_binary()).to_pylist()]


def longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def in_pieces(columns: dict[str, pa.Array], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """One batch cut into slices, so that no single message to the JVM is large."""
    batch = pa.RecordBatch.from_pydict(columns)
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
