"""Dense row numbers and deep pages without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelrow.session import pin_partitions

_TIE, _PART, _OFFSET = "__tie", "__part", "__offset"


def range_sorted(df: DataFrame, order: Sequence[str], descending: bool = False, partitions: int | None = None) -> DataFrame:
    """Rows in global order: range partitions (as many as asked for, or as Spark finds fit), each sorted.

    A running number breaks ties, so rows that share their order key (or are exact copies)
    may be spread over many partitions.
    """
    tied = df.withColumn(_TIE, F.monotonically_increasing_id())
    keys = [F.col(c).desc() if descending else F.col(c).asc() for c in order] + [F.col(_TIE).asc()]
    dealt = tied.repartitionByRange(partitions, *keys) if partitions else tied.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys).drop(_TIE)


def numbered_partitions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fix the rows in place; return them with their partition, and each partition's first number."""
    fixed = pin_partitions(df).withColumn(_PART, F.spark_partition_id())
    sizes = fixed.groupBy(_PART).agg(F.count(F.lit(1)).alias("n"))
    # one row per partition of the input, so a single task is enough here
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn(_OFFSET, F.coalesce(F.sum("n").over(before), F.lit(0)))
    return fixed, offsets


def _row_in_partition() -> Column:
    # the lower 33 bits count the rows of the partition
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def dense_numbers(df: DataFrame, name: str, order: Sequence[str] = (), start: int = 1) -> DataFrame:
    """Add gap-free numbers from ``start``, in the given order if there is one."""
    fixed, offsets = numbered_partitions(range_sorted(df, order) if order else df)
    local = fixed.withColumn(name, _row_in_partition())
    # the offsets have one row per partition of the input, so they may be broadcast
    return (
        local.join(F.broadcast(offsets.select(_PART, _OFFSET)), _PART)
        .withColumn(name, F.col(name) + F.col(_OFFSET) + F.lit(start).cast("long"))
        .drop(_PART, _OFFSET)
    )
