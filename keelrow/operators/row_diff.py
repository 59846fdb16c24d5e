"""Comparing two versions of a table row by row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelrow.session import cut_lineage


def row_digest(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Two 64-bit hashes of the named values.

    The hash skips NULLs, so a mask of them is hashed as well; nested values go in as text,
    which keeps their shape.
    """
    parts, masks = [], []
    for f in df.select(*columns).schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c, {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
                              "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
        parts.append(c)
        masks.append(F.when(F.col(f.name).isNull(), F.lit("1")).otherwise(F.lit("0")))
    mask = F.concat(*masks) if masks else F.lit("")
    return [F.xxhash64(F.lit(seed), mask, *parts).alias(f"__d{seed}") for seed in (1, 2)]


def _same_key(keys: Sequence[str], renamed: str) -> Column:
    """Keys are equal, NULL parts included."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{renamed}{i}")) for i, k in enumerate(keys)])


def changed_keys(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose rows are not the same on both sides, told by digests.

    Only keys and 128 bits per row are shuffled, after equal rows of a task were combined.  Two
    different rows of one key pass for equal with a chance of 2 to the power of -128.
    """
    values = [c for c in old.columns if c not in keys]
    both = old.select(*keys, *row_digest(old, values), F.lit(-1).alias("__n")).union(
        new.select(*keys, *row_digest(new, values), F.lit(1).alias("__n")))
    left_over = both.groupBy(*keys, "__d1", "__d2").agg(F.sum("__n").alias("__n")).filter("__n <> 0")
    return left_over.select(*keys).distinct()


def diff_rows(old: DataFrame, new: DataFrame, keys: Sequence[str], prefilter: bool = True) -> DataFrame:
    """Rows added, dropped or modified between two versions.

    Result: the key columns, ``change`` (ADD, DROP, MODIFY or AMBIGUOUS), ``changed`` (names of
    the columns that differ) and ``n_rows``.

    First the keys that changed are found from digests and written out (``prefilter``); where
    few rows changed, no wide row is shuffled.  The rows of these keys are compared exactly:
    equal rows cancel out in one aggregate that is combined before the shuffle, so copies of a
    row, however many, travel as one, and what is left is compared by key.  A key that still
    has several different rows on one side cannot be paired; its rows are summed up as AMBIGUOUS.
    """
    keys = list(keys)
    values = [c for c in old.columns if c not in keys]
    if sorted(old.columns) != sorted(new.columns):
        raise ValueError("both versions need the same columns")
    new = new.select(*old.columns)
    if prefilter:
        found = cut_lineage(changed_keys(old, new, keys)).toDF(*[f"__k{i}" for i in range(len(keys))])
        old, new = (df.join(found, _same_key(keys, "__k"), "left_semi") for df in (old, new))
    both = old.withColumn("__n", F.lit(-1)).unionByName(new.withColumn("__n", F.lit(1)))
    left_over = both.groupBy(*old.columns).agg(F.sum("__n").alias("__n")).filter("__n <> 0")

    def first(side_is_new: bool, c: str):
        return F.max(F.when((F.col("__n") > 0) == side_is_new, F.struct(F.col(c))))

    grouped = left_over.groupBy(*keys).agg(
        F.count_if(F.col("__n") < 0).alias("old_kinds"), F.count_if(F.col("__n") > 0).alias("new_kinds"),
        F.sum(F.abs("__n")).alias("n_rows"),
        *[first(False, c).alias(f"old_{i}") for i, c in enumerate(values)],
        *[first(True, c).alias(f"new_{i}") for i, c in enumerate(values)],
    )
    single = (F.col("old_kinds") == 1) & (F.col("new_kinds") == 1) & (F.col("n_rows") == 2)
    change = (
        F.when((F.col("old_kinds") == 0) & (F.col("n_rows") == 1), F.lit("ADD"))
        .when((F.col("new_kinds") == 0) & (F.col("n_rows") == 1), F.lit("DROP"))
        .when(single, F.lit("MODIFY"))
        .otherwise(F.lit("AMBIGUOUS"))
    )
    differing = F.array_compact(F.array(*[
        F.when(~F.col(f"old_{i}")[c].eqNullSafe(F.col(f"new_{i}")[c]), F.lit(c)) for i, c in enumerate(values)
    ])) if values else F.array().cast("array<string>")
    return grouped.select(
        *keys, change.alias("change"),
        F.when(change == "MODIFY", differing).otherwise(F.array().cast("array<string>")).alias("changed"),
        "n_rows",
    )


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n_rows").alias("n_rows"))
