"""Renamed columns, told from the values of two versions of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelrow.operators.inclusion import family, value_text
from keelrow.session import cut_lineage

# digests kept of each column
SKETCH = 256
_PAIR = "old_column string, new_column string"


def value_sketch(df: DataFrame, column: str, size: int = SKETCH) -> DataFrame:
    """The smallest digests of a column's distinct values: each task sends ``size`` at most to the top-k."""
    text = value_text(F.col(f"`{column}`"), df.schema[column].dataType)
    return df.select(F.md5(text).alias("digest")).filter("digest IS NOT NULL").distinct().orderBy("digest").limit(size)


def rename_similarities(old: DataFrame, new: DataFrame, size: int = SKETCH) -> DataFrame:
    """``old_column, new_column, similarity`` for every column that is gone and comparable one that is new.

    The similarity is the share of common values among all of both, estimated from the ``size`` smallest digests of both
    together (exact if there are no more values).
    """
    spark = old.sparkSession
    gone, come = [c for c in old.columns if c not in new.columns], [c for c in new.columns if c not in old.columns]
    pairs = [
        (o, n) for o in gone for n in come
        if family(old.schema[o].dataType) and family(old.schema[o].dataType) == family(new.schema[n].dataType)]
    if not pairs:
        return spark.createDataFrame([], _PAIR + ", similarity double")

    def sketches(df: DataFrame, names: list[str], side: str) -> DataFrame:
        parts = [value_sketch(df, c, size).select(F.lit(c).alias(f"{side}_column"), "digest") for c in names]
        return cut_lineage(reduce(DataFrame.unionByName, parts))

    listed = spark.createDataFrame(pairs, _PAIR)
    sides = [
        listed.join(sketches(df, sorted({p[i] for p in pairs}), side), f"{side}_column").select(
            "old_column", "new_column", "digest", F.lit(side).alias("side"))
        for i, (df, side) in enumerate(((old, "old"), (new, "new")))]
    key = ["old_column", "new_column"]
    met = sides[0].unionByName(sides[1]).groupBy(*key, "digest").agg(F.count_distinct("side").alias("n_sides"))
    smallest = F.row_number().over(Window.partitionBy(*key).orderBy("digest"))     # two sketches at most
    return met.withColumn("place", smallest).filter(F.col("place") <= size).groupBy(*key).agg(
        (F.count_if(F.col("n_sides") == 2) / F.count(F.lit(1))).alias("similarity"))


def rename_by_data(old: DataFrame, new: DataFrame, minimum: float = 0.5, size: int = SKETCH) -> DataFrame:
    """Which columns were renamed: the most similar pairs, each column in one pair, none below ``minimum``.

    A suggestion only, as :func:`keelrow.operators.catalog_diff.rename_suggestions`, but it tells several renames in one table apart.
    Equal similarities go by name.
    """
    found = rename_similarities(old, new, size).filter(F.col("similarity") >= minimum).collect()    # pairs of columns
    taken, chosen = set(), []
    for r in sorted(found, key=lambda r: (-r["similarity"], r["old_column"], r["new_column"])):
        ends = {("old", r["old_column"]), ("new", r["new_column"])}
        if not ends & taken:
            taken |= ends
            chosen.append((r["old_column"], r["new_column"], r["similarity"]))
    return old.sparkSession.createDataFrame(chosen, _PAIR + ", similarity double")
