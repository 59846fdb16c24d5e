"""Reading a contract off the data: column profiles, key candidates, references."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelrow.contract import pg_type
from keelrow.functions.types import parse_value
from keelrow.operators import inclusion
from keelrow.operators.checks import duplicate_keys, key_counts

# Types that text columns are tried against, narrowest first.
_CAST_TARGETS = ("bigint", "double precision", "boolean", "date", "timestamp")


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
    """One row per column: rows, nulls, distinct values, range, longest text, suggested rules.

    The default is one aggregate over one scan with approximate distinct counts.  ``exact``
    counts the distinct values of each column by its own two-step aggregate instead, which
    reads every column once more but never expands rows.
    """
    names = list(columns or df.columns)
    held = {f.name: f.dataType for f in df.schema.fields}
    measures = [F.count(F.lit(1)).alias("n_rows")]
    for i, name in enumerate(names):
        c, dtype = F.col(name), held[name]
        measures.append(F.count(c).alias(f"filled{i}"))
        if not exact:
            measures.append(F.approx_count_distinct(c).alias(f"distinct{i}"))
        ordered = not isinstance(dtype, (T.MapType, T.VariantType))
        measures.append((F.min(c).cast("string") if ordered else F.lit(None).cast("string")).alias(f"low{i}"))
        measures.append((F.max(c).cast("string") if ordered else F.lit(None).cast("string")).alias(f"high{i}"))
        if isinstance(dtype, T.StringType):
            measures.append(F.max(F.length(c)).cast("long").alias(f"longest{i}"))
            for target in _CAST_TARGETS:
                measures.append(F.count(parse_value(c, target)).alias(f"as_{_slug(target)}{i}"))
    row = df.agg(*measures)

    def described(i: int, name: str):
        dtype = held[name]
        filled = F.col(f"filled{i}")
        if isinstance(dtype, T.StringType):
            suggestion = F.lit("text")
            for target in reversed(_CAST_TARGETS):
                fits = (filled > 0) & (F.col(f"as_{_slug(target)}{i}") == filled)
                suggestion = F.when(fits, F.lit(target)).otherwise(suggestion)
            longest = F.col(f"longest{i}")
        else:
            suggestion, longest = F.lit(pg_type(dtype)), F.lit(None).cast("long")
        return F.struct(
            F.lit(name).alias("column"), F.lit(i).alias("position"), F.lit(pg_type(dtype)).alias("held_type"),
            suggestion.alias("suggested_type"), F.col("n_rows"),
            (F.col("n_rows") - filled).alias("n_nulls"),
            (F.lit(None).cast("long") if exact else F.col(f"distinct{i}")).alias("n_distinct"),
            F.col(f"low{i}").alias("min_value"), F.col(f"high{i}").alias("max_value"),
            longest.alias("max_length"),
        )

    profile = row.select(F.inline(F.array(*[described(i, n) for i, n in enumerate(names)])))
    if exact:
        distinct = reduce(DataFrame.unionByName, [
            key_counts(df, [n]).agg(F.count(F.lit(1)).alias("exact_distinct")).withColumn("column", F.lit(n))
            for n in names
        ])
        profile = profile.join(distinct, "column").withColumn("n_distinct", F.col("exact_distinct"))
        profile = profile.drop("exact_distinct")
    unique = (F.col("n_distinct") == F.col("n_rows") - F.col("n_nulls")) & (F.col("n_distinct") > 0)
    return profile.withColumn("nullable", F.col("n_nulls") > 0).withColumn(
        "unique_candidate", unique if exact else F.lit(None).cast("boolean")
    ).withColumn("key_candidate", F.col("unique_candidate") & ~F.col("nullable"))


def _slug(name: str) -> str:
    return name.replace(" ", "_")


def key_candidates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """For every column whether its filled values are all different, counted exactly.

    A column without values is no candidate.
    """
    estimate = profile_columns(df, columns)
    close = list(columns or df.columns)
    checked = [
        duplicate_keys(df, [c]).agg(F.count(F.lit(1)).alias("n_duplicate_values")).withColumn("column", F.lit(c))
        for c in close
    ]
    none = df.sparkSession.createDataFrame([], "n_duplicate_values long, column string")
    found = reduce(DataFrame.unionByName, checked, none)
    return estimate.select("column", "held_type", "n_rows", "n_nulls").join(found, "column").withColumn(
        "unique_candidate", (F.col("n_duplicate_values") == 0) & (F.col("n_rows") > F.col("n_nulls"))
    ).withColumn("key_candidate", F.col("unique_candidate") & (F.col("n_nulls") == 0))


def discover_references(tables: Mapping[str, DataFrame], keys: Mapping[str, str], same_name: bool = False) -> DataFrame:
    """Inclusion of every comparable column in each key: distinct values, values without a parent, verdict.

    With ``same_name`` only columns of the key's name after the prefix.  See :mod:`keelrow.operators.inclusion`: the
    values of all tables meet in one shuffle, whatever the number of pairs.
    """
    pairs = inclusion.unary_pairs(tables, {table: [(key,)] for table, key in keys.items()})
    if same_name:
        pairs = [(c, p) for c, p in pairs if c.columns[0].split("_", 1)[-1] == p.columns[0].split("_", 1)[-1]]
    return inclusion.discover_inclusions(tables, pairs=pairs)
