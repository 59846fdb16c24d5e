"""References read off the data: which columns hold only values of which other columns.

Every column (or combination of columns) that is asked about is an *attribute*.  One inverted index answers for all pairs at
once: each value points to the set of attributes that hold it, as bits.  The values of all tables meet in a single
shuffle, reduced to one row per value and attribute set within the tasks; how many values have the same
attribute set is all that is left then.  An attribute is included in another if no set has it without the other.

Combinations are searched level by level: a combination of k columns is tried only if all its parts of
k - 1 columns are included in the corresponding parts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelrow.session import cut_lineage

# bits of a long that are used, and characters of a value that stand for themselves
_BITS, _PLAIN = 62, 64
_PAIR = "child_table string, child_columns array<string>, parent_table string, parent_columns array<string>"


@dataclass(frozen=True)
class Attribute:
    table: str
    columns: tuple[str, ...]


def family(dtype: T.DataType) -> str | None:
    """Columns are comparable within a family; nested types with none."""
    if isinstance(dtype, T.IntegralType):
        return "integral"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return None
    return dtype.typeName()


def value_text(column: Column, dtype: T.DataType) -> Column:
    """Equal values of one family, and only those, have the same text."""
    if isinstance(dtype, T.DecimalType):
        text = column.cast("string")
        return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        # 0.0 and -0.0 are equal
        return F.when(column == 0, F.lit("0.0")).otherwise(column.cast("string"))
    if isinstance(dtype, T.BinaryType):
        return F.hex(column)
    return column.cast("string")


def _key(values: Sequence[Column]) -> Column:
    """One text for one or more values; a long one is digested, so that no text is moved whole."""
    if len(values) == 1:
        whole = values[0]
    else:
        # lengths keep the parts apart
        whole = F.concat(*[part for v in values for part in (F.char_length(v).cast("string"), F.lit(":"), v)])
    return F.when(F.char_length(whole) >= _PLAIN, F.sha2(whole, 256)).otherwise(whole)


def attribute_sets(tables: Mapping[str, DataFrame], attributes: Sequence[Attribute]) -> DataFrame:
    """``bits, n_values``: how many values are held by exactly the attributes whose bits are set.

    ``bits`` is an array of longs.  Values with a null part are left out.  There is one shuffle of values, for all tables
    together.
    """
    words = -(-len(attributes) // _BITS)
    families: dict[str, int] = {}
    parts = []
    for table in dict.fromkeys(a.table for a in attributes):
        df = tables[table]
        entries = []
        for i, a in enumerate(attributes):
            if a.table == table:
                kind = ",".join(family(df.schema[c].dataType) or "" for c in a.columns)
                value = _key([value_text(F.col(f"`{c}`"), df.schema[c].dataType) for c in a.columns])
                entries.append(F.struct(
                    F.lit(i).alias("i"), F.lit(families.setdefault(kind, len(families))).alias("family"), value.alias("value")))
        parts.append(df.select(F.inline(F.array(*entries))).filter("value IS NOT NULL"))
    held = reduce(DataFrame.unionByName, parts).groupBy("family", "value").agg(*[
        F.bit_or(F.expr(f"CASE WHEN i div {_BITS} = {w} THEN shiftleft(1L, i % {_BITS}) ELSE 0L END")).alias(f"m{w}") for w in range(words)])
    return held.groupBy(F.array(*[f"m{w}" for w in range(words)]).alias("bits")).agg(F.count(F.lit(1)).alias("n_values"))


def _tested(tables: Mapping[str, DataFrame], pairs: Sequence[tuple[Attribute, Attribute]]) -> DataFrame:
    """For each pair: values of the child, how many of them the parent lacks, and the verdict."""
    attributes = list(dict.fromkeys(a for pair in pairs for a in pair))
    at = {a: i for i, a in enumerate(attributes)}
    # few rows: one for each set of attributes that some value has
    sets = cut_lineage(attribute_sets(tables, attributes))
    listed = sets.sparkSession.createDataFrame(
        [(at[c], at[p], c.table, list(c.columns), p.table, list(p.columns)) for c, p in pairs], "child int, parent int, " + _PAIR)

    def has(which: str) -> Column:
        return F.expr(f"(shiftright(element_at(bits, int({which} div {_BITS}) + 1), {which} % {_BITS}) & 1) = 1")

    members = sets.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(attributes) - 1))).alias("child")).filter(has("child"))
    counts = members.join(listed.select("child", "parent"), "child").groupBy("child", "parent").agg(
        F.sum("n_values").alias("n_values"), F.sum(F.when(has("parent"), 0).otherwise(F.col("n_values"))).alias("n_missing"))
    # a pair whose child has no value still has a row
    zero = F.lit(0).cast("long")
    return listed.join(counts, ["child", "parent"], "left").withColumns({
        "n_values": F.coalesce("n_values", zero), "n_missing": F.coalesce("n_missing", zero)}).withColumn(
        "included", (F.col("n_missing") == 0) & (F.col("n_values") > 0)).drop("child", "parent")


def _known(tables: Mapping[str, DataFrame], parents: Mapping[str, Sequence[Sequence[str]]] | None) -> dict[str, list[str]]:
    """The columns of each table that may be referred to."""
    if parents is None:
        return {t: [f.name for f in df.schema.fields if family(f.dataType)] for t, df in tables.items()}
    return {t: list(dict.fromkeys(c for key in keys for c in key)) for t, keys in parents.items()}


def unary_pairs(
    tables: Mapping[str, DataFrame], parents: Mapping[str, Sequence[Sequence[str]]] | None = None,
) -> list[tuple[Attribute, Attribute]]:
    """Every column against every comparable other one; with ``parents`` only against their columns."""
    pairs = []
    for parent, keys in _known(tables, parents).items():
        for key in keys:
            wanted = family(tables[parent].schema[key].dataType)
            pairs += [
                (Attribute(child, (f.name,)), Attribute(parent, (key,)))
                for child, df in tables.items() for f in df.schema.fields
                if wanted and family(f.dataType) == wanted and (child, f.name) != (parent, key)]
    return pairs


def discover_inclusions(
    tables: Mapping[str, DataFrame], parents: Mapping[str, Sequence[Sequence[str]]] | None = None,
    pairs: Sequence[tuple[Attribute, Attribute]] | None = None,
) -> DataFrame:
    """One row for each pair of comparable columns: distinct values of the child, those the parent lacks, the verdict.

    ``parents`` names the keys of each table that may be referred to (default: every column).  A column without values
    is included nowhere.
    """
    pairs = unary_pairs(tables, parents) if pairs is None else pairs
    if not pairs:
        raise ValueError("no pair of columns is comparable")
    return _tested(tables, pairs).select(
        "child_table", F.element_at("child_columns", 1).alias("child_column"), "parent_table",
        F.element_at("parent_columns", 1).alias("parent_column"), "n_values", "n_missing", "included")


def _joined_pairs(included: set, width: int, whole: Mapping[str, Sequence[Sequence[str]]] | None) -> list[tuple[Attribute, Attribute]]:
    """Pairs of combinations of ``width`` columns all of whose smaller parts are included.

    The child's columns are in ascending order, each once; so are the parent's, in any order.
    """
    by_tables: dict[tuple[str, str], set] = {}
    for child, parent in included:
        by_tables.setdefault((child.table, parent.table), set()).add(tuple(zip(child.columns, parent.columns)))
    pairs = []
    for (child, parent), known in sorted(by_tables.items()):
        singles = sorted({m for mapping in known for m in mapping})
        allowed = None if whole is None else [set(k) for k in whole.get(parent, ()) if len(k) >= width]
        for mapping in combinations(singles, width):
            left, right = [m[0] for m in mapping], [m[1] for m in mapping]
            if len(set(left)) < width or len(set(right)) < width:
                continue
            if allowed is not None and not any(set(right) <= key for key in allowed):
                continue
            if all(part in known for part in combinations(mapping, width - 1)):
                pairs.append((Attribute(child, tuple(left)), Attribute(parent, tuple(right))))
    return pairs


def discover_composite_inclusions(
    tables: Mapping[str, DataFrame], parents: Mapping[str, Sequence[Sequence[str]]] | None = None, max_width: int = 3,
) -> DataFrame:
    """Included combinations of two and more columns: ``child_table, child_columns, parent_table, parent_columns, width,
    n_values``, columns paired by position and comma-joined.

    A row with a null part refers to nothing.  A combination counts only if each of its columns is included by itself.
    With ``parents`` only combinations within one of their keys are looked for.  One shuffle of values a level; what
    the driver sees is one row for each included pair.
    """
    tested = _tested(tables, unary_pairs(tables, parents)) if unary_pairs(tables, parents) else None
    spark = next(iter(tables.values())).sparkSession
    found = [spark.createDataFrame([], _PAIR + ", n_values long")]
    width = 1
    while tested is not None:
        kept = cut_lineage(tested.filter("included").drop("n_missing", "included"))
        if width > 1:
            found.append(kept)
        included = {
            (Attribute(r["child_table"], tuple(r["child_columns"])), Attribute(r["parent_table"], tuple(r["parent_columns"])))
            for r in kept.collect()}
        width += 1
        pairs = _joined_pairs(included, width, parents) if width <= max_width else []
        tested = _tested(tables, pairs) if pairs else None
    return reduce(DataFrame.unionByName, found).select(
        "child_table", F.array_join("child_columns", ",").alias("child_columns"), "parent_table",
        F.array_join("parent_columns", ",").alias("parent_columns"), F.size("child_columns").alias("width"), "n_values")
