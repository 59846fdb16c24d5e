"""Keys of several columns read off the data.

The minimal combinations of columns whose values never repeat are found level by level.  A combination is looked at only
if none of its parts is unique.  Most are refuted without counting:

* by agree sets: two rows that agree on some columns refute every combination of those.  The pairs come from the
  stripped partitions of the single columns (values held by more than one row), two rows of each value;
* by numbers: a combination whose columns have fewer combined values than there are rows must repeat;
* in large tables, in place of both, by evidence: all rows of some values of each column.  What repeats there repeats.

What is left of a level is looked for repeats in passes, each over the values whose hash falls into its share, so that no
pass shuffles more than a set number of rows.  A value that repeats refutes its combination, which later passes leave out; a
combination is unique once all passes have found nothing, so every row has counted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelrow.operators.inclusion import family, value_text
from keelrow.session import cut_lineage, shuffles_removed

# largest agree sets that reach the driver; fewer refute less but change no result
_AGREE_SETS = 2_000
# rows that a pass shuffles, and rows up to which a table is counted as a whole
_SHUFFLED, _SMALL = 1 << 25, 1 << 21
# rows of evidence a column, and values up to which columns share it; fewer refute less but change no result
_SHOWN, _FEW = 1 << 17, 10_000
# their values are as short as a digest
_SHORT = (T.IntegralType, T.DoubleType, T.FloatType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
_RESULT = "columns string, width int, n_rows long, n_nulls long, key_candidate boolean"


def _digests(values: Sequence[Column]) -> Column:
    """128 bits of the values, null if one of them is."""
    filled = reduce(lambda a, b: a & b, [v.isNotNull() for v in values])
    return F.when(filled, F.struct(F.xxhash64(*values).alias("a"), F.xxhash64(F.lit(1), *reversed(list(values))).alias("b")))


def _expanded(held: DataFrame, groups: Sequence[tuple[int, ...]], more: Sequence[Column] = ()) -> DataFrame:
    """Each row once for each group of columns: the group's number and the digest of its values."""
    entries = [F.struct(F.lit(i).alias("g"), _digests([F.col(f"v{c}") for c in group]).alias("d")) for i, group in enumerate(groups)]
    return held.select(*more, F.explode(F.array(*entries)).alias("e")).filter("e.d IS NOT NULL").select("e.g", "e.d", *more)


def _values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Digests stand for long values, so that no text is carried on."""
    return df.select(*[_value(F.col(f"`{c}`"), df.schema[c].dataType).alias(f"v{i}") for i, c in enumerate(columns)])


def _value(column: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        # 0.0 and -0.0 are equal
        return F.when(column == 0, F.lit(0).cast(dtype)).otherwise(column)
    return column if isinstance(dtype, _SHORT) else _digests([value_text(column, dtype)])


def _counted(held: DataFrame, groups: Sequence[tuple[int, ...]]) -> list[tuple[int, int]]:
    """Distinct values and complete rows of each group of columns."""
    values = _expanded(held, groups).groupBy("g", "d").agg(F.count(F.lit(1)).alias("n"))
    rows = values.groupBy("g").agg(F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("n_rows")).collect()
    found = {r["g"]: (r["n_values"], r["n_rows"]) for r in rows}
    return [found.get(i, (0, 0)) for i in range(len(groups))]


def _filled(group: Sequence[int]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"v{c}").isNotNull() for c in group])


def _complete(held: DataFrame, groups: Sequence[tuple[int, ...]], n_rows: int, filled: frozenset[int]) -> list[int]:
    """Complete rows of each group of columns; those of ``filled`` have no null."""
    asked = [g for g in groups if not set(g) <= filled]
    found = dict(zip(asked, held.agg(*[F.count_if(_filled(g)).alias(f"n{i}") for i, g in enumerate(asked)]).first())) if asked else {}
    return [found.get(g, n_rows) for g in groups]


def _hash(group: Sequence[int]) -> Column:
    return F.xxhash64(*[F.col(f"v{c}") for c in group])


def _hashed(held: DataFrame, shown: Mapping[tuple[int, ...], Column]) -> DataFrame:
    """``g, h``: the number of each group and the hash of its values, for the complete rows that it is shown."""
    entries = [
        F.when(_filled(g) & where, F.struct(F.lit(i).alias("g"), _hash(g).alias("h"))) for i, (g, where) in enumerate(shown.items())]
    return held.select(F.explode(F.array(*entries)).alias("e")).filter("e IS NOT NULL").select("e.g", "e.h")


def _repeats(held: DataFrame, shown: Mapping[tuple[int, ...], Column]) -> set[tuple[int, ...]]:
    """The groups with a value in more than one of the rows they are shown.

    Rows with one hash are compared by 128 bits; should they differ, all rows of that group are.
    """
    groups = list(shown)
    with shuffles_removed(held.sparkSession):
        found = _hashed(held, shown).groupBy("g", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").groupBy("g").agg(
            F.min("h").alias("h")).collect()
        same = {groups[r["g"]]: r["h"] for r in found}
        if not same:
            return set()
        listed = list(same)
        entries = [F.when(_filled(g) & shown[g] & (_hash(g) == same[g]), F.struct(
            F.lit(i).alias("g"), _digests([F.col(f"v{c}") for c in g]).alias("d"))) for i, g in enumerate(listed)]
        sure = held.select(F.explode(F.array(*entries)).alias("e")).filter("e IS NOT NULL").groupBy("e.g", "e.d").agg(
            F.count(F.lit(1)).alias("n")).filter("n > 1").select("g").distinct().collect()
        repeated = {listed[r["g"]] for r in sure}
        for g in [g for g in listed if g not in repeated]:
            values, rows = _counted(held.filter(shown[g]), [g])[0]
            repeated |= {g} if values < rows else set()
    return repeated


def _shares(held: DataFrame, groups: Sequence[tuple[int, ...]], n_rows: int) -> set[tuple[int, ...]]:
    """The groups with a value in more than one row, from passes over all rows."""
    repeated: set[tuple[int, ...]] = set()
    done = 0.0
    while done < 1:
        left = [g for g in groups if g not in repeated]
        if not left:
            break
        # a share is a range of hashes; each pass takes as much as may be shuffled at once
        upto = min(1.0, done + _SHUFFLED / max(1, n_rows * len(left)))
        # one bit less than a long has, so that the last bound fits in one
        low, high = (round((2 * x - 1) * 2 ** 62) for x in (done, upto))
        shown = {g: (F.shiftright(_hash(g), 1) >= low) & (F.shiftright(_hash(g), 1) < high) for g in left}
        repeated |= _repeats(held, shown)
        done = upto
    return repeated


def _evidence(held: DataFrame, n_columns: int, n_rows: int) -> tuple[DataFrame, list[int]]:
    """Rows of some values of every column, tagged by the column, and the columns with most values first.

    All rows of a value that is taken are there, so values that repeat show it however far apart their rows are.
    Columns with few values share the rows of some numbers, under -1.
    """
    many = held.agg(*[F.approx_count_distinct(f"v{c}").alias(f"n{c}") for c in range(n_columns)]).first()
    order = sorted((c for c in range(n_columns) if many[c] > _FEW), key=lambda c: -many[c])
    parts = F.lit(max(1, n_rows // _SHOWN))
    numbered = held.withColumn("row", F.monotonically_increasing_id())
    tags = [F.when(F.pmod(F.xxhash64(f"v{c}"), parts) == 0, c) for c in order] + [F.when(F.pmod(F.xxhash64("row"), parts) == 0, -1)]
    return cut_lineage(numbered.withColumn("tag", F.explode(F.array_compact(F.array(*tags)))).drop("row")), order


def agree_sets(held: DataFrame, n_columns: int, order: Sequence[int]) -> list[frozenset[int]]:
    """Sets of columns on which two rows agree: for every repeated value of every column two of its rows.

    The rows of a value are halved by their position; the smallest of each half, columns with few values first, lie
    near each other.  Both minima are combined within the tasks, so a value that most rows hold is one row a task.
    """
    row = F.struct(*[F.xxhash64(f"v{c}").alias(f"h{c}") for c in order])
    halved = held.withColumn("half", F.monotonically_increasing_id() % 2).withColumn("row", row)
    rows = _expanded(halved, [(c,) for c in range(n_columns)], [F.col("half"), F.col("row")])
    pairs = rows.groupBy("g", "d").agg(
        F.min(F.when(F.col("half") == 0, F.col("row"))).alias("x"), F.min(F.when(F.col("half") == 1, F.col("row"))).alias("y")).filter(
        "x IS NOT NULL AND y IS NOT NULL")
    same = F.concat(*[F.when(F.col(f"x.h{c}") == F.col(f"y.h{c}"), "1").otherwise("0") for c in range(n_columns)])
    size = F.char_length(F.replace("same", F.lit("0"), F.lit("")))
    largest = pairs.select(same.alias("same")).distinct().orderBy(size.desc(), "same").limit(_AGREE_SETS)
    return [frozenset(c for c, bit in enumerate(r["same"]) if bit == "1") for r in largest.collect()]


def _told(held: DataFrame, groups: Sequence[tuple[int, ...]], n_rows: int,
          evidence: tuple[DataFrame, list[int]] | None, filled: frozenset[int]) -> list[tuple[int, int]]:
    """Of each group the complete rows, and before them as many values if none repeats, else 0."""
    repeated: set[tuple[int, ...]] = set()
    if evidence:
        rows, order = evidence
        repeated = _repeats(rows, {g: F.col("tag") == next((c for c in order if c in g), -1) for g in groups})
    repeated |= _shares(held, [g for g in groups if g not in repeated], n_rows)
    return [(0 if g in repeated else n, n) for g, n in zip(groups, _complete(held, groups, n_rows, filled))]


def composite_key_candidates(df: DataFrame, columns: Sequence[str] | None = None, max_width: int = 3) -> DataFrame:
    """The minimal combinations of up to ``max_width`` columns whose values never repeat.

    Rows with a null in one of the columns hold no value of the combination, as for unique keys; ``n_nulls`` counts them
    and ``key_candidate`` is true where there are none.  A combination that no row fills is none.  Nested
    columns take no part.
    """
    names = [f.name for f in df.schema.fields if family(f.dataType) and (columns is None or f.name in columns)]
    spark = df.sparkSession
    if not names:
        return spark.createDataFrame([], _RESULT)
    held = cut_lineage(_values(df, names))
    n_rows = held.count()
    found, repeated = [], {}
    singles = [(c,) for c in range(len(names))]
    agreed, values, evidence = [], [], None
    if n_rows <= _SMALL:
        counts = _counted(held, singles)
        values = [n for n, _ in counts]
    else:
        evidence = _evidence(held, len(names), n_rows)
        counts = _told(held, singles, n_rows, evidence, frozenset())
    # two nulls do not repeat a value, so columns with nulls cannot refute by agreeing
    filled = frozenset(c for c, (_, n) in enumerate(counts) if n == n_rows)
    if evidence is None:
        by_size = sorted(range(len(names)), key=lambda c: values[c])
        agreed = [s & filled for s in agree_sets(held, len(names), by_size)] if n_rows else []
    level = dict(zip(singles, counts))
    width = 1
    while level:
        unique = {g: n for g, (n, rows) in level.items() if n == rows and n}
        found += [(g, n) for g, n in unique.items()]
        repeated = {g for g, (n, rows) in level.items() if rows and g not in unique}
        width += 1
        if width > max_width:
            break
        # parts of a combination that nothing is known of were refuted before
        wide = [
            g for g in combinations(range(len(names)), width)
            if all(part in repeated for part in combinations(g, width - 1))]
        refuted = {
            g for g in wide if any(set(g) <= s for s in agreed)
            or (values and set(g) <= filled and _product([values[c] for c in g]) < n_rows)}
        left = [g for g in wide if g not in refuted]
        level = dict(zip(left, _told(held, left, n_rows, evidence, filled))) if left else {}
        # refuted ones repeat: any rows, fewer values
        level.update({g: (0, n_rows) for g in refuted})
    rows = [
        (",".join(names[c] for c in g), len(g), n, n_rows - n, n == n_rows) for g, n in sorted(found, key=lambda x: (len(x[0]), x[0]))]
    return spark.createDataFrame(rows, _RESULT)


def _product(numbers: Sequence[int]) -> int:
    return reduce(lambda a, b: a * b, numbers, 1)
