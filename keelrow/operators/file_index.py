"""What is kept beside a version to read only some of its files: Bloom filters of keys, trigrams of texts, places of rows.

An index covers the files it was built over.  Files that it does not cover are read, so it may lag behind; building it
again for a later version reads only the new files.  Every answer is a superset of the files that matter; what is
read is checked exactly.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelrow import fixed_values as fv
from keelrow.contract import TableContract, spark_type
from keelrow.functions.types import parse_value
from keelrow.operators import changes, search
from keelrow.session import cut_lineage
from keelrow.sources.versions import FILE, Version, append_rows, either

# a filter has so many bits for each row, and each key sets one bit with each hash
BITS_PER_ROW, HASHES = 12, 4
# bits in one stored piece of a filter
_PIECE = 4_096 * 8
# keys times files that are looked up in filters; beyond it most files are met anyhow, and their key columns are read
PROBES = 50_000_000
_FILTERS = "key string, name string, n_bits long, piece long, bitmap binary"
_GRAMS = "column string, gram string, name string"
_GRAM = 3


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _uncovered(version: Version, covered: DataFrame | None) -> DataFrame:
    return version.files() if covered is None else version.files().join(covered, "name", "left_anti")


# ---------------------------------------------------------------- filters of keys

def _places(values: Sequence[Column], n_bits: Column) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), *values), n_bits) for i in range(HASHES)])


def build_filters(version: Version, keys: Sequence[Sequence[str]], path: str, before: DataFrame | None = None) -> DataFrame:
    """A Bloom filter for each file and key, written to ``path``; what ``before`` covers is taken over.

    A task sends one bitmap for each file and piece it has read, never the keys.
    """
    spark = version.spark
    parts = [spark.createDataFrame([], _FILTERS)]
    for columns in keys:
        name = ",".join(columns)
        new = cut_lineage(_uncovered(version, None if before is None else before.filter(F.col("key") == name).select("name").distinct()))
        most = new.agg(F.max("n_rows")).first()[0]
        if before is not None:
            parts.append(before.filter(F.col("key") == name).join(version.files().select("name"), "name", "left_semi").select(*parts[0].columns))
        if most is None:
            continue
        n_bits = F.lit(-(-most * BITS_PER_ROW // _PIECE) * _PIECE).cast("long")
        rows = version.rows(new, with_file=True).filter(reduce(lambda a, b: a & b, [_col(c).isNotNull() for c in columns]))
        bits = rows.select(F.col(FILE).alias("name"), F.explode(_places([_col(c) for c in columns], n_bits)).alias("bit"))
        filled = bits.groupBy("name", F.expr(f"bit div {_PIECE}").alias("piece")).agg(
            F.bitmap_construct_agg(F.col("bit") % _PIECE).alias("bitmap"))
        # a file without a key is covered as well
        every = new.select("name").join(filled, "name", "left")
        parts.append(every.select(F.lit(name).alias("key"), "name", n_bits.alias("n_bits"), "piece", "bitmap"))
    reduce(DataFrame.unionByName, parts).write.parquet(path)
    return spark.read.schema(_FILTERS).parquet(path)


def files_that_may_hold(version: Version, filters: DataFrame, key: Sequence[str], values: DataFrame) -> DataFrame:
    """The files that may hold one of the values: by range, then by filter.

    ``values`` has the key's columns in the version's types.  Keys with a null part are in no file.
    """
    columns = list(key)
    wanted = cut_lineage(values.select(*map(_col, columns)).dropna().distinct())
    near = version.near(wanted, [(columns[0], columns[0])]) if columns[0] in version.bounds else version.files()
    near = cut_lineage(near)
    n_keys, n_files = wanted.count(), near.count()
    if not n_keys:
        return near.filter("false")
    if n_keys * n_files > PROBES:
        return near
    own = filters.filter(F.col("key") == ",".join(columns)).join(near.select("name"), "name", "left_semi")
    asked: list[DataFrame] = []
    # files written together have filters of one size: one set of places for each
    for size in [r["n_bits"] for r in own.select("n_bits").distinct().collect()]:
        asked.append(wanted.withColumn("n_key", F.monotonically_increasing_id()).select(
            "n_key", F.posexplode(_places([_col(c) for c in columns], F.lit(size))).alias("hash", "bit"), F.lit(size).alias("n_bits")))
    covered = own.select("name").distinct()
    open_ = near.join(covered, "name", "left_anti")
    if not asked:
        return near
    places = reduce(DataFrame.unionByName, asked).withColumn("piece", F.expr(f"bit div {_PIECE}"))
    byte = F.expr(f"conv(hex(substring(bitmap, int(bit % {_PIECE} div 8) + 1, 1)), 16, 10)").cast("int")
    is_set = F.expr("(shiftright(byte, int(bit % 8)) & 1) = 1")
    hits = places.join(own.select("name", "n_bits", "piece", "bitmap"), ["n_bits", "piece"]).withColumn("byte", byte).filter(is_set)
    held = hits.groupBy("name", "n_key", "n_bits").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == HASHES).select("name").distinct()
    return cut_lineage(near.join(held, "name", "left_semi").unionByName(open_))


@dataclass(frozen=True)
class IndexedInsert:
    version: Version
    filters: DataFrame
    accepted: DataFrame
    rejected: DataFrame
    files_read: int
    files_total: int


def _typed(batch: DataFrame, contract: TableContract, column: str, kind: T.DataType) -> Column:
    held = batch.schema[column].dataType
    value = parse_value(_col(column), contract.column(column).type) if isinstance(held, T.StringType) else _col(column).try_cast(
        spark_type(contract.column(column).type))
    return value.try_cast(kind)


def insert_indexed(version: Version, filters: DataFrame, base: str, batch: DataFrame, contract: TableContract,
                   parents: Mapping[str, DataFrame] | None = None, mode: str = "strict") -> IndexedInsert:
    """:func:`keelrow.operators.changes.insert` that reads only the files a key of the batch may be in.

    The filters have every unique key of the contract, and every column of the table that it refers to itself.  Accepted
    rows are new files; the filters grow by those.
    """
    kept = cut_lineage(batch)
    asked: list[tuple[tuple[str, ...], DataFrame]] = []
    wanted = [(k.columns, k.columns) for k in contract.unique_keys()]
    wanted += [((fk.column,), (column,)) for column, fk in contract.references() if fk.table == contract.name]
    for key, own in wanted:
        if all(c in kept.columns for c in own):
            asked.append((key, kept.select(*[_typed(kept, contract, c, version.schema[k].dataType).alias(k) for k, c in zip(key, own)])))
    files = cut_lineage(either(version.files().filter("false"), *[files_that_may_hold(version, filters, key, values) for key, values in asked]))
    following = {
        c.name: changes.next_id(version.rows().select(c.name), c.name)
        for c in contract.columns if c.serial and c.default is None and c.name not in kept.columns}
    done = changes.insert(version.rows(files), kept, contract, parents, mode, next_ids=following)
    accepted = cut_lineage(done.accepted)
    after = append_rows(version, base, accepted)
    keys = list(dict.fromkeys(key for key, _ in wanted))
    return IndexedInsert(
        after, build_filters(after, keys, f"{after.path}/filters", filters), accepted, done.rejected, files.count(), version.files().count())


# ---------------------------------------------------------------- trigrams of texts

def _grams(text: Column) -> Column:
    # a look-ahead at every place: linear in the text, whatever its characters
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(.{%d}))" % _GRAM), F.lit(1)))


def build_trigrams(version: Version, path: str, before: DataFrame | None = None) -> DataFrame:
    """Which files hold which three characters, lower-cased, in which text column; written to ``path`` in order of the characters."""
    columns = search.text_columns(version.spark.createDataFrame([], version.schema))
    new = cut_lineage(_uncovered(version, None if before is None else before.select("name").distinct()))
    rows = version.rows(new, with_file=True)
    parts = [version.spark.createDataFrame([], _GRAMS)]
    if before is not None:
        parts.append(before.join(version.files().select("name"), "name", "left_semi").select(*parts[0].columns))
    # the empty gram says that the file is covered
    parts += [new.select(F.lit(c).alias("column"), F.lit("").alias("gram"), "name") for c in columns]
    for c in columns:
        parts.append(rows.select(F.lit(c).alias("column"), F.explode(_grams(_col(c))).alias("gram"), F.col(FILE).alias("name")).distinct())
    found = reduce(DataFrame.unionByName, parts)
    found.repartitionByRange("gram", "column", "name").sortWithinPartitions("gram", "column", "name").write.parquet(path)
    return version.spark.read.schema(_GRAMS).parquet(path)


def literal_parts(term: str) -> list[str]:
    """What a pattern with ``%`` and ``_`` must contain, piece by piece; a backslash makes the next character literal."""
    parts, now = [], ""
    for escaped, wild, plain in re.findall(r"\\(.)|([%_])|(.)", term, re.DOTALL):
        if wild:
            parts.append(now)
            now = ""
        else:
            now += escaped or plain
    return [p for p in [*parts, now] if len(p) >= _GRAM]


def files_with_term(version: Version, trigrams: DataFrame, term: str, literal: bool = False) -> DataFrame:
    """The files in which some text column has all trigrams of the term.  Without a trigram in the term, all files."""
    parts = [term] if literal else literal_parts(term)
    spark = version.spark
    grams = sorted({g for p in parts for g in spark.range(1).select(_grams(F.lit(p))).first()[0]})
    if not grams:
        return version.files()
    columns = search.text_columns(spark.createDataFrame([], version.schema))
    held = trigrams.filter(F.col("gram").isin(grams)).groupBy("column", "name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams))
    covered = trigrams.filter("gram = ''").groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(columns))
    files = version.files()
    return either(files.join(held.select("name").distinct(), "name", "left_semi"), files.join(covered, "name", "left_anti"))


def search_indexed(version: Version, trigrams: DataFrame, term: str, literal: bool = False) -> DataFrame:
    """The rows of :func:`keelrow.operators.search.search`, from the files that may have them."""
    return search.search(version.rows(files_with_term(version, trigrams, term, literal)), term, literal)


# ---------------------------------------------------------------- places of rows

def page_files(version: Version, number: int = 1, limit: int = fv.DEFAULT_PAGE_SIZE) -> tuple[DataFrame, int]:
    """The files that a page lies in, and the rows of these files before the page.

    One row for each file is summed up in order; no data file is read.
    """
    if not version.order:
        raise ValueError("the version is in no order: write it anew with one")
    number, limit = search.page_bounds(number, limit)
    skip = (number - 1) * limit
    before = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    placed = version.files().withColumn("before", F.coalesce(F.sum("n_rows").over(before), F.lit(0)))
    files = cut_lineage(placed.filter((F.col("before") < skip + limit) & (F.col("before") + F.col("n_rows") > skip)))
    first = files.agg(F.min("before")).first()[0]
    return files.drop("before"), skip - (first or 0)


def page_indexed(version: Version, number: int = 1, limit: int = fv.DEFAULT_PAGE_SIZE) -> DataFrame:
    """The rows of one page of a version whose order covers all columns, or a unique key: one or two files are read."""
    files, skip = page_files(version, number, limit)
    return version.rows(files).orderBy(*map(_col, version.order)).offset(skip).limit(limit)
