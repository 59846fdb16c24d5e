"""Finding and paging rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelrow import fixed_values as fv
from keelrow.contract import TableContract
from keelrow.functions.values import Ranges, constant
from keelrow.operators.numbering import dense_numbers
from keelrow.session import cut_lineage

# Beyond this many rows a page is cut from range partitions instead of one top-k task.
TOP_K_ROWS = 10_000
# Longer lists of ids become a join.
INLINE_IDS = 200


def scan(df: DataFrame, contract: TableContract) -> DataFrame:
    """All columns in contract order."""
    return df.select(*contract.names)


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))]


def search_condition(df: DataFrame, term: str, literal: bool = False) -> Column:
    """Any text column contains the term, whatever its case.  ``%`` and ``_`` are wildcards
    unless ``literal``.  Without a term or a text column every row is meant."""
    columns = text_columns(df)
    if not term or not columns:
        return F.lit(True)
    if literal:
        hits = [F.lower(F.col(c)).contains(term.lower()) for c in columns]
    else:
        hits = [F.col(c).ilike(f"%{term}%") for c in columns]
    return reduce(lambda a, b: a | b, hits)


def search(df: DataFrame, term: str, literal: bool = False) -> DataFrame:
    return df.filter(search_condition(df, term, literal))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def search_count(df: DataFrame, term: str, literal: bool = False) -> DataFrame:
    return row_count(search(df, term, literal))


def key_lookup(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose key equals a value; the value takes the key's type, so the filter reaches the scan."""
    return df.filter(F.col(column) == constant(value, df.schema[column].dataType))


def ids_in(df: DataFrame, column: str, ids: Sequence | DataFrame) -> DataFrame:
    """Rows whose key is listed: a pushed filter for short lists, a semi join otherwise."""
    if not isinstance(ids, DataFrame):
        dtype = df.schema[column].dataType
        if len(ids) <= INLINE_IDS:
            return df.filter(F.col(column).isin(*[constant(i, dtype) for i in ids]))
        ids = df.sparkSession.createDataFrame([(i,) for i in ids], T.StructType([T.StructField(column, dtype)]))
    return df.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_semi").select(*df.columns)


def ids_not_in(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.filter(~F.col(column).isin(*values))


@dataclass(frozen=True)
class Page:
    """One page and its place in the whole."""

    rows: DataFrame
    number: int
    limit: int
    total: int

    @property
    def total_pages(self) -> int:
        return -(-self.total // self.limit)

    @property
    def label(self) -> str:
        if self.total == 0:
            return "No data found"
        first = (self.number - 1) * self.limit + 1
        last = min(self.number * self.limit, self.total)
        return f"Showing {first} to {last} of {self.total} rows (Page {self.number} of {self.total_pages})"


def page_bounds(number: int, limit: int, maximum: int = fv.MAX_PAGE_SIZE) -> tuple[int, int]:
    """Page number (the first at least) and size; a size out of range is refused."""
    if not 1 <= limit <= maximum:
        raise ValueError(f"a page has 1 to {maximum} rows, not {limit}")
    return max(number, 1), limit


def _total_order(df: DataFrame, key: Sequence[str], unique: bool) -> list[Column]:
    """The key, then all other columns: rows that are still equal are copies, so any order of them is the same."""
    if unique:
        return [F.col(c) for c in key]
    rest = [f for f in df.schema.fields if f.name not in key]
    unordered = (T.MapType, T.VariantType)
    return [F.col(c) for c in key] + [
        F.to_json(f.name) if isinstance(f.dataType, unordered) else F.col(f.name) for f in rest]


def page_rows(df: DataFrame, key: Sequence[str], number: int = 1, limit: int = fv.DEFAULT_PAGE_SIZE,
              unique: bool = False) -> DataFrame:
    """Rows of one page in key order; rows with equal keys are ordered by their other columns.

    Near pages are a top-k.  For far ones the rows are range-partitioned and numbered, so no
    task ever holds all the rows in front of the page.  With a ``unique`` key only the key
    columns are moved; the rows of the page are then looked up by key and range.
    """
    number, limit = page_bounds(number, limit)
    skip = (number - 1) * limit
    if skip + limit <= TOP_K_ROWS:
        return df.orderBy(*_total_order(df, key, unique)).offset(skip).limit(limit)
    if unique:
        numbers = dense_numbers(df.select(*key), "__row", key, start=0)
        # a page is at most 100 keys
        wanted = cut_lineage(numbers.filter(F.col("__row").between(skip, skip + limit - 1)).drop("__row"))
        inside = Ranges(wanted, [key[0]]).cut(df, key[0], key[0])
        return inside.join(F.broadcast(wanted), list(key), "left_semi").orderBy(*key)
    ties = {f"__tie_{i}": c for i, c in enumerate(_total_order(df, key, unique))}
    numbered = dense_numbers(df.withColumns(ties), "__row", list(ties), start=0)
    return numbered.filter(F.col("__row").between(skip, skip + limit - 1)).orderBy("__row").drop("__row", *ties)


def page(df: DataFrame, key: Sequence[str], number: int = 1, limit: int = fv.DEFAULT_PAGE_SIZE,
         term: str = "", unique: bool = False) -> Page:
    """A page of the rows that match ``term``, with the total of all matching rows."""
    number, limit = page_bounds(number, limit)
    hits = search(df, term)
    return Page(page_rows(hits, key, number, limit, unique), number, limit, hits.count())


def next_page(df: DataFrame, key: str | Sequence[str], after, limit: int = fv.DEFAULT_PAGE_SIZE, term: str = "") -> DataFrame:
    """Rows that match ``term`` and follow a key: the filter reaches the scan, whatever the depth.

    A key of several columns takes as many values; keys are unique and complete.
    """
    _, limit = page_bounds(1, limit)
    names = [key] if isinstance(key, str) else list(key)
    hits = search(df, term)
    if after is not None:
        values = [after] if isinstance(key, str) else list(after)
        bounds = [(F.col(c), constant(v, df.schema[c].dataType)) for c, v in zip(names, values, strict=True)]
        follows = F.lit(False)
        for column, value in reversed(bounds):
            follows = (column > value) | ((column == value) & follows)
        # said of the first column alone, it prunes files
        hits = hits.filter((bounds[0][0] >= bounds[0][1]) & follows)
    return hits.orderBy(*names).limit(limit)


def newest(df: DataFrame, by: str, tie: str, limit: int = 0) -> DataFrame:
    """Newest first; 0 means all."""
    ordered = df.orderBy(F.col(by).desc(), F.col(tie).desc())
    return ordered.limit(limit) if limit > 0 else ordered
