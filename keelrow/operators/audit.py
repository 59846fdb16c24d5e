"""Checking a wanted catalog: names, types, defaults, keys, references, indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelrow.functions.defaults import default_error
from keelrow.functions.names import identifier_error, message
from keelrow.functions.references import foreign_key_error
from keelrow.functions.types import supported_type
from keelrow.operators.catalog import Catalog, first_columns, first_indexes, first_tables
from keelrow.operators.changes import union_all
from keelrow.session import cut_lineage

FINDING_COLUMNS = ("type", "table", "column", "index", "message", "severity", "n_rows")


def finding(kind: str, severity: str, text: Column, column: Column | None = None, index: Column | None = None,
            n: Column | None = None) -> Column:
    nothing = F.lit(None).cast("string")
    return F.when(text.isNotNull(), F.struct(
        F.lit(kind).alias("type"), F.col("table_name").alias("table"),
        (nothing if column is None else column).alias("column"),
        (nothing if index is None else index).alias("index"),
        text.alias("message"), F.lit(severity).alias("severity"),
        (F.lit(1) if n is None else n).cast("long").alias("n_rows"),
    ))


def _emit(rows: DataFrame, found: Sequence[Column]) -> DataFrame:
    """All rules over one relation in one pass."""
    return rows.select(F.explode(F.array_compact(F.array(*found))).alias("f")).select("f.*")


def audit(wanted: Catalog, existing_tables: DataFrame | None = None, exact_types: bool = False,
          materialize: bool = True) -> DataFrame:
    """Findings on a catalog.

    A repeated column or index gives that finding only (``n_rows`` says how many are too
    many); its first definition is checked.  Without ``existing_tables`` nothing is said about
    tables that exist already.  ``exact_types`` refuses sizes in parentheses.  The first
    definitions of columns and indexes serve many rules, so they are written once (``materialize``).
    """
    tables, columns, indexes = first_tables(wanted.tables), first_columns(wanted.columns), first_indexes(wanted.indexes)
    if materialize:
        columns, indexes = cut_lineage(columns), cut_lineage(indexes)
    column, index = F.col("column_name"), F.col("index_name")
    parts = [
        _emit(tables, [finding("table_name", "error", identifier_error(F.col("table_name"), "table"))]),
        _emit(
            tables.join(columns.select("table_name"), "table_name", "left_anti"),
            [finding("no_columns", "error", message("no_columns", F.col("table_name")))],
        ),
        _emit(
            columns.groupBy("table_name").agg(F.bool_or("is_primary").alias("has_key")).filter("NOT has_key"),
            [finding("no_primary_key", "warning", message("no_primary_key", F.col("table_name")))],
        ),
        _emit(columns, [
            finding("duplicate_column", "error",
                    F.when(F.col("n_definitions") > 1, message("duplicate_column", column, F.col("table_name"))),
                    column, n=F.col("n_definitions") - 1),
            finding("column_name", "error", identifier_error(column, "column"), column),
            finding("data_type", "error",
                    F.when(~supported_type(F.col("data_type"), exact_types), message("data_type", F.col("data_type"))),
                    column),
            finding("default_value", "warning",
                    F.when(F.col("column_default").isNotNull(),
                           default_error(F.col("data_type"), F.col("column_default"))), column),
        ]),
        _emit(indexes, [
            finding("duplicate_index", "error",
                    F.when(F.col("n_definitions") > 1, message("duplicate_index", index, F.col("table_name"))),
                    index=index, n=F.col("n_definitions") - 1),
            finding("index_name", "error", identifier_error(index, "index"), index=index),
        ]),
    ]
    if existing_tables is not None:
        parts.append(_emit(
            tables.join(existing_tables.select("table_name"), "table_name", "left_semi"),
            [finding("table_exists", "info", message("table_exists", F.col("table_name")))],
        ))

    # definitions of references: of the first definition of a column only
    first_positions = columns.select("table_name", "column_name", "column_pos")
    defined = wanted.foreign_keys.join(first_positions, ["table_name", "column_name", "column_pos"], "left_semi")
    parts.append(_emit(defined, [finding(
        "foreign_key", "error",
        foreign_key_error(F.col("table_name"), column, F.col("ref_table"), F.col("ref_column"),
                          F.col("on_delete"), F.col("on_update")), column,
    )]))

    # targets of references, counted per distinct reference before anything is joined
    references = wanted.foreign_keys.groupBy("table_name", "column_name", "ref_table", "ref_column").agg(
        F.count(F.lit(1)).alias("n")
    )
    known_tables = tables.select(F.col("table_name").alias("ref_table"))
    known_columns = columns.select(F.col("table_name").alias("ref_table"), F.col("column_name").alias("ref_column"))
    parts.append(_emit(references.join(known_tables, "ref_table", "left_anti"), [finding(
        "foreign_key_table_not_found", "error", message("foreign_key_table_not_found", F.col("ref_table")),
        column, n=F.col("n"),
    )]))
    parts.append(_emit(
        references.join(known_tables, "ref_table", "left_semi")
        .join(known_columns, ["ref_table", "ref_column"], "left_anti"),
        [finding("foreign_key_column_not_found", "error",
                 message("foreign_key_column_not_found", F.col("ref_column"), F.col("ref_table")),
                 column, n=F.col("n"))],
    ))

    # members of the first definition of each index
    members = wanted.index_columns.join(
        indexes.select("table_name", "index_name", "index_pos"), ["table_name", "index_name", "index_pos"], "left_semi"
    ).groupBy("table_name", "index_name", "column_name").agg(F.count(F.lit(1)).alias("n"))
    parts.append(_emit(
        members.join(columns.select("table_name", "column_name"), ["table_name", "column_name"], "left_anti"),
        [finding("index_column_not_found", "error",
                 message("index_column_not_found", index, column, F.col("table_name")), column, index, F.col("n"))],
    ))
    return union_all(parts)
