"""Catalogs as relations: one row per table, column, reference, index and index member.

A catalog may describe one database or an estate of many; every operator here is a join or an
aggregate over these relations.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelrow import fixed_values as fv
from keelrow.contract import TableContract, pg_type

TABLES = "table_name string, table_pos long"
COLUMNS = (
    "table_name string, column_name string, column_pos long, data_type string, nullable boolean, "
    "column_default string, is_primary boolean, is_unique boolean"
)
FOREIGN_KEYS = (
    "constraint_name string, table_name string, column_name string, column_pos long, ref_table string, "
    "ref_column string, on_delete string, on_update string"
)
INDEXES = (
    "table_name string, index_name string, index_pos long, is_unique boolean, method string, on_column boolean"
)
INDEX_COLUMNS = "table_name string, index_name string, index_pos long, column_name string, member_pos long"


@dataclass(frozen=True)
class Catalog:
    tables: DataFrame
    columns: DataFrame
    foreign_keys: DataFrame
    indexes: DataFrame
    index_columns: DataFrame


def from_contracts(spark: SparkSession, contracts: Sequence[TableContract]) -> Catalog:
    """The catalog that contracts ask for."""
    tables, columns, fks, indexes, members = [], [], [], [], []
    for t_pos, t in enumerate(contracts):
        tables.append((t.name, t_pos))
        for c_pos, c in enumerate(t.columns):
            columns.append((t.name, c.name, c_pos, c.type, not c.not_null, c.default, c.primary, c.unique))
            if c.foreign_key is not None:
                fk = c.foreign_key
                fks.append((f"fk_{t.name}_{fk.table}", t.name, c.name, c_pos, fk.table, fk.column,
                            fk.on_delete, fk.on_update))
        own = len(t.indexes)
        for i_pos, i in enumerate(t.all_indexes()):
            indexes.append((t.name, i.name, i_pos, i.unique, i.method, i_pos >= own))
            members += [(t.name, i.name, i_pos, c, m) for m, c in enumerate(i.columns)]
    return Catalog(
        spark.createDataFrame(tables, TABLES), spark.createDataFrame(columns, COLUMNS),
        spark.createDataFrame(fks, FOREIGN_KEYS), spark.createDataFrame(indexes, INDEXES),
        spark.createDataFrame(members, INDEX_COLUMNS),
    )


def from_data(spark: SparkSession, tables: Mapping[str, DataFrame]) -> Catalog:
    """The catalog that table schemas show: names, types and the rules kept as field metadata."""
    names, columns = [], []
    for t_pos, (name, df) in enumerate(tables.items()):
        names.append((name, t_pos))
        for c_pos, f in enumerate(df.schema.fields):
            meta = f.metadata
            columns.append((
                name, f.name, c_pos, meta.get("pg_type", pg_type(f.dataType)), f.nullable,
                meta.get("default"), bool(meta.get("primary")), bool(meta.get("unique")),
            ))
    return Catalog(
        spark.createDataFrame(names, TABLES), spark.createDataFrame(columns, COLUMNS),
        spark.createDataFrame([], FOREIGN_KEYS), spark.createDataFrame([], INDEXES),
        spark.createDataFrame([], INDEX_COLUMNS),
    )


# ---------------------------------------------------------------- information-schema relations

def catalog_tables(raw_tables: DataFrame, schema: str = "public") -> DataFrame:
    """Base tables of one schema by name, without the bookkeeping tables."""
    return raw_tables.filter(
        (F.col("table_schema") == schema) & (F.col("table_type") == "BASE TABLE")
        & ~F.col("table_name").isin(*fv.OWN_TABLES)
    ).select("table_name").orderBy("table_name")


def catalog_columns(raw_columns: DataFrame, key_usage: DataFrame, constraints: DataFrame) -> DataFrame:
    """Columns with key flags.

    The flags are aggregated per column before the join, so a column in several constraints
    stays one row.
    """
    kinds = constraints.select("constraint_name", "table_name", "constraint_type")
    flags = key_usage.select("constraint_name", "table_name", "column_name").join(
        kinds, ["constraint_name", "table_name"]
    ).groupBy("table_name", "column_name").agg(
        F.bool_or(F.col("constraint_type") == "PRIMARY KEY").alias("pk"),
        F.bool_or(F.col("constraint_type") == "UNIQUE").alias("uk"),
    )
    return raw_columns.join(flags, ["table_name", "column_name"], "left").select(
        "table_name", "column_name", F.col("ordinal_position").cast("long").alias("column_pos"), "data_type",
        (F.col("is_nullable") == "YES").alias("nullable"), "column_default",
        F.coalesce("pk", F.lit(False)).alias("is_primary"), F.coalesce("uk", F.lit(False)).alias("is_unique"),
    )


def catalog_foreign_keys(constraints: DataFrame, key_usage: DataFrame, referenced: DataFrame,
                         rules: DataFrame) -> DataFrame:
    """References with their delete and update rules, one row per column.

    Constraint names belong to a table, so every join has both; the columns of a composite reference
    are paired by position.  ``referenced`` has, for each constraint of a table and position, the
    ``ref_table`` and ``ref_column``.
    """
    name = ["table_name", "constraint_name"]
    return (
        constraints.filter("constraint_type = 'FOREIGN KEY'").select(*name).distinct()
        .join(key_usage.select(*name, "column_name", "ordinal_position"), name)
        .join(referenced.select(*name, "ordinal_position", "ref_table", "ref_column"), [*name, "ordinal_position"])
        .join(rules.select(*name, F.col("delete_rule").alias("on_delete"), F.col("update_rule").alias("on_update")),
              name, "left")
        .select("constraint_name", "table_name", "column_name", F.col("ordinal_position").alias("column_pos"),
                "ref_table", "ref_column", "on_delete", "on_update")
    )


def index_members(index_list: DataFrame, members: DataFrame) -> DataFrame:
    """One row per member of a listed index, with its place from 1."""
    name = ["table_name", "index_name"]
    place = F.row_number().over(Window.partitionBy(*name).orderBy("member_pos", "column_name"))
    return members.join(index_list.select(*name).distinct(), name, "left_semi").select(
        *name, place.cast("long").alias("place"), "column_name")


def catalog_indexes(index_list: DataFrame, members: DataFrame, details: DataFrame) -> DataFrame:
    """Indexes with the ordered list of all their columns, uniqueness and method.

    Index names belong to a table.  :func:`index_members` has the same columns as rows.
    """
    name = ["table_name", "index_name"]
    ordered = F.array_sort(F.collect_list(F.struct("member_pos", "column_name")))
    lists = members.groupBy(*name).agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.array_join(F.transform(ordered, lambda m: m["column_name"]), ",").alias("column_names"),
    )
    return (
        index_list.select(*name).join(lists, name, "left")
        .join(details.select(*name, "is_unique", "method"), name, "left")
        .select(
            "index_name", "table_name", F.coalesce("n_columns", F.lit(0)).cast("long").alias("n_columns"),
            F.coalesce("column_names", F.lit("")).alias("column_names"),
            F.coalesce("is_unique", F.lit(False)).alias("is_unique"),
            F.coalesce("method", F.lit("btree")).alias("method"),
        )
    )


def primary_key_columns(constraints: DataFrame, key_usage: DataFrame) -> DataFrame:
    """Key columns per table, all of them, with their position."""
    name = ["table_name", "constraint_name"]
    keys = constraints.filter("constraint_type = 'PRIMARY KEY'").select(*name).distinct()
    return key_usage.select(*name, "column_name", "ordinal_position").join(keys, name).select(
        "table_name", "column_name", "ordinal_position")


# ---------------------------------------------------------------- shared steps

def first_columns(columns: DataFrame) -> DataFrame:
    """One row per column name of a table: its first definition and how many there are."""
    rest = [c for c in columns.columns if c not in ("table_name", "column_name")]
    return columns.groupBy("table_name", "column_name").agg(
        F.min_by(F.struct(*rest), "column_pos").alias("d"), F.count(F.lit(1)).alias("n_definitions")
    ).select("table_name", "column_name", "d.*", "n_definitions")


def first_indexes(indexes: DataFrame) -> DataFrame:
    rest = [c for c in indexes.columns if c not in ("table_name", "index_name")]
    return indexes.groupBy("table_name", "index_name").agg(
        F.min_by(F.struct(*rest), "index_pos").alias("d"), F.count(F.lit(1)).alias("n_definitions")
    ).select("table_name", "index_name", "d.*", "n_definitions")


def first_tables(tables: DataFrame) -> DataFrame:
    return tables.groupBy("table_name").agg(F.min("table_pos").alias("table_pos"))
