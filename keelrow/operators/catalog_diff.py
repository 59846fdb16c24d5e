"""From an existing catalog to a wanted one: the operations that lead there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelrow import fixed_values as fv
from keelrow.functions.defaults import same_default
from keelrow.functions.references import normalize_fk_action
from keelrow.functions.types import is_compatible_type, is_significant_type_change
from keelrow.operators.catalog import Catalog, first_columns, first_indexes, first_tables
from keelrow.operators.changes import union_all
from keelrow.session import cut_lineage

# The order of operations on one table.
CREATE, ADD, DROP, MODIFY, INDEX, COLUMN_INDEX, FK, FK_OF_DROPPED, DROP_TABLE = range(9)

OPERATION_COLUMNS = {
    "table_pos": "long", "step": "int", "pos": "long", "sub": "int", "kind": "string", "table_name": "string",
    "column_name": "string", "index_name": "string", "constraint_name": "string",
    "new_type": "string", "old_type": "string", "new_nullable": "boolean", "old_nullable": "boolean",
    "new_default": "string", "old_default": "string", "is_unique": "boolean", "method": "string",
    "ref_table": "string", "ref_column": "string", "on_delete": "string", "on_update": "string",
}
ORDER = ("table_pos", "step", "pos", "sub", "table_name", "column_name", "index_name")
# Operations that drop something have no place in the wanted order; they come last.
_LAST = 1 << 62


def _operations(rows: DataFrame, operation: str, at: int, pos: Column, sub: int = 0, **values) -> DataFrame:
    given = {
        "table_pos": F.col("table_pos"), "step": F.lit(at), "pos": pos, "sub": F.lit(sub), "kind": F.lit(operation),
        "table_name": F.col("table_name"), **values,
    }
    return rows.select(*[
        given.get(n, F.lit(None)).cast(t).alias(n) for n, t in OPERATION_COLUMNS.items()
    ])


def column_changed(parity: bool) -> Column:
    """Whether a column needs a MODIFY, over ``old_*`` and ``new_*`` columns.

    Key columns are left alone.  Types are compared first: compatible ones count as equal.
    With ``parity`` an incompatible type counts only if the change is significant; otherwise
    every such change is reported.
    """
    same_type = is_compatible_type(F.col("old_type"), F.col("new_type"))
    type_change = is_significant_type_change(F.col("old_type"), F.col("new_type")) if parity else F.lit(True)
    rules = (F.col("old_nullable") != F.col("new_nullable")) | ~same_default(
        F.col("old_default"), F.col("new_default")
    )
    return ~F.col("old_primary") & F.when(same_type, rules).otherwise(type_change)


def reference_changed() -> Column:
    pairs = [(F.col("old_ref_table"), F.col("ref_table")), (F.col("old_ref_column"), F.col("ref_column"))]
    pairs += [
        (normalize_fk_action(F.col(f"old_{a}")), normalize_fk_action(F.col(a))) for a in ("on_delete", "on_update")
    ]
    return reduce(lambda a, b: a | b, [~x.eqNullSafe(y) for x, y in pairs])


def diff_catalog(wanted: Catalog, existing: Catalog, parity: bool = False, materialize: bool = True) -> DataFrame:
    """Operations in order.

    Every comparison is between relations with one row per name, so a table with many columns
    or a name that occurs often does not multiply rows.  With ``parity`` new tables and new
    columns get no reference operations, and type changes count only if significant.  The
    tables of both sides and the changed columns serve many kinds of operations, so they are
    written once (``materialize``).
    """
    own = F.col("table_name").isin(*fv.OWN_TABLES)
    keep = cut_lineage if materialize else (lambda df: df)
    old_tables = first_tables(existing.tables.filter(~own)).withColumnRenamed("table_pos", "place")
    sides = keep(first_tables(wanted.tables).join(old_tables, "table_name", "full_outer"))
    both = sides.filter("table_pos IS NOT NULL AND place IS NOT NULL").drop("place")
    created = sides.filter("place IS NULL").drop("place")
    dropped = sides.filter("table_pos IS NULL").withColumn("table_pos", F.lit(_LAST))

    new_columns = first_columns(wanted.columns).select(
        "table_name", "column_name", F.col("column_pos").alias("new_pos"), F.col("data_type").alias("new_type"),
        F.col("nullable").alias("new_nullable"), F.col("column_default").alias("new_default"),
        F.col("is_unique").alias("new_unique"),
    )
    old_columns = first_columns(existing.columns.filter(~own)).select(
        "table_name", "column_name", F.col("column_pos").alias("old_pos"), F.col("data_type").alias("old_type"),
        F.col("nullable").alias("old_nullable"), F.col("column_default").alias("old_default"),
        F.col("is_primary").alias("old_primary"), F.lit(True).alias("is_old"),
    )
    compared = new_columns.withColumn("is_new", F.lit(True)).join(
        old_columns, ["table_name", "column_name"], "full_outer"
    ).join(both, "table_name")
    state = (
        F.when(F.col("is_old").isNull(), F.lit("ADD_COLUMN"))
        .when(F.col("is_new").isNull(), F.lit("DROP_COLUMN"))
        .when(column_changed(parity), F.lit("MODIFY_COLUMN"))
    )
    changed = keep(compared.withColumn("state", state).filter("state IS NOT NULL"))
    column_step = F.when(F.col("state") == "ADD_COLUMN", ADD).when(F.col("state") == "DROP_COLUMN", DROP).otherwise(MODIFY)
    column_operations = _column_operations(changed, column_step)

    missing_indexes = first_indexes(wanted.indexes.filter("index_name <> ''")).join(
        existing.indexes.select("table_name", "index_name"), ["table_name", "index_name"], "left_anti"
    ).join(both, "table_name")
    index_step = F.when(F.col("on_column"), COLUMN_INDEX).otherwise(INDEX)

    new_fks = _one_per_column(wanted.foreign_keys)
    old_fks = _one_per_column(existing.foreign_keys.filter(~own))
    touched = keep(changed.select("table_name").distinct())
    old_side = old_fks.select(
        "table_name", "column_name", F.col("constraint_name").alias("old_constraint"),
        *[F.col(c).alias(f"old_{c}") for c in ("ref_table", "ref_column", "on_delete", "on_update")],
    )
    updated = (
        new_fks.join(touched, "table_name", "left_semi").join(both, "table_name")
        .join(old_side, ["table_name", "column_name"]).filter(reference_changed())
    )
    gone = old_fks.join(
        changed.filter("state = 'DROP_COLUMN'").select("table_name", "column_name", "table_pos"),
        ["table_name", "column_name"],
    )
    fk_values = {c: F.col(c) for c in ("ref_table", "ref_column", "on_delete", "on_update")}
    parts = [
        _operations(created, "CREATE_TABLE", CREATE, F.lit(0)),
        column_operations,
        _operations(missing_indexes, "CREATE_INDEX", INDEX, F.col("index_pos"), index_name=F.col("index_name"),
                    is_unique=F.col("is_unique"), method=F.col("method"), step=index_step),
        _operations(updated, "DROP_FOREIGN_KEY", FK, F.col("column_pos"), 0, column_name=F.col("column_name"),
                    constraint_name=F.col("old_constraint"), **{c: F.col(f"old_{c}") for c in fk_values}),
        _operations(updated, "ADD_FOREIGN_KEY", FK, F.col("column_pos"), 1, column_name=F.col("column_name"),
                    constraint_name=F.col("constraint_name"), **fk_values),
        _operations(gone, "DROP_FOREIGN_KEY", FK_OF_DROPPED, F.col("column_pos"), column_name=F.col("column_name"),
                    constraint_name=F.col("constraint_name"), **fk_values),
        _operations(dropped, "DROP_TABLE", DROP_TABLE, F.col("place")),
    ]
    if not parity:
        added_columns = changed.filter("state = 'ADD_COLUMN'").select("table_name", "column_name")
        fresh = new_fks.join(created, "table_name").unionByName(
            new_fks.join(added_columns, ["table_name", "column_name"], "left_semi").join(both, "table_name")
        )
        parts.append(_operations(fresh, "ADD_FOREIGN_KEY", FK, F.col("column_pos"), 1,
                                 column_name=F.col("column_name"), constraint_name=F.col("constraint_name"), **fk_values))
        new_table_indexes = first_indexes(wanted.indexes).join(created, "table_name")
        parts.append(_operations(new_table_indexes, "CREATE_INDEX", INDEX, F.col("index_pos"),
                                 index_name=F.col("index_name"), is_unique=F.col("is_unique"),
                                 method=F.col("method"), step=index_step))
    return union_all(parts)


def _column_operations(changed: DataFrame, step: Column) -> DataFrame:
    return _operations(
        changed, "", ADD, F.coalesce("new_pos", "old_pos"), kind=F.col("state"), step=step,
        column_name=F.col("column_name"), is_unique=F.col("new_unique"),
        **{c: F.col(c) for c in ("new_type", "old_type", "new_nullable", "old_nullable", "new_default", "old_default")},
    )


def _one_per_column(fks: DataFrame) -> DataFrame:
    rest = [c for c in fks.columns if c not in ("table_name", "column_name")]
    return fks.groupBy("table_name", "column_name").agg(
        F.max_by(F.struct(*rest), "constraint_name").alias("d")
    ).select("table_name", "column_name", "d.*")


def operation_line() -> Column:
    """One text line per operation."""
    spot = F.concat("table_name", F.lit("."), "column_name")
    kind = F.col("kind")
    definition = F.concat(
        F.lit("ADD COLUMN "), spot, F.lit(" ("), "new_type", F.lit(")"),
        F.when(~F.col("new_nullable"), F.lit(" NOT NULL")).otherwise(F.lit("")),
        F.coalesce(F.concat(F.lit(" DEFAULT "), F.col("new_default")), F.lit("")),
    )
    return (
        F.when(kind == "CREATE_TABLE", F.concat(F.lit("CREATE TABLE "), "table_name"))
        .when(kind == "DROP_TABLE", F.concat(F.lit("DROP TABLE "), "table_name"))
        .when(kind == "ADD_COLUMN", definition)
        .when(kind == "DROP_COLUMN", F.concat(F.lit("DROP COLUMN "), spot))
        .when(kind == "MODIFY_COLUMN", F.concat(F.lit("MODIFY COLUMN "), spot))
        .when(kind == "CREATE_INDEX", F.concat(F.lit("CREATE INDEX "), "index_name", F.lit(" ON "), "table_name"))
        .when(kind == "ADD_FOREIGN_KEY", F.concat(
            F.lit("ADD FOREIGN KEY "), spot, F.lit(" → "), "ref_table", F.lit("."), "ref_column"))
        .when(kind == "DROP_FOREIGN_KEY", F.concat(F.lit("DROP FOREIGN KEY "), "constraint_name"))
    )


def modification_text() -> Column:
    """What a MODIFY changes: type, NOT NULL, default."""
    def when(changed: Column, text: Column) -> Column:
        return F.when(F.coalesce(changed, F.lit(False)), text)

    old_default, new_default = F.col("old_default"), F.col("new_default")
    return F.when(F.col("kind") == "MODIFY_COLUMN", F.array_join(F.array_compact(F.array(
        when(F.lower("old_type") != F.lower("new_type"), F.concat(F.lit("TYPE: "), "old_type", F.lit(" → "), "new_type")),
        when(F.col("old_nullable") & ~F.col("new_nullable"), F.lit("NOT NULL: ADDED")),
        when(~F.col("old_nullable") & F.col("new_nullable"), F.lit("NOT NULL: REMOVED")),
        when(old_default.isNull() & new_default.isNotNull(), F.concat(F.lit("DEFAULT: ADDED "), new_default)),
        when(old_default.isNotNull() & new_default.isNull(),
             F.concat(F.lit("DEFAULT: REMOVED (was "), old_default, F.lit(")"))),
        when(old_default != new_default, F.concat(F.lit("DEFAULT: "), old_default, F.lit(" → "), new_default)),
    )), "; "))


def diff_lines(operations: DataFrame) -> DataFrame:
    return operations.select(
        *ORDER, "kind", operation_line().alias("line"), modification_text().alias("details")
    )


def diff_summary(operations: DataFrame) -> DataFrame:
    """Per table: what happens to it, and how many operations of each kind."""
    def count(kind: str) -> Column:
        return F.count_if(F.col("kind") == kind).alias(f"n_{kind.lower()}")

    kinds = ("ADD_COLUMN", "DROP_COLUMN", "MODIFY_COLUMN", "CREATE_INDEX", "ADD_FOREIGN_KEY", "DROP_FOREIGN_KEY")
    return operations.groupBy("table_name").agg(
        F.bool_or(F.col("kind") == "CREATE_TABLE").alias("c"), F.bool_or(F.col("kind") == "DROP_TABLE").alias("d"),
        *[count(k) for k in kinds],
    ).select(
        "table_name",
        F.when(F.col("c"), F.lit("CREATE")).when(F.col("d"), F.lit("DROP")).otherwise(F.lit("MODIFY")).alias("change"),
        *[f"n_{k.lower()}" for k in kinds],
    )


def operation_counts(operations: DataFrame) -> DataFrame:
    return operations.groupBy("kind").agg(F.count(F.lit(1)).alias("n_operations"))


def rename_suggestions(operations: DataFrame) -> DataFrame:
    """Tables that lose exactly one column and gain exactly one of the same type: maybe a rename.
    Only a suggestion; a rename is never carried out unasked."""
    per_table = operations.filter("kind IN ('ADD_COLUMN', 'DROP_COLUMN')").groupBy("table_name").agg(
        F.count_if(F.col("kind") == "ADD_COLUMN").alias("added"),
        F.count_if(F.col("kind") == "DROP_COLUMN").alias("dropped"),
        F.max(F.when(F.col("kind") == "DROP_COLUMN", F.struct("column_name", "old_type"))).alias("o"),
        F.max(F.when(F.col("kind") == "ADD_COLUMN", F.struct("column_name", "new_type"))).alias("n"),
    )
    return per_table.filter("added = 1 AND dropped = 1").filter(
        is_compatible_type(F.col("o.old_type"), F.col("n.new_type"))
    ).select("table_name", F.col("o.column_name").alias("old_column"), F.col("n.column_name").alias("new_column"))


def index_drift(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Indexes that are missing, extra or made otherwise: ``kind, table_name, index_name, details``.

    Both sides are as :func:`keelrow.operators.catalog.catalog_indexes` returns them.
    """
    name, parts = ["table_name", "index_name"], ("column_names", "is_unique", "method")

    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*name, *[F.col(p).alias(f"{prefix}_{p}") for p in parts], F.lit(True).alias(prefix))

    both = side(wanted, "wanted").join(side(existing, "existing"), name, "full_outer")
    differs = [
        F.when(~F.col(f"wanted_{p}").eqNullSafe(F.col(f"existing_{p}")), F.concat_ws(
            "", F.lit(f"{p}: "), F.col(f"existing_{p}").cast("string"), F.lit(" → "), F.col(f"wanted_{p}").cast("string")))
        for p in parts]
    details = F.array_join(F.array_compact(F.array(*differs)), "; ")
    kind = F.when(F.col("existing").isNull(), "missing_index").when(F.col("wanted").isNull(), "extra_index").otherwise("index_mismatch")
    found = both.withColumn("kind", kind).withColumn("details", F.when(F.col("kind") == "index_mismatch", details).otherwise(""))
    return found.filter("kind <> 'index_mismatch' OR details <> ''").select("kind", *name, "details")
