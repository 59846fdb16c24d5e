"""Referential-action expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keelrow import fixed_values as fv
from keelrow.functions.names import message


def normalize_fk_action(s: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(F.trim(s)), F.lit("")), F.lit("NO ACTION"))


def valid_fk_action(s: Column) -> Column:
    return F.upper(s).isin(*fv.FK_ACTIONS)


def foreign_key_error(table: Column, column: Column, ref_table: Column, ref_column: Column,
                      on_delete: Column, on_update: Column) -> Column:
    """First broken rule of a foreign-key definition, or NULL."""
    def wrong(action: Column) -> Column:
        return F.coalesce((action != "") & ~valid_fk_action(action), F.lit(False))

    return (
        F.when(ref_table == "", F.lit(fv.MESSAGES["fk_table_empty"]))
        .when(ref_column == "", F.lit(fv.MESSAGES["fk_column_empty"]))
        .when((ref_table == table) & (ref_column == column), F.lit(fv.MESSAGES["fk_itself"]))
        .when(wrong(on_delete), message("fk_on_delete", on_delete))
        .when(wrong(on_update), message("fk_on_update", on_update))
    )
