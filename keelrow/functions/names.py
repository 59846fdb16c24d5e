"""Identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keelrow import fixed_values as fv

_INVALID = "[^A-Za-z0-9_]"


def message(name: str, *values: Column | str) -> Column:
    """Fill the %s marks of a fixed text with columns."""
    return F.format_string(fv.MESSAGES[name], *[F.lit(v) if isinstance(v, str) else v for v in values])


def snake_case(s: Column) -> Column:
    """``UserID`` -> ``user_id``: a break wherever a lower-case letter meets an upper-case one."""
    return F.lower(F.regexp_replace(s, "([a-z])(?=[A-Z])", "$1_"))


def pluralize(s: Column) -> Column:
    return (
        F.when(s.endswith("y"), F.concat(s.substr(F.lit(1), F.length(s) - 1), F.lit("ies")))
        .when(s.endswith("s"), s)
        .otherwise(F.concat(s, F.lit("s")))
    )


def table_name_of(s: Column) -> Column:
    """Table name for a type name: snake case, plural."""
    return pluralize(snake_case(s))


def identifier_error(s: Column, what: str) -> Column:
    """First rule the name breaks, or NULL.  ``what`` is table, column or index."""
    checks = (
        F.when(s == "", F.lit(fv.MESSAGES["empty"] % what))
        .when(F.octet_length(s) > fv.MAX_IDENTIFIER, message("long", what, s))
        .when(s.rlike(_INVALID), message("character", what, s, F.regexp_extract(s, _INVALID, 0)))
    )
    if what == "table":
        checks = checks.when(is_reserved(s), message("reserved", s))
    return checks


def valid_identifier(s: Column, strict: bool = False) -> Column:
    """Strict names also do not start with a digit."""
    ok = s.rlike("^[A-Za-z0-9_]{1,%d}$" % fv.MAX_IDENTIFIER) & ~s.contains("\n")
    return ok & ~s.rlike("^[0-9]") if strict else ok


def is_reserved(s: Column) -> Column:
    return F.lower(s).isin(*fv.RESERVED_TABLE_NAMES)
