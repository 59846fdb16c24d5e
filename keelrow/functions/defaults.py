"""Default-value expressions.  A default is text: a literal or a function call."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keelrow import fixed_values as fv
from keelrow.contract import spark_type
from keelrow.functions.names import message
from keelrow.functions.types import constant_lists, parse_value


def normalize_default(s: Column) -> Column:
    """Comparable form: quotes off, else lower case, no ``::cast``, one spelling of now()."""
    t = F.trim(s, F.lit(fv.WHITESPACE))
    quoted = (t.startswith("'") & t.endswith("'")) | (t.startswith('"') & t.endswith('"'))
    plain = F.substring_index(F.lower(t), "::", 1)
    # a cast behind a quoted literal leaves the literal
    plain = F.when(
        plain.startswith("'") & plain.endswith("'"), F.trim(plain, F.lit("'"))
    ).otherwise(plain)
    return F.when(quoted, F.trim(t, F.lit("'\""))).otherwise(
        F.regexp_replace(plain, r"current_timestamp(\(\))?", "now()")
    )


def default_equivalent(a: Column, b: Column) -> Column:
    """Equal, or one is a listed spelling of the other."""
    x, y = (F.lower(F.trim(v, F.lit(fv.WHITESPACE))) for v in (a, b))
    listed = constant_lists(fv.EQUIVALENT_DEFAULTS)

    def stands_for(p: Column, q: Column) -> Column:
        return F.coalesce(F.array_contains(F.try_element_at(listed, p), q), F.lit(False))

    return (x == y) | stands_for(x, y) | stands_for(y, x)


def same_default(a: Column, b: Column) -> Column:
    """Null-safe comparison of two default texts."""
    both = default_equivalent(normalize_default(a), normalize_default(b))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(both)


def format_default(s: Column) -> Column:
    """Text for a definition: calls, booleans, numbers and quoted literals stay, the rest is quoted."""
    keep = (
        (s.startswith("'") & s.endswith("'"))
        | (s.contains("(") & s.contains(")"))
        | s.isin("true", "false")
        | (s.rlike("[0-9]") & ~s.rlike("[A-Za-z]"))
    )
    return F.when(keep, s).otherwise(F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("''")), F.lit("'")))


def default_error(pg_type: Column, default: Column) -> Column:
    """Why a default does not suit its type, or NULL."""
    t = F.lower(pg_type)
    integer = t.contains("int") | t.contains("serial")
    string = t.contains("char") | (t == "text")
    boolean = t.isin("boolean", "bool")
    return (
        F.when(
            integer,
            F.when(
                ~default.contains("(") & ~default.contains("'") & default.contains("."),
                message("default_integer", default),
            ),
        )
        .when(
            string,
            F.when(
                ~default.contains("(") & ~default.startswith("'") & ~default.startswith('"'),
                message("default_string", default),
            ),
        )
        .when(
            boolean,
            F.when(~default.isin("true", "false", "TRUE", "FALSE"), message("default_boolean", default)),
        )
    )


def default_value(default: str | None, pg_type: str) -> Column:
    """The value a missing column takes.

    ``now()`` and ``uuid()`` are evaluated when the plan runs, so write the result once and
    read it back instead of using the plan twice.
    """
    target = spark_type(pg_type)
    if default is None:
        return F.lit(None).cast(target)
    text = default.strip()
    name = text.lower().split("::")[0]
    if name in fv.NOW_DEFAULTS:
        return F.current_timestamp().cast(target)
    if name in fv.DATE_DEFAULTS:
        return F.current_date().cast(target)
    if name in ("current_time", "current_time()"):
        return F.date_format(F.current_timestamp(), "HH:mm:ss.SSSSSS").cast(target)
    if name in fv.UUID_DEFAULTS:
        return F.uuid().cast(target)
    if text.endswith(")") and "(" in text and not text.startswith("'"):
        raise ValueError(f"default {default!r} calls an unknown function")
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        text = text[1:-1].replace("''", "'")
    return parse_value(F.lit(text), pg_type)
