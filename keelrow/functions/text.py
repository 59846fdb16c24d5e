"""Text expressions: checksums, cut cells, literals, change scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelrow import fixed_values as fv

def checksum(s: Column) -> Column:
    return F.sha2(s, 256)


def short_checksum(s: Column) -> Column:
    return F.concat(F.substring(s, 1, 8), F.lit("..."))


def _cut(s: Column, longest: int, kept: int) -> Column:
    return F.when(F.length(s) > longest, F.concat(F.substring(s, 1, kept), F.lit("..."))).otherwise(s)


def truncate_cell(s: Column) -> Column:
    return _cut(s, 50, 50)


def truncate_name(s: Column) -> Column:
    return _cut(s, 23, 20)


def escape_csv(s: Column) -> Column:
    doubled = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(s.rlike('[,"\n\r]'), doubled).otherwise(s)


def escape_sql(s: Column) -> Column:
    return F.replace(s, F.lit("'"), F.lit("''"))


def unescape_sql(s: Column) -> Column:
    return F.replace(s, F.lit("''"), F.lit("'"))


def render_literal(value: Column, dtype: T.DataType) -> Column:
    """A SQL literal on one line; text with line breaks becomes an E-string."""
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        text = value.cast("string")
    else:
        if isinstance(dtype, T.BinaryType):
            raw = F.concat(F.lit("\\x"), F.lower(F.hex(value)))
        elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
            raw = F.to_json(value)
        else:
            raw = value.cast("string")
        quoted = escape_sql(raw)
        one_line = F.replace(quoted, F.lit("\\"), F.lit("\\x5C"))
        one_line = F.replace(one_line, F.lit("\n"), F.lit("\\n"))
        one_line = F.replace(one_line, F.lit("\r"), F.lit("\\r"))
        text = F.when(
            raw.rlike("[\n\r]"), F.concat(F.lit("E'"), one_line, F.lit("'"))
        ).otherwise(F.concat(F.lit("'"), quoted, F.lit("'")))
    return F.when(value.isNull(), F.lit("NULL")).otherwise(text)


def read_literal(literal: Column) -> Column:
    """Inverse of :func:`render_literal`: the text of the value, NULL for a bare NULL."""
    body = unescape_sql(literal.substr(F.lit(2), F.length(literal) - 2))
    e_body = unescape_sql(literal.substr(F.lit(3), F.length(literal) - 3))
    e_body = F.replace(e_body, F.lit("\\n"), F.lit("\n"))
    e_body = F.replace(e_body, F.lit("\\r"), F.lit("\r"))
    e_body = F.replace(e_body, F.lit("\\x5C"), F.lit("\\"))
    return (
        F.when(literal.startswith("E'"), e_body)
        .when(literal.startswith("'"), body)
        .when(literal == "NULL", F.lit(None).cast("string"))
        .otherwise(literal)
    )


def script_up(content: Column) -> Column:
    """Forward part of a change script; NULL when its marker is missing."""
    head = F.element_at(F.split(content, _quoted(fv.DOWN_MARKER)), 1)
    return _section(head, fv.UP_MARKER)


def script_down(content: Column) -> Column:
    """Backward part; NULL when the marker or its rule line is missing."""
    tail = F.try_element_at(F.split(content, _quoted(fv.DOWN_MARKER)), F.lit(2))
    return _section(tail, fv.DOWN_BODY_MARKER)


def script_error(content: Column) -> Column:
    """Which section is missing, or NULL."""
    tail = F.try_element_at(F.split(content, _quoted(fv.DOWN_MARKER)), F.lit(2))
    return (
        F.when(tail.isNull(), F.lit("does not contain rollback section"))
        .when(script_up(content).isNull(), F.lit("does not contain up migration section"))
        .when(script_down(content).isNull(), F.lit("does not contain valid rollback section"))
    )


def _quoted(marker: str) -> str:
    return "\\Q" + marker + "\\E"


def _section(text: Column, marker: str) -> Column:
    return F.trim(F.try_element_at(F.split(text, _quoted(marker)), F.lit(2)), F.lit(fv.WHITESPACE))
