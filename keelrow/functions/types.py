"""Column-type expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelrow import fixed_values as fv
from keelrow.contract import spark_type, type_parts


def constant_map(pairs) -> Column:
    """A literal map column; folded by the optimiser, so no join and no broadcast is needed."""
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(pairs)])


def constant_lists(pairs) -> Column:
    return F.create_map(
        *chain.from_iterable((F.lit(k), F.array(*[F.lit(v) for v in vs])) for k, vs in pairs)
    )


def _allowed_types() -> dict[str, tuple[str, ...]]:
    allowed = {}
    for group in fv.TYPE_ALIAS_GROUPS:
        for name in group:
            allowed[name] = tuple(other for other in group if other != name)
    allowed.update(dict(fv.ONE_WAY_ALIASES))
    return allowed


def base_type(t: Column) -> Column:
    """``numeric(10,2)`` -> ``numeric``."""
    return F.substring_index(F.lower(F.trim(t)), "(", 1)


def is_compatible_type(existing: Column, wanted: Column) -> Column:
    """The wanted type is the existing one or a listed stand-in for it (not symmetric)."""
    old, new = base_type(existing), base_type(wanted)
    stand_ins = F.coalesce(
        F.array_contains(F.try_element_at(constant_lists(_allowed_types().items()), old), new), F.lit(False)
    )
    return (old == new) | stand_ins


def is_significant_type_change(existing: Column, wanted: Column) -> Column:
    """Both types belong to a known class and the classes differ."""
    classes = constant_map((name, cls) for cls, names in fv.TYPE_CHANGE_CLASSES for name in names)
    old = F.try_element_at(classes, base_type(existing))
    new = F.try_element_at(classes, base_type(wanted))
    return F.coalesce(old != new, F.lit(False))


def supported_type(t: Column, exact: bool = False) -> Column:
    """``exact`` refuses sizes in parentheses; otherwise only the base type counts."""
    name = F.lower(t) if exact else F.regexp_replace(F.lower(F.trim(t)), r"\s*\([^)]*\)", "")
    return name.isin(*fv.SUPPORTED_TYPES)


def infer_type(source: Column) -> Column:
    """Column type for a source-language type name."""
    return F.coalesce(
        F.try_element_at(constant_map(fv.INFERRED_TYPES), source),
        F.when(source.startswith("[]"), F.lit("jsonb"))
        .when(source.contains("time.Time"), F.lit("timestamp"))
        .when(source.contains("uuid.UUID"), F.lit("uuid"))
        .otherwise(F.lit("text")),
    )


# The shape of text that stands for a type Spark keeps as string.
TEXT_SHAPES = {
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "time": r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,6})?)?$",
    "timetz": r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,6})?)?(Z|[+-]\d{2}(:?\d{2})?)$",
    "macaddr": r"^([0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}$",
    "macaddr8": r"^([0-9a-fA-F]{2}[:-]){7}[0-9a-fA-F]{2}$",
    "inet": r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)(/(3[0-2]|[12]?\d))?$"
            r"|^[0-9a-fA-F:]*:[0-9a-fA-F:.]*(/(12[0-8]|1[01]\d|\d?\d))?$",
    "bit": r"^[01]+$",
}
_SHAPE_OF = {
    "uuid": "uuid", "time": "time", "timetz": "timetz", "time with time zone": "timetz",
    "macaddr": "macaddr", "macaddr8": "macaddr8", "inet": "inet", "cidr": "inet",
    "bit": "bit", "bit varying": "bit",
}


# The shape of numbers and truth values.  Text of another shape is not tried,
# because a parse that fails is slow.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
FLOAT = NUMBER[:-1] + r"$|(?i)^\s*([+-]?inf(inity)?|nan)\s*$"

TRUTH = ("t", "true", "y", "yes", "1", "f", "false", "n", "no", "0")


def parse_value(value: Column, pg_type: str) -> Column:
    """Text -> typed value, NULL when it does not conform."""
    target = spark_type(pg_type)
    base, _, _ = type_parts(pg_type)
    if isinstance(target, T.StringType):
        return F.when(~breaks_text_rule(value, pg_type), value)
    if isinstance(target, T.BinaryType):
        return F.try_to_binary(F.regexp_replace(value, r"^\\x", ""), F.lit("hex"))
    if isinstance(target, T.ArrayType):
        return F.from_json(value, target)
    if base in fv.INTEGER_TYPES + fv.SERIAL_TYPES:
        # a whole number may be written with a zero fraction, a broken one may not
        whole = F.substring_index(value, ".", 1)
        return F.when(value.rlike(r"^\s*[+-]?\d+(\.0*)?\s*$"), whole.try_cast(target))
    if base in fv.BOOLEAN_TYPES:
        return F.when(F.lower(F.trim(value)).isin(*TRUTH), value.try_cast(target))
    if base in fv.DECIMAL_TYPES:
        return F.when(value.rlike(NUMBER), value.try_cast(target))
    if base in fv.FLOAT_TYPES:
        return F.when(value.rlike(FLOAT), value.try_cast(target))
    return value.try_cast(target)


def breaks_text_rule(value: Column, pg_type: str) -> Column:
    """A string value that its declared type does not allow; NULL breaks nothing."""
    base, size, _ = type_parts(pg_type)
    if base in fv.JSON_TYPES:
        broken = F.try_parse_json(value).isNull()
    elif base in _SHAPE_OF:
        broken = ~value.rlike(TEXT_SHAPES[_SHAPE_OF[base]])
        if base == "bit" and size:
            broken = broken | (F.length(value) != size)
        if base == "bit varying" and size:
            broken = broken | (F.length(value) > size)
    elif base in ("varchar", "character varying", "char", "character") and size:
        broken = F.length(value) > size
    else:
        return F.lit(False)
    return value.isNotNull() & broken


def violates_type(value: Column, held_as: T.DataType, pg_type: str) -> Column | None:
    """True where a non-NULL value does not fit the declared type.

    ``held_as`` is the Spark type the data has now.  None means that no value can break the
    rule, so the column need not be read.
    """
    target = spark_type(pg_type)
    base, size, _ = type_parts(pg_type)
    if isinstance(held_as, T.StringType):
        if isinstance(target, T.StringType):
            if base in fv.JSON_TYPES or base in _SHAPE_OF or (base != "text" and size):
                return breaks_text_rule(value, pg_type)
            return None
        return value.isNotNull() & parse_value(value, pg_type).isNull()
    if isinstance(target, T.StringType):
        sized = base in ("varchar", "character varying", "char", "character") and size
        # the value as it would be written
        return value.isNotNull() & (F.length(value.cast("string")) > size) if sized else None
    if held_as == target:
        return None
    if base in fv.INTEGER_TYPES + fv.SERIAL_TYPES and isinstance(
        held_as, (T.FloatType, T.DoubleType, T.DecimalType)
    ):
        return value.isNotNull() & (value.try_cast(target).isNull() | (value != F.floor(value)))
    return value.isNotNull() & value.try_cast(target).isNull()


def conforms(value: Column, pg_type: str) -> Column:
    """Whether a text value may be written to a column of that type (NULL may)."""
    return value.isNull() | parse_value(value, pg_type).isNotNull()
