"""Table contracts: the wanted shape of a table, as plain Python data."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from keelrow import fixed_values as fv

_TYPE_SHAPE = re.compile(r"^\s*([^()]*?)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)\s*(.*))?$")


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    on_delete: str = ""
    on_update: str = ""


@dataclass(frozen=True)
class Index:
    name: str
    columns: tuple[str, ...]
    unique: bool = False
    method: str = "btree"


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    primary: bool = False
    unique: bool = False
    not_null: bool = False
    default: str | None = None
    foreign_key: ForeignKey | None = None
    index: Index | None = None

    @property
    def required(self) -> bool:
        return self.not_null or self.primary

    @property
    def serial(self) -> bool:
        return type_parts(self.type)[0] in fv.SERIAL_TYPES


@dataclass(frozen=True)
class UniqueKey:
    columns: tuple[str, ...]
    kind: str          # "primary_key", "unique" or "unique_index"
    name: str = ""


@dataclass(frozen=True)
class TableContract:
    name: str
    columns: tuple[Column, ...]
    indexes: tuple[Index, ...] = field(default=())

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def key(self) -> tuple[str, ...]:
        return tuple(c.name for c in self.columns if c.primary)

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(f"table {self.name!r} has no column {name!r}")

    def has(self, name: str) -> bool:
        return name in self.names

    def with_column(self, column: Column) -> TableContract:
        """Replace the column of that name, or append it."""
        if self.has(column.name):
            return replace(self, columns=tuple(column if c.name == column.name else c for c in self.columns))
        return replace(self, columns=self.columns + (column,))

    def without_column(self, name: str) -> TableContract:
        self.column(name)
        return replace(
            self,
            columns=tuple(c for c in self.columns if c.name != name),
            indexes=tuple(i for i in self.indexes if name not in i.columns),
        )

    def renamed(self, old: str, new: str) -> TableContract:
        if self.has(new):
            raise ValueError(f"table {self.name!r} already has a column {new!r}")
        moved = replace(self.column(old), name=new)
        return replace(
            self,
            columns=tuple(moved if c.name == old else c for c in self.columns),
            indexes=tuple(
                replace(i, columns=tuple(new if c == old else c for c in i.columns)) for i in self.indexes
            ),
        )

    def all_indexes(self) -> list[Index]:
        """Table-level indexes, then column-level ones."""
        own = []
        for c in self.columns:
            if c.index is not None:
                own.append(replace(c.index, columns=c.index.columns or (c.name,)))
        return list(self.indexes) + own

    def unique_keys(self) -> list[UniqueKey]:
        keys: list[UniqueKey] = []
        if self.key:
            keys.append(UniqueKey(self.key, "primary_key"))
        keys += [UniqueKey((c.name,), "unique") for c in self.columns if c.unique]
        keys += [UniqueKey(i.columns, "unique_index", i.name) for i in self.all_indexes() if i.unique]
        return keys

    def references(self) -> list[tuple[str, ForeignKey]]:
        return [(c.name, c.foreign_key) for c in self.columns if c.foreign_key is not None]

    def struct(self) -> T.StructType:
        """Spark schema; the rules that Spark cannot hold travel as field metadata."""
        fields = []
        for c in self.columns:
            meta: dict = {"pg_type": c.type, "primary": c.primary, "unique": c.unique}
            if c.default is not None:
                meta["default"] = c.default
            if c.foreign_key is not None:
                meta["references"] = f"{c.foreign_key.table}.{c.foreign_key.column}"
            fields.append(T.StructField(c.name, spark_type(c.type), not c.required, meta))
        return T.StructType(fields)


def type_parts(pg_type: str) -> tuple[str, int | None, int | None]:
    """``numeric(10,2)`` -> ``("numeric", 10, 2)``."""
    m = _TYPE_SHAPE.match(pg_type.lower())
    if not m:
        return pg_type.lower().strip(), None, None
    base, first, second, tail = m.groups()
    if tail:
        base = f"{base} {tail}"
    return base.strip(), int(first) if first else None, int(second) if second else None


def spark_type(pg_type: str) -> T.DataType:
    base, first, second = type_parts(pg_type)
    if base in ("smallint", "smallserial"):
        return T.ShortType()
    if base in ("integer", "serial"):
        return T.IntegerType()
    if base in ("bigint", "bigserial"):
        return T.LongType()
    if base in fv.DECIMAL_TYPES:
        return T.DecimalType(first, second or 0) if first else T.DecimalType(38, 10)
    if base == "real":
        return T.FloatType()
    if base == "double precision":
        return T.DoubleType()
    if base in ("timestamp", "timestamp without time zone"):
        return T.TimestampNTZType()
    if base in ("timestamptz", "timestamp with time zone"):
        return T.TimestampType()
    if base == "date":
        return T.DateType()
    if base == "interval":
        return T.DayTimeIntervalType()
    if base in fv.BOOLEAN_TYPES:
        return T.BooleanType()
    if base in fv.BINARY_TYPES:
        return T.BinaryType()
    if base in fv.ARRAY_TYPES:
        return T.ArrayType(T.IntegerType() if base == "integer[]" else T.StringType())
    if base in fv.GEOMETRIC_TYPES + fv.TEXT_SEARCH_TYPES:
        raise ValueError(f"type {pg_type!r} has no Spark counterpart")
    if base in fv.SUPPORTED_TYPES:
        return T.StringType()
    raise ValueError(f"unsupported data type {pg_type!r}")


def pg_type(spark: T.DataType) -> str:
    """Column type that holds values of a Spark type (used when profiling data)."""
    if isinstance(spark, (T.ByteType, T.ShortType)):
        return "smallint"
    if isinstance(spark, T.IntegerType):
        return "integer"
    if isinstance(spark, T.LongType):
        return "bigint"
    if isinstance(spark, T.DecimalType):
        return f"numeric({spark.precision},{spark.scale})"
    if isinstance(spark, T.FloatType):
        return "real"
    if isinstance(spark, T.DoubleType):
        return "double precision"
    if isinstance(spark, T.BooleanType):
        return "boolean"
    if isinstance(spark, T.TimestampNTZType):
        return "timestamp"
    if isinstance(spark, T.TimestampType):
        return "timestamptz"
    if isinstance(spark, T.DateType):
        return "date"
    if isinstance(spark, T.BinaryType):
        return "bytea"
    if isinstance(spark, T.ArrayType):
        if isinstance(spark.elementType, T.IntegerType):
            return "integer[]"
        if isinstance(spark.elementType, T.StringType):
            return "text[]"
        return "jsonb"
    if isinstance(spark, (T.StructType, T.MapType)):
        return "jsonb"
    return "text"
