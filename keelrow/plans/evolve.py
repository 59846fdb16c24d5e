"""Evolving tables: ten operations on data, their inverses, and plans of several.

Operations are transforms; a plan of many stays one job.  What a database would refuse on the
rows is carried along as flags next to the rows and counted in one aggregate per table.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from itertools import count

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelrow.contract import Column, ForeignKey, Index, TableContract, spark_type
from keelrow.functions.defaults import default_value
from keelrow.functions.types import breaks_text_rule, parse_value
from keelrow.operators import checks
from keelrow.operators.catalog_diff import ORDER
from keelrow.operators.changes import Refused, union_all
from keelrow.operators.numbering import dense_numbers


@dataclass(frozen=True)
class Operation:
    kind: str
    table: str
    column: Column | None = None
    old_column: Column | None = None
    new_name: str = ""
    foreign_key: ForeignKey | None = None
    index: Index | None = None
    contract: TableContract | None = None


def create_table(contract: TableContract) -> Operation:
    return Operation("CREATE_TABLE", contract.name, contract=contract)


def drop_table(contract: TableContract) -> Operation:
    return Operation("DROP_TABLE", contract.name, contract=contract)


def add_column(table: str, column: Column) -> Operation:
    return Operation("ADD_COLUMN", table, column=column)


def drop_column(table: str, old: Column) -> Operation:
    return Operation("DROP_COLUMN", table, old_column=old)


def modify_column(table: str, new: Column, old: Column) -> Operation:
    return Operation("MODIFY_COLUMN", table, column=new, old_column=old)


def rename_column(table: str, old: Column, new_name: str) -> Operation:
    return Operation("RENAME_COLUMN", table, old_column=old, new_name=new_name)


def add_foreign_key(table: str, column: Column, fk: ForeignKey) -> Operation:
    return Operation("ADD_FOREIGN_KEY", table, column=column, foreign_key=fk)


def drop_foreign_key(table: str, column: Column, fk: ForeignKey) -> Operation:
    return Operation("DROP_FOREIGN_KEY", table, column=column, foreign_key=fk)


def create_index(table: str, index: Index) -> Operation:
    return Operation("CREATE_INDEX", table, index=index)


def drop_index(table: str, index: Index) -> Operation:
    return Operation("DROP_INDEX", table, index=index)


_INVERSE_KIND = {
    "CREATE_TABLE": "DROP_TABLE", "DROP_TABLE": "CREATE_TABLE", "ADD_COLUMN": "DROP_COLUMN",
    "DROP_COLUMN": "ADD_COLUMN", "MODIFY_COLUMN": "MODIFY_COLUMN", "RENAME_COLUMN": "RENAME_COLUMN",
    "ADD_FOREIGN_KEY": "DROP_FOREIGN_KEY", "DROP_FOREIGN_KEY": "ADD_FOREIGN_KEY",
    "CREATE_INDEX": "DROP_INDEX", "DROP_INDEX": "CREATE_INDEX",
}


def inverse(op: Operation) -> Operation:
    """The operation that undoes another.  A dropped column comes back with its definition but
    without its values; :func:`restore_column` brings those from the version before."""
    kind = _INVERSE_KIND[op.kind]
    if op.kind == "RENAME_COLUMN":
        return replace(op, old_column=replace(op.old_column, name=op.new_name), new_name=op.old_column.name)
    if op.kind in ("ADD_COLUMN", "DROP_COLUMN", "MODIFY_COLUMN"):
        return replace(op, kind=kind, column=op.old_column, old_column=op.column)
    return replace(op, kind=kind)


def inverses(ops: Sequence[Operation]) -> list[Operation]:
    return [inverse(op) for op in reversed(ops)]


# ---------------------------------------------------------------- contracts

def _update(contracts: dict[str, TableContract], table: str) -> TableContract:
    if table not in contracts:
        raise ValueError(f"table {table!r} does not exist")
    return contracts[table]


def _point_to(contracts: dict[str, TableContract], table: str, old: str, new: str) -> None:
    """References follow a renamed column."""
    for name, contract in contracts.items():
        moved = tuple(
            replace(c, foreign_key=replace(c.foreign_key, column=new))
            if c.foreign_key and (c.foreign_key.table, c.foreign_key.column) == (table, old) else c
            for c in contract.columns
        )
        contracts[name] = replace(contract, columns=moved)


def preview(contracts: Mapping[str, TableContract], ops: Iterable[Operation]) -> dict[str, TableContract]:
    """Contracts after the operations, without touching data; impossible plans raise."""
    out = dict(contracts)
    for op in ops:
        if op.kind == "CREATE_TABLE":
            if op.table in out:
                raise ValueError(f"table {op.table!r} exists")
            op.contract.struct()       # refuses types that no Spark type can hold
            out[op.table] = op.contract
            continue
        contract = _update(out, op.table)
        if op.kind == "DROP_TABLE":
            users = [f"{c.name}.{n}" for c in out.values() for n, fk in c.references()
                     if fk.table == op.table and c.name != op.table]
            if users:
                raise Refused(f"table {op.table} is referred to", {u: 1 for u in users})
            del out[op.table]
        elif op.kind == "ADD_COLUMN":
            if contract.has(op.column.name):
                raise ValueError(f"column {op.column.name!r} exists in {op.table!r}")
            spark_type(op.column.type)
            out[op.table] = contract.with_column(op.column)
        elif op.kind == "DROP_COLUMN":
            name = op.old_column.name
            users = [f"{c.name}.{n}" for c in out.values() for n, fk in c.references()
                     if (fk.table, fk.column) == (op.table, name)]
            if users:
                raise Refused(f"column {op.table}.{name} is referred to", {u: 1 for u in users})
            out[op.table] = contract.without_column(name)
        elif op.kind == "MODIFY_COLUMN":
            current = contract.column(op.column.name)
            spark_type(op.column.type)
            out[op.table] = contract.with_column(replace(
                current, type=op.column.type, not_null=op.column.not_null, default=op.column.default
            ))
        elif op.kind == "RENAME_COLUMN":
            out[op.table] = contract.renamed(op.old_column.name, op.new_name)
            _point_to(out, op.table, op.old_column.name, op.new_name)
        elif op.kind == "ADD_FOREIGN_KEY":
            target = _update(out, op.foreign_key.table)
            target.column(op.foreign_key.column)
            if not any(tuple(k.columns) == (op.foreign_key.column,) for k in target.unique_keys()):
                raise ValueError(f"{op.foreign_key.table}.{op.foreign_key.column} is not a unique key")
            out[op.table] = contract.with_column(
                replace(contract.column(op.column.name), foreign_key=op.foreign_key)
            )
        elif op.kind == "DROP_FOREIGN_KEY":
            # a dropped column took its reference along
            if contract.has(op.column.name):
                out[op.table] = contract.with_column(replace(contract.column(op.column.name), foreign_key=None))
        elif op.kind == "CREATE_INDEX":
            for c in op.index.columns:
                contract.column(c)
            out[op.table] = replace(contract, indexes=contract.indexes + (op.index,))
        elif op.kind == "DROP_INDEX":
            out[op.table] = replace(contract, indexes=tuple(i for i in contract.indexes if i.name != op.index.name))
        else:
            raise ValueError(f"unsupported operation {op.kind!r}")
    return out


# ---------------------------------------------------------------- data

@dataclass
class _Check:
    """A rule that the rows must meet as long as its columns, its table and the rule itself are there at the end."""

    table: str
    columns: list[str]
    report: DataFrame
    index: str = ""
    reference: bool = False


def _still_asked(pending: list[_Check], op: Operation) -> list[_Check]:
    """What an operation leaves of the rules that earlier steps of its plan brought; names follow a rename."""
    out = []
    for check in pending:
        if check.table == op.table:
            if op.kind == "RENAME_COLUMN":
                check.columns = [op.new_name if c == op.old_column.name else c for c in check.columns]
            gone = (
                op.kind == "DROP_TABLE"
                or (op.kind == "DROP_COLUMN" and op.old_column.name in check.columns)
                or (op.kind == "DROP_FOREIGN_KEY" and check.reference and op.column.name in check.columns)
                or (op.kind == "DROP_INDEX" and check.index == op.index.name)
            )
            if gone:
                continue
        out.append(check)
    return out


@dataclass
class Evolution:
    tables: dict[str, DataFrame]
    contracts: dict[str, TableContract]
    reports: list[DataFrame] = field(default_factory=list)

    def report(self) -> DataFrame | None:
        """One row per condition the rows must meet."""
        return union_all(self.reports) if self.reports else None

    def require_allowed(self) -> Evolution:
        report = self.report()
        if report is not None:
            broken = checks.findings(report).collect()     # one row per broken condition
            if broken:
                raise Refused("evolution refused", {
                    f"{r['type']}:{r['table']}.{r['column']}": r["n_rows"] for r in broken
                })
        return self


def cast_value(value: SparkColumn, held: T.DataType, pg_type: str) -> SparkColumn:
    """A value in another type; NULL where it cannot be cast.  Fractions round to integers."""
    target = spark_type(pg_type)
    if isinstance(held, T.StringType):
        return parse_value(value, pg_type)
    if isinstance(target, T.IntegralType) and isinstance(held, (T.FloatType, T.DoubleType)):
        return F.rint(value).try_cast(target)
    if isinstance(target, T.IntegralType) and isinstance(held, T.DecimalType):
        return F.round(value).try_cast(target)
    if isinstance(target, T.StringType):
        text = F.to_json(value) if isinstance(held, (T.ArrayType, T.MapType, T.StructType)) else value.cast("string")
        return F.when(~breaks_text_rule(text, pg_type), text)
    return value.try_cast(target)


def evolve(tables: Mapping[str, DataFrame], contracts: Mapping[str, TableContract],
           ops: Sequence[Operation]) -> Evolution:
    """Apply operations in order.  Check the report (``require_allowed``) before publishing.

    A rule that one step brings and a later one takes back, with its column or alone, is not asked of the rows.
    """
    rows = dict(tables)
    state = dict(contracts)
    # flag columns with their rules and the columns they are about, by their names now
    flags: dict[str, list[tuple[str, checks.RowRule, str]]] = {}
    numbers = count()
    pending: list[_Check] = []
    # columns whose values changed type, by their names at the end, and whether different values may be equal now
    retyped: dict[tuple[str, str], bool] = {}

    def flag(table: str, kind: str, column: str, text: str, violated: SparkColumn) -> None:
        name = f"__refused_{next(numbers)}"
        rows[table] = rows[table].withColumn(name, violated)
        flags.setdefault(table, []).append((name, checks.RowRule(kind, column, text, F.col(name)), column))

    for op in ops:
        after = preview(state, [op])
        pending = _still_asked(pending, op)
        if op.kind == "CREATE_TABLE":
            spark = next(iter(tables.values())).sparkSession if tables else SparkSession.active()
            rows[op.table] = spark.createDataFrame([], op.contract.struct())
        elif op.kind == "DROP_TABLE":
            rows.pop(op.table)
            flags.pop(op.table, None)
        elif op.kind == "ADD_COLUMN":
            c = op.column
            if c.serial and c.default is None:
                rows[op.table] = dense_numbers(rows[op.table], c.name).withColumn(
                    c.name, F.col(c.name).cast(spark_type(c.type)))
            else:
                rows[op.table] = rows[op.table].withColumn(c.name, default_value(c.default, c.type))
            if c.required and not c.serial:
                flag(op.table, "not_null", c.name, f"{c.name} must not be null", F.col(c.name).isNull())
            if c.unique or c.primary:
                pending.append(_Check(op.table, [c.name], checks.check_unique(rows[op.table], [c.name], op.table)))
            if c.foreign_key is not None:
                fk = c.foreign_key
                pending.append(_Check(op.table, [c.name], checks.check_foreign_key(
                    rows[op.table], [c.name], rows[fk.table], [fk.column], op.table, fk.table), reference=True))
        elif op.kind == "DROP_COLUMN":
            name = op.old_column.name
            rows[op.table] = rows[op.table].drop(name, *[f for f, _, c in flags.get(op.table, []) if c == name])
            flags[op.table] = [flag for flag in flags.get(op.table, []) if flag[2] != name]
            retyped.pop((op.table, name), None)
        elif op.kind == "MODIFY_COLUMN":
            name = op.column.name
            held = rows[op.table].schema[name].dataType
            old = "__old"
            if spark_type(op.column.type) != held or op.column.type.lower() != state[op.table].column(name).type.lower():
                rows[op.table] = rows[op.table].withColumn(old, F.col(name)).withColumn(
                    name, cast_value(F.col(old), held, op.column.type))
                flag(op.table, "type", name, f"{name} must be {op.column.type}",
                     F.col(old).isNotNull() & F.col(name).isNull())
                if op.column.not_null:
                    flag(op.table, "not_null", name, f"{name} must not be null", F.col(old).isNull())
                rows[op.table] = rows[op.table].drop(old)
                retyped[op.table, name] = retyped.get((op.table, name), False) or _may_merge(held, op.column.type)
            elif op.column.not_null:
                flag(op.table, "not_null", name, f"{name} must not be null", F.col(name).isNull())
        elif op.kind == "RENAME_COLUMN":
            rows[op.table] = rows[op.table].withColumnRenamed(op.old_column.name, op.new_name)
            flags[op.table] = [
                (f, r, op.new_name if c == op.old_column.name else c) for f, r, c in flags.get(op.table, [])]
            if (op.table, op.old_column.name) in retyped:
                retyped[op.table, op.new_name] = retyped.pop((op.table, op.old_column.name))
        elif op.kind == "ADD_FOREIGN_KEY":
            fk = op.foreign_key
            pending.append(_Check(op.table, [op.column.name], checks.check_foreign_key(
                rows[op.table], [op.column.name], rows[fk.table], [fk.column], op.table, fk.table), reference=True))
        elif op.kind == "CREATE_INDEX" and op.index.unique:
            pending.append(_Check(op.table, list(op.index.columns), checks.check_unique(
                rows[op.table], op.index.columns, op.table, "unique_index", op.index.name), op.index.name))
        state = after
    reports = [check.report for check in pending]
    for table, rules in flags.items():
        if not rules:
            continue
        reports.append(checks.rule_rows(rows[table], table, [rule for _, rule, _ in rules]))
        rows[table] = rows[table].drop(*[name for name, _, _ in rules])
    reports += _recheck(rows, state, retyped)
    return Evolution(rows, state, reports)


def _may_merge(held: T.DataType, pg_type: str) -> bool:
    """Whether a cast can make different values equal; integers stay apart as text and as other integers."""
    return not (isinstance(held, T.IntegralType) and isinstance(spark_type(pg_type), (T.StringType, T.IntegralType)))


def _recheck(rows: Mapping[str, DataFrame], state: Mapping[str, TableContract],
             retyped: Mapping[tuple[str, str], bool]) -> list[DataFrame]:
    """Keys and references, in both directions, of columns whose type changed: values that differed may be equal now."""
    reports = []
    for name, contract in state.items():
        for key in contract.unique_keys():
            if any(retyped.get((name, c), False) for c in key.columns):
                reports.append(checks.check_unique(rows[name], key.columns, name, key.kind, key.name))
        for column, fk in contract.references():
            if fk.table in rows and ((name, column) in retyped or (fk.table, fk.column) in retyped):
                reports.append(checks.check_foreign_key(rows[name], [column], rows[fk.table], [fk.column], name, fk.table))
    return reports


def restore_column(current: DataFrame, previous: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """Bring a dropped column's values back from the version before, by key."""
    old = previous.select(*key, F.col(column).alias("__old"))
    return current.drop(column).join(old, list(key), "left").withColumnRenamed("__old", column)


def operations_of(diff: DataFrame, wanted: Mapping[str, TableContract],
                  existing: Mapping[str, TableContract]) -> list[Operation]:
    """Turn the operations of a catalog diff into a plan.  The diff of contracts is as small
    as the contracts are, so it may come to the driver."""
    ops: list[Operation] = []
    links: list[Operation] = []
    drops: list[Operation] = []
    for r in diff.orderBy(*ORDER).collect():
        table, name, kind = r["table_name"], r["column_name"], r["kind"]
        if kind == "CREATE_TABLE":
            bare = tuple(replace(c, foreign_key=None, index=None) for c in wanted[table].columns)
            ops.append(create_table(replace(wanted[table], columns=bare, indexes=())))
        elif kind == "DROP_TABLE":
            old = existing[table]
            ops += [drop_foreign_key(table, old.column(c), fk) for c, fk in old.references()]
            drops.append(drop_table(old))
        elif kind == "ADD_COLUMN":
            ops.append(add_column(table, replace(wanted[table].column(name), foreign_key=None, index=None)))
        elif kind == "DROP_COLUMN":
            ops.append(drop_column(table, existing[table].column(name)))
        elif kind == "MODIFY_COLUMN":
            ops.append(modify_column(table, wanted[table].column(name), existing[table].column(name)))
        elif kind == "CREATE_INDEX":
            found = next(i for i in wanted[table].all_indexes() if i.name == r["index_name"])
            ops.append(create_index(table, found))
        elif kind == "ADD_FOREIGN_KEY":
            column = wanted[table].column(name)
            links.append(add_foreign_key(table, column, column.foreign_key))
        elif kind == "DROP_FOREIGN_KEY":
            column = existing[table].column(name)
            ops.append(drop_foreign_key(table, column, column.foreign_key))
    # references come last, when the tables they point to are there
    return ops + links + drops
