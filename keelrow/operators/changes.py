"""Inserting, updating and deleting rows.

Nothing is changed in place: every operation returns the new rows, to be written to a new path
and published when the checks pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelrow.contract import TableContract, spark_type
from keelrow.functions.defaults import default_value
from keelrow.functions.types import parse_value
from keelrow.functions.values import Ranges
from keelrow.operators import checks
from keelrow.operators.numbering import dense_numbers
from keelrow.operators.reach import hanging_on
from keelrow.session import cut_lineage

VIOLATIONS = "__violations"
RAW = "__raw"


class Refused(Exception):
    """A change that the contract does not allow.  ``details`` maps rules to row counts."""

    def __init__(self, what: str, details: Mapping[str, int]):
        self.details = dict(details)
        super().__init__(f"{what}: " + ", ".join(f"{k} ({v})" for k, v in sorted(self.details.items())))


# ---------------------------------------------------------------- defaults

def next_id(target: DataFrame, column: str) -> int:
    """The first free number of a generated column."""
    return int(target.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]) + 1


def apply_defaults(batch: DataFrame, contract: TableContract, next_ids: Mapping[str, int] | None = None,
                   order: Sequence[str] = ()) -> DataFrame:
    """Give absent columns their default, in contract order; an explicit NULL stays NULL.

    Generated columns continue from ``next_ids`` (1 if not given), numbered in ``order``.
    """
    unknown = [c for c in batch.columns if not contract.has(c)]
    if unknown:
        raise ValueError(f"columns not found in table {contract.name}: {', '.join(unknown)}")
    out = batch
    for c in contract.columns:
        if c.name in batch.columns:
            continue
        if c.serial and c.default is None:
            start = (next_ids or {}).get(c.name, 1)
            out = dense_numbers(out, c.name, order, start).withColumn(
                c.name, F.col(c.name).cast(spark_type(c.type))
            )
        else:
            out = out.withColumn(c.name, default_value(c.default, c.type))
    return out.select(*contract.names)


# ---------------------------------------------------------------- insert

@dataclass(frozen=True)
class Insert:
    rows: DataFrame       # target and accepted rows
    accepted: DataFrame   # typed rows that keep every rule
    rejected: DataFrame   # rows as they came, with the rules they break


def _flag_keys(rows: DataFrame, columns: Sequence[str], bad: DataFrame) -> DataFrame:
    """Add ``__rules`` of the keys in ``bad`` (one row per key) to the rows that hold them."""
    joined = rows.join(bad, list(columns), "left")
    none = F.array().cast("array<string>")
    return joined.withColumn(VIOLATIONS, F.concat(VIOLATIONS, F.coalesce("__rules", none))).drop("__rules")


def _bad_keys(rows: DataFrame, columns: Sequence[str], kind: str, known: DataFrame | None) -> DataFrame:
    """Keys that the batch repeats or that are taken already, with the rules they break."""
    name = ",".join(columns)
    held = checks.key_counts(rows, columns)
    repeated = F.when(F.col("n_rows") > 1, F.lit(f"{kind}:{name}"))
    if known is None:
        return held.filter("n_rows > 1").select(*columns, F.array(repeated).alias("__rules"))
    taken = known.select(*columns).distinct().withColumn("__taken", F.lit(True))
    exists = F.when(F.col("__taken"), F.lit(f"exists:{name}"))
    return held.join(taken, list(columns), "left").filter("n_rows > 1 OR __taken").select(
        *columns, F.array_compact(F.array(repeated, exists)).alias("__rules")
    )


def _lost_keys(rows: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    rule = F.array(F.lit(f"foreign_key:{column}")).alias("__rules")
    return checks.orphan_keys(rows, [column], parent, [parent_column]).select(column, rule)


def _lost_below(good: DataFrame, column: str, key: str, target: DataFrame | None, lost: DataFrame) -> DataFrame:
    """The lost keys, and those of the rows that go with them as far as good rows refer to them."""
    kind = good.schema[key].dataType
    held = good.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(column).cast(kind).alias("up"))
    if target is not None:
        # who refers to the target is safe and points no further
        held = held.join(target.select(F.col(key).cast(kind).alias("up")).distinct(), "up", "left_anti")
    marks = lost.select(F.col(column).cast(kind).alias("up"), F.lit(True).alias("gone"))
    nodes = held.join(marks, "up", "left").select("id", "up", F.coalesce("gone", F.lit(False)).alias("gone"))
    gone, _ = hanging_on(nodes, ["id"], ["up"])
    below = good.select(column).distinct().join(
        gone.select(F.col("id").cast(good.schema[column].dataType).alias(column)), column, "left_semi")
    rule = F.array(F.lit(f"foreign_key:{column}")).alias("__rules")
    return cut_lineage(lost.unionByName(below.select(column, rule)).distinct())


def _flag_own_references(tagged: DataFrame, column: str, key: str, target: DataFrame | None, unique: bool) -> DataFrame:
    """Rows may refer to rows of the same batch, but only to good ones.  A rejected row takes the rows that refer to
    it along, whatever the depth: pointers are doubled if no two good rows share the key (``unique``), else it goes
    wave by wave until no good row points nowhere."""
    while True:
        good = tagged.filter(F.size(VIOLATIONS) == 0)
        parent = good.select(key) if target is None else target.select(key).unionByName(good.select(key))
        lost = cut_lineage(_lost_keys(good, column, parent, key))
        if lost.isEmpty():
            return tagged
        if unique:
            return cut_lineage(_flag_keys(tagged, [column], _lost_below(good, column, key, target, lost)))
        tagged = cut_lineage(_flag_keys(tagged, [column], lost))


def tag_batch(batch: DataFrame, contract: TableContract, target: DataFrame | None = None,
              parents: Mapping[str, DataFrame] | None = None, materialize: bool = True) -> DataFrame:
    """Typed batch with the rules each row breaks and the row as it came.

    Row rules are expressions.  Keys are counted per value, so what is joined back is one row
    per offending key.  With ``materialize`` the typed rows are written once, so values are parsed
    and defaults drawn once, and the few offending keys are written too, so that Spark can
    broadcast them or split a hot key of the batch.  All rows of a key that the batch repeats
    are marked.
    """
    held = {f.name: f.dataType for f in batch.schema.fields}
    typed, same = [], set()
    for c in contract.columns:
        target_type = spark_type(c.type)
        if held[c.name] == target_type and isinstance(target_type, T.StringType):
            same.add(c.name)
        elif held[c.name] == target_type:
            typed.append(F.col(c.name))
        elif held[c.name].typeName() == "string":
            typed.append(parse_value(F.col(c.name), c.type).alias(c.name))
        else:
            typed.append(F.col(c.name).try_cast(target_type).alias(c.name))
    rules = [
        F.when(r.violated, F.lit(f"{r.type}:{r.column}")) for r in checks.row_rules(batch, contract)
    ]
    broken = F.array_compact(F.array(*rules)) if rules else F.array().cast("array<string>")
    rows = batch.select(F.struct(*batch.columns).alias(RAW), *typed, broken.alias(VIOLATIONS))
    if materialize:
        rows = cut_lineage(rows)
    # texts that stay as they came are written once
    rows = rows.select(RAW, *[F.col(f"{RAW}.`{n}`").alias(n) if n in same else F.col(f"`{n}`") for n in contract.names], VIOLATIONS)

    inside = _key_ranges(rows, contract).cut if materialize else (lambda df, column, own: df)
    flags: list[tuple[Sequence[str], DataFrame]] = []
    for key in contract.unique_keys():
        known = None if target is None else inside(target, key.columns[0], key.columns[0])
        flags.append((key.columns, _bad_keys(rows, key.columns, key.kind, known)))
    for column, fk in contract.references():
        parent = (parents or {}).get(fk.table)
        if parent is not None and fk.table != contract.name:
            flags.append(([column], _lost_keys(rows, column, inside(parent, fk.column, column), fk.column)))
    tagged = rows
    for columns, bad in flags:
        tagged = _flag_keys(tagged, columns, cut_lineage(bad) if materialize else bad)
    for column, fk in contract.references():
        if fk.table == contract.name:
            unique = (fk.column,) in [k.columns for k in contract.unique_keys()]
            tagged = _flag_own_references(tagged, column, fk.column, target, unique)
    return tagged.select(RAW, *contract.names, VIOLATIONS)


def _key_ranges(rows: DataFrame, contract: TableContract) -> Ranges:
    """Ranges of the batch's keys: where keys grow with time, old files of the target and of
    parents are then not read at all."""
    return Ranges(rows, sorted({k.columns[0] for k in contract.unique_keys()} | {c for c, _ in contract.references()}))


def insert(target: DataFrame, batch: DataFrame, contract: TableContract,
           parents: Mapping[str, DataFrame] | None = None, mode: str = "strict",
           next_ids: Mapping[str, int] | None = None, materialize: bool = True) -> Insert:
    """Validate a batch and append it.

    ``strict``: one bad row refuses the whole batch.  ``quarantine``: bad rows are set aside.
    The tagged batch is written once (``materialize``) where accepted and rejected rows both read it; a strict
    batch is whole or refused, so its check reads the few columns it needs.  See :func:`tag_batch` for what else is
    written.  Generated columns continue after the target's highest number.
    """
    if mode not in ("strict", "quarantine"):
        raise ValueError("mode is strict or quarantine")
    absent = [c.name for c in contract.columns if c.serial and c.default is None and c.name not in batch.columns]
    following = {c: next_id(target, c) for c in absent if c not in (next_ids or {})}
    complete = apply_defaults(batch, contract, {**following, **(next_ids or {})})
    tagged = tag_batch(complete, contract, target, parents, materialize)
    if materialize and mode != "strict":
        tagged = cut_lineage(tagged)
    accepted = tagged.filter(F.size(VIOLATIONS) == 0).select(*contract.names)
    rejected = tagged.filter(F.size(VIOLATIONS) > 0).select(
        f"{RAW}.*", F.col(VIOLATIONS).alias("violations")
    )
    if mode == "strict":
        broken = violation_counts(rejected).collect()      # one row per rule
        if broken:
            raise Refused(f"batch for {contract.name} refused", {r["rule"]: r["n_rows"] for r in broken})
    return Insert(target.select(*contract.names).unionByName(accepted), accepted, rejected)


def violation_counts(rejected: DataFrame) -> DataFrame:
    return rejected.select(F.explode("violations").alias("rule")).groupBy("rule").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def import_counts(tagged: DataFrame) -> DataFrame:
    """Rows taken and rows seen, of a tagged batch."""
    return tagged.agg(
        F.count_if(F.size(VIOLATIONS) == 0).alias("inserted_rows"), F.count(F.lit(1)).alias("total_rows")
    )


# ---------------------------------------------------------------- update

def _changed_columns(changes: DataFrame, contract: TableContract, key: Sequence[str],
                     set_columns: str | None) -> list[str]:
    names = [c for c in changes.columns if c not in key and c != set_columns]
    for n in names:
        if not contract.has(n):
            raise ValueError(f"column '{n}' does not exist in table '{contract.name}'")
    if not names:
        raise ValueError("no data to update")
    return names


def _typed(changes: DataFrame, contract: TableContract, name: str):
    held = changes.schema[name].dataType
    wanted = spark_type(contract.column(name).type)
    if held.typeName() == "string":
        return parse_value(F.col(name), contract.column(name).type)
    return F.col(name) if held == wanted else F.col(name).try_cast(wanted)


def _is_set(name: str, set_columns: str | None):
    return F.array_contains(F.col(set_columns), name) if set_columns else F.lit(True)


def check_update(target: DataFrame, changes: DataFrame, contract: TableContract,
                 key: Sequence[str] | None = None, set_columns: str | None = None) -> DataFrame:
    """Report on a set of changes: nulls, types, repeated keys, keys that match no row."""
    key = list(key or contract.key)
    names = _changed_columns(changes, contract, key, set_columns)
    rules = []
    for n in names:
        column = contract.column(n)
        chosen = _is_set(n, set_columns)
        if column.required:
            rules.append(checks.RowRule("not_null", n, f"{n} cannot be null", chosen & F.col(n).isNull()))
        rules.append(checks.RowRule("type", n, f"{n} must be {column.type}",
                                    chosen & F.col(n).isNotNull() & _typed(changes, contract, n).isNull()))
    unmatched = changes.select(*key).join(target.select(*key).distinct(), key, "left_anti")
    missing = unmatched.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit("not_found").alias("type"), F.lit(contract.name).alias("table"),
        F.lit(",".join(key)).alias("column"), F.lit("").alias("index"),
        F.lit("no row has this key").alias("message"),
        F.when(F.col("n_rows") > 0, F.lit("error")).otherwise(F.lit("info")).alias("severity"), "n_rows",
    )
    return checks.rule_rows(changes, contract.name, rules).unionByName(
        checks.check_unique(changes, key, contract.name, "repeated_key")
    ).unionByName(missing)


def _matched(target: DataFrame, changes: DataFrame, contract: TableContract, key: Sequence[str],
             names: Sequence[str], set_columns: str | None) -> DataFrame:
    new = changes.select(
        *key, F.lit(True).alias("__matched"),
        *[F.struct(_typed(changes, contract, n).alias("value")).alias(f"__new_{n}") if not set_columns
          else F.when(_is_set(n, set_columns), F.struct(_typed(changes, contract, n).alias("value"))).alias(f"__new_{n}")
          for n in names],
    )
    return target.join(new, list(key), "left")


def update(target: DataFrame, changes: DataFrame, contract: TableContract,
           key: Sequence[str] | None = None, set_columns: str | None = None, mode: str = "strict") -> DataFrame:
    """New rows after the changes.

    ``changes`` has the key and new values.  ``set_columns`` names an array column that lists
    which values of a row are meant; without it all are.  ``strict``: the report of
    :func:`check_update` is made first and its errors refuse the update.  ``ignore_unknown``: the
    same, but changes of keys that no row has are left out.
    """
    if mode not in ("strict", "ignore_unknown"):
        raise ValueError("mode is strict or ignore_unknown")
    kept = cut_lineage(changes)
    broken = checks.findings(check_update(target, kept, contract, key, set_columns)).collect()   # one row per rule
    refused = {f"{r['type']}:{r['column']}": r["n_rows"] for r in broken if mode == "strict" or r["type"] != "not_found"}
    if refused:
        raise Refused(f"update of {contract.name} refused", refused)
    return updated(target, kept, contract, key, set_columns)


def updated(target: DataFrame, changes: DataFrame, contract: TableContract,
            key: Sequence[str] | None = None, set_columns: str | None = None) -> DataFrame:
    """The rows after changes that were checked: a repeated key would repeat rows."""
    key = list(key or contract.key)
    names = _changed_columns(changes, contract, key, set_columns)
    joined = _matched(target, changes, contract, key, names, set_columns)
    out = []
    for c in target.columns:
        if c in names:
            new = F.col(f"__new_{c}")
            out.append(F.when(new.isNotNull(), new["value"]).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def rows_affected(target: DataFrame, changes: DataFrame, contract: TableContract,
                  key: Sequence[str] | None = None) -> DataFrame:
    """Target rows that the changes reach.  Target rows are counted per key before the join."""
    key = list(key or contract.key)
    return checks.key_counts(target, key).join(changes.select(*key), key, "left_semi").agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).cast("long").alias("rows_affected")
    )


# ---------------------------------------------------------------- delete

def delete(target: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key is not listed; ``keys`` has the key columns."""
    return target.join(keys, keys.columns, "left_anti").select(*target.columns)


def deleted_rows(target: DataFrame, keys: DataFrame) -> DataFrame:
    return target.join(keys, keys.columns, "left_semi").select(*target.columns)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
