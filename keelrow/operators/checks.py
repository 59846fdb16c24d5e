"""Contract checks on data.

Every check is a query.  A report has one row per rule with the number of rows that break it;
``findings`` keeps the broken ones.  The rules that look at one row at a time share a single
aggregate over a single scan; keys and references are counted per value before anything is
joined, so a value held by a third of all rows costs one row in the shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelrow.contract import TableContract
from keelrow.functions.types import violates_type
from keelrow.session import cut_lineage

REPORT_COLUMNS = ("type", "table", "column", "index", "message", "severity", "n_rows")
_RULE_SHAPE = (
    "array<struct<`type`: string, `table`: string, `column`: string, `index`: string, message: string>>"
)


@dataclass(frozen=True)
class Rule:
    """What a check is about; its place in a list is its number."""

    type: str
    table: str
    column: str
    index: str
    message: str


# the rows of a key, under a name that no key column has
_HELD = "__held"


@dataclass(frozen=True)
class RowRule:
    """A rule about single rows; ``violated`` is a predicate over the table."""

    type: str
    column: str
    message: str
    violated: Column


def _described(counts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Report rows from ``(rule number, n_rows)``.  The texts are one constant, looked up by number."""
    texts = F.from_json(F.lit(json.dumps([asdict(r) for r in rules])), _RULE_SHAPE)
    return counts.select(F.get(texts, F.col("rule")).alias("r"), "n_rows").select(
        "r.type", "r.table", "r.column", "r.index", "r.message",
        F.expr("CASE WHEN n_rows > 0 THEN 'error' ELSE 'info' END AS severity"), "n_rows",
    )


def _count_row_rules(df: DataFrame, rules: Sequence[RowRule], first: int) -> DataFrame:
    """``(rule, n_rows)`` of all row rules of a table from one aggregate."""
    if not rules:
        return df.sparkSession.createDataFrame([], "rule int, n_rows long")
    names = [f"v{i}" for i in range(len(rules))]
    counts = df.agg(*[F.count_if(r.violated).alias(n) for n, r in zip(names, rules)])
    return counts.select(F.posexplode(F.array(*names)).alias("rule", "n_rows")).select(
        F.expr(f"rule + {first} AS rule"), "n_rows"
    )


def rule_rows(df: DataFrame, table: str, rules: Sequence[RowRule]) -> DataFrame:
    """One report row per rule from one pass over ``df``."""
    return _described(
        _count_row_rules(df, rules, 0), [Rule(r.type, table, r.column, "", r.message) for r in rules]
    )


def row_rules(df: DataFrame, contract: TableContract) -> list[RowRule]:
    """Required values and type rules of a contract, as predicates over ``df``."""
    rules = []
    held = {f.name: f.dataType for f in df.schema.fields}
    for c in contract.columns:
        if c.name not in held:
            continue
        if c.required:
            rules.append(not_null_rule(c.name))
        broken = violates_type(F.col(c.name), held[c.name], c.type)
        if broken is not None:
            rules.append(RowRule("type", c.name, f"{c.name} must be {c.type}", broken))
    return rules


def not_null_rule(column: str) -> RowRule:
    return RowRule("not_null", column, f"{column} must not be null", F.col(column).isNull())


def check_rows(df: DataFrame, contract: TableContract) -> DataFrame:
    """NOT NULL and type rules of one table in one aggregate; no row where no rule applies."""
    return rule_rows(df, contract.name, row_rules(df, contract))


def check_not_null(df: DataFrame, columns: Sequence[str], table: str = "") -> DataFrame:
    return rule_rows(df, table, [not_null_rule(c) for c in columns])


def _all_filled(columns: Sequence[str]) -> str:
    return " AND ".join(f"{_name(c)} IS NOT NULL" for c in columns)


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def key_counts(df: DataFrame, columns: Sequence[str], alias: str = "n_rows") -> DataFrame:
    """Rows per complete key; keys with a NULL part never count as equal."""
    return df.filter(_all_filled(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias(alias))


def duplicate_keys(df: DataFrame, columns: Sequence[str], alias: str = "n_rows") -> DataFrame:
    """Keys held by more than one row, with their row counts under ``alias``."""
    return key_counts(df, columns, alias).filter(F.col(alias) > 1)


def duplicate_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows that share their key with another row."""
    repeated = cut_lineage(duplicate_keys(df, columns, _HELD).select(*columns))
    return df.join(repeated, list(columns), "left_semi")


def _count_excess(df: DataFrame, columns: Sequence[str], rule: int) -> DataFrame:
    return key_counts(df, columns, _HELD).filter(F.col(_HELD) > 1).agg(
        F.expr(f"{rule} AS rule"), F.expr(f"coalesce(sum({_HELD} - 1), 0L) AS n_rows")
    )


def _unique_rule(columns: Sequence[str], table: str, kind: str, index: str) -> Rule:
    name = ",".join(columns)
    return Rule(kind, table, name, index, f"{name} must be unique")


def check_unique(df: DataFrame, columns: Sequence[str], table: str = "", kind: str = "unique",
                 index: str = "") -> DataFrame:
    """Rows in excess of one per key."""
    return _described(_count_excess(df, columns, 0), [_unique_rule(columns, table, kind, index)])


def check_primary_key(df: DataFrame, columns: Sequence[str], table: str = "") -> DataFrame:
    """Unique and complete."""
    return check_not_null(df, columns, table).unionByName(
        check_unique(df, columns, table, kind="primary_key")
    )


def _as_parent(child: DataFrame, columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]) -> DataFrame:
    """Child keys held as text take the parent's type; one that cannot be cast is left to the type rules."""
    out = child
    for c, p in zip(columns, parent_columns):
        held, wanted = child.schema[c].dataType, parent.schema[p].dataType
        if isinstance(held, T.StringType) and not isinstance(wanted, T.StringType):
            out = out.withColumn(c, F.col(c).try_cast(wanted))
    return out


def orphan_keys(child: DataFrame, columns: Sequence[str], parent: DataFrame,
                parent_columns: Sequence[str], alias: str = "n_rows") -> DataFrame:
    """Child key values without a parent row, with the number of child rows that hold them.

    The child is reduced to one row per value first.  That aggregate is hash-partitioned by the
    key, so only the parent's key column has to be moved for the join; it is reduced as well.
    """
    held = key_counts(_as_parent(child, columns, parent, parent_columns), columns, alias)
    known = parent.select(*[F.col(p).alias(c) for c, p in zip(columns, parent_columns)]).distinct()
    return held.join(known, list(columns), "left_anti")


def orphan_rows(child: DataFrame, columns: Sequence[str], parent: DataFrame,
                parent_columns: Sequence[str]) -> DataFrame:
    """The child rows whose key has no parent row."""
    lost = cut_lineage(orphan_keys(child, columns, parent, parent_columns, _HELD).select(*columns))
    # the keys of the child in the parent's type find the lost ones
    typed = _as_parent(child, columns, parent, parent_columns)
    if typed is child:
        return child.join(lost, list(columns), "left_semi")
    keys = [f"__key_{i}" for i in range(len(columns))]
    return child.withColumns({k: F.col(c).try_cast(lost.schema[c].dataType) for k, c in zip(keys, columns)}).join(
        lost.toDF(*keys), keys, "left_semi").select(*child.columns)


def _count_orphans(child: DataFrame, columns: Sequence[str], parent: DataFrame,
                   parent_columns: Sequence[str], rule: int) -> DataFrame:
    return orphan_keys(child, columns, parent, parent_columns, _HELD).agg(
        F.expr(f"{rule} AS rule"), F.expr(f"coalesce(sum({_HELD}), 0L) AS n_rows")
    )


def _reference_rule(columns: Sequence[str], parent_columns: Sequence[str], table: str, parent_table: str) -> Rule:
    name = ",".join(columns)
    return Rule("foreign_key", table, name, "", f"{name} must exist in {parent_table}.{','.join(parent_columns)}")


def check_foreign_key(child: DataFrame, columns: Sequence[str], parent: DataFrame,
                      parent_columns: Sequence[str], table: str = "", parent_table: str = "") -> DataFrame:
    return _described(
        _count_orphans(child, columns, parent, parent_columns, 0),
        [_reference_rule(columns, parent_columns, table, parent_table)],
    )


def contract_report(tables: Mapping[str, DataFrame], contracts: Sequence[TableContract]) -> DataFrame:
    """Every rule of every contract, one row per rule."""
    rules: list[Rule] = []
    parts: list[DataFrame] = []
    for contract in contracts:
        df = tables[contract.name]
        missing = [n for n in contract.names if n not in df.columns]
        if missing:
            raise ValueError(f"table {contract.name!r} lacks columns {missing}")
        about_rows = row_rules(df, contract)
        if about_rows:
            parts.append(_count_row_rules(df, about_rows, len(rules)))
            rules += [Rule(r.type, contract.name, r.column, "", r.message) for r in about_rows]
        for key in contract.unique_keys():
            parts.append(_count_excess(df, key.columns, len(rules)))
            rules.append(_unique_rule(key.columns, contract.name, key.kind, key.name))
        for column, fk in contract.references():
            parts.append(_count_orphans(df, [column], tables[fk.table], [fk.column], len(rules)))
            rules.append(_reference_rule([column], [fk.column], contract.name, fk.table))
    return _described(reduce(DataFrame.union, parts), rules)


def findings(report: DataFrame) -> DataFrame:
    """The broken rules of a report."""
    return report.filter("n_rows > 0")


def severity_counts(rows: DataFrame) -> DataFrame:
    """Rows per severity; a report is valid when no error is left."""
    return rows.groupBy("severity").agg(F.count(F.lit(1)).alias("n_findings"))


def is_valid(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.every(F.col("severity") != "error"), F.lit(True)).alias("valid"))


def relationship_profile(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """What the data says about a reference: fan-out, parents without children, kind."""
    held = key_counts(child, [column], "n_children").withColumnRenamed(column, "key")
    keys = parent.select(F.col(parent_column).alias("key")).filter("key IS NOT NULL").distinct()
    return keys.join(held, "key", "left").agg(
        F.count(F.lit(1)).alias("n_parents"),
        F.count("n_children").alias("n_linked_parents"),
        F.count_if(F.col("n_children").isNull()).alias("n_childless"),
        F.coalesce(F.sum("n_children"), F.lit(0)).cast("long").alias("n_children"),
        F.coalesce(F.max("n_children"), F.lit(0)).cast("long").alias("max_children"),
    ).withColumn(
        "kind", F.when(F.col("max_children") <= 1, F.lit("one_to_one")).otherwise(F.lit("one_to_many"))
    )


def junction_profile(df: DataFrame, left: str, right: str) -> DataFrame:
    """Whether a table of two references links many to many: distinct pairs and fan-out per side."""
    pairs = key_counts(df, [left, right], "n_pair_rows")
    sides = [
        pairs.groupBy(F.col(side).alias("key")).agg(F.count(F.lit(1)).alias("fan_out")).agg(
            F.coalesce(F.max("fan_out"), F.lit(0)).cast("long").alias(f"max_per_{name}")
        )
        for side, name in ((left, "left"), (right, "right"))
    ]
    totals = pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(F.col("n_pair_rows") > 1).alias("n_repeated_pairs"),
    )
    # one row with the three results
    measures = ("n_pairs", "n_repeated_pairs", "max_per_left", "max_per_right")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [totals, *sides])
    joined = rows.agg(*[F.max(m).alias(m) for m in measures])
    many_left, many_right = F.col("max_per_left") > 1, F.col("max_per_right") > 1
    return joined.withColumn(
        "kind",
        F.when(many_left & many_right, F.lit("many_to_many"))
        .when(many_left, F.lit("one_to_many")).when(many_right, F.lit("many_to_one"))
        .otherwise(F.lit("one_to_one")),
    )
