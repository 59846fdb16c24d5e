"""Referential actions: what deleting or re-keying parent rows does to their children."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelrow.contract import TableContract, spark_type
from keelrow.functions.defaults import default_value
from keelrow.operators import checks
from keelrow.operators.changes import Refused, union_all
from keelrow.operators.reach import hanging_on
from keelrow.session import cut_lineage


@dataclass(frozen=True)
class Edge:
    child: str
    column: str
    parent: str
    parent_column: str
    action: str


@dataclass
class Deletion:
    tables: dict[str, DataFrame] = field(default_factory=dict)    # rows after the deletion
    victims: dict[str, DataFrame] = field(default_factory=dict)   # deleted keys of tables others refer to
    blocked: list[DataFrame] = field(default_factory=list)        # report rows of RESTRICT / NO ACTION
    rounds: int = 0                                               # joins of tables with themselves, for cycles

    def blockers(self) -> DataFrame | None:
        return union_all(self.blocked) if self.blocked else None

    def require_allowed(self) -> Deletion:
        """Refuse when a restricting reference still has children (one row per reference is read)."""
        if self.blocked:
            held = checks.findings(self.blockers()).collect()
            if held:
                raise Refused("deletion refused", {f"{r['table']}.{r['column']}": r["n_rows"] for r in held})
        return self


def _action(text: str) -> str:
    return text.strip().upper() or "NO ACTION"


def edges(contracts: Sequence[TableContract]) -> list[Edge]:
    return [
        Edge(c.name, column, fk.table, fk.column, _action(fk.on_delete))
        for c in contracts for column, fk in c.references()
    ]


def _cascade_order(start: str, cascades: Sequence[Edge]) -> list[str] | None:
    """Tables a cascade reaches, parents first; None when references form a cycle."""
    reached, todo = {start}, [start]
    while todo:
        parent = todo.pop()
        for e in cascades:
            if e.parent == parent and e.child not in reached:
                reached.add(e.child)
                todo.append(e.child)
    order: list[str] = []
    while len(order) < len(reached):
        ready = sorted(
            t for t in reached - set(order)
            if all(e.parent in order or e.parent not in reached for e in cascades if e.child == t)
        )
        if not ready:
            return None
        order += ready
    return order


def _rings(start: str, cascades: Sequence[Edge]) -> list[list[str]]:
    """Tables a cascade reaches, in groups that reach each other, parents first."""
    reach: dict[str, set[str]] = {}
    todo = [start]
    while todo:
        table = todo.pop()
        if table in reach:
            continue
        seen, open_ = set(), [table]
        while open_:
            for e in cascades:
                if e.parent == open_[-1] and e.child not in seen:
                    seen.add(e.child)
                    open_.insert(0, e.child)
            open_.pop()
        reach[table] = seen
        todo += seen
    rings, placed = [], set()
    while len(placed) < len(reach):
        ring = next(
            sorted({t} | {o for o in reach[t] if t in reach[o]}) for t in sorted(set(reach) - placed)
            if all(o in placed or o in reach[t] or t not in reach[o] for o in reach))
        rings.append(ring)
        placed.update(ring)
    return rings


def _needed(table: str, contract: TableContract, all_edges: Sequence[Edge]) -> list[str]:
    """Columns that tell which rows go: the key, and whatever children refer to."""
    wanted = set(contract.key) | {e.parent_column for e in all_edges if e.parent == table}
    return [n for n in contract.names if n in wanted]


def _hits(child: DataFrame, edge: Edge, victims: DataFrame) -> DataFrame:
    gone = victims.select(F.col(edge.parent_column).alias(edge.column))
    return child.join(gone, edge.column, "left_semi")


def _spared(child: DataFrame, edge: Edge, victims: DataFrame) -> DataFrame:
    gone = victims.select(F.col(edge.parent_column).alias(edge.column))
    columns = child.columns
    return child.join(gone, edge.column, "left_anti").select(*columns)


def _blocked_rows(child: DataFrame, edge: Edge, victims: DataFrame) -> DataFrame:
    held = checks.key_counts(child, [edge.column])
    gone = victims.select(F.col(edge.parent_column).alias(edge.column))
    counted = held.join(gone, edge.column, "left_semi").agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).cast("long").alias("n_rows")
    )
    severity = F.when(F.col("n_rows") > 0, F.lit("error")).otherwise(F.lit("info"))
    return counted.select(
        F.lit(edge.action.lower().replace(" ", "_")).alias("type"), F.lit(edge.child).alias("table"),
        F.lit(edge.column).alias("column"), F.lit("").alias("index"),
        F.lit(f"rows still refer to {edge.parent}.{edge.parent_column}").alias("message"),
        severity.alias("severity"), "n_rows",
    )


def delete_with_actions(tables: Mapping[str, DataFrame], contracts: Sequence[TableContract], table: str,
                        keys: DataFrame, materialize: bool = True) -> Deletion:
    """Delete rows by key and carry out every reference's delete action.

    Cascades without a cycle are worked through parents first: one semi join per reference for
    the deleted keys, one anti join per reference for the rows that stay.  Where tables refer to
    themselves or to each other in a ring, each row having one parent in it, pointers are doubled:
    the number of joins is the logarithm of the depth.  Rows with several parents in a ring are
    followed wave by wave.  Every step is written out, so no plan grows.  Deleted keys are kept,
    never whole rows.
    """
    by_name = {c.name: c for c in contracts}
    _require_tables(tables, edges(contracts), table)
    all_edges = [e for e in edges(contracts) if e.child in tables and e.parent in tables]
    cascades = [e for e in all_edges if e.action == "CASCADE"]
    keep = cut_lineage if materialize else (lambda df: df)

    def columns_of(name: str) -> list[str]:
        return _needed(name, by_name[name], all_edges)

    first = tables[table].join(keys, keys.columns, "left_semi").select(*columns_of(table))
    order = _cascade_order(table, cascades)
    victims: dict[str, DataFrame] = {}
    if order is not None:
        victims[table] = keep(first)
        for name in order[1:]:
            if not any(e.parent == name for e in all_edges):
                continue      # nothing refers to this table, so its deleted keys are not needed
            parts = [
                _hits(tables[name], e, victims[e.parent]).select(*columns_of(name))
                for e in cascades if e.child == name and e.parent in victims
            ]
            victims[name] = keep(parts[0] if len(parts) == 1 else union_all(parts).distinct())
    result = Deletion()
    if order is None:
        for ring in _rings(table, cascades):
            inner = [e for e in cascades if e.child in ring and e.parent in ring]
            seeds = {}
            for name in ring:
                parts = [first] if name == table else []
                parts += [
                    _hits(tables[name], e, victims[e.parent]).select(*columns_of(name))
                    for e in cascades if e.child == name and e.parent in victims and e.parent not in ring]
                if parts:
                    seeds[name] = cut_lineage(parts[0] if len(parts) == 1 else union_all(parts).distinct())
            if not inner:
                victims.update(seeds)
            elif _one_parent(inner, by_name):
                found, rounds = _follow_pointers(tables, inner, seeds, columns_of)
                victims.update(found)
                result.rounds += rounds
            else:
                victims.update(_follow_waves(tables, by_name, inner, seeds, columns_of))
    result.victims = victims
    for name, df in tables.items():
        held = rows_after(df, name, contracts, victims, keys if name == table else None, set_values=False)
        for e in all_edges:
            gone = victims.get(e.parent)
            if e.child == name and gone is not None and e.action in ("RESTRICT", "NO ACTION"):
                result.blocked.append(_blocked_rows(df if e.action == "RESTRICT" else held, e, gone))
        result.tables[name] = _with_values_set(held, by_name[name], all_edges, victims)
    for e in all_edges:
        gone = result.victims.get(e.parent)
        if gone is not None and e.action == "SET DEFAULT":
            rest = result.tables[e.parent]
            result.blocked.append(checks.check_foreign_key(
                result.tables[e.child], [e.column], rest, [e.parent_column], e.child, e.parent
            ))
    return result


def rows_after(df: DataFrame, name: str, contracts: Sequence[TableContract], victims: Mapping[str, DataFrame],
               keys: DataFrame | None, set_values: bool = True) -> DataFrame:
    """The rows of a table that stay, given the deleted keys of the tables it refers to; ``keys`` are its own."""
    rows = df if keys is None else df.join(keys, keys.columns, "left_anti").select(*df.columns)
    links = [e for e in edges(contracts) if e.parent in victims]
    for e in links:
        if e.child == name and e.action == "CASCADE":
            rows = _spared(rows, e, victims[e.parent])
    contract = next(c for c in contracts if c.name == name)
    return _with_values_set(rows, contract, links, victims) if set_values else rows


def _with_values_set(rows: DataFrame, contract: TableContract, links: Sequence[Edge], victims: Mapping[str, DataFrame]) -> DataFrame:
    for e in links:
        if e.child == contract.name and e.parent in victims and e.action in ("SET NULL", "SET DEFAULT"):
            rows = replace_reference(rows, contract, e.column, victims[e.parent], e.parent_column, e.action)
    return rows


def _require_tables(tables: Mapping[str, DataFrame], links, table: str) -> None:
    """Every table that the deletion can reach must be there, else its rows would not be asked."""
    reached, open_ = {table}, [table]
    while open_:
        parent = open_.pop()
        for e in links:
            if e.parent == parent and e.action == "CASCADE" and e.child not in reached:
                reached.add(e.child)
                open_.append(e.child)
    missing = sorted({table} - set(tables) | {e.child for e in links if e.parent in reached and e.child not in tables})
    if missing:
        raise ValueError(f"tables that the deletion reaches are not given: {', '.join(missing)}")


def _one_parent(inner: Sequence[Edge], by_name: Mapping[str, TableContract]) -> bool:
    """Every row of the ring points to at most one row of it: one reference a table, to one unique column."""
    if len({e.child for e in inner}) < len(inner):
        return False
    if len({(e.parent, e.parent_column) for e in inner}) > len({e.parent for e in inner}):
        return False
    return all((e.parent_column,) in [k.columns for k in by_name[e.parent].unique_keys()] for e in inner)


def _follow_pointers(tables, inner, seeds, columns_of) -> tuple[dict[str, DataFrame], int]:
    """Deleted keys of a ring in which every row has one parent."""
    identity = {e.parent: e.parent_column for e in inner}
    parts = []
    for e in inner:
        own, up = identity[e.child], tables[e.parent].schema[e.parent_column].dataType
        rows = tables[e.child].filter(F.col(own).isNotNull()).select(
            F.col(own).alias("id"), F.col(e.column).cast(up).alias("up"))
        if e.child in seeds:
            marks = seeds[e.child].select(F.col(own).alias("id")).distinct().withColumn("gone", F.lit(True))
            rows = rows.join(marks, "id", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
        else:
            rows = rows.withColumn("gone", F.lit(False))
        if len(inner) > 1:
            # ids of several tables side by side
            rows = rows.withColumns({c: F.col(c).cast("string") for c in ("id", "up")})
        parts.append(rows.select(F.lit(e.child).alias("table"), "id", F.lit(e.parent).alias("up_table"), "up", "gone"))
    gone, rounds = hanging_on(union_all(parts), ["table", "id"], ["up_table", "up"])
    found = {}
    for e in inner:
        dead = gone.filter(F.col("table") == e.parent).select(
            F.col("id").cast(tables[e.parent].schema[e.parent_column].dataType).alias(e.parent_column))
        hit = _hits(tables[e.child], e, dead).select(*columns_of(e.child))
        found[e.child] = cut_lineage(hit.unionByName(seeds[e.child]).distinct() if e.child in seeds else hit)
    return found, rounds


def _follow_waves(tables, by_name, cascades, seeds, columns_of) -> dict[str, DataFrame]:
    """Deleted keys of a ring in which rows have several parents.  The number of waves is the depth of the references."""
    seen = dict(seeds)
    wave = dict(seeds)
    while wave:
        found: dict[str, list[DataFrame]] = {}
        for e in cascades:
            if e.parent in wave:
                if not by_name[e.child].key:
                    raise ValueError(f"table {e.child!r} needs a primary key: it is part of a cyclic cascade")
                found.setdefault(e.child, []).append(
                    _hits(tables[e.child], e, wave[e.parent]).select(*columns_of(e.child))
                )
        wave = {}
        for name, parts in found.items():
            fresh = union_all(parts).distinct() if len(parts) > 1 else parts[0]
            if name in seen:
                fresh = fresh.join(seen[name], list(by_name[name].key), "left_anti").select(*columns_of(name))
            fresh = cut_lineage(fresh)
            if fresh.isEmpty():
                continue
            wave[name] = fresh
            # one file set, not a union that grows with every wave
            seen[name] = cut_lineage(seen[name].unionByName(fresh)) if name in seen else fresh
    return seen


def replace_reference(child: DataFrame, contract: TableContract, column: str, gone: DataFrame,
                      parent_column: str, action: str) -> DataFrame:
    """SET NULL / SET DEFAULT: child rows of deleted parents get NULL or the column's default."""
    spec = contract.column(column)
    if action == "SET NULL":
        if spec.required:
            raise Refused("deletion refused", {f"{contract.name}.{column} must not be null": 0})
        value = F.lit(None).cast(spark_type(spec.type))
    else:
        value = default_value(spec.default, spec.type)
    marked = cut_lineage(gone.select(F.col(parent_column).alias(column)).distinct()).withColumn("__gone", F.lit(True))
    return child.join(marked, column, "left").withColumn(
        column, F.when(F.col("__gone"), value).otherwise(F.col(column))
    ).select(*child.columns)


def restricting_children(child: DataFrame, column: str, victims: DataFrame, parent_column: str) -> DataFrame:
    """Child rows that stand in the way of a deletion."""
    return child.join(victims.select(F.col(parent_column).alias(column)), column, "left_semi").select(*child.columns)


def update_keys(child: DataFrame, contract: TableContract, column: str, key_map: DataFrame,
                action: str = "CASCADE", parents: DataFrame | None = None) -> DataFrame:
    """Child rows after their parents' keys changed.

    ``key_map`` has ``old`` and ``new``, one row per old key.  It is refused if an old key is
    repeated, or if required references would become NULL.  With ``parents`` (the key column
    after the change, as its first column) a new key or a default that no parent has is refused too.
    """
    action = _action(action)
    spec = contract.column(column)
    key_map = cut_lineage(key_map)
    refused = {"repeated_key:old": checks.duplicate_keys(key_map.select("old"), ["old"]).count()}
    if spec.required and action == "SET NULL":
        refused[f"not_null:{column}"] = key_map.join(child.select(F.col(column).alias("old")), "old", "left_semi").count()
    if spec.required and action == "CASCADE":
        refused[f"not_null:{column}"] = key_map.filter("new IS NULL").count()
    if parents is not None and action in ("CASCADE", "SET DEFAULT"):
        value = F.col("new") if action == "CASCADE" else default_value(spec.default, spec.type)
        known = parents.select(F.col(parents.columns[0]).alias("__to"))
        refused[f"foreign_key:{column}"] = checks.orphan_keys(
            key_map.select(value.alias("__to")), ["__to"], known, ["__to"]).count()
    refused = {rule: n for rule, n in refused.items() if n}
    if refused:
        raise Refused(f"new keys for {contract.name} refused", refused)
    if action == "CASCADE":
        value = F.col("__new")
    elif action == "SET NULL":
        value = F.lit(None).cast(child.schema[column].dataType)
    elif action == "SET DEFAULT":
        value = default_value(spec.default, spec.type)
    else:
        raise ValueError(f"{action} does not change children; check them with restricting_children")
    moved = key_map.select(F.col("old").alias(column), F.col("new").alias("__new"), F.lit(True).alias("__moved"))
    return child.join(moved, column, "left").withColumn(
        column, F.when(F.col("__moved"), value).otherwise(F.col(column))
    ).select(*child.columns)
