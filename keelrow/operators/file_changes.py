"""Updates and deletes that rewrite only the files that hold a changed row.

Which files those are is found in two steps: by the ranges that a version keeps for each file, and then exactly, by
reading nothing but the key columns of the files that are left.  The other files are listed again in the new version.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelrow.contract import TableContract
from keelrow.operators import actions, changes, checks
from keelrow.operators.changes import Refused
from keelrow.session import cut_lineage
from keelrow.sources.versions import FILE, Version, either, holding, rewrite_files


@dataclass(frozen=True)
class FileChange:
    version: Version
    files_rewritten: int
    files_kept: int
    bytes_rewritten: int    # of the files that were replaced


def _changed(version: Version, base: str, touched: DataFrame, change, keeps_order: bool = True) -> FileChange:
    sizes = touched.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    total = version.files().count()
    if not sizes[0]:
        return FileChange(version, 0, total, 0)
    return FileChange(rewrite_files(version, base, touched, change, keeps_order), sizes[0], total - sizes[0], sizes[1])


def _pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    return [(c, c) for c in columns]


def update_files(version: Version, base: str, change: DataFrame, contract: TableContract,
                 key: Sequence[str] | None = None, set_columns: str | None = None, mode: str = "strict") -> FileChange:
    """:func:`keelrow.operators.changes.update`, file by file: the same checks and the same rows.

    If a column of the version's order is changed, the new version is in no order.
    """
    if mode not in ("strict", "ignore_unknown"):
        raise ValueError("mode is strict or ignore_unknown")
    key = list(key or contract.key)
    kept = cut_lineage(change)
    near = version.near(kept, [(key[0], key[0])])
    # keys outside the near files are in no row at all
    broken = checks.findings(changes.check_update(version.rows(near), kept, contract, key, set_columns)).collect()
    refused = {f"{r['type']}:{r['column']}": r["n_rows"] for r in broken if mode == "strict" or r["type"] != "not_found"}
    if refused:
        raise Refused(f"update of {contract.name} refused", refused)
    touched = holding(version, near, kept, _pairs(key))
    moved = {c for c in kept.columns if c not in key} & set(version.order)
    return _changed(version, base, touched, lambda rows: changes.updated(rows, kept, contract, key, set_columns), not moved)


def delete_files(version: Version, base: str, keys: DataFrame) -> FileChange:
    """:func:`keelrow.operators.changes.delete`, file by file; ``keys`` has the key columns."""
    kept = cut_lineage(keys)
    touched = holding(version, version.near(kept, [(kept.columns[0], kept.columns[0])]), kept, _pairs(kept.columns))
    return _changed(version, base, touched, lambda rows: rows.join(kept, kept.columns, "left_anti").select(*rows.columns))


def delete_files_with_actions(versions: Mapping[str, Version], bases: Mapping[str, str], contracts: Sequence[TableContract],
                              table: str, keys: DataFrame) -> dict[str, FileChange]:
    """:func:`keelrow.operators.actions.delete_with_actions`, file by file; refused as a whole if a reference forbids it.

    The deleted keys are found first; of every table only the files that hold a row that goes or changes are rewritten.
    """
    tables = {name: version.rows() for name, version in versions.items()}
    kept = cut_lineage(keys)
    found = actions.delete_with_actions(tables, contracts, table, kept).require_allowed()
    links = [e for e in actions.edges(contracts) if e.child in tables and e.parent in found.victims and e.action in (
        "CASCADE", "SET NULL", "SET DEFAULT")]
    done = {}
    for name, version in versions.items():
        lists = []
        if name == table:
            lists.append(holding(version, version.near(kept, [(kept.columns[0], kept.columns[0])]), kept, _pairs(kept.columns)))
        for e in links:
            if e.child == name:
                gone = found.victims[e.parent]
                pair = (e.column, e.parent_column)
                lists.append(holding(version, version.near(gone, [pair]), gone, [pair]))
        if not lists:
            done[name] = FileChange(version, 0, version.files().count(), 0)
            continue
        own = {e.column for e in links if e.child == name and e.action != "CASCADE"}

        def change(rows: DataFrame, name: str = name) -> DataFrame:
            # FILE travels as one more column
            return actions.rows_after(rows, name, contracts, found.victims, kept if name == table else None)

        done[name] = _changed(version, bases[name], cut_lineage(either(*lists)), change, not own & set(version.order))
    return done


__all__ = ["FILE", "FileChange", "delete_files", "delete_files_with_actions", "update_files"]
