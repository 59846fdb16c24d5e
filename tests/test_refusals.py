"""Dirty inputs: what is refused, kept apart or counted right."""

import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from keelrow import Column, ForeignKey, TableContract
from keelrow.operators import actions, changes, checks, search
from keelrow.operators.changes import Refused
from keelrow.plans import evolve as ev
from keelrow.plans import ledger as led

PARENT = TableContract("parent", (Column("id", "bigint", primary=True), Column("code", "numeric(5,1)", unique=True)))
CHILD = TableContract("child", (
    Column("id", "serial", primary=True), Column("parent", "bigint", not_null=True, foreign_key=ForeignKey("parent", "id", "RESTRICT")),
    Column("note", "varchar(2)"),
))


@pytest.fixture
def tables(spark):
    return {
        "parent": spark.createDataFrame([(1, 1.1), (2, 1.2)], "id long, code double").withColumn("code", F.col("code").cast("decimal(5,1)")),
        "child": spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], "id int, parent long, note string"),
    }


def test_update_refuses_by_itself(spark, tables):
    for rows, rule in (([(1, "x")], "type:parent"), ([(1, None)], "not_null:parent"), ([(1, "1"), (1, "2")], "repeated_key:id"),
                       ([(9, "1")], "not_found:id")):
        with pytest.raises(Refused) as refused:
            changes.update(tables["child"], spark.createDataFrame(rows, "id int, parent string"), CHILD)
        assert rule in refused.value.details
    done = changes.update(tables["child"], spark.createDataFrame([(1, "2"), (9, "1")], "id int, parent string"), CHILD, mode="ignore_unknown")
    assert sorted(tuple(r) for r in done.collect()) == [(1, 2, "a"), (2, 2, "b")]


def test_generated_numbers_continue(spark, tables):
    batch = spark.createDataFrame([(1, "c")], "parent long, note string")
    done = changes.insert(tables["child"], batch, CHILD, {"parent": tables["parent"]})
    assert [tuple(r) for r in done.accepted.collect()] == [(3, 1, "c")]


def test_new_keys_are_refused(spark, tables):
    def moved(rows, action="CASCADE", parents=None):
        return actions.update_keys(tables["child"], CHILD, "parent", spark.createDataFrame(rows, "old long, new long"), action, parents)

    for rows, action, parents in (([(1, 5), (1, 6)], "CASCADE", None), ([(1, None)], "CASCADE", None), ([(1, 5)], "SET NULL", None),
                                  ([(1, 5)], "CASCADE", tables["parent"].select("id"))):
        with pytest.raises(Refused):
            moved(rows, action, parents)
    assert sorted(r["parent"] for r in moved([(1, 2)], parents=tables["parent"].select("id")).collect()) == [2, 2]


def test_deletion_asks_every_table(spark, tables):
    keys = spark.createDataFrame([(1,)], "id long")
    with pytest.raises(ValueError, match="child"):
        actions.delete_with_actions({"parent": tables["parent"]}, [PARENT, CHILD], "parent", keys)


def contracts():
    return {"parent": PARENT, "child": CHILD}


def test_lossy_type_change_of_a_unique_column(tables):
    old = PARENT.column("code")
    done = ev.evolve(tables, contracts(), [ev.modify_column("parent", replace(old, type="integer"), old)])
    with pytest.raises(Refused):
        done.require_allowed()


def test_added_reference_is_checked(tables):
    column = Column("other", "bigint", default="7", foreign_key=ForeignKey("parent", "id"))
    with pytest.raises(Refused):
        ev.evolve(tables, contracts(), [ev.add_column("child", column)]).require_allowed()
    fine = replace(column, default="2")
    ev.evolve(tables, contracts(), [ev.add_column("child", fine)]).require_allowed()


def test_reference_needs_a_unique_target(tables):
    with pytest.raises(ValueError, match="not a unique key"):
        ev.evolve(tables, contracts(), [ev.add_foreign_key("parent", PARENT.column("id"), ForeignKey("child", "note"))])


def test_state_after_a_roll_back(spark, tmp_path):
    tables = {"t": str(tmp_path / "t")}
    spark.range(3).write.parquet(tables["t"])
    contract = TableContract("t", (Column("id", "bigint", primary=True),))
    ledger = led.Ledger(spark, str(tmp_path / "base"), tables, {"t": contract})
    ledger.apply_pending([led.Step("001", (ev.add_column("t", Column("a", "integer")),)),
                          led.Step("002", (ev.add_column("t", Column("b", "integer")),))])
    ledger.rollback(1)
    scripts = spark.createDataFrame([("001",), ("002",)], "name string")
    assert {(r["state"], r["name"]) for r in ledger.status(scripts).collect()} == {("applied", "001"), ("pending", "002")}
    assert [r["name"] for r in ledger.pending(scripts).collect()] == ["002"]
    assert ledger.summary().first()[:3] == (1, 1, 0)


def test_whole_history_is_numbered(spark):
    rows = spark.range(50).select(
        "id", F.concat(F.lit("n"), "id").alias("name"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("applied_at"),
        F.lit(1.0).alias("seconds"), F.lit("u").alias("executed_by"), F.lit("success").alias("status"), F.lit("c" * 64).alias("checksum"),
        F.lit("t").alias("table_affected"))
    whole = {r["number"]: r["name"] for r in led.history_numbered(rows, 0).collect()}
    assert whole == {i + 1: f"n{49 - i}" for i in range(50)}


def test_dirty_text_does_not_stop_a_report(spark, tables):
    child = spark.createDataFrame([("1", "abc", "toolong"), ("2", "9", "b"), ("2", "1", None)], "id string, parent string, note string")
    report = {(r["type"], r["column"]): r["n_rows"] for r in
              checks.contract_report({"parent": tables["parent"], "child": child}, [PARENT, CHILD]).collect()}
    assert report["type", "parent"] == 1 and report["foreign_key", "parent"] == 1 and report["type", "note"] == 1
    orphans = checks.orphan_rows(child, ["parent"], tables["parent"], ["id"]).collect()
    assert [tuple(r) for r in orphans] == [("2", "9", "b")]


def test_checks_of_odd_tables(spark):
    wide = TableContract("w", (Column("a", "varchar(2)"),))
    assert checks.check_rows(spark.createDataFrame([(123,), (12,)], "a long"), wide).first()["n_rows"] == 1
    assert checks.check_rows(spark.createDataFrame([(1,)], "a long"), TableContract("w", (Column("a", "bigint"),))).count() == 0
    keyed = spark.createDataFrame([(1,), (1,)], "n_rows long")
    assert checks.check_unique(keyed, ["n_rows"]).first()["n_rows"] == 1
    profile = checks.relationship_profile(
        spark.createDataFrame([(1,), (1,)], "k long"), "k", spark.createDataFrame([(1,), (1,), (2,)], "id long"), "id").first()
    assert (profile["n_parents"], profile["n_children"], profile["n_childless"]) == (2, 2, 1)


def test_pages_tile_a_table_with_ties(spark, monkeypatch):
    """Near and far pages follow one order, also where the key is the same for most rows."""
    monkeypatch.setattr(search, "TOP_K_ROWS", 150)
    df = spark.range(300).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"), F.create_map(F.lit("m"), "id").alias("m")).repartition(5)
    seen = [r["v"] for n in range(1, 7) for r in search.page_rows(df, ["k"], n, 50).collect()]
    assert len(seen) == 300 and len(set(seen)) == 300


def test_long_lists_keep_the_columns(spark):
    df = spark.createDataFrame([("a", 1), ("b", 999)], "v string, id long")
    assert search.ids_in(df, "id", list(range(300))).columns == ["v", "id"]


def test_pages_by_several_columns(spark):
    df = spark.range(60).select((F.col("id") / 7).cast("int").alias("a"), F.col("id").alias("b"), F.concat(F.lit("t"), "id").alias("t"))
    seen, after = [], None
    while True:
        got = search.next_page(df, ["a", "b"], after, 7, term="t").collect()
        if not got:
            break
        seen += [r["b"] for r in got]
        after = (got[-1]["a"], got[-1]["b"])
    assert seen == list(range(60))


def test_a_scope_leaves_nothing_behind(spark):
    from keelrow.session import cut_lineage, scratch_path, scratch_scope

    def files():
        folder = scratch_path(spark, "x").rsplit("/", 1)[0].removeprefix("file:")
        return sorted(os.listdir(folder)) if os.path.isdir(folder) else []

    before = files()
    with scratch_scope(spark):
        assert cut_lineage(spark.range(5)).count() == 5
        with pytest.raises(Refused), scratch_scope(spark):
            cut_lineage(spark.range(5)).count()
            raise Refused("inside", {})
        assert len(files()) == len(before) + 1
    assert files() == before
