"""Evolution, ledger, file formats, layouts and streams."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from keelrow import Column, ForeignKey, Index, TableContract
from keelrow.operators import catalog, catalog_diff, changes, checks
from keelrow.plans import evolve as ev
from keelrow.plans.ledger import Ledger, Step
from keelrow.sources import csv_files, dumps, json_files, layout, scripts
from keelrow.streaming import follow, importing

ITEMS = TableContract("items", (
    Column("id", "integer", primary=True), Column("name", "text", not_null=True), Column("price", "text"),
    Column("day", "date"),
))
ITEM_ROWS = "(1, 'ax', '5', DATE'2024-01-01'), (2, 'bow', '7', NULL), (3, 'cup', NULL, NULL)"


@pytest.fixture
def items(spark):
    return spark.sql(f"SELECT * FROM VALUES {ITEM_ROWS} AS t(id, name, price, day)")


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def evolved(items, *ops):
    return ev.evolve({"items": items}, {"items": ITEMS}, ops)


# ------------------------------------------------------------------ evolution

def test_add_required_column_without_default_is_refused(items):
    op = ev.add_column("items", Column("x", "text", not_null=True))
    with pytest.raises(changes.Refused) as refused:
        evolved(items, op).require_allowed()
    assert refused.value.details == {"not_null:items.x": 3}
    assert evolved(items.filter("false"), op).require_allowed().tables["items"].columns[-1] == "x"


def test_add_unique_column_with_default_is_refused(items):
    op = ev.add_column("items", Column("x", "integer", unique=True, default="1"))
    with pytest.raises(changes.Refused):
        evolved(items, op).require_allowed()


def test_add_serial_column(items):
    done = evolved(items, ev.add_column("items", Column("n", "serial"))).require_allowed()
    assert [r[0] for r in rows(done.tables["items"], "n")] == [1, 2, 3]


def test_modify_refuses_bad_casts(items):
    name = ITEMS.column("name")
    with pytest.raises(changes.Refused) as refused:
        evolved(items, ev.modify_column("items", replace(name, type="integer"), name)).require_allowed()
    assert refused.value.details == {"type:items.name": 3}
    price = ITEMS.column("price")
    done = evolved(items, ev.modify_column("items", replace(price, type="integer"), price)).require_allowed()
    assert rows(done.tables["items"], "price") == [(5,), (7,), (None,)]
    with pytest.raises(changes.Refused) as refused:
        evolved(items, ev.modify_column("items", replace(price, type="integer", not_null=True), price)).require_allowed()
    assert refused.value.details == {"not_null:items.price": 1}


def test_unique_index_and_reference_are_refused(spark, items):
    with pytest.raises(changes.Refused):
        evolved(items.union(items), ev.create_index("items", Index("u", ("name",), unique=True))).require_allowed()
    other = TableContract("other", (Column("k", "integer", primary=True),))
    done = ev.evolve({"items": items, "other": spark.createDataFrame([(1,)], "k int")}, {"items": ITEMS, "other": other},
                     [ev.add_foreign_key("items", ITEMS.column("id"), ForeignKey("other", "k"))])
    assert checks.findings(done.report()).first()["n_rows"] == 2


def test_referenced_column_cannot_be_dropped():
    child = TableContract("child", (Column("i", "integer", foreign_key=ForeignKey("items", "id")),))
    both = {"items": ITEMS, "child": child}
    with pytest.raises(changes.Refused):
        ev.preview(both, [ev.drop_column("items", ITEMS.column("id"))])
    with pytest.raises(changes.Refused):
        ev.preview(both, [ev.drop_table(ITEMS)])
    renamed = ev.preview(both, [ev.rename_column("items", ITEMS.column("id"), "key")])
    assert renamed["child"].column("i").foreign_key.column == "key"


def test_inverse_is_identity_on_kept_columns(items):
    price = ITEMS.column("price")
    ops = [ev.add_column("items", Column("x", "text", default="'a'")), ev.rename_column("items", ITEMS.column("name"), "title"),
           ev.modify_column("items", replace(price, type="bigint"), price), ev.create_index("items", Index("i", ("day",)))]
    there = evolved(items, *ops)
    back = ev.evolve(there.tables, there.contracts, ev.inverses(ops))
    assert back.contracts["items"] == ITEMS
    assert rows(back.tables["items"]) == rows(items)
    assert all(ev.inverse(ev.inverse(op)) == op for op in ops)


def test_whole_plan_reads_the_table_once(spark, sf_dir):
    from registry.star import LINEITEM
    from registry.run_queries import _modify_ops
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    done = ev.evolve({"lineitem": df}, {"lineitem": LINEITEM}, _modify_ops())
    for out in (done.tables["lineitem"], done.report()):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1
    assert "Exchange" not in done.tables["lineitem"]._jdf.queryExecution().executedPlan().toString()


def test_plan_from_a_catalog_diff(spark):
    old = [TableContract("a", (Column("id", "integer", primary=True), Column("v", "text"), Column("gone", "text"))),
           TableContract("z", (Column("id", "integer", primary=True), Column("a", "integer", foreign_key=ForeignKey("a", "id"))))]
    new = [TableContract("a", (Column("id", "integer", primary=True), Column("v", "integer"), Column("extra", "text", default="'n'")),
                         (Index("ix_v", ("v",), unique=True),)),
           TableContract("b", (Column("id", "integer", primary=True), Column("a", "integer", foreign_key=ForeignKey("a", "id"))))]
    diff = catalog_diff.diff_catalog(catalog.from_contracts(spark, new), catalog.from_contracts(spark, old))
    ops = ev.operations_of(diff, {c.name: c for c in new}, {c.name: c for c in old})
    tables = {"a": spark.createDataFrame([(1, "5", "g"), (2, "6", "h")], "id int, v string, gone string"),
              "z": spark.createDataFrame([(1, 1)], "id int, a int")}
    done = ev.evolve(tables, {c.name: c for c in old}, ops).require_allowed()
    assert rows(done.tables["a"]) == [(1, 5, "n"), (2, 6, "n")]
    assert set(done.tables) == {"a", "b"} and done.contracts["b"].references()
    again = catalog_diff.diff_catalog(
        catalog.from_contracts(spark, new), catalog.from_contracts(spark, list(done.contracts.values())))
    assert again.count() == 0


# ------------------------------------------------------------------ ledger

def steps():
    price = ITEMS.column("price")
    return [
        Step("001_stock", (ev.add_column("items", Column("stock", "integer", default="0")),)),
        Step("002_price", (ev.modify_column("items", replace(price, type="integer"), price),)),
        Step("003_title", (ev.rename_column("items", ITEMS.column("name"), "title"),)),
    ]


@pytest.fixture
def ledger(spark, items, tmp_path):
    items.write.parquet(f"{tmp_path}/start")
    return Ledger(spark, str(tmp_path / "base"), {"items": f"{tmp_path}/start"}, {"items": ITEMS}, user="tester")


def test_apply_and_roll_back(spark, ledger, items):
    assert [n for n, _, _ in ledger.preview(steps())] == ["001_stock", "002_price", "003_title"]
    assert ledger.apply_pending(steps()) == ["001_stock", "002_price", "003_title"]
    assert ledger.apply_pending(steps()) == []
    now = spark.read.parquet(ledger.paths()["items"])
    assert now.columns == ["id", "title", "price", "day", "stock"] and dict(now.dtypes)["price"] == "int"
    assert ledger.rollback(2) == ["003_title", "002_price"]
    assert spark.read.parquet(ledger.paths()["items"]).columns == ["id", "name", "price", "day", "stock"]
    assert ledger.apply_pending(steps()) == ["002_price", "003_title"]
    assert ledger.rollback(99) == ["003_title", "002_price", "001_stock"]
    assert rows(spark.read.parquet(ledger.paths()["items"])) == rows(items)
    levels = {r["level"] for r in ledger.log_rows().collect()}
    assert levels == {"INFO", "SUCCESS"}
    assert {r["table_affected"] for r in ledger.rows().collect()} == {"items"}


def test_failure_blocks_until_resolved(spark, ledger, items):
    name = ITEMS.column("name")
    bad = [steps()[0], Step("002_bad", (ev.modify_column("items", replace(name, type="date"), name),))]
    with pytest.raises(changes.Refused):
        ledger.apply_pending(bad)
    assert [r["name"] for r in ledger.current().filter("status = 'success'").collect()] == ["001_stock"]
    assert rows(spark.read.parquet(ledger.paths()["items"]), "id", "name") == rows(items, "id", "name")
    with pytest.raises(changes.Refused, match="resolved first"):
        ledger.apply_pending(steps())
    ledger.resolve("002_bad")
    assert ledger.apply_pending(steps()) == ["002_price", "003_title"]
    with pytest.raises(ValueError):
        ledger.resolve("002_bad")


def test_checksums_tell_steps_apart():
    a, b, _ = steps()
    assert a.checksum != b.checksum and a.checksum == steps()[0].checksum


def test_script_files(spark, tmp_path):
    (tmp_path / "002_b.sql").write_text("-- Up Migration\nB;\n-- Down Migration (Rollback)\n-- =======================\nb;\n")
    (tmp_path / "001_a.sql").write_text("A;\n")
    (tmp_path / "notes.txt").write_text("x")
    got = scripts.script_sections(scripts.read_scripts(spark, str(tmp_path))).orderBy("name").collect()
    assert [(r["name"], r["up"], r["down"], r["error"]) for r in got] == [
        ("001_a.sql", None, None, "does not contain rollback section"), ("002_b.sql", "B;", "b;", None)]


# ------------------------------------------------------------------ files

def csv_import(spark, tmp_path, content, mode="strict", target=None):
    path = tmp_path / "in.csv"
    path.write_bytes(content.encode())
    return csv_files.import_csv(spark, str(path), target or spark.createDataFrame([], ITEMS.struct()), ITEMS, mode=mode)


def test_csv_import(spark, tmp_path):
    done = csv_import(spark, tmp_path, 'name,id\n"a ""quoted"", name",1\n\n"two\nlines",2\nlast,3\r\n')
    assert rows(done.accepted, "id", "name", "price") == [
        (1, 'a "quoted", name', None), (2, "two\nlines", None), (3, "last", None)]


def test_csv_refusals(spark, tmp_path):
    with pytest.raises(ValueError, match="columns not found in table items: color, size"):
        csv_import(spark, tmp_path, "id,color,size\n1,2,3\n")
    with pytest.raises(ValueError, match="at least one data row"):
        csv_import(spark, tmp_path, "id,name\n")
    for content in ("id,name\n1,a\n2\n", "id,name\n1,a\n2,b,c\n"):
        with pytest.raises(changes.Refused) as refused:
            csv_import(spark, tmp_path, content)
        assert refused.value.details == {"malformed": 1}
    with pytest.raises(changes.Refused) as refused:
        csv_import(spark, tmp_path, "id,name\n1,a\n1,b\nx,c\n2,\n")
    assert refused.value.details == {"primary_key:id": 2, "type:id": 1, "not_null:name": 1}


def test_csv_quarantine(spark, tmp_path):
    done = csv_import(spark, tmp_path, "id,name,day\n1,a,2024-05-01\n2,b\n3,c,never\n", "quarantine")
    assert rows(done.accepted, "id") == [(1,)]
    assert sorted(r["violations"][0] for r in done.rejected.collect()) == ["malformed", "type:day"]


HARD = [(1, "a,b", 'say "hi"', None), (2, "line\nbreak", "cr\r\nlf", None), (3, "NULL", "it's; --", None),
        (4, "back\\slash", "\\n", None), (5, " spaced ", "', '", None), (6, "ünï 漢", "#x", None)]


@pytest.mark.parametrize("form", ["csv", "json", "sql"])
def test_hard_text_round_trips(spark, tmp_path, form):
    df = spark.createDataFrame(HARD, "id int, name string, price string, day date")
    empty, path = spark.createDataFrame([], ITEMS.struct()), str(tmp_path / form)
    if form == "csv":
        csv_files.export_csv(df, path)
        back = csv_files.import_csv(spark, path, empty, ITEMS)
    elif form == "json":
        json_files.export_json(df, path)
        back = json_files.import_json(spark, path, empty, ITEMS)
    else:
        dumps.export_sql(df, path, "items")
        back = dumps.import_sql(spark, path, empty, ITEMS)
    assert rows(back.rows) == rows(df)


def test_empty_text_survives_json_and_sql(spark, tmp_path):
    df = spark.createDataFrame([(1, "", None, None), (2, "x", "", None)], "id int, name string, price string, day date")
    empty = spark.createDataFrame([], ITEMS.struct())
    json_files.export_json(df, str(tmp_path / "j"))
    dumps.export_sql(df, str(tmp_path / "s"), "items")
    assert rows(json_files.import_json(spark, str(tmp_path / "j"), empty, ITEMS).rows) == rows(df)
    assert rows(dumps.import_sql(spark, str(tmp_path / "s"), empty, ITEMS).rows) == rows(df)


def test_csv_export_is_ordered(spark, tmp_path):
    df = spark.range(500).select((F.lit(499) - F.col("id")).alias("id"), F.col("id").cast("string").alias("name"))
    csv_files.export_csv(df, str(tmp_path / "o"))
    ids = []
    for f in sorted((tmp_path / "o").glob("part-*.csv")):
        lines = f.read_text().splitlines()
        assert lines[0] == "id,name"
        ids += [int(line.split(",")[0]) for line in lines[1:]]
    assert ids == list(range(500))


def test_json_columns_of_later_objects(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('[{"id": 1, "name": "a"}, {"id": 2, "name": "b", "price": 7}]')
    empty = spark.createDataFrame([], ITEMS.struct())
    done = json_files.import_json(spark, str(path), empty, ITEMS, array_files=True)
    assert rows(done.rows, "id", "name", "price") == [(1, "a", None), (2, "b", "7")]
    lines = tmp_path / "l.json"
    lines.write_text('{"id": 1, "name": "a"}\n\n{broken\n{"id": 1.5, "name": "b"}\n')
    kept = json_files.import_json(spark, str(lines), empty, ITEMS, mode="quarantine")
    assert kept.accepted.count() == 1
    assert sorted(r["violations"][0] for r in kept.rejected.collect()) == ["malformed", "type:id"]
    lines.write_text('{"id": 1, "name": "a", "color": 3}\n')
    with pytest.raises(ValueError, match="columns not found in table items: color"):
        json_files.import_json(spark, str(lines), empty, ITEMS)
    lines.write_text("\n")
    with pytest.raises(ValueError):
        json_files.import_json(spark, str(lines), empty, ITEMS)


def test_dump_of_another_table_is_set_aside(spark, tmp_path):
    path = tmp_path / "d.sql"
    path.write_text("-- comment\n\nINSERT INTO items (\"id\", \"name\") VALUES (1, 'a; b');\n"
                    "INSERT INTO others (\"id\") VALUES (1);\nDROP TABLE items;\n")
    empty = spark.createDataFrame([], ITEMS.struct())
    done = dumps.import_sql(spark, str(path), empty, ITEMS, mode="quarantine")
    assert rows(done.accepted, "id", "name") == [(1, "a; b")]
    assert done.rejected.count() == 2


def test_serial_ids_continue(spark, tmp_path):
    contract = TableContract("t", (Column("id", "serial", primary=True), Column("name", "text")))
    target = spark.createDataFrame([(7, "old")], contract.struct())
    path = tmp_path / "s.csv"
    path.write_text("name\n" + "\n".join(f"n{i}" for i in range(20)) + "\n")
    done = csv_files.import_csv(spark, str(path), target, contract)
    assert [r[0] for r in sorted(done.rows.select("id").collect())] == list(range(7, 28))


def test_layouts(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.col("id").alias("v"))
    clustered = layout.write_indexed(df, str(tmp_path / "c"), Index("i", ("k",)))
    assert rows(clustered) == rows(df)
    with pytest.raises(ValueError):
        layout.write_indexed(df, str(tmp_path / "h"), Index("i", ("k",), method="hash"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = layout.write_bucketed(df, "bucket_a", ["k"], 4)
        b = layout.write_bucketed(df, "bucket_b", ["k"], 4)
        plan = a.join(b, "k")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        plan = checks.check_unique(a, ["k"])._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS bucket_a")
        spark.sql("DROP TABLE IF EXISTS bucket_b")


def test_empty_table_is_typed(spark, tmp_path):
    df = layout.create_table(spark, str(tmp_path / "e"), ITEMS)
    assert df.count() == 0 and [f.dataType for f in df.schema] == [f.dataType for f in ITEMS.struct()]


def test_time_keys_do_not_shift(spark, tmp_path):
    contract = TableContract("t", (Column("at", "timestamp", primary=True), Column("v", "text")))
    target = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-31 02:30:00' AS at, 'x' AS v")
    path = tmp_path / "t.csv"
    path.write_text("at,v\n2024-03-31 02:30:00,y\n2024-03-31 03:30:00,z\n")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        done = csv_files.import_csv(spark, str(path), target, contract, mode="quarantine")
        assert [r["v"] for r in done.accepted.collect()] == ["z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_publish_switches_versions(spark, tmp_path):
    one, two = (layout.new_version(str(tmp_path), "t") for _ in range(2))
    layout.write_version(spark.range(3), one)
    layout.write_version(spark.range(5), two)
    try:
        layout.publish(spark, "published", one)
        assert spark.table("published").count() == 3
        layout.publish(spark, "published", two)
        assert spark.table("published").count() == 5
    finally:
        spark.sql("DROP TABLE IF EXISTS published")
    with pytest.raises(Exception):
        layout.write_version(spark.range(1), one)


# ------------------------------------------------------------------ streams

def test_follow_log(spark, ledger, tmp_path):
    seen = []

    def drain():
        query = follow.follow_log(spark, ledger.base, ("ERROR", "INFO")).writeStream.foreachBatch(
            lambda df, n: seen.extend(r["message"] for r in df.collect())
        ).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
    ledger.write_log("INFO", "one", "r")
    ledger.write_log("SUCCESS", "hidden", "r")
    drain()
    ledger.write_log("ERROR", "two", "r")
    drain()
    assert sorted(seen) == ["one", "two"]


def test_stream_import_and_replay(spark, tmp_path):
    contract = TableContract("t", (Column("id", "integer", primary=True), Column("p", "integer", foreign_key=ForeignKey("par", "k")),
                                   Column("status", "text", default="'new'")))
    parents = spark.createDataFrame([(1,), (2,)], "k int")
    folder, base = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.csv").write_text("id,p\n1,1\n2,9\nx,1\n3,2,2\n")

    def run():
        rows_in = importing.arriving_csv(spark, str(folder), contract, ["id", "p"])
        importing.stream_import(rows_in, base, contract, lambda: {"par": parents}).awaitTermination()
    run()
    (folder / "b.csv").write_text("id,p\n1,1\n4,\n5,2\n")
    run()
    run()
    kept = spark.read.parquet(f"{base}/t")
    assert rows(kept, "id", "status") == [(1, "new"), (4, "new"), (5, "new")]
    rejects = spark.read.parquet(f"{base}/t_rejects")
    assert sorted(r["violations"][0] for r in rejects.collect()) == ["exists:id", "foreign_key:p", "malformed", "type:id"]
    assert rows(spark.read.parquet(f"{base}/t_files"), "source_file") == [("a.csv",), ("b.csv",)]
    # the same batch again, as after a failure, changes nothing
    batch = spark.createDataFrame([("1", "1", None, "b.csv"), ("4", None, None, "b.csv"), ("5", "2", None, "b.csv")],
                                  "id string, p string, _corrupt_record string, source_file string")
    importing.import_batch(batch, 1, f"{base}/t", f"{base}/t_rejects", f"{base}/t_files", contract, lambda: {"par": parents})
    assert rows(spark.read.parquet(f"{base}/t"), "id") == [(1,), (4,), (5,)]


def test_stream_json(spark, tmp_path):
    folder, base = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.json").write_text('{"id": 1, "name": "a"}\nnot json\n{"id": 2}\n')
    rows_in = importing.arriving_json(spark, str(folder), ITEMS, ["id", "name"])
    importing.stream_import(rows_in, base, ITEMS).awaitTermination()
    assert rows(spark.read.parquet(f"{base}/items"), "id", "name") == [(1, "a")]
    assert sorted(r["violations"][0] for r in spark.read.parquet(f"{base}/items_rejects").collect()) == ["malformed", "not_null:name"]
