"""Split files, renames from data, rules that a plan takes back, imports by file name, hashed layouts."""

import json
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from keelrow import Column, ForeignKey, Index, TableContract
from keelrow.operators import catalog_diff, changes, renames
from keelrow.plans import evolve as ev
from keelrow.sources import csv_files, json_files
from keelrow.sources.split_records import csv_records, json_records
from keelrow.streaming import importing

NOTES = TableContract("notes", (Column("id", "bigint", primary=True), Column("text", "text"), Column("tag", "text")))


@pytest.fixture(params=[100, 4096])
def small_splits(request, spark):
    """Files are read in blocks of a few bytes."""
    name = "spark.sql.files.maxPartitionBytes"
    open_cost = "spark.sql.files.openCostInBytes"
    kept = spark.conf.get(name), spark.conf.get(open_cost)
    spark.conf.set(name, str(request.param))
    spark.conf.set(open_cost, "1")
    yield request.param
    spark.conf.set(name, kept[0])
    spark.conf.set(open_cost, kept[1])


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def csv_text(seed):
    draw = random.Random(seed)
    pieces = ["plain", "", "two words", 'say ""hi""', "a,b", "line\nbreak", "\n\n", "é 😀", "cr\r\nlf", '""', "x" * 150, "tail\n"]
    lines = ["id,text,tag"]
    for i in range(60):
        fields = [str(i)]
        for _ in range(2):
            value = draw.choice(pieces)
            fields.append(f'"{value}"' if any(c in value for c in ',\n"\r') or draw.random() < 0.3 else value)
        if i % 13 == 0:
            fields.append("too many")
        lines.append(",".join(fields))
        if i % 17 == 0:
            lines.append("")
    return "\n".join(lines) + ("\n" if seed % 2 else "")


@pytest.mark.parametrize("seed", range(2))
def test_split_csv_equals_the_whole_file(spark, tmp_path, small_splits, seed):
    path = tmp_path / "notes.csv"
    path.write_text(csv_text(seed), newline="")
    whole, split = (csv_files.read_csv(spark, str(path), NOTES, split=s) for s in (False, True))
    assert rows(split.rows) == rows(whole.rows) and split.rows.count() > 40
    assert split.malformed.count() == whole.malformed.count() == 5
    if small_splits < 4096:
        assert spark.read.option("lineSep", "\n").text(str(path)).rdd.getNumPartitions() > 5


def test_split_csv_over_files_of_one_header(spark, tmp_path, small_splits):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f'id,text,tag\n{i},"a\nb",x\n', newline="")
    got = csv_files.read_csv(spark, str(tmp_path), NOTES, split=True)
    assert rows(got.rows) == [(str(i), "a\nb", "x") for i in range(3)]
    (tmp_path / "9.csv").write_text("id,tag,text\n9,x,y\n", newline="")
    with pytest.raises(ValueError, match="one header"):
        csv_files.read_csv(spark, str(tmp_path), NOTES, split=True)


@pytest.mark.parametrize("split", (False, True))
def test_empty_texts_survive_csv_where_asked_for(spark, tmp_path, split):
    df = spark.createDataFrame([("1", "", "x"), ("2", "a\nb", None), ("3", ' ""', "")], "id string, text string, tag string")
    path, none = str(tmp_path / "c"), spark.createDataFrame([], NOTES.struct())
    csv_files.export_csv(df, path, empty_text=True)
    assert rows(csv_files.read_csv(spark, path, NOTES, split=split, empty_text=True).rows) == rows(df)
    # without, both are NULL, as in files that know no difference
    assert rows(csv_files.read_csv(spark, path, NOTES, split=split).rows) == [("1", None, "x"), ("2", "a\nb", None), ("3", ' ""', None)]
    assert csv_files.import_csv(spark, path, none, NOTES, split=split, empty_text=True).rows.count() == 3


@pytest.mark.parametrize("query", ("csv_round_trip", "csv_multiline_split"))
def test_round_trips_keep_empty_texts(spark, tmp_path, query):
    docs = spark.createDataFrame([(1, "", "en", "", 0), (2, 'a\n"b"', None, None, 5)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(__spark_entry__.queries()[query](spark, str(tmp_path))) == rows(docs)


def test_split_csv_of_a_header_alone(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("id,text,tag\n")
    assert csv_records(spark, str(path)).count() == 1
    with pytest.raises(ValueError, match="at least one data row"):
        csv_files.import_csv(spark, str(path), spark.createDataFrame([], NOTES.struct()), NOTES, split=True)


def objects(n, seed):
    draw = random.Random(seed)
    texts = ["", "plain", 'quote " here', "brace } and {", "], [", "back\\slash", "\\\"", "line\nbreak", "é 😀", "}" * 40, "x" * 200, "\\"]
    return [{"id": i, "text": draw.choice(texts), "tag": draw.choice([None, *texts])} for i in range(n)]


@pytest.mark.parametrize("form", [{"indent": 2}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_split_json_array(spark, tmp_path, small_splits, form):
    data = objects(50, 3)
    path = tmp_path / "notes.json"
    path.write_text(json.dumps(data, **form))
    got = json_files.read_json(spark, str(path), NOTES, array_files=True)
    assert got.malformed.collect() == []
    assert rows(got.rows) == sorted(((str(d["id"]), d["text"], d["tag"]) for d in data), key=repr)
    records = json_records(spark, str(path)).collect()
    assert sorted((json.loads(r["record"]) for r in records), key=lambda d: d["id"]) == data


def test_split_json_array_with_nested_objects(spark, tmp_path, small_splits):
    data = [{"id": i, "text": {"a": [{"b": "}"}, {"c": i}], "d": {}}, "tag": "[{"} for i in range(20)]
    path = tmp_path / "n.json"
    path.write_text(json.dumps(data))
    got = [json.loads(r["record"]) for r in json_records(spark, str(path)).collect()]
    assert sorted(got, key=lambda d: d["id"]) == data


def test_split_json_of_odd_files(spark, tmp_path, small_splits):
    texts = {
        "empty array": "[]", "nothing": "", "spaces": " \n", "one object": '{"id": 1}', "open end": '[{"id": 2}, {"id": 3}', "cut": '[{"id": 4}, {"id": "5',
        "lines": '{"id": 6}\n{"id": 7}\n', "bad": '[{"id" 8}, {"id": 9}]'}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {r["record"] for r in json_records(spark, str(tmp_path)).collect()}
    assert got == {'{"id": 1}', '{"id": 2}', '{"id": 3}', '{"id": 4}', '{"id": "5', '{"id": 6}', '{"id": 7}', '{"id" 8}', '{"id": 9}'}
    batch = json_files.read_json(spark, str(tmp_path), NOTES, array_files=True)
    assert {r["record"] for r in batch.malformed.collect()} == {'{"id": "5', '{"id" 8}'}


def test_large_values_span_many_blocks(spark, tmp_path):
    name = "spark.sql.files.maxPartitionBytes"
    kept = spark.conf.get(name)
    try:
        spark.conf.set(name, "1000")
        text = 'a "quoted" \\ {x}\n' * 2000
        path = tmp_path / "big.json"
        path.write_text(json.dumps([{"id": 1, "text": text}, {"id": 2, "text": "small"}]))
        assert rows(json_files.read_json(spark, str(path), NOTES, array_files=True).rows) == [("1", text), ("2", "small")]
        doubled = text.replace('"', '""')
        (tmp_path / "big.csv").write_text(f'id,text,tag\n1,"{doubled}",x\n2,small,y\n', newline="")
        assert rows(csv_files.read_csv(spark, str(tmp_path / "big.csv"), NOTES, split=True).rows) == [("1", text, "x"), ("2", "small", "y")]
    finally:
        spark.conf.set(name, kept)


# ------------------------------------------------------------------ renames and indexes

def test_renames_are_told_apart_by_values(spark):
    old = spark.range(2000).select(
        "id", (F.col("id") % 50).alias("a"), (F.col("id") * 7 % 2000).alias("b"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("c"),
        F.lit(None).cast("int").alias("empty"), F.array(F.lit(1)).alias("nested"))
    new = old.filter("id % 10 > 0").withColumnsRenamed({"a": "x", "b": "y", "c": "z", "empty": "void", "nested": "deep"}).withColumn(
        "other", F.col("id") + 10**6).withColumn("x", F.col("x").cast("int"))
    got = {(r["old_column"], r["new_column"]): r["similarity"] for r in renames.rename_by_data(old, new).collect()}
    assert set(got) == {("a", "x"), ("b", "y"), ("c", "z")}
    # few values are compared exactly, many by their smallest digests
    assert got["a", "x"] == len({i % 50 for i in range(2000) if i % 10}) / 50
    assert got["b", "y"] == pytest.approx(0.9, abs=0.08)
    assert renames.rename_by_data(old, old).collect() == []
    # each column has one partner: the better one
    twice = new.withColumn("copy", F.when(F.col("id") % 3 > 0, F.col("z")))
    assert ("c", "z") in {tuple(r)[:2] for r in renames.rename_by_data(old, twice).collect()}


def test_index_drift_kinds(spark):
    shape = "table_name string, index_name string, column_names string, is_unique boolean, method string"
    wanted = spark.createDataFrame([("t", "a", "x", True, "btree"), ("t", "b", "x,y", False, "btree"), ("u", "a", "x", False, "hash")], shape)
    existing = spark.createDataFrame([("t", "a", "x", False, "btree"), ("t", "c", "x", False, "btree"), ("u", "a", "x", False, "hash")], shape)
    got = {tuple(r) for r in catalog_diff.index_drift(wanted, existing).collect()}
    assert got == {("missing_index", "t", "b", ""), ("extra_index", "t", "c", ""), ("index_mismatch", "t", "a", "is_unique: false → true")}


# ------------------------------------------------------------------ plans

def test_rules_taken_back_in_a_plan_are_not_asked(spark):
    parent = TableContract("p", (Column("id", "integer", primary=True),))
    contract = TableContract("t", (Column("id", "integer", primary=True), Column("n", "text"), Column("p", "integer")))
    tables = {"t": spark.createDataFrame([(1, "x", 7), (2, None, 8)], contract.struct()), "p": spark.createDataFrame([(1,)], parent.struct())}
    contracts = {"t": contract, "p": parent}
    key, fk = Column("k", "integer", unique=True, default="3"), ForeignKey("p", "id")
    n, needed = contract.column("n"), Column("n", "text", not_null=True)
    index = Index("u", ("k",), unique=True)
    kept = [ev.add_column("t", key)]
    assert ev.evolve(tables, contracts, kept).report().filter("severity = 'error'").count() == 1
    for ops in (
        [*kept, ev.drop_column("t", key)],
        [*kept, ev.rename_column("t", key, "m"), ev.drop_column("t", Column("m", "integer", unique=True, default="3"))],
        [ev.modify_column("t", needed, n), ev.drop_column("t", needed)],
        [ev.add_foreign_key("t", contract.column("p"), fk), ev.drop_foreign_key("t", contract.column("p"), fk)],
        [ev.add_column("t", Column("k", "integer", default="3")), ev.create_index("t", index), ev.drop_index("t", index)],
        [*kept, ev.drop_table(contract)],
    ):
        ev.evolve(tables, contracts, ops).require_allowed()
    for ops in (
        [*kept, ev.add_column("t", Column("z", "integer"))], [*kept, ev.rename_column("t", key, "m")], [ev.modify_column("t", needed, n)],
        [ev.add_foreign_key("t", contract.column("p"), fk)], [*kept, ev.drop_column("t", n)],
    ):
        with pytest.raises(changes.Refused):
            ev.evolve(tables, contracts, ops).require_allowed()


# ------------------------------------------------------------------ streams and layouts

def test_a_file_is_imported_once_also_without_its_checkpoint(spark, tmp_path):
    folder, base = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    contract = TableContract("notes", (Column("id", "bigint"), Column("text", "text"), Column("tag", "text")))

    def run():
        stream = importing.arriving_csv(spark, str(folder), contract, ["id", "text", "tag"])
        importing.stream_import(stream, str(base), contract).awaitTermination()
        return rows(spark.read.parquet(str(base / "notes")).select("id", "text", "tag"))

    (folder / "a.csv").write_text("id,text,tag\n1,x,y\n2,x,y\n")
    first = run()
    assert first == [(1, "x", "y"), (2, "x", "y")]
    # the checkpoint is lost: another name in another place
    (base / "notes_checkpoint").rename(base / "lost_checkpoint")
    (folder / "b.csv").write_text("id,text,tag\n3,x,y\n")
    assert run() == [*first, (3, "x", "y")]
    files = spark.read.parquet(str(base / "notes_files")).groupBy("source_file").agg(F.sum("n_rows").alias("n")).collect()
    assert {r["source_file"]: r["n"] for r in files} == {"a.csv": 2, "b.csv": 1}


def test_bucketed_join_needs_no_shuffle(spark, sf_dir):
    from registry.exchange_queries import bucketed_join
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = bucketed_join(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
