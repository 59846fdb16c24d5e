"""Versions as lists of files: what is rewritten, what is read, and that the rows are those of the plain operators."""

import random

import pytest
from pyspark.sql import functions as F

from keelrow import Column, ForeignKey, TableContract
from keelrow.operators import changes, file_changes, file_index, search
from keelrow.sources import layout, versions

T = TableContract("t", (
    Column("id", "bigint", primary=True), Column("name", "text", unique=True), Column("n", "integer", not_null=True),
    Column("up", "bigint", foreign_key=ForeignKey("t", "id"))))


@pytest.fixture
def base(tmp_path):
    return lambda: str(tmp_path / f"t{random.randrange(10**9)}")


@pytest.fixture
def table(spark):
    return spark.range(1000).select(
        "id", F.concat(F.lit("name "), F.col("id").cast("string")).alias("name"), (F.col("id") % 7).cast("int").alias("n"),
        F.when(F.col("id") > 0, F.expr("id div 2")).alias("up"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def made(table, base, n=10, order=("id",), bounds=("id", "up")):
    return versions.create_version(table, base(), order, bounds, n)


def test_version_keeps_places_rows_and_ranges(spark, table, base):
    version = versions.open_version(spark, made(table, base).path)
    files = version.files().orderBy("position").collect()
    assert len(files) == 10 and sum(f["n_rows"] for f in files) == 1000 == version.count()
    ends = [(f["low_high"]["low_0"], f["low_high"]["high_0"]) for f in files]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:])) and ends[0][0] == 0 and ends[-1][1] == 999
    assert rows(version.rows()) == rows(table) and version.rows().columns == table.columns
    one = version.near(spark.createDataFrame([(5,), (6,)], "k int"), [("id", "k")])
    assert one.count() == 1 and version.near(spark.createDataFrame([], "k int"), [("id", "k")]).count() == 0
    assert len(version.rows(one).inputFiles()) == 1


def test_update_rewrites_only_files_with_a_changed_key(spark, table, base):
    version = made(table, base)
    change = spark.createDataFrame([(5, "50"), (7, "70"), (950, "1")], "id long, n string")
    done = file_changes.update_files(version, base(), change, T)
    assert (done.files_rewritten, done.files_kept) == (2, 8)
    total = version.files().agg(F.sum("n_bytes")).first()[0]
    assert 0 < done.bytes_rewritten < total / 3
    assert rows(done.version.rows()) == rows(changes.update(table, change, T))
    # the old version is as it was, and the files in between are the same ones
    assert rows(version.rows()) == rows(table)
    names = [{r["name"] for r in v.files().select("name").collect()} for v in (version, done.version)]
    assert len(names[0] & names[1]) == 8
    # the order still holds, so pages do as well
    assert [r["id"] for r in file_index.page_indexed(done.version, 96, 10).collect()] == list(range(950, 960))


def test_update_refuses_as_the_plain_one(spark, table, base):
    version = made(table, base)
    for bad in ([(5, None)], [(5, "x")], [(5, "1"), (5, "2")], [(5000, "1")]):
        change = spark.createDataFrame(bad, "id long, n string")
        found = []
        for attempt in (lambda: changes.update(table, change, T), lambda: file_changes.update_files(version, base(), change, T)):
            with pytest.raises(changes.Refused) as refused:
                attempt()
            found.append(refused.value.details)
        assert found[0] == found[1]
    left = file_changes.update_files(version, base(), spark.createDataFrame([(5000, "1")], "id long, n string"), T, mode="ignore_unknown")
    assert left.version is version and left.files_rewritten == 0
    with pytest.raises(ValueError):
        file_changes.update_files(version, base(), left.version.rows(), T, mode="other")


def test_change_of_an_order_column_ends_the_order(spark, table, base):
    version = made(table, base, order=("n", "id"), bounds=("id",))
    done = file_changes.update_files(version, base(), spark.createDataFrame([(5, 1)], "id long, n int"), T)
    assert version.order == ("n", "id") and done.version.order == ()
    with pytest.raises(ValueError, match="no order"):
        file_index.page_indexed(done.version)


def test_delete_by_file(spark, table, base):
    version = made(table, base)
    gone = table.filter("id < 100 OR id = 555").select("id")
    done = file_changes.delete_files(version, base(), gone)
    assert done.files_rewritten == 2 and rows(done.version.rows()) == rows(changes.delete(table, gone))
    assert file_changes.delete_files(version, base(), gone.filter("false")).version is version
    # unclustered tables give the same rows
    loose = versions.create_version(table, base(), n_files=4)
    assert rows(file_changes.delete_files(loose, base(), gone).version.rows()) == rows(changes.delete(table, gone))
    everything = file_changes.delete_files(version, base(), table.select("id"))
    assert everything.version.count() == 0 and everything.version.rows().collect() == []


def test_cascade_by_file(spark, base):
    parent = TableContract("p", (Column("id", "bigint", primary=True),))
    child = TableContract("c", (
        Column("id", "bigint", primary=True), Column("p", "bigint", foreign_key=ForeignKey("p", "id", "CASCADE"))))
    other = TableContract("o", (Column("id", "bigint", primary=True), Column("c", "bigint", foreign_key=ForeignKey("c", "id", "SET NULL"))))
    tables = {
        "p": spark.range(100), "c": spark.range(1000).select("id", F.expr("id div 10").alias("p")),
        "o": spark.range(500).select("id", (F.col("id") * 2).alias("c"))}
    held = {n: versions.create_version(df, base(), ["id"], df.columns, 5) for n, df in tables.items()}
    contracts, keys = [parent, child, other], spark.createDataFrame([(3,), (4,)], "id long")
    done = file_changes.delete_files_with_actions(held, {n: base() for n in held}, contracts, "p", keys)
    from keelrow.operators import actions
    plain = actions.delete_with_actions(tables, contracts, "p", keys)
    assert {n: rows(d.version.rows()) for n, d in done.items()} == {n: rows(df) for n, df in plain.tables.items()}
    assert {n: d.files_rewritten for n, d in done.items()} == {"p": 1, "c": 1, "o": 1}
    strict = TableContract("c", (Column("id", "bigint", primary=True), Column("p", "bigint", foreign_key=ForeignKey("p", "id"))))
    with pytest.raises(changes.Refused):
        file_changes.delete_files_with_actions(held, {n: base() for n in held}, [parent, strict, other], "p", keys)


def batch(spark):
    return spark.createDataFrame([
        ("1500", "new", "1", "3"), ("1501", "name 77", "1", None), ("5", "other", "1", None), ("1502", "twice", "1", "1500"),
        ("1503", "twice", "1", None), ("1504", "lost", "1", "99999"), ("1505", "bad", "x", "1500"), ("1506", "after bad", "2", "1505"),
        ("1507", None, "2", "998")], "id string, name string, n string, up string")


def test_indexed_insert_reads_few_files_and_rejects_the_same(spark, table, base):
    version = made(table, base, 20, order=("id",), bounds=("id",))
    filters = file_index.build_filters(version, [("id",), ("name",)], f"{version.path}/filters")
    for rows_in in (batch(spark), batch(spark).limit(0)):
        done = file_index.insert_indexed(version, filters, base(), rows_in, T, mode="quarantine")
        plain = changes.insert(table, rows_in, T, mode="quarantine")
        assert rows(done.rejected) == rows(plain.rejected) and rows(done.accepted) == rows(plain.accepted)
        assert rows(done.version.rows()) == rows(plain.rows)
        # ids 5, 3, 998 and the name of 77 lie in three files; others are false hits of the filters
        assert done.files_read <= 6 and done.files_total == 20
        # the merged filters know the new rows
        again = file_index.insert_indexed(done.version, done.filters, base(), plain.accepted, T, mode="quarantine")
        assert again.accepted.count() == 0 and again.rejected.count() == plain.accepted.count()


def test_indexed_insert_is_strict(spark, table, base):
    version = made(table, base, 5)
    filters = file_index.build_filters(version, [("id",), ("name",)], f"{version.path}/filters")
    with pytest.raises(changes.Refused):
        file_index.insert_indexed(version, filters, base(), batch(spark), T)


def test_filters_have_no_false_miss_and_few_false_hits(spark, table, base, monkeypatch):
    version = made(table, base, 10, order=(), bounds=())
    filters = file_index.build_filters(version, [("name",)], f"{version.path}/filters")
    known = table.filter("id % 50 = 0").select("name")
    held = {r["name"] for r in versions.holding(version, version.files(), known, [("name", "name")]).collect()}
    found = {r["name"] for r in file_index.files_that_may_hold(version, filters, ["name"], known).collect()}
    assert held <= found
    strangers = spark.range(10).select(F.concat(F.lit("stranger "), F.col("id").cast("string")).alias("name"))
    assert file_index.files_that_may_hold(version, filters, ["name"], strangers).count() <= 3
    # files without a filter are always met; so are all where too many keys are asked for
    assert file_index.files_that_may_hold(version, filters.filter("false"), ["name"], strangers).count() == 10
    monkeypatch.setattr(file_index, "PROBES", 5)
    assert file_index.files_that_may_hold(version, filters, ["name"], strangers).count() == 10


def test_pages_read_one_or_two_files(spark, base):
    df = spark.range(3000).select((F.col("id") % 40).alias("k"), (F.col("id") % 3).alias("x"), F.lit("same").alias("y"))
    version = versions.create_version(df, base(), ["k", "x", "y"], ["k"], 12)
    plain = sorted(map(tuple, df.collect()))
    for number in (1, 7, 16, 30):
        files, _ = file_index.page_files(version, number, 100)
        assert 1 <= files.count() <= 2
        assert [tuple(r) for r in file_index.page_indexed(version, number, 100).collect()] == plain[(number - 1) * 100:number * 100]
    assert file_index.page_indexed(version, 31, 100).collect() == []


TERMS = [("nee", False), ("NEEDLE", False), ("ne_dle", False), ("n%dle", False), ("ab", False), ("%", False), ("100%", True), ("éclair", False),
         ("needle in", True), ("zzz", False), (r"a\%b", False), ("", False)]


def test_indexed_search_equals_the_plain_one(spark, base):
    texts = ["a needle in hay", "hay " * 500, None, "", "Éclair 100%", "a%b", "nope", "ne dle", "x" * 20_000 + "needle"]
    df = spark.createDataFrame([(i, t, "note" if i % 4 else None) for i, t in enumerate(texts * 3)], "id int, text string, other string")
    version = versions.create_version(df, base(), ["id"], ["id"], 9)
    grams = file_index.build_trigrams(version, f"{version.path}/trigrams")
    for term, literal in TERMS:
        assert rows(file_index.search_indexed(version, grams, term, literal)) == rows(search.search(df, term, literal)), term
    assert file_index.files_with_term(version, grams, "needle").count() < 9
    assert file_index.files_with_term(version, grams, "zzz").count() == 0
    # appended files are read until the index covers them
    more = versions.append_rows(version, base(), spark.createDataFrame([(99, "zzz", None)], df.schema))
    assert [r["id"] for r in file_index.search_indexed(more, grams, "zzz").collect()] == [99]
    later = file_index.build_trigrams(more, f"{more.path}/trigrams", grams)
    assert file_index.files_with_term(more, later, "zzz").count() == 1
    assert rows(file_index.search_indexed(more, later, "needle")) == rows(search.search(more.rows(), "needle"))


def test_zorder_prunes_by_either_column(spark, tmp_path):
    df = spark.range(20_000).select(
        (F.xxhash64("id") % 1000).alias("a"), F.sha2(F.col("id").cast("string"), 256).alias("b"), F.lit(1).alias("c"))
    written = layout.write_zordered(df, str(tmp_path / "z"), ["a", "b"], 64)
    assert rows(written) == rows(df)
    for column in ("a", "b"):
        ends = written.groupBy(F.col("_metadata.file_name")).agg(F.min(column).alias("low"), F.max(column).alias("high")).collect()
        values = sorted(e["low"] for e in ends)
        met = [sum(e["low"] <= v <= e["high"] for e in ends) / len(ends) for v in values]
        assert len(ends) > 50 and sum(met) / len(met) <= 0.4
    names = spark.createDataFrame([], "a long, b string, d date, t timestamp_ntz, f double, g boolean")
    assert layout.write_zordered(names, str(tmp_path / "e"), ["a", "b", "d", "t", "f", "g"]).count() == 0
    with pytest.raises(ValueError):
        layout.write_zordered(spark.createDataFrame([], "x array<int>"), str(tmp_path / "f"), ["x"])
