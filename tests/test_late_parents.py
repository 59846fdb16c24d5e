"""Children that wait for their parents, over restarts from the checkpoint."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from keelrow import Column, ForeignKey, TableContract
from keelrow.streaming import importing, late_parents

CHILD = TableContract("child", (
    Column("id", "bigint", primary=True), Column("p", "integer", foreign_key=ForeignKey("parent", "id")), Column("n", "integer", not_null=True)))


def at(minute):
    return datetime(2024, 1, 1, 0, minute)


@pytest.fixture
def place(spark, tmp_path):
    def arrive(children=(), parents=()):
        if children:
            spark.createDataFrame(list(children), "id string, p string, n string, arrived timestamp").coalesce(1).write.mode(
                "append").parquet(str(tmp_path / "children"))
        if parents:
            spark.createDataFrame(list(parents), "id int, arrived timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "parents"))
        rows = spark.readStream.schema("id string, p string, n string, arrived timestamp").parquet(str(tmp_path / "children")).withColumns(
            {importing.CORRUPT: F.lit(None).cast("string"), "source_file": F.col("_metadata.file_name")})
        known = spark.readStream.schema("id int, arrived timestamp").parquet(str(tmp_path / "parents"))
        late_parents.stream_import_late_parents(rows, known, str(tmp_path / "out"), CHILD, "p", "id", patience="10 minutes").awaitTermination()
        accepted = spark.read.schema("id long, p int, n int").parquet(str(tmp_path / "out/child"))
        rejected = spark.read.schema("id string, violations array<string>").parquet(str(tmp_path / "out/child_rejects"))
        return sorted(r["id"] for r in accepted.collect()), sorted((int(r["id"]), *r["violations"]) for r in rejected.collect())
    return arrive


def test_children_wait_and_are_given_up(place):
    first = place([("1", "7", "1", at(0)), ("2", "8", "1", at(0)), ("3", None, "1", at(0)), ("4", "7", None, at(0))], [(9, at(0))])
    assert first == ([3], [])
    # a parent that arrives later lets its children in; one of them breaks another rule
    second = place([("5", "9", "1", at(5)), ("6", "x", "1", at(5))], [(7, at(5))])
    assert second == ([1, 3, 5], [(4, "not_null:n"), (6, "type:p")])
    # time passes: what still waits is given up, what arrives behind the clock is not dropped
    third = place([("10", "7", "1", at(1))], [(100, at(30))])
    assert third == ([1, 3, 5, 10], [(2, "foreign_key:p"), (4, "not_null:n"), (6, "type:p")])
    # too late: the child is gone, a new one of the same parent is not
    fourth = place([("11", "8", "1", at(31))], [(8, at(31))])
    assert fourth == ([1, 3, 5, 10, 11], third[1])


def test_many_children_of_one_parent_are_dealt_over_salts(place, monkeypatch):
    children = [(str(i), "7", "1", at(0)) for i in range(200)]
    assert place(children, [(1, at(0))])[0] == []
    assert place((), [(7, at(1)), (7, at(1))])[0] == list(range(200))


def test_time_is_over_once_it_has_passed_and_parents_stay_known(place, monkeypatch):
    # no value's children are a call of Python each
    monkeypatch.setattr("pyspark.sql.GroupedData.transformWithState", None)
    assert place([("1", "7", "1", at(0)), ("2", "8", "1", at(1)), ("2", "8", "2", at(1))], [(100, at(9))]) == ([], [])
    assert place((), [(7, at(9)), (7, at(9))]) == ([1], [])
    # the clock stands while nothing newer arrives; a child behind it whose parent is known goes on
    assert place([("3", "7", "1", at(0))], [(101, at(10))]) == ([1, 3], [])
    # both rows of the repeated key are given up at the last moment of their patience, each once
    assert place((), [(102, at(11))]) == ([1, 3], [(2, "foreign_key:p"), (2, "foreign_key:p")])
    assert place((), [(8, at(12))])[0] == [1, 3]


def test_children_of_many_values_are_given_up_once(place, monkeypatch):
    monkeypatch.setattr("pyspark.sql.GroupedData.transformWithState", None)
    children = [(str(i), str(i), "1", at(0)) for i in range(300)]
    lost = [(i, "foreign_key:p") for i in range(300) if i % 3]
    assert place(children, [*((i, at(0)) for i in range(0, 300, 3)), (1000, at(30))]) == ([*range(0, 300, 3)], lost)
    assert place((), [(1, at(31))]) == ([*range(0, 300, 3)], lost)
