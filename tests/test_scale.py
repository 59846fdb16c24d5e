"""Plans that must hold at scale: hot keys are split, scans are narrow, nothing is paired blindly."""

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from keelrow import Column, ForeignKey, TableContract
from keelrow.operators import actions, changes, checks, row_diff
from keelrow.session import RECOMMENDED_CONF

# small thresholds make small data count as skewed, and no side as small
SKEW_CONF = {
    **RECOMMENDED_CONF,
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
}


@contextmanager
def settings(spark, conf):
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


ROW = TableContract("hot", (
    Column("id", "bigint", primary=True), Column("k", "bigint", foreign_key=ForeignKey("parent", "k", "CASCADE")),
    Column("text", "text"),
))
PARENT = TableContract("parent", (Column("k", "bigint", primary=True),))


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """A third of all rows share one key."""
    path = str(tmp_path_factory.mktemp("hot") / "t")
    spark.range(300_000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50_000).alias("k"),
        F.sha2(F.col("id").cast("string"), 256).alias("text"),
    ).repartition(12).write.parquet(path)
    return spark.read.parquet(path)


def executed(df):
    """Run to the end; the final adaptive plan and the number of rows."""
    query = df._jdf.queryExecution()
    rows = query.toRdd().count()
    return query.executedPlan().toString(), rows


JOINS = {
    "orphan_rows": lambda s, hot, few: checks.orphan_rows(hot, ["k"], few.filter("k > 100"), ["k"]),
    "set_null": lambda s, hot, few: actions.replace_reference(hot, ROW, "k", few.filter("k < 100"), "k", "SET NULL"),
    "duplicate_rows": lambda s, hot, few: checks.duplicate_rows(hot, ["k"]),
    "delete": lambda s, hot, few: changes.delete(hot, few.filter("k > 100").select("k")),
    "update_keys": lambda s, hot, few: actions.update_keys(
        hot, ROW, "k", few.select(F.col("k").alias("old"), (F.col("k") + 1_000_000).alias("new"))),
    "update": lambda s, hot, few: changes.updated(
        hot, few.select("k", F.lit("new").alias("text")), ROW, key=["k"]),
    "insert": lambda s, hot, few: changes.tag_batch(hot, ROW, None, {"parent": few.filter("k > 100")}),
}


@pytest.mark.parametrize("name", sorted(JOINS))
def test_hot_key_is_split(name, spark, hot):
    few = spark.range(50_000).select(F.col("id").alias("k"))
    with settings(spark, SKEW_CONF):
        plan, _ = executed(JOINS[name](spark, hot, few))
    assert "skew=true" in plan, plan


def test_key_checks_shuffle_one_row_per_key_and_task(spark, hot):
    """Counting keys combines before the shuffle, so the hot key is a handful of rows in it."""
    few = spark.range(50_000).select(F.col("id").alias("k"))
    for df in (checks.check_unique(hot, ["k"]), checks.check_foreign_key(hot, ["k"], few, ["k"]),
               row_diff.diff_rows(hot, hot, ["id"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        first_exchange = plan[plan.rindex("Exchange hashpartitioning"):]
        assert "partial_" in first_exchange


def test_hot_copies_cancel_in_a_diff(spark):
    copies = spark.range(60_000).select(F.lit(1).alias("k"), F.lit("same").alias("v"))
    other = copies.union(spark.createDataFrame([(1, "new"), (2, "x")], "k int, v string"))
    got = {r["k"]: (r["change"], r["n_rows"]) for r in row_diff.diff_rows(copies, other, ["k"]).collect()}
    assert got == {1: ("ADD", 1), 2: ("ADD", 1)}


def test_hot_cascade_is_exact(spark, hot):
    parents = spark.range(50_000).select(F.col("id").alias("k"))
    keys = spark.createDataFrame([(7,)], "k long")
    with settings(spark, SKEW_CONF):
        done = actions.delete_with_actions({"hot": hot, "parent": parents}, [ROW, PARENT], "parent", keys)
        assert done.tables["hot"].count() == hot.filter("k <> 7").count()


QUERIES = entry_module.queries()
# these write files or build catalogs on the way, which takes long for a look at a plan
SLOW = ("round_trip", "ledger_", "stream_import", "catalog", "diff_summary", "diff_lines", "operation_counts", "rename", "drift")
# the training-data operators may use Python and are looked at beside them
OPTIONAL = re.compile(r"op\d+_|pipeline$")


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not OPTIONAL.match(n) and not any(s in n for s in SLOW)))
def test_plans_have_no_python_and_no_blind_pairs(name, spark, sf_dir):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups"):
        assert word not in plan, plan
    if "BroadcastNestedLoopJoin" in plan:
        pytest.fail(plan)


def test_no_query_plans_a_whole_table_window(spark, sf_dir):
    """Windows without a partition only ever see a limited set or one row per partition."""
    for name in ("history_numbered", "page_deep", "apply_defaults"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        window = plan.find("Window [")
        if window >= 0:
            assert re.search(r"TakeOrderedAndProject|HashAggregate", plan[window:])


def test_scans_read_only_what_they_need(spark, sf_dir):
    plan = QUERIES["check_fk_orders"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        assert len(schema.split(",")) <= 2, schema
    plan = QUERIES["clustered_layout"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan
