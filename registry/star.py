"""Contracts of the given tables, and the relations with faults that queries derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelrow import Column, ForeignKey, TableContract


def _ref(table: str, column: str, on_delete: str = "CASCADE") -> ForeignKey:
    return ForeignKey(table, column, on_delete, "CASCADE")


REGION = TableContract("region", (
    Column("r_regionkey", "integer", primary=True),
    Column("r_name", "varchar(25)", unique=True, not_null=True),
))
NATION = TableContract("nation", (
    Column("n_nationkey", "integer", primary=True),
    Column("n_name", "varchar(25)", unique=True, not_null=True),
    Column("n_regionkey", "integer", not_null=True, foreign_key=_ref("region", "r_regionkey")),
))
CUSTOMER = TableContract("customer", (
    Column("c_custkey", "bigint", primary=True),
    Column("c_name", "varchar(25)", unique=True, not_null=True),
    Column("c_nationkey", "integer", not_null=True, foreign_key=_ref("nation", "n_nationkey")),
    Column("c_acctbal", "double precision", not_null=True),
    Column("c_mktsegment", "varchar(9)", not_null=True, default="BUILDING"),
))
SUPPLIER = TableContract("supplier", (
    Column("s_suppkey", "bigint", primary=True),
    Column("s_name", "varchar(25)", unique=True, not_null=True),
    Column("s_nationkey", "integer", not_null=True, foreign_key=_ref("nation", "n_nationkey")),
    Column("s_acctbal", "double precision", not_null=True),
))
PART = TableContract("part", (
    Column("p_partkey", "bigint", primary=True),
    Column("p_name", "varchar(55)", unique=True, not_null=True),
    Column("p_brand", "varchar(10)", not_null=True),
    Column("p_type", "varchar(25)", not_null=True),
    Column("p_size", "integer", not_null=True),
    Column("p_retailprice", "double precision", not_null=True),
))
ORDERS = TableContract("orders", (
    Column("o_orderkey", "bigint", primary=True),
    Column("o_custkey", "bigint", not_null=True, foreign_key=_ref("customer", "c_custkey")),
    Column("o_orderstatus", "varchar(1)", not_null=True, default="O"),
    Column("o_totalprice", "double precision", not_null=True),
    Column("o_orderdate", "timestamp", not_null=True),
    Column("o_orderpriority", "varchar(15)", not_null=True),
))
LINEITEM = TableContract("lineitem", (
    Column("l_orderkey", "bigint", primary=True, foreign_key=_ref("orders", "o_orderkey")),
    Column("l_partkey", "bigint", not_null=True, foreign_key=_ref("part", "p_partkey")),
    Column("l_suppkey", "bigint", not_null=True, foreign_key=_ref("supplier", "s_suppkey")),
    Column("l_linenumber", "integer", primary=True),
    Column("l_quantity", "double precision", not_null=True),
    Column("l_extendedprice", "double precision", not_null=True),
    Column("l_discount", "double precision", not_null=True, default="0"),
    Column("l_tax", "double precision", not_null=True, default="0"),
    Column("l_returnflag", "varchar(1)", not_null=True),
    Column("l_linestatus", "varchar(1)", not_null=True),
    Column("l_shipdate", "timestamp", not_null=True),
))
STAR = (REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDERS, LINEITEM)
STAR_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey",
             "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
EVENTS_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {c.name: table(spark, sf_dir, c.name) for c in STAR}


def returned_lines_without_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with NULL quantities on returned lines."""
    return table(spark, sf_dir, "lineitem").withColumn(
        "l_quantity", F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))
    )


def order_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """orders, and a later version: one priority gone, one repriced, one copied to new keys."""
    old = table(spark, sf_dir, "orders")
    kept = old.filter("o_orderpriority <> '1-URGENT'").withColumn(
        "o_totalprice",
        F.when(F.col("o_orderpriority") == "2-HIGH", F.col("o_totalprice") * 2)
        .otherwise(F.col("o_totalprice")),
    ).withColumn(
        "o_orderstatus",
        F.when((F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderstatus") == "P"), F.lit(None))
        .otherwise(F.col("o_orderstatus")),
    )
    added = old.filter("o_orderpriority = '5-LOW'").withColumn(
        "o_orderkey", F.col("o_orderkey") + 1_000_000_000_000
    )
    return old, kept.unionByName(added)


def ledger_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events read as a ledger of runs."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("run_"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("name"),
        F.col("ts").alias("applied_at"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("seconds"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("executed_by"),
        F.when(F.col("event_type") == "error", F.lit("failed")).otherwise(F.lit("success")).alias("status"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error_message"),
        F.sha2(F.col("props"), 256).alias("checksum"),
        F.when(F.col("event_type") != "signup", F.col("event_type")).alias("table_affected"),
    )


LEDGER_SQL = """
SELECT event_id AS id, 'run_' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS name, ts AS applied_at,
       CASE WHEN event_type <> 'view' THEN value END AS seconds,
       'user_' || CAST(user_id AS VARCHAR) AS executed_by,
       CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
       CASE WHEN event_type = 'error' THEN props END AS error_message,
       sha256(props) AS checksum,
       CASE WHEN event_type <> 'signup' THEN event_type END AS table_affected
FROM events
"""

ORDERS_V2_SQL = """
SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
       o_orderdate, o_orderpriority
FROM orders WHERE o_orderpriority <> '1-URGENT'
UNION ALL
SELECT o_orderkey + 1000000000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE o_orderpriority = '5-LOW'
"""
