"""Files of any size, renames and index drift, defaults, tables that come and go, hashed layouts and followed logs."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from keelrow import Column, TableContract, fixed_values as fv
from keelrow.functions.defaults import default_value
from keelrow.operators import catalog_diff, changes, renames
from keelrow.plans import evolve as ev
from keelrow.plans import ledger as led
from keelrow.session import scratch_path
from keelrow.sources import csv_files, json_files, layout
from keelrow.streaming import follow, importing, late_parents
from registry.run_queries import _DOCUMENTS, _no_rows
from registry.star import ORDERS, ORDERS_V2_SQL, STAR, order_versions, table

# ------------------------------------------------------------------ files that are split


def csv_multiline_split(spark, sf_dir):
    """Texts with line breaks, commas and quotes in files that many tasks read."""
    path = scratch_path(spark, "csv")
    csv_files.export_csv(table(spark, sf_dir, "documents"), path, empty_text=True)
    return csv_files.import_csv(spark, path, _no_rows(spark, _DOCUMENTS), _DOCUMENTS, split=True, empty_text=True).rows


def _array_files(spark, sf_dir, text):
    """documents as JSON array files, several objects each."""
    path = scratch_path(spark, "arrays")
    docs = table(spark, sf_dir, "documents").withColumn("part", F.col("doc_id") % 8).withColumn("record", text)
    first = docs.groupBy("part").agg(F.min("doc_id").alias("first"))
    lines = docs.join(F.broadcast(first), "part").select(
        "part", F.lit(1).alias("place"), "doc_id", F.concat(F.when(F.col("doc_id") == F.col("first"), "").otherwise(","), "record").alias("value"))
    ends = [first.select("part", F.lit(i).alias("place"), F.lit(0).cast("long").alias("doc_id"), F.lit(b).alias("value")) for i, b in ((0, "["), (2, "]"))]
    lines.unionByName(ends[0]).unionByName(ends[1]).repartition("part").sortWithinPartitions("part", "place", "doc_id").select(
        "part", "value").write.partitionBy("part").text(path)
    return path


def json_array_round_trip(spark, sf_dir):
    path = _array_files(spark, sf_dir, F.to_json(F.struct(*_DOCUMENTS.names)))
    return json_files.import_json(spark, path, _no_rows(spark, _DOCUMENTS), _DOCUMENTS, array_files=True).rows


def json_array_rejects(spark, sf_dir):
    """French texts are no valid objects; what is set aside is their text as it came."""
    fields = F.to_json(F.struct("doc_id", "lang", "source"))
    broken = F.concat(F.lit("{\"doc_id\" "), F.col("doc_id").cast("string"), F.lit(", \"note\": \"} {[\"}"))
    path = _array_files(spark, sf_dir, F.when(F.col("lang") == "fr", broken).otherwise(fields))
    contract = TableContract("documents", tuple(replace(c, not_null=False) for c in _DOCUMENTS.columns))
    done = json_files.import_json(spark, path, _no_rows(spark, contract), contract, mode="quarantine", array_files=True)
    return done.rejected.select(F.array_join("violations", ",").alias("violations"), "record")


# ------------------------------------------------------------------ renames and indexes

_RENAMED = {"o_custkey": "buyer", "o_orderpriority": "urgency", "o_orderdate": "placed_at"}


def rename_by_data(spark, sf_dir):
    """A later version of orders in which three columns have other names and some rows other values."""
    old, new = order_versions(spark, sf_dir)
    return renames.rename_by_data(old, new.withColumnsRenamed(_RENAMED)).withColumn("similarity", F.round("similarity", 6))


def _rename_sql() -> str:
    def sketch(source, column):
        return f"""SELECT DISTINCT md5(CAST({column} AS VARCHAR)) AS h FROM {source} WHERE {column} IS NOT NULL ORDER BY h LIMIT 256"""
    pairs = [(o, n) for o in _RENAMED for p, n in _RENAMED.items() if o == p]
    parts = [f"""
SELECT '{o}' AS old_column, '{n}' AS new_column,
       (SELECT round(count(*) FILTER (sides = 2) / count(*), 6) FROM (
            SELECT h, count(*) AS sides FROM (SELECT h FROM ({sketch("orders", o)}) UNION ALL SELECT h FROM ({sketch("v2", o)}))
            GROUP BY h ORDER BY h LIMIT 256)) AS similarity""" for o, n in pairs]
    return f"WITH v2 AS ({ORDERS_V2_SQL})" + "\nUNION ALL\n".join(parts)


def _indexes(spark, sf_dir):
    """An index of each order on the table of its customer, as wanted and as it is."""
    orders = table(spark, sf_dir, "orders")
    key, priority = F.col("o_orderkey").cast("string"), F.col("o_orderpriority")
    wanted = orders.select(
        F.concat(F.lit("t_"), F.col("o_custkey").cast("string")).alias("table_name"), F.concat(F.lit("ix_"), key).alias("index_name"),
        F.concat(F.lit("c_"), key, F.lit(",id")).alias("column_names"), (F.col("o_orderstatus") == "F").alias("is_unique"),
        F.lit("btree").alias("method"), "o_orderpriority", "o_orderstatus")
    existing = wanted.filter(priority != "1-URGENT").select(
        "table_name", F.when(priority == "2-HIGH", F.concat(F.lit("old_"), "index_name")).otherwise(F.col("index_name")).alias("index_name"),
        F.when(F.col("o_orderstatus") == "P", "id").otherwise(F.col("column_names")).alias("column_names"), "is_unique",
        F.when(priority == "5-LOW", "hash").otherwise("btree").alias("method"))
    return wanted, existing


def index_drift(spark, sf_dir):
    return catalog_diff.index_drift(*_indexes(spark, sf_dir))


def drift_report_indexes(spark, sf_dir):
    """A report in which the operations say nothing and the indexes everything."""
    none = spark.createDataFrame([], "kind string, table_name string, column_name string, index_name string")
    report = spark.createDataFrame([], "type string, table string, column string, index string, message string, severity string, n_rows long")
    scripts = spark.createDataFrame([], "name string")
    found = led.drift_report(none, report, spark.createDataFrame([], led.LEDGER_SCHEMA), scripts, index_drift(spark, sf_dir))
    return found.groupBy("kind").agg(F.sum("n_rows").alias("n_rows"), F.count_distinct("name").alias("n_names"))


# ------------------------------------------------------------------ defaults, tables, layouts, logs

def default_functions(spark, sf_dir):
    """What the functions among the defaults give on every customer: types and counts."""
    made = table(spark, sf_dir, "customer").select(
        default_value("now()", "timestamptz").alias("now"), default_value("CURRENT_DATE", "date").alias("today"),
        default_value("uuid_generate_v4()", "uuid").alias("uuid"), default_value("gen_random_uuid()", "uuid").alias("other"),
        default_value("CURRENT_TIME", "time").alias("time"))
    types = {f.name: f.dataType.simpleString() for f in made.schema.fields}
    shape = "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    return made.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("uuid").alias("n_uuids"), F.count_if(F.col("uuid") == F.col("other")).alias("n_equal"),
        F.count_if(F.rlike("uuid", F.lit(shape))).alias("n_version_4"), F.count_distinct("now").alias("n_times"),
        F.count_if(F.abs(F.date_diff("today", F.col("now").cast("date"))) <= 1).alias("n_today"),
        F.count_if(F.rlike("time", F.lit(r"^\d\d:\d\d:\d\d\.\d{6}$"))).alias("n_clock")).withColumn(
        "types", F.lit(",".join(f"{k}:{v}" for k, v in sorted(types.items()))))


def create_and_fill(spark, sf_dir):
    """A table made from its contract, then filled with rows given as text."""
    made = layout.create_table(spark, scratch_path(spark, "created"), ORDERS)
    rows = table(spark, sf_dir, "orders").select(*[F.col(c).cast("string").alias(c) for c in ORDERS.names])
    return changes.insert(made, rows, ORDERS, {"customer": table(spark, sf_dir, "customer")}).rows


def drop_and_recreate(spark, sf_dir):
    """A dropped table is gone from the plan, its inverse brings it back empty, its old rows stay where they were."""
    tables, contracts = {"lineitem": table(spark, sf_dir, "lineitem")}, {c.name: c for c in STAR if c.name == "lineitem"}
    drop = ev.drop_table(contracts["lineitem"])
    gone = ev.evolve(tables, contracts, [drop])
    back = ev.evolve(gone.tables, gone.contracts, [ev.inverse(drop)])
    held = back.tables["lineitem"]
    before = tables["lineitem"].count()
    columns = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in held.schema.fields)
    return held.agg(F.count(F.lit(1)).alias("n_rows")).withColumns({
        "n_tables_between": F.lit(len(gone.tables) + len(gone.contracts)), "n_before": F.lit(before).cast("long"), "columns": F.lit(columns)})


def hash_layout_join(spark, sf_dir):
    """Orders and their lines in buckets of the order key: joined and counted without a shuffle."""
    return bucketed_join(spark, sf_dir).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


def bucketed_join(spark, sf_dir):
    name = f"keelrow_{uuid.uuid4().hex}"
    held = [
        layout.write_bucketed(table(spark, sf_dir, t), f"{name}_{t}", [key], 8, scratch_path(spark, t))
        for t, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey"))]
    return held[0].join(held[1].withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")


def followed_log(spark, sf_dir):
    """events appended to a log in two steps; a follower that is stopped in between reads every row of its levels once."""
    base, sink = scratch_path(spark, "log"), scratch_path(spark, "followed")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("logged_at"), F.col("event_type").alias("level"), F.col("props").alias("message"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user_name"), F.lit(None).cast("string").alias("details"),
        F.lit("run").alias("run_name"))
    for half in (0, 1):
        rows.filter(F.col("id") % 2 == half).write.mode("append").parquet(f"{base}/{fv.LOG_TABLE}")
        follow.follow_log(spark, base, ("error", "purchase")).writeStream.format("parquet").option("path", sink).option(
            "checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(led.LOG_SCHEMA).parquet(sink)


def _late_import(spark, sf_dir) -> str:
    """Orders arrive at once, customers in three steps and a quarter of them never; each step is a run of its own."""
    base = scratch_path(spark, "late")
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey")
    csv_files.export_csv(orders, f"{base}/in/orders")
    for i, wanted in enumerate(("c_custkey % 2 = 0", "c_custkey % 4 = 1", "c_custkey = -1")):
        rows = customers.filter(wanted)
        # the last step brings a stranger a day later: time has passed
        at = "2024-01-01 00:00:00" if i < 2 else "2024-01-02 00:00:00"
        rows = rows if i < 2 else customers.limit(1).select((-F.col("c_custkey") - 7).alias("c_custkey"))
        rows.withColumn("arrived", F.lit(at).cast("timestamp")).write.mode("append").parquet(f"{base}/in/customers")
        children = importing.arriving_csv(spark, f"{base}/in/orders", ORDERS, ORDERS.names, multi_line=False).withColumn(
            "arrived", F.lit("2024-01-01 00:00:00").cast("timestamp"))
        parents = spark.readStream.schema("c_custkey long, arrived timestamp").parquet(f"{base}/in/customers")
        late_parents.stream_import_late_parents(children, parents, f"{base}/out", ORDERS, "o_custkey", "c_custkey").awaitTermination()
    return f"{base}/out"


def stream_import_late_parents(spark, sf_dir):
    return spark.read.parquet(f"{_late_import(spark, sf_dir)}/orders").select(*ORDERS.names)


def stream_late_parents_rejects(spark, sf_dir):
    """Orders whose customer never came."""
    rejected = spark.read.parquet(f"{_late_import(spark, sf_dir)}/orders_rejects")
    return rejected.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.array_join("violations", ",").alias("violations"))


_PLAN_NOTE = Column("o_note", "text", unique=True, default="'same'")


def evolve_taken_back(spark, sf_dir):
    """A unique column whose default would repeat is added, renamed and dropped again: nothing is refused."""
    renamed = replace(_PLAN_NOTE, name="o_remark")
    ops = [
        ev.add_column("orders", _PLAN_NOTE), ev.rename_column("orders", _PLAN_NOTE, "o_remark"), ev.drop_column("orders", renamed),
        ev.add_column("orders", Column("o_rating", "integer", default="5"))]
    return ev.evolve({"orders": table(spark, sf_dir, "orders")}, {"orders": ORDERS}, ops).require_allowed().tables["orders"]


QUERIES = {
    f.__name__: f for f in (
        csv_multiline_split, json_array_round_trip, json_array_rejects, rename_by_data, index_drift, drift_report_indexes,
        default_functions, create_and_fill, drop_and_recreate, hash_layout_join, followed_log, evolve_taken_back,
        stream_import_late_parents, stream_late_parents_rejects,
    )
}

_INDEX_SQL = """
WITH w AS (SELECT 't_' || o_custkey AS t, 'ix_' || o_orderkey AS i, 'c_' || o_orderkey || ',id' AS c, o_orderstatus = 'F' AS u,
                  o_orderpriority AS p, o_orderstatus AS s FROM orders),
e AS (SELECT t, CASE WHEN p = '2-HIGH' THEN 'old_' || i ELSE i END AS i, CASE WHEN s = 'P' THEN 'id' ELSE c END AS c, u,
             CASE WHEN p = '5-LOW' THEN 'hash' ELSE 'btree' END AS m FROM w WHERE p <> '1-URGENT'),
d AS (
  SELECT 'missing_index' AS kind, t AS table_name, i AS index_name, '' AS details FROM w WHERE (t, i) NOT IN (SELECT t, i FROM e)
  UNION ALL SELECT 'extra_index', t, i, '' FROM e WHERE (t, i) NOT IN (SELECT t, i FROM w)
  UNION ALL SELECT 'index_mismatch', t, i, concat_ws('; ', CASE WHEN e.c <> w.c THEN 'column_names: ' || e.c || ' → ' || w.c END,
      CASE WHEN e.m <> 'btree' THEN 'method: hash → btree' END)
  FROM w JOIN e USING (t, i) WHERE e.c <> w.c OR e.m <> 'btree')
"""

ORACLES = {
    "csv_multiline_split": "SELECT * FROM documents",
    "json_array_round_trip": "SELECT * FROM documents",
    "json_array_rejects": """
        SELECT 'malformed' AS violations, '{"doc_id" ' || doc_id || ', "note": "} {["}' AS record FROM documents WHERE lang = 'fr'""",
    "rename_by_data": _rename_sql(),
    "index_drift": _INDEX_SQL + "SELECT * FROM d",
    "drift_report_indexes": _INDEX_SQL + """
        SELECT kind, count(*) AS n_rows, count(DISTINCT index_name) AS n_names FROM d GROUP BY kind""",
    "default_functions": """
        SELECT count(*) AS n_rows, count(*) AS n_uuids, 0::BIGINT AS n_equal, count(*) AS n_version_4, 1::BIGINT AS n_times,
               count(*) AS n_today, count(*) AS n_clock,
               'now:timestamp,other:string,time:string,today:date,uuid:string' AS types FROM customer""",
    "create_and_fill": "SELECT * FROM orders",
    "drop_and_recreate": """
        SELECT 0::BIGINT AS n_rows, 0 AS n_tables_between, count(*) AS n_before,
               'l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int,l_quantity:double,l_extendedprice:double,l_discount:double,'
               || 'l_tax:double,l_returnflag:string,l_linestatus:string,l_shipdate:timestamp_ntz' AS columns FROM lineitem""",
    "hash_layout_join": """
        SELECT o_orderstatus, count(*) AS n_lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderstatus""",
    "followed_log": """
        SELECT event_id AS id, ts AS logged_at, event_type AS level, props AS message, 'user_' || user_id AS user_name,
               CAST(NULL AS VARCHAR) AS details, 'run' AS run_name FROM events WHERE event_type IN ('error', 'purchase')""",
    "stream_import_late_parents": "SELECT * FROM orders WHERE o_custkey % 4 <> 3",
    "stream_late_parents_rejects": """
        SELECT o_orderkey, 'foreign_key:o_custkey' AS violations FROM orders WHERE o_custkey % 4 = 3""",
    "evolve_taken_back": "SELECT *, 5 AS o_rating FROM orders",
}
