"""Evolution, ledger, exchange and streaming over the given tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from keelrow import Column, ForeignKey, Index, TableContract
from keelrow.functions.text import checksum
from keelrow.operators import checks
from keelrow.plans import evolve as ev
from keelrow.plans import ledger as led
from keelrow.session import scratch_path
from keelrow.sources import csv_files, dumps, json_files, layout, scripts
from keelrow.streaming import importing
from registry.catalog_queries import _diff, _operations_sql
from registry.contract_queries import _orphan_count_sql, _rule_sql, _unique_count_sql
from registry.star import (
    LEDGER_SQL, LINEITEM, ORDERS, STAR, ledger_of_events, returned_lines_without_quantity, table,
)

CONTRACTS = {c.name: c for c in STAR}

# ------------------------------------------------------------------ evolution

_CHANNEL = Column("o_channel", "text", not_null=True, default="'web'")
_RATING = Column("o_rating", "integer", default="5")
_GIFT = Column("o_gift", "boolean", default="false")


def _evolved(spark, sf_dir, ops, names=("orders",)):
    return ev.evolve({n: table(spark, sf_dir, n) for n in names}, {n: CONTRACTS[n] for n in names}, ops)


def evolve_add(spark, sf_dir):
    ops = [ev.add_column("orders", c) for c in (_CHANNEL, _RATING, _GIFT, Column("o_note", "varchar(10)"))]
    return _evolved(spark, sf_dir, ops).tables["orders"]


def evolve_drop(spark, sf_dir):
    return _evolved(spark, sf_dir, [ev.drop_column("orders", ORDERS.column("o_totalprice"))]).tables["orders"]


def _restored(spark, sf_dir):
    op = ev.drop_column("orders", ORDERS.column("o_totalprice"))
    dropped = _evolved(spark, sf_dir, [op])
    back = ev.evolve(dropped.tables, dropped.contracts, [ev.inverse(op)])
    return ev.restore_column(back.tables["orders"], table(spark, sf_dir, "orders"), ["o_orderkey"], "o_totalprice")


def evolve_restore(spark, sf_dir):
    """A dropped column comes back with the values of the version before."""
    return _restored(spark, sf_dir)


def _modify_ops():
    def to(name, **changes):
        old = LINEITEM.column(name)
        return ev.modify_column("lineitem", replace(old, **changes), old)
    return [to("l_quantity", type="integer"), to("l_linenumber", type="text"), to("l_extendedprice", type="numeric(12,1)"),
            to("l_shipdate", type="date"), to("l_tax", not_null=False, default=None)]


def evolve_modify(spark, sf_dir):
    return _evolved(spark, sf_dir, _modify_ops(), ("lineitem",)).tables["lineitem"]


def evolve_rename(spark, sf_dir):
    return _evolved(
        spark, sf_dir, [ev.rename_column("orders", ORDERS.column("o_totalprice"), "o_amount")]
    ).tables["orders"]


def _plan_ops():
    priority = ORDERS.column("o_orderpriority")
    return [
        ev.add_column("orders", _CHANNEL), ev.rename_column("orders", ORDERS.column("o_orderstatus"), "o_state"),
        ev.modify_column("orders", replace(ORDERS.column("o_custkey"), type="text"), ORDERS.column("o_custkey")),
        ev.modify_column("orders", replace(priority, type="varchar(20)", not_null=False), priority),
        ev.add_column("orders", _RATING), ev.create_index("orders", Index("ix_state", ("o_state",))),
    ]


def evolve_plan(spark, sf_dir):
    return _evolved(spark, sf_dir, _plan_ops()).tables["orders"]


def evolve_rollback(spark, sf_dir):
    """A plan, then its inverses: the table it started from."""
    done = _evolved(spark, sf_dir, _plan_ops())
    return ev.evolve(done.tables, done.contracts, ev.inverses(_plan_ops())).tables["orders"]


def evolve_refusals(spark, sf_dir):
    """What the rows refuse: casts, missing values, duplicates, orphans, a missing default."""
    names = ("customer", "orders", "lineitem")
    tables = {n: table(spark, sf_dir, n) for n in names}
    tables["lineitem"] = returned_lines_without_quantity(spark, sf_dir)
    tables["customer"] = tables["customer"].filter("c_acctbal > 0")
    contracts = {n: CONTRACTS[n] for n in names}
    priority, quantity = ORDERS.column("o_orderpriority"), LINEITEM.column("l_quantity")
    done = ev.evolve(tables, contracts, [
        ev.modify_column("orders", replace(priority, type="integer"), priority),
        ev.add_column("orders", Column("o_required", "text", not_null=True)),
        ev.modify_column("lineitem", quantity, replace(quantity, not_null=False)),
        ev.create_index("lineitem", Index("ux_line", ("l_orderkey", "l_linenumber"), unique=True)),
        ev.add_foreign_key("orders", ORDERS.column("o_custkey"), ForeignKey("customer", "c_custkey")),
    ])
    return done.report()


_REFUSALS_SQL = "\nUNION ALL\n".join((
    _rule_sql("type", "orders", "o_orderpriority", "", "o_orderpriority must be integer", "SELECT count(*) AS n FROM orders"),
    _rule_sql("not_null", "orders", "o_orderpriority", "", "o_orderpriority must not be null",
              "SELECT count(*) FILTER (WHERE o_orderpriority IS NULL) AS n FROM orders"),
    _rule_sql("not_null", "orders", "o_required", "", "o_required must not be null", "SELECT count(*) AS n FROM orders"),
    _rule_sql("not_null", "lineitem", "l_quantity", "", "l_quantity must not be null",
              "SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS n FROM lineitem"),
    _rule_sql("unique_index", "lineitem", "l_orderkey,l_linenumber", "ux_line", "l_orderkey,l_linenumber must be unique",
              _unique_count_sql("lineitem", ["l_orderkey", "l_linenumber"])),
    _rule_sql("foreign_key", "orders", "o_custkey", "", "o_custkey must exist in customer.c_custkey",
              _orphan_count_sql("orders", "o_custkey", "(SELECT * FROM customer WHERE c_acctbal > 0)", "c_custkey")),
))


# ------------------------------------------------------------------ ledger

def _scripts(spark, sf_dir):
    """Documents as change scripts; some lack a section."""
    lang = F.col("lang")
    head = F.when(lang == "de", F.lit("")).otherwise(F.lit("-- Up Migration\n"))
    mark = F.when(lang == "fr", F.lit("")).otherwise(F.lit("\n-- Down Migration (Rollback)\n"))
    rule = F.when(lang == "es", F.lit("")).otherwise(F.lit("-- =======================\n"))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("script_"), F.lpad(F.col("doc_id").cast("string"), 10, "0")).alias("name"),
        F.concat(head, F.lit(" \t\n"), "text", F.lit(" \n"), mark, rule, F.lit("\n\n"), "source", F.lit("\r\n ")).alias("content"),
    )


def script_sections(spark, sf_dir):
    return scripts.script_sections(_scripts(spark, sf_dir))


_SPACES = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160)"
_SCRIPTS_SQL = f"""
WITH s AS (SELECT *, 'script_' || lpad(CAST(doc_id AS VARCHAR), 10, '0') AS name,
           trim(text, {_SPACES}) AS up_text FROM documents),
p AS (SELECT name, lang, source,
      CASE WHEN lang = 'de' THEN NULL
           WHEN lang = 'fr' THEN up_text || ' ' || chr(10) || '-- =======================' || chr(10) || chr(10) || chr(10) || source
           ELSE up_text END AS up,
      CASE WHEN lang IN ('fr', 'es') THEN NULL ELSE source END AS down FROM s)
"""


def _document_scripts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("run_"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("name"),
        checksum(F.col("text")).alias("checksum"),
    )


def _document_ledger(spark, sf_dir):
    """Runs of documents as scripts: what ran in one language has another text now."""
    return ledger_of_events(spark, sf_dir).drop("checksum").join(
        table(spark, sf_dir, "documents").select(
            F.concat(F.lit("run_"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("name"),
            F.when(F.col("lang") == "fr", checksum(F.col("source"))).otherwise(checksum(F.col("text"))).alias("checksum"),
        ), "name")


def status_applied_pending_failed(spark, sf_dir):
    return led.status(ledger_of_events(spark, sf_dir), _document_scripts(spark, sf_dir))


def pending_scripts(spark, sf_dir):
    return led.pending(_document_scripts(spark, sf_dir), ledger_of_events(spark, sf_dir)).select("name")


def failed_runs(spark, sf_dir):
    return led.with_status(ledger_of_events(spark, sf_dir), "failed")


def top_k_history(spark, sf_dir):
    return led.history(ledger_of_events(spark, sf_dir), 25)


def history_filtered(spark, sf_dir):
    return led.history(ledger_of_events(spark, sf_dir), 0, "URCH")


def history_numbered(spark, sf_dir):
    return led.history_numbered(ledger_of_events(spark, sf_dir), 40)


def history_summary(spark, sf_dir):
    return led.history_summary(ledger_of_events(spark, sf_dir)).withColumn("seconds", F.round("seconds", 2))


def log_recent(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("logged_at"),
        F.when(F.col("event_type") == "error", F.lit("ERROR")).otherwise(F.lit("INFO")).alias("level"),
        F.col("props").alias("message"))
    return led.log(rows)


def rollback_candidates(spark, sf_dir):
    return led.rollback_candidates(ledger_of_events(spark, sf_dir), 7).select("name", "applied_at")


def latest_runs(spark, sf_dir):
    """Users as names: the newest run of each."""
    runs = ledger_of_events(spark, sf_dir).drop("name").withColumnRenamed("executed_by", "name")
    return led.latest(runs)


def checksum_drift(spark, sf_dir):
    return led.checksum_drift(_document_ledger(spark, sf_dir), _document_scripts(spark, sf_dir))


def drift_report(spark, sf_dir):
    report = checks.check_foreign_key(
        table(spark, sf_dir, "orders"), ["o_custkey"], table(spark, sf_dir, "customer").filter("c_acctbal > 0"),
        ["c_custkey"], "orders", "customer")
    return led.drift_report(_diff(spark, sf_dir), report, ledger_of_events(spark, sf_dir), _document_scripts(spark, sf_dir))


def _ran_ledger(spark, sf_dir):
    """Three steps over orders, the last one rolled back again."""
    ledger = led.Ledger(spark, scratch_path(spark, "ledger"), {"orders": f"{sf_dir}/orders.parquet"},
                        {"orders": ORDERS}, user="registry")
    priority = ORDERS.column("o_orderpriority")
    ledger.apply_pending([
        led.Step("003_state", (ev.rename_column("orders", ORDERS.column("o_orderstatus"), "o_state"),)),
        led.Step("001_channel", (ev.add_column("orders", _CHANNEL), ev.add_column("orders", _RATING))),
        led.Step("002_priority", (ev.modify_column("orders", replace(priority, type="varchar(20)"), priority),)),
    ])
    ledger.rollback(1)
    return ledger


def ledger_current_table(spark, sf_dir):
    return spark.read.parquet(_ran_ledger(spark, sf_dir).paths()["orders"])


def ledger_rows(spark, sf_dir):
    """What the ledger says about each run: its newest state and how often it was written."""
    ledger = _ran_ledger(spark, sf_dir)
    written = ledger.rows().groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"))
    rows_now = spark.read.parquet(ledger.paths()["orders"]).agg(F.count(F.lit(1)).alias("n_orders"))
    return led.latest(ledger.rows()).select("name", "status", "table_affected", "executed_by").join(
        written, "name").withColumn("n_orders", F.lit(rows_now.first()[0]))


_STATUS_SQL = f"""
WITH l AS ({LEDGER_SQL}), d AS (SELECT 'run_' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS name FROM documents)
SELECT 'applied' AS state, name, CAST(NULL AS VARCHAR) AS error_message FROM l WHERE status = 'success'
UNION ALL SELECT 'pending', name, NULL FROM d WHERE name NOT IN (SELECT name FROM l WHERE status = 'success')
UNION ALL SELECT 'failed', name, error_message FROM l WHERE status = 'failed'
"""

# ------------------------------------------------------------------ exchange


def render_insert(spark, sf_dir):
    return dumps.render_inserts(table(spark, sf_dir, "documents"), "documents")


def render_insert_typed(spark, sf_dir):
    return dumps.render_inserts(
        table(spark, sf_dir, "events").withColumn("seen", F.col("event_type") == "view").withColumn(
            "value", F.when(F.col("event_type") != "error", F.col("value"))), "events")


_DOCUMENTS = TableContract("documents", (
    Column("doc_id", "bigint", primary=True), Column("text", "text", not_null=True), Column("lang", "varchar(2)"),
    Column("source", "text"), Column("n_chars", "bigint"),
))


def _no_rows(spark, contract):
    return spark.createDataFrame([], contract.struct())


def csv_round_trip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    csv_files.export_csv(table(spark, sf_dir, "documents"), path, empty_text=True)
    return csv_files.import_csv(spark, path, _no_rows(spark, _DOCUMENTS), _DOCUMENTS, empty_text=True).rows


def csv_typed_round_trip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    csv_files.export_csv(table(spark, sf_dir, "orders"), path)
    return csv_files.import_csv(
        spark, path, _no_rows(spark, ORDERS), ORDERS, {"customer": table(spark, sf_dir, "customer")}, multi_line=False,
    ).rows


def json_round_trip(spark, sf_dir):
    path = scratch_path(spark, "json")
    json_files.export_json(table(spark, sf_dir, "documents"), path)
    return json_files.import_json(spark, path, _no_rows(spark, _DOCUMENTS), _DOCUMENTS).rows


def sql_round_trip(spark, sf_dir):
    path = scratch_path(spark, "sql")
    dumps.export_sql(table(spark, sf_dir, "documents"), path, "documents")
    return dumps.import_sql(spark, path, _no_rows(spark, _DOCUMENTS), _DOCUMENTS).rows


def clustered_layout(spark, sf_dir):
    """Lines clustered by date, then read for one month."""
    clustered = layout.write_clustered(table(spark, sf_dir, "lineitem"), scratch_path(spark, "clustered"), ["l_shipdate"])
    return clustered.filter("l_shipdate >= TIMESTAMP_NTZ '1998-03-01' AND l_shipdate < TIMESTAMP_NTZ '1998-04-01'")


def stream_import(spark, sf_dir):
    """Orders arrive as CSV files and are imported as a stream; unknown customers are set aside."""
    folder, base = scratch_path(spark, "arriving"), scratch_path(spark, "imported")
    csv_files.export_csv(table(spark, sf_dir, "orders"), folder)
    rows = importing.arriving_csv(spark, folder, ORDERS, ORDERS.names, multi_line=False)
    known = table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    importing.stream_import(rows, base, ORDERS, lambda: {"customer": known}).awaitTermination()
    return spark.read.parquet(f"{base}/orders").select(*ORDERS.names)


def stream_import_json(spark, sf_dir):
    """Orders arrive as JSON Lines; objects with a key that is no column are set aside."""
    return spark.read.parquet(f"{_json_stream(spark, sf_dir)}/orders").select(*ORDERS.names)


def stream_import_rejects(spark, sf_dir):
    """What that stream set aside, by reason."""
    rejected = spark.read.parquet(f"{_json_stream(spark, sf_dir)}/orders_rejects")
    return rejected.select(F.explode("violations").alias("rule"), F.length("record").alias("length")).groupBy("rule").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("length").alias("shortest"))


def _json_stream(spark, sf_dir) -> str:
    folder, base = scratch_path(spark, "arriving"), scratch_path(spark, "imported")
    orders = table(spark, sf_dir, "orders")
    fields = F.struct(*ORDERS.names, F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).alias("o_extra"))
    lines = F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("broken "), F.to_json(fields))).otherwise(F.to_json(fields))
    orders.select(lines.alias("value")).write.text(folder)
    rows = importing.arriving_json(spark, folder, ORDERS, ORDERS.names)
    known = table(spark, sf_dir, "customer")
    importing.stream_import(rows, base, ORDERS, lambda: {"customer": known}).awaitTermination()
    return base


def _user_ledger(spark, sf_dir):
    """events as a ledger with many rows for each name: what a user did last is the state."""
    kind = F.col("event_type")
    state = (
        F.when(kind == "error", "failed").when(kind == "click", "rolled_back").when(kind == "view", "resolved").otherwise("success"))
    return ledger_of_events(spark, sf_dir).join(
        table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), state.alias("now")), "id"
    ).withColumns({"name": F.col("executed_by"), "status": F.col("now")}).drop("now")


def _customer_scripts(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("user_"), F.col("c_custkey").cast("string")).alias("name"))


def ledger_status_now(spark, sf_dir):
    return led.status(_user_ledger(spark, sf_dir), _customer_scripts(spark, sf_dir))


def ledger_summary_now(spark, sf_dir):
    return led.history_summary(_user_ledger(spark, sf_dir)).withColumn("seconds", F.round("seconds", 2))


def ledger_rollback_now(spark, sf_dir):
    return led.rollback_candidates(_user_ledger(spark, sf_dir), 50).select("name", "id")


QUERIES = {
    f.__name__: f for f in (
        evolve_add, evolve_drop, evolve_restore, evolve_modify, evolve_rename, evolve_plan, evolve_rollback,
        evolve_refusals, script_sections, status_applied_pending_failed, pending_scripts, failed_runs, top_k_history,
        history_filtered, history_numbered, history_summary, log_recent, rollback_candidates, latest_runs,
        checksum_drift, drift_report, render_insert, render_insert_typed, csv_round_trip, csv_typed_round_trip,
        json_round_trip, sql_round_trip, clustered_layout, stream_import, ledger_current_table, ledger_rows,
        stream_import_json, stream_import_rejects, ledger_status_now, ledger_summary_now, ledger_rollback_now,
    )
}

_LITERAL = """CASE WHEN regexp_matches({0}, '[\\n\\r]') THEN
 'E''' || replace(replace(replace(replace({0}, '''', ''''''), '\\', '\\x5C'), chr(10), '\\n'), chr(13), '\\r') || ''''
 ELSE '''' || replace({0}, '''', '''''') || '''' END"""

_USER_LEDGER_SQL = """
WITH l AS (SELECT 'user_' || user_id AS name, arg_max(event_id, (ts, event_id)) AS id, max(ts) AS applied_at,
  arg_max(CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'rolled_back' WHEN 'view' THEN 'resolved' ELSE 'success' END,
          (ts, event_id)) AS status,
  arg_max({'s': CASE WHEN event_type <> 'view' THEN value END}, (ts, event_id)).s AS seconds,
  arg_max({'m': CASE WHEN event_type = 'error' THEN props END}, (ts, event_id)).m AS error_message
  FROM events GROUP BY user_id)
"""
_NO_EXTRA = "o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P'"

ORACLES = {
    "stream_import_json": f"SELECT * FROM orders WHERE {_NO_EXTRA} AND o_custkey IN (SELECT c_custkey FROM customer)",
    "stream_import_rejects": """
        SELECT rule, count(*) AS n_rows, min(n)::INTEGER AS shortest FROM (
            SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'malformed' ELSE 'unknown_key:o_extra' END AS rule,
                length('{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus
                    || '","o_totalprice":,"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000')
                    || '","o_orderpriority":"' || o_orderpriority || '"}')
                + length(CAST(o_totalprice AS VARCHAR))
                + CASE WHEN o_orderstatus = 'P' THEN length(',"o_extra":""') + length(o_orderpriority) ELSE 0 END
                + CASE WHEN o_orderpriority = '5-LOW' THEN 7 ELSE 0 END AS n
            FROM orders WHERE o_orderpriority = '5-LOW' OR o_orderstatus = 'P') GROUP BY rule""",
    "ledger_status_now": _USER_LEDGER_SQL + """
        SELECT 'applied' AS state, name, CAST(NULL AS VARCHAR) AS error_message FROM l WHERE status = 'success'
        UNION ALL SELECT 'pending', 'user_' || c_custkey, NULL FROM customer
            WHERE 'user_' || c_custkey NOT IN (SELECT name FROM l WHERE status = 'success')
        UNION ALL SELECT 'failed', name, error_message FROM l WHERE status = 'failed'""",
    "ledger_summary_now": _USER_LEDGER_SQL + """
        SELECT count(*) AS total, count(*) FILTER (status = 'success') AS successful, count(*) FILTER (status = 'failed') AS failed,
               round(coalesce(sum(seconds) FILTER (seconds > 0), 0.0), 2) AS seconds
        FROM l WHERE status IN ('success', 'failed')""",
    "ledger_rollback_now": _USER_LEDGER_SQL + """
        SELECT name, id FROM l WHERE status = 'success' ORDER BY applied_at DESC, id DESC LIMIT 50""",
    "evolve_add": """SELECT *, 'web' AS o_channel, CAST(5 AS INTEGER) AS o_rating, false AS o_gift, CAST(NULL AS VARCHAR) AS o_note FROM orders""",
    "evolve_drop": "SELECT * EXCLUDE (o_totalprice) FROM orders",
    "evolve_restore": "SELECT * FROM orders",
    "evolve_modify": """SELECT * REPLACE (CAST(round(l_quantity) AS INTEGER) AS l_quantity, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
                        CAST(l_extendedprice AS DECIMAL(12,1)) AS l_extendedprice, CAST(l_shipdate AS DATE) AS l_shipdate) FROM lineitem""",
    "evolve_rename": "SELECT * RENAME (o_totalprice AS o_amount) FROM orders",
    "evolve_plan": """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus AS o_state, o_totalprice, o_orderdate,
                      o_orderpriority, 'web' AS o_channel, CAST(5 AS INTEGER) AS o_rating FROM orders""",
    "evolve_rollback": "SELECT * FROM orders",
    "evolve_refusals": _REFUSALS_SQL,
    "script_sections": _SCRIPTS_SQL + """
        SELECT name, up, down, sha256(up) AS checksum,
               CASE WHEN lang = 'fr' THEN 'does not contain rollback section' WHEN lang = 'de' THEN 'does not contain up migration section'
                    WHEN lang = 'es' THEN 'does not contain valid rollback section' END AS error FROM p""",
    "status_applied_pending_failed": _STATUS_SQL,
    "pending_scripts": f"SELECT name FROM ({_STATUS_SQL}) WHERE state = 'pending'",
    "failed_runs": f"SELECT * FROM ({LEDGER_SQL}) WHERE status = 'failed'",
    "top_k_history": f"SELECT * FROM ({LEDGER_SQL}) ORDER BY applied_at DESC, id DESC LIMIT 25",
    "history_filtered": f"SELECT * FROM ({LEDGER_SQL}) WHERE table_affected ILIKE '%urch%'",
    "history_numbered": f"""
        SELECT row_number() OVER (ORDER BY applied_at DESC, id DESC) AS number, status,
               CASE WHEN length(name) > 23 THEN substr(name, 1, 20) || '...' ELSE name END AS name,
               CASE WHEN seconds > 0 THEN seconds END AS seconds, coalesce(nullif(executed_by, ''), 'N/A') AS executed_by,
               strftime(applied_at, '%Y-%m-%d %H:%M') AS applied_at, substr(checksum, 1, 8) || '...' AS checksum
        FROM ({LEDGER_SQL}) ORDER BY number LIMIT 40""",
    "history_summary": f"""
        SELECT count(*) AS total, count(*) FILTER (WHERE status = 'success') AS successful,
               count(*) FILTER (WHERE status = 'failed') AS failed, round(coalesce(sum(seconds) FILTER (WHERE seconds > 0), 0), 2) AS seconds
        FROM ({LEDGER_SQL})""",
    "log_recent": """SELECT event_id AS id, ts AS logged_at, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
                     props AS message FROM events ORDER BY ts DESC, event_id DESC LIMIT 50""",
    "rollback_candidates": f"SELECT name, applied_at FROM ({LEDGER_SQL}) WHERE status = 'success' ORDER BY applied_at DESC, id DESC LIMIT 7",
    "latest_runs": f"""
        SELECT executed_by AS name, id, applied_at, seconds, status, error_message, checksum, table_affected FROM (
          SELECT *, row_number() OVER (PARTITION BY executed_by ORDER BY applied_at DESC, id DESC) AS rn FROM ({LEDGER_SQL})) WHERE rn = 1""",
    "checksum_drift": f"""
        SELECT l.name, sha256(d.source) AS applied_checksum, sha256(d.text) AS current_checksum
        FROM ({LEDGER_SQL}) l JOIN documents d ON l.id = d.doc_id WHERE l.status = 'success' AND d.lang = 'fr'""",
    "drift_report": _operations_sql(False) + f"""
        , st AS ({_STATUS_SQL})
        SELECT CASE kind WHEN 'CREATE_TABLE' THEN 'missing_table' WHEN 'DROP_TABLE' THEN 'orphaned_table' WHEN 'ADD_COLUMN' THEN 'missing_column'
               WHEN 'DROP_COLUMN' THEN 'orphaned_column' WHEN 'MODIFY_COLUMN' THEN 'column_mismatch' WHEN 'CREATE_INDEX' THEN 'missing_index'
               ELSE 'foreign_key_mismatch' END AS kind, table_name AS "table", coalesce(column_name, index_name) AS name, count(*) AS n_rows
        FROM ops GROUP BY 1, 2, 3
        UNION ALL SELECT 'broken_foreign_key', 'orders', 'o_custkey', count(*) FROM orders
          WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) HAVING count(*) > 0
        UNION ALL SELECT state || '_script', NULL, name, 1 FROM st WHERE state <> 'applied'""",
    "render_insert": f"""
        SELECT 'INSERT INTO documents ("doc_id", "text", "lang", "source", "n_chars") VALUES (' || doc_id || ', ' || {_LITERAL.format('text')}
          || ', ''' || lang || ''', ''' || source || ''', ' || n_chars || ');' AS statement FROM documents""",
    "render_insert_typed": """
        SELECT 'INSERT INTO events ("event_id", "ts", "user_id", "event_type", "value", "props", "seen") VALUES (' || event_id || ', '''
          || CAST(ts AS VARCHAR) || ''', ' || user_id || ', ''' || event_type || ''', '
          || CASE WHEN event_type <> 'error' THEN CAST(value AS VARCHAR) ELSE 'NULL' END || ', ''' || props || ''', '
          || CASE WHEN event_type = 'view' THEN 'true' ELSE 'false' END || ');' AS statement FROM events""",
    "csv_round_trip": "SELECT * FROM documents",
    "csv_typed_round_trip": "SELECT * FROM orders",
    "json_round_trip": "SELECT * FROM documents",
    "sql_round_trip": "SELECT * FROM documents",
    "ledger_current_table": "SELECT *, 'web' AS o_channel, CAST(5 AS INTEGER) AS o_rating FROM orders",
    "ledger_rows": """
        SELECT name, status, 'orders' AS table_affected, 'registry' AS executed_by, n_rows, (SELECT count(*) FROM orders) AS n_orders
        FROM (VALUES ('001_channel', 'success', 1::BIGINT), ('002_priority', 'success', 1), ('003_state', 'rolled_back', 2)) AS t(name, status, n_rows)""",
    "clustered_layout": "SELECT * FROM lineitem WHERE l_shipdate >= '1998-03-01' AND l_shipdate < '1998-04-01'",
    "stream_import": "SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
}
