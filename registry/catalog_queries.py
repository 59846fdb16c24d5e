"""Catalog operators over an estate that the given tables describe.

Every customer is a table, every order a column of its customer's table, every event an index.
The estate grows with the data, and its names, types and references hold the faults the
operators look for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelrow.operators import audit as audit_ops
from keelrow.operators import catalog, catalog_diff
from registry.scalar_queries import (
    DEFAULT_TEXTS, TYPE_NAMES, _SUPPORTED, compatible_sql, default_error_sql, pick, same_default_sql, significant_sql,
    sql_pick,
)
from registry.star import table

ACTIONS = ("CASCADE", "set null", "DESTROY", "")

# ------------------------------------------------------------------ information-schema relations


def _raw(spark, sf_dir) -> dict[str, DataFrame]:
    customers = table(spark, sf_dir, "customer")
    orders, events = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    name = F.concat(F.lit("t_"), F.col("c_custkey").cast("string"))
    raw_tables = customers.select(
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("audit")).otherwise(F.lit("public")).alias("table_schema"),
        F.when(F.col("c_acctbal") > 9900, F.lit("schema_migrations")).otherwise(name).alias("table_name"),
        F.when(F.col("c_acctbal") < 0, F.lit("VIEW")).otherwise(F.lit("BASE TABLE")).alias("table_type"),
    )
    t_name = F.concat(F.lit("t_"), F.col("o_custkey").cast("string"))
    c_name = F.concat(F.lit("c_"), F.col("o_orderkey").cast("string"))
    raw_columns = orders.select(
        t_name.alias("table_name"), c_name.alias("column_name"), F.col("o_orderkey").alias("ordinal_position"),
        pick(TYPE_NAMES, F.col("o_orderkey")).alias("data_type"),
        F.when(F.col("o_orderstatus") == "F", F.lit("NO")).otherwise(F.lit("YES")).alias("is_nullable"),
        F.when(F.col("o_orderstatus") == "P", pick(DEFAULT_TEXTS, F.col("o_custkey"))).alias("column_default"),
    )
    # a key, a unique constraint and composite references of each table; all tables use the same names
    kind = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("PRIMARY KEY"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("UNIQUE"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("FOREIGN KEY"))
    )
    constrained = orders.withColumn("kind", kind).filter("kind IS NOT NULL").withColumn(
        "constraint_name",
        F.when(F.col("kind") == "FOREIGN KEY", F.concat(F.lit("fk_"), F.col("o_orderstatus")))
        .otherwise(F.when(F.col("kind") == "UNIQUE", F.lit("uq")).otherwise(F.lit("pk"))),
    ).select("constraint_name", t_name.alias("table_name"), c_name.alias("column_name"), "kind",
             F.col("o_orderkey").alias("ordinal_position"), "o_orderkey", "o_orderstatus")
    # every key column is also unique by a constraint of its own
    doubled = constrained.filter("kind = 'PRIMARY KEY'").withColumn("kind", F.lit("UNIQUE")).withColumn(
        "constraint_name", F.concat(F.lit("also_"), F.col("constraint_name"))
    )
    usage = constrained.unionByName(doubled)
    # few tables with wide indexes of the same names
    indexed = events.withColumns({
        "index_name": F.concat(F.lit("ix_"), F.col("event_type")),
        "table_name": F.concat(F.lit("t_"), (F.col("user_id") % 7).cast("string"))})
    return {
        "tables": raw_tables, "columns": raw_columns,
        "constraints": usage.select("constraint_name", "table_name", F.col("kind").alias("constraint_type")).distinct(),
        "key_usage": usage.select("constraint_name", "table_name", "column_name", "ordinal_position"),
        "referenced": usage.filter("kind = 'FOREIGN KEY'").select(
            "constraint_name", "table_name", "ordinal_position", F.lit("t_0").alias("ref_table"),
            F.concat(F.lit("r_"), "column_name").alias("ref_column")),
        "rules": usage.filter("kind = 'FOREIGN KEY' AND o_orderstatus <> 'P'").select(
            "constraint_name", "table_name", F.lit("CASCADE").alias("delete_rule"),
            F.lit("NO ACTION").alias("update_rule")).distinct(),
        "index_list": indexed.select("index_name", "table_name").distinct(),
        "index_members": indexed.filter("event_type <> 'error'").select(
            "index_name", "table_name", F.concat(F.lit("c_"), F.col("event_id").cast("string")).alias("column_name"),
            F.col("event_id").alias("member_pos")),
        "index_details": indexed.filter("event_type = 'purchase'").select(
            "index_name", "table_name", F.lit(True).alias("is_unique"), F.lit("hash").alias("method")).distinct(),
    }


_RAW_SQL = f"""
WITH raw_columns AS (
  SELECT 't_' || o_custkey AS table_name, 'c_' || o_orderkey AS column_name, o_orderkey AS ordinal_position,
         {sql_pick(TYPE_NAMES, 'o_orderkey')} AS data_type,
         CASE WHEN o_orderstatus = 'F' THEN 'NO' ELSE 'YES' END AS is_nullable,
         CASE WHEN o_orderstatus = 'P' THEN {sql_pick(DEFAULT_TEXTS, 'o_custkey')} END AS column_default FROM orders),
keyed AS (SELECT *, 't_' || o_custkey AS table_name, 'c_' || o_orderkey AS column_name,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'PRIMARY KEY' WHEN '2-HIGH' THEN 'UNIQUE' WHEN '3-MEDIUM' THEN 'FOREIGN KEY' END AS kind
          FROM orders)
"""


def catalog_tables(spark, sf_dir):
    return catalog.catalog_tables(_raw(spark, sf_dir)["tables"])


def catalog_columns(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return catalog.catalog_columns(raw["columns"], raw["key_usage"], raw["constraints"])


def catalog_fks(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return catalog.catalog_foreign_keys(raw["constraints"], raw["key_usage"], raw["referenced"], raw["rules"])


def catalog_indexes(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return catalog.catalog_indexes(raw["index_list"], raw["index_members"], raw["index_details"])


def index_members(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return catalog.index_members(raw["index_list"], raw["index_members"])


def primary_key_columns(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return catalog.primary_key_columns(raw["constraints"], raw["key_usage"])


# ------------------------------------------------------------------ wanted and existing catalogs

def _wanted(spark, sf_dir) -> catalog.Catalog:
    customers = table(spark, sf_dir, "customer")
    name = F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.col("c_name")).otherwise(
        F.lower(F.replace("c_name", F.lit("#"), F.lit("_"))))
    tables = customers.select(name.alias("table_name"), F.col("c_custkey").alias("table_pos"))
    orders = table(spark, sf_dir, "orders").join(
        tables.withColumnRenamed("table_pos", "o_custkey"), "o_custkey"
    )
    key = F.col("o_orderkey").cast("string")
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    column = (
        F.when(priority == "5-LOW", F.lit("created_at")).when(priority == "2-HIGH", F.concat(F.lit("col "), key))
        .when((priority == "1-URGENT") & (status == "P"), F.lit("")).otherwise(F.concat(F.lit("col_"), key))
    )
    columns = orders.select(
        "table_name", column.alias("column_name"), F.col("o_orderkey").alias("column_pos"),
        pick(TYPE_NAMES, F.col("o_orderkey")).alias("data_type"), (status != "F").alias("nullable"),
        F.when(status == "P", pick(DEFAULT_TEXTS, F.col("o_custkey"))).alias("column_default"),
        ((priority == "3-MEDIUM") & (status == "F")).alias("is_primary"), F.lit(False).alias("is_unique"),
    )
    fks = orders.filter("o_orderpriority = '4-NOT SPECIFIED'").select(
        F.concat(F.lit("fk_"), key).alias("constraint_name"), "table_name", column.alias("column_name"),
        F.col("o_orderkey").alias("column_pos"),
        F.when(F.col("o_custkey") > 20, F.concat(F.lit("customer_"), F.lpad((F.col("o_custkey") + 1).cast("string"), 9, "0")))
        .otherwise(F.lit("")).alias("ref_table"),
        F.when(status == "O", F.lit("created_at")).when(status == "P", F.concat(F.lit("col_"), key))
        .otherwise(F.lit("")).alias("ref_column"),
        pick(ACTIONS, F.col("o_orderkey")).alias("on_delete"), F.lit("").alias("on_update"),
    )
    events = table(spark, sf_dir, "events").join(
        tables.withColumnRenamed("table_pos", "user_id"), "user_id"
    )
    index = F.concat(F.when(F.col("event_type") == "click", F.lit("idx-")).otherwise(F.lit("idx_")), "event_type",
                     F.when(F.col("value") > 20, F.floor("value").cast("string")).otherwise(F.lit("")))
    indexes = events.select(
        "table_name", index.alias("index_name"), F.col("event_id").alias("index_pos"),
        (F.col("event_type") == "signup").alias("is_unique"), F.lit("btree").alias("method"),
        (F.col("event_type") == "view").alias("on_column"),
    )
    members = events.select(
        "table_name", index.alias("index_name"), F.col("event_id").alias("index_pos"),
        F.when(F.col("value") > 5, F.lit("created_at"))
        .otherwise(F.concat(F.lit("col_"), F.col("event_id").cast("string"))).alias("column_name"),
        F.lit(0).cast("long").alias("member_pos"),
    )
    return catalog.Catalog(tables, columns, fks, indexes, members)


def _existing(spark, sf_dir) -> catalog.Catalog:
    """An older state: fewer tables and columns, other types, rules and references, and left-overs."""
    wanted = _wanted(spark, sf_dir)
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("table_pos"), "c_mktsegment")
    tables = wanted.tables.join(customers, "table_pos").filter("c_mktsegment <> 'MACHINERY'").select(
        "table_name", "table_pos"
    ).unionByName(
        wanted.tables.join(customers, "table_pos").filter("c_mktsegment = 'FURNITURE'")
        .select(F.concat(F.lit("old_"), "table_name").alias("table_name"), "table_pos")
    ).unionByName(
        wanted.tables.join(customers, "table_pos").filter("table_pos = 0").select(
            F.lit("schema_migrations").alias("table_name"), "table_pos")
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("column_pos"), "o_orderpriority", "o_orderstatus", "o_custkey")
    states = wanted.columns.join(orders, "column_pos")
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    kept = states.filter((priority != "1-URGENT") | (status == "F"))
    columns = kept.select(
        "table_name",
        F.when((priority == "3-MEDIUM") & (status == "O"), F.concat(F.lit("extra_"), F.col("column_pos").cast("string")))
        .otherwise(F.col("column_name")).alias("column_name"),
        "column_pos",
        F.when(priority == "2-HIGH", pick(TYPE_NAMES, F.col("column_pos") + F.col("o_custkey")))
        .otherwise(F.col("data_type")).alias("data_type"),
        F.when((priority == "5-LOW") & (status == "O"), F.lit(False)).otherwise(F.col("nullable")).alias("nullable"),
        F.when(status == "P", pick(DEFAULT_TEXTS, F.col("column_pos"))).alias("column_default"),
        "is_primary", "is_unique",
    )
    fks = wanted.foreign_keys.withColumn("constraint_name", F.concat(F.lit("old_"), "constraint_name")).withColumn(
        "on_delete", F.when(F.col("on_delete") == "CASCADE", F.lit("SET DEFAULT")).otherwise(F.upper("on_delete"))
    ).unionByName(states.filter("o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'O'").select(
        F.concat(F.lit("fk_extra_"), F.col("column_pos").cast("string")).alias("constraint_name"), "table_name",
        F.concat(F.lit("extra_"), F.col("column_pos").cast("string")).alias("column_name"), "column_pos",
        F.lit("somewhere").alias("ref_table"), F.lit("id").alias("ref_column"),
        F.lit("CASCADE").alias("on_delete"), F.lit("NO ACTION").alias("on_update"),
    ))
    return catalog.Catalog(
        tables, columns, fks, wanted.indexes.filter("NOT is_unique"), wanted.index_columns.filter(F.lit(False))
    )


_NAME = "CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN c_name ELSE lower(replace(c_name, '#', '_')) END"
_COLUMN = """CASE WHEN o_orderpriority = '5-LOW' THEN 'created_at' WHEN o_orderpriority = '2-HIGH' THEN 'col ' || o_orderkey
             WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN '' ELSE 'col_' || o_orderkey END"""

_WANTED_SQL = f"""
WITH w_tables AS (SELECT {_NAME} AS table_name, c_custkey AS table_pos, c_mktsegment FROM customer),
w_orders AS (SELECT o.*, t.table_name, {_COLUMN} AS column_name FROM orders o JOIN w_tables t ON o_custkey = table_pos),
w_columns AS (
  SELECT table_name, column_name, o_orderkey AS column_pos, {sql_pick(TYPE_NAMES, 'o_orderkey')} AS data_type,
         o_orderstatus <> 'F' AS nullable, CASE WHEN o_orderstatus = 'P' THEN {sql_pick(DEFAULT_TEXTS, 'o_custkey')} END AS column_default,
         o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'F' AS is_primary, false AS is_unique,
         o_orderpriority, o_orderstatus, o_custkey FROM w_orders),
w_fks AS (
  SELECT 'fk_' || o_orderkey AS constraint_name, table_name, column_name, o_orderkey AS column_pos,
         CASE WHEN o_custkey > 20 THEN 'customer_' || lpad(CAST(o_custkey + 1 AS VARCHAR), 9, '0') ELSE '' END AS ref_table,
         CASE o_orderstatus WHEN 'O' THEN 'created_at' WHEN 'P' THEN 'col_' || o_orderkey ELSE '' END AS ref_column,
         {sql_pick(ACTIONS, 'o_orderkey')} AS on_delete, '' AS on_update
  FROM w_orders WHERE o_orderpriority = '4-NOT SPECIFIED'),
w_indexes AS (
  SELECT table_name, CASE WHEN event_type = 'click' THEN 'idx-' ELSE 'idx_' END || event_type
         || CASE WHEN value > 20 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) ELSE '' END AS index_name, event_id AS index_pos,
         event_type = 'signup' AS is_unique, 'btree' AS method, event_type = 'view' AS on_column,
         CASE WHEN value > 5 THEN 'created_at' ELSE 'col_' || event_id END AS column_name
  FROM events JOIN w_tables ON user_id = table_pos),
f_columns AS (SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY column_pos) AS rn,
           count(*) OVER (PARTITION BY table_name, column_name) AS n_definitions FROM w_columns) WHERE rn = 1),
f_indexes AS (SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY table_name, index_name ORDER BY index_pos) AS rn,
           count(*) OVER (PARTITION BY table_name, index_name) AS n_definitions FROM w_indexes) WHERE rn = 1)
"""


def audit_catalog(spark, sf_dir):
    return audit_ops.audit(_wanted(spark, sf_dir), _existing(spark, sf_dir).tables)


def audit_catalog_offline(spark, sf_dir):
    """Findings per type and severity, without a look at existing tables and with exact type names."""
    return audit_ops.audit(_wanted(spark, sf_dir), exact_types=True).groupBy("type", "severity").agg(
        F.count(F.lit(1)).alias("n_findings"), F.sum("n_rows").alias("n_rows")
    )


def _name_error(what: str, s: str) -> str:
    reserved = (
        f"WHEN lower({s}) IN ('user', 'order', 'group', 'table', 'index', 'view', 'schema') "
        f"THEN 'table name ''' || {s} || ''' is a reserved keyword'" if what == "table" else ""
    )
    return f"""CASE WHEN {s} = '' THEN '{what} name cannot be empty'
      WHEN strlen({s}) > 63 THEN '{what} name ''' || {s} || ''' is too long (max 63 characters)'
      WHEN NOT regexp_full_match({s}, '[A-Za-z0-9_]*')
        THEN '{what} name ''' || {s} || ''' contains invalid character ''' || regexp_extract({s}, '[^A-Za-z0-9_]') || ''''
      {reserved} END"""


_FK_ERROR = """CASE WHEN ref_table = '' THEN 'foreign key references table cannot be empty'
  WHEN ref_column = '' THEN 'foreign key references column cannot be empty'
  WHEN ref_table = table_name AND ref_column = column_name THEN 'foreign key cannot reference itself'
  WHEN on_delete <> '' AND upper(on_delete) NOT IN ('CASCADE', 'SET NULL', 'SET DEFAULT', 'RESTRICT', 'NO ACTION')
    THEN 'invalid onDelete action ''' || on_delete || ''', must be one of: [CASCADE SET NULL SET DEFAULT RESTRICT NO ACTION]' END"""


def _audit_sql(exact: bool, online: bool) -> str:
    supported = "lower(data_type)" if exact else "regexp_replace(lower(trim(data_type)), '\\(.*\\)', '')"
    rules = [
        ("table_name", "error", "NULL", "NULL", _name_error("table", "table_name"), "1", "w_tables"),
        ("no_columns", "error", "NULL", "NULL", "'Table ''' || table_name || ''' must have at least one column'", "1",
         "(SELECT * FROM w_tables WHERE table_name NOT IN (SELECT table_name FROM w_columns))"),
        ("no_primary_key", "warning", "NULL", "NULL", "'Table ''' || table_name || ''' has no primary key defined'", "1",
         "(SELECT table_name FROM f_columns GROUP BY table_name HAVING NOT bool_or(is_primary))"),
        ("duplicate_column", "error", "column_name", "NULL",
         "CASE WHEN n_definitions > 1 THEN 'Duplicate column name ''' || column_name || ''' in table ''' || table_name || '''' END",
         "n_definitions - 1", "f_columns"),
        ("column_name", "error", "column_name", "NULL", _name_error("column", "column_name"), "1", "f_columns"),
        ("data_type", "error", "column_name", "NULL",
         f"CASE WHEN {supported} NOT IN ({_SUPPORTED}) THEN 'unsupported data type ''' || data_type || '''' END", "1", "f_columns"),
        ("default_value", "warning", "column_name", "NULL", default_error_sql("data_type", "column_default"), "1", "f_columns"),
        ("duplicate_index", "error", "NULL", "index_name",
         "CASE WHEN n_definitions > 1 THEN 'Duplicate index name ''' || index_name || ''' in table ''' || table_name || '''' END",
         "n_definitions - 1", "f_indexes"),
        ("index_name", "error", "NULL", "index_name", _name_error("index", "index_name"), "1", "f_indexes"),
        ("foreign_key", "error", "column_name", "NULL", _FK_ERROR, "1",
         "(SELECT k.* FROM w_fks k JOIN f_columns c USING (table_name, column_name, column_pos))"),
        ("foreign_key_table_not_found", "error", "column_name", "NULL",
         "'Foreign key references non-existent table ''' || ref_table || ''''", "n",
         """(SELECT table_name, column_name, ref_table, ref_column, count(*) AS n FROM w_fks
             WHERE ref_table NOT IN (SELECT table_name FROM w_tables) GROUP BY ALL)"""),
        ("foreign_key_column_not_found", "error", "column_name", "NULL",
         "'Foreign key references non-existent column ''' || ref_column || ''' in table ''' || ref_table || ''''", "n",
         """(SELECT table_name, column_name, ref_table, ref_column, count(*) AS n FROM w_fks
             WHERE ref_table IN (SELECT table_name FROM w_tables)
               AND (ref_table, ref_column) NOT IN (SELECT (table_name, column_name) FROM w_columns) GROUP BY ALL)"""),
        ("index_column_not_found", "error", "column_name", "index_name",
         "'Index ''' || index_name || ''' references non-existent column ''' || column_name || ''' in table ''' || table_name || ''''",
         "1", "(SELECT * FROM f_indexes WHERE (table_name, column_name) NOT IN (SELECT (table_name, column_name) FROM w_columns))"),
    ]
    if online:
        rules.append((
            "table_exists", "info", "NULL", "NULL", "'Table ''' || table_name || ''' already exists in database'", "1",
            "(SELECT * FROM w_tables WHERE c_mktsegment <> 'MACHINERY')",
        ))
    parts = [
        f"SELECT '{kind}' AS type, table_name AS \"table\", CAST({column} AS VARCHAR) AS \"column\", CAST({index} AS VARCHAR) AS \"index\", "
        f"{text} AS message, '{severity}' AS severity, CAST({n} AS BIGINT) AS n_rows FROM {source} WHERE ({text}) IS NOT NULL"
        for kind, severity, column, index, text, n, source in rules
    ]
    return "\nUNION ALL\n".join(parts)


def _diff(spark, sf_dir, parity=False):
    return catalog_diff.diff_catalog(_wanted(spark, sf_dir), _existing(spark, sf_dir), parity)


def diff_catalog(spark, sf_dir):
    return _diff(spark, sf_dir)


def diff_catalog_parity(spark, sf_dir):
    return _diff(spark, sf_dir, parity=True)


def diff_summary(spark, sf_dir):
    return catalog_diff.diff_summary(_diff(spark, sf_dir))


def diff_lines(spark, sf_dir):
    return catalog_diff.diff_lines(_diff(spark, sf_dir))


def operation_counts(spark, sf_dir):
    return catalog_diff.operation_counts(_diff(spark, sf_dir, parity=True))


def rename_suggestions(spark, sf_dir):
    return catalog_diff.rename_suggestions(_diff(spark, sf_dir))


_EXISTING_SQL = f"""
, e_tables AS (
  SELECT table_name, table_pos FROM w_tables WHERE c_mktsegment <> 'MACHINERY'
  UNION ALL SELECT 'old_' || table_name, table_pos FROM w_tables WHERE c_mktsegment = 'FURNITURE'),
e_all AS (SELECT * FROM w_columns WHERE o_orderpriority <> '1-URGENT' OR o_orderstatus = 'F'),
e_renamed AS (
  SELECT table_name, CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'O' THEN 'extra_' || column_pos ELSE column_name END AS column_name,
         column_pos, CASE WHEN o_orderpriority = '2-HIGH' THEN {sql_pick(TYPE_NAMES, 'column_pos + o_custkey')} ELSE data_type END AS data_type,
         CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN false ELSE nullable END AS nullable,
         CASE WHEN o_orderstatus = 'P' THEN {sql_pick(DEFAULT_TEXTS, 'column_pos')} END AS column_default, is_primary FROM e_all),
e_columns AS (SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY column_pos) AS rn FROM e_renamed) WHERE rn = 1),
e_fks AS (
  SELECT 'old_' || constraint_name AS constraint_name, table_name, column_name, column_pos, ref_table, ref_column,
         CASE WHEN on_delete = 'CASCADE' THEN 'SET DEFAULT' ELSE upper(on_delete) END AS on_delete, on_update FROM w_fks
  UNION ALL SELECT 'fk_extra_' || column_pos, table_name, 'extra_' || column_pos, column_pos, 'somewhere', 'id', 'CASCADE', 'NO ACTION'
  FROM w_columns WHERE o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'O'),
both_tables AS (SELECT table_name, table_pos FROM w_tables WHERE c_mktsegment <> 'MACHINERY'),
created AS (SELECT table_name, table_pos FROM w_tables WHERE c_mktsegment = 'MACHINERY'),
compared AS (
  SELECT b.table_pos, coalesce(n.table_name, o.table_name) AS table_name, coalesce(n.column_name, o.column_name) AS column_name,
         coalesce(n.column_pos, o.column_pos) AS pos, n.data_type AS new_type, o.data_type AS old_type,
         n.nullable AS new_nullable, o.nullable AS old_nullable, n.column_default AS new_default, o.column_default AS old_default,
         n.table_name IS NOT NULL AS in_new, o.table_name IS NOT NULL AS in_old, o.is_primary AS old_primary,
         CASE WHEN n.table_name IS NOT NULL THEN false END AS is_unique
  FROM f_columns n FULL OUTER JOIN e_columns o ON n.table_name = o.table_name AND n.column_name = o.column_name
  JOIN both_tables b ON b.table_name = coalesce(n.table_name, o.table_name)),
changed AS (
  SELECT *, CASE WHEN NOT in_old THEN 'ADD_COLUMN' WHEN NOT in_new THEN 'DROP_COLUMN' ELSE 'MODIFY_COLUMN' END AS kind FROM compared
  WHERE NOT in_old OR NOT in_new OR (NOT old_primary AND CASE WHEN {compatible_sql('old_type', 'new_type')}
     THEN old_nullable <> new_nullable OR NOT ({same_default_sql('old_default', 'new_default')}) ELSE @TYPE@ END)),
new_fks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY constraint_name DESC) AS rn FROM w_fks) WHERE rn = 1),
old_fks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY constraint_name DESC) AS rn FROM e_fks) WHERE rn = 1),
updated AS (
  SELECT n.*, b.table_pos, o.constraint_name AS old_constraint, o.ref_table AS o_table, o.ref_column AS o_column, o.on_delete AS o_delete, o.on_update AS o_update
  FROM new_fks n JOIN old_fks o USING (table_name, column_name) JOIN both_tables b USING (table_name)
  WHERE table_name IN (SELECT table_name FROM changed) AND (n.ref_table <> o.ref_table OR n.ref_column <> o.ref_column
    OR coalesce(nullif(upper(trim(n.on_delete)), ''), 'NO ACTION') <> coalesce(nullif(upper(trim(o.on_delete)), ''), 'NO ACTION')
    OR coalesce(nullif(upper(trim(n.on_update)), ''), 'NO ACTION') <> coalesce(nullif(upper(trim(o.on_update)), ''), 'NO ACTION'))),
"""

_BLANK = {
    "table_pos": "table_pos", "step": "0", "pos": "0", "sub": "0", "kind": "''", "table_name": "table_name",
    "column_name": "NULL", "index_name": "NULL", "constraint_name": "NULL", "new_type": "NULL", "old_type": "NULL",
    "new_nullable": "NULL", "old_nullable": "NULL", "new_default": "NULL", "old_default": "NULL", "is_unique": "NULL",
    "method": "NULL", "ref_table": "NULL", "ref_column": "NULL", "on_delete": "NULL", "on_update": "NULL",
}
_SQL_TYPES = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}


def _op(source: str, **values) -> str:
    given = {**_BLANK, **values}
    columns = ", ".join(
        f"CAST({v} AS {_SQL_TYPES[catalog_diff.OPERATION_COLUMNS[n]]}) AS {n}" for n, v in given.items()
    )
    return f"SELECT {columns} FROM {source}"


def _operations_sql(parity: bool) -> str:
    fk = {c: c for c in ("ref_table", "ref_column", "on_delete", "on_update")}
    old_fk = {"ref_table": "o_table", "ref_column": "o_column", "on_delete": "o_delete", "on_update": "o_update"}
    index = {"kind": "'CREATE_INDEX'", "step": "CASE WHEN on_column THEN 5 ELSE 4 END", "pos": "index_pos",
             "index_name": "index_name", "is_unique": "is_unique", "method": "method"}
    parts = [
        _op("created", kind="'CREATE_TABLE'"),
        _op("changed", kind="kind", pos="pos", column_name="column_name", is_unique="is_unique",
            step="CASE kind WHEN 'ADD_COLUMN' THEN 1 WHEN 'DROP_COLUMN' THEN 2 ELSE 3 END",
            **{c: c for c in ("new_type", "old_type", "new_nullable", "old_nullable", "new_default", "old_default")}),
        _op("(SELECT i.*, b.table_pos FROM f_indexes i JOIN both_tables b USING (table_name) "
            "WHERE (table_name, index_name) NOT IN (SELECT (table_name, index_name) FROM w_indexes WHERE NOT is_unique))", **index),
        _op("updated", kind="'DROP_FOREIGN_KEY'", step="6", pos="column_pos", column_name="column_name",
            constraint_name="old_constraint", **old_fk),
        _op("updated", kind="'ADD_FOREIGN_KEY'", step="6", pos="column_pos", sub="1", column_name="column_name",
            constraint_name="constraint_name", **fk),
        _op("(SELECT o.*, c.table_pos FROM old_fks o JOIN changed c USING (table_name, column_name) WHERE c.kind = 'DROP_COLUMN')",
            kind="'DROP_FOREIGN_KEY'", step="7", pos="column_pos", column_name="column_name", constraint_name="constraint_name", **fk),
        _op("(SELECT * FROM e_tables WHERE table_name NOT IN (SELECT table_name FROM w_tables))", kind="'DROP_TABLE'",
            step="8", pos="table_pos", table_pos=str(1 << 62)),
    ]
    if not parity:
        parts += [
            _op("(SELECT n.*, t.table_pos FROM new_fks n JOIN created t USING (table_name) UNION ALL "
                "SELECT n.*, c.table_pos FROM new_fks n JOIN changed c USING (table_name, column_name) WHERE c.kind = 'ADD_COLUMN')",
                kind="'ADD_FOREIGN_KEY'", step="6", sub="1", pos="column_pos", column_name="column_name",
                constraint_name="constraint_name", **fk),
            _op("(SELECT i.*, t.table_pos FROM f_indexes i JOIN created t USING (table_name))", **index),
        ]
    changes = significant_sql("old_type", "new_type") if parity else "true"
    body = "\nUNION ALL\n".join(parts)
    return f"{_WANTED_SQL}{_EXISTING_SQL.replace('@TYPE@', changes)} ops AS ({body}) "


_LINE_SQL = """
SELECT table_pos, step, pos, sub, table_name, column_name, index_name, kind,
  CASE kind WHEN 'CREATE_TABLE' THEN 'CREATE TABLE ' || table_name WHEN 'DROP_TABLE' THEN 'DROP TABLE ' || table_name
    WHEN 'ADD_COLUMN' THEN 'ADD COLUMN ' || table_name || '.' || column_name || ' (' || new_type || ')'
         || CASE WHEN NOT new_nullable THEN ' NOT NULL' ELSE '' END || coalesce(' DEFAULT ' || new_default, '')
    WHEN 'DROP_COLUMN' THEN 'DROP COLUMN ' || table_name || '.' || column_name
    WHEN 'MODIFY_COLUMN' THEN 'MODIFY COLUMN ' || table_name || '.' || column_name
    WHEN 'CREATE_INDEX' THEN 'CREATE INDEX ' || index_name || ' ON ' || table_name
    WHEN 'ADD_FOREIGN_KEY' THEN 'ADD FOREIGN KEY ' || table_name || '.' || column_name || ' → ' || ref_table || '.' || ref_column
    WHEN 'DROP_FOREIGN_KEY' THEN 'DROP FOREIGN KEY ' || constraint_name END AS line,
  CASE WHEN kind = 'MODIFY_COLUMN' THEN concat_ws('; ',
    CASE WHEN lower(old_type) <> lower(new_type) THEN 'TYPE: ' || old_type || ' → ' || new_type END,
    CASE WHEN old_nullable AND NOT new_nullable THEN 'NOT NULL: ADDED' END,
    CASE WHEN NOT old_nullable AND new_nullable THEN 'NOT NULL: REMOVED' END,
    CASE WHEN old_default IS NULL AND new_default IS NOT NULL THEN 'DEFAULT: ADDED ' || new_default END,
    CASE WHEN old_default IS NOT NULL AND new_default IS NULL THEN 'DEFAULT: REMOVED (was ' || old_default || ')' END,
    CASE WHEN old_default <> new_default THEN 'DEFAULT: ' || old_default || ' → ' || new_default END) END AS details
FROM ops
"""


QUERIES = {
    f.__name__: f for f in (
        catalog_tables, catalog_columns, catalog_fks, catalog_indexes, index_members, primary_key_columns, audit_catalog,
        audit_catalog_offline, diff_catalog, diff_catalog_parity, diff_summary, diff_lines, operation_counts,
        rename_suggestions,
    )
}

_KINDS = ("ADD_COLUMN", "DROP_COLUMN", "MODIFY_COLUMN", "CREATE_INDEX", "ADD_FOREIGN_KEY", "DROP_FOREIGN_KEY")

ORACLES = {
    "catalog_tables": """
        SELECT 't_' || c_custkey AS table_name FROM customer
        WHERE c_mktsegment <> 'HOUSEHOLD' AND c_acctbal BETWEEN 0 AND 9900""",
    "catalog_columns": _RAW_SQL + """
        SELECT c.table_name, c.column_name, c.ordinal_position AS column_pos, c.data_type, c.is_nullable = 'YES' AS nullable,
               c.column_default, coalesce(k.kind = 'PRIMARY KEY', false) AS is_primary,
               coalesce(k.kind IN ('PRIMARY KEY', 'UNIQUE'), false) AS is_unique
        FROM raw_columns c LEFT JOIN keyed k ON c.table_name = k.table_name AND c.column_name = k.column_name""",
    "catalog_fks": _RAW_SQL + """
        SELECT 'fk_' || o_orderstatus AS constraint_name, table_name, column_name, o_orderkey AS column_pos, 't_0' AS ref_table,
               'r_' || column_name AS ref_column, CASE WHEN o_orderstatus <> 'P' THEN 'CASCADE' END AS on_delete,
               CASE WHEN o_orderstatus <> 'P' THEN 'NO ACTION' END AS on_update FROM keyed WHERE kind = 'FOREIGN KEY'""",
    "catalog_indexes": """
        SELECT 'ix_' || event_type AS index_name, 't_' || (user_id % 7) AS table_name,
               count(*) FILTER (WHERE event_type <> 'error') AS n_columns,
               coalesce(string_agg('c_' || event_id, ',' ORDER BY event_id) FILTER (WHERE event_type <> 'error'), '') AS column_names,
               bool_or(event_type = 'purchase') AS is_unique,
               CASE WHEN bool_or(event_type = 'purchase') THEN 'hash' ELSE 'btree' END AS method
        FROM events GROUP BY event_type, user_id % 7""",
    "index_members": """
        SELECT 'ix_' || event_type AS index_name, 't_' || (user_id % 7) AS table_name, 'c_' || event_id AS column_name,
               row_number() OVER (PARTITION BY event_type, user_id % 7 ORDER BY event_id) AS place
        FROM events WHERE event_type <> 'error'""",
    "primary_key_columns": _RAW_SQL + "SELECT table_name, column_name, o_orderkey AS ordinal_position FROM keyed WHERE kind = 'PRIMARY KEY'",
    "audit_catalog": _WANTED_SQL + _audit_sql(exact=False, online=True),
    "audit_catalog_offline": _WANTED_SQL + f"""
        SELECT type, severity, count(*) AS n_findings, CAST(sum(n_rows) AS BIGINT) AS n_rows
        FROM ({_audit_sql(exact=True, online=False)}) GROUP BY type, severity""",
    "diff_catalog": _operations_sql(False) + "SELECT * FROM ops",
    "diff_catalog_parity": _operations_sql(True) + "SELECT * FROM ops",
    "diff_summary": _operations_sql(False) + f"""
        SELECT table_name, CASE WHEN bool_or(kind = 'CREATE_TABLE') THEN 'CREATE' WHEN bool_or(kind = 'DROP_TABLE') THEN 'DROP'
               ELSE 'MODIFY' END AS change,
               {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k.lower()}" for k in _KINDS)} FROM ops GROUP BY table_name""",
    "diff_lines": _operations_sql(False) + _LINE_SQL,
    "operation_counts": _operations_sql(True) + "SELECT kind, count(*) AS n_operations FROM ops GROUP BY kind",
    "rename_suggestions": _operations_sql(False) + f"""
        SELECT o.table_name, o.column_name AS old_column, n.column_name AS new_column
        FROM ops o JOIN ops n ON o.table_name = n.table_name AND o.kind = 'DROP_COLUMN' AND n.kind = 'ADD_COLUMN'
        WHERE o.table_name IN (SELECT table_name FROM ops WHERE kind IN ('ADD_COLUMN', 'DROP_COLUMN') GROUP BY table_name
          HAVING count(*) FILTER (WHERE kind = 'ADD_COLUMN') = 1 AND count(*) FILTER (WHERE kind = 'DROP_COLUMN') = 1)
          AND {compatible_sql('o.old_type', 'n.new_type')}""",
}
