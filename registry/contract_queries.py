"""Contract checks over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelrow import Column, TableContract
from keelrow.operators import checks
from registry.star import (
    STAR, returned_lines_without_quantity, star_tables, table,
)


def contract_report(spark, sf_dir):
    return checks.contract_report(star_tables(spark, sf_dir), STAR)


def _rule_sql(kind, table_name, column, index, message, count_sql):
    return (
        f"SELECT '{kind}' AS type, '{table_name}' AS \"table\", '{column}' AS \"column\", '{index}' AS \"index\", "
        f"'{message}' AS message, CASE WHEN n > 0 THEN 'error' ELSE 'info' END AS severity, "
        f"CAST(n AS BIGINT) AS n_rows FROM ({count_sql})"
    )


def _unique_count_sql(source, columns):
    cols = ", ".join(columns)
    complete = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    return (
        f"SELECT coalesce(sum(k - 1), 0) AS n FROM (SELECT count(*) AS k FROM {source} "
        f"WHERE {complete} GROUP BY {cols} HAVING count(*) > 1)"
    )


def _orphan_count_sql(child, column, parent, parent_column):
    return (
        f"SELECT count(*) AS n FROM {child} c WHERE c.{column} IS NOT NULL AND NOT EXISTS "
        f"(SELECT 1 FROM {parent} p WHERE p.{parent_column} = c.{column})"
    )


def _contract_report_sql() -> str:
    parts = []
    for contract in STAR:
        for c in contract.columns:
            if c.required:
                parts.append(_rule_sql("not_null", contract.name, c.name, "", f"{c.name} must not be null",
                                       f"SELECT count(*) AS n FROM {contract.name} WHERE {c.name} IS NULL"))
            if c.type.startswith("varchar("):
                size = c.type[8:-1]
                parts.append(_rule_sql("type", contract.name, c.name, "", f"{c.name} must be {c.type}",
                                       f"SELECT count(*) AS n FROM {contract.name} WHERE length({c.name}) > {size}"))
        for key in contract.unique_keys():
            name = ",".join(key.columns)
            parts.append(_rule_sql(key.kind, contract.name, name, key.name, f"{name} must be unique",
                                   _unique_count_sql(contract.name, key.columns)))
        for column, fk in contract.references():
            parts.append(_rule_sql("foreign_key", contract.name, column, "",
                                   f"{column} must exist in {fk.table}.{fk.column}",
                                   _orphan_count_sql(contract.name, column, fk.table, fk.column)))
    return "\nUNION ALL\n".join(parts)


def findings_by_severity(spark, sf_dir):
    return checks.severity_counts(contract_report(spark, sf_dir))


def report_valid(spark, sf_dir):
    return checks.is_valid(contract_report(spark, sf_dir))


def check_not_null(spark, sf_dir):
    return checks.check_not_null(
        returned_lines_without_quantity(spark, sf_dir),
        ["l_orderkey", "l_quantity", "l_returnflag", "l_shipdate"], "lineitem",
    )


_NULLED_SQL = (
    "(SELECT * REPLACE (CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS l_quantity) FROM lineitem)"
)


def check_unique(spark, sf_dir):
    return checks.check_unique(table(spark, sf_dir, "documents"), ["text"], "documents")


def check_pk_lineitem(spark, sf_dir):
    return checks.check_primary_key(
        table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "lineitem"
    )


def duplicate_rows_lineitem(spark, sf_dir):
    return checks.duplicate_rows(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def check_fk_orders(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    open_orders = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'")
    return checks.check_foreign_key(
        table(spark, sf_dir, "orders"), ["o_custkey"], rich, ["c_custkey"], "orders", "customer"
    ).unionByName(checks.check_foreign_key(
        table(spark, sf_dir, "lineitem"), ["l_orderkey"], open_orders, ["o_orderkey"], "lineitem", "orders"
    ))


def orphan_rows_lineitem(spark, sf_dir):
    open_orders = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'")
    return checks.orphan_rows(table(spark, sf_dir, "lineitem"), ["l_orderkey"], open_orders, ["o_orderkey"])


_TYPE_CONTRACT = TableContract("mixed", (
    Column("priority_number", "integer"),
    Column("priority_name", "integer"),
    Column("priority_code", "varchar(6)"),
    Column("price", "numeric(8,2)"),
    Column("day", "date"),
    Column("flag", "boolean"),
    Column("number_of_key", "smallint"),
))


def check_type(spark, sf_dir):
    """orders read as text and checked against narrower types."""
    texts = table(spark, sf_dir, "orders").select(
        F.substring("o_orderpriority", 1, 1).alias("priority_number"),
        F.col("o_orderpriority").alias("priority_name"),
        F.col("o_orderpriority").alias("priority_code"),
        F.regexp_replace(F.format_number(F.col("o_totalprice") * 10, 2), ",", "").alias("price"),
        F.col("o_orderdate").cast("date").cast("string").alias("day"),
        F.when(F.col("o_orderstatus") == "P", F.lit("true")).otherwise(F.col("o_orderstatus")).alias("flag"),
        F.col("o_orderkey").cast("string").alias("number_of_key"),
    )
    return checks.check_rows(texts, _TYPE_CONTRACT)


_CHECK_TYPE_SQL = "\nUNION ALL\n".join(
    _rule_sql("type", "mixed", column, "", f"{column} must be {pg}", f"SELECT count(*) AS n FROM orders WHERE {cond}")
    for column, pg, cond in (
        ("priority_number", "integer", "TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) IS NULL"),
        ("priority_name", "integer", "TRY_CAST(o_orderpriority AS INTEGER) IS NULL"),
        ("priority_code", "varchar(6)", "length(o_orderpriority) > 6"),
        ("price", "numeric(8,2)", "TRY_CAST(round(o_totalprice * 10, 2) AS DECIMAL(8,2)) IS NULL"),
        ("day", "date", "TRY_CAST(strftime(o_orderdate, '%Y-%m-%d') AS DATE) IS NULL"),
        ("flag", "boolean", "o_orderstatus NOT IN ('P', 'F')"),
        ("number_of_key", "smallint", "TRY_CAST(CAST(o_orderkey AS VARCHAR) AS SMALLINT) IS NULL"),
    )
)


def relationship_profile(spark, sf_dir):
    parts = []
    for child, column, parent, key in (
        ("events", "user_id", "customer", "c_custkey"),
        ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("labels", "doc_id", "documents", "doc_id"),
        ("nation", "n_regionkey", "region", "r_regionkey"),
    ):
        parts.append(checks.relationship_profile(
            table(spark, sf_dir, child), column, table(spark, sf_dir, parent), key
        ).withColumn("reference", F.lit(f"{child}.{column}")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _relationship_sql(child, column, parent, key):
    return f"""
SELECT *, CASE WHEN max_children <= 1 THEN 'one_to_one' ELSE 'one_to_many' END AS kind,
       '{child}.{column}' AS reference
FROM (SELECT count(*) AS n_parents, count(n) AS n_linked_parents,
             count(*) - count(n) AS n_childless, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_children,
             coalesce(max(n), 0) AS max_children
      FROM {parent} p LEFT JOIN (SELECT {column} AS k, count(*) AS n FROM {child} GROUP BY 1) c ON p.{key} = c.k)
"""


def junction_profile(spark, sf_dir):
    return checks.junction_profile(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


QUERIES = {
    "contract_report": contract_report,
    "findings_by_severity": findings_by_severity,
    "report_valid": report_valid,
    "check_not_null": check_not_null,
    "check_unique": check_unique,
    "check_pk_lineitem": check_pk_lineitem,
    "duplicate_rows_lineitem": duplicate_rows_lineitem,
    "check_fk_orders": check_fk_orders,
    "orphan_rows_lineitem": orphan_rows_lineitem,
    "check_type": check_type,
    "relationship_profile": relationship_profile,
    "junction_profile": junction_profile,
}

ORACLES = {
    "contract_report": _contract_report_sql(),
    "findings_by_severity":
        f"SELECT severity, count(*) AS n_findings FROM ({_contract_report_sql()}) GROUP BY severity",
    "report_valid":
        f"SELECT count(*) FILTER (WHERE severity = 'error') = 0 AS valid FROM ({_contract_report_sql()})",
    "check_not_null": "\nUNION ALL\n".join(
        _rule_sql("not_null", "lineitem", c, "", f"{c} must not be null",
                  f"SELECT count(*) AS n FROM {_NULLED_SQL} WHERE {c} IS NULL")
        for c in ("l_orderkey", "l_quantity", "l_returnflag", "l_shipdate")
    ),
    "check_unique": _rule_sql("unique", "documents", "text", "", "text must be unique",
                              _unique_count_sql("documents", ["text"])),
    "check_pk_lineitem": "\nUNION ALL\n".join(
        [_rule_sql("not_null", "lineitem", c, "", f"{c} must not be null",
                   f"SELECT count(*) AS n FROM lineitem WHERE {c} IS NULL")
         for c in ("l_orderkey", "l_linenumber")]
        + [_rule_sql("primary_key", "lineitem", "l_orderkey,l_linenumber", "",
                     "l_orderkey,l_linenumber must be unique",
                     _unique_count_sql("lineitem", ["l_orderkey", "l_linenumber"]))]
    ),
    "duplicate_rows_lineitem": """
        SELECT * FROM lineitem WHERE (l_orderkey, l_linenumber) IN (
            SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""",
    "check_fk_orders": "\nUNION ALL\n".join((
        _rule_sql("foreign_key", "orders", "o_custkey", "", "o_custkey must exist in customer.c_custkey",
                  _orphan_count_sql("orders", "o_custkey", "(SELECT * FROM customer WHERE c_acctbal > 0)", "c_custkey")),
        _rule_sql("foreign_key", "lineitem", "l_orderkey", "", "l_orderkey must exist in orders.o_orderkey",
                  _orphan_count_sql("lineitem", "l_orderkey",
                                    "(SELECT * FROM orders WHERE o_orderstatus <> 'F')", "o_orderkey")),
    )),
    "orphan_rows_lineitem": """
        SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')""",
    "check_type": _CHECK_TYPE_SQL,
    "relationship_profile": "\nUNION ALL\n".join((
        _relationship_sql("events", "user_id", "customer", "c_custkey"),
        _relationship_sql("lineitem", "l_orderkey", "orders", "o_orderkey"),
        _relationship_sql("labels", "doc_id", "documents", "doc_id"),
        _relationship_sql("nation", "n_regionkey", "region", "r_regionkey"),
    )),
    "junction_profile": """
        WITH pairs AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2)
        SELECT n_pairs, n_repeated_pairs, max_per_left, max_per_right,
               CASE WHEN max_per_left > 1 AND max_per_right > 1 THEN 'many_to_many'
                    WHEN max_per_left > 1 THEN 'one_to_many' WHEN max_per_right > 1 THEN 'many_to_one'
                    ELSE 'one_to_one' END AS kind
        FROM (SELECT count(*) AS n_pairs, count(*) FILTER (WHERE n > 1) AS n_repeated_pairs FROM pairs),
             (SELECT max(k) AS max_per_left FROM (SELECT count(*) AS k FROM pairs GROUP BY l_partkey)),
             (SELECT max(k) AS max_per_right FROM (SELECT count(*) AS k FROM pairs GROUP BY l_suppkey))""",
}
