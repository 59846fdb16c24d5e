"""Profiles, search, paging, row diffs, changes and referential actions over the given tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from keelrow import Column, ForeignKey, TableContract
from keelrow.operators import actions, changes, profile, row_diff, search
from registry.star import ORDERS, ORDERS_V2_SQL, PART, STAR, STAR_KEYS, order_versions, star_tables, table

# ------------------------------------------------------------------ profile


def profile_columns(spark, sf_dir):
    return profile.profile_columns(table(spark, sf_dir, "orders"), exact=True)


def _profile_sql() -> str:
    parts = []
    shapes = {
        "o_orderkey": ("bigint", False), "o_custkey": ("bigint", False), "o_orderstatus": ("text", True),
        "o_totalprice": ("double precision", False), "o_orderdate": ("timestamp", False),
        "o_orderpriority": ("text", True),
    }
    for i, (c, (pg, is_text)) in enumerate(shapes.items()):
        longest = f"CAST(max(length({c})) AS BIGINT)" if is_text else "CAST(NULL AS BIGINT)"
        parts.append(f"""
SELECT '{c}' AS "column", {i} AS position, '{pg}' AS held_type, '{pg}' AS suggested_type, count(*) AS n_rows,
       count(*) - count({c}) AS n_nulls, count(DISTINCT {c}) AS n_distinct,
       CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value, {longest} AS max_length,
       count(*) > count({c}) AS nullable,
       count(DISTINCT {c}) = count({c}) AND count({c}) > 0 AS unique_candidate,
       count(DISTINCT {c}) = count({c}) AND count({c}) > 0 AND count(*) = count({c}) AS key_candidate
FROM orders""")
    return "\nUNION ALL\n".join(parts)


def profile_text(spark, sf_dir):
    """Text that holds numbers is told apart from other text."""
    texts = table(spark, sf_dir, "part").select(
        F.regexp_extract("p_brand", r"(\d+)", 1).alias("brand_number"), "p_name",
        F.col("p_retailprice").cast("string").alias("price"),
    )
    return profile.profile_columns(texts, exact=True).select(
        "column", "held_type", "suggested_type", "n_rows", "n_nulls", "n_distinct", "max_length"
    )


def key_candidates(spark, sf_dir):
    return profile.key_candidates(table(spark, sf_dir, "customer"))


def discover_fks(spark, sf_dir):
    found = profile.discover_references(star_tables(spark, sf_dir), STAR_KEYS, same_name=True)
    return found


def _discover_sql() -> str:
    columns = {c.name: c.names for c in STAR}
    parts = []
    for parent, key in STAR_KEYS.items():
        for child, names in columns.items():
            for c in names:
                if c != key and c.split("_", 1)[-1] == key.split("_", 1)[-1]:
                    parts.append(f"""
SELECT '{child}' AS child_table, '{c}' AS child_column, '{parent}' AS parent_table, '{key}' AS parent_column,
       count(*) AS n_values, count(*) FILTER (WHERE v NOT IN (SELECT {key} FROM {parent})) AS n_missing,
       count(*) > 0 AND count(*) FILTER (WHERE v NOT IN (SELECT {key} FROM {parent})) = 0 AS included
FROM (SELECT DISTINCT {c} AS v FROM {child} WHERE {c} IS NOT NULL)""")
    return "\nUNION ALL\n".join(parts)


# ------------------------------------------------------------------ search and pages

def scan_schema_order(spark, sf_dir):
    turned = table(spark, sf_dir, "orders")
    return search.scan(turned.select(*reversed(turned.columns)), ORDERS)


def search_any_text(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), "ThE oN")


def search_literal(spark, sf_dir):
    return search.search(table(spark, sf_dir, "pages"), "%%%", literal=True)


def search_count(spark, sf_dir):
    return search.search_count(table(spark, sf_dir, "part"), "red%G")


def row_counts(spark, sf_dir):
    parts = [
        search.row_count(df).withColumn("table", F.lit(name))
        for name, df in star_tables(spark, sf_dir).items()
    ]
    return changes.union_all(parts)


def key_lookup(spark, sf_dir):
    return search.key_lookup(table(spark, sf_dir, "lineitem"), "l_orderkey", "42")


def ids_in(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select("c_custkey")
    return search.ids_in(table(spark, sf_dir, "orders"), "o_custkey", rich)


def ids_in_long_list(spark, sf_dir):
    """A long list of ids against a table whose key is not its first column."""
    listed = [r[0] for r in table(spark, sf_dir, "supplier").select("s_suppkey").collect()] * 3
    return search.ids_in(table(spark, sf_dir, "lineitem"), "l_suppkey", sorted(listed)[: len(listed) // 2] * 2)


def not_in(spark, sf_dir):
    return search.ids_not_in(table(spark, sf_dir, "events"), "event_type", ["view", "error"])


def page_orders(spark, sf_dir):
    return search.page_rows(table(spark, sf_dir, "orders"), ["o_orderkey"], 3, 25)


def page_deep(spark, sf_dir):
    """A page far into the table, cut from numbered range partitions."""
    return search.page_rows(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey"], 150, 100)


def page_deep_by_key(spark, sf_dir):
    """A page far into the table, found through its unique key."""
    return search.page_rows(table(spark, sf_dir, "orders"), ["o_orderkey"], 140, 100, unique=True)


def next_page(spark, sf_dir):
    return search.next_page(table(spark, sf_dir, "orders"), "o_orderkey", 999, 50)


# ------------------------------------------------------------------ row diff

def diff_rows(spark, sf_dir):
    old, new = order_versions(spark, sf_dir)
    return row_diff.diff_rows(old, new, ["o_orderkey"])


_DIFF_SQL = f"""
WITH v2 AS ({ORDERS_V2_SQL}),
j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_orderkey AS ka, b.o_orderkey AS kb,
      list_filter([
        CASE WHEN a.o_custkey IS DISTINCT FROM b.o_custkey THEN 'o_custkey' END,
        CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'o_orderstatus' END,
        CASE WHEN a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'o_totalprice' END,
        CASE WHEN a.o_orderdate IS DISTINCT FROM b.o_orderdate THEN 'o_orderdate' END,
        CASE WHEN a.o_orderpriority IS DISTINCT FROM b.o_orderpriority THEN 'o_orderpriority' END],
        lambda x: x IS NOT NULL) AS diffs
      FROM orders a FULL OUTER JOIN v2 b ON a.o_orderkey = b.o_orderkey)
SELECT o_orderkey, CASE WHEN ka IS NULL THEN 'ADD' WHEN kb IS NULL THEN 'DROP' ELSE 'MODIFY' END AS change,
       CASE WHEN ka IS NULL OR kb IS NULL THEN CAST([] AS VARCHAR[]) ELSE diffs END AS changed,
       CAST(CASE WHEN ka IS NULL OR kb IS NULL THEN 1 ELSE 2 END AS BIGINT) AS n_rows
FROM j WHERE ka IS NULL OR kb IS NULL OR len(diffs) > 0
"""


def diff_row_counts(spark, sf_dir):
    return row_diff.diff_counts(diff_rows(spark, sf_dir))


def diff_lines_without_key(spark, sf_dir):
    """Lines share their key, so rows that cannot be paired are summed up."""
    old = table(spark, sf_dir, "lineitem")
    new = old.withColumn("l_tax", F.when(F.col("l_returnflag") == "R", F.lit(0.0)).otherwise(F.col("l_tax")))
    return row_diff.diff_counts(row_diff.diff_rows(old, new, ["l_orderkey", "l_linenumber"]))


# ------------------------------------------------------------------ changes

def update_rows(spark, sf_dir):
    """New status and price for urgent orders, given as text."""
    orders = table(spark, sf_dir, "orders")
    new = orders.filter("o_orderpriority = '1-URGENT'").select(
        "o_orderkey", F.lit("X").alias("o_orderstatus"),
        (F.col("o_totalprice") * 2).cast("string").alias("o_totalprice"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("o_orderstatus")))
        .otherwise(F.array(F.lit("o_orderstatus"), F.lit("o_totalprice"))).alias("fields"),
    )
    return changes.update(orders, new, ORDERS, set_columns="fields")


def update_strict_refusals(spark, sf_dir):
    """Why a strict update is refused: bad numbers, missing values, repeated and unknown keys."""
    orders = table(spark, sf_dir, "orders")
    new = orders.filter("o_orderpriority = '1-URGENT'").select(
        F.when(F.col("o_orderstatus") == "F", -F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey")).alias("o_orderkey"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"),
        F.col("o_orderpriority").alias("o_totalprice"))
    try:
        changes.update(orders, new.unionByName(new.filter("o_orderstatus = 'O'")), ORDERS)
    except changes.Refused as refused:
        return spark.createDataFrame(sorted(refused.details.items()), "rule string, n_rows long")
    raise AssertionError("the update was not refused")


def check_update(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    new = orders.select(
        F.when(F.col("o_orderpriority") == "5-LOW", -F.col("o_orderkey") - 1)
        .otherwise(F.col("o_orderkey")).alias("o_orderkey"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"),
        F.col("o_orderpriority").alias("o_totalprice"),
    )
    return changes.check_update(orders, new.unionByName(new.filter("o_orderstatus = 'F'")), ORDERS)


_CHECK_UPDATE_SQL = """
WITH one AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN -o_orderkey - 1 ELSE o_orderkey END AS k,
                    CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS s, o_orderpriority AS p FROM orders),
     c AS (SELECT * FROM one UNION ALL SELECT * FROM one WHERE s = 'F'),
     r AS (
  SELECT 'not_null' AS type, 'o_orderstatus' AS "column", 'o_orderstatus cannot be null' AS message,
         count(*) FILTER (WHERE s IS NULL) AS n_rows FROM c
  UNION ALL SELECT 'type', 'o_orderstatus', 'o_orderstatus must be varchar(1)', count(*) FILTER (WHERE length(s) > 1) FROM c
  UNION ALL SELECT 'not_null', 'o_totalprice', 'o_totalprice cannot be null', count(*) FILTER (WHERE p IS NULL) FROM c
  UNION ALL SELECT 'type', 'o_totalprice', 'o_totalprice must be double precision',
         count(*) FILTER (WHERE TRY_CAST(p AS DOUBLE) IS NULL) FROM c
  UNION ALL SELECT 'repeated_key', 'o_orderkey', 'o_orderkey must be unique', CAST(count(*) - count(DISTINCT k) AS BIGINT) FROM c
  UNION ALL SELECT 'not_found', 'o_orderkey', 'no row has this key',
         count(*) FILTER (WHERE k NOT IN (SELECT o_orderkey FROM orders)) FROM c)
SELECT type, 'orders' AS "table", "column", '' AS "index", message,
       CASE WHEN n_rows > 0 THEN 'error' ELSE 'info' END AS severity, n_rows FROM r
"""


def rows_affected(spark, sf_dir):
    low = table(spark, sf_dir, "orders").filter("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("l_orderkey"))
    return changes.rows_affected(
        table(spark, sf_dir, "lineitem"), low, next(c for c in STAR if c.name == "lineitem"), ["l_orderkey"]
    )


def delete_rows(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return changes.delete(table(spark, sf_dir, "lineitem"), gone)


ORDERS_IN = replace(ORDERS, columns=tuple(
    replace(c, foreign_key=ForeignKey("customer", "c_custkey")) if c.name == "o_custkey" else c
    for c in ORDERS.columns
))


def order_batch(spark, sf_dir):
    """New orders as text: some keys taken, some repeated, some customers unknown, some prices missing."""
    orders = table(spark, sf_dir, "orders")
    key = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.col("o_custkey") + 2_000_000_000_000)
        .otherwise(F.col("o_orderkey") + 1_000_000_000_000)
    )
    customer = F.when(F.col("o_orderpriority") == "3-MEDIUM", -F.col("o_custkey") - 1).otherwise(F.col("o_custkey"))
    price = F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    return orders.select(
        key.cast("string").alias("o_orderkey"), customer.cast("string").alias("o_custkey"),
        F.when(F.col("o_orderstatus") == "F", F.lit("FF")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        price.alias("o_totalprice"), F.col("o_orderdate").cast("string").alias("o_orderdate"), "o_orderpriority",
    )


def insert_validated(spark, sf_dir):
    done = changes.insert(
        table(spark, sf_dir, "orders"), order_batch(spark, sf_dir), ORDERS_IN,
        {"customer": table(spark, sf_dir, "customer")}, mode="quarantine",
    )
    return done.rows


def insert_rejects(spark, sf_dir):
    done = changes.insert(
        table(spark, sf_dir, "orders"), order_batch(spark, sf_dir), ORDERS_IN,
        {"customer": table(spark, sf_dir, "customer")}, mode="quarantine",
    )
    return changes.violation_counts(done.rejected)


_BATCH_SQL = """
WITH b AS (
  SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey WHEN o_orderpriority = '2-HIGH'
              THEN o_custkey + 2000000000000 ELSE o_orderkey + 1000000000000 END AS o_orderkey,
         CASE WHEN o_orderpriority = '3-MEDIUM' THEN -o_custkey - 1 ELSE o_custkey END AS o_custkey,
         CASE WHEN o_orderstatus = 'F' THEN 'FF' ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
  FROM orders),
t AS (SELECT b.*, count(*) OVER (PARTITION BY o_orderkey) > 1 AS repeated,
             o_orderkey IN (SELECT o_orderkey FROM orders) AS taken,
             o_custkey NOT IN (SELECT c_custkey FROM customer) AS orphan,
             length(o_orderstatus) > 1 AS long_status, o_totalprice IS NULL AS bad_price FROM b)
"""


def import_counts(spark, sf_dir):
    tagged = changes.tag_batch(
        order_batch(spark, sf_dir), ORDERS_IN, table(spark, sf_dir, "orders"),
        {"customer": table(spark, sf_dir, "customer")},
    )
    return changes.import_counts(tagged)


_TICKET = TableContract("ticket", (
    Column("id", "bigserial", primary=True),
    Column("customer", "text", not_null=True),
    Column("status", "text", default="'open'"),
    Column("priority", "integer", default="3"),
    Column("closed", "boolean", default="false"),
    Column("note", "text"),
))


def apply_defaults(spark, sf_dir):
    batch = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("customer"),
        F.when(F.col("c_acctbal") > 0, F.lit(7)).alias("priority"),
    )
    return changes.apply_defaults(batch, _TICKET, {"id": 1001}, order=["customer"])


# ------------------------------------------------------------------ referential actions

def _star_deletion(spark, sf_dir):
    tables = star_tables(spark, sf_dir)
    gone = tables["region"].filter("r_name = 'AMERICA'").select("r_regionkey")
    return actions.delete_with_actions(tables, STAR, "region", gone)


def cascade_delete(spark, sf_dir):
    """Lines left after one region is deleted."""
    return _star_deletion(spark, sf_dir).tables["lineitem"]


def cascade_counts(spark, sf_dir):
    left = _star_deletion(spark, sf_dir).tables
    return changes.union_all([
        search.row_count(df).withColumn("table", F.lit(name)) for name, df in left.items()
    ])


_CASCADE_SQL = """
WITH n AS (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AMERICA'),
     c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (FROM n)),
     s AS (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (FROM n)),
     o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM c)),
     l AS (SELECT * FROM lineitem WHERE l_orderkey NOT IN (FROM o) AND l_suppkey NOT IN (FROM s))
"""


def _with_action(action: str, default: str | None = None) -> TableContract:
    return replace(ORDERS, columns=tuple(
        replace(c, not_null=False, default=default, foreign_key=ForeignKey("customer", "c_custkey", action))
        if c.name == "o_custkey" else c for c in ORDERS.columns
    ))


def _debtor_deletion(spark, sf_dir, action, default=None):
    customer = next(c for c in STAR if c.name == "customer")
    tables = {n: table(spark, sf_dir, n) for n in ("customer", "orders")}
    gone = tables["customer"].filter("c_acctbal < 0").select("c_custkey")
    return actions.delete_with_actions(tables, [customer, _with_action(action, default)], "customer", gone)


def restrict_delete(spark, sf_dir):
    return _debtor_deletion(spark, sf_dir, "RESTRICT").blockers()


def no_action_delete(spark, sf_dir):
    return _debtor_deletion(spark, sf_dir, "NO ACTION").blockers()


def restricting_rows(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select("c_custkey")
    return actions.restricting_children(table(spark, sf_dir, "orders"), "o_custkey", gone, "c_custkey")


def set_null(spark, sf_dir):
    return _debtor_deletion(spark, sf_dir, "SET NULL").tables["orders"]


def set_default(spark, sf_dir):
    return _debtor_deletion(spark, sf_dir, "SET DEFAULT", "1").tables["orders"]


def _key_map(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1_000_000_000_000).alias("new")
    )


def on_update_cascade(spark, sf_dir):
    return actions.update_keys(table(spark, sf_dir, "orders"), ORDERS, "o_custkey", _key_map(spark, sf_dir))


def on_update_set_null(spark, sf_dir):
    optional = ORDERS.with_column(replace(ORDERS.column("o_custkey"), not_null=False))
    return actions.update_keys(
        table(spark, sf_dir, "orders"), optional, "o_custkey", _key_map(spark, sf_dir), "SET NULL"
    )


_PART_TREE = TableContract("part_tree", PART.columns + (
    Column("parent", "bigint", foreign_key=ForeignKey("part_tree", "p_partkey", "CASCADE")),
))


def self_ref_cascade(spark, sf_dir):
    """Parts form a tree (parent = half the key); small parts go, and everything below them."""
    parts = table(spark, sf_dir, "part")
    tree = parts.withColumn("parent", F.when(F.col("p_partkey") > 0, F.expr("p_partkey div 2")))
    gone = tree.filter("p_size = 1").select("p_partkey")
    return actions.delete_with_actions({"part_tree": tree}, [_PART_TREE], "part_tree", gone).tables["part_tree"]


QUERIES = {
    f.__name__: f for f in (
        profile_columns, profile_text, key_candidates, discover_fks, scan_schema_order, search_any_text,
        search_literal, search_count, row_counts, key_lookup, ids_in, not_in, page_orders, page_deep, page_deep_by_key, next_page,
        diff_rows, diff_row_counts, diff_lines_without_key, update_rows, update_strict_refusals, ids_in_long_list, check_update, rows_affected, delete_rows,
        insert_validated, insert_rejects, import_counts, apply_defaults, cascade_delete, cascade_counts,
        restrict_delete, no_action_delete, restricting_rows, set_null, set_default, on_update_cascade,
        on_update_set_null, self_ref_cascade,
    )
}

_BLOCKED_SQL = """
SELECT '{kind}' AS type, 'orders' AS "table", 'o_custkey' AS "column", '' AS "index",
       'rows still refer to customer.c_custkey' AS message,
       CASE WHEN count(*) > 0 THEN 'error' ELSE 'info' END AS severity, count(*) AS n_rows
FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"""

ORACLES = {
    "profile_columns": _profile_sql(),
    "profile_text": """
        SELECT 'brand_number' AS "column", 'text' AS held_type, 'bigint' AS suggested_type, count(*) AS n_rows,
               0::BIGINT AS n_nulls, count(DISTINCT p_brand) AS n_distinct, CAST(max(length(p_brand)) - 6 AS BIGINT) AS max_length FROM part
        UNION ALL SELECT 'p_name', 'text', 'text', count(*), 0, count(DISTINCT p_name), max(length(p_name)) FROM part
        UNION ALL SELECT 'price', 'text', 'double precision', count(*), 0, count(DISTINCT p_retailprice),
               max(length(CAST(p_retailprice AS VARCHAR))) FROM part""",
    "key_candidates": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS held_type, sum(n)::BIGINT AS n_rows, 0::BIGINT AS n_nulls,
               count(*) FILTER (n > 1) AS n_duplicate_values, max(n) = 1 AS unique_candidate, max(n) = 1 AS key_candidate
        FROM (SELECT count(*) AS n FROM customer GROUP BY {c})"""
        for c, t in (("c_custkey", "bigint"), ("c_name", "text"), ("c_nationkey", "integer"),
                     ("c_acctbal", "double precision"), ("c_mktsegment", "text"))),
    "discover_fks": _discover_sql(),
    "scan_schema_order": "SELECT * FROM orders",
    "search_any_text": "SELECT * FROM documents WHERE text ILIKE '%the on%' OR lang ILIKE '%the on%' OR source ILIKE '%the on%'",
    "search_literal": "SELECT * FROM pages WHERE contains(lower(url), '%%%') OR contains(lower(html), '%%%')",
    "search_count": "SELECT count(*) AS total FROM part WHERE p_name ILIKE '%red%g%' OR p_brand ILIKE '%red%g%' OR p_type ILIKE '%red%g%'",
    "row_counts": " UNION ALL ".join(f"SELECT count(*) AS total, '{c.name}' AS \"table\" FROM {c.name}" for c in STAR),
    "key_lookup": "SELECT * FROM lineitem WHERE l_orderkey = 42",
    "ids_in": "SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)",
    "ids_in_long_list": """
        SELECT * FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM (
            SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey, k) AS r FROM supplier, (SELECT unnest(range(3)) AS k))
            WHERE r <= (SELECT count(*) * 3 // 2 FROM supplier))""",
    "update_strict_refusals": """
        WITH n AS (SELECT CASE WHEN o_orderstatus = 'F' THEN -o_orderkey - 1 ELSE o_orderkey END AS k, o_orderstatus AS s
                   FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT * FROM n UNION ALL SELECT * FROM n WHERE s = 'O'),
        f AS (SELECT 'not_null:o_orderstatus' AS rule, count(*) FILTER (s = 'P') AS n_rows FROM b
              UNION ALL SELECT 'type:o_totalprice', count(*) FROM b
              UNION ALL SELECT 'repeated_key:o_orderkey', count(*) FILTER (s = 'O') // 2 FROM b
              UNION ALL SELECT 'not_found:o_orderkey', count(*) FILTER (s = 'F') FROM b)
        SELECT * FROM f WHERE n_rows > 0""",
    "not_in": "SELECT * FROM events WHERE event_type NOT IN ('view', 'error')",
    "page_orders": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 50",
    "page_deep": "SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_partkey LIMIT 100 OFFSET 14900",
    "page_deep_by_key": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 13900",
    "next_page": "SELECT * FROM orders WHERE o_orderkey > 999 ORDER BY o_orderkey LIMIT 50",
    "diff_rows": _DIFF_SQL,
    "diff_row_counts": f"SELECT change, count(*) AS n_keys, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM ({_DIFF_SQL}) GROUP BY change",
    "diff_lines_without_key": """
        WITH v2 AS (SELECT * REPLACE (CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_tax END AS l_tax) FROM lineitem),
        u AS (SELECT *, -1 AS n FROM lineitem UNION ALL SELECT *, 1 FROM v2),
        left_over AS (SELECT * EXCLUDE (n), sum(n) AS n FROM u GROUP BY ALL HAVING sum(n) <> 0),
        k AS (SELECT l_orderkey, l_linenumber, count(*) FILTER (WHERE n < 0) AS olds, count(*) FILTER (WHERE n > 0) AS news,
                     sum(abs(n)) AS n_rows FROM left_over GROUP BY 1, 2)
        SELECT CASE WHEN olds = 1 AND news = 1 AND n_rows = 2 THEN 'MODIFY' WHEN olds = 0 AND n_rows = 1 THEN 'ADD'
                    WHEN news = 0 AND n_rows = 1 THEN 'DROP' ELSE 'AMBIGUOUS' END AS change,
               count(*) AS n_keys, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM k GROUP BY 1""",
    "update_rows": """
        SELECT o_orderkey, o_custkey,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
               CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
               o_orderdate, o_orderpriority FROM orders""",
    "check_update": _CHECK_UPDATE_SQL,
    "rows_affected": """
        SELECT count(*) AS rows_affected FROM lineitem
        WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW')""",
    "delete_rows": "SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')",
    "insert_validated": _BATCH_SQL + """
        SELECT * FROM orders UNION ALL
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM t
        WHERE NOT repeated AND NOT taken AND NOT orphan AND NOT long_status AND NOT bad_price""",
    "insert_rejects": _BATCH_SQL + """
        SELECT * FROM (
        SELECT 'primary_key:o_orderkey' AS rule, count(*) AS n_rows FROM t WHERE repeated
        UNION ALL SELECT 'exists:o_orderkey', count(*) FROM t WHERE taken
        UNION ALL SELECT 'foreign_key:o_custkey', count(*) FROM t WHERE orphan
        UNION ALL SELECT 'type:o_orderstatus', count(*) FROM t WHERE long_status
        UNION ALL SELECT 'type:o_totalprice', count(*) FROM t WHERE bad_price) WHERE n_rows > 0""",
    "import_counts": _BATCH_SQL + """
        SELECT count(*) FILTER (WHERE NOT repeated AND NOT taken AND NOT orphan AND NOT long_status AND NOT bad_price) AS inserted_rows,
               count(*) AS total_rows FROM t""",
    "apply_defaults": """
        SELECT 1000 + row_number() OVER (ORDER BY c_name) AS id, c_name AS customer, 'open' AS status,
               CASE WHEN c_acctbal > 0 THEN 7 END AS priority, false AS closed, CAST(NULL AS VARCHAR) AS note FROM customer""",
    "cascade_delete": _CASCADE_SQL + "SELECT * FROM l",
    "cascade_counts": _CASCADE_SQL + """
        SELECT count(*) AS total, 'region' AS "table" FROM region WHERE r_name <> 'AMERICA'
        UNION ALL SELECT count(*), 'nation' FROM nation WHERE n_nationkey NOT IN (FROM n)
        UNION ALL SELECT count(*), 'customer' FROM customer WHERE c_custkey NOT IN (FROM c)
        UNION ALL SELECT count(*), 'supplier' FROM supplier WHERE s_suppkey NOT IN (FROM s)
        UNION ALL SELECT count(*), 'part' FROM part
        UNION ALL SELECT count(*), 'orders' FROM orders WHERE o_orderkey NOT IN (FROM o)
        UNION ALL SELECT count(*), 'lineitem' FROM l""",
    "restrict_delete": _BLOCKED_SQL.format(kind="restrict"),
    "no_action_delete": _BLOCKED_SQL.format(kind="no_action"),
    "restricting_rows": "SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "set_null": """SELECT * REPLACE (CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
                   THEN o_custkey END AS o_custkey) FROM orders""",
    "set_default": """SELECT * REPLACE (CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
                      THEN o_custkey ELSE 1 END AS o_custkey) FROM orders""",
    "on_update_cascade": """SELECT * REPLACE (CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
                            THEN o_custkey + 1000000000000 ELSE o_custkey END AS o_custkey) FROM orders""",
    "on_update_set_null": """SELECT * REPLACE (CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
                             THEN o_custkey END AS o_custkey) FROM orders""",
    "self_ref_cascade": """
        WITH RECURSIVE tree AS (SELECT *, CASE WHEN p_partkey > 0 THEN p_partkey // 2 END AS parent FROM part),
        gone AS (SELECT p_partkey FROM tree WHERE p_size = 1
                 UNION SELECT t.p_partkey FROM tree t JOIN gone g ON t.parent = g.p_partkey)
        SELECT * FROM tree WHERE p_partkey NOT IN (SELECT p_partkey FROM gone)""",
}
