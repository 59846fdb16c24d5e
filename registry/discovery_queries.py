"""References and keys read off the data, and deep hierarchies."""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import functions as F

from keelrow import Column, ForeignKey
from keelrow.operators import actions, inclusion, key_search, profile
from registry.star import EVENTS_COLUMNS, LINEITEM, ORDERS, STAR, STAR_KEYS, star_tables, table

# ------------------------------------------------------------------ single references


def discover_fks_all(spark, sf_dir):
    """Every comparable column against every key of the star."""
    return profile.discover_references(star_tables(spark, sf_dir), STAR_KEYS)


def discover_inclusions(spark, sf_dir):
    """Every column against every comparable one, texts, prices and dates too."""
    return inclusion.discover_inclusions(star_tables(spark, sf_dir))


_FAMILIES = {"integer": "integral", "bigint": "integral", "double precision": "double", "timestamp": "timestamp"}


def _inclusion_sql(parents: dict[str, str] | None) -> str:
    columns = [(t.name, c.name, _FAMILIES.get(c.type, "text")) for t in STAR for c in t.columns]
    values = "\nUNION ALL\n".join(
        f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, '{f}' AS f, CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL" for t, c, f in columns)
    listed = ", ".join(f"('{t}', '{c}', '{f}')" for t, c, f in columns)
    wanted = "" if parents is None else " AND (b.t, b.c) IN (" + ", ".join(f"('{t}', '{c}')" for t, c in parents.items()) + ")"
    return f"""
WITH vals AS ({values}), cols(t, c, f) AS (VALUES {listed}),
counts AS (SELECT t, c, count(*) AS n FROM vals GROUP BY ALL),
common AS (SELECT a.t, a.c, b.t AS pt, b.c AS pc, count(*) AS n FROM vals a JOIN vals b USING (f, v) GROUP BY ALL)
SELECT a.t AS child_table, a.c AS child_column, b.t AS parent_table, b.c AS parent_column, coalesce(n.n, 0) AS n_values,
       coalesce(n.n, 0) - coalesce(m.n, 0) AS n_missing, coalesce(n.n, 0) > 0 AND coalesce(n.n, 0) = coalesce(m.n, 0) AS included
FROM cols a JOIN cols b ON a.f = b.f AND (a.t, a.c) <> (b.t, b.c){wanted}
LEFT JOIN counts n ON n.t = a.t AND n.c = a.c
LEFT JOIN common m ON m.t = a.t AND m.c = a.c AND m.pt = b.t AND m.pc = b.c"""


# ------------------------------------------------------------------ composite references

_SUPPLY = ("s_line", "s_part", "s_supp")


def discover_fks_composite(spark, sf_dir):
    """lineitem, its returned lines and orders against the table of supplied parts."""
    lines = table(spark, sf_dir, "lineitem")
    tables = {
        "lineitem": lines, "returns": lines.filter("l_returnflag = 'R'"), "orders": table(spark, sf_dir, "orders"),
        "supply": lines.filter("l_returnflag <> 'A'").select(
            F.col("l_partkey").alias("s_part"), F.col("l_suppkey").alias("s_supp"), F.col("l_linenumber").alias("s_line")).distinct(),
    }
    return inclusion.discover_composite_inclusions(tables, {"supply": [("s_part", "s_supp", "s_line")]})


def _composite_sql() -> str:
    held = {
        "lineitem": ["l_linenumber", "l_orderkey", "l_partkey", "l_suppkey"], "orders": ["o_custkey", "o_orderkey"], "supply": list(_SUPPLY)}
    held["returns"] = held["lineitem"]
    parts = []
    for child, names in held.items():
        for width in (2, 3):
            for left in combinations(names, width):
                for right in permutations(_SUPPLY, width):
                    if child == "supply" and any(a == b for a, b in zip(left, right)):
                        continue
                    values = ", ".join(left)
                    single = " AND ".join(
                        f"NOT EXISTS (SELECT 1 FROM {child} WHERE {a} IS NOT NULL AND {a} NOT IN (SELECT {b} FROM supply))"
                        for a, b in zip(left, right))
                    parts.append(f"""
SELECT '{child}' AS child_table, '{",".join(left)}' AS child_columns, 'supply' AS parent_table,
       '{",".join(right)}' AS parent_columns, {width} AS width, count(*) AS n_values
FROM (SELECT DISTINCT {values} FROM {child}) c LEFT JOIN (SELECT DISTINCT {", ".join(right)}, TRUE AS known FROM supply) p
  ON {" AND ".join(f"c.{a} = p.{b}" for a, b in zip(left, right))}
WHERE {single}
HAVING count(*) > 0 AND count(*) = count(known)""")
    union = "\nUNION ALL\n".join(parts)
    return f"""
WITH returns AS (SELECT * FROM lineitem WHERE l_returnflag = 'R'),
supply AS (SELECT DISTINCT l_partkey AS s_part, l_suppkey AS s_supp, l_linenumber AS s_line FROM lineitem WHERE l_returnflag <> 'A')
{union}"""


# ------------------------------------------------------------------ composite keys

def composite_keys_lineitem(spark, sf_dir):
    return key_search.composite_key_candidates(table(spark, sf_dir, "lineitem"))


def composite_keys_events(spark, sf_dir):
    """events without their number, user ids missing in errors: no single column is left that is a key."""
    events = table(spark, sf_dir, "events").drop("event_id").withColumn(
        "user_id", F.when(F.col("event_type") != "error", F.col("user_id")))
    return key_search.composite_key_candidates(events)


def _keys_sql(source: str, names: list[str], width: int = 3) -> str:
    parts = []
    for k in range(1, width + 1):
        for group in combinations(names, k):
            whole = " AND ".join(f"{c} IS NOT NULL" for c in group)
            parts.append(f"""
SELECT '{",".join(group)}' AS columns, {k} AS width, count(*) FILTER ({whole}) AS n_rows, count(*) AS n,
       (SELECT count(*) FROM (SELECT DISTINCT {", ".join(group)} FROM source WHERE {whole})) AS n_values
FROM source""")
    union = "\nUNION ALL\n".join(parts)
    return f"""
WITH source AS ({source}), counted AS ({union}), keys AS (SELECT * FROM counted WHERE n_rows > 0 AND n_rows = n_values)
SELECT columns, width, n_rows, n - n_rows AS n_nulls, n = n_rows AS key_candidate FROM keys k
WHERE NOT EXISTS (SELECT 1 FROM keys o WHERE o.columns <> k.columns
                  AND list_has_all(string_split(k.columns, ','), string_split(o.columns, ',')))"""


# ------------------------------------------------------------------ deep hierarchies

_CHAIN = ORDERS.with_column(Column("previous", "bigint", foreign_key=ForeignKey("orders", "o_orderkey", "CASCADE")))


def self_ref_cascade_deep(spark, sf_dir):
    """Orders in chains of 300, each pointing to the one before; late returns take everything after them along."""
    orders = table(spark, sf_dir, "orders").withColumn(
        "previous", F.when(F.col("o_orderkey") % 300 != 0, F.col("o_orderkey") - 1))
    gone = orders.filter("o_orderkey % 41 = 0 AND o_orderpriority = '1-URGENT'").select("o_orderkey")
    return actions.delete_with_actions({"orders": orders}, [_CHAIN], "orders", gone).tables["orders"]


QUERIES = {
    f.__name__: f for f in (
        discover_fks_all, discover_inclusions, discover_fks_composite, composite_keys_lineitem, composite_keys_events,
        self_ref_cascade_deep,
    )
}

ORACLES = {
    "discover_fks_all": _inclusion_sql(STAR_KEYS),
    "discover_inclusions": _inclusion_sql(None),
    "discover_fks_composite": _composite_sql(),
    "composite_keys_lineitem": _keys_sql("SELECT * FROM lineitem", LINEITEM.names),
    "composite_keys_events": _keys_sql(
        "SELECT * EXCLUDE (event_id) REPLACE (CASE WHEN event_type <> 'error' THEN user_id END AS user_id) FROM events",
        [c for c in EVENTS_COLUMNS if c != "event_id"]),
    # within a chain without gaps everything after the first lost order goes
    "self_ref_cascade_deep": """
        WITH RECURSIVE chain AS (
            SELECT *, CASE WHEN o_orderkey % 300 <> 0 THEN o_orderkey - 1 END AS previous FROM orders
        ), gone AS (
            SELECT o_orderkey FROM chain WHERE o_orderkey % 41 = 0 AND o_orderpriority = '1-URGENT'
            UNION SELECT c.o_orderkey FROM chain c JOIN gone g ON c.previous = g.o_orderkey
        )
        SELECT * FROM chain WHERE o_orderkey NOT IN (SELECT o_orderkey FROM gone)""",
}
