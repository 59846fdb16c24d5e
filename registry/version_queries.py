"""Tables kept as lists of files: changes by file, inserts by filters, far pages, indexed search, layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelrow.operators import changes, file_changes, file_index
from keelrow.session import scratch_path
from keelrow.sources import layout, versions
from registry import data_queries as data
from registry.star import LINEITEM, ORDERS, STAR, star_tables, table

# files of a version here: enough that a change leaves some alone also where the tables are small
_FILES = 16


def _version(spark, df, order, bounds):
    return versions.create_version(df, scratch_path(spark, "table"), order, bounds, _FILES)


def orders_version(spark, sf_dir):
    return _version(spark, table(spark, sf_dir, "orders"), ["o_orderkey"], ["o_orderkey", "o_custkey"])


def _late_changes(spark, sf_dir):
    """New status and price for orders of the last tenth of the keys."""
    orders = table(spark, sf_dir, "orders")
    last = orders.agg((F.max("o_orderkey") * 0.9).cast("long")).first()[0]
    return orders.filter(F.col("o_orderkey") > last).select(
        "o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") * 2).cast("string").alias("o_totalprice"))


def update_files(spark, sf_dir):
    version = orders_version(spark, sf_dir)
    return file_changes.update_files(version, scratch_path(spark, "table"), _late_changes(spark, sf_dir), ORDERS).version.rows()


def delete_files(spark, sf_dir):
    """Lines of partly shipped orders of early customers, in files clustered by order."""
    lines = _version(spark, table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_orderkey"])
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P' AND o_custkey < 100").select(F.col("o_orderkey").alias("l_orderkey"))
    return file_changes.delete_files(lines, scratch_path(spark, "table"), gone).version.rows()


def cascade_files(spark, sf_dir):
    """Some early customers go; what is left of each table, and how many of its files were not rewritten."""
    bounds = {c.name: [c.names[0], *[column for column, _ in c.references() if column != c.names[0]]] for c in STAR}
    held = {name: _version(spark, df, [df.columns[0]], bounds[name]) for name, df in star_tables(spark, sf_dir).items()}
    bases = {name: scratch_path(spark, "table") for name in held}
    gone = table(spark, sf_dir, "customer").filter("c_custkey < 5").select("c_custkey")
    done = file_changes.delete_files_with_actions(held, bases, STAR, "customer", gone)
    return changes.union_all([
        d.version.files().agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total")).withColumn("table", F.lit(name)) for name, d in done.items()])


def _indexed_insert(spark, sf_dir):
    version = orders_version(spark, sf_dir)
    filters = file_index.build_filters(version, [("o_orderkey",)], f"{version.path}/filters")
    return file_index.insert_indexed(
        version, filters, scratch_path(spark, "table"), data.order_batch(spark, sf_dir), data.ORDERS_IN,
        {"customer": table(spark, sf_dir, "customer")}, mode="quarantine")


def insert_validated_indexed(spark, sf_dir):
    return _indexed_insert(spark, sf_dir).version.rows()


def insert_indexed_rejects(spark, sf_dir):
    return changes.violation_counts(_indexed_insert(spark, sf_dir).rejected)


def page_deep_indexed(spark, sf_dir):
    """A page far into lineitem: its files follow the key and then all other columns."""
    key = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey"]
    order = key + [c for c in LINEITEM.names if c not in key]
    return file_index.page_indexed(_version(spark, table(spark, sf_dir, "lineitem"), order, ["l_orderkey"]), 150, 100)


def search_indexed(spark, sf_dir):
    docs = _version(spark, table(spark, sf_dir, "documents"), ["doc_id"], ["doc_id"])
    return file_index.search_indexed(docs, file_index.build_trigrams(docs, f"{docs.path}/trigrams"), "ThE oN")


def search_indexed_rare(spark, sf_dir):
    """A word of few documents: most files are not read."""
    docs = _version(spark, table(spark, sf_dir, "documents"), ["doc_id"], ["doc_id"])
    trigrams = file_index.build_trigrams(docs, f"{docs.path}/trigrams")
    return file_index.search_indexed(docs, trigrams, "License", literal=True).select("doc_id")


def zorder_layout(spark, sf_dir):
    """Orders laid out by customer and date alike, read back by a range of either."""
    rows = layout.write_zordered(table(spark, sf_dir, "orders"), scratch_path(spark, "zorder"), ["o_custkey", "o_orderdate"], _FILES)
    return rows.filter("o_custkey BETWEEN 20 AND 60").unionByName(rows.filter("o_orderdate < timestamp_ntz'1993-01-01'"))


QUERIES = {
    f.__name__: f for f in (
        update_files, delete_files, cascade_files, insert_validated_indexed, insert_indexed_rejects, page_deep_indexed,
        search_indexed, search_indexed_rare, zorder_layout,
    )
}

ORACLES = {
    "update_files": """
        SELECT * EXCLUDE (late) REPLACE (CASE WHEN late THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
                                         CASE WHEN late THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice)
        FROM (SELECT *, o_orderkey > CAST(floor((SELECT max(o_orderkey) FROM orders) * 0.9) AS BIGINT) AS late FROM orders)""",
    "delete_files": """
        SELECT * FROM lineitem WHERE l_orderkey NOT IN (
            SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey < 100)""",
    "cascade_files": """
        WITH o AS (SELECT o_orderkey FROM orders WHERE o_custkey < 5)
        SELECT count(*) AS total, 'region' AS "table" FROM region
        UNION ALL SELECT count(*), 'nation' FROM nation
        UNION ALL SELECT count(*), 'customer' FROM customer WHERE c_custkey >= 5
        UNION ALL SELECT count(*), 'supplier' FROM supplier
        UNION ALL SELECT count(*), 'part' FROM part
        UNION ALL SELECT count(*), 'orders' FROM orders WHERE o_custkey >= 5
        UNION ALL SELECT count(*), 'lineitem' FROM lineitem WHERE l_orderkey NOT IN (FROM o)""",
    "insert_validated_indexed": data.ORACLES["insert_validated"],
    "insert_indexed_rejects": data.ORACLES["insert_rejects"],
    "page_deep_indexed": data.ORACLES["page_deep"],
    "search_indexed": data.ORACLES["search_any_text"],
    "search_indexed_rare": """
        SELECT doc_id FROM documents
        WHERE contains(lower(text), 'license') OR contains(lower(lang), 'license') OR contains(lower(source), 'license')""",
    "zorder_layout": """
        SELECT * FROM orders WHERE o_custkey BETWEEN 20 AND 60
        UNION ALL SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01'""",
}
