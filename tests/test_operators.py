"""Checks, profiles, numbering, pages, diffs, changes and referential actions."""

import random

import pytest
from pyspark.sql import functions as F

from keelrow import Column, ForeignKey, Index, TableContract
from keelrow.operators import actions, audit, catalog, catalog_diff, changes, checks, profile, row_diff, search
from keelrow.operators.numbering import dense_numbers, range_sorted


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=nulls_last)


def nulls_last(row):
    return [(v is None, v) for v in row]


# ------------------------------------------------------------------ checks

def test_unique_ignores_null_keys(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, None), (1, None), (None, 1), (2, 2)], "a int, b int")
    assert checks.check_unique(df, ["a", "b"]).first()["n_rows"] == 1
    assert rows(checks.duplicate_rows(df, ["a", "b"])) == [(1, 1), (1, 1)]


def test_primary_key_is_unique_and_complete(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (2,)], "a int")
    found = {(r["type"], r["n_rows"]) for r in checks.check_primary_key(df, ["a"], "t").collect()}
    assert found == {("not_null", 1), ("primary_key", 1)}


def test_foreign_key_ignores_null(spark):
    child = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (3,)], "id int")
    assert checks.check_foreign_key(child, ["k"], parent, ["id"]).first()["n_rows"] == 2
    assert rows(checks.orphan_rows(child, ["k"], parent, ["id"])) == [(2,), (2,)]


def test_row_rules_share_one_scan(spark, sf_dir):
    from registry.star import LINEITEM
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = checks.check_rows(df, LINEITEM)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_type_rules_follow_the_held_type(spark):
    contract = TableContract("t", (Column("a", "integer"), Column("b", "varchar(2)"), Column("c", "smallint")))
    df = spark.createDataFrame([(1.0, "ab", 1), (1.5, "abc", 40000), (None, None, None)], "a double, b string, c int")
    got = {(r["column"], r["n_rows"]) for r in checks.check_rows(df, contract).collect()}
    assert got == {("a", 1), ("b", 1), ("c", 1)}


def test_report_severities(spark):
    contract = TableContract("t", (Column("id", "integer", primary=True), Column("n", "text", not_null=True)))
    good = spark.createDataFrame([(1, "a")], "id int, n string")
    bad = spark.createDataFrame([(1, "a"), (1, None)], "id int, n string")
    assert checks.is_valid(checks.contract_report({"t": good}, [contract])).first()[0]
    report = checks.contract_report({"t": bad}, [contract])
    assert not checks.is_valid(report).first()[0]
    assert {(r["type"], r["column"]) for r in checks.findings(report).collect()} == {("primary_key", "id"), ("not_null", "n")}


def test_relationship_kinds(spark):
    parent = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    one = spark.createDataFrame([(1,), (2,)], "p int")
    many = spark.createDataFrame([(1,), (1,), (None,)], "p int")
    a = checks.relationship_profile(one, "p", parent, "id").first()
    b = checks.relationship_profile(many, "p", parent, "id").first()
    assert (a["kind"], a["n_childless"]) == ("one_to_one", 1)
    assert (b["kind"], b["n_childless"], b["max_children"]) == ("one_to_many", 2, 2)


# ------------------------------------------------------------------ profiles

def test_profile_suggests_types(spark):
    df = spark.createDataFrame([("1", "1.5", "true", "2024-01-01", "x"), ("2", "2", "false", "2024-02-01", None)],
                               "a string, b string, c string, d string, e string")
    got = {r["column"]: r["suggested_type"] for r in profile.profile_columns(df).collect()}
    assert got == {"a": "bigint", "b": "double precision", "c": "boolean", "d": "date", "e": "text"}


def test_empty_table_profile(spark):
    df = spark.createDataFrame([], "a int, b string")
    got = rows(profile.profile_columns(df, exact=True), "column", "n_rows", "unique_candidate")
    assert got == [("a", 0, False), ("b", 0, False)]


# ------------------------------------------------------------------ numbering and pages

def test_dense_numbers_follow_the_order(spark):
    values = list(range(1000))
    random.Random(3).shuffle(values)
    df = spark.createDataFrame([(v // 3, v) for v in values], "a int, b int").repartition(7)
    got = dense_numbers(df, "n", ["a", "b"], start=10).orderBy("n").collect()
    assert [(r["a"], r["b"], r["n"]) for r in got] == [(v // 3, v, v + 10) for v in range(1000)]


def test_hot_order_key_is_spread(spark):
    df = spark.range(20000).select(F.lit(1).alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r["count"] for r in range_sorted(df.repartition(5), ["k"]).groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 20000 and max(sizes) < 20000 / 3


def test_pages_cover_the_table(spark, monkeypatch):
    df = spark.createDataFrame([(i % 10, i) for i in range(95)], "g int, id int")
    near = [tuple(r) for p in range(1, 11) for r in search.page_rows(df, ["g", "id"], p, 10).collect()]
    monkeypatch.setattr(search, "TOP_K_ROWS", 0)
    far, by_key = ([tuple(r) for p in range(1, 11) for r in search.page_rows(df, ["g", "id"], p, 10, unique=u).collect()]
                   for u in (False, True))
    tied = [r["id"] for p in range(1, 11) for r in search.page_rows(df, ["g"], p, 10).collect()]
    assert sorted(tied) == list(range(95))
    assert near == far == by_key == sorted((i % 10, i) for i in range(95))


def test_page_bounds_and_label(spark):
    df = spark.createDataFrame([(i, f"name {i}") for i in range(25)], "id int, name string")
    page = search.page(df, ["id"], 3, 10)
    assert (page.total, page.total_pages, page.label) == (25, 3, "Showing 21 to 25 of 25 rows (Page 3 of 3)")
    assert search.page(df, ["id"], 0, 10).number == 1
    for limit in (0, 101):
        with pytest.raises(ValueError):
            search.page(df, ["id"], 1, limit)
    assert search.page(df, ["id"], term="zzz").label == "No data found"
    assert search.page(df, ["id"], 2, 5, term="NAME 1").total == 11


def test_keyset_pages(spark):
    df = spark.createDataFrame([(i,) for i in range(30)], "id int")
    seen, after = [], None
    while True:
        got = [r["id"] for r in search.next_page(df, "id", after, 7).collect()]
        if not got:
            break
        seen += got
        after = got[-1]
    assert seen == list(range(30))


def test_search_wildcards(spark):
    df = spark.createDataFrame([("100%", 1), ("100 x", 2), (None, 3)], "s string, n int")
    assert rows(search.search(df, "0%"), "n") == [(1,), (2,)]
    assert rows(search.search(df, "0%", literal=True), "n") == [(1,)]
    assert search.search(df.select("n"), "x").count() == 3
    assert search.search(df, "").count() == 3


def test_ids_in_long_and_short_lists_agree(spark, monkeypatch):
    df = spark.range(100).select(F.col("id").cast("int"))
    short = rows(search.ids_in(df, "id", [3, 5, 500]))
    monkeypatch.setattr(search, "INLINE_IDS", 0)
    assert rows(search.ids_in(df, "id", [3, 5, 500])) == short == [(3,), (5,)]


def test_key_filter_reaches_the_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    for q in (search.key_lookup(df, "l_orderkey", "42"), search.next_page(df, "l_orderkey", 10, 5),
              search.ids_in(df, "l_orderkey", [1, 2])):
        assert "PushedFilters: [IsNotNull(l_orderkey)" in q._jdf.queryExecution().executedPlan().toString() or \
            "In(l_orderkey" in q._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------ row diff

def random_rows(seed, n, keys):
    r = random.Random(seed)
    return [(r.choice([None, *range(keys)]), r.choice(["a", "b", None]), r.choice([1.0, 2.0, None])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_diff_properties(spark, seed):
    schema = "k int, s string, v double"
    a = spark.createDataFrame(random_rows(seed, 60, 40), schema)
    b = spark.createDataFrame(random_rows(seed + 100, 60, 40), schema)
    assert row_diff.diff_rows(a, a.orderBy("v"), ["k"]).count() == 0
    assert rows(row_diff.diff_rows(a, b, ["k"])) == rows(row_diff.diff_rows(a, b, ["k"], prefilter=False))
    forth = {r["k"]: (r["change"], tuple(r["changed"]), r["n_rows"]) for r in row_diff.diff_rows(a, b, ["k"]).collect()}
    back = {r["k"]: (r["change"], tuple(r["changed"]), r["n_rows"]) for r in row_diff.diff_rows(b, a, ["k"]).collect()}
    mirror = {"ADD": "DROP", "DROP": "ADD", "MODIFY": "MODIFY", "AMBIGUOUS": "AMBIGUOUS"}
    assert back == {k: (mirror[c], ch, n) for k, (c, ch, n) in forth.items()}


def test_diff_is_null_safe(spark):
    a = spark.createDataFrame([(1, None, 1.0), (2, "x", None), (3, None, None)], "k int, s string, v double")
    b = spark.createDataFrame([(1, "y", 1.0), (2, None, 2.0), (3, None, None)], "k int, s string, v double")
    got = {r["k"]: (r["change"], r["changed"]) for r in row_diff.diff_rows(a, b, ["k"]).collect()}
    assert got == {1: ("MODIFY", ["s"]), 2: ("MODIFY", ["s", "v"])}


def test_digests_tell_shapes_apart(spark):
    df = spark.createDataFrame([
        ("a", None, [1], [2]), (None, "a", [1], [2]), ("a", "", [1], [2]), ("", "a", [1, 2], []), ("", "a", [1], [2]),
        ("", "a", None, [2]), ("", "a", [None, 1], [2]), ("", "a", [1, None], [2]),
    ], "a string, b string, c array<int>, d array<int>")
    for digest in row_diff.row_digest(df, df.columns):
        assert df.select(digest).distinct().count() == df.count()


# ------------------------------------------------------------------ changes

PEOPLE = TableContract("people", (
    Column("id", "integer", primary=True), Column("name", "varchar(5)", not_null=True),
    Column("boss", "integer", foreign_key=ForeignKey("people", "id")), Column("mail", "text", unique=True),
    Column("level", "integer", default="1"),
))
PEOPLE_ROWS = [(1, "ann", None, "a@x", 1), (2, "bob", 1, None, 2)]


@pytest.fixture
def people(spark):
    return spark.createDataFrame(PEOPLE_ROWS, PEOPLE.struct())


def test_strict_insert_refuses_everything(spark, people):
    batch = spark.createDataFrame([("3", "cy", "1", "c@x"), ("x", "dan", "1", "d@x")], "id string, name string, boss string, mail string")
    with pytest.raises(changes.Refused) as refused:
        changes.insert(people, batch, PEOPLE)
    assert refused.value.details == {"type:id": 1}
    assert people.count() == 2


def test_quarantine_insert(spark, people):
    batch = spark.createDataFrame([
        ("3", "cy", "1", "c@x"), ("4", "toolong", "1", None), ("5", "eve", "99", None), ("2", "bob", None, None),
        ("6", "fay", "3", "a@x"), ("7", "gus", None, "g@x"), ("8", "hal", None, "g@x"), ("9", None, None, None),
        ("10", "ida", "3", None), ("11.0", "jon", None, None),
    ], "id string, name string, boss string, mail string")
    done = changes.insert(people, batch, PEOPLE, mode="quarantine")
    assert rows(done.accepted, "id", "level") == [(3, 1), (10, 1), (11, 1)]
    assert done.rows.count() == 5
    assert {r["id"]: sorted(r["violations"]) for r in done.rejected.collect()} == {
        "4": ["type:name"], "5": ["foreign_key:boss"], "2": ["exists:id"], "6": ["exists:mail"],
        "7": ["unique:mail"], "8": ["unique:mail"], "9": ["not_null:name"]}


def test_rejected_rows_take_their_followers_along(spark, people):
    batch = spark.createDataFrame([
        ("20", "toolong", "1"), ("21", "a", "20"), ("22", "b", "21"), ("23", "c", "24"), ("24", "d", "23"), ("25", "e", "25"),
    ], "id string, name string, boss string")
    done = changes.insert(people, batch, PEOPLE, mode="quarantine")
    assert rows(done.accepted, "id") == [(23,), (24,), (25,)]
    assert checks.check_foreign_key(done.rows, ["boss"], done.rows, ["id"]).first()["n_rows"] == 0


def test_explicit_null_stays_null(spark):
    batch = spark.createDataFrame([("cy", None)], "name string, level int")
    out = changes.apply_defaults(batch.withColumn("id", F.lit(3)), PEOPLE).first()
    assert out["level"] is None and out["boss"] is None
    with pytest.raises(ValueError, match="columns not found in table people: nope"):
        changes.apply_defaults(batch.withColumn("nope", F.lit(1)), PEOPLE)


def test_update_sets_only_named_columns(spark, people):
    new = spark.createDataFrame([(1, "zoe", "7", ["name"]), (2, None, "9", ["level"])], "id int, name string, level string, f array<string>")
    out = changes.update(people, new, PEOPLE, set_columns="f")
    assert rows(out, "id", "name", "level") == [(1, "zoe", 1), (2, "bob", 9)]
    report = {r["type"]: r["n_rows"] for r in checks.findings(changes.check_update(people, new, PEOPLE, set_columns="f")).collect()}
    assert report == {}
    with pytest.raises(ValueError, match="column 'nope' does not exist"):
        changes.update(people, spark.createDataFrame([(1, 2)], "id int, nope int"), PEOPLE)


def test_update_can_set_null(spark, people):
    out = changes.update(people, spark.createDataFrame([(1, None)], "id int, mail string"), PEOPLE)
    assert rows(out.filter("mail IS NULL"), "id") == [(1,), (2,)]


def test_update_problems_are_reported(spark, people):
    new = spark.createDataFrame([(1, None), (1, "x"), (9, "toolong")], "id int, name string")
    found = {(r["type"], r["column"]): r["n_rows"] for r in checks.findings(changes.check_update(people, new, PEOPLE)).collect()}
    assert found == {("not_null", "name"): 1, ("type", "name"): 1, ("repeated_key", "id"): 1, ("not_found", "id"): 1}


def test_composite_delete(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "a int, b int")
    keys = spark.createDataFrame([(1, 2)], "a int, b int")
    assert rows(changes.delete(df, keys)) == [(1, 1), (2, 1)]
    assert rows(changes.deleted_rows(df, keys)) == [(1, 2)]


# ------------------------------------------------------------------ referential actions

def brute_cascade(tables, edges, start, keys):
    gone = {start: set(keys)}
    moved = True
    while moved:
        moved = False
        for child, column, parent in edges:
            for row in tables[child]:
                if row[column] in gone.get(parent, set()) and row["id"] not in gone.setdefault(child, set()):
                    gone[child].add(row["id"])
                    moved = True
    return {t: sorted(r["id"] for r in data if r["id"] not in gone.get(t, set())) for t, data in tables.items()}


@pytest.mark.parametrize("seed", range(3))
def test_cyclic_cascade_matches_brute_force(spark, seed):
    r = random.Random(seed)
    ids = range(40)
    data = {
        "a": [{"id": i, "up": r.choice([None, *ids]), "b_ref": r.choice([None, None, *ids])} for i in ids],
        "b": [{"id": i, "a_ref": r.choice([None, None, None, *ids])} for i in ids],
        "c": [{"id": i, "b_ref": r.choice([None, *ids])} for i in ids],
    }
    key = Column("id", "integer", primary=True)
    contracts = [
        TableContract("a", (key, Column("up", "integer", foreign_key=ForeignKey("a", "id", "CASCADE")),
                            Column("b_ref", "integer", foreign_key=ForeignKey("b", "id", "cascade")))),
        TableContract("b", (key, Column("a_ref", "integer", foreign_key=ForeignKey("a", "id", "CASCADE")))),
        TableContract("c", (key, Column("b_ref", "integer", foreign_key=ForeignKey("b", "id", "CASCADE")))),
    ]
    tables = {c.name: spark.createDataFrame([tuple(x[n] for n in c.names) for x in data[c.name]], c.struct()) for c in contracts}
    keys = spark.createDataFrame([(0,), (1,)], "id int")
    done = actions.delete_with_actions(tables, contracts, "a", keys)
    expected = brute_cascade(data, [("a", "up", "a"), ("a", "b_ref", "b"), ("b", "a_ref", "a"), ("c", "b_ref", "b")], "a", [0, 1])
    assert {t: [x[0] for x in rows(df, "id")] for t, df in done.tables.items()} == expected


def test_restrict_and_no_action(spark):
    parent = TableContract("p", (Column("id", "integer", primary=True),))

    def child(action):
        return TableContract("c", (Column("id", "integer", primary=True),
                                   Column("p", "integer", foreign_key=ForeignKey("p", "id", action))))
    tables = {"p": spark.createDataFrame([(1,), (2,)], parent.struct()),
              "c": spark.createDataFrame([(1, 1), (2, None)], child("").struct())}
    one, two = (spark.createDataFrame([(k,)], "id int") for k in (1, 2))
    for action in ("", "NO ACTION", "restrict"):
        with pytest.raises(changes.Refused):
            actions.delete_with_actions(tables, [parent, child(action)], "p", one).require_allowed()
        assert actions.delete_with_actions(tables, [parent, child(action)], "p", two).require_allowed().tables["p"].count() == 1


def test_set_default_must_exist(spark):
    parent = TableContract("p", (Column("id", "integer", primary=True),))

    def child(default):
        return TableContract("c", (Column("p", "integer", default=default, foreign_key=ForeignKey("p", "id", "SET DEFAULT")),))
    tables = {"p": spark.createDataFrame([(1,), (2,)], parent.struct()), "c": spark.createDataFrame([(1,), (2,)], child("2").struct())}
    one = spark.createDataFrame([(1,)], "id int")
    done = actions.delete_with_actions(tables, [parent, child("2")], "p", one).require_allowed()
    assert rows(done.tables["c"]) == [(2,), (2,)]
    with pytest.raises(changes.Refused):
        actions.delete_with_actions(tables, [parent, child("7")], "p", one).require_allowed()


def test_no_orphans_after_cascade(spark, sf_dir):
    from registry.star import STAR, star_tables
    tables = star_tables(spark, sf_dir)
    gone = tables["customer"].filter("c_acctbal < 0").select("c_custkey")
    done = actions.delete_with_actions(tables, STAR, "customer", gone)
    report = checks.contract_report(done.tables, STAR)
    assert report.filter("type = 'foreign_key' AND n_rows > 0").count() == 0


# ------------------------------------------------------------------ catalogs

BLOG = [
    TableContract("users", (
        Column("id", "serial", primary=True), Column("email", "text", unique=True, not_null=True),
        Column("status", "text", default="'active'"), Column("created_at", "timestamp", default="now()",
                                                             index=Index("idx_users_created_at", ())))),
    TableContract("posts", (
        Column("id", "serial", primary=True), Column("title", "text", not_null=True),
        Column("user_id", "integer", foreign_key=ForeignKey("users", "id", "CASCADE")))),
    TableContract("post_tags", (
        Column("id", "serial", primary=True), Column("post_id", "integer", foreign_key=ForeignKey("posts", "id", "CASCADE")),
        Column("tag_id", "integer")), (Index("idx_post_tags_unique", ("post_id", "tag_id"), unique=True),)),
]


def test_clean_catalog_has_no_findings(spark):
    assert audit.audit(catalog.from_contracts(spark, BLOG)).count() == 0


def test_audit_findings(spark):
    bad = [
        TableContract("order", (Column("a b", "money"), Column("x", "integer", default="1.5"),
                                Column("x", "text"), Column("r", "integer", foreign_key=ForeignKey("gone", "id")),
                                Column("q", "integer", foreign_key=ForeignKey("users", "nope", "DESTROY"))),
                      (Index("ix", ("x", "zz")), Index("ix", ("x",)), Index("", ("x",)))),
        TableContract("empty", ()), BLOG[0],
    ]
    wanted = catalog.from_contracts(spark, bad)
    existing = spark.createDataFrame([("users",)], "table_name string")
    got = {(r["type"], r["table"], r["column"], r["index"]) for r in audit.audit(wanted, existing).collect()}
    assert got == {
        ("table_name", "order", None, None), ("column_name", "order", "a b", None), ("data_type", "order", "a b", None),
        ("default_value", "order", "x", None), ("duplicate_column", "order", "x", None),
        ("no_primary_key", "order", None, None), ("foreign_key_table_not_found", "order", "r", None),
        ("foreign_key_column_not_found", "order", "q", None), ("foreign_key", "order", "q", None),
        ("duplicate_index", "order", None, "ix"), ("index_name", "order", None, ""),
        ("index_column_not_found", "order", "zz", "ix"), ("no_columns", "empty", None, None),
        ("table_exists", "users", None, None),
    }


def test_same_catalog_has_no_operations(spark):
    c = catalog.from_contracts(spark, BLOG)
    assert catalog_diff.diff_catalog(c, c).count() == 0


def test_new_database_operations(spark):
    empty = catalog.from_contracts(spark, [TableContract("schema_migrations", (Column("id", "integer"),))])
    ops = catalog_diff.diff_catalog(catalog.from_contracts(spark, BLOG), empty)
    lines = [r["line"] for r in catalog_diff.diff_lines(ops).orderBy(*catalog_diff.ORDER).collect()]
    assert lines == [
        "CREATE TABLE users", "CREATE INDEX idx_users_created_at ON users", "CREATE TABLE posts",
        "ADD FOREIGN KEY posts.user_id → users.id", "CREATE TABLE post_tags",
        "CREATE INDEX idx_post_tags_unique ON post_tags", "ADD FOREIGN KEY post_tags.post_id → posts.id"]
    parity = catalog_diff.diff_catalog(catalog.from_contracts(spark, BLOG), empty, parity=True)
    assert {r["kind"] for r in parity.collect()} == {"CREATE_TABLE"}


def test_type_change_parity(spark):
    def one(t):
        return catalog.from_contracts(spark, [TableContract("t", (Column("a", t),))])
    assert catalog_diff.diff_catalog(one("bigint"), one("integer"), parity=True).count() == 0
    assert catalog_diff.diff_catalog(one("bigint"), one("integer")).count() == 1
    assert catalog_diff.diff_catalog(one("varchar"), one("character varying")).count() == 0


def test_all_index_members_by_table(spark):
    members = spark.createDataFrame(
        [("i", "t", f"c{n}", n) for n in range(40)] + [("i", "u", "x", 1), ("j", "t", "b", 2), ("j", "t", "a", 1)],
        "index_name string, table_name string, column_name string, member_pos long")
    listed = spark.createDataFrame([("i", "t"), ("i", "u"), ("j", "t"), ("k", "t")], "index_name string, table_name string")
    details = spark.createDataFrame([("j", "t", True, "hash")], "index_name string, table_name string, is_unique boolean, method string")
    got = rows(catalog.catalog_indexes(listed, members, details))
    assert got == [
        ("i", "t", 40, ",".join(f"c{n}" for n in range(40)), False, "btree"), ("i", "u", 1, "x", False, "btree"),
        ("j", "t", 2, "a,b", True, "hash"), ("k", "t", 0, "", False, "btree")]
    assert catalog.index_members(listed, members).count() == 43


def test_references_of_one_name_stay_apart(spark):
    """Two tables with a composite reference of the same name: four rows, not sixteen."""
    both = [("fk", t, c, p) for t in ("a", "b") for p, c in enumerate(("x", "y"))]
    usage = spark.createDataFrame(both, "constraint_name string, table_name string, column_name string, ordinal_position long")
    constraints = spark.createDataFrame([("fk", "a", "FOREIGN KEY"), ("fk", "b", "FOREIGN KEY")],
                                        "constraint_name string, table_name string, constraint_type string")
    referenced = spark.createDataFrame([(n, t, p, "r", f"r_{t}_{c}") for n, t, c, p in both],
                                       "constraint_name string, table_name string, ordinal_position long, ref_table string, ref_column string")
    rules = spark.createDataFrame([("fk", "a", "CASCADE", "RESTRICT")],
                                  "constraint_name string, table_name string, delete_rule string, update_rule string")
    got = rows(catalog.catalog_foreign_keys(constraints, usage, referenced, rules).select("table_name", "column_name", "ref_column", "on_delete"))
    assert got == [("a", "x", "r_a_x", "CASCADE"), ("a", "y", "r_a_y", "CASCADE"), ("b", "x", "r_b_x", None), ("b", "y", "r_b_y", None)]
