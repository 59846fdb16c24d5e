"""References, keys and hierarchies read off the data, against plain Python."""

import math
import random
from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

from keelrow import Column, ForeignKey, TableContract
from keelrow.operators import actions, changes, inclusion, key_search, profile
from keelrow.operators.reach import hanging_on


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "Exchange" in line]


# ------------------------------------------------------------------ references

def test_references_of_keys(spark, sf_dir):
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("customer", "orders", "nation", "region")}
    keys = {"customer": "c_custkey", "nation": "n_nationkey", "region": "r_regionkey", "orders": "o_orderkey"}
    got = {tuple(r)[:4]: r["included"] for r in profile.discover_references(tables, keys).collect()}
    assert got["orders", "o_custkey", "customer", "c_custkey"] and not got["customer", "c_nationkey", "region", "r_regionkey"]
    named = {tuple(r)[:4] for r in profile.discover_references(tables, keys, same_name=True).collect()}
    assert named < set(got) and ("orders", "o_orderkey", "customer", "c_custkey") not in named


def test_values_of_all_tables_meet_in_one_shuffle(spark, sf_dir):
    names = ("customer", "orders", "lineitem", "part", "supplier", "nation", "region")
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    attributes = list(dict.fromkeys(a for pair in inclusion.unary_pairs(tables) for a in pair))
    assert len(attributes) > 35
    found = exchanges(inclusion.attribute_sets(tables, attributes))
    # one by value, one of the counted sets
    assert len(found) == 2 and sum("value" in line for line in found) == 1


def test_equal_values_of_a_family(spark):
    tables = {
        "a": spark.sql("SELECT * FROM VALUES (1S, 1.50D, 2.50BD, 'x', X'01', date'2020-01-01'), (NULL, -0.0D, 3BD, NULL, NULL, NULL) AS t(i, d, n, s, b, t)"),
        "b": spark.sql("SELECT * FROM VALUES (1L, 1.5D, 2.5000BD, 'x', X'01', date'2020-01-01', array(1)), (2L, 0.0D, 3.0BD, 'y', X'02', NULL, array(2)) AS t(i, d, n, s, b, t, l)"),
    }
    got = {(r["child_column"], r["parent_table"]): tuple(r)[4:] for r in inclusion.discover_inclusions(tables).collect()}
    assert {k: v for k, v in got.items() if k[1] == "b"} == {
        (c, "b"): (n, 0, True) for c, n in (("i", 1), ("d", 2), ("n", 2), ("s", 1), ("b", 1), ("t", 1))}
    assert got["i", "a"] == (2, 1, False) and ("l", "a") not in got


def test_a_column_without_values_is_included_nowhere(spark):
    tables = {"a": spark.createDataFrame([(None,)], "x int"), "b": spark.createDataFrame([(1,)], "y int")}
    got = {(r["child_table"]): (r["n_values"], r["n_missing"], r["included"]) for r in inclusion.discover_inclusions(tables).collect()}
    assert got == {"a": (0, 0, False), "b": (1, 1, False)}


def test_more_columns_than_bits(spark):
    names = [f"c{i}" for i in range(70)]
    df = spark.createDataFrame([tuple(range(70)), tuple(range(1, 71))], ", ".join(f"{n} int" for n in names))
    got = {(r["child_column"], r["parent_column"]): r["n_missing"] for r in inclusion.discover_inclusions({"t": df}).collect()}
    assert len(got) == 70 * 69
    assert all(n == len({int(a[1:]), int(a[1:]) + 1} - {int(b[1:]), int(b[1:]) + 1}) for (a, b), n in got.items())


def composite_brute(tables, width):
    """All included combinations: rows as dictionaries."""
    def values(table, columns):
        return {tuple(r[c] for c in columns) for r in tables[table] if all(r[c] is not None for c in columns)}

    out = set()
    for child, parent in permutations(list(tables) + list(tables), 2):
        left_names, right_names = sorted(tables[child][0]), sorted(tables[parent][0])
        for k in range(2, width + 1):
            for left in combinations(left_names, k):
                for right in permutations(right_names, k):
                    if child == parent and any(a == b for a, b in zip(left, right)):
                        continue
                    own = values(child, left)
                    singles = all(values(child, (a,)) and values(child, (a,)) <= values(parent, (b,)) for a, b in zip(left, right))
                    if singles and own and own <= values(parent, right):
                        out.add((child, ",".join(left), parent, ",".join(right), k, len(own)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_composite_references_match_brute_force(spark, seed):
    draw = random.Random(seed)
    parent = [{"p": draw.randrange(4), "q": draw.randrange(4), "r": draw.randrange(3)} for _ in range(25)]
    child = [{**{c: r[p] for c, p in zip("abc", "pqr")}} for r in draw.choices(parent, k=12)]
    child[0]["b"] = None
    data = {"child": child, "parent": parent}
    frames = {
        "child": spark.createDataFrame([tuple(r[c] for c in "abc") for r in child], "a int, b int, c bigint"),
        "parent": spark.createDataFrame([tuple(r[c] for c in "pqr") for r in parent], "p int, q smallint, r int")}
    got = {tuple(r) for r in inclusion.discover_composite_inclusions(frames).collect()}
    expected = composite_brute(data, 3)
    # apriori: every part of two columns is included as well
    assert got == {e for e in expected if e[4] == 2 or all(
        any(x[:3:2] == e[:3:2] and set(zip(x[1].split(","), x[3].split(","))) == set(part) for x in expected if x[4] == 2)
        for part in combinations(tuple(zip(e[1].split(","), e[3].split(","))), 2))}
    assert ("child", "a,b,c", "parent", "p,q,r") in {e[:4] for e in got}


def test_composite_references_only_to_given_keys(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    key = spark.createDataFrame([(1, 2, 3)], "x int, y int, z int")
    got = {tuple(r)[:4] for r in inclusion.discover_composite_inclusions({"t": df, "k": key}, {"k": [("x", "y")]}).collect()}
    assert got == {("t", "a,b", "k", "x,y")}
    assert inclusion.discover_composite_inclusions({"t": spark.createDataFrame([], "a int")}).collect() == []


# ------------------------------------------------------------------ keys

def keys_brute(rows, names, width):
    unique = []
    for k in range(1, width + 1):
        for group in combinations(range(len(names)), k):
            if any(set(u) <= set(group) for u, _ in unique):
                continue
            held = [tuple(r[c] for c in group) for r in rows if all(r[c] is not None for c in group)]
            if held and len(set(held)) == len(held):
                unique.append((group, len(held)))
    return {(",".join(names[c] for c in g), len(g), n, len(rows) - n, n == len(rows)) for g, n in unique}


@pytest.mark.parametrize("seed", range(4))
def test_composite_keys_match_brute_force(spark, seed):
    draw = random.Random(seed)
    sizes = [2, 3, 5, 9, 30, 4]
    rows = [tuple(draw.choice([None] + [*range(s)] * 3) if s == 9 else draw.randrange(s) for s in sizes) for _ in range(60)]
    names = list("abcdef")
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    got = {tuple(r) for r in key_search.composite_key_candidates(df, max_width=5).collect()}
    assert got == keys_brute(rows, names, 5)


def test_agree_sets_refute_before_counting(spark, monkeypatch):
    counted = []
    plain = key_search._counted
    monkeypatch.setattr(key_search, "_counted", lambda held, groups: counted.append(len(groups)) or plain(held, groups))
    rows = [(i % 2, i % 3, i % 5, i) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b int, c int, id int")
    assert [r["columns"] for r in key_search.composite_key_candidates(df).collect()] == ["id"]
    # ab, ac, bc and abc repeat: agree sets or numbers say so
    assert counted == [4]


def test_keys_of_repeated_empty_and_nested_rows(spark):
    twice = spark.createDataFrame([(1, 2), (1, 2)], "a int, b int")
    assert key_search.composite_key_candidates(twice).collect() == []
    assert key_search.composite_key_candidates(spark.createDataFrame([], "a int, b int")).collect() == []
    nested = spark.createDataFrame([([1], 1), ([2], 1)], "a array<int>, b int")
    assert key_search.composite_key_candidates(nested).collect() == []
    assert key_search.composite_key_candidates(nested.select("a")).collect() == []
    nulls = spark.createDataFrame([(None, 1), (None, 1), (3, 1)], "a int, b int")
    assert [tuple(r) for r in key_search.composite_key_candidates(nulls).collect()] == [("a", 1, 1, 2, False)]


def test_composite_keys_are_the_same_in_passes(spark, monkeypatch):
    draw = random.Random(7)
    rows = [(i % 40, i // 40, draw.randrange(30), draw.choice([None, 0.0, -0.0, 1.5, 2.5]), draw.choice("abcdef")) for i in range(400)]
    names = [*"abcde"]
    df = spark.createDataFrame(rows, "a int, b long, c int, d double, e string")
    most, plain = [], key_search.shuffles_removed
    for name, small in (("_SMALL", 100), ("_SHUFFLED", 150), ("_SHOWN", 50), ("_FEW", 7)):
        monkeypatch.setattr(key_search, name, small)
    monkeypatch.setattr(key_search, "shuffles_removed", lambda session: most.append(1) or plain(session))
    assert {tuple(r) for r in key_search.composite_key_candidates(df, max_width=4).collect()} == keys_brute(rows, names, 4)
    assert len(most) > 6


# ------------------------------------------------------------------ hierarchies

@pytest.mark.parametrize("depth", [1, 2, 3, 20, 70])
def test_rounds_grow_with_the_logarithm_of_the_depth(spark, depth):
    nodes = spark.createDataFrame([(i, i - 1 if i else None, i == 0) for i in range(depth + 1)], "id int, up int, gone boolean")
    gone, rounds = hanging_on(nodes, ["id"], ["up"])
    assert gone.count() == depth + 1
    assert rounds <= 2 + math.log2(depth)


def test_rings_end_and_missing_parents_save(spark):
    data = [(1, 2, False), (2, 1, False), (3, 4, True), (4, 3, False), (5, 99, False), (6, 5, False), (7, 7, False), (8, 3, False)]
    gone, rounds = hanging_on(spark.createDataFrame(data, "id int, up int, gone boolean"), ["id"], ["up"])
    assert {r["id"] for r in gone.collect()} == {3, 4, 8} and rounds <= 4


TREE = TableContract("t", (
    Column("id", "bigint", primary=True), Column("up", "integer", foreign_key=ForeignKey("t", "id", "CASCADE")), Column("b", "bigint")))


def test_deep_chain_is_deleted_in_few_rounds(spark):
    df = spark.createDataFrame([(i, i - 1 if i else None, i) for i in range(200)] + [(1000, None, 1), (None, 5, 1)], "id long, up int, b long")
    done = actions.delete_with_actions({"t": df}, [TREE], "t", spark.createDataFrame([(3,)], "id long"))
    assert sorted(r["b"] for r in done.tables["t"].collect()) == [0, 1, 1, 2]
    assert done.rounds <= 2 + math.log2(200)


@pytest.mark.parametrize("seed", range(2))
def test_ring_of_tables_with_one_parent_a_row(spark, seed):
    """r -> a <-> b -> c, and a row of b may hang on a row of c only through a."""
    draw = random.Random(seed)
    key = Column("id", "integer", primary=True)

    def ref(table):
        return Column("up", "integer", foreign_key=ForeignKey(table, "id", "CASCADE"))

    contracts = [
        TableContract("r", (key,)),
        TableContract("a", (key, ref("b"), Column("r", "integer", foreign_key=ForeignKey("r", "id", "CASCADE")))),
        TableContract("b", (Column("id", "bigint", primary=True), ref("a"))),
        TableContract("c", (key, ref("b")))]
    n = range(60)
    data = {
        "r": [(i,) for i in range(8)], "a": [(i, draw.choice([None, *n]), draw.choice([None] * 6 + [*range(8)])) for i in n],
        "b": [(i, draw.choice([None, *n])) for i in n], "c": [(i, draw.choice([None, *n])) for i in n]}
    gone = {"r": {0, 1}, "a": set(), "b": set(), "c": set()}
    for _ in range(200):
        gone["a"] |= {x[0] for x in data["a"] if x[1] in gone["b"] or x[2] in gone["r"]}
        gone["b"] |= {x[0] for x in data["b"] if x[1] in gone["a"]}
        gone["c"] |= {x[0] for x in data["c"] if x[1] in gone["b"]}
    tables = {c.name: spark.createDataFrame(data[c.name], c.struct()) for c in contracts}
    done = actions.delete_with_actions(tables, contracts, "r", spark.createDataFrame([(0,), (1,)], "id int"))
    assert {t: {x["id"] for x in df.collect()} for t, df in done.tables.items()} == {
        t: {x[0] for x in rows} - gone[t] for t, rows in data.items()}
    assert done.rounds > 0


def test_rejected_rows_take_deep_chains_along(spark):
    """200 rows, each referring to the one before; the first refers to nothing."""
    contract = TableContract("t", (
        Column("id", "bigint", primary=True), Column("up", "bigint", foreign_key=ForeignKey("t", "id")), Column("n", "integer")))
    target = spark.createDataFrame([(5000, None, 1)], contract.struct())
    rows = [(i, i - 1 if i else 9999, "1") for i in range(200)] + [(300, 5000, "1"), (301, 300, "1"), (302, 302, "1"), (303, 304, "x"), (304, 303, "1"), (305, 9999, "x")]
    done = changes.insert(target, spark.createDataFrame(rows, "id long, up long, n string"), contract, mode="quarantine")
    assert sorted(r["id"] for r in done.accepted.collect()) == [300, 301, 302]
    broken = {r["id"]: sorted(r["violations"]) for r in done.rejected.collect()}
    assert broken[199] == ["foreign_key:up"] and broken[304] == ["foreign_key:up"]
    assert broken[303] == ["type:n"] and broken[305] == ["foreign_key:up", "type:n"]
