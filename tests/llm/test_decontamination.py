"""Decontamination: copies and near copies of items are found, all else is left alone."""

import random

import pytest
from pyspark.sql import functions as F

from keelrow.llm import decontamination as d

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(seed, n):
    draw = random.Random(seed)
    return [f"w{draw.randrange(5000)}" for _ in range(n)]


def found(spark, docs, items):
    rows = d.leaking_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    return sorted(((r["doc_id"], r["item_id"], r["n_windows"], r["first_word"]) for r in rows), key=repr)


def test_places_of_copies(spark):
    long_item, short_item, tiny = words(1, 60), words(2, 12), ["tiny", "item", "here"]
    items = [(1, " ".join(long_item)), (2, " ".join(short_item)), (3, " ".join(tiny)), (4, None), (5, ""), (6, " ".join(long_item))]
    near = long_item[:30] + ["changed"] + long_item[31:]
    far = [w if i % 3 else "other" for i, w in enumerate(long_item)]
    docs = [
        (10, " ".join(words(10, 50) + long_item + words(11, 50))), (11, " ".join(w.upper() + "," for w in short_item)),
        (12, " ".join(words(12, 30) + near + words(13, 9))), (13, " ".join(far)), (14, " ".join(words(14, 500))),
        (15, "A tiny; ITEM -- here"), (16, None), (17, ""), (None, " ".join(short_item)), (18, " ".join(words(15, 60_000) + short_item)),
        (10, " ".join(words(10, 50) + long_item + words(11, 50))), (19, " ".join(short_item + ["x"] + short_item)),
    ]
    assert found(spark, docs, items) == sorted([
        (10, 1, 1, 50), (10, 6, 1, 50), (11, 2, 1, 0), (12, 1, 1, 30), (12, 6, 1, 30), (15, 3, 1, 1), (None, 2, 1, 0),
        (18, 2, 1, 60_000), (19, 2, 2, 0)], key=repr)
    left = d.drop_leaking(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert sorted(r[0] for r in left.collect()) == [13, 14, 16, 17]


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "some words of a text that is here", 7, "x")], DOCS + ", item_id int, similarity string")
    items = spark.createDataFrame([(1, "some words of a text that is here", "y")], ITEMS + ", n string")
    assert d.leaking_items(docs, items.limit(0)).collect() == []
    assert d.leaking_items(docs.limit(0), items).collect() == []
    assert d.drop_leaking(docs, items.limit(0)).columns == docs.columns
    assert d.drop_leaking(docs, items.limit(0)).count() == 1
    assert d.drop_leaking(docs, items).count() == 0


def test_index_reaches_every_fingerprint_within_the_radius():
    draw = random.Random(4)
    near = set(d._near_values())
    for _ in range(300):
        flips = draw.sample(range(64), d.RADIUS)
        assert any(sum(1 << b % 8 for b in flips if b // 8 == block) in near for block in range(d.BLOCKS))


def test_similarity_is_weighted_jaccard(spark):
    df = spark.createDataFrame(
        [([(1, 2.0), (2, 1.0)], [(1, 1.0), (3, 4.0)]), ([(1, 2.0)], [(1, 2.0)])],
        "a array<struct<h:bigint,weight:double>>, b array<struct<h:bigint,weight:double>>")
    got = [r[0] for r in df.select(d._similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(1 / 7), pytest.approx(1.0)]


def test_plan_has_no_python(spark, sf_dir):
    import __spark_entry__ as entry
    plan = entry.queries()["op3_decontamination"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("shared", [80, 100])
def test_items_of_one_form_are_all_found(spark, shared):
    """300 items share a form and end in a word of their own; a document that repeats one with its last word changed is
    alike to every item of the form, and all those pairs are found."""
    form = words(30, shared + 4)
    items = [(i, " ".join([*form, f"own{i}"])) for i in range(300)]
    docs = [(i, " ".join([*words(1000 + i, 20), *form, f"other{i}", *words(2000 + i, 20)])) for i in range(20)]
    got = d.leaking_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    import math
    common, own = shared * math.log(2), math.log(301)
    expected = common / (common + 2 * own)
    if expected >= 0.8:
        assert len({(r["doc_id"], r["item_id"]) for r in got}) == 20 * 300
        assert all(r["similarity"] == pytest.approx(expected, abs=1e-6) for r in got)
    else:
        assert got == []
