"""Line dedup against a plain reading of its rules."""

import hashlib
import random

import numpy as np
import pytest

from keelrow.llm import line_dedup, perfect_hash

SCHEMA = "doc_id long, text string"


def by_hand(rows):
    def key(line):
        return line.strip(b" \t\n\x0b\x0c\r").lower()

    holders = {}
    for doc_id, text in rows:
        for line in (text or "").encode().split(b"\n"):
            if len(key(line).decode()) >= 10:
                holders.setdefault(key(line), set()).add((1 << 63) - 1 if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").encode().split(b"\n")
        own = (1 << 63) - 1 if doc_id is None else doc_id
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == own]
        out.append((doc_id, b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in df.collect()), key=repr)


HARD = [
    (1, "a shared line here\nown line number one\nshort\nshort"),
    (2, "  A SHARED line here\t\nshort\n\nown line number two"),
    (3, "a shared line here"), (3, "a shared line here"),  # repeated rows are one holder
    (4, None), (5, ""), (6, "\n\n"), (None, "a shared line here\nonly without an id"), (None, "only without an id"),
    (7, "ééééééééé"), (8, "ééééééééé"), (9, "éééééééééé"), (10, "Éééééééééé"), (11, "éééééééééé"),  # 9 and 10 characters
    (12, "x" * 300_000 + "\na shared line here"), (-5, "x" * 300_000),
    (13, "twice in one document\ntwice in one document"),
]


def test_rules_on_hard_rows(spark):
    assert found(line_dedup.drop_repeated_lines(spark.createDataFrame(HARD, SCHEMA))) == by_hand(HARD)


def test_random_rows_with_a_hot_line(spark):
    random.seed(3)
    pool = [f"line of the pool {i}" for i in range(200)]
    rows = [
        (i, "\n".join(["the line of every third document"] * (i % 3 == 0) + random.choices(pool, k=random.randrange(6))
                      + [f"only in {i}"]))
        for i in range(3000)
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert found(line_dedup.drop_repeated_lines(df)) == by_hand(rows)


def test_empty_table_and_clashing_columns(spark):
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "a shared line here", "x", 5), (2, "a shared line here", None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hi string, n_lines int")
    done = line_dedup.drop_repeated_lines(df)
    assert done.columns == ["doc_id", "text", "hi", "n_lines", "n_dropped"]
    assert sorted(map(tuple, done.collect())) == [(1, "a shared line here", "x", 1, 0), (2, "", None, 1, 1)]


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_perfect_hash_is_minimal(n):
    random = np.random.default_rng(n)
    high, low = random.integers(0, 1 << 63, (2, n)).astype(np.uint64)
    sizes, words = perfect_hash.build(high, low)
    assert sorted(perfect_hash.slots(sizes, words, high, low)) == list(range(n))
    if n:
        with pytest.raises(ValueError):
            perfect_hash.build(np.repeat(high[:1], 2), np.repeat(low[:1], 2))


def test_result_is_a_digest_of_the_kept_text(spark, sf_dir):
    import __spark_entry__ as entry
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    kept = {d: t for d, t, _, _ in by_hand(list(docs.items()))}
    for row in entry.queries()["op10_line_dedup"](spark, sf_dir).collect():
        assert row["kept_sha256"] == hashlib.sha256(kept[row["doc_id"]].encode()).hexdigest()
