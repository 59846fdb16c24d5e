"""SimHash near-dedup against all pairs."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from keelrow.llm import components, simhash_dedup
from keelrow.llm.common import LAST_ID

SCHEMA = "doc_id long, text string"


def shingles_of(text, width=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def fingerprint(text, width=3):
    shingles = shingles_of(text, width)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints, radius=3):
    """Smallest id reachable, of (id, fingerprint); a missing id comes last."""
    ids = [LAST_ID if i is None else i for i, _ in prints]
    values = np.array([p for _, p in prints], np.uint64)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= radius) + i + 1:
            root[find(j)] = find(i)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), LAST_ID), ids[i])
    return [None if least[find(i)] == LAST_ID else least[find(i)] for i in range(len(ids))]


def first_of_groups(texts, radius=8, width=5, similarity=0.8):
    """The smallest id of each group of texts whose fingerprints are near and whose shingles are alike; texts by id."""
    ids = sorted(texts)
    prints = {i: fingerprint(texts[i], width) for i in ids}
    sets = {i: set(shingles_of(texts[i], width)) or {b""} for i in ids}
    least = {i: i for i in ids}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, j in itertools.combinations(ids, 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            shared = len(sets[i] & sets[j])
            if shared >= similarity * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((find(i), find(j)))
                least[b] = a
    return {i for i in ids if find(i) == i}


def check(spark, rows):
    got = simhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = sorted(((r[0], r[1] & (1 << 64) - 1, r[2]) for r in got.collect()), key=repr)
    prints = [(i, fingerprint(t)) for i, t in rows]
    assert got == sorted(((i, p, c) for (i, p), c in zip(prints, grouped(prints))), key=repr)


def test_texts(spark):
    random.seed(5)
    base = [f"w{random.randrange(500)}" for _ in range(300)]
    rows = [(i, " ".join(base[:k] + [f"new{i}"] + base[k + 1:])) for i, k in enumerate(range(40, 240, 4))]
    rows += [(100 + i, " ".join(random.choices(base, k=random.randrange(1, 60)))) for i in range(100)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "One"), (304, "one"), (305, "one two"), (305, "one two"), (None, "one"),
             (306, "é è ê ë"), (307, "x " * 200_000), (308, "\x1c a b c")]
    check(spark, rows)


def edited(words, n, seed):
    draw, out = random.Random(seed), list(words)
    for at in draw.sample(range(len(out)), n):
        out[at] = f"edit{seed}x{at}"
    return " ".join(out)


def test_verified_near_duplicates(spark):
    draw, texts = random.Random(11), {}
    for g in range(60):
        words = [f"w{draw.randrange(4000)}" for _ in range(200)]
        for k, edits in enumerate((0, 0, 1, 2, 4, 12, 40)):
            texts[100 * g + k] = edited(words, edits, 100 * g + k) if k else " ".join(words)
    # half of a text in another: near in words, not alike
    texts[9000] = texts[0] + " " + " ".join(f"z{i}" for i in range(200))
    texts.update({9001: "", 9002: " \n", 9003: "one", 9004: "One"})
    df = spark.createDataFrame(list(texts.items()), SCHEMA).repartition(4)
    got = {r["doc_id"] for r in simhash_dedup.drop_near_duplicates(df, radius=8, width=5, similarity=0.8).collect()}
    assert got == first_of_groups(texts)
    # against the similarity alone: what the fingerprints lose
    alike = first_of_groups(texts, radius=64)
    dropped = set(texts) - alike
    assert len(dropped) > 200 and len(dropped - got) >= 0.75 * len(dropped) and not alike - got


def test_large_groups_lose_no_verified_link(spark):
    """Families in which each text is an edit of an earlier one: many are near in bits that are not alike."""
    draw, texts = random.Random(23), {}
    for g in range(8):
        family = [[f"w{draw.randrange(4000)}" for _ in range(200)]]
        while len(family) < 60:
            own = list(draw.choice(family))
            for at in draw.sample(range(200), draw.randrange(1, 4)):
                own[at] = f"edit{g}x{len(family)}x{at}"
            family.append(own)
        texts.update({100 * g + i: " ".join(own) for i, own in enumerate(family)})
    df = spark.createDataFrame(list(texts.items()), SCHEMA).repartition(4)
    got = {r["doc_id"] for r in simhash_dedup.drop_near_duplicates(df, radius=8, width=5, similarity=0.8).collect()}
    assert got == first_of_groups(texts)


def test_verified_rows_that_repeat(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "b"), (1, text, "a"), (1, text, "a"), (1, text + " more", "c"), (None, text, "d"), (2, "other", None), (None, None, "e")]
    df = spark.createDataFrame(rows, SCHEMA + ", root string")
    for options in ({"similarity": 0.8, "width": 5, "radius": 8}, {}):
        got = simhash_dedup.drop_near_duplicates(df, **options)
        assert got.columns == df.columns
        kept = sorted(((r["doc_id"], r["text"], r["root"]) for r in got.collect()), key=repr)
        # of the rows of one id and text one stays, whichever columns differ, the same one at every run
        assert kept == sorted(((r["doc_id"], r["text"], r["root"]) for r in simhash_dedup.drop_near_duplicates(
            df.repartition(3), **options).collect()), key=repr)
        assert len(kept) == 3 and {k[0] for k in kept} == {1, 2, None}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash_dedup.near_duplicates(empty).collect() == []
    assert simhash_dedup.drop_near_duplicates(empty).collect() == []


@pytest.mark.parametrize("layout", ["small", "near", "hot"])
def test_links_connect_all_within_the_radius(spark, layout):
    """Random fingerprints with families; blocks of hot keys are split and still whole."""
    draw = np.random.default_rng(11)
    centers = draw.integers(0, 1 << 63, {"small": 400, "near": 60, "hot": 1}[layout]).tolist()
    prints = set()
    for center in centers:
        for _ in range({"small": 2, "near": 20, "hot": 1500}[layout]):
            value = center
            for bit in draw.integers(0, 64, draw.integers(0, 7)):
                value ^= 1 << int(bit)
            prints.add(value)
    rows = [(i, p) for i, p in enumerate(sorted(prints))]
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in rows], "fp long, node long")
    found = {r[0]: r[1] for r in components.components(simhash_dedup.links(df), "a", "b").collect()}
    assert [found.get(i, i) for i, _ in rows] == grouped(rows)


def test_allocation_keeps_the_pigeonhole(spark):
    near = [[1e-3, 1e-2, 0.1, 0.3]] * 3
    for m in (2, 3, 4):
        _, chosen = simhash_dedup.allocate([64 // m] * m, (near * 2)[:m], 10_000, 3)
        assert sum(chosen) == 3 - m + 1
        # any three flipped bits leave one partition within its threshold
        for spread in itertools.product(range(4), repeat=m):
            if sum(spread) <= 3:
                assert any(x <= t for x, t in zip(spread, chosen))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, x) for x in range(1001, 1200)] + [(5, 5)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    assert got == {**{i: 0 for i in range(61)}, **{x: 1000 for x in range(1000, 1200)}}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_one_document_of_each_group_stays(spark):
    rows = [(3, "a b c d", "p"), (1, "a b c d", "q"), (1, "a b c d", "r"), (2, "quite another text here", None), (None, "a b c d", "s"),
            (None, "no id but an own text", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    left = simhash_dedup.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted((r[0] or 0, r[1]) for r in left.collect()) == [
        (0, "no id but an own text"), (1, "a b c d"), (2, "quite another text here")]


def test_query_finds_the_groups(spark, sf_dir):
    import __spark_entry__ as entry
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    prints = [(i, fingerprint(t)) for i, t in docs]
    expected = {i: ("%016x" % p, c) for (i, p), c in zip(prints, grouped(prints))}
    got = entry.queries()["op6_simhash_dedup"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == expected
