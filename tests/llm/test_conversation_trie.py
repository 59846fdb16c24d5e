"""The trie against every prefix spelt out, with small levels, shards and pieces of ends."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from keelrow.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"
GROUP = 20


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role, digest(role, text), text))
    turns = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % GROUP) * (1 if c >= 0 else -1)
        seqs[c] = turns.get(base, [])[:h] + mine[h:]
    members = defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[tuple(seqs[c][:d])].append(c)
    children = defaultdict(int)
    for prefix in members:
        if prefix:
            children[prefix[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for prefix, convs in members.items():
        words = len("".join(x if x not in "\t\n\v\f\r" else " " for x in prefix[-1][1]).split(" ")) if prefix else 0
        words = len([w for w in "".join(x if x not in "\t\n\v\f\r" else " " for x in prefix[-1][1]).split(" ") if w]) if prefix else 0
        for d in range(len(prefix) + 1):
            leaves[prefix[:d]] += children[prefix] == 0
            saved[prefix[:d]] += (len(convs) - 1) * words
    out = []
    for prefix, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(seqs[c]) == len(prefix))
        out.append((
            convs[0], len(prefix), members[prefix[:-1]][0] if prefix else None, len(convs), children[prefix], leaves[prefix],
            saved[prefix], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def built(spark, rows, schema=SCHEMA):
    turns, convs = trie.encode(spark.createDataFrame(rows, schema))
    head = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(4))
    found = trie.nodes(*trie.rebuilt(turns, convs, GROUP, head, 3))
    assert found.columns == list(trie.NODE)
    return sorted(map(tuple, found.collect()), key=lambda r: (r[1], r[0]))


def conversations(n, seed=2, longest=9, texts=3):
    draw = random.Random(seed)
    said = ["", "a b", "a  b\tc", "x\x1cy", "é\n", None]
    rows = []
    for c in range(n):
        for t in range(draw.randrange(1, longest)):
            rows.append((c, t, draw.choice(["user", None]), draw.choice(said[:texts])))
    draw.shuffle(rows)
    return rows


HARD = [
    (None, 0, "user", "no conversation"), (5000, None, None, None), (5000, None, "user", "b"), (5000, 2, "user", "x" * 50_000),
    (5000, 2, "user", "x" * 50_000), (5000, 2, "a", "tied"), (-3, 0, "user", "negative"), (-20, 0, "user", "negative base"),
    (5017, 1, "only", "turn"), (5018, 1, "only", "turn"), (1 << 40, 7, "user", "\n"),
]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(trie, "LEVEL", 3)
    monkeypatch.setattr(trie, "SHARD", 12)
    monkeypatch.setattr(trie, "ENDS", 2)


def test_equals_all_prefixes(spark):
    rows = conversations(150) + HARD
    assert built(spark, rows) == brute(rows)


def test_equals_all_prefixes_in_small_levels_and_shards(spark, small):
    rows = conversations(120, seed=5, longest=14, texts=2) + HARD
    # a group of equal conversations over many shards, and longer ones that go on from them
    same = [("user", f"t{t}") for t in range(7)]
    for c in range(6000, 6060):
        rows += [(c, t, *turn) for t, turn in enumerate(same + ([("user", f"more {c % 3}")] * (c % 4) if c % 5 == 0 else []))]
    assert built(spark, rows) == brute(rows)


def test_one_long_conversation_and_its_copy(spark, small):
    rows = [(c, t, "user", f"turn {t}") for c in (0, 1, 40) for t in range(25)] + [(2, 0, "user", "short")]
    rows += [(40, 100 + t, "user", "alone") for t in range(10)]
    assert built(spark, rows) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert built(spark, []) == []
    rows = conversations(30)
    assert built(spark, [(*r, 1, 2, 3, "z") for r in rows], SCHEMA + ", conv int, position int, key int, `a b` string") == brute(rows)


def test_median_insertion_keeps_siblings_balanced():
    tree = trie.SearchTree()
    for i in trie.medians(1000):
        tree.insert([i], [1])
    assert sorted(trie.medians(1000)) == list(range(1000))

    def height(node):
        return 0 if node < 0 else 1 + max(height(tree.low[node]), height(tree.high[node]))

    assert height(tree.same[0]) == 10
