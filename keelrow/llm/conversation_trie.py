"""The prefix trie of conversations, from ternary search trees per range shard.

Turns are dictionary-encoded: equal (role, text) have one number.  Conversations are range partitioned by their sequence
of numbers, so a shard holds neighbours, and a group of equal conversations may fill many shards.  Each shard builds a ternary
search tree: the distinct sequences are inserted medians first, so the binary trees among siblings are balanced.  An iterative
traversal adds up members, leaves and savings.  Only the prefixes of a shard's first and last sequence can go on in a
neighbour; these boundary nodes are merged by a digest of their prefix, and what a merged node adds goes to all its merged
ancestors.  Every other node is final in its shard.

Sequences are cut into levels of ``LEVEL`` turns, so no row, shard or tree grows with one conversation.  A level below the
first is keyed by its start node and built only for conversations that still share it; turns that no other
conversation shares are nodes of their own and need no tree.  Totals go up level by level.  The number of levels is that of the longest
shared prefix.

Positions within a conversation come from one global sort and a prefix sum over partitions, so a conversation with very
many turns fills no single task.  Texts are read once and never shuffled: a SHA-256 of role and text stands for them.

Defined results: rows with a null conversation id take no part; null turns come first, equal ones are ordered by role and
then by that digest; null roles and texts are empty; repeated rows are turns of their own; a text without words adds
nothing to the savings; very long texts are digested where they are read; no conversation, no node (not even a root); columns
other than the four named play no role, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelrow.llm.common import Batches, in_pieces
from keelrow.operators.numbering import dense_numbers
from keelrow.session import cut_lineage

# turns in a level, turn numbers in one tree, ids in one piece of a node's list of ends
LEVEL, SHARD, ENDS = 256, 1 << 16, 500
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
_WORD = r"[^\x20\x09-\x0D]+"
_NOTHING = hashlib.sha256(b"").hexdigest()
_COMPLETE, _BOUNDARY, _ENDS = 0, 1, 2
_SHARD_ROWS = (
    "kind int, key long, digest binary, path array<binary>, depth long, conv long, parent_conv long, n_convs long, "
    "n_children long, n_leaves long, saved long, words long, ends string")
_TYPES = (
    pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.binary()), *[pa.int64()] * 8, pa.string())
_NAMES = [field.split(" ")[0] for field in _SHARD_ROWS.split(", ")]


def encode(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """``conv, position, turn_id, words`` of every turn, and ``conv, n_turns`` of every conversation."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    # the length keeps role and text apart
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    own = conversations.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"),
        digest.alias("digest"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words")).filter(F.col("conv").isNotNull())
    numbered = cut_lineage(
        dense_numbers(own, "number", order=["conv", "turn", "role", "digest"]).select("conv", "number", "digest", "words"))
    convs = cut_lineage(numbered.groupBy("conv").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n_turns")))
    dictionary = cut_lineage(
        dense_numbers(numbered.groupBy("digest").agg(F.max("words").alias("words")), "turn_id"))
    turns = cut_lineage(numbered.drop("words").join(dictionary, "digest").join(convs, "conv").select(
        "conv", (F.col("number") - F.col("first")).alias("position"), "turn_id", "words"))
    return turns, convs.select("conv", "n_turns")


def rebuilt(turns: DataFrame, convs: DataFrame, group: int, head: Column, longest_head: int) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with its first turns replaced by those of c - c % group.

    ``head``, over ``conv``, is how many: the first ``head`` turns of that conversation (all if fewer, none if it is
    absent), then c's own turns after its first ``head``.  At most ``longest_head``.
    """
    wanted = convs.select("conv", "n_turns", (F.col("conv") - F.col("conv") % group).alias("base"), head.cast("long").alias("head"))
    bases = convs.filter(F.col("conv") % group == 0).select(F.col("conv").alias("base"), F.col("n_turns").alias("n_base"))
    made = cut_lineage(wanted.join(bases, "base", "left").select(
        "conv", "base", "head", F.least("head", F.coalesce("n_base", F.lit(0))).alias("n_head"),
        F.greatest(F.col("n_turns") - F.col("head"), F.lit(0)).alias("n_own")))
    own = turns.join(made.select("conv", "head", "n_head"), "conv").filter("position >= head").select(
        "conv", (F.col("position") - F.col("head") + F.col("n_head")).alias("position"), "turn_id", "words")
    # at most `group` conversations take a turn
    heads = turns.filter((F.col("conv") % group == 0) & (F.col("position") < longest_head)).withColumnRenamed("conv", "base").join(
        made.select("conv", "base", "n_head"), "base").filter("position < n_head").select("conv", "position", "turn_id", "words")
    return cut_lineage(own.unionByName(heads)), made.select("conv", (F.col("n_head") + F.col("n_own")).alias("n_turns"))


class SearchTree:
    """A ternary search tree over turn numbers.  Every node is one prefix; node 0 is the empty one.

    ``low`` and ``high`` lead to siblings with smaller and larger numbers, ``same`` to the first child.
    """

    def __init__(self):
        self.turn, self.low, self.same, self.high = [-1], [-1], [-1], [-1]
        self.parent, self.depth, self.words = [-1], [0], [0]
        self.members, self.smallest, self.children, self.leaves, self.saved = [0], [None], [0], [0], [0]
        self.ends: dict[int, list[int]] = {}

    def insert(self, turns: list[int], words: list[int]) -> list[int]:
        """Add a sequence; return its nodes, the empty prefix first."""
        at, path = 0, [0]
        for turn, n_words in zip(turns, words):
            links, slot = self.same, at
            while (found := links[slot]) >= 0 and self.turn[found] != turn:
                links, slot = (self.low if turn < self.turn[found] else self.high), found
            if found < 0:
                found = links[slot] = len(self.turn)
                for column, value in (
                        (self.turn, turn), (self.low, -1), (self.same, -1), (self.high, -1), (self.parent, at),
                        (self.depth, self.depth[at] + 1), (self.words, n_words), (self.members, 0), (self.smallest, None),
                        (self.children, 0), (self.leaves, 0), (self.saved, 0)):
                    column.append(value)
            at = found
            path.append(at)
        return path

    def add(self, node: int, conv: int, ends: bool, below: tuple[int, int, int]) -> None:
        """A member whose sequence stops at the node; ``below``: children, leaves and savings of the next level."""
        self.members[node] += 1
        if self.smallest[node] is None or conv < self.smallest[node]:
            self.smallest[node] = conv
        if ends:
            self.ends.setdefault(node, []).append(conv)
        self.children[node] += below[0]
        self.leaves[node] += below[1]
        self.saved[node] += below[2]

    def accumulate(self, boundary: set[int]) -> None:
        """Add members, leaves and savings up the tree.

        A boundary node passes on its members, but neither its leaves and savings nor itself as a child: those are known only once it is merged.
        """
        stack = [(0, False)]
        while stack:
            node, done = stack.pop()
            if not done:
                stack.append((node, True))
                stack += [(link, False) for link in (self.low[node], self.high[node], self.same[node]) if link >= 0]
                continue
            whole = node not in boundary
            if whole:
                self.saved[node] += (self.members[node] - 1) * self.words[node]
                self.leaves[node] += self.children[node] == 0
            up = self.parent[node]
            if up >= 0:
                self.members[up] += self.members[node]
                if self.smallest[up] is None or self.smallest[node] < self.smallest[up]:
                    self.smallest[up] = self.smallest[node]
                if whole:
                    self.children[up] += 1
                    self.leaves[up] += self.leaves[node]
                    self.saved[up] += self.saved[node]


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle first, then the middles of both halves, and so on."""
    stack = [(0, n)]
    while stack:
        start, end = stack.pop()
        if start < end:
            middle = (start + end) // 2
            yield middle
            stack += [(middle + 1, end), (start, middle)]


def tree_rows(rows: list[tuple], first: bool, last: bool) -> Iterator[tuple]:
    """The nodes of one key's sorted rows ``key, conv, turns, words, ends, below``.

    ``first`` and ``last``: the rows are the first or last of their shard, so a neighbour may go on with their prefixes.
    """
    key, tree, starts = rows[0][0], SearchTree(), [i for i, row in enumerate(rows) if not i or row[2] != rows[i - 1][2]]
    ends = [*starts[1:], len(rows)]
    boundary = {0}
    for i in medians(len(starts)):
        path = tree.insert(rows[starts[i]][2], rows[starts[i]][3])
        for _, conv, _, _, stops, below in rows[starts[i]:ends[i]]:
            tree.add(path[-1], conv, stops, below)
        if (first and i == 0) or (last and i == len(starts) - 1):
            boundary.update(path)
    tree.accumulate(boundary)
    paths = {0: [hashlib.sha256(b"%d" % key).digest()]}
    for node in sorted(boundary - {0}):
        above = paths[tree.parent[node]]
        paths[node] = [*above, hashlib.sha256(above[-1] + b"%d" % tree.turn[node]).digest()]
    for node, depth in enumerate(tree.depth):
        own = (tree.smallest[node], tree.members[node], tree.children[node], tree.leaves[node], tree.saved[node], tree.words[node])
        stopped = tree.ends.get(node, [])
        if node in boundary:
            yield (_BOUNDARY, key, paths[node][-1], paths[node], depth, own[0], None, *own[1:], None)
            for at in range(0, len(stopped), ENDS):
                piece = stopped[at:at + ENDS]
                yield (_ENDS, key, paths[node][-1], None, depth, piece[0], *[None] * 6, ",".join(map(str, piece)))
            continue
        up = tree.parent[node]
        sha = hashlib.sha256(",".join(map(str, stopped)).encode()).hexdigest()
        # a merged parent's smallest member is looked up by its digest
        known = (None, tree.smallest[up]) if up not in boundary else (paths[up][-1], None)
        yield (_COMPLETE, key, known[0], None, depth, own[0], known[1], *own[1:], sha)


def _shards(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Nodes of the sorted rows of a task, one shard of bounded size after the other."""
    def searched(shard):
        groups = []
        for row in shard:
            if not groups or groups[-1][0][0] != row[0]:
                groups.append([])
            groups[-1].append(row)
        found = [
            node for i, group in enumerate(groups) for node in tree_rows(group, i == 0, i == len(groups) - 1)]
        columns = zip(*found)
        yield from in_pieces({name: pa.array(values, kind) for name, values, kind in zip(_NAMES, columns, _TYPES)}, 10_000)

    shard, held = [], 0
    for batch in batches:
        for key, conv, turns, words, ends, *below in zip(*(column.to_pylist() for column in batch.columns)):
            shard.append((key, conv, turns, words, ends, tuple(below)))
            held += len(turns) + 1
            if held >= SHARD:
                yield from searched(shard)
                shard, held = [], 0
    if shard:
        yield from searched(shard)


def _digested(batches: Batches) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined pieces of each node, sorted by node and first id; a node's state is all that is held."""
    now, state = None, None
    for batch in batches:
        done = []
        for digest, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if digest != now:
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = digest, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["digest", "sha"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["digest", "sha"])


def _level(rows: DataFrame, above: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of one level, and for each key what its start node gets from it: ``conv, n_children, n_leaves, saved``.

    ``above`` is the number of turns before the level.
    """
    order = ["key", "turns", "conv"]
    found = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "key", "conv", "turns", "words", "ends", "below_children", "below_leaves", "below_saved").mapInArrow(_shards, _SHARD_ROWS))
    partial = found.filter(F.col("kind") == _BOUNDARY)
    merged = partial.groupBy("digest").agg(
        F.first("key").alias("key"), F.first("path").alias("path"), F.first("depth").alias("depth"), F.min("conv").alias("conv"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved").alias("saved"), F.max("words").alias("words")).withColumn(
        # members that end at the start of a lower level are not among its rows
        "conv", F.when((F.col("depth") == 0) & (F.col("key") >= 0), F.col("key")).otherwise(F.col("conv"))).withColumn(
        "parent", F.when(F.col("depth") > 0, F.element_at("path", -2)))
    merged = cut_lineage(merged)
    children = merged.filter("depth > 0").groupBy(F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("more"))
    whole = cut_lineage(merged.join(children, "digest", "left").withColumn(
        "n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more"))
    # what a merged node adds: itself as a leaf, its savings, and what its complete children have added to it
    added = whole.select(
        F.explode("path").alias("digest"), (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_below"))
    totals = added.groupBy("digest").agg(F.sum("leaves").alias("leaves"), F.sum("saved_below").alias("saved_below"))
    pieces = found.filter(F.col("kind") == _ENDS).repartition("digest").sortWithinPartitions("digest", "conv").select("digest", "ends")
    ends = cut_lineage(pieces.mapInArrow(_digested, "digest binary, sha string"))
    parents = whole.select(F.col("digest").alias("parent"), F.col("conv").alias("merged_parent"))
    boundary = cut_lineage(whole.join(totals, "digest").join(ends, "digest", "left").join(parents, "parent", "left"))

    def named(df: DataFrame, parent: str, leaves: str, saved: str, sha: Column) -> DataFrame:
        return df.select(
            F.col("conv").alias("conv_id"), (F.col("depth") + above).alias("depth"), F.col(parent).alias("parent_conv_id"), "n_convs",
            "n_children", F.col(leaves).alias("n_leaves"), F.col(saved).alias("saved_tokens"), sha.alias("ends_sha256"))

    complete = found.filter(F.col("kind") == _COMPLETE)
    nodes = [
        named(complete.filter("digest IS NULL"), "parent_conv", "n_leaves", "saved", F.col("ends")),
        named(
            complete.filter("digest IS NOT NULL").join(parents.withColumnRenamed("parent", "digest"), "digest"), "merged_parent",
            "n_leaves", "saved", F.col("ends")),
        # the start node of a lower level is a node of the level above
        named(boundary if not above else boundary.filter("depth > 0"), "merged_parent", "leaves", "saved_below", F.coalesce("sha", F.lit(_NOTHING)))]
    start = boundary.filter("depth = 0").select(
        "conv", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved_below").alias("saved"))
    return reduce(DataFrame.unionByName, nodes), start


def nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node, columns ``NODE``, from ``conv, position, turn_id, words`` and ``conv, n_turns``."""
    parts = turns.groupBy("conv", F.expr(f"position div {LEVEL}").alias("level")).agg(
        F.sort_array(F.collect_list(F.struct("position", "turn_id", "words"))).alias("t"))
    # conversations without a turn are members of the root
    every = convs.select("conv", "n_turns", F.lit(0).cast("long").alias("first_level"))
    blocks = cut_lineage(every.join(parts, "conv", "left").select(
        "conv", "n_turns", F.coalesce("level", "first_level").alias("level"),
        F.coalesce(F.col("t.turn_id"), F.array().cast("array<bigint>")).alias("turns"),
        F.coalesce(F.col("t.words"), F.array().cast("array<bigint>")).alias("words")))
    levels, alone = [], []
    members = blocks.filter("level = 0").withColumn("key", F.lit(-1).cast("long"))
    while True:
        level = len(levels)
        members = cut_lineage(members)
        levels.append(members)
        ahead = F.col("n_turns") > (level + 1) * LEVEL
        # who shares the whole level, and how many of them go on
        classes = cut_lineage(members.filter(F.size("turns") == LEVEL).groupBy("key", "turns").agg(
            F.min("conv").alias("class"), F.count_if(ahead).alias("going")).filter("going > 0"))
        on = cut_lineage(members.filter(ahead).join(classes, ["key", "turns"]).select("conv", "class", "going"))
        alone.append(on.filter("going = 1"))
        shared = on.filter("going > 1").select("conv", F.col("class").alias("key"))
        if shared.isEmpty():
            break
        members = blocks.filter(F.col("level") == level + 1).join(shared, "conv")
    found, below = [], None
    for level in reversed(range(len(levels))):
        tails = alone[level]
        given = tails.select(
            F.col("class").alias("conv"), *(F.lit(n).cast("long").alias(c) for c, n in (("n_children", 1), ("n_leaves", 1), ("saved", 0))))
        if below is not None:
            given = given.unionByName(below)
        rows = levels[level].join(given, "conv", "left").select(
            "key", "conv", "turns", "words", (F.col("n_turns") <= (level + 1) * LEVEL).alias("ends"),
            *(F.coalesce(c, F.lit(0)).cast("long").alias(f"below_{c[2:] if c != 'saved' else c}") for c in ("n_children", "n_leaves", "saved")))
        own, below = _level(rows, level * LEVEL)
        found.append(own)
        # turns that nobody shares: one node each
        start = (level + 1) * LEVEL
        last = F.col("position") + 1 == F.col("n_turns")
        found.append(turns.filter(F.col("position") >= start).join(tails, "conv").join(convs, "conv").select(
            F.col("conv").alias("conv_id"), (F.col("position") + 1).alias("depth"),
            F.when(F.col("position") == start, F.col("class")).otherwise(F.col("conv")).alias("parent_conv_id"),
            F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
            F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
            F.sha2(F.when(last, F.col("conv").cast("string")).otherwise(F.lit("")), 256).alias("ends_sha256")))
    return reduce(DataFrame.unionByName, found).select(*NODE)
