"""Hard negatives of anchors by inner product, from STR-packed R-trees searched best first.

Vectors are scaled to integers, so scores are exact.  They are range partitioned by label and first coordinate and cut
into pieces of ``PIECE`` rows; each piece is packed by sort-tile-recursive (sorted by its widest coordinate into slabs,
each slab by the next one, down to leaves of ``LEAF`` rows) and written in that order.  The minimum bounding boxes of
leaves and of ``FANOUT`` nodes each give an interval that holds the inner product of an anchor with every row inside.

A search goes over all pieces with a queue of boxes, the highest upper bound first.  A box is left out if its interval
lies outside every window of scores that is still looked for, if its labels cannot matter, or if its upper bound is
*strictly* below the lowest score that still counts, so ties are never lost.  What a task has found bounds its later pieces.
First the positives of each anchor are searched, then the negatives within the windows that the positives set.

Anchors are read in blocks of ``ANCHORS``; a block and its positives are the only rows that reach the driver and are
broadcast.  Each block is searched against all rows, a bounded number of them in a task's memory; a task returns at most
as many rows for an anchor as are asked for, and those are merged by a grouped sort.

Defined results: rows with a null id, label or vector, a null or non-finite component, or one whose scaled value is
``LIMIT`` or more (products would not fit a long) take no part; equal rows (id, label and vector) count once; rows that share an
id but differ are rows of their own; a shorter vector counts as ending in zeros, an empty one scores 0; ties go to the smaller
id; an anchor without a positive, or a positive without a row in its window, has no row in the result; an empty table has
an empty result; columns other than the three named play no role.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelrow.llm.common import Batches
from keelrow.operators.numbering import dense_numbers
from keelrow.session import scratch_path

SCALE = 256
LIMIT = 1 << 27
PIECE, LEAF, FANOUT, AXES = 8_192, 128, 8, 3
ANCHORS = 10_000
POSITIVES, NEGATIVES = 5, 3
# percent of the positive's score between which a negative's lies
LOW, HIGH = 50, 95
_EXACT = 1 << 53
_PACKED = "piece long, id long, label long, vector binary"


def str_order(vectors: np.ndarray, leaf: int = LEAF, axes: int = AXES) -> np.ndarray:
    """The order of sort-tile-recursive packing over the widest coordinates."""
    if len(vectors) <= leaf or not vectors.shape[1]:
        return np.arange(len(vectors))
    widest = np.argsort(-np.ptp(vectors, axis=0), kind="stable")[:axes]

    def tiled(rows: np.ndarray, left: list[int]) -> list[np.ndarray]:
        rows = rows[np.argsort(vectors[rows, left[0]], kind="stable")]
        leaves = -(-len(rows) // leaf)
        if len(left) == 1 or leaves <= 1:
            return [rows]
        slab = leaf * -(-leaves // max(1, round(leaves ** (1 / len(left)))))
        return [part for at in range(0, len(rows), slab) for part in tiled(rows[at:at + slab], left[1:])]

    return np.concatenate(tiled(np.arange(len(vectors)), widest.tolist()))


class Tree:
    """A packed piece: rows in leaf order and, level by level, the boxes and label ranges of its nodes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.lows, self.highs, self.label_low, self.label_high, self.children = [], [], [], [], []
        low, high, label_low, label_high, size, below = vectors, vectors, labels, labels, LEAF, len(ids)
        while True:
            starts = np.arange(0, below, size)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            label_low, label_high = np.minimum.reduceat(label_low, starts), np.maximum.reduceat(label_high, starts)
            self.lows.append(low)
            self.highs.append(high)
            self.label_low.append(label_low)
            self.label_high.append(label_high)
            # where the children of a node lie in the level below
            self.children.append([(s, min(s + size, below)) for s in starts.tolist()])
            below, size = len(starts), FANOUT
            if below == 1:
                break
        self.largest = float(np.abs(vectors).max(initial=0))

    def fitted(self, anchors: np.ndarray) -> np.ndarray:
        """The anchors with as many coordinates as the piece has; both as long integers where doubles would round.

        Coordinates that the rows of the piece have no part in add nothing.
        """
        width = self.vectors.shape[1]
        own = anchors[:, :width] if anchors.shape[1] >= width else np.pad(anchors, ((0, 0), (0, width - anchors.shape[1])))
        if self.largest * np.abs(own).max(initial=0) * width < _EXACT:
            return own
        self.vectors = self.vectors.astype(np.int64)
        self.lows, self.highs = ([x.astype(np.int64) for x in boxes] for boxes in (self.lows, self.highs))
        return own.astype(np.int64)

    def intervals(self, anchors: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each level: the highest and the lowest inner product of each anchor within each box."""
        positive, negative = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return (
            [products(positive, high) + products(negative, low) for low, high in zip(self.lows, self.highs)],
            [products(positive, low) + products(negative, high) for low, high in zip(self.lows, self.highs)])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b.T


@dataclass
class Anchors:
    """One block.  ``positives`` holds, for each anchor, the id and score of its positives once they are known."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    positives: list[list[tuple[int, int]]] | None = None


def _same_row(tree: Tree, anchor_id: int, label: int, vector: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which of the rows are the anchor itself."""
    same = (tree.ids[rows] == anchor_id) & (tree.labels[rows] == label)
    for at in np.flatnonzero(same):
        same[at] = np.array_equal(tree.vectors[rows[at]], vector)
    return same


def search_positives(tree: Tree, anchors: Anchors, found: list[list[tuple[int, int]]]) -> None:
    """Add the piece's rows to the best ``(-score, id)`` of each anchor's own label."""
    vectors = tree.fitted(anchors.vectors)
    highest, _ = tree.intervals(vectors)
    top = len(tree.children) - 1
    for a, (anchor_id, label) in enumerate(zip(anchors.ids.tolist(), anchors.labels.tolist())):
        best = found[a]
        queue = [(-highest[top][a, 0], top, 0)]
        while queue:
            bound, level, node = heapq.heappop(queue)
            if len(best) == POSITIVES and -bound < -best[-1][0]:
                break
            if not tree.label_low[level][node] <= label <= tree.label_high[level][node]:
                continue
            first, last = tree.children[level][node]
            if level:
                bounds = highest[level - 1][a, first:last]
                for child in range(first, last):
                    heapq.heappush(queue, (-bounds[child - first], level - 1, child))
                continue
            scores = products(vectors[a:a + 1], tree.vectors[first:last])[0]
            wanted = tree.labels[first:last] == label
            if len(best) == POSITIVES:
                wanted &= scores >= -best[-1][0]
            at = np.flatnonzero(wanted) + first
            if len(at):
                at = at[~_same_row(tree, anchor_id, label, vectors[a], at)]
            for row in at.tolist():
                insort(best, (-int(scores[row - first]), int(tree.ids[row])))
                del best[POSITIVES:]


def windows(score: int) -> tuple[int, int]:
    """The scores, both ends included, that a negative of a positive with this score may have."""
    return -(-LOW * score // 100), HIGH * score // 100


def search_negatives(tree: Tree, anchors: Anchors, found: list[list[list[tuple[int, int]]]]) -> None:
    """Add the piece's rows of other labels to the best ``(-score, id)`` within each positive's window."""
    vectors = tree.fitted(anchors.vectors)
    highest, lowest = tree.intervals(vectors)
    top = len(tree.children) - 1
    for a, label in enumerate(anchors.labels.tolist()):
        ranges = [(*windows(score), best) for (_, score), best in zip(anchors.positives[a], found[a])]
        ranges = [(low, high, best) for low, high, best in ranges if low <= high]
        queue = [(-highest[top][a, 0], top, 0)] if ranges else []
        while queue:
            bound, level, node = heapq.heappop(queue)
            # the lowest score that still counts in each window
            floors = [max(low, -best[-1][0]) if len(best) == NEGATIVES else low for low, _, best in ranges]
            if -bound < min(floors):
                break
            least = lowest[level][a, node]
            if not any(floor <= -bound and least <= high for floor, (_, high, _) in zip(floors, ranges)):
                continue
            if tree.label_low[level][node] == label == tree.label_high[level][node]:
                continue
            first, last = tree.children[level][node]
            if level:
                bounds = highest[level - 1][a, first:last]
                for child in range(first, last):
                    heapq.heappush(queue, (-bounds[child - first], level - 1, child))
                continue
            scores = products(vectors[a:a + 1], tree.vectors[first:last])[0]
            wanted = (scores >= min(floors)) & (scores <= max(high for _, high, _ in ranges)) & (tree.labels[first:last] != label)
            for at in np.flatnonzero(wanted).tolist():
                entry = (-int(scores[at]), int(tree.ids[first + at]))
                for low, high, best in ranges:
                    if low <= -entry[0] <= high and (len(best) < NEGATIVES or entry < best[-1]):
                        insort(best, entry)
                        del best[NEGATIVES:]


def _vectors(column: pa.Array) -> list[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[start:end] for start, end in zip(offsets[:-1], offsets[1:])]


def _stacked(vectors: list[np.ndarray]) -> np.ndarray:
    """One matrix; shorter rows end in zeros."""
    out = np.zeros((len(vectors), max((len(v) for v in vectors), default=0)))
    for row, vector in zip(out, vectors):
        row[:len(vector)] = vector
    return out


def _pack(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Sorted rows into packed pieces; rows whose scaled components are too large are left out."""
    ids, labels, vectors, piece = [], [], [], TaskContext.get().partitionId() << 32

    def packed():
        order = str_order(_stacked(vectors)).tolist()
        return pa.RecordBatch.from_arrays([
            pa.array([piece] * len(order), pa.int64()), pa.array([ids[i] for i in order], pa.int64()),
            pa.array([labels[i] for i in order], pa.int64()),
            pa.array([vectors[i].astype(np.int32).tobytes() for i in order], pa.binary())], ["piece", "id", "label", "vector"])

    for batch in batches:
        for id_, label, vector in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), _vectors(batch.column(2))):
            scaled = np.floor(SCALE * vector.astype(np.float64))
            if np.abs(scaled).max(initial=0) >= LIMIT:
                continue
            ids.append(id_)
            labels.append(label)
            vectors.append(scaled)
            if len(ids) == PIECE:
                yield packed()
                ids, labels, vectors, piece = [], [], [], piece + 1
    if ids:
        yield packed()


def pack(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """``piece, id, label, vector`` of all rows that take part, written in packed order."""
    spark = rows.sparkSession
    known = rows.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("vector")).filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))).distinct()
    keys = ["label", F.get("vector", F.lit(0)), "id", "vector"]
    path = scratch_path(spark, "packed")
    known.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_pack, _PACKED).write.parquet(path)
    return spark.read.schema(_PACKED).parquet(path)


def _trees(batches: Batches) -> Iterator[Tree]:
    """The pieces that a task reads.  A piece that a file split cuts in two makes two trees."""
    rows, piece = [], None

    def tree():
        return Tree(
            np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64),
            _stacked([np.frombuffer(r[2], np.int32) for r in rows]))

    for batch in batches:
        for number, *row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if rows and number != piece:
                yield tree()
                rows = []
            piece = number
            rows.append(row)
    if rows:
        yield tree()


def _positives(block):
    def searched(batches: Batches) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(*block.value)
        found = [[] for _ in anchors.ids]
        for tree in _trees(batches):
            search_positives(tree, anchors, found)
        rows = [(a, id_, -score) for a, best in enumerate(found) for score, id_ in best]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["a", "id", "score"])
    return searched


def _negatives(block):
    def searched(batches: Batches) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(*block.value)
        found = [[[] for _ in own] for own in anchors.positives]
        for tree in _trees(batches):
            search_negatives(tree, anchors, found)
        rows = [
            (a, p, id_, -score) for a, own in enumerate(found) for p, best in enumerate(own) for score, id_ in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["a", "p", "id", "score"])
    return searched


def _first(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first ``n`` of each group by score and id, with their rank; each task has sent at most ``n`` of a group."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def mine(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` is a condition over ``id``; ``label`` the label of a row (default: its column ``label``).  Rank counts the
    negatives of an anchor and positive from 1.
    """
    spark = rows.sparkSession
    packed = pack(rows, id_col, vector_col, F.col("label") if label is None else label)
    numbered = dense_numbers(packed.filter(anchor).select("id", "label", "vector"), "number", start=0)
    anchors_path, result_path = scratch_path(spark, "anchors"), scratch_path(spark, "negatives")
    numbered.withColumn("block", F.expr(f"number div {ANCHORS}")).write.partitionBy("block").parquet(anchors_path)
    anchors = spark.read.schema("id long, label long, vector binary, number long, block long").parquet(anchors_path)
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], result).write.parquet(result_path)
    # blocks of bounded size, one after the other
    for block in range((anchors.agg(F.max("block")).first()[0] or 0) + 1):
        own = anchors.filter(F.col("block") == block).orderBy("number").toArrow()
        if not own.num_rows:
            break
        ids, labels = (own.column(i).to_numpy() for i in (0, 1))
        vectors = _stacked([np.frombuffer(v, np.int32) for v in own.column(2).to_pylist()])
        held = spark.sparkContext.broadcast((ids, labels, vectors))
        best = _first(packed.mapInArrow(_positives(held), "a long, id long, score long"), ["a"], POSITIVES)
        positives = [[] for _ in ids]
        for a, id_, score in zip(*(c.to_pylist() for c in best.orderBy("a", "rank").select("a", "id", "score").toArrow().columns)):
            positives[a].append((id_, score))
        searched = spark.sparkContext.broadcast((ids, labels, vectors, positives))
        negatives = _first(packed.mapInArrow(_negatives(searched), "a long, p long, id long, score long"), ["a", "p"], NEGATIVES)
        # as many rows as anchors and positives: their ids and scores
        pairs = spark.createDataFrame(
            [(a, p, int(ids[a]), id_, score) for a, of in enumerate(positives) for p, (id_, score) in enumerate(of)],
            "a long, p long, anchor_id long, positive_id long, positive_score long")
        negatives.join(F.broadcast(pairs), ["a", "p"]).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score")).write.mode("append").parquet(result_path)
    return spark.read.schema(result).parquet(result_path)
