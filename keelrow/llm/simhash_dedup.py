"""SimHash near-dedup by the generalised pigeonhole principle.

Each text has a 64-bit SimHash over its 3-word shingles; texts whose fingerprints differ in at most
``radius`` bits are linked, and every document gets the smallest id it is connected with.

The bits are grouped into partitions, correlated bits together.  If two fingerprints differ in at
most r bits and the thresholds of m partitions sum up to r - m + 1, they agree in at least one
partition within its threshold.  Dynamic programming deals that sum out unequally (-1 leaves a
partition out) so that probes and estimated candidates cost least; the estimate is the distribution
of distances within each partition over pairs drawn from all fingerprints.  Layouts of 2 to 8
partitions compete (of 4 at most at radius 3), so more documents lead to more probes instead of larger candidate groups.

Copies collapse first: only distinct fingerprints are probed.  Fingerprints that meet under a key are
verified in blocks of bounded size: a group with more members is dealt over all pairs of its blocks,
and each block reports a spanning forest of its links, never all pairs.

:func:`drop_near_duplicates` can verify: then texts, not fingerprints, are linked, over the words' shingles of any width,
and a link counts only if the Jaccard similarity of their shingles reaches the threshold.  The links that the blocks
report are verified first: all in small groups, a spanning forest in larger ones.  Then the blocks of the larger groups
report all pairs within the radius that these have not connected, and those are verified too, so no pair that meets
under a key is left out.

Defined results: null and empty texts have fingerprint zero and link like any other; rows of one id
belong to the classes of their texts; a null id counts after all others and stays null in the result; very long texts
are hashed whole, in pieces; an empty table has no rows; equal distances need no order; in :func:`near_duplicates` other
columns play no role, in :func:`drop_near_duplicates` they stay, and where rows repeat id and text the row with the
smallest hash of all columns stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelrow.llm.common import ID, LAST_ID, TEXT, Batches, in_pieces, longs, shuffle_partitions, utf8
from keelrow.llm.components import components
from keelrow.session import cut_lineage

RADIUS = 3
BITS = 64
SHINGLE = 3
SEED = 42
_LAYOUTS = (2, 3, 4, 5, 6, 7, 8)
# members of a block: least and most
_BLOCK = (256, 4096)
# groups up to this size report all verified pairs, larger ones a spanning forest
_SMALL_GROUP = 16
# partners that each fingerprint is compared with to estimate distances
_PARTNERS = 8
_CHUNK = 1 << 16
# prints that are compared with a whole block at once
_ROWS = 256


def simhash(text: bytes, width: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half the hashes of the shingles."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    columns = [words[i:len(words) - width + 1 + i] for i in range(width)]
    digest, total, sums = xxhash.xxh64_digest, len(columns[0]), np.zeros(BITS, np.int64)
    hashed = [digest(b" ".join(shingle), SEED) for shingle in zip(*columns)]
    for start in range(0, total, _CHUNK):
        part = np.frombuffer(b"".join(hashed[start:start + _CHUNK]), np.uint8).reshape(-1, 8)
        sums += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > total).tobytes(), "big")


def _fingerprints(width: int):
    def printed(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([simhash(text, width) for text in utf8(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints.view(np.int64))], ["__id", "mark", "fp"])
    return printed


def _bits(prints: np.ndarray) -> np.ndarray:
    """Rows of 64 bits, the most significant first."""
    return np.unpackbits(prints.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)


def _together(batches: Batches) -> Iterator[pa.RecordBatch]:
    """How often each two bits are both set, with the number of prints in the last row."""
    both, rows = np.zeros((BITS, BITS)), 0
    for batch in batches:
        bits = _bits(longs(batch.column(0))).astype(np.float32)
        both += bits.T @ bits
        rows += len(bits)
    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(both.ravel(), rows))], ["cell", "n"])


def correlations(prints: DataFrame) -> np.ndarray:
    cells = prints.select("fp").mapInArrow(_together, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(BITS * BITS + 1)
    for row in cells:  # 4,097 rows at any size
        sums[row["cell"]] = row["n"]
    rows, both = max(sums[-1], 1.0), sums[:-1].reshape(BITS, BITS) / max(sums[-1], 1.0)
    mean = np.diag(both) if rows else np.zeros(BITS)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    return np.abs((both - np.outer(mean, mean)) / np.outer(spread, spread))


def grouped_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """Partitions of equal width; each takes the bit most correlated with its own, one after the other."""
    left, groups = set(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        group = [max(left, key=lambda b: (sum(correlation[b, x] for x in left if x != b), -b))]
        left.remove(group[0])
        while len(group) < width:
            best = max(left, key=lambda b: (sum(correlation[b, x] for x in group), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def _distances(masks: Sequence[int]):
    packed = np.array(masks, np.uint64)

    def counted(batches: Batches) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(packed), BITS + 1), np.int64)
        for batch in batches:
            prints = longs(batch.column(0)).view(np.uint64)
            for step in range(1, min(_PARTNERS + 1, len(prints))):
                apart = prints ^ np.roll(prints, step)
                for i, mask in enumerate(packed):
                    counts[i] += np.bincount(np.bitwise_count(apart & mask), minlength=BITS + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(counts.size)), pa.array(counts.ravel())], ["cell", "n"])
    return counted


def _mask(bits: Sequence[int]) -> int:
    return sum(1 << (BITS - 1 - b) for b in bits)


def allocate(widths: Sequence[int], near: Sequence[Sequence[float]], rows: int, radius: int) -> tuple[float, list[int]]:
    """The cheapest thresholds that sum up to ``radius - m + 1``, and their cost in rows touched.

    ``near[i][t]`` is the share of pairs within t bits of each other in partition i.
    """
    m = len(widths)
    best = {0: (0.0, [])}
    for i in range(m):
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, radius + 1):
                probes = sum(math.comb(widths[i], k) for k in range(t + 1))
                more = cost + rows * probes + 0.02 * rows * rows * near[i][t] if t >= 0 else cost
                key = total + t
                if key not in step or more < step[key][0]:
                    step[key] = (more, chosen + [t])
        best = step
    return best[radius - m + 1]


def plan_probes(prints: DataFrame, rows: int, radius: int) -> list[tuple[list[int], int]]:
    """The partitions to probe, as their bits and their thresholds."""
    correlation = correlations(prints)
    layouts = [grouped_bits(correlation, m) for m in _LAYOUTS if m <= radius + 1]
    flat = [bits for layout in layouts for bits in layout]
    cells = (
        prints.select("fp").mapInArrow(_distances([_mask(bits) for bits in flat]), "cell long, n long")
        .groupBy("cell").agg(F.sum("n").alias("n")).collect()
    )
    counts = np.zeros((len(flat), BITS + 1))
    for row in cells:  # 65 rows a partition
        counts[row["cell"] // (BITS + 1), row["cell"] % (BITS + 1)] = row["n"]
    near = (counts.cumsum(axis=1) + 1) / (counts.sum(axis=1, keepdims=True) + 1)
    plans, at = [], 0
    for layout in layouts:
        cost, thresholds = allocate([len(b) for b in layout], near[at:at + len(layout)], rows, radius)
        plans.append((cost, [(bits, t) for bits, t in zip(layout, thresholds) if t >= 0]))
        at += len(layout)
    return min(plans, key=lambda p: p[0])[1]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _keys(plan: list[tuple[list[int], int]]) -> Column:
    """All (partition, key) under which a fingerprint is found: its own bits, and each flip within the threshold."""
    from itertools import combinations
    parts = []
    for i, (bits, threshold) in enumerate(plan):
        own = F.col("fp").bitwiseAND(F.lit(_signed(_mask(bits))))
        for flips in range(threshold + 1):
            for flipped in combinations(bits, flips):
                key = own.bitwiseXOR(F.lit(_signed(_mask(flipped)))) if flips else own
                parts.append(F.struct(F.lit(i).alias("part"), key.alias("key")))
    return F.array(*parts)


def _with_partners(prints: np.ndarray, radius: int) -> np.ndarray:
    """Places of the prints that another one is near to; most have none."""
    near = np.zeros(len(prints), np.int64)
    for start in range(0, len(prints), _ROWS):
        apart = np.bitwise_count(prints[start:start + _ROWS, None] ^ prints[None])
        near[start:start + _ROWS] = (apart <= radius).sum(axis=1)
    return np.flatnonzero(near > 1)


def _forest(prints: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the links within one block."""
    left = _with_partners(prints, radius)
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(prints[left] ^ prints[at]) <= radius
            for other in left[near]:
                yield at, other
            front.extend(left[near])
            left = left[~near]


def _linked_in(columns: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked rows; rows with the same leading columns are one block."""
    *keys, prints = columns
    new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(new)))
    left, right = [], []
    block, size = np.cumsum(new) - 1, sizes[np.cumsum(new) - 1]
    small = np.flatnonzero(size <= _SMALL_GROUP)
    for step in range(1, _SMALL_GROUP):
        if len(small) <= step:
            break
        a, b = small[:-step], small[step:]
        hit = (block[a] == block[b]) & (np.bitwise_count(prints[a] ^ prints[b]) <= radius)
        left.append(a[hit])
        right.append(b[hit])
    for start, n in zip(starts[sizes > _SMALL_GROUP], sizes[sizes > _SMALL_GROUP]):
        pairs = np.array(list(_forest(prints[start:start + n], radius)), np.int64).reshape(-1, 2) + start
        left.append(pairs[:, 0])
        right.append(pairs[:, 1])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _whole_blocks(batches: Batches) -> Iterator[list[np.ndarray]]:
    kept: list[np.ndarray] | None = None  # the last block may go on in the next batch
    for batch in batches:
        columns = [longs(c) for c in batch.columns]
        if not len(columns[0]):
            continue
        if kept is not None:
            columns = [np.concatenate([k, c]) for k, c in zip(kept, columns)]
        same = np.all([c == c[-1] for c in columns[:4]], axis=0)
        last = len(same) - np.argmin(same[::-1]) if not same.all() else 0
        kept = [c[last:] for c in columns]
        if last:
            yield [c[:last] for c in columns]
    if kept is not None:
        yield kept


def _links(radius: int):
    def linked(batches: Batches) -> Iterator[pa.RecordBatch]:
        for columns in _whole_blocks(batches):
            yield from _edges(columns, radius)
    return linked


def _edges(columns: list[np.ndarray], radius: int) -> Iterator[pa.RecordBatch]:
    nodes = columns[5]
    a, b = _linked_in([*columns[:4], columns[4].view(np.uint64)], radius)
    yield from in_pieces({"a": pa.array(nodes[a]), "b": pa.array(nodes[b])})


def _unconnected(radius: int):
    """All pairs within the radius whose nodes have different roots."""
    def paired(batches: Batches) -> Iterator[pa.RecordBatch]:
        for columns in _whole_blocks(batches):
            prints, nodes, roots = columns[4].view(np.uint64), columns[5], columns[6]
            new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in columns[:4]], axis=0), [True]])
            bounds = np.flatnonzero(new)
            for start, end in zip(bounds[:-1], bounds[1:]):
                if (roots[start:end] == roots[start]).all():
                    continue
                for first in range(start, end, _ROWS):
                    rows = slice(first, min(first + _ROWS, end))
                    near = np.bitwise_count(prints[rows, None] ^ prints[None, first:end]) <= radius
                    a, b = np.nonzero(near & (roots[rows, None] != roots[None, first:end]))
                    a, b = a[a < b] + first, b[a < b] + first
                    yield from in_pieces({
                        "a": pa.array(np.minimum(nodes[a], nodes[b])), "b": pa.array(np.maximum(nodes[a], nodes[b]))})
    return paired


def _met(prints: DataFrame, radius: int) -> tuple[list[tuple[list[int], int]], DataFrame, int]:
    """The plan, the groups of several prints (``part, key, size``) and the size of a block."""
    # without rows every plan would cost nothing
    plan = plan_probes(prints, max(prints.count(), 1), radius)
    keyed = prints.select(F.explode(_keys(plan)).alias("k")).select("k.part", "k.key")
    sizes = cut_lineage(keyed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    touched = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return plan, sizes, min(max(_BLOCK[0], touched // (4 * shuffle_partitions(prints))), _BLOCK[1])


def _dealt(prints: DataFrame, plan: list[tuple[list[int], int]], sizes: DataFrame, block: int) -> DataFrame:
    """The prints (``fp, node``, further columns) under each key of ``sizes``, dealt over all pairs of a group's blocks."""
    own = prints.columns
    return (
        prints.select(*own, F.explode(_keys(plan)).alias("k")).select("k.part", "k.key", *own).join(sizes, ["part", "key"])
        .withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("part", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), *own)
        .repartition(shuffle_partitions(prints), "part", "key", "x", "y").sortWithinPartitions("part", "key", "x", "y")
    )


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links between the nodes of distinct fingerprints (``fp, node``) that connect all within the radius."""
    return _dealt(prints, *_met(prints, radius)).mapInArrow(_links(radius), "a long, b long").distinct()


def _mark(text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{text_col}`").cast("string"))


def _prints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    return cut_lineage(docs.select(
        F.col(f"`{id_col}`").cast("long").alias(ID), F.col(f"`{text_col}`").cast("string").alias(TEXT), _mark(text_col).alias("mark"),
    ).mapInArrow(_fingerprints(width), f"{ID} long, mark long, fp long"))


def _rooted(nodes: DataFrame, linked: DataFrame, node: str) -> DataFrame:
    """``node``, the node that stands for its class (``root``) and the class's least id."""
    rooted = cut_lineage(nodes.join(linked.withColumnRenamed("node", "__node"), F.col(node) == F.col("__node"), "left").select(
        node, "first", F.coalesce("component", node).alias("root")))
    least = cut_lineage(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    return cut_lineage(rooted.join(least, "root").select(node, "root", "component_id"))


def _classes(docs: DataFrame, id_col: str, text_col: str, radius: int) -> DataFrame:
    """Each row's id, text hash (``mark``), ``fp``, the fingerprint that stands for its class (``root``) and the class's least id."""
    prints = _prints(docs, id_col, text_col, SHINGLE)
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min(F.coalesce(F.col(ID), F.lit(LAST_ID))).alias("first")))
    linked = components(links(nodes.select("fp", F.col("fp").alias("node")), radius), "a", "b")
    return prints.join(_rooted(nodes, linked, "fp"), "fp")


def _shingle_set(text: bytes, width: int) -> set[bytes]:
    words = text.lower().split()
    if len(words) <= width:
        return {b" ".join(words)}
    return set(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def _alike(width: int, similarity: float):
    def alike(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(utf8(batch.column(2)), utf8(batch.column(3))):
                own, other = _shingle_set(x, width), _shingle_set(y, width)
                shared = len(own & other)
                keep.append(shared >= similarity * (len(own) + len(other) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])
    return alike


def _with_texts(docs: DataFrame, text_col: str, near: DataFrame) -> DataFrame:
    """``a, b`` with their texts ``x, y``; each distinct text that has a link is read once."""
    ends = cut_lineage(near.select(F.col("a").alias("mark")).union(near.select(F.col("b").alias("mark"))).distinct())
    texts = cut_lineage(docs.select(_mark(text_col).alias("mark"), F.col(f"`{text_col}`").cast("string").alias("text")).join(
        ends, "mark", "left_semi").groupBy("mark").agg(F.max("text").alias("text")))
    return near.join(texts.select(F.col("mark").alias("a"), F.col("text").alias("x")), "a").join(
        texts.select(F.col("mark").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")


def _verified_classes(docs: DataFrame, id_col: str, text_col: str, radius: int, width: int, similarity: float) -> DataFrame:
    """As :func:`_classes`, but the nodes are distinct texts (``mark``), and their links are verified."""
    prints = _prints(docs, id_col, text_col, width)
    nodes = cut_lineage(prints.groupBy("mark").agg(
        F.min("fp").alias("fp"), F.min(F.coalesce(F.col(ID), F.lit(LAST_ID))).alias("first")))
    probed = nodes.select("fp", F.col("mark").alias("node"))
    plan, sizes, block = _met(probed, radius)

    def verified(near: DataFrame) -> DataFrame:
        return cut_lineage(_with_texts(docs, text_col, near).mapInArrow(_alike(width, similarity), "a long, b long"))

    near = cut_lineage(_dealt(probed, plan, sizes, block).mapInArrow(_links(radius), "a long, b long").distinct())
    linked = cut_lineage(components(verified(near), "a", "b"))
    # what a forest leaves out: its links need not be alike, and others may be
    rooted = probed.join(linked.select("node", "component"), "node", "left").select(
        "fp", "node", F.coalesce("component", "node").alias("root"))
    large = sizes.filter(F.col("size") > _SMALL_GROUP)
    rest = cut_lineage(_dealt(rooted, plan, large, block).mapInArrow(_unconnected(radius), "a long, b long").distinct().join(
        near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    more = verified(rest)
    if not more.isEmpty():
        linked = components(linked.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), "a", "b")
    return prints.join(_rooted(nodes, linked, "mark"), "mark")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row a document: its id, ``fp`` (signed 64 bits) and ``component_id``."""
    return _classes(docs, id_col, text_col, radius).select(
        F.col(ID).alias(id_col), "fp", F.when(F.col("component_id") != LAST_ID, F.col("component_id")).alias("component_id"))


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = SHINGLE,
    similarity: float | None = None,
) -> DataFrame:
    """One document of each group: the smallest id, of several texts under it that with the least hash.

    With a ``similarity`` links are verified, over shingles of ``width`` words; without one width is that of the fingerprints.
    """
    if similarity is None:
        rows = _classes(docs, id_col, text_col, radius)
    else:
        rows = _verified_classes(docs, id_col, text_col, radius, width, similarity)
    # one row a group; what repeats both id and text counts as one
    chosen = rows.groupBy("root").agg(F.min(F.struct(F.coalesce(F.col(ID), F.lit(LAST_ID)).alias("id"), "mark")).alias("x")).select(
        "x.id", "x.mark", F.lit(True).alias("chosen")).distinct()
    counted = rows.groupBy(F.coalesce(F.col(ID), F.lit(LAST_ID)).alias("id"), "mark").agg(F.count(F.lit(1)).alias("__rows"))
    # most documents stay, so the shorter list is that of those that do not, or not as they are
    listed = cut_lineage(
        counted.join(chosen, ["id", "mark"], "left").filter("chosen IS NULL OR __rows > 1")
        .select(F.col("id").alias("__listed"), F.col("mark").alias("__mark"), F.col("chosen").isNotNull().alias("__once")))
    own = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID))
    same = (own == F.col("__listed")) & (_mark(text_col) == F.col("__mark"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    repeated = docs.join(listed.filter("__once"), same, "left_semi").groupBy(own.alias("__own"), _mark(text_col).alias("__text")).agg(
        F.min_by(F.struct(*columns), F.struct(F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns))).alias("__row")).select("__row.*")
    return docs.join(listed, same, "left_anti").union(repeated)
