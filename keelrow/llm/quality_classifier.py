"""Document quality from a byte-level convolutional network in numpy.

Every byte has an embedding.  Filters slide over the embeddings of ``WIDTH`` bytes, one window starting at each byte of
the whole document.  A chunk is ``2 * BLOCK`` windows and overlaps its neighbours by half; its features are the
rectified maxima of the filters over its windows, and a small dense layer turns them into one logit.  The document's
logit is the smooth minimum of its chunks' (the negative logarithm of the mean of exp(-logit)), so that one chunk of
junk in a long document is not averaged away.  Embeddings, filters and dense layer are trained jointly (Adam); only the
windows that are a chunk's maximum get a gradient.

The sample is bounded: ``MAX_GOOD`` and ``MAX_POOR`` labelled documents of at most ``MAX_CHARS`` characters, those whose
ids have the smallest hashes.  It is collected and fitted on the driver; both classes weigh the same.  Scoring reads
every whole text in the tasks, in slabs of fixed size: embedding and filters become one table for each pair of bytes,
so a window is ``WIDTH / 2`` look-ups.

Defined results: a null or empty text has no windows, all its features are zero, and its score is the network's value
there; a text shorter than a window is padded; repeated rows and equal texts get equal scores; rows without a label or
with a null one are scored like others; where labels of an id differ, the larger counts; a null id is scored, never
learnt from; without labels of both classes every score is 0.5; an empty table stays empty; own columns named ``score``
or ``predicted`` are replaced, all other names stay.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from keelrow.llm.common import ID, ROW, TEXT, Batches, carried, uncarried, utf8
from keelrow.session import cut_lineage

THRESHOLD = 0.7
MAX_GOOD, MAX_POOR = 1_500, 1_500
MAX_CHARS = 20_000
WIDTH, BLOCK, EMBEDDING, FILTERS, HIDDEN = 8, 128, 8, 16, 16
_PAD, _SYMBOLS = 256, 257
# blocks in one slab of scoring, and bytes of short texts that are laid out together
_SLAB, _TOGETHER = 128, 1 << 20
_EPOCHS, _BATCH, _RATE = 8, 32, 0.01
# chunks of one document in one training step; other epochs draw others
_CHUNKS = 40


def n_blocks(size: int) -> int:
    """Blocks in which windows of a text of so many bytes start."""
    return max(1, -(-size // BLOCK))


def padded(text: bytes) -> np.ndarray:
    """Whole blocks that hold the text and the padding that its last window reads."""
    flat = np.full(n_blocks(len(text) + WIDTH - 1) * BLOCK, _PAD, np.int32)
    flat[:len(text)] = np.frombuffer(text, np.uint8)
    return flat


@dataclass
class Network:
    embedding: np.ndarray
    filters: np.ndarray
    offsets: np.ndarray
    dense: np.ndarray
    dense_offsets: np.ndarray
    out: np.ndarray
    out_offset: np.ndarray

    def tables(self) -> np.ndarray:
        """What a byte at each place of a window adds to each filter."""
        return np.einsum("ve,kef->kvf", self.embedding, self.filters).astype(np.float32)

    def chunk_logits(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(features @ self.dense + self.dense_offsets, 0)
        return hidden, hidden @ self.out + self.out_offset


def started(seed: int) -> Network:
    draw = np.random.default_rng(seed)
    network = Network(
        draw.normal(0, 0.5, (_SYMBOLS, EMBEDDING)), draw.normal(0, 0.3, (WIDTH, EMBEDDING, FILTERS)), np.zeros(FILTERS),
        draw.normal(0, 0.35, (FILTERS, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 0.3, HIDDEN), np.zeros(()))
    network.embedding[_PAD] = 0
    return network


def smooth_minimum(logits: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each run of chunks, and the share that each chunk has in its gradient."""
    low = np.minimum.reduceat(logits, starts)
    weights = np.exp(np.repeat(low, sizes) - logits)
    sums = np.add.reduceat(weights, starts)
    return low - np.log(sums / sizes), weights / np.repeat(sums, sizes)


class Scorer:
    """The fitted network with its filters folded into one table for each pair of bytes."""

    def __init__(self, network: Network):
        self.network = network
        single = network.tables()
        self.pairs = [
            (single[k][:, None] + single[k + 1][None]).reshape(_SYMBOLS * _SYMBOLS, FILTERS) for k in range(0, WIDTH, 2)]

    def block_maxima(self, flat: np.ndarray, blocks: int) -> np.ndarray:
        """The filters' maxima over the windows that start in each block; ``flat`` may hold what follows the last block."""
        found = np.empty((blocks, FILTERS), np.float32)
        ahead = np.full(blocks * BLOCK + WIDTH, _PAD, np.int32)
        ahead[:min(len(flat), len(ahead))] = flat[:len(ahead)]
        codes = ahead[:-1] * _SYMBOLS + ahead[1:]
        for at in range(0, blocks, _SLAB):
            start, n = at * BLOCK, min(_SLAB, blocks - at) * BLOCK
            sums = self.pairs[0].take(codes[start:start + n], axis=0)
            for k, table in enumerate(self.pairs[1:], start=1):
                sums += table.take(codes[start + 2 * k:start + 2 * k + n], axis=0)
            # no window starts in the padding
            sums[ahead[start:start + n] == _PAD] = -np.inf
            found[at:at + n // BLOCK] = sums.reshape(-1, BLOCK, FILTERS).max(axis=1)
        return found

    def _maxima(self, texts: Sequence[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """Block maxima of each text; short texts are laid out together, long ones in pieces."""
        waiting, held = [], 0

        def flushed():
            if waiting:
                every = [padded(texts[i]) for i in waiting]
                sizes = [len(flat) // BLOCK for flat in every]
                maxima = self.block_maxima(np.concatenate(every), sum(sizes))
                for i, own in zip(waiting, np.split(maxima, np.cumsum(sizes)[:-1])):
                    # the last block may hold padding only
                    yield i, own[:n_blocks(len(texts[i]))]

        for i, text in enumerate(texts):
            if len(text) > _TOGETHER:
                pieces = []
                for start in range(0, len(text), _TOGETHER):
                    piece = np.frombuffer(text, np.uint8, min(_TOGETHER + WIDTH, len(text) - start), start).astype(np.int32)
                    pieces.append(self.block_maxima(piece, n_blocks(min(_TOGETHER, len(text) - start))))
                yield i, np.concatenate(pieces)
                continue
            waiting.append(i)
            held += len(text)
            if held > _TOGETHER:
                yield from flushed()
                waiting, held = [], 0
        yield from flushed()

    def logits(self, texts: Sequence[bytes]) -> np.ndarray:
        order, chunks = [], []
        for i, blocks in self._maxima(texts):
            order.append(i)
            chunks.append(np.maximum(blocks[:-1], blocks[1:]) if len(blocks) > 1 else blocks)
        if not order:
            return np.zeros(0)
        sizes = np.array([len(c) for c in chunks])
        features = np.maximum(np.concatenate(chunks) + self.network.offsets, 0)
        _, logits = self.network.chunk_logits(features)
        found = np.empty(len(order))
        found[order] = smooth_minimum(logits, np.cumsum(sizes) - sizes, sizes)[0]
        return found


def _chunked(text: bytes) -> np.ndarray:
    """The bytes of each chunk's windows, one row a chunk."""
    flat = padded(text)
    windows = np.concatenate([flat, np.full(BLOCK + WIDTH, _PAD, np.int32)])
    starts = np.arange(0, max(1, n_blocks(len(text)) - 1)) * BLOCK
    return windows[starts[:, None] + np.arange(2 * BLOCK + WIDTH - 1)].astype(np.int16)


def gradients(network: Network, chunks: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, Network]:
    """The weighted cross-entropy of documents given as runs of chunks, and its gradient."""
    starts, n = np.cumsum(sizes) - sizes, 2 * BLOCK
    single = network.tables()
    sums = single[0].take(chunks[:, :n], axis=0)
    for k in range(1, WIDTH):
        sums += single[k].take(chunks[:, k:k + n], axis=0)
    sums[chunks[:, :n] == _PAD] = -np.inf
    at = sums.argmax(axis=1)
    features = np.maximum(np.take_along_axis(sums, at[:, None], 1)[:, 0] + network.offsets, 0)
    hidden, logits = network.chunk_logits(features)
    whole, share = smooth_minimum(logits, starts, sizes)
    signed = np.where(labels == 1, whole, -whole)
    loss = float((weights * np.logaddexp(0, -signed)).sum())
    pull = np.repeat((1 / (1 + np.exp(-whole)) - labels) * weights, sizes) * share
    to_hidden = pull[:, None] * network.out * (hidden > 0)
    to_features = (to_hidden @ network.dense.T) * (features > 0)
    to_tables, own = np.empty((WIDTH, _SYMBOLS, FILTERS)), np.arange(FILTERS)
    for k in range(WIDTH):
        byte = np.take_along_axis(chunks, at + k, 1).astype(np.int64)
        to_tables[k] = np.bincount((byte * FILTERS + own).ravel(), to_features.ravel(), _SYMBOLS * FILTERS).reshape(_SYMBOLS, FILTERS)
    to_embedding = np.einsum("kvf,kef->ve", to_tables, network.filters)
    to_embedding[_PAD] = 0
    return loss, Network(
        to_embedding, np.einsum("ve,kvf->kef", network.embedding, to_tables), to_features.sum(axis=0),
        features.T @ to_hidden, to_hidden.sum(axis=0), hidden.T @ pull, pull.sum())


def fit(rows: Sequence[tuple[int, bytes]], seed: int = 3) -> Network:
    """From (label, text).  Without both classes every output weight is zero, so every score is 0.5."""
    network, draw = started(seed), np.random.default_rng(seed + 1)
    labels = np.array([label for label, _ in rows], float)
    if len(set(labels.tolist())) < 2:
        network.out[:] = 0
        return network
    chunks = [_chunked(text) for _, text in rows]
    balanced = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    values = list(astuple(network))
    means, squares, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for epoch in range(_EPOCHS):
        order = draw.permutation(len(rows))
        rate = _RATE * (1 - 0.8 * epoch / _EPOCHS)
        for own in np.split(order, range(_BATCH, len(order), _BATCH)):
            parts = [
                chunks[i] if len(chunks[i]) <= _CHUNKS else chunks[i][draw.choice(len(chunks[i]), _CHUNKS, replace=False)]
                for i in own]
            sizes = np.array([len(part) for part in parts])
            _, pulls = gradients(Network(*values), np.concatenate(parts), sizes, labels[own], balanced[own] / len(own))
            step += 1
            for i, pull in enumerate(astuple(pulls)):
                means[i] = 0.9 * means[i] + 0.1 * pull
                squares[i] = 0.999 * squares[i] + 0.001 * pull * pull
                values[i] = values[i] - rate * (means[i] / (1 - 0.9 ** step)) / (np.sqrt(squares[i] / (1 - 0.999 ** step)) + 1e-8)
    return Network(*values)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, usable: Column) -> Network:
    """Fit on a bounded sample of labelled documents for which ``usable`` (over ``__id``) holds."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias(ID), F.col(f"`{label_col}`").cast("int").alias("label")).filter(
        F.col(ID).isNotNull() & F.col("label").isin(0, 1) & usable).groupBy(ID).agg(F.max("label").alias("label"))
    order = (F.xxhash64(ID), F.col(ID))
    chosen = cut_lineage(
        known.filter("label = 1").orderBy(*order).limit(MAX_GOOD)
        .union(known.filter("label = 0").orderBy(*order).limit(MAX_POOR)).withColumnRenamed(ID, "__chosen"))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias(ID), F.col(f"`{text_col}`").cast("string").alias(TEXT)).filter(
        F.char_length(TEXT) <= MAX_CHARS).join(F.broadcast(chosen), F.col(ID) == F.col("__chosen"))
    # a sample of bounded size; of repeated rows of one id any one
    rows = texts.groupBy(ID).agg(F.max("label").alias("label"), F.max(TEXT).alias(TEXT)).orderBy(ID).select("label", TEXT).toArrow()
    return fit(list(zip(rows.column(0).to_pylist(), utf8(rows.column(1).combine_chunks()))))


def _scores(model):
    def scored(batches: Batches) -> Iterator[pa.RecordBatch]:
        own = Scorer(Network(*model.value))
        for batch in batches:
            logits = own.logits(utf8(batch.column("__text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("__row"), pa.array(1 / (1 + np.exp(-np.clip(logits, -50, 50))))], ["__row", "score"])
    return scored


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    usable: Column | None = None,
) -> DataFrame:
    """All columns but the text, ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``.

    Labels are learnt only where ``usable``, a condition over ``__id``, holds.
    """
    network = train(docs, labels, id_col, text_col, label_col, F.lit(True) if usable is None else usable)
    model = docs.sparkSession.sparkContext.broadcast(astuple(network))
    rows = carried(docs, id_col, text_col)
    found = rows.select(ROW, TEXT).mapInArrow(_scores(model), StructType([rows.schema[ROW], StructField("score", DoubleType())]))
    return uncarried(found, docs.drop(text_col), text_col, F.lit(None), {
        "score": F.col("score"), "predicted": (F.col("score") >= THRESHOLD).cast("int")})
