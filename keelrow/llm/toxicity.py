"""Toxicity from averaged subword embeddings with a linear softmax on top, trained jointly in numpy.

Texts are cut into passages of a few words.  A passage is the average of the embeddings of the character
n-grams of its words (3 to 6 bytes with the word's ends), so a misspelling shares most n-grams
with the word it stands for.  A linear softmax over the two classes scores the passage; the document's
score is that of its most toxic passage, so a few words in a long text are not averaged away.
Only documents are labelled: training starts with all passages of a document and narrows down to its
highest-scoring ones, with embeddings and softmax updated together (Adagrad).

The sample is bounded: ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled documents of at most ``MAX_CHARS`` characters,
those whose ids have the smallest hashes.  It is collected and fitted on the driver.  Scoring reads every whole
text in the tasks; a passage needs one number for each n-gram cell, the product of embedding and softmax.

Defined results: null and empty texts get the score of no evidence, below the threshold; unlabelled and
null-labelled rows are scored like others; without labels of both classes every score is 0.5 or less;
repeated rows and equal texts get equal scores; a null id is scored, never learnt from; where labels of an id differ the
larger counts; very long texts are scored in pieces; own columns named ``score`` or ``predicted`` are replaced, all other
names stay; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelrow.llm.common import ID, ROW, TEXT, Batches, carried, uncarried, utf8, with_row
from keelrow.session import cut_lineage

THRESHOLD = 0.7
MAX_TOXIC, MAX_CLEAN = 1_500, 2_500
MAX_CHARS = 20_000
PASSAGE = 12
CELL_BITS, DIMENSIONS = 17, 8
CELLS = 1 << CELL_BITS
NGRAMS = (3, 4, 5, 6)
# a passage with fewer n-grams counts as having so many
LEAST = 100
_EPOCHS, _RATE, _TOGETHER = 8, 0.5, 32
# where the threshold lies between the samples, from clean to toxic
_BETWEEN = 0.12
_PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _spaced(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """The words with single spaces around them, the first byte of each passage, and the number of passages.

    A word that is repeated at once counts once.
    """
    words = [word for word, _ in groupby(text.lower().split())]
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    # a passage starts at the space before its first word
    starts = np.flatnonzero(data == 32)[:-1:PASSAGE]
    return data, starts, len(starts) if words else 0


def _grams(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: the cell of the n-gram at each byte, and whether it lies within one word and its ends."""
    space, wide = data == 32, data.astype(np.uint64)
    code, across = np.zeros(len(data), np.uint64), np.zeros(len(data), bool)
    for k in range(min(NGRAMS[-1], len(data))):
        length = len(data) - k
        code = code[:length] * np.uint64(0x100000001B3) + wide[k:]
        across = across[:length] | space[k - 1:k - 1 + length] if k >= 2 else across[:length]
        if k + 1 >= NGRAMS[0]:
            mixed = (code + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            yield (mixed >> np.uint64(64 - CELL_BITS)).astype(np.int64), ~across


def passages(text: bytes) -> list[np.ndarray]:
    """The cells of all n-grams of each passage."""
    data, starts, n = _spaced(text)
    if not n:
        return []
    cells, places = [], []
    for found, within in _grams(data):
        at = np.flatnonzero(within)
        cells.append(found[at].astype(np.int32))
        places.append(at)
    place = np.concatenate(places)
    order = np.argsort(place, kind="stable")
    return np.split(np.concatenate(cells)[order], np.searchsorted(place[order], starts[1:]))


@dataclass(frozen=True)
class Model:
    """One number for each cell (embedding times softmax weights of toxic over clean) and the bias."""

    cells: np.ndarray
    bias: float

    def logits(self, text: bytes) -> float:
        """The logit of the most toxic passage; without words, that of the bias, zero at most."""
        best = -np.inf
        for piece in _pieces(text):
            data, starts, n = _spaced(piece)
            if not n:
                continue
            sums, sizes = np.zeros(len(data)), np.zeros(len(data))
            for cells, within in _grams(data):
                sums[:len(cells)] += self.cells[cells] * within
                sizes[:len(cells)] += within
            # the last byte is a space and starts nothing
            means = np.add.reduceat(sums, starts) / np.maximum(np.add.reduceat(sizes, starts), LEAST)
            best = max(best, float(means.max()) + self.bias)
        return best if best > -np.inf else min(self.bias, 0.0)


def _pieces(text: bytes) -> Iterator[bytes]:
    """A very long text in pieces that end at white space, so that memory does not grow with it."""
    start = 0
    while len(text) - start > _PIECE:
        end = start + _PIECE
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def fit(rows: Sequence[tuple[int, bytes]], seed: int = 7) -> Model:
    """From (toxic, text); both classes must occur."""
    if len({label for label, _ in rows}) < 2:
        return Model(np.zeros(CELLS, np.float32), -1.0)
    random = np.random.default_rng(seed)
    softmax = random.normal(0, 1, DIMENSIONS)
    embedding = np.zeros((CELLS, DIMENSIONS))
    squares, softmax_squares, bias_square = np.full(CELLS, 1e-6), np.full(DIMENSIONS, 1e-6), 1e-6
    bias, value, softmax_pull = 0.0, np.zeros(CELLS), np.zeros(DIMENSIONS)
    cut = []
    for label, text in rows:
        parts = passages(text)
        if parts:
            sizes = np.array([len(p) for p in parts])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            cut.append((label, np.concatenate(parts), starts, sizes, 1.0 / np.maximum(sizes, LEAST)))
    for epoch in range(_EPOCHS):
        # all passages of a toxic document, then fewer, then the highest-scoring one; of a clean one the highest tenth
        wide = max(0.0, 1.0 - epoch / 2)
        for done, i in enumerate(random.permutation(len(cut))):
            label, cells, starts, sizes, inverse = cut[i]
            n = len(starts)
            logits = np.add.reduceat(value[cells], starts) * inverse + bias
            k = max(1, round((wide if label else max(wide, 0.1)) * n))
            chosen = np.argpartition(logits, n - k)[n - k:] if k < n else np.arange(n)
            errors = (1 / (1 + np.exp(-np.clip(logits[chosen], -30, 30))) - label) / (k if label else k ** 0.5)
            own = np.concatenate([cells[starts[c]:starts[c] + sizes[c]] for c in chosen])
            at, which = np.unique(own, return_inverse=True)
            pull = np.bincount(which, np.repeat(errors * inverse[chosen], sizes[chosen]))
            softmax_pull += pull @ embedding[at]
            squares[at] += pull * pull
            norm = np.linalg.norm(softmax)
            step = _RATE * pull / np.sqrt(squares[at])
            embedding[at] -= step[:, None] * (softmax / norm)
            value[at] -= step * norm
            bias_square += errors.sum() ** 2
            bias -= 0.1 * errors.sum() / np.sqrt(bias_square)
            if done % _TOGETHER == 0:
                softmax_squares += softmax_pull ** 2
                softmax -= 0.05 * softmax_pull / np.sqrt(softmax_squares)
                value, softmax_pull = embedding @ softmax, np.zeros(DIMENSIONS)
    model = Model((embedding @ softmax).astype(np.float32), float(bias))
    return _placed(model, rows)


def _placed(model: Model, rows: Sequence[tuple[int, bytes]]) -> Model:
    """With the bias at which the threshold lies between the clean and the toxic sample.

    Toxic texts outside the sample score lower than those in it, clean ones hardly higher.
    """
    clean = np.quantile([model.logits(text) for label, text in rows if not label], 0.999)
    toxic = np.quantile([model.logits(text) for label, text in rows if label], 0.5)
    if toxic <= clean:
        return model
    return Model(model.cells, model.bias + np.log(THRESHOLD / (1 - THRESHOLD)) - (clean + _BETWEEN * (toxic - clean)))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, usable: Column) -> Model:
    """Fit on a bounded sample of labelled documents for which ``usable`` (over ``__id``) holds."""
    known = labels.select(F.col(id_col).cast("long").alias(ID), F.col(label_col).cast("int").alias("label")).filter(
        F.col(ID).isNotNull() & F.col("label").isin(0, 1) & usable).groupBy(ID).agg(F.max("label").alias("label"))
    order = (F.xxhash64(ID), F.col(ID))
    chosen = cut_lineage(
        known.filter("label = 1").orderBy(*order).limit(MAX_TOXIC)
        .union(known.filter("label = 0").orderBy(*order).limit(MAX_CLEAN)).withColumnRenamed(ID, "__chosen"))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias(ID), F.col(f"`{text_col}`").cast("string").alias(TEXT)).filter(
        F.char_length(TEXT) <= MAX_CHARS).join(F.broadcast(chosen), F.col(ID) == F.col("__chosen"))
    # a sample of bounded size; of repeated rows of one id any one
    rows = texts.groupBy(ID).agg(F.max("label").alias("label"), F.max(TEXT).alias(TEXT)).orderBy(ID).select("label", TEXT).toArrow()
    return fit(list(zip(rows.column(0).to_pylist(), utf8(rows.column(1).combine_chunks()))))


def _scores(model):
    def scored(batches: Batches) -> Iterator[pa.RecordBatch]:
        own = Model(*model.value)
        for batch in batches:
            logits = np.array([own.logits(text) for text in utf8(batch.column("__text"))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("__row"), pa.array(1 / (1 + np.exp(-np.clip(logits, -50, 50))))], ["__row", "score"])
    return scored


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    usable: Column | None = None,
) -> DataFrame:
    """All columns but the text, ``score`` and ``predicted``.  Labels are learnt only where ``usable`` holds."""
    fitted = train(docs, labels, id_col, text_col, label_col, F.lit(True) if usable is None else usable)
    model = docs.sparkSession.sparkContext.broadcast((fitted.cells, fitted.bias))
    rows = carried(docs, id_col, text_col)
    found = rows.select(ROW, TEXT).mapInArrow(_scores(model), with_row(rows, "score double"))
    return uncarried(found, docs.drop(text_col), text_col, F.lit(None), {
        "score": F.col("score"), "predicted": (F.col("score") >= THRESHOLD).cast("int")})
