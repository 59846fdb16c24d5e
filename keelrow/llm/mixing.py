"""Mixing documents to target domain weights with soft membership.

A linear softmax over hashed words, fitted on a bounded sample of the labelled table, gives each document
posterior probabilities p over the domains.  Then nonnegative rates r (how often a document is to be
used) minimise the squared distance of the expected domain shares, the sum of t r p / T over all
documents, from the targets; t are a document's tokens and T all tokens.  The minimum is found by projected
gradient descent.  The gradient is taken in the metric of the second moments of p over the documents whose rate is
positive (one small matrix), which makes rare domains as quick as common ones, and the step is the best of a fixed
list.  One iteration is one distributed sum of a few numbers for each step size.  A rate is a function of the
posterior and of the steps so far, so nothing but those few numbers a step is kept, and a lost executor costs
only its part of one sum.

The descent ends at the targets (``_TOLERANCE``) or where no step size comes nearer; what is left then is in the column
``target_miss``, the largest distance of a share from its target.

Defined results: null and empty texts have no tokens, the posterior of no evidence, and a rate like
any other; labels without a document, and null labels, are left out; without labels all domains
are equally likely; repeated rows are separate documents (of a labelled id that repeats the classifier learns from one);
an empty table stays empty; a very long text is classified whole, like any other.  Targets are scaled to sum up to 1; a domain
that the targets do not name is not a domain.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelrow.llm.common import ID, ROW, TEXT, Batches, carried, uncarried, utf8, with_row
from keelrow.session import cut_lineage

TARGETS = {"good": 0.9, "poor": 0.07, "toxic": 0.03}
# labelled documents that the classifier is fitted on, at most: those whose ids have the smallest hashes
MAX_LABELLED = 8_000
FEATURES = 1 << 15
_EPOCHS, _BATCH, _RATE = 12, 128, 0.05
_TOLERANCE = 1e-5
# step sizes that compete, and what keeps the metric regular where domains go together
_SIZES = np.array([1.0, 0.5, 0.25, 0.125, 1 / 16, 1 / 64, 1 / 256, 1 / 1024])
_RIDGE = 1e-9


def domain() -> Column:
    """The domain of a labelled row; null if its labels are."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")


def features(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashed words with values of unit length, and the number of words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0), 0
    cells, counts = np.unique(np.array([zlib.crc32(w) for w in words], np.int64) % FEATURES, return_counts=True)
    values = np.log1p(counts)
    return cells, values / np.sqrt((values * values).sum()), len(words)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: Sequence[tuple[int, np.ndarray, np.ndarray]], classes: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases from (class, cells, values) by Adam."""
    weights, bias = np.zeros((FEATURES, classes)), np.zeros(classes)
    if not rows:
        return weights, bias
    random = np.random.default_rng(seed)
    moments = [np.zeros_like(x) for x in (weights, weights, bias, bias)]
    step = 0
    for _ in range(_EPOCHS):
        order = random.permutation(len(rows))
        for start in range(0, len(order), _BATCH):
            batch = [rows[i] for i in order[start:start + _BATCH]]
            cells = np.concatenate([b[1] for b in batch])
            values = np.concatenate([b[2] for b in batch])
            owner = np.repeat(np.arange(len(batch)), [len(b[1]) for b in batch])
            logits = np.stack([
                np.bincount(owner, weights[cells, k] * values, minlength=len(batch)) for k in range(classes)], axis=1) + bias
            error = softmax(logits)
            error[np.arange(len(batch)), [b[0] for b in batch]] -= 1
            error /= len(batch)
            grad = np.stack([np.bincount(cells, error[owner, k] * values, minlength=FEATURES) for k in range(classes)], axis=1)
            grad += 1e-6 * weights
            step += 1
            for x, g, m, v in ((weights, grad, *moments[:2]), (bias, error.sum(axis=0), *moments[2:])):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                x -= _RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return weights, bias


def _hashed(batches: Batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(text) for text in utf8(batch.column(1))]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())),
            pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32())),
        ], ["domain", "cells", "values"])


@dataclass(frozen=True)
class Classifier:
    """Posterior probabilities of the domains, in the order of ``domains``."""

    domains: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray

    def posterior(self, text: bytes) -> tuple[np.ndarray, int]:
        cells, values, n = features(text)
        return softmax(values @ self.weights[cells] + self.bias), n


def train(
    docs: DataFrame, labels: DataFrame, domains: Sequence[str], id_col: str = "doc_id", text_col: str = "text",
    label: Column | None = None, max_labelled: int = MAX_LABELLED,
) -> Classifier:
    known = labels.select(F.col(id_col).cast("long").alias("__labelled"), (domain() if label is None else label).alias("domain"))
    chosen = cut_lineage(
        known.filter(F.col("__labelled").isNotNull() & F.col("domain").isin(*domains))
        .groupBy("__labelled").agg(F.min("domain").alias("domain"))
        .orderBy(F.xxhash64("__labelled"), "__labelled").limit(max_labelled)
    )
    texts = docs.join(F.broadcast(chosen), F.col(f"`{id_col}`").cast("long") == F.col("__labelled")).select(
        "__labelled", "domain", F.col(f"`{text_col}`").cast("string").alias(TEXT))
    # one row a label, however often its id repeats
    texts = texts.groupBy("__labelled").agg(F.max("domain").alias("domain"), F.max(TEXT).alias(TEXT)).select("domain", TEXT)
    rows = texts.mapInArrow(_hashed, "domain string, cells array<int>, values array<float>").toArrow()
    number = {name: i for i, name in enumerate(domains)}
    found = sorted(  # of at most max_labelled documents; in an order that does not depend on the partitions
        ((number[d.as_py()], c.values.to_numpy().astype(np.int64), v.values.to_numpy().astype(np.float64))
         for d, c, v in zip(rows.column(0), rows.column(1), rows.column(2))),
        key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    return Classifier(tuple(domains), *fit(found, len(domains)))


@dataclass(frozen=True)
class Mixture:
    """Rates as a function of the posterior: all steps of the descent, replayed."""

    steps: np.ndarray
    miss: float = 0.0

    def rates(self, posterior: np.ndarray) -> np.ndarray:
        rate = np.ones(len(posterior))
        for step in self.steps:
            rate = np.maximum(0.0, rate - posterior @ step)
        return rate


def _memberships(model) -> object:
    def member(batches: Batches) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(*model.value)
        for batch in batches:
            rows = [classifier.posterior(text) for text in utf8(batch.column("__text"))]
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in batch.schema.names if c != "__text"),
                pa.array([r[1] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.list_(pa.float64())),
            ], [*(c for c in batch.schema.names if c != "__text"), "n_tokens", "posterior"])
    return member


def _sums(mixture: Mixture, moves: np.ndarray):
    """Of one task, for each move from the rates so far: the sum of t r p, and of t p p' where r > 0, as cells."""
    def summed(batches: Batches) -> Iterator[pa.RecordBatch]:
        classes = moves.shape[1]
        total = np.zeros((len(moves), classes + classes * classes))
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = batch.column(0).to_numpy().astype(np.float64)
            posterior = batch.column(1).values.to_numpy().reshape(-1, classes)
            rate = mixture.rates(posterior)
            for row, move in zip(total, moves):
                moved = np.maximum(0.0, rate - posterior @ move)
                row[:classes] += (tokens * moved) @ posterior
                row[classes:] += ((posterior * (tokens * (moved > 0))[:, None]).T @ posterior).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "x"])
    return summed


def _tried(memberships: DataFrame, mixture: Mixture, moves: np.ndarray, tokens: float) -> tuple[np.ndarray, np.ndarray]:
    """The shares that each move would reach, and the second moments over the documents that would keep a rate."""
    classes = moves.shape[1]
    cells = memberships.select("n_tokens", "posterior").mapInArrow(_sums(mixture, moves), "cell long, x double")
    out = np.zeros(len(moves) * (classes + classes * classes))
    for row in cells.groupBy("cell").agg(F.sum("x").alias("x")).collect():  # a few numbers for each move
        out[row["cell"]] = row["x"] / tokens
    out = out.reshape(len(moves), -1)
    return out[:, :classes], out[:, classes:].reshape(-1, classes, classes)


def solve(memberships: DataFrame, shares: np.ndarray) -> Mixture:
    """The mixture for rows of ``n_tokens, posterior``."""
    classes = len(shares)
    tokens = float(memberships.agg(F.sum("n_tokens")).first()[0] or 0)
    mixture = Mixture(np.zeros((0, classes)))
    if not tokens:
        return mixture
    reached, moments = _tried(memberships, mixture, np.zeros((1, classes)), tokens)
    residual, second = reached[0] - shares, moments[0]
    while np.abs(residual).max() > _TOLERANCE:
        step = np.linalg.solve(second + _RIDGE * max(np.trace(second), 1e-12) * np.eye(classes), residual)
        moves = _SIZES[:, None] * step
        reached, moments = _tried(memberships, mixture, moves, tokens)
        distances = ((reached - shares) ** 2).sum(axis=1)
        best = int(distances.argmin())
        # every step comes nearer by a share of the distance, so their number is bounded
        if not distances[best] < (1 - 1e-4) * (residual @ residual):
            break
        mixture = Mixture(np.vstack([mixture.steps, moves[best]]))
        residual, second = reached[best] - shares, moments[best]
    return Mixture(mixture.steps, float(np.abs(residual).max()))


def _rated(mixture: Mixture, classes: int):
    def rated(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            posterior = batch.column("posterior").values.to_numpy().reshape(-1, classes)
            rate = mixture.rates(posterior) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], [*batch.schema.names, "rate"])
    return rated


def mix(
    docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, id_col: str = "doc_id",
    text_col: str = "text", label: Column | None = None, max_labelled: int = MAX_LABELLED, with_text: bool = True,
) -> DataFrame:
    """The documents with ``n_tokens``, ``posterior`` (by sorted domain), ``rate``, ``copies`` and ``target_miss``.

    ``copies`` is the rate rounded up or down by a hash of the row, so that its mean is the rate.
    Every document is classified once; its text is written along with that only ``with_text``
    (else the text column is null).
    """
    domains = sorted(targets)
    shares = np.array([targets[d] for d in domains], float)
    shares = shares / shares.sum()
    classes = len(domains)
    fitted = train(docs, labels, domains, id_col, text_col, label, max_labelled)
    model = docs.sparkSession.sparkContext.broadcast((fitted.domains, fitted.weights, fitted.bias))
    rows = carried(docs, id_col, text_col)
    kept = with_row(rows, "text string, mark long, n_tokens long, posterior array<double>")
    read = rows.select(
        TEXT, ROW, (F.col(TEXT) if with_text else F.lit(None).cast("string")).alias("text"), F.xxhash64(ID, TEXT).alias("mark"))
    known = cut_lineage(read.mapInArrow(_memberships(model), kept))
    mixture = solve(known, shares)
    rated = known.mapInArrow(
        _rated(mixture, classes), with_row(rows, "text string, mark long, n_tokens long, posterior array<double>, rate double"))
    whole = F.floor("rate")
    chance = F.pmod("mark", F.lit(1_000_003)) / 1_000_003
    copies = (whole + (chance < F.col("rate") - whole).cast("long")).cast("long")
    return uncarried(rated, docs, text_col, F.col("text"), {
        "n_tokens": F.col("n_tokens"), "posterior": F.col("posterior"), "rate": F.col("rate"), "copies": copies,
        "target_miss": F.lit(mixture.miss)})
