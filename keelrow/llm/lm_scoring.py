"""Language-model scores from the subword lattice of an existing vocabulary.

The vocabulary of a public tokenizer gives the pieces and their scores.  A text's ``score`` is the log10 of its
marginal probability: each word's sum over all segmentations into pieces, by forward recursion in log space, and
the vocabulary's end piece.  The vocabulary files at hand hold ranks instead of probabilities; a rank r is read
as a weight of 1 / (r + 10), scaled to sum up to 1 (Zipf's law).  Nothing of that score is fitted to the corpus.

``learnt_score`` is that of the same lattice after it has learnt from the training documents: the weights of the pieces are
fitted by expectation maximisation, over all segmentations of all their distinct words with their counts, and a word
of the training documents has one more way through its lattice, as a whole, with its relative frequency.  The ways
share the mass as Good and Turing estimate it (that of unseen words is the share of words seen once).  Beside them stands
the smoothed unigram score over whole words (base), from counts over all training documents.  The base gives any unseen
word the same tenth of a count, so its values for all words do not sum up to 1 as those of the lattice do.

Every distinct word is segmented once, wherever it occurs.  The commonest words of the corpus
(``HEAD``, a bounded table) are broadcast; documents add these up on the spot and pass on only their other words,
each once, to be joined with the word table.

Defined results: null and empty texts are just the end; bytes that are no UTF-8 are replaced before they
are segmented; a row with a null id is learnt from; rows of one id, and repeated rows, are scored
by themselves; very long texts are read whole; without training documents the base has no counts, the vocabulary's lattice
is the same, and the learnt one is the vocabulary's with an end of its own;
an empty table stays empty; own columns stay in ``__row``, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelrow.llm.common import ID, ROW, TEXT, Batches, carried, in_pieces, utf8
from keelrow.llm.lattice import Pieces, expected_counts, log_probabilities
from keelrow.session import cut_lineage

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
END = "</s>"
HEAD = 100_000
SMOOTHING = 0.1
# rounds of the fit, and the weight of the vocabulary's own weights in it, in pieces
ROUNDS, PRIOR = 2, 10_000.0
_DISTINCT = 500_000
_ROWS_AT_ONCE, _BYTES_AT_ONCE = 100_000, 1 << 25


def vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces and first log probabilities of a tokenizer whose scores are ranks: p falls with 1 / rank."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    ranks = -np.array([model.get_score(i) for i in range(len(pieces))])
    rest = 1.0 / (ranks + 10.0)
    special = np.array([p.startswith("<0x") for p in pieces])
    rest[special] = 1.0 / len(pieces)
    return pieces, np.log(rest / rest.sum())


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def _counted(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Words with their counts in training and in all documents."""
    def rows(learnt: Counter, seen: Counter) -> Iterator[pa.RecordBatch]:
        seen.update(learnt)
        words = list(seen)
        yield from in_pieces({
            "word": pa.array(words, pa.binary()), "c": pa.array([learnt.get(w, 0) for w in words], pa.int64()),
            "n": pa.array([seen[w] for w in words], pa.int64())})

    learnt, seen = Counter(), Counter()
    for batch in batches:
        for text, held_out in zip(utf8(batch.column(0)), batch.column(1).to_pylist()):
            (seen if held_out else learnt).update(_words(text))
            if len(learnt) + len(seen) > _DISTINCT:
                yield from rows(learnt, seen)
                learnt, seen = Counter(), Counter()
    yield from rows(learnt, seen)


def _gathered(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Larger batches: the lattice works on all words of one length at once."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= _ROWS_AT_ONCE or size >= _BYTES_AT_ONCE:
            yield pa.concat_batches(held)
            held, rows, size = [], 0, 0
    if rows:
        yield pa.concat_batches(held)


def _texts(column: pa.Array) -> list[str]:
    return [value.decode("utf-8", "replace") for value in utf8(column)]


def _with_logs(model):
    def scored(batches: Batches) -> Iterator[pa.RecordBatch]:
        numbered, logs, learnt = model.value
        own, fitted = Pieces(numbered, logs), Pieces(numbered, learnt)
        for batch in _gathered(batches):
            words = _texts(batch.column(0))
            columns = [pa.array(log_probabilities(pieces, words) / math.log(10)) for pieces in (own, fitted)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "lp", "fitted"])
    return scored


def _expected(model):
    def expected(batches: Batches) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(*model.value)
        total = np.zeros(len(pieces.logs))
        for batch in _gathered(batches):
            total += expected_counts(pieces, _texts(batch.column(0)), batch.column(1).to_numpy().astype(float))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "x"])
    return expected


def fit(words: DataFrame, pieces: Sequence[str], logs: np.ndarray, ends: int) -> tuple[np.ndarray, float]:
    """Natural logs of the pieces' weights and log10 of the end's, from the training counts of all distinct words."""
    prior, total = np.exp(logs), PRIOR
    learnt = words.filter("c > 0").select("word", "c")
    for _ in range(ROUNDS):
        model = words.sparkSession.sparkContext.broadcast((list(pieces), logs))
        sums = learnt.mapInArrow(_expected(model), "piece long, x double").groupBy("piece").agg(F.sum("x").alias("x")).toArrow()
        counts = np.zeros(len(pieces))
        # at most one row a piece of the vocabulary
        counts[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
        total = counts.sum() + PRIOR
        logs = np.log((counts + PRIOR * prior) / total)
    end = (ends + 1) / (total + ends + 1)
    return logs + math.log1p(-end), math.log10(end)


def _mixed(c: Column, fitted: Column, tokens: int, unseen: float) -> Column:
    """log10 of a word's probability as a whole or by its pieces."""
    both = F.log10((1 - unseen) * c / F.lit(float(max(tokens, 1))) + unseen * F.pow(F.lit(10.0), fitted))
    return F.when(c > 0, both).otherwise(math.log10(unseen) + fitted)


def _commonest(words: DataFrame, most: int) -> DataFrame:
    """The words above the lowest count that at most ``most`` words reach, without sorting them.

    Counts are taken in steps of a sixteenth power of two, so that there are about a thousand at any size.
    """
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((r["step"], r["count"]) for r in words.groupBy(step.alias("step")).count().collect()), reverse=True)
    lowest, total = None, 0
    for at, count in sizes:
        total += count
        if total > most:
            break
        lowest = at
    return words.filter(F.lit(False) if lowest is None else step >= lowest)


def _dealt(head, ends: tuple[bool, float, float, float]):
    def dealt(batches: Batches) -> Iterator[pa.RecordBatch]:
        table = head.value
        for batch in batches:
            columns = {name: [] for name in ("n_tokens", "n_known", "base", "score", "learnt", "words", "times")}
            for text in utf8(batch.column("__text")):
                words = _words(text)
                known, base, score, learnt = int(ends[0]), [ends[1]], [ends[2]], [ends[3]]
                rare, times = [], []
                for word, n in Counter(words).items():
                    got = table.get(word)
                    if got is None:
                        rare.append(word)
                        times.append(n)
                    else:
                        known += n * (got[0] > 0)
                        base.append(n * got[1])
                        score.append(n * got[2])
                        learnt.append(n * got[3])
                row = (len(words) + 1, known, math.fsum(base), math.fsum(score), math.fsum(learnt), rare, times)
                for name, value in zip(columns, row):
                    columns[name].append(value)
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            own = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in own), *(pa.array(v, t) for v, t in zip(columns.values(), types))], [*own, *columns])
    return dealt


def score(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY,
) -> DataFrame:
    """``__id``, ``__row``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and
    ``learnt_score``.

    ``held_out`` (over ``__id``) marks the documents that nothing is learnt from.
    """
    context = docs.sparkSession.sparkContext
    rows = carried(docs, id_col, text_col).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    words = cut_lineage(
        rows.select(TEXT, "held_out").mapInArrow(_counted, "word binary, c long, n long")
        .groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")))
    ends = rows.filter(~F.col("held_out")).count()
    tokens, distinct, once = words.filter("c > 0").agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("c") == 1)).first()
    tokens, distinct = tokens + ends, distinct + (ends > 0)
    unseen = max(once, 1) / (tokens + 1) if tokens else 1.0
    whole = tokens + SMOOTHING * (distinct + 1)
    pieces, logs = vocabulary(path)
    fitted, fitted_end = fit(words, pieces, logs, ends)
    model = context.broadcast((pieces, logs, fitted))
    base = F.log10((F.col("c") + SMOOTHING) / F.lit(whole))
    table = cut_lineage(
        words.mapInArrow(_with_logs(model), "word binary, c long, n long, lp double, fitted double")
        .withColumns({"base": base, "learnt": _mixed(F.col("c"), F.col("fitted"), tokens, unseen)}).drop("fitted"))
    # a bounded table, of any corpus
    common = _commonest(table, HEAD).select("word", "c", "base", "lp", "learnt").toArrow()
    head = context.broadcast({word: values for word, *values in zip(*(common.column(i).to_pylist() for i in range(5)))})
    kinds = T.StructType([rows.schema[ID], rows.schema[ROW], *T.StructType.fromDDL(
        "held_out boolean, n_tokens long, n_known long, base double, score double, learnt double,"
        " words array<binary>, times array<long>").fields])
    end = (
        ends > 0, math.log10((ends + SMOOTHING) / whole), float(logs[pieces.index(END)]) / math.log(10),
        math.log10((1 - unseen) * ends / max(tokens, 1) + unseen * 10 ** fitted_end))
    dealt = cut_lineage(
        rows.select(ID, ROW, "held_out", TEXT).mapInArrow(_dealt(head, end), kinds)
        .withColumn("__rid", F.monotonically_increasing_id()))
    rare = dealt.select("__rid", F.explode(F.arrays_zip("words", "times")).alias("x")).select(
        "__rid", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    more = rare.join(table.select("word", "c", F.col("base").alias("one"), "lp", "learnt"), "word").groupBy("__rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(F.lit(0))).alias("more_known"),
        *(F.sum(F.col("times") * F.col(c)).alias(f"more_{c}") for c in ("one", "lp", "learnt")))

    def total(own: str, other: str) -> Column:
        return F.col(own) + F.coalesce(other, F.lit(0))

    return dealt.join(more, "__rid", "left").select(
        ID, ROW, "held_out", "n_tokens", total("n_known", "more_known").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), total("base", "more_one").alias("base_score"),
        total("score", "more_lp").alias("score"), total("learnt", "more_learnt").alias("learnt_score"))
