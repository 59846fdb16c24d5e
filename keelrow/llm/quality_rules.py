"""Quality rules whose cutoffs are certified on labelled documents.

Every document gets a few shares (symbols, capitals, repeated lines, repeated 8-word windows).  For
each stratum, rule and cutoff of a fixed grid the labelled documents say how many good ones the
cutoff would reject.  The exact binomial tail P(X <= k), X ~ Bin(n, risk), tests whether the true
share of good documents that it rejects can still be above the rule's risk.  Cutoffs whose tail is at most
``delta`` over the number of all tests (Bonferroni over strata, rules and cutoffs) are certified: with
probability 1 - delta no certified cutoff rejects more.  ``risk`` is dealt evenly over the rules, so
what the rules reject together stays below it in every stratum.  Of the certified cutoffs a rule takes
the one with the most bad less good labelled documents rejected, if that is positive; of equal ones the
mildest.  A stratum with too few labels certifies nothing and rejects nothing.

Only DataFrame functions are used.  Texts are read once; the rest works on a written table of counts.

Defined results: null and empty texts have no words (and fail the base rules); a null stratum is a
stratum of its own; labels without a document, and null qualities, are left out; a document
labelled twice counts as good if one label says so, which can only make the cutoffs milder; each of
several rows of one id is judged by itself; without documents the result is empty.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelrow.llm.common import ID, ROW, TEXT, carried, uncarried
from keelrow.session import cut_lineage

WINDOW = 8
RISK = 0.05
DELTA = 0.05
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# White space between words, and the signs that count as symbols
SPACE = " \t\n\u000b\u000c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
NOT_SYMBOLS = r"[^#*$%&|<>]+"
# cutoffs of each rule, chosen before any label is seen
GRID = tuple(i / 40 for i in range(1, 33))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")
RULES: dict[str, Callable[[], Column]] = {
    "symbols": lambda: _share("n_symbols", "word_chars"),
    "capitals": lambda: _share("n_capitals", "word_chars"),
    "marks": lambda: _share("n_marks", "word_chars"),
    "dup_lines": lambda: _share("n_dup_lines", "n_lines"),
    "repeat_words": lambda: _share("n_repeat_words", "n_words"),
}


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, also where the body uses it many times."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS))


def _repeats_by_position(words: Column, hashes: Column, width: int) -> Column:
    """Words within windows that occur at least twice; windows are compared by their 64-bit hashes."""
    def covered(starts: Column) -> Column:
        last = F.size(starts) - 1
        return F.aggregate(
            F.transform(starts, lambda x, i: F.when(i == last, F.lit(width)).otherwise(F.least(F.lit(width), F.get(starts, i + 1) - x))),
            F.lit(0), lambda total, x: total + x)

    def twice(ordered: Column) -> Column:
        same = F.filter(ordered, lambda x, i: F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False)))
        return bound(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    return bound(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), twice)


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    n = F.size(words)
    hashes = F.when(n > width, F.transform(
        F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width))))
    return F.coalesce(bound(hashes, lambda h: F.when(
        F.size(F.array_distinct(h)) < F.size(h), _repeats_by_position(words, h, width)).otherwise(F.lit(0))), F.lit(0))


def _counts(words: Column, lines: Column, text: Column) -> Column:
    full = F.filter(lines, lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(text, NOT_SYMBOLS, "")).cast("long").alias("n_symbols"),
        bound(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(words).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.char_length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        F.char_length(F.regexp_replace(text, "[^!]+", "")).cast("long").alias("n_marks"),
    )


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, the row's other columns and the counts of the rules, read from the whole texts."""
    text = F.coalesce(F.col(TEXT), F.lit(""))
    # the structs bind the arrays, so each is made once a row
    found = bound(
        F.struct(words_of(text).alias("w"), F.split(text, "\n", -1).alias("l"), text.alias("t")),
        lambda x: _counts(x["w"], x["l"], x["t"]))
    return carried(docs, id_col, text_col).select(ID, ROW, TEXT, found.alias("c")).select(
        ID, ROW, TEXT, *(F.col("c")[c].alias(c) for c in COUNTS))


def _tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) of a binomial for k below its mean, where each term is larger than the one before."""
    first = F.struct((n * math.log1p(-p)).alias("t"), F.lit(1.0).alias("s"))

    def step(at: Column, j: Column) -> Column:
        grow = F.log((n - j + 1) / j * (p / (1 - p)))
        return F.struct((at["t"] + grow).alias("t"), (at["s"] * F.exp(-grow) + 1.0).alias("s"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(steps, first, step, lambda at: F.exp(at["t"]) * at["s"])


def cutoffs(labelled: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``stratum, rule, cutoff`` from rows of ``stratum, good`` and the counts."""
    each_risk = risk / len(RULES)
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), share().alias("share")) for name, share in RULES.items()))
    # how many cutoffs of the grid are below the share: all of them would reject the document
    below = sum(((F.col("r.share") > cut).cast("int") for cut in GRID), F.lit(0))
    bins = (
        labelled.select("stratum", "good", F.explode(rules).alias("r"))
        .groupBy("stratum", F.col("r.rule").alias("rule"), below.alias("below"))
        .agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
    )
    # every cutoff of the grid, also those that no document reaches
    whole = bins.select("stratum", "rule").distinct().select(
        "stratum", "rule", F.explode(F.sequence(F.lit(0), F.lit(len(GRID)))).alias("below"))
    filled = (
        bins.select("stratum", "rule", "below", "good", "bad")
        .union(whole.select("stratum", "rule", "below", F.lit(0).cast("long"), F.lit(0).cast("long")))
        .groupBy("stratum", "rule", "below").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    )
    # one row for each cutoff of the grid
    rule = Window.partitionBy("stratum", "rule")
    above = rule.orderBy(F.col("below").desc())
    counts = filled.select(
        "stratum", "rule", "below", F.sum("good").over(rule).alias("n"), F.sum("good").over(above).alias("k"),
        F.sum("bad").over(above).alias("bad"),
    ).filter("below > 0")
    tests = cut_lineage(counts)
    n_tests = max(tests.count(), 1)
    passed = tests.filter(F.col("k") < F.col("n") * each_risk).filter(
        _tail(F.col("n"), F.col("k"), each_risk) <= delta / n_tests).filter("bad > k")
    best = passed.groupBy("stratum", "rule").agg(F.max(F.struct(F.col("bad") - F.col("k"), "below")).alias("best"))
    grid = F.array(*(F.lit(cut) for cut in GRID))
    return best.select("stratum", "rule", F.get(grid, F.col("best.below") - 1).alias("cutoff"))


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
    quality_col: str = "quality", risk: float = RISK, delta: float = DELTA, with_text: bool = False,
) -> DataFrame:
    """``__id``, ``__row``, the counts, ``base_failed``, ``kept`` and ``failed_rules`` of every row.

    The counts are written once; ``with_text`` writes the text with them and returns it as ``__text``.
    """
    text = [TEXT] if with_text else []
    counts = cut_lineage(counted(docs, id_col, text_col).select(ID, ROW, *text, *COUNTS)).withColumn(
        "stratum", F.coalesce(F.col(ROW).getField(stratum_col).cast("string"), F.lit("")))
    marked = labels.filter(F.col(quality_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).cast("long").alias("__labelled")).agg((F.max(quality_col) > 0).alias("good"))
    labelled = counts.join(marked, F.col(ID) == F.col("__labelled")).select("stratum", "good", *COUNTS)
    chosen = cut_lineage(
        cutoffs(labelled, risk, delta).groupBy("stratum")
        .agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    )
    failed = F.filter(F.array(*(
        F.when(share() > F.element_at("cutoffs", F.lit(name)), F.lit(name)) for name, share in RULES.items()
    )), lambda x: x.isNotNull())
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counts.join(chosen, "stratum", "left").select(
        ID, ROW, *text, *COUNTS, base_failed.alias("base_failed"),
        (~base_failed & (F.coalesce(F.size(failed), F.lit(0)) <= 0)).alias("kept"),
        F.coalesce(F.array_join(failed, ","), F.lit("")).alias("failed_rules"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    judged = judge(docs, labels, id_col, text_col, with_text=True, **options).filter("kept")
    return uncarried(judged, docs, text_col, F.col(TEXT), {})
