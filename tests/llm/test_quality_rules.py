"""Quality rules: counts by a plain reading, tails by exact fractions, certificates on labelled rows."""

import math
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from keelrow.llm import quality_rules as q

SCHEMA = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    full = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(covered))


def judged(spark, rows, labels=(), **options):
    return q.judge(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(list(labels), LABELS), **options)


def test_counts(spark):
    random.seed(1)
    eight = "one two three four five six seven eight"
    texts = [
        None, "", " \t\n", "word", f"{eight} {eight}", f"{eight} nine {eight}", f"{eight}", "a " * 40, "é è ü #*$ %&|<>",
        "same\nsame\n \n \nsame\nother", "a\x0bb\x0cc\rd\te\x1cf", f"{eight} x {eight[4:]} one {eight}",
        " ".join(random.choices("ab", k=400)), "long " + "w" * 100_000 + "\n" + "tail " * 3000,
    ]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(0, "a row of the same id", None)]
    got = sorted((tuple(r) for r in judged(spark, rows).select(
        F.col("__id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()))
    expected = []
    for i, t, _ in rows:
        counts = by_hand(t)
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        expected.append((i, *counts, failed, not failed))
    assert got == sorted(expected)


@pytest.mark.parametrize("n,k,p", [(10, 0, 0.1), (100, 3, 0.05), (2000, 15, 0.01), (50_000, 400, 0.01), (700, 0, 0.01)])
def test_tail_is_exact(spark, n, k, p):
    exact, share = Fraction(0), Fraction(p)
    if n <= 2000:
        exact = float(sum(math.comb(n, j) * share ** j * (1 - share) ** (n - j) for j in range(k + 1)))
    else:
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p)
                             + (n - j) * math.log1p(-p)) for j in range(k + 1))
    df = spark.createDataFrame([(n, k)], "n long, k long")
    assert df.select(q._tail(F.col("n"), F.col("k"), p)).first()[0] == pytest.approx(exact, rel=1e-7)


def test_cutoffs_hold_the_risk(spark):
    """Junk is found where labels certify it; a stratum with few labels, or one where the good look bad, is left alone."""
    words = [f"word{i}" for i in range(3000)]
    random.seed(2)

    def text(junk):
        return " ".join(w + ("###" if junk else "") for w in random.sample(words, 30))

    rows, labels = [], []
    for i in range(4000):
        lang = ("en", "de", "few")[0 if i < 2000 else 1 if i < 3990 else 2]
        # in "de" good documents look like junk too
        junk = i % 10 == 0 or lang == "de" and i % 10 == 1
        rows.append((i, text(junk), lang))
        labels.append((i, int(i % 10 != 0), 0))
    got = {r["__id"]: (r["kept"], r["failed_rules"]) for r in judged(spark, rows, labels).collect()}
    for i, _, lang in rows:
        assert got[i][0] == (lang != "en" or i % 10 != 0), (i, got[i])
    assert got[0][1] == "symbols"


def test_labels_with_nulls_and_repeats(spark):
    rows = [(1, "word " * 5, None), (None, None, None)]
    labels = [(1, None, 0), (1, 1, None), (1, 0, 0), (None, 1, 1), (99, 0, 0)]
    got = judged(spark, rows, labels).select("__id", "kept").collect()
    assert sorted((r[0] or 0, r[1]) for r in got) == [(0, False), (1, False)]


def test_empty_table_and_clashing_columns(spark):
    assert judged(spark, []).collect() == []
    text = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(1, text, "en", "a", 3), (2, "few words", "en", "b", 4)], SCHEMA + ", stratum string, n_words int")
    left = q.keep_good(df, spark.createDataFrame([], LABELS))
    assert left.columns == df.columns
    assert [tuple(r) for r in left.collect()] == [(1, text, "en", "a", 3)]


def test_plan_has_no_python(spark, sf_dir):
    import __spark_entry__ as entry
    plan = entry.queries()["op1_quality_rules"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
