"""Models: lattice sums against all segmentations, base scores, mixing against its targets, held-out accuracy."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelrow.llm import lattice, lm_scoring, mixing, toxicity

SCHEMA = "doc_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


def all_segmentations(pieces, logs, word):
    """Sum over all ways to cut the word into pieces."""
    number = {p: i for i, p in enumerate(pieces)}
    text, total = lattice.START + word, 0.0
    for cuts in itertools.product([False, True], repeat=len(text) - 1):
        parts, start = [], 0
        for i, cut in enumerate([*cuts, True], start=1):
            if cut:
                parts.append(text[start:i])
                start = i
        p = 0.0
        for part in parts:
            if part in number:
                p += logs[number[part]]
            elif len(part) == 1:
                p += sum(logs[number[f"<0x{b:02X}>"]] for b in part.encode())
            else:
                p = -math.inf
                break
        total += math.exp(p)
    return math.log(total)


def vocabulary():
    pieces = [f"<0x{b:02X}>" for b in range(256)] + ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca"]
    weights = np.random.default_rng(1).random(len(pieces)) + 0.1
    return pieces, np.log(weights / weights.sum())


def test_lattice_sums_all_segmentations():
    pieces, logs = vocabulary()
    words = ["a", "abc", "abcabc", "cab", "é", "aéb", "x", "b" * 9, ""]
    got = lattice.log_probabilities(lattice.Pieces(pieces, logs), words)
    assert got == pytest.approx([all_segmentations(pieces, logs, w) for w in words], rel=1e-12)


def test_long_words_do_not_underflow():
    pieces, logs = vocabulary()
    assert np.isfinite(lattice.log_probabilities(lattice.Pieces(pieces, logs), ["ab" * 20_000]))[0]


def held_out(n):
    return F.pmod(F.crc32(F.col("__id").cast("string").cast("binary")), F.lit(n)) == 0


def test_base_score(spark):
    random.seed(8)
    rows = [(i, " ".join(random.choices(["the", "of", "Théâtre", "rare", f"w{i}"], k=random.randrange(12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "A\x1cb\tc\n"), (103, "x" * 5000), (103, "a second row"), (None, "no id")]
    learnt = [(zlib.crc32(str(i).encode()) % 10 != 0) if i is not None else True for i, _ in rows]
    tokens = [(t or "").encode().lower().split() for _, t in rows]
    counts = Counter(w for own, l in zip(tokens, learnt) if l for w in own)
    ends = sum(learnt)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    whole = n + 0.1 * (v + 1)
    got = lm_scoring.score(spark.createDataFrame(rows, SCHEMA), held_out(10)).collect()
    expected = sorted((
        -1 if i is None else i, not l, len(own) + 1, sum(counts[w] > 0 for w in own) + 1,
        round(sum(math.log10((counts[w] + 0.1) / whole) for w in own) + math.log10((ends + 0.1) / whole), 8))
        for (i, _), own, l in zip(rows, tokens, learnt))
    assert expected == sorted((
        -1 if r["__id"] is None else r["__id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 8)) for r in got)
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)


def test_score_is_the_sum_over_all_segmentations(spark, monkeypatch):
    """Whole documents, held out or not, with the end; the vocabulary alone gives the weights."""
    pieces, logs = vocabulary()
    pieces = [*pieces, lm_scoring.END]
    logs = np.append(logs, math.log(0.01))
    monkeypatch.setattr(lm_scoring, "vocabulary", lambda path: (pieces, logs))
    rows = [(i, t) for i, t in enumerate(["abc ab", "", None, "ca  ca\nca", "x éa", "ABC", "abcabca b"] * 2)]
    got = {r["__id"]: r["score"] for r in lm_scoring.score(spark.createDataFrame(rows, SCHEMA), held_out(3)).collect()}
    for i, text in rows:
        expected = sum(all_segmentations(pieces, logs, w) for w in (text or "").lower().split()) + math.log(0.01)
        assert got[i] == pytest.approx(expected / math.log(10), rel=1e-9)


def test_vocabulary_reads_ranks_as_weights():
    pieces, logs = lm_scoring.vocabulary(lm_scoring.VOCABULARY)
    assert np.exp(logs).sum() == pytest.approx(1) and lm_scoring.END in pieces
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=lm_scoring.VOCABULARY)
    plain = [i for i, p in enumerate(pieces) if not p.startswith("<")][::500]
    for i in plain:
        assert logs[plain[0]] - logs[i] == pytest.approx(math.log((10 - model.get_score(i)) / (10 - model.get_score(plain[0]))))


def test_learnt_scores_of_held_out_documents_are_near_the_base(spark, sf_dir):
    import __spark_entry__ as entry
    got = entry.queries()["op2_lm_scoring"](spark, sf_dir).filter("held_out").collect()
    assert all(r["score"] is not None and np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert all(r["lattice_score"] is not None and np.isfinite(r["lattice_score"]) for r in got)
    words, known = (sum(r[c] for r in got) for c in ("n_tokens", "n_known"))
    base, score = (sum(r[c] for r in got) / words for c in ("base_score", "score"))
    # what unseen words cost more than the base's tenth of a count, which is no share of a whole
    assert score > base - 0.05 - 5 * (1 - known / words)


def test_learnt_probabilities_by_hand(spark, monkeypatch):
    """One round over words of at most two segmentations, then the mixture."""
    pieces, weights = ["▁", "a", "b", "▁a", "ab", lm_scoring.END], np.array([0.3, 0.2, 0.1, 0.2, 0.1, 0.1])
    monkeypatch.setattr(lm_scoring, "vocabulary", lambda path: (pieces, np.log(weights)))
    monkeypatch.setattr(lm_scoring, "ROUNDS", 1)
    monkeypatch.setattr(lm_scoring, "PRIOR", 10.0)
    rows = [(1, "a a"), (1, "b"), (0, "ba a")]
    got = lm_scoring.score(spark.createDataFrame(rows, SCHEMA), F.col("__id") == 0).collect()
    # "▁a" by itself or from "▁" and "a", twice; "▁b" in one way
    alone = 0.2 / (0.2 + 0.3 * 0.2)
    counts = np.array([2 * (1 - alone) + 1, 2 * (1 - alone), 1, 2 * alone, 0, 0])
    fitted = (counts + 10 * weights) / (counts.sum() + 10)
    end = 3 / (counts.sum() + 10 + 3)
    w = dict(zip(pieces, fitted * (1 - end)))
    # five tokens with two ends, one word seen once
    unseen = 1 / 6
    one = (1 - unseen) * 2 / 5 + unseen * (w["▁a"] + w["▁"] * w["a"])
    seen_once = (1 - unseen) * 1 / 5 + unseen * w["▁"] * w["b"]
    last = (1 - unseen) * 2 / 5 + unseen * end
    expected = sorted([one * one * last, seen_once * last, unseen * w["▁"] * w["b"] * w["a"] * one * last])
    assert sorted(10 ** r["learnt_score"] for r in got) == pytest.approx(expected, rel=1e-9)


def test_lm_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "some text", 2, 3.0, "x")], SCHEMA + ", score int, `a b` double, words string")
    row = lm_scoring.score(df, held_out(10)).first()
    assert row["__row"].asDict() == {"doc_id": 1, "score": 2, "a b": 3.0, "words": "x"}


def test_rare_words_are_joined_as_the_common_ones_are_added(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"common word{i % 7} only{i}") for i in range(40)], SCHEMA)
    columns = ("__id", "n_known", "base_score", "score")

    def scores():
        return sorted(tuple(round(x, 9) for x in r) for r in lm_scoring.score(rows, held_out(10)).select(*columns).collect())

    whole = scores()
    monkeypatch.setattr(lm_scoring, "HEAD", 3)
    assert scores() == whole


def test_lm_on_empty_and_untrained_tables(spark):
    assert lm_scoring.score(spark.createDataFrame([], SCHEMA), held_out(10)).collect() == []
    only = lm_scoring.score(spark.createDataFrame([(1, "some text")], SCHEMA), F.lit(True)).first()
    assert only["train_tokens"] == 0 and only["n_known"] == 0 and np.isfinite([only["base_score"], only["score"]]).all()


def labelled(n):
    draw = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        kind = draw.choices(["good", "poor", "toxic"], [6, 3, 1])[0]
        own = {"good": "fine", "poor": "###", "toxic": "idiot"}[kind]
        words = [own if draw.random() < 0.2 else f"w{draw.randrange(300)}" for _ in range(draw.randrange(5, 60))]
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind != "poor"), int(kind == "toxic")))
    return rows, labels


def test_mixing_meets_its_targets(spark):
    rows, labels = labelled(600)
    rows += [(1000, None), (1001, ""), (None, "a row without an id"), (1, "a second row of one id")]
    labels += [(None, 1, 1), (5000, 0, 0), (3, None, None)]
    targets = {"good": 5.0, "poor": 4.0, "toxic": 1.0}
    done = mixing.mix(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS), targets).collect()
    assert len(done) == len(rows)
    p, t, r = (np.array([x[c] for x in done], float) for c in ("posterior", "n_tokens", "rate"))
    assert (r >= 0).all() and np.allclose(p.sum(axis=1), 1)
    assert (t * r) @ p / t.sum() == pytest.approx([0.5, 0.4, 0.1], abs=1e-3)
    assert sum(x["copies"] for x in done) == pytest.approx(r.sum(), rel=0.2)
    assert all(x["target_miss"] <= 1e-5 for x in done)
    # the same descent over all rows at once, in plain numpy
    shares, rate, total = np.array([0.5, 0.4, 0.1]), np.ones(len(p)), t.sum()
    for _ in range(100):
        residual = (t * rate) @ p / total - shares
        if np.abs(residual).max() <= 1e-5:
            break
        second = (p * (t * (rate > 0))[:, None]).T @ p / total
        direction = np.linalg.solve(second + 1e-9 * np.trace(second) * np.eye(3), residual)
        tried = [np.maximum(0, rate - size * (p @ direction)) for size in (1, 1/2, 1/4, 1/8, 1/16, 1/64, 1/256, 1/1024)]
        rate = min(tried, key=lambda x: float((((t * x) @ p / total - shares) ** 2).sum()))
    assert r == pytest.approx(rate, abs=1e-6)


def test_posteriors_in_plain_numpy(spark):
    """The softmax of hashed words, word by word."""
    rows, labels = labelled(200)
    domains = ["good", "poor", "toxic"]
    df, marks = spark.createDataFrame(rows + [(900, "long " * 200_000)], SCHEMA), spark.createDataFrame(labels, LABELS)
    fitted = mixing.train(df, marks, domains)
    got = {r["doc_id"]: r["posterior"] for r in mixing.mix(df, marks).collect()}
    for i, text in [*rows[:20], (900, "long " * 200_000)]:
        counts = Counter(zlib.crc32(w.encode()) % mixing.FEATURES for w in text.lower().split())
        size = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values()))
        logits = [float(fitted.bias[k]) + sum(math.log1p(c) / size * float(fitted.weights[cell, k]) for cell, c in counts.items()) for k in range(3)]
        whole = [math.exp(x - max(logits)) for x in logits]
        assert got[i] == pytest.approx([x / sum(whole) for x in whole], abs=1e-9)


@pytest.mark.parametrize("share, sharp", [(0.003, 6), (0.0005, 6), (0.0005, 2), (0.003, 1)])
def test_mixing_meets_its_targets_with_a_rare_domain(spark, share, sharp):
    draw = np.random.default_rng(7)
    n = 20_000
    of = np.where(np.arange(n) < share * n, 2, draw.integers(0, 10, n) == 0).astype(int)
    p = mixing.softmax(np.eye(3)[of] * sharp + draw.normal(size=(n, 3)))
    t, shares = draw.integers(1, 500, n), np.array([0.9, 0.07, 0.03])
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p)], "n_tokens long, posterior array<double>")
    mixture = mixing.solve(df, shares)
    r = mixture.rates(p)
    assert mixture.miss <= 1e-5
    assert (r >= 0).all() and (t * r) @ p / t.sum() == pytest.approx(shares, abs=2e-5)


def test_mixing_reports_targets_out_of_reach(spark):
    df = spark.createDataFrame([(10, [0.5, 0.5])] * 4, "n_tokens long, posterior array<double>")
    mixture = mixing.solve(df, np.array([0.9, 0.1]))
    assert mixture.miss == pytest.approx(0.4, abs=1e-3)
    assert mixture.rates(np.array([[0.5, 0.5]])) == pytest.approx([1.0], abs=1e-3)


def test_one_id_with_many_rows_is_learnt_once(spark):
    rows, labels = labelled(100)
    marks = spark.createDataFrame(labels, LABELS)
    plain = mixing.train(spark.createDataFrame(rows, SCHEMA), marks, ["good", "poor", "toxic"])
    many = mixing.train(spark.createDataFrame(rows + [rows[3]] * 300, SCHEMA), marks, ["good", "poor", "toxic"])
    assert np.array_equal(plain.weights, many.weights)


def test_mixing_without_rows_or_labels(spark):
    none = spark.createDataFrame([], LABELS)
    assert mixing.mix(spark.createDataFrame([], SCHEMA), none).collect() == []
    df = spark.createDataFrame([(1, "some text", 2.5, "z")], SCHEMA + ", rate double, posterior string")
    done = mixing.mix(df, none)
    assert done.columns == ["doc_id", "text", "n_tokens", "posterior", "rate", "copies", "target_miss"]
    assert done.first()["posterior"] == pytest.approx([1 / 3] * 3)


def test_toxicity_finds_unseen_spellings(spark):
    draw = random.Random(6)
    bad = ["idiot", "scumbag", "worthless"]

    def text(words):
        own = [f"{draw.choice('bdfgklmn')}{draw.choice('aeiou')}{draw.choice(['ra', 'ti', 'lon', 'mer', 'sk'])}" for _ in range(draw.randrange(30, 200))]
        for w in words:
            own[draw.randrange(len(own))] = w
        return " ".join(own)

    rows = [(i, text(draw.sample(bad, 2) if i % 4 == 0 else [])) for i in range(600)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(600)]
    unseen = [(1000 + i, text(w)) for i, w in enumerate([["idiots", "scumbagg"], ["idiott", "worthlesss"], ["scumbags", "idiotic"]])]
    clean = [(2000 + i, text([])) for i in range(100)] + [(3000, None), (3001, ""), (3002, " \n"), (3003, text([]) + " long" * 300_000)]
    df = spark.createDataFrame(rows + unseen + clean, SCHEMA)
    usable = F.col("__id") % 3 != 1
    got = {r["doc_id"]: r for r in toxicity.score(df, spark.createDataFrame(labels, LABELS), usable=usable).collect()}
    test = [(got[i]["predicted"], int(i % 4 == 0)) for i in range(600) if i % 3 == 1]
    assert np.mean([p == l for p, l in test]) > 0.97
    assert all(got[i]["predicted"] for i, _ in unseen)
    assert not any(got[i]["predicted"] for i, _ in clean)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], LABELS)
    assert toxicity.score(spark.createDataFrame([], SCHEMA), none).collect() == []
    df = spark.createDataFrame([(1, "some text", 3)], SCHEMA + ", score int")
    row = toxicity.score(df, none).first()
    assert row["score"] <= 0.5 and row["predicted"] == 0 and "text" not in row


def test_query_is_right_on_held_out_labels(spark):
    import __spark_entry__ as entry
    sf_dir = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in entry.queries()["op9_toxicity"](spark, sf_dir).collect() if r["held_out"] and r["doc_id"] in labels]
    clean = [r for r in rows if not labels[r["doc_id"]]]
    toxic = [r for r in rows if labels[r["doc_id"]]]
    assert sum(r["predicted"] for r in clean) <= 0.01 * len(clean)
    assert sum(r["predicted"] for r in toxic) >= 0.55 * len(toxic)
