"""The byte-level network: every window by plain loops, gradients by differences, held-out accuracy, hard rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelrow.llm import quality_classifier as classifier

SCHEMA = "doc_id long, text string"
LABELS = "doc_id long, quality int"


def logit_by_loops(network, text):
    """The document's logit window by window, with no table and no layout in blocks."""
    data = [*text, *[256] * classifier.WIDTH]
    windows = [
        sum(network.embedding[data[i + k]] @ network.filters[k] for k in range(classifier.WIDTH)) + network.offsets
        for i in range(len(text))]
    ends = -(-len(text) // classifier.BLOCK)
    logits = []
    for first in range(max(1, ends - 1)):
        own = windows[first * classifier.BLOCK:(first + 2) * classifier.BLOCK]
        features = np.maximum(np.max(own, axis=0), 0) if own else np.zeros(classifier.FILTERS)
        hidden = np.maximum(features @ network.dense + network.dense_offsets, 0)
        logits.append(float(hidden @ network.out + network.out_offset))
    return -np.log(np.mean(np.exp(-np.array(logits))))


def texts():
    draw = random.Random(4)
    sizes = [0, 1, 5, 8, 121, 122, 128, 129, 249, 250, 256, 377, 378, 1000]
    return [bytes(draw.randrange(256) for _ in range(n)) for n in sizes]


def test_score_is_the_network_over_every_window(monkeypatch):
    network = classifier.started(1)
    expected = [logit_by_loops(network, t) for t in texts()]
    assert classifier.Scorer(network).logits(texts()) == pytest.approx(expected, abs=1e-4)
    # long texts in pieces and slabs
    monkeypatch.setattr(classifier, "_TOGETHER", 256)
    monkeypatch.setattr(classifier, "_SLAB", 1)
    assert classifier.Scorer(network).logits(texts()) == pytest.approx(expected, abs=1e-4)


def test_gradient_by_differences():
    network = classifier.started(2)
    chunks = [classifier._chunked(t) for t in texts()[4:]]
    sizes = np.array([len(c) for c in chunks])
    labels, weights = np.arange(len(chunks)) % 2, np.linspace(0.5, 1, len(chunks))
    _, found = classifier.gradients(network, np.concatenate(chunks), sizes, labels, weights)
    draw = np.random.default_rng(5)
    for part, pull in zip(vars(network).values(), vars(found).values()):
        for _ in range(4):
            at = tuple(draw.integers(0, n) for n in part.shape)
            if part is network.embedding and at[0] == 256:
                continue
            kept, losses = part[at].copy(), []
            for moved in (kept + 1e-3, kept - 1e-3):
                part[at] = moved
                losses.append(classifier.gradients(network, np.concatenate(chunks), sizes, labels, weights)[0])
            part[at] = kept
            assert pull[at] == pytest.approx((losses[0] - losses[1]) / 2e-3, abs=2e-3, rel=2e-2)


def labelled(n):
    draw = random.Random(9)

    def prose(k):
        return " ".join("".join(draw.choices("aeinorst", k=draw.randrange(2, 9))) for _ in range(k))

    rows, labels = [], []
    for i in range(n):
        good = draw.random() < 0.7
        body = prose(draw.randrange(30, 150))
        if not good:
            # a junk passage somewhere in the text
            body = body + " " + " ".join(w + draw.choice(["###", "&&&", "$$$"]) for w in prose(40).split()) + " " + prose(20)
        rows.append((i, body))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy_and_hard_rows(spark):
    rows, labels = labelled(700)
    extra = [(9000, None), (9001, ""), (9002, " \n"), (None, rows[0][1]), (0, rows[0][1]), (9003, rows[1][1] * 400), (9004, "é\x00😀")]
    df = spark.createDataFrame([(*r, 1.5, "x") for r in rows + extra], SCHEMA + ", score double, `a b` string")
    more = [(None, 1), (1, None), (7777, 0), (2, 7), (labels[3][0], 1 - labels[3][1])]
    done = classifier.score(df, spark.createDataFrame(labels + more, LABELS), usable=F.col("__id") % 4 != 2)
    assert done.columns == ["doc_id", "a b", "score", "predicted"]
    got = done.collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r["score"])
    # equal texts, equal scores, whatever the id
    assert by_id[0][0] == by_id[0][1] == by_id[None][0] and by_id[9000] == by_id[9001]
    truth = dict(labels)
    test = [(int(by_id[i][0] >= 0.7), truth[i]) for i, _ in rows if i % 4 == 2]
    assert np.mean([p == t for p, t in test]) > 0.95


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], LABELS)
    assert classifier.score(spark.createDataFrame([], SCHEMA), none).collect() == []
    one = spark.createDataFrame([(1, "some text")], SCHEMA)
    assert classifier.score(one, none).first()["score"] == 0.5
    # one class alone teaches nothing
    assert classifier.score(one, spark.createDataFrame([(1, 1)], LABELS)).first()["predicted"] == 0


def test_query_is_right_on_held_out_labels(spark):
    import __spark_entry__ as entry
    sf_dir = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in entry.queries()["op13_quality_classifier"](spark, sf_dir).collect() if r["held_out"] and r["doc_id"] in labels]
    good = [r["predicted"] for r in rows if labels[r["doc_id"]] == 1]
    poor = [r["predicted"] for r in rows if labels[r["doc_id"]] == 0]
    assert np.mean(good) >= 0.98 and np.mean(poor) <= 0.06
