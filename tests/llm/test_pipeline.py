"""The pipeline: its stages against the operators' own brute force, and on hard rows."""

from pyspark.sql import functions as F

import corpus_pipeline
from test_line_dedup import by_hand as lines_by_hand
from test_quality_rules import by_hand as counts_by_hand
from test_simhash_dedup import first_of_groups


def test_stages(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "SimHash near-dedup", "benchmark decontamination", "mixing to target weights"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    quality, lines, near, leaks, mixing = (stage for _, stage in corpus_pipeline.STAGES)

    def step(stage, docs):
        done = stage(spark, docs, sf_dir).cache()
        return done, {r["doc_id"]: r for r in done.collect()}

    docs, kept = step(quality, docs)
    assert docs.columns == columns
    for i, row in before.items():  # too few labels here to certify a cutoff, so the base rules decide
        n_words, *_, repeats = counts_by_hand(row["text"])
        assert (i in kept) == (n_words >= 20 and 100 * repeats <= 30 * n_words)
    docs, deduped = step(lines, docs)
    assert docs.columns == columns
    expected = {i: text for i, text, _, _ in lines_by_hand([(i, r["text"]) for i, r in kept.items()])}
    assert {i: r["text"] for i, r in deduped.items()} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in deduped.values())
    docs, single = step(near, docs)
    assert docs.columns == columns
    assert set(single) == first_of_groups({i: r["text"] for i, r in deduped.items()}, corpus_pipeline.NEAR_BITS)
    docs, clean = step(leaks, docs)
    assert docs.columns == columns
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for i, row in single.items():
        if any(item in " ".join(row["text"].lower().split()) for item in items):
            assert i not in clean
    assert len(clean) > 0.9 * len(single)
    docs, mixed = step(mixing, docs)
    assert set(mixed) == set(clean) and docs.columns == [*columns, "n_tokens", "posterior", "rate", "copies", "target_miss"]
    whole = corpus_pipeline.run(spark, sf_dir).select("doc_id", "text", "n_tokens", "rate", "copies")
    assert {r["doc_id"]: (r["text"], r["n_tokens"], r["copies"]) for r in whole.collect()} == {
        i: (r["text"], r["n_tokens"], r["copies"]) for i, r in mixed.items()}


def test_stages_on_hard_rows(spark, sf_dir):
    text = " ".join(f"word{i}" for i in range(30))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).withColumns({"hi": F.lit(None).cast("string"), "stratum": F.lit(None).cast("int")})
    rows = [(None, None, None, None, None, "a", 1), (1, "", None, "s", 0, None, None), (2, text, "en", None, 5, "b", 2),
            (2, text, "en", None, 5, "b", 2), (3, text + " more", None, None, None, "c", 3), (None, text, "en", "s", 1, "d", 4),
            (4, " ".join(f"other{i}" for i in range(30)), None, None, None, "e", 5)]
    # the text of the row without an id is a line of document 2: it stays as an empty one; document 3 is nearly document 2
    kept = [(2, "b"), (4, "e"), (None, "d")]
    for table, expected in ((docs, []), (spark.createDataFrame(rows, docs.schema), kept)):
        now = table
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, sf_dir)
        assert now.columns == [*docs.columns, "n_tokens", "posterior", "rate", "copies", "target_miss"]
        found = [(r["doc_id"], r["hi"]) for r in now.collect()]
        assert sorted(found, key=repr) == sorted(expected, key=repr)
