"""Secret and licence scans against plain readings of their rules."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from keelrow.llm import licenses, secrets

SCHEMA = "doc_id long, text string"
KEY = "AKIA" + "A1" * 8
TEXTS = [
    None, "", "no secret", "token = \"0123456789abcdef0123456789abcdef01234567\" end", "PASSWORD:hunter22 and apikey=abc12 api_key='abcdef'",
    f"x{KEY}y {KEY[:19]} {KEY}", "é" * 50 + " secret: abcdefg", "paſsword=abcdefg toKen=abcdefg", "a" * 24 + "g" + "b" * 23,
    "ghp_" + "x" * 36 + " xoxb-1234567890-abc", "-----BEGIN RSA PRIVATE KEY-----", "Bearer " + "t" * 30, "password=short secret=longenough",
    "passwdpassword=abcdefgh", "x " * 200_000 + "token=abcdefgh", "token=token=abcdef", "AKIA" + "é" + "A" * 30,
]


def by_hand(text):
    text = text or ""
    spans = []
    base = (
        (r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), (r"[0-9a-f]+", lambda m: len(m[0]) >= 24))
    for order, (pattern, good) in enumerate(base):
        spans += [(m.start(), order, m.end()) for m in re.finditer(pattern, text) if good(m)]
    return ",".join(f"{('assign', 'access', 'hex')[o]}:{s}:{e}" for s, o, e in sorted(spans))


def test_secrets(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3])]
    got = secrets.scan(spark.createDataFrame(rows, SCHEMA).repartition(3))
    base = {r.kind for r in secrets.BASE}
    for row in got.collect():
        joined = ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in row["spans"] if x["kind"] in base)
        assert joined == by_hand(TEXTS[row["doc_id"]]), TEXTS[row["doc_id"]][:80]
    more = {r["doc_id"]: [x["kind"] for x in r["spans"]] for r in got.collect()}
    assert more[9] == ["github", "slack"] and more[10] == ["private_key"] and more[11] == ["bearer"]


@pytest.mark.parametrize("pattern,query", [
    ("abcd", {frozenset({b"abc", b"bcd"})}), ("abc|xyz+", {frozenset({b"abc"}), frozenset({b"xyz"})}),
    ("[0-9]+", {frozenset()}), ("(abc)?def", {frozenset({b"def"})}), ("ab[cd]e", {frozenset({b"abc", b"bce"}), frozenset({b"abd", b"bde"})}),
    ("(foo)+x{3}", {frozenset({b"foo", b"xxx"})}), ("a.bcd", {frozenset({b"bcd"})}),
])
def test_trigram_queries(pattern, query):
    assert set(secrets.trigram_query(pattern)) == query


def test_no_match_escapes_the_index():
    """Every match of every rule holds all trigrams of one alternative."""
    for text in TEXTS:
        folded = (text or "").encode().lower()
        for rule in secrets.RULES:
            if re.search(rule.pattern, text or ""):
                assert any(all(gram in folded for gram in own) for own in secrets.trigram_query(rule.pattern)), (rule, text[:60])


def test_secret_query_digests(spark, sf_dir):
    import __spark_entry__ as entry
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for row in entry.queries()["op7_secret_scan"](spark, sf_dir).collect():
        joined = by_hand(docs[row["doc_id"]])
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in ("assign", "access", "hex")] == [joined.count(f"{k}:") for k in ("assign", "access", "hex")]


def test_scans_of_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert secrets.scan(empty).collect() == [] and licenses.scan(empty).collect() == []
    df = spark.createDataFrame([(1, "the MIT License", "a", 5)], SCHEMA + ", spans string, score int")
    assert secrets.scan(df).columns == ["doc_id", "score", "spans"]
    row = licenses.scan(df).first()
    assert (row["base_labels"], row["__row"]["score"]) == ("mit", 5)


LICENSED = [
    (None, "", 0, None, None, ""), ("", "", 0, None, None, ""), ("MIT License", "mit", 1, 0, 0, "mit"),
    ("see the mit\nLICENSE, mit-license; Apache License 2.0", "apache,mit", 3, 2, 6, "apache,mit"),
    ("GNU General Public License", "gpl", 1, 1, 1, "gpl"), ("mitlicense mit x license general public", "", 0, None, None, ""),
    ("Licensed under CC BY-NC 4.0.", "", 0, None, None, "cc-by-nc"), ("mité license", "", 0, None, None, ""),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
     " conditions are met:", "", 0, None, None, "bsd"),
    ("mit license " * 3, "mit", 3, 0, 4, "mit"), ("filler " * 50_000 + "apache license", "apache", 1, 50_000, 50_000, "apache"),
]


def test_licenses(spark):
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(LICENSED)] + [(2, LICENSED[2][0])], SCHEMA)
    rows = licenses.scan(df).collect()
    assert len(rows) == len(LICENSED) + 1
    for row in rows:
        text, base, n, first, last, labels = LICENSED[row["__id"]]
        assert (row["base_labels"], row["n_base"], row["first_word"], row["last_word"], row["labels"]) == (base, n, first, last, labels), text
        assert row["n_words"] == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()))
        assert 0 <= row["score"] <= 1 and (row["score"] > 0) == bool(labels)


def test_license_plan_has_no_python(spark, sf_dir):
    import __spark_entry__ as entry
    plan = entry.queries()["op4_license_scan"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_all_licences_of_a_file_with_all_notices(spark):
    notices = [template for _, template, _ in licenses.TEMPLATES]
    rows = [(10 * i + k, f"own words {t} and more") for i, t in enumerate(notices) for k in range(10)]
    rows.append((1000, " some words between ".join(notices)))
    got = {r["__id"]: r for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1000]["labels"] == ",".join(sorted({label for label, _, _ in licenses.TEMPLATES}))
    assert got[1000]["score"] == pytest.approx(1.0)
