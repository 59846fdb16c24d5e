"""License scan by a positional index of rare words.

The templates below are indexed by word and place, without the commonest function words.  Each text is
read once: the places of all template words in it are written, a few bytes a document.  Then

1. the words get inverse document frequencies over all documents;
2. each document looks up all its template words in the postings; places minus template
   places give relative positions, and templates that at least two words (or all, if
   the template has fewer) agree on are candidates at that position;
3. at a candidate's position all template words count: the coverage is the share of the template's
   weight found in place, and every word of the template's key phrase must be in place.

Only DataFrame functions are used; what is broadcast are the fixed templates.

Defined results: null and empty texts have no words and no labels; every row, repeated or not, has its own
result; phrases may overlap; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelrow.llm.common import ID, ROW, TEXT, carried
from keelrow.llm.quality_rules import bound
from keelrow.session import cut_lineage

COVERAGE = 0.6
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# The base phrases and their labels
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Label, template and key phrase; places count all words, the phrase is within the template
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
     " documentation files the software to deal in the software without restriction", "hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"
     " http www apache org licenses", "apache org licenses"),
    ("gpl", "this work is licensed under the gnu general public license version", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
     " public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "redistribute it and or modify it under the terms of the gnu lesser general public license",
     "gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"
     " the following conditions are met", "source and binary forms"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
     " granted", "with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license",
     "creative commons attribution noncommercial"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license",
     "creative commons attribution 4 0 international"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released"),
)
# Words that are not indexed
FUNCTION_WORDS = (
    "a", "and", "any", "are", "as", "at", "by", "can", "for", "in", "into", "is", "it", "may", "not", "of", "or", "that", "the",
    "this", "to", "under", "with", "you",
)


def postings() -> list[tuple]:
    """``template, label, place, word, key``: the words of the templates that are indexed."""
    rows = []
    for number, (label, template, phrase) in enumerate(TEMPLATES):
        words, key = template.split(), phrase.split()
        start = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
        rows += [
            (number, label, i, word, start <= i < start + len(key))
            for i, word in enumerate(words) if word not in FUNCTION_WORDS
        ]
    return rows


def _index(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(postings(), "template int, label string, place int, word string, key boolean")


def vocabulary() -> list[str]:
    return sorted({row[3] for row in postings()} | {word for phrase, _ in PHRASES for word in phrase.split()})


def _places(words: Column) -> Column:
    known = vocabulary()
    listed = F.array(*map(F.lit, known))
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(known))
    return F.when(F.arrays_overlap(words, listed), hits)


def _base(hits: Column) -> Column:
    """Start and label of every place of a base phrase, whose words are all among the hits."""
    def places(words: list[str], label: str) -> Column:
        def starts(x: Column, j: Column) -> Column:
            found = x["w"] == words[0]
            for k in range(1, len(words)):
                other = F.get(hits, j + k)
                found = found & F.coalesce((other["w"] == words[k]) & (other["i"] == x["i"] + k), F.lit(False))
            return found

        return F.transform(F.filter(hits, starts), lambda x: F.struct(x["i"].alias("i"), F.lit(label).alias("label")))

    return F.concat(*(places(phrase.split(), label) for phrase, label in PHRASES))


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    words = F.filter(F.split(F.lower(F.coalesce(F.col(TEXT), F.lit(""))), SEPARATORS), lambda w: w != "")
    rows = carried(docs, id_col, text_col).select(
        ID, ROW, bound(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _places(w).alias("hits"))).alias("x"))
    return cut_lineage(rows.select(
        F.monotonically_increasing_id().alias("__rid"), ID, ROW, "x.n_words", F.col("x.hits").alias("hits")))


def _templates_found(read: DataFrame) -> DataFrame:
    """``__rid, label, coverage`` of the templates that are verified."""
    index = F.broadcast(_index(read.sparkSession))  # the fixed templates
    hits = read.filter("hits IS NOT NULL").select("__rid", F.explode("hits").alias("x")).select("__rid", "x.w", "x.i")
    total = read.count()
    seen = hits.select("__rid", "w").distinct()
    idf = cut_lineage(seen.groupBy("w").agg(F.log((F.lit(total) + 1) / (F.count(F.lit(1)) + 0.5)).alias("idf")))
    # a word that no document has keeps the weight of the rarest
    weighted = _index(read.sparkSession).join(F.broadcast(idf), F.col("word") == F.col("w"), "left").withColumn(
        "idf", F.coalesce("idf", F.log(F.lit(2.0 * (total + 1))))).drop("w")
    whole = cut_lineage(weighted.groupBy("template", "label").agg(
        F.sum("idf").alias("weight"), F.sum(F.col("key").cast("int")).alias("n_key"), F.count(F.lit(1)).alias("n_places")))
    at = (F.col("i") - F.col("place")).alias("at")
    aligned = hits.join(index, F.col("w") == F.col("word")).groupBy("__rid", "template", at).agg(
        F.count_distinct("place").alias("agree"))
    candidates = aligned.join(F.broadcast(whole), "template").filter(
        F.col("agree") >= F.least(F.lit(2), "n_places")).select("__rid", "template", "at")
    placed = hits.join(F.broadcast(weighted), F.col("w") == F.col("word")).select(
        "__rid", "template", at, "place", "idf", F.col("key").cast("int").alias("key"))
    return (
        placed.join(candidates, ["__rid", "template", "at"], "left_semi")
        .groupBy("__rid", "template", "at").agg(F.sum("idf").alias("found"), F.sum("key").alias("keys"))
        .join(F.broadcast(whole), "template")
        .withColumn("coverage", F.least(F.lit(1.0), F.col("found") / F.col("weight")))
        .filter((F.col("keys") == F.col("n_key")) & (F.col("coverage") >= COVERAGE))
        .select("__rid", "label", "coverage")
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``__id``, ``__row`` and the result of each document.

    ``score`` is the best coverage of a verified template, and at least a half where a base phrase stands.
    """
    read = _read(docs, id_col, text_col)
    found = _templates_found(read).groupBy("__rid").agg(
        F.collect_set("label").alias("more"), F.max("coverage").alias("coverage"))
    based = read.withColumn("base", F.coalesce(
        bound(F.col("hits"), _base), F.array().cast("array<struct<i:int,label:string>>")))
    starts, names = F.col("base.i"), F.array_distinct(F.col("base.label"))
    none = F.array().cast("array<string>")
    return based.join(found, "__rid", "left").select(
        ID, ROW, "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.sort_array(names), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(names, F.coalesce("more", none))), ",").alias("labels"),
        F.greatest(F.coalesce("coverage", F.lit(0.0)), F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
    )


def duckdb_sql() -> str:
    """The same in DuckDB's SQL: all template words of a document are looked up."""
    def text(value: str) -> str:
        return "'" + re.sub("'", "''", value) + "'"

    index = ", ".join(f"({t}, {text(lab)}, {p}, {text(w)}, {key})" for t, lab, p, w, key in postings())
    base = " UNION ALL ".join(
        f"SELECT doc_id, i, {text(label)} AS label FROM words WHERE "
        + " AND ".join(f"w[i + {k + 1}] = {text(word)}" for k, word in enumerate(phrase.split()))
        for phrase, label in PHRASES)
    return f"""
    WITH split AS (
        SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')),
            '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
    ), words AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM split
    ), base AS ({base}
    ), based AS (
        SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS names
        FROM base GROUP BY doc_id
    ), postings(template, label, place, word, key) AS (VALUES {index}
    ), hits AS (SELECT doc_id, i, w[i + 1] AS word FROM words WHERE w[i + 1] IN (SELECT word FROM postings)
    ), idf AS (
        SELECT word, ln(((SELECT count(*) FROM split) + 1) / (count(DISTINCT doc_id) + 0.5)) AS idf FROM hits GROUP BY word
    ), weighted AS (
        SELECT p.*, coalesce(idf, ln(2.0 * ((SELECT count(*) FROM split) + 1))) AS idf FROM postings p LEFT JOIN idf USING (word)
    ), whole AS (
        SELECT template, sum(idf) AS weight, sum(key::INT) AS n_key, count(*) AS n_places FROM weighted GROUP BY template
    ), candidates AS (
        SELECT doc_id, template, i - place AS rel FROM hits JOIN postings USING (word)
        JOIN whole USING (template) GROUP BY ALL HAVING count(DISTINCT place) >= any_value(least(2, n_places))
    ), found AS (
        SELECT doc_id, label, least(1.0, sum(w.idf) / any_value(weight)) AS coverage
        FROM hits h JOIN weighted w USING (word) SEMI JOIN candidates c
            ON c.doc_id = h.doc_id AND c.template = w.template AND c.rel = h.i - w.place
        JOIN whole o ON o.template = w.template GROUP BY doc_id, label, w.template, h.i - w.place
        HAVING sum(key::INT) = any_value(n_key) AND sum(w.idf) / any_value(weight) >= {COVERAGE}
    ), more AS (SELECT doc_id, list(DISTINCT label) AS more, max(coverage) AS coverage FROM found GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
        last_word::BIGINT AS last_word, coalesce(array_to_string(list_sort(names), ','), '') AS base_labels,
        coalesce(array_to_string(list_sort(list_distinct(list_concat(names, more))), ','), '') AS labels,
        greatest(coalesce(coverage, 0.0), if(n_base > 0, 0.5, 0.0))::DOUBLE AS score
    FROM split LEFT JOIN based USING (doc_id) LEFT JOIN more USING (doc_id)"""
