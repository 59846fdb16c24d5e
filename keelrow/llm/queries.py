"""The registered queries of this folder and the DuckDB counterparts of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelrow.llm import (
    conversation_trie, decontamination, hard_negatives, licenses, line_dedup, lm_scoring, mixing, quality_classifier, quality_rules, secrets,
    simhash_dedup, substring_dedup, toxicity,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def _remainder(doc_id: str, n: int):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules.judge(docs, _table(spark, sf_dir, "labels")).select(
        F.col("__id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "failed_rules",
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scoring.score(docs, _remainder("__id", 10) == 0).select(
        F.col("__id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score",
        F.col("learnt_score").alias("score"), F.col("score").alias("lattice_score"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.leaking_items(docs, _table(spark, sf_dir, "benchmark")).withColumn(
        "similarity", F.round("similarity", 6))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).select(
        F.col("__id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
        F.round("score", 9).alias("score"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.shared_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "class_id", F.size("spans").cast("long").alias("n_spans"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"] + 1).alias("n_words"),
        F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("spans"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash_dedup.near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    base = [rule.kind for rule in secrets.BASE]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return secrets.scan(docs).select(
        "doc_id", *map(count, base), F.sha2(joined(F.filter("spans", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    mixed = mixing.mix(docs, _table(spark, sf_dir, "labels"), with_text=False)
    posterior = [F.get("posterior", F.lit(i)).alias(f"p_{name}") for i, name in enumerate(sorted(mixing.TARGETS))]
    return mixed.select("doc_id", "n_tokens", *posterior, "rate", "copies", "target_miss")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    # a null id is never held out
    scored = toxicity.score(docs, _table(spark, sf_dir, "labels"), usable=F.coalesce(_remainder("__id", 3), F.lit(0)) != 1)
    return scored.select(
        "doc_id", (F.coalesce(_remainder("doc_id", 3), F.lit(0)) == 1).alias("held_out"), "score", "predicted")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows, F.col("id") % 50 == 0, label=moved)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = conversation_trie.encode(
        _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return conversation_trie.nodes(*conversation_trie.rebuilt(turns, convs, 20, _remainder("conv", 4), 3))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    # a null id is never held out
    scored = quality_classifier.score(
        docs, _table(spark, sf_dir, "labels"), usable=F.coalesce(_remainder("__id", 4), F.lit(0)) != 2)
    return scored.select(
        "doc_id", (F.coalesce(_remainder("doc_id", 4), F.lit(0)) == 2).alias("held_out"), "score", "predicted")


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_decontamination": op3_decontamination,
    "op4_license_scan": op4_license_scan,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_source_mixing": op8_source_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_quality_classifier": op13_quality_classifier,
    "pipeline": corpus_pipeline.run,
}

# Every share above its cutoff; the certified cutoffs from exact binomial tails by the log gamma function
_QUALITY_SQL = r"""
    WITH base AS (
        SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
            list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
            string_split(coalesce(text, ''), chr(10)) AS l
        FROM documents
    ), full_lines AS (
        SELECT *, list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS fl FROM base
    ), windows AS (
        SELECT doc_id, i, list_slice(w, i, i + 7) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM base)
    ), twice AS (
        SELECT doc_id, i FROM windows SEMI JOIN (
            SELECT doc_id, win FROM windows GROUP BY ALL HAVING count(*) > 1) r USING (doc_id, win)
    ), covered AS (
        SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM twice, (SELECT unnest(range(8)) AS o) GROUP BY doc_id
    ), counts AS (
        SELECT doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
            length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
            (len(fl) - len(list_distinct(fl)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
            len(l) AS n_lines, length(regexp_replace(t, '\P{Lu}', '', 'g')) AS n_capitals,
            length(regexp_replace(t, '[^!]', '', 'g')) AS n_marks
        FROM full_lines LEFT JOIN covered USING (doc_id)
    ), shares AS (
        SELECT doc_id, stratum, unnest(['symbols', 'capitals', 'marks', 'dup_lines', 'repeat_words']) AS rule,
            unnest([if(word_chars > 0, n_symbols / word_chars, 0.0), if(word_chars > 0, n_capitals / word_chars, 0.0),
                if(word_chars > 0, n_marks / word_chars, 0.0), if(n_lines > 0, n_dup_lines / n_lines, 0.0),
                if(n_words > 0, n_repeat_words / n_words, 0.0)]) AS share
        FROM counts
    ), marked AS (
        SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
    ), tests AS (
        SELECT stratum, rule, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND share > cutoff) AS k,
            count(*) FILTER (NOT good AND share > cutoff) AS bad
        FROM shares JOIN marked USING (doc_id), (SELECT unnest(range(1, 33)) / 40 AS cutoff) GROUP BY ALL
    ), tails AS (
        SELECT *, list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
            + j * ln(0.01) + (n - j) * ln(0.99)))) AS tail, (SELECT count(*) FROM tests) AS m
        FROM tests WHERE k < n * 0.01 AND bad > k
    ), chosen AS (
        SELECT stratum, rule, arg_max(cutoff, (bad - k) * 1000 + cutoff) AS cutoff FROM tails WHERE tail <= 0.05 / m
        GROUP BY stratum, rule
    ), failed AS (
        SELECT doc_id, string_agg(rule, ',' ORDER BY list_position(['symbols', 'capitals', 'marks', 'dup_lines', 'repeat_words'], rule))
            AS failed_rules
        FROM shares JOIN chosen USING (stratum, rule) WHERE share > cutoff GROUP BY doc_id
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
        n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND failed_rules IS NULL AS kept,
        coalesce(failed_rules, '') AS failed_rules
    FROM counts LEFT JOIN failed USING (doc_id)"""

ORACLES = {
    "op1_quality_rules": _QUALITY_SQL,
    # windows of an item's size at every shared shingle, compared exactly
    "op3_decontamination": r"""
        WITH words AS (
            SELECT 'd' AS kind, doc_id AS id, list_filter(string_split_regex(lower(text), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
                lambda x: x <> '') AS w FROM documents
            UNION ALL
            SELECT 'i', item_id, list_filter(string_split_regex(lower(text), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
                lambda x: x <> '') FROM benchmark
        ), items AS (
            SELECT id AS item_id, w, len(w) AS n FROM words WHERE kind = 'i' AND len(w) >= 5
        ), item_shingles AS (
            SELECT item_id, n, i, list_slice(w, i, i + 4) AS s FROM (SELECT *, unnest(range(1, n - 3)) AS i FROM items)
        ), idf AS (
            SELECT s, ln(1 + (SELECT count(*) FROM items) / count(DISTINCT item_id)) AS idf FROM item_shingles GROUP BY s
        ), doc_shingles AS (
            SELECT id AS doc_id, p, list_slice(w, p, p + 4) AS s
            FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS p FROM words WHERE kind = 'd')
        ), windows AS (
            SELECT DISTINCT doc_id, item_id, n, greatest(p - i, 0) AS start FROM doc_shingles JOIN item_shingles USING (s)
        ), own AS (
            SELECT doc_id, item_id, start, s, count(*) AS c
            FROM windows JOIN doc_shingles USING (doc_id) WHERE p > start AND p + 4 <= start + n GROUP BY ALL
        ), theirs AS (
            SELECT item_id, s, count(*) AS c FROM item_shingles GROUP BY ALL
        ), sums AS (
            SELECT doc_id, item_id, start, sum(own.c * coalesce(idf, (SELECT max(idf) FROM idf))) AS wa,
                sum(least(own.c, coalesce(theirs.c, 0)) * coalesce(idf, 0)) AS common
            FROM own LEFT JOIN theirs USING (item_id, s) LEFT JOIN idf USING (s) GROUP BY ALL
        ), weights AS (
            SELECT item_id, sum(c * idf) AS wb FROM theirs JOIN idf USING (s) GROUP BY item_id
        )
        SELECT doc_id, item_id, count(*) AS n_windows, min(start)::INTEGER AS first_word, round(max(common / (wa + wb - common)), 6) AS similarity
        FROM sums JOIN weights USING (item_id) WHERE common / (wa + wb - common) >= 0.8 - 1e-9 GROUP BY doc_id, item_id""",
    "op4_license_scan": licenses.duckdb_sql().replace("AS score", "AS raw").replace(
        "greatest(coalesce(coverage, 0.0), if(n_base > 0, 0.5, 0.0))::DOUBLE AS raw",
        "round(greatest(coalesce(coverage, 0.0), if(n_base > 0, 0.5, 0.0))::DOUBLE, 9) AS score"),
    "op10_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, i, l[i] AS line, lower_ascii AS key FROM (
                SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
                    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
                LATERAL (SELECT translate(trim(l[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii)
        ), shared AS (
            SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key
            HAVING count(DISTINCT doc_id) >= 2
        ), marked AS (
            SELECT doc_id, i, line, first IS NOT NULL AND first <> doc_id AS dropped FROM lines LEFT JOIN shared USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    # every anchor against every row
    "op11_hard_negatives": r"""
        WITH known AS (
            SELECT DISTINCT vec_id, if(vec_id % 7 = 0, (label + 1) % 10, label) AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_dot_product(a.v, b.v)::BIGINT AS score
            FROM known a JOIN known b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
        ), positives AS (
            SELECT anchor_id, id, score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
        )
        SELECT p.anchor_id, p.id AS positive_id,
            row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
            n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
            AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
        QUALIFY rank <= 3""",
    # every prefix as a list of turns; crc32 bit by bit
    "op12_conversation_trie": r"""
        WITH ordered AS (
            SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, ''))
                ORDER BY turn NULLS FIRST, coalesce(role, ''),
                sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS t
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ), headed AS (
            SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
                    lambda x, i: if(x & 1 = 1, xor(x >> 1, 3988292384::BIGINT), x >> 1))), 4294967295::BIGINT) % 4 AS h
            FROM ordered
        ), seqs AS (
            SELECT c.conv_id, list_concat(coalesce(list_slice(b.t, 1, c.h), []), list_slice(c.t, c.h + 1, len(c.t))) AS seq
            FROM headed c LEFT JOIN headed b ON b.conv_id = c.conv_id - c.conv_id % 20
        ), prefixes AS (
            SELECT conv_id, d, len(seq) = d AS ends, list_slice(seq, 1, d) AS prefix,
                if(d = 0, 0, len(list_filter(string_split_regex(seq[d].text, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS words
            FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM seqs)
        ), member AS (
            SELECT conv_id, d, ends, words, min(conv_id) OVER (PARTITION BY prefix) AS node FROM prefixes
        ), node AS (
            SELECT node AS conv_id, d AS depth, count(*) AS n_convs, max(words) AS words,
                sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
            FROM member GROUP BY node, d
        ), linked AS (
            SELECT n.*, m.node AS parent_conv_id FROM node n LEFT JOIN member m ON m.conv_id = n.conv_id AND m.d = n.depth - 1
        ), counted AS (
            SELECT l.*, coalesce(k.n, 0) AS n_children FROM linked l LEFT JOIN (
                SELECT parent_conv_id, depth - 1 AS depth, count(*) AS n FROM linked WHERE depth > 0 GROUP BY ALL
            ) k ON k.parent_conv_id = l.conv_id AND k.depth = l.depth
        ), below AS (
            SELECT m.node, m.d, sum((c.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((c.n_convs - 1) * c.words)::BIGINT AS saved_tokens
            FROM counted c JOIN member m ON m.conv_id = c.conv_id AND m.d <= c.depth GROUP BY ALL
        )
        SELECT c.conv_id, c.depth, c.parent_conv_id, c.n_convs, c.n_children, b.n_leaves, b.saved_tokens, c.ends_sha256
        FROM counted c JOIN below b ON b.node = c.conv_id AND b.d = c.depth""",
}
