"""Benchmark decontamination: SimHash over item-sized windows, multi-index Hamming search, exact check.

1. A window of an item's size can only reach the similarity if it shares a shingle with an item, so
   the shingles of the texts are looked up in the items' and each hit gives the window at its offset.
   Nothing is lost by that.  Windows with the same words are one content from here on.
2. Each content and each item gets a SimHash of its weighted shingles (weight: occurrences times the
   inverse document frequency among the items).  Bits are drawn with the *roots* of the weights: the
   expected distance then follows the weighted similarity itself, however unequal the weights are.
3. Fingerprints are cut into blocks.  Two that differ in at most ``RADIUS`` bits differ in at most
   RADIUS // BLOCKS bits in one block, so items are listed under all values that near in each block, and
   contents look up their own values: every fingerprint of the same size within the radius is found.
   The radius lies over three standard deviations above the distance expected at the similarity (9.7
   bits of 64 at 0.8): 0.1 % of the windows exactly at the similarity lie beyond it, fewer above.
4. Candidates are verified by the exact weighted Jaccard similarity of their shingles.

Only DataFrame functions are used.  The benchmark is joined, not collected; Spark broadcasts its
shingles only below its own size limit.  Shingles take five words, or all words of a shorter item.

Defined results: null and empty texts, and items without words, match nothing; repeated rows are found
once; a null id stays null; without items or documents nothing is found; very long texts are cut into windows
where they share a shingle, whole; equal similarities are all found; other columns play no role, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelrow.llm.quality_rules import bound
from keelrow.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
BITS, BLOCKS, RADIUS = 64, 8, 19
_WIDTH = BITS // BLOCKS
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-case words: ASCII letters and digits, and all other characters beyond ASCII."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SEPARATORS), lambda w: w != "")


def _shingles(words: Column, width: Column | int) -> Column:
    """Hashes of all shingles, in order."""
    n, width = F.size(words), width if isinstance(width, Column) else F.lit(width)
    return F.when(n >= width, F.transform(
        F.sequence(F.lit(1), n - width + 1), lambda i: F.xxhash64(F.slice(words, i, width)))
    ).otherwise(F.array().cast("array<long>"))


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))


def _postings(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id, n, width, at, h, idf``: the shingles of the items with their places and weights."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), words_of(F.col(text_col)).alias("w"))
    sized = rows.select("item_id", "w", F.size("w").alias("n")).filter("n > 0").withColumn("width", F.least(F.lit(SHINGLE), "n"))
    listed = cut_lineage(sized.select("item_id", "n", "width", F.posexplode(_shingles(F.col("w"), F.col("width"))).alias("at", "h")))
    total = listed.select("item_id").distinct().count()
    idf = listed.groupBy("width", "h").agg(F.log(1 + F.lit(total) / F.count_distinct("item_id")).alias("idf"))
    return cut_lineage(listed.join(idf, ["width", "h"]))


def _weighted(shingles: DataFrame, by: list[str]) -> DataFrame:
    """Of rows ``by..., h, idf``: the shingles of each with their weights, and the fingerprint."""
    weights = shingles.groupBy(*by, "h").agg((F.count(F.lit(1)) * F.max("idf")).alias("weight"))
    bits = [
        F.when(F.sum(F.when(F.shiftright("h", b).bitwiseAND(F.lit(1)) == 1, F.sqrt("weight")).otherwise(-F.sqrt("weight"))) > 0,
               F.lit(-(1 << 63) if b == 63 else 1 << b)).otherwise(F.lit(0)).cast("long") for b in range(BITS)
    ]
    sums = [b.alias(f"b{i}") for i, b in enumerate(bits)]
    rows = weights.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("h", "weight"))).alias("shingles"), *sums)
    folded = F.col("b0")
    for i in range(1, BITS):
        folded = folded.bitwiseOR(F.col(f"b{i}"))
    return rows.select(*by, "shingles", folded.alias("fp"))


def _block(i: int) -> Column:
    return F.shiftrightunsigned("fp", _WIDTH * i).bitwiseAND(F.lit((1 << _WIDTH) - 1)).cast("int")


def _near_values() -> list[int]:
    """All masks of a block with at most RADIUS // BLOCKS bits."""
    return [sum(1 << b for b in flips) for k in range(RADIUS // BLOCKS + 1) for flips in combinations(range(_WIDTH), k)]


def _similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two lists of (h, weight)."""
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, y: s + y["weight"])

    shared = bound(F.map_from_entries(b), lambda m: F.aggregate(
        a, F.lit(0.0), lambda s, x: s + F.least(x["weight"], F.coalesce(F.element_at(m, x["h"]), F.lit(0.0)))))
    return bound(shared, lambda s: s / (total(a) + total(b) - s))


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY,
) -> DataFrame:
    """``__key, __id, item_id, start, n, similarity``: windows of documents that repeat an item.

    ``__key`` marks the document's row (its id and text), ``start`` is the first word, from 0.
    """
    postings = _postings(benchmark, item_id_col, item_text_col)
    widths = [r[0] for r in postings.select("width").distinct().collect()]  # 1 to 5
    keyed = docs.select(
        _key(id_col, text_col).alias("__key"), F.col(f"`{id_col}`").cast("long").alias("__id"),
        F.col(f"`{text_col}`").cast("string").alias("__text"))
    hashed = bound(words_of(F.col("__text")), lambda w: F.array(*(
        F.struct(F.lit(width).alias("width"), _shingles(w, width).alias("hs")) for width in widths or [SHINGLE])))
    hits = (
        keyed.select("__key", F.explode(hashed).alias("x"))
        .select("__key", F.col("x.width").alias("width"), F.posexplode("x.hs").alias("p", "h"))
        # a shingle that many items have at one place, as in a form, is one window there
        .join(cut_lineage(postings.select("width", "h", "n", "at").distinct()), ["width", "h"])
        .select("__key", "n", F.greatest(F.col("p") - F.col("at"), F.lit(0)).alias("start")).distinct()
    )
    # the windows of one document: not more than it has words for each size of item
    windows = cut_lineage(hits.groupBy("__key").agg(F.collect_list(F.struct("n", "start")).alias("windows")))
    cut = keyed.join(windows, "__key").select(
        "__key", "__id", words_of(F.col("__text")).alias("words"), "windows")
    sliced = cut.select("__key", "__id", F.explode(bound(F.col("words"), lambda words: F.transform("windows", lambda x: F.struct(
        x["n"].alias("n"), x["start"].alias("start"), F.slice(words, x["start"] + 1, x["n"]).alias("words"))))).alias("x"))
    found = cut_lineage(sliced.select(
        "__key", "__id", F.col("x.n").alias("n"), F.col("x.start").alias("start"), F.col("x.words").alias("words"),
        F.xxhash64("x.n", "x.words").alias("content")).distinct())
    contents = found.groupBy("content", "n").agg(F.max(F.array_join("words", " ")).alias("words"))
    idf = postings.groupBy("width", "h").agg(F.max("idf").alias("idf"))
    rarest = postings.agg(F.max("idf")).first()[0] or 0.0
    content_shingles = contents.withColumn("width", F.least(F.lit(SHINGLE), "n")).select(
        "content", "n", "width", F.explode(_shingles(F.split("words", " "), F.col("width"))).alias("h")
    ).join(idf, ["width", "h"], "left").withColumn("idf", F.coalesce("idf", F.lit(rarest)))
    probes = _weighted(content_shingles, ["content", "n"]).select(
        "content", "n", "fp", "shingles",
        F.explode(F.array(*(F.struct(F.lit(i).alias("block"), _block(i).alias("value")) for i in range(BLOCKS)))).alias("b")
    ).select("content", "n", F.col("fp").alias("probe"), F.col("shingles").alias("own"), "b.block", "b.value")
    masks = F.array(*(F.lit(m) for m in _near_values()))
    index = _weighted(postings, ["item_id", "n"]).select(
        "item_id", "n", "fp", "shingles",
        F.explode(F.array(*(F.struct(F.lit(i).alias("block"), _block(i).alias("value")) for i in range(BLOCKS)))).alias("b")
    ).select("item_id", "n", "fp", "shingles", "b.block", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("b.value")))).alias("value"))
    near = probes.join(cut_lineage(index), ["n", "block", "value"]).filter(
        F.bit_count(F.col("probe").bitwiseXOR(F.col("fp"))) <= RADIUS)
    # a pair that meets in several blocks is checked once
    once = near.groupBy("content", "item_id").agg(F.first("own").alias("own"), F.first("shingles").alias("shingles"))
    same = cut_lineage(
        once.select("content", "item_id", _similarity(F.col("own"), F.col("shingles")).alias("similarity"))
        .filter(F.col("similarity") >= similarity - 1e-9)
    )
    return found.join(same, "content").select("__key", "__id", "item_id", "start", "n", "similarity")


def leaking_items(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each document and item: places, the first word of the first, the best similarity."""
    return leaks(docs, benchmark, **options).groupBy(F.col("__id").alias("doc_id"), "item_id").agg(
        F.count_distinct("start").alias("n_windows"), F.min("start").alias("first_word"),
        F.max("similarity").alias("similarity"))


def drop_leaking(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without any window that repeats an item."""
    found = cut_lineage(leaks(docs, benchmark, id_col, text_col, **options).select(F.col("__key").alias("__leak")).distinct())
    return docs.join(found, _key(id_col, text_col) == F.col("__leak"), "left_anti")
