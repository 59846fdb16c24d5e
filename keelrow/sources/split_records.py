"""Records of large text files that lines alone do not tell apart, read by many tasks.

A file is read in blocks, each cut at every separator (a line break in CSV, a closing brace in JSON).  Whether a
piece begins inside quotes or inside an object depends on everything before it, but only through two numbers.  Each block sums
up its own; the sums of one row per block are added up over the file; within a block they are added up piece by
piece.  Pieces that are a record by themselves stay where they are; only those of longer records are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelrow.session import cut_lineage

_PLACE = ("file", "block")


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``file, block, n, value``: the pieces of each block in order.  A piece belongs to the block it begins in."""
    read = spark.read.option("lineSep", separator).text(path)
    return read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"), F.col("_metadata.file_size").alias("file_size"), "value")


def _before(rows: bool) -> Window:
    """All that precedes: within the block, piece by piece, or within the file, block by block."""
    keys = [*_PLACE] if rows else ["file"]
    return Window.partitionBy(*keys).orderBy("n" if rows else "block").rowsBetween(Window.unboundedPreceding, -1)


def _sum_before(column: str, rows: bool) -> Column:
    return F.coalesce(F.sum(column).over(_before(rows)), F.lit(0))


def _occurrences(text: Column, what: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(what), F.lit("")))


def _gathered(flagged: DataFrame, separator: str) -> DataFrame:
    """``file, first, record, ended``: flagged pieces (``starts, ends``) as records.

    ``first`` marks the first record of a file.  A record that begins in one block goes on in the next ones.  Pieces are
    put together within their block, where they lie; only the ends of blocks are moved for records that cross them.
    """
    up_to = Window.partitionBy(*_PLACE).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    numbered = flagged.withColumn("seq", F.sum(F.col("starts").cast("long")).over(up_to))
    ordered = F.sort_array(F.collect_list(F.struct("n", "value")))
    held = cut_lineage(numbered.groupBy(*_PLACE, "seq").agg(ordered.alias("t"), F.bool_or("ends").alias("ended")).select(
        *_PLACE, "seq", F.array_join("t.value", separator).alias("value"), "ended"))
    whole = held.filter("seq > 0 AND ended").select(
        "file", ((F.col("block") == 0) & (F.col("seq") == 1)).alias("first"), F.col("value").alias("record"), "ended")
    # where the record began that is open at the start of a block: one row a block
    last = F.struct("block", F.col("seq"))
    open_ = held.groupBy(*_PLACE).agg(F.max("seq").alias("seq")).withColumn(
        "from", F.last(F.when(F.col("seq") > 0, last), ignorenulls=True).over(_before(False))).select(*_PLACE, "from")
    parts = held.filter("NOT (seq > 0 AND ended)")
    own = parts.filter("seq > 0").select("*", F.col("block").alias("from_block"), F.col("seq").alias("from_seq"))
    carried = parts.filter("seq = 0").join(open_, [*_PLACE]).select(
        *parts.columns, F.col("from.block").alias("from_block"), F.col("from.seq").alias("from_seq"))
    over = F.sort_array(F.collect_list(F.struct("block", "value")))
    joined = own.unionByName(carried).groupBy("file", "from_block", "from_seq").agg(over.alias("t"), F.bool_or("ended").alias("ended"))
    return whole.unionByName(joined.select(
        "file", ((F.col("from_block") == 0) & (F.col("from_seq") == 1)).alias("first"),
        F.array_join("t.value", separator).alias("record"), "ended"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, first, record``: records of CSV files; a line break between quotes does not end one.

    Every quote opens or closes, a doubled one does both; blank lines are left out.
    """
    lines = _pieces(spark, path, "\n").withColumn("quotes", _occurrences(F.col("value"), '"'))
    blocks = lines.groupBy(*_PLACE).agg(F.sum("quotes").alias("quotes"))
    blocks = cut_lineage(blocks.withColumn("before", _sum_before("quotes", False)).select(*_PLACE, "before"))
    counted = lines.join(blocks, [*_PLACE]).withColumn("open", F.col("before") + _sum_before("quotes", True))
    flagged = counted.select(
        *_PLACE, "n", "value", (F.col("open") % 2 == 0).alias("starts"), ((F.col("open") + F.col("quotes")) % 2 == 0).alias("ends"))
    records = _gathered(flagged, "\n").withColumn("record", F.regexp_replace("record", "\r$", ""))
    return records.filter("record <> ''").select("file", "first", "record")


_STRING = '"[^"]*("|$)'


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, record``: the objects of files that are one JSON array each, as they came.

    What stands between two objects belongs to the one after it, so an element that is no object spoils that one.
    """
    pieces = _pieces(spark, path, "}").withColumn("bare", F.regexp_replace("value", r"(?s)\\.", ""))
    # what lies outside strings, if the piece begins outside one or inside
    outside = F.regexp_replace("bare", _STRING, "")
    inside = F.regexp_replace(F.regexp_replace("bare", '^[^"]*("|$)', ""), _STRING, "")

    def depth(text: Column) -> Column:
        return F.char_length(F.regexp_replace(text, r"[^{\[]", "")) - F.char_length(F.regexp_replace(text, r"[^\]]", ""))

    measured = pieces.select(
        *_PLACE, "n", "value", "file_size", _occurrences(F.col("bare"), '"').alias("quotes"), depth(outside).alias("deep_out"),
        depth(inside).alias("deep_in"), F.octet_length("value").cast("long").alias("bytes"))
    measured = cut_lineage(measured)
    # the last piece of a file has no brace behind it, unless the sizes say so
    ends = measured.groupBy("file").agg(
        F.max(F.struct("block", "n")).alias("last"), (F.sum("bytes") + F.count(F.lit(1)) > F.max("file_size")).alias("bare_end"))
    measured = measured.join(ends, "file").withColumn(
        "closed", ~(F.col("bare_end") & (F.struct("block", "n") == F.col("last"))))
    counted = measured.withColumn("in_block", _sum_before("quotes", True))
    # a block's depth, if it begins outside a string or inside
    even = F.col("in_block") % 2 == 0
    shut = (F.col("in_block") + F.col("quotes")) % 2 == 0

    def with_brace(is_out: Column, ends_out: Column) -> Column:
        return F.when(is_out, F.col("deep_out")).otherwise(F.col("deep_in")) - F.when(ends_out & F.col("closed"), 1).otherwise(0)

    counted = cut_lineage(counted.select(
        *_PLACE, "n", "value", "closed", "in_block", "quotes", with_brace(even, shut).alias("step_out"), with_brace(~even, ~shut).alias("step_in")))
    blocks = counted.groupBy(*_PLACE).agg(
        F.sum("quotes").alias("quotes"), F.sum("step_out").alias("step_out"), F.sum("step_in").alias("step_in"))
    blocks = blocks.withColumn("quotes_before", _sum_before("quotes", False)).withColumn(
        "step", F.when(F.col("quotes_before") % 2 == 0, F.col("step_out")).otherwise(F.col("step_in")))
    blocks = cut_lineage(blocks.withColumn("depth_before", _sum_before("step", False)).select(*_PLACE, "quotes_before", "depth_before"))
    placed = counted.join(blocks, [*_PLACE]).withColumn(
        "step", F.when(F.col("quotes_before") % 2 == 0, F.col("step_out")).otherwise(F.col("step_in"))).withColumn(
        "depth", F.col("depth_before") + _sum_before("step", True)).withColumn("open", F.col("quotes_before") + F.col("in_block"))
    flagged = placed.select(
        *_PLACE, "n", "value", ((F.col("open") % 2 == 0) & (F.col("depth") <= 1)).alias("starts"),
        (F.col("closed") & ((F.col("open") + F.col("quotes")) % 2 == 0) & (F.col("depth") + F.col("step") <= 1)).alias("ends"))
    records = _gathered(flagged, "}")
    text = F.regexp_replace(F.concat("record", F.when(F.col("ended"), "}").otherwise("")), r"^\s*[\[,]?\s*", "")
    return records.select("file", text.alias("record")).filter(~F.col("record").rlike(r"^\]?\s*$"))
