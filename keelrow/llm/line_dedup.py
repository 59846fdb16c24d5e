"""Line dedup: documents keep a repeated line only where its first holder has it.

Lines are keyed by their stripped, lower-cased text through a 128-bit hash.  The distinct shared
keys are dealt into shards; each shard is a minimal perfect hash over its keys with three arrays:
fingerprint, number of holders, smallest holder.  Documents probe the arrays: the hashes of their
lines go to the shard (a few bytes a line, never the text), each is looked up by position, and only
lines to drop come back.  A shard that is asked very often - a line that a third of all documents
hold - is copied to as many groups as its probes fill, so no group grows with a hot line.

Defined results: null text is one empty line; a null id is one document after all others; repeated
rows of an id are one holder and all lose the same lines; a very long text is one row of line hashes, its lines are
kept in order; own columns named ``n_lines`` or ``n_dropped`` are replaced, all other names stay; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelrow.llm.perfect_hash import build, slots
from keelrow.llm.common import (
    ID, LAST_ID, ROW, TEXT, Batches, carried, in_pieces, longs, shuffle_partitions, uncarried, utf8, with_row,
)
from keelrow.session import cut_lineage

MIN_CHARS = 10
# probes of one group, at least; a group is what one call of the lookup holds
_GROUP_ROWS = 1024
_HASHED = "__id long, hi long, lo long"
_ARRAYS = "shard long, sizes binary, words binary, fingerprints binary, holders binary, first binary"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line; None if it is too short to count."""
    key = line.strip().lower()  # of bytes: ASCII white space and A-Z only
    if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
        return key
    return None


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _line_hashes(min_chars: int):
    def hashes(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests, counts = batch.column(0), [], []
            for text in utf8(batch.column(1)):
                own = {_digest(k) for line in text.split(b"\n") if (k := line_key(line, min_chars)) is not None}
                digests.extend(own)
                counts.append(len(own))
            pairs = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            yield from in_pieces({
                "__id": pa.array(np.repeat(longs(ids), counts)), "hi": pa.array(pairs[:, 0]), "lo": pa.array(pairs[:, 1]),
            })
    return hashes


def _build_shard(table: pa.Table) -> pa.Table:
    high, low = (longs(table.column(c).combine_chunks()).view(np.uint64) for c in ("hi", "lo"))
    sizes, words = build(high, low)
    at = slots(sizes, words, high, low)
    fingerprints, holders, first = (np.zeros(len(at), np.int64) for _ in range(3))
    fingerprints[at] = low.view(np.int64)
    holders[at] = longs(table.column("holders").combine_chunks())
    first[at] = longs(table.column("first").combine_chunks())
    return pa.table({
        "shard": table.column("shard").slice(0, 1),
        **{name: pa.array([values.tobytes()], pa.binary()) for name, values in (
            ("sizes", sizes), ("words", words), ("fingerprints", fingerprints), ("holders", holders), ("first", first))},
    })


def _probe(probes: pa.Table, arrays: pa.Table) -> pa.Table:
    """The probes whose line is shared and belongs to another document."""
    if not (probes.num_rows and arrays.num_rows):
        return probes.select(["__id", "hi", "lo"]).slice(0, 0)
    array = {
        name: np.frombuffer(arrays.column(name)[0].as_py(), np.uint64 if name == "words" else np.int64)
        for name in ("sizes", "words", "fingerprints", "holders", "first")
    }
    high, low, ids = (longs(probes.column(c).combine_chunks()) for c in ("hi", "lo", "__id"))
    at = slots(array["sizes"], array["words"], high.view(np.uint64), low.view(np.uint64))
    drop = (at >= 0) & (array["fingerprints"][at] == low) & (array["first"][at] != ids)
    return probes.select(["__id", "hi", "lo"]).filter(pa.array(drop))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``__id, hi, lo`` of each line that a document has to drop."""
    hashed = cut_lineage(
        docs.select(
            F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)).alias(ID),
            F.col(f"`{text_col}`").cast("string").alias(TEXT),
        ).mapInArrow(_line_hashes(min_chars), _HASHED)
    )
    shards = 4 * shuffle_partitions(docs)
    rows = hashed.count()
    # as many groups as shards, and of one size: the total over the shards, so it falls with more partitions
    group_rows = max(_GROUP_ROWS, -(-rows // shards))
    probes = hashed.withColumn("shard", F.pmod("hi", F.lit(shards)))
    # one row a shard: its size is set by the number of partitions, not by the data
    copies = cut_lineage(
        probes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / group_rows).cast("int").alias("copies"))
    )
    shared = (
        hashed.groupBy("hi", "lo").agg(F.min(ID).alias("first"), F.max(ID).alias("last"), F.count(F.lit(1)).alias("holders"))
        .filter("first < last").withColumn("shard", F.pmod("hi", F.lit(shards)))
    )
    arrays = (
        shared.select("shard", "hi", "lo", "first", "holders").groupBy("shard").applyInArrow(_build_shard, _ARRAYS)
        .join(F.broadcast(copies), "shard")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    )
    dealt = probes.join(F.broadcast(copies), "shard").withColumn(
        "copy", F.pmod(F.xxhash64("lo", ID), F.col("copies")).cast("int")).drop("copies")
    return dealt.groupBy("shard", "copy").cogroup(arrays.groupBy("shard", "copy")).applyInArrow(_probe, _HASHED)


def _kept_lines(min_chars: int):
    def kept(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drops in zip(utf8(batch.column("__text")), batch.column("drops").to_pylist()):
                lines = text.split(b"\n")
                left = lines
                if drops:
                    drops = set(drops)
                    left = [x for x in lines if (k := line_key(x, min_chars)) is None or _digest(k) not in drops]
                texts.append(b"\n".join(left))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
            yield pa.RecordBatch.from_arrays([
                batch.column("__row"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()),
                pa.array(n_dropped, pa.int64()),
            ], ["__row", "__text", "n_lines", "n_dropped"])
    return kept


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS
) -> DataFrame:
    """The documents with the text that is left, ``n_lines`` before and ``n_dropped``."""
    def bits(name: str):
        return F.lpad(F.hex(name), 16, "0")

    drops = (
        repeated_lines(docs, id_col, text_col, min_chars)
        .select(F.col(ID).alias("__drop_id"), F.unhex(F.concat(bits("hi"), bits("lo"))).alias("drop"))
        # the lines of one document
        .groupBy("__drop_id").agg(F.collect_list("drop").alias("drops"))
    )
    rows = carried(docs, id_col, text_col)
    kept = rows.join(drops, F.coalesce(F.col(ID), F.lit(LAST_ID)) == F.col("__drop_id"), "left").select(ROW, TEXT, "drops")
    done = kept.mapInArrow(_kept_lines(min_chars), with_row(rows, f"{TEXT} string, n_lines long, n_dropped long"))
    return uncarried(done, docs, text_col, F.col(TEXT), {"n_lines": F.col("n_lines"), "n_dropped": F.col("n_dropped")})
