"""Exact duplicates by a two-pass Bloom filter.

Pass one reads a 64-bit hash of each text and marks filter slots hit once and
hit twice or more. Slots meet by segment, as lists of two-byte numbers, so a
row costs about four bytes there, and a text with any number of copies costs
one entry a task. Pass two asks the filter about each row: a row with a slot
that was hit once only has no copy and passes straight through; the others are
grouped by SHA-256, which decides alone what is equal.

The filter is broadcast. Its size follows the rows up to ``max_filter_bytes``
(a proven bound); with more rows it lets more unique rows into the grouping,
which costs time and never changes a result.

Defined results: null text counts as empty; of rows equal in text and doc_id one
stays; a null doc_id is below all others; an empty table gives an empty table;
other columns are ignored by ``decisions`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazlens.llm import scratch

SEGMENT_SLOTS = 1 << 15
SLOTS_PER_ROW = 16
MAX_FILTER_BYTES = 64 << 20
#: A group is hot with over 1/HOT_SHARE of the rows, so there are fewer than HOT_SHARE of them.
HOT_SHARE = 500


def _slots(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = hashes.view(np.uint64)
    low = (h & np.uint64(SEGMENT_SLOTS - 1)).astype(np.int64)
    high = ((h >> np.uint64(15)) & np.uint64(SEGMENT_SLOTS - 1)).astype(np.int64)
    return ((h >> np.uint64(30)) % np.uint64(segments)).astype(np.int64), low, high


def _hits(segments: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            segment, low, high = _slots(h, segments)
            # the two slots of one hash can be the same slot; it is then one hit
            slot = np.concatenate([segment * SEGMENT_SLOTS + low, (segment * SEGMENT_SLOTS + high)[low != high]])
            times = np.concatenate([n, n[low != high]])
            slot, back = np.unique(slot, return_inverse=True)
            twice = np.bincount(back, weights=times, minlength=len(slot)) > 1
            at = slot // SEGMENT_SLOTS
            cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, int)
            rows = [(int(at[a]), (slot[a:b] % SEGMENT_SLOTS).astype("<u2").tobytes(), np.packbits(twice[a:b]).tobytes()) for a, b in zip(cuts, np.append(cuts[1:], len(at)))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["segment", "slots", "twice"])

    return work


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    count = np.zeros(SEGMENT_SLOTS, np.int64)
    for slots, twice in zip(rows["slots"], rows["twice"]):
        at = np.frombuffer(slots, "<u2")
        count[at] += 1 + np.unpackbits(np.frombuffer(twice, np.uint8), count=len(at))
    return pd.DataFrame({"segment": [rows["segment"].iloc[0]], "bits": [np.packbits(count > 1).tobytes()]})


#: Rows of one doc_id and text that are written by one task.
COPIES = 100_000


def repeat_filter(hashes: DataFrame, rows: int, max_filter_bytes: int = MAX_FILTER_BYTES) -> tuple[int, np.ndarray]:
    """Segments, and the packed bits of the slots that were hit more than once, from a column of hashes."""
    segments = max(1, min(-(-rows * SLOTS_PER_ROW // SEGMENT_SLOTS), max_filter_bytes * 8 // SEGMENT_SLOTS))
    hit = hashes.mapInArrow(_hits(segments), "segment long, slots binary, twice binary")
    merged = hit.groupBy("segment").applyInPandas(_merge, "segment long, bits binary").toArrow()
    bits = np.zeros((segments, SEGMENT_SLOTS // 8), np.uint8)
    for segment, packed in zip(merged.column(0).to_pylist(), merged.column(1).to_pylist()):
        bits[segment] = np.frombuffer(packed, np.uint8)
    return segments, bits


def _marked(segments: int, bits):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            at, low, high = _slots(batch.column("h").to_numpy(zero_copy_only=False), segments)
            maybe = ((table[at, low >> 3] >> (7 - (low & 7)).astype(np.uint8)) & (table[at, high >> 3] >> (7 - (high & 7)).astype(np.uint8)) & 1).astype(bool)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_sha256"), pa.array(maybe)], ["doc_id", "text_sha256", "maybe"])

    return work


def decisions(docs: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.count()
    segments, bits = repeat_filter(docs.select(F.xxhash64(text).alias("h")), rows, max_filter_bytes)
    shared = spark.sparkContext.broadcast(bits)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"), F.xxhash64(text).alias("h"))
    marked = scratch.written(marked.mapInArrow(_marked(segments, shared), "doc_id long, text_sha256 string, maybe boolean"), "exact-marked")

    alone = marked.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    # rows equal in both columns become one row with a count, so that one of them can stay
    members = scratch.written(marked.where("maybe").groupBy("text_sha256", "doc_id").agg(F.count("*").alias("n")), "exact-members")
    groups = scratch.written(members.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")), "exact-groups")
    hot = groups.where(F.col("group_size") > max(1000, rows // HOT_SHARE))
    large = members.join(F.broadcast(hot), "text_sha256")
    small = members.join(F.broadcast(hot.select("text_sha256")), "text_sha256", "left_anti").join(groups, "text_sha256")
    met = large.unionByName(small)
    listed = met.where(F.col("n") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    # very many rows of one doc_id and text are dealt over tasks in runs of ``COPIES``
    run = met.where(F.col("n") > COPIES).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))).repartition("text_sha256", "doc_id", "run")
    dealt = run.withColumn("copy", F.explode(F.sequence(F.col("run") * COPIES + 1, F.least(F.col("n"), (F.col("run") + 1) * COPIES)))).drop("run")
    grouped = listed.unionByName(dealt)
    return alone.unionByName(
        grouped.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
    )


def deduplicate(docs: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """The rows that stay, with all their columns. Rows equal in doc_id and text become one of them."""
    # one key for the join and for equal rows, so that texts are exchanged once
    key = lambda sha: F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")), F.lit(":"), sha)
    out = decisions(docs, max_filter_bytes).where("kept").select(key(F.col("text_sha256")).alias("__key"))
    kept = docs.withColumn("__key", key(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))).join(out, "__key", "left_semi")
    return kept.dropDuplicates(["__key"]).drop("__key")
