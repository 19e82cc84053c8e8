"""Exact de-duplication (operator 9) with counting quotient filters.

1. Each input partition hashes its whitespace-normalised texts and builds a counting
   quotient filter: a fingerprint is split into quotient and remainder; remainders are
   kept sorted in runs, one run per occupied quotient, each with its count.
2. Filters are cut into blocks of neighbouring quotients, blocks meet in a shuffle and
   merge without loss by their sorted remainders (a hot text is one entry per partition).
3. Fingerprints counted more than once route their texts, and only those, to byte
   verification: an aggregation on the normalised text itself with map-side combine.

Defined results: a NULL text counts as empty; empty texts are equal to each other. A NULL
``doc_id`` sorts after every other id. Of rows that repeat both id and text, one stays.
An empty table gives an empty result. Other columns are ignored by :func:`decisions` and
carried along by :func:`drop_copies`.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_filter, id_text, in_filter, map_texts, written

QUOTIENT_BITS = 10  # quotients of a block: 1024
ENTRIES_PER_BLOCK = 1 << 15
BLOCK_SCHEMA = "block bigint, occupied binary, run_ends binary, remainders binary, counts binary"


def normalise(text: bytes) -> bytes:
    """Each run of space, tab, LF, VT, FF, CR becomes one space (at the ends too)."""
    words = text.split()
    if not words:
        return text and b" "
    return b" " * text[:1].isspace() + b" ".join(words) + b" " * text[-1:].isspace()


def fingerprint(norm: bytes) -> int:
    return xxhash.xxh64_intdigest(norm)


# --- counting quotient filter ------------------------------------------------

def build_blocks(prints: np.ndarray, counts: np.ndarray, block_bits: int):
    """Blocks ``(block, occupied, run_ends, remainders, counts)`` of a filter over sorted,
    distinct unsigned fingerprints and their counts."""
    rem_bits = np.uint64(64 - block_bits - QUOTIENT_BITS)
    blocks = prints >> np.uint64(64 - block_bits)
    starts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]) if len(prints) else []
    for s, e in zip(starts, [*starts[1:], len(prints)]):
        p = prints[s:e]
        q = (p >> rem_bits) & np.uint64((1 << QUOTIENT_BITS) - 1)
        occupied = np.zeros(1 << QUOTIENT_BITS, bool)
        occupied[q.astype(np.int64)] = True
        run_ends = np.r_[q[1:] != q[:-1], True]
        yield (int(blocks[s]), np.packbits(occupied).tobytes(), np.packbits(run_ends).tobytes(),
               (p & ((np.uint64(1) << rem_bits) - np.uint64(1))).tobytes(), counts[s:e].astype(np.int64).tobytes())


def read_block(block: int, occupied: bytes, run_ends: bytes, remainders: bytes, counts: bytes, block_bits: int):
    """The sorted fingerprints and counts that a block holds."""
    rem = np.frombuffer(remainders, np.uint64)
    ends = np.unpackbits(np.frombuffer(run_ends, np.uint8))[:len(rem)].astype(np.int64)
    run = np.cumsum(ends) - ends
    q = np.flatnonzero(np.unpackbits(np.frombuffer(occupied, np.uint8)))[run].astype(np.uint64)
    rem_bits = np.uint64(64 - block_bits - QUOTIENT_BITS)
    high = np.uint64(block) << np.uint64(64 - block_bits)
    return high | (q << rem_bits) | rem, np.frombuffer(counts, np.int64)


def merge(parts) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted ``(fingerprints, counts)`` parts, adding the counts of equal ones."""
    prints = np.concatenate([p for p, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(prints, kind="stable")  # a merge of sorted runs
    prints, counts = prints[order], counts[order]
    starts = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]])
    return prints[starts], np.add.reduceat(counts, starts)


def partition_filters(docs: DataFrame, block_bits: int) -> DataFrame:
    """One filter per input partition, as rows of blocks."""
    def run(batches):
        seen = []
        for b in batches:
            seen.append(np.array([fingerprint(normalise(t)) for t in b.column(0).cast(pa.binary()).to_pylist()], np.uint64))
        if seen:
            prints, counts = np.unique(np.concatenate(seen), return_counts=True)
            rows = list(build_blocks(prints, counts, block_bits))
            for i in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows[i:i + 256]), [pa.int64()] + [pa.binary()] * 4)],
                    names=["block", "occupied", "run_ends", "remainders", "counts"])
    return id_text(docs).select("text").mapInArrow(run, BLOCK_SCHEMA)


def repeated_fingerprints(filters: DataFrame, block_bits: int) -> DataFrame:
    """Merge all partitions' filters block by block; ``h``: fingerprints counted over once."""
    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        prints, counts = merge([read_block(*r, block_bits) for r in pdf.itertuples(index=False)])
        return pd.DataFrame({"h": prints[counts > 1].view(np.int64)})
    return filters.groupBy("block").applyInPandas(merged, "h bigint")


def duplicate_filter(spark: SparkSession, docs: DataFrame) -> np.ndarray:
    """The bounded bit filter of all fingerprints that occur more than once."""
    n = docs.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block_bits = min(20, max(1, math.ceil(math.log2(max(n / ENTRIES_PER_BLOCK, 2 * parts)))))
    h = written(spark, repeated_fingerprints(partition_filters(docs, block_bits), block_bits), "repeated")
    return bit_filter(h, h.count())


# --- routing to byte verification ---------------------------------------------

def digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, text_sha256, norm``; ``norm`` (the normalised text) only where the
    fingerprint may be repeated, NULL for texts proven unique."""
    filt = spark.sparkContext.broadcast(duplicate_filter(spark, docs))

    def per_batch(ids, texts):
        norm = [normalise(t) for t in texts]
        maybe = in_filter(filt.value, np.array([fingerprint(x) for x in norm], np.uint64))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([hashlib.sha256(x).hexdigest() for x in norm]),
             pa.array([x if m else None for x, m in zip(norm, maybe)], pa.binary()).cast(pa.string())],
            names=["doc_id", "text_sha256", "norm"])
    return map_texts(id_text(docs), per_batch, "doc_id bigint, text_sha256 string, norm string")


def decisions(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row."""
    d = written(spark, digests(spark, docs).withColumn("row", F.monotonically_increasing_id()), "digests")
    # Byte verification: the texts themselves are the grouping key.
    same = d.where("norm IS NOT NULL").groupBy("text_sha256", "norm").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # One text per digest from here on; anything else must fail, not merge.
    # A table of its own, so that the join below deals both sides anew and a hot digest's rows
    # can be split over tasks.
    groups = written(spark, same.groupBy("text_sha256").agg(
        F.when(F.count("*") == 1, F.min("keep_id")).otherwise(
            F.raise_error(F.lit("different texts share a SHA-256 digest")).cast("bigint")).alias("keep_id"),
        F.min("group_size").alias("group_size")), "groups")
    # Rows may share an id and a text: the first in the written table stays.
    rows = d.where("norm IS NOT NULL").select("doc_id", "text_sha256", "row")
    first = rows.join(groups, "text_sha256").where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("text_sha256").agg(F.min("row").alias("first"))
    keepers = written(spark, groups.join(first, "text_sha256"), "keepers")
    routed = rows.join(keepers, "text_sha256").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("first")).alias("kept"), "text_sha256")
    unique = d.where("norm IS NULL").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    return unique.unionByName(routed)


def drop_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one row left of each group of equal texts (the smallest ``doc_id``).
    Rows whose text is proven unique pass without a shuffle."""
    filt = spark.sparkContext.broadcast(duplicate_filter(spark, docs))

    @F.pandas_udf("string")
    def shared_text(texts: pd.Series) -> pd.Series:
        norm = [normalise(t.encode()) for t in texts]
        maybe = in_filter(filt.value, np.array([fingerprint(x) for x in norm], np.uint64))
        return pd.Series([x.decode() if m else None for x, m in zip(norm, maybe)], dtype=object)

    cols = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in cols])
    marked = docs.select(row.alias("row"), shared_text(F.coalesce(F.col("text"), F.lit(""))).alias("norm"))
    unique = marked.where("norm IS NULL").select("row.*")
    kept = (marked.where("norm IS NOT NULL").groupBy("norm")
            .agg(F.min_by("row", F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"))).alias("row"))
            .select("row.*"))
    return unique.unionByName(kept)
