"""Small helpers shared by the training-data operators.

Input convention: an operator reads ``doc_id`` and ``text`` from ``docs`` and
ignores every other column, whatever its name. A NULL text counts as empty.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# Bits of the largest bit filter that is broadcast: 2**27 bits are 16 MB, whatever the input.
MAX_FILTER_BITS = 27


def id_text(docs: DataFrame) -> DataFrame:
    """``(doc_id bigint, text string)`` with NULL texts as empty ones."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: lineage ends here, and every
    executor (a replacement of a lost one too) can read it. It goes when the driver's Python ends."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_texts(df: DataFrame, per_batch: Callable, schema: str, *, binary: bool = True,
              finish: Callable | None = None) -> DataFrame:
    """``mapInArrow`` over ``(doc_id, text)`` rows. ``per_batch(ids, texts)`` gets an Arrow
    id column and a list of texts (UTF-8 bytes if ``binary``) and returns Arrow columns;
    ``finish()`` may yield more record batches once the partition is read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                t = b.column(1)
                yield per_batch(b.column(0), (t.cast(pa.binary()) if binary else t).to_pylist())
        if finish:
            yield from finish()
    return df.mapInArrow(run, schema)


def bit_filter(hashes: DataFrame, n: int) -> np.ndarray:
    """A one-hash membership filter over the ``h`` (bigint) column as a bool-per-bit array
    packed in bytes: 16 bits for each of the ``n`` values, 2**27 bits at most. It has no
    false negatives; beyond the bound it only lets more rows through.

    The bits are OR-ed in a distributed aggregation; at most 16 MB reach the driver.
    """
    bits = min(max(16, math.ceil(math.log2(16 * max(n, 1)))), MAX_FILTER_BITS)
    slot = F.shiftrightunsigned(F.col("h"), 64 - bits)
    words = (hashes.select(F.shiftright(slot, 6).alias("w"), F.expr(
        f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))").alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b"))).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    if words.num_rows:
        out[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return out


def in_filter(filt: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Membership of each unsigned 64-bit hash."""
    bits = int(len(filt)).bit_length() - 1 + 6
    slot = h >> np.uint64(64 - bits)
    return (filt[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def joined_ids(ids: Column) -> Column:
    """An array of ids as strings, sorted and comma-joined."""
    return F.array_join(F.array_sort(F.transform(ids, lambda x: x.cast("string"))), ",")
