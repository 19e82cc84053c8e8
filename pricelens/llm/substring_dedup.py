"""Substring de-duplication (operator 5) by hashing lines, paragraphs, sentences or clauses.

A unit is normalised (A-Z to lower case, runs of white space to one space, trimmed; sentences
and clauses without the marks that end them) and hashed to 128 bits. Digests are grouped globally,
with map-side combine, so that a unit which every document has is one row per partition; it
is *repeated* if two rows have it (``across``) or it occurs twice anywhere. Single short units repeat by
chance (boilerplate), so what counts is a **run**: adjacent repeated units of a row with ``min_run_words`` words or more
together. The occurrence with the smallest ``(doc_id, start)`` is kept and each other one in a run
is a removal that retains its original offsets. Units shorter than ``min_words`` words stay and break a run.

Two passes over the texts: the first sends each unit's digest once per partition; the second sends only units of runs whose digests
pass a bit filter (16 MB at most) of the repeated ones, and the exact join and runs follow.

Offsets count code points of the original text, ends are exclusive. Defined results: NULL
and empty texts have no units; a NULL ``doc_id`` ranks last; of repeated rows one occurrence
is kept; an empty table gives an empty result. Columns other than ``doc_id`` and ``text`` may have any name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bit_filter, in_filter, written

MIN_WORDS = 5
MIN_RUN_WORDS = 30  # of a passage; sentences and clauses
UNITS = {  # group 1 is what is compared
    "line": re.compile(r"([^\n]+)"), "paragraph": re.compile(r"([^\n]+(?:\n[^\n]+)*)"),
    "sentence": re.compile(r"([^\n.!?]+)[\n.!?]*"), "clause": re.compile(r"([^\n.!?,;:]+)[\n.!?,;:]*"),
}
SCHEMA = "doc_id bigint, row bigint, place int, start bigint, end bigint, n_words int, h1 bigint, h2 bigint"


def units_of(text: str, unit: str, min_words: int):
    """``(place, start, end, words, digest halves)`` of each unit; places tell neighbours."""
    place = 0
    for m in UNITS[unit].finditer(text):
        w = m[1].encode().lower().split()
        if w:
            place += 1
            if len(w) >= min_words:
                h = xxhash.xxh3_128_intdigest(b" ".join(w))
                yield place, m.start(), m.end(), len(w), (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def runs(found: list[tuple], min_run_words: int) -> list[tuple]:
    """The units (in order) that stand in a run of neighbours with enough words."""
    out, run, words = [], [], 0
    for u in [*found, None]:
        if run and (u is None or u[0] != run[-1][0] + 1):
            out += run if words >= min_run_words else []
            run, words = [], 0
        if u is not None:
            run.append(u)
            words += u[3]
    return out


def units(rows: DataFrame, unit: str = "line", min_words: int = MIN_WORDS, passing=None, min_run_words: int = 0) -> DataFrame:
    """Every unit of ``rows(doc_id, row, text)`` with its offsets and digest; with a broadcast filter only those
    in runs of units that pass it."""
    def run(batches):
        for b in batches:
            out = [[] for _ in range(8)]
            for doc, row, text in zip(*(c.to_pylist() for c in b.columns)):
                found = list(units_of(text, unit, min_words))
                if passing is not None and found:
                    ok = in_filter(passing.value, np.array([u[4] for u in found], np.int64).view(np.uint64))
                    found = runs([u for u, k in zip(found, ok.tolist()) if k], min_run_words)
                for u in found:
                    for col, v in zip(out, (doc, row, *u)):
                        col.append(v)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=[x.split()[0] for x in SCHEMA.split(", ")])
    return rows.select("doc_id", "row", "text").mapInArrow(run, SCHEMA)


def repeats(spark: SparkSession, docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS, min_run_words: int = 0, across: bool = False) -> DataFrame:
    """``doc_id, start, end, n_words, run_words, keep_doc_id, keep_start, copies, kept`` for each
    repeated unit in a run, the kept occurrences too."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    numbered = written(spark, docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text.alias("text")), "numbered")
    return _repeats(spark, numbered, unit, min_words, min_run_words, across).drop("row")


def _repeats(spark: SparkSession, numbered: DataFrame, unit: str, min_words: int, min_run_words: int, across: bool) -> DataFrame:
    """The same with ``row``, for a written table of ``doc_id, row, text`` (both passes read its numbers)."""
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "start", "row")
    groups = units(numbered, unit, min_words).groupBy("h1", "h2").agg(
        F.min(rank).alias("keep"), F.count("*").alias("copies"), F.min("row").alias("low"), F.max("row").alias("high"))
    groups = written(spark, groups.where("low <> high" if across else "copies > 1").select("h1", "h2", "keep", "copies"), "repeated-units")
    passing = spark.sparkContext.broadcast(bit_filter(groups.select(F.col("h1").alias("h")), groups.count()))
    u = units(numbered, unit, min_words, passing, min_run_words).join(groups, ["h1", "h2"])
    run = F.col("place") - F.row_number().over(Window.partitionBy("row").orderBy("place"))
    u = u.withColumn("run", run).withColumn("run_words", F.sum("n_words").over(Window.partitionBy("row", "run")))
    kept = (F.col("row") == F.col("keep.row")) & (F.col("start") == F.col("keep.start"))
    return u.where(F.col("run_words") >= min_run_words).select(
        "doc_id", "row", "start", "end", "n_words", "run_words", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.start").alias("keep_start"), "copies",
        kept.alias("kept"))


def removals(spark: SparkSession, docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS, min_run_words: int = 0, across: bool = False) -> DataFrame:
    """``doc_id, start, end, n_words, keep_doc_id, keep_start, copies`` for each removed unit."""
    return repeats(spark, docs, unit, min_words, min_run_words, across).where("NOT kept").drop("run_words", "kept")


def cut_copies(spark: SparkSession, docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS, min_run_words: int = 0, across: bool = False) -> DataFrame:
    """``docs`` with every repeated unit but the first cut out. Each row loses its own units
    only, whatever other rows have its ``doc_id`` or none."""
    whole = written(spark, docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), "numbered")
    numbered = whole.select(F.col("doc.doc_id").cast("bigint").alias("doc_id"), "row", F.coalesce(F.col("doc.text").cast("string"), F.lit("")).alias("text"))
    removed = _repeats(spark, numbered, unit, min_words, min_run_words, across).where("NOT kept")
    return _cut(whole, removed, "row").select(*_columns(docs))


def without(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` with the removed units cut out of their texts (a unit takes one line end
    with it). ``doc_id`` must be unique in ``docs``: where ids are missing or shared, use
    ``cut_copies``."""
    whole = docs.select(F.col("doc_id").cast("bigint").alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return _cut(whole, removed.withColumnRenamed("doc_id", "key"), "key").select(*_columns(docs))


def _columns(docs: DataFrame) -> list:
    return [F.col("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns]


def _cut(whole: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """``doc, text`` of ``whole(key, doc)``, the units of the same key cut out."""
    spans = removed.groupBy(F.col(key).alias("of")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("cuts"))  # bounded by the document

    @F.arrow_udf("string")
    def cut(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        out = []
        for t, spans in zip(texts.to_pylist(), cuts.to_pylist()):
            if t is not None and spans:
                parts, at = [], 0
                for x in spans:
                    parts.append(t[at:x["start"]])
                    at = x["end"] + (t[x["end"]:x["end"] + 1] == "\n")
                t = "".join(parts) + t[at:]
            out.append(t)
        return pa.array(out, pa.string())
    joined = whole.join(spans, F.col(key).eqNullSafe(F.col("of")), "left")
    return joined.select("doc", F.when(F.col("cuts").isNull(), F.col("doc.text")).otherwise(cut(F.col("doc.text"), F.col("cuts"))).alias("text"))
