"""Benchmark decontamination (operator 7) as a prefix-filtered set join.

A window is ``window`` consecutive words of a benchmark item (the whole item if it has
fewer). A document contains a window only if it contains the window's rarest word, so that
word alone is the necessary prefix:

1. count, over all documents, the words that the benchmark uses, and order each window's
   words by rarity; a window with a word that no document has can't occur;
2. join document words with the prefix words on Spark: a match at position ``p`` for a word at
   ``offset`` can only be the window at ``p - offset``. A document sends an occurrence only if the word and the
   neighbour that the window has beside it pass two bit filters of bounded size;
3. the positional bound (``p >= offset``) and the length bound (the window ends inside the
   document) discard the rest, and what is left is compared word by word with the words
   around the occurrence, which it carries.

Words, windows and their items are tables; neither the driver nor any worker holds the benchmark. A hot
prefix word is split by the skew join, as both sides are shuffled for it.

Words are runs of characters other than ASCII non-alphanumerics, after lower-casing A-Z.

Defined results: a NULL or empty text has no words and is not contaminated; an item without
words, or with a NULL text, never occurs; repeated items count once per item id. Windows of an item
without ``item_id`` mark words as hit; only items with an id are counted and listed. Repeated documents each give
a row. Empty tables give empty results or clean documents. Other columns pass untouched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_filter, id_text, written

WINDOW = 10
PIECE_WORDS = 4_096    # longer items are cut into overlapping pieces first
REMEMBERED = 400_000   # words whose filter answers a worker keeps

# Separators (ASCII apart from digits and lower-case letters, after lower-casing) to spaces.
_TABLE = bytes(c if c > 0x7F or chr(c).isalnum() and chr(c) == chr(c).lower() else
               ord(chr(c).lower()) if chr(c).isalpha() else 0x20 for c in range(256))
_SIGNED = 1 << 63


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def word_hash(word: bytes) -> int:
    """Signed, as Spark's columns hold it."""
    h = xxhash.xxh64_intdigest(word)
    return h - (h >= _SIGNED) * 2 * _SIGNED


class Known(dict):
    """word -> whether it passes the filter, remembered for common words."""

    def __init__(self, words: np.ndarray):
        super().__init__()
        self.words, self.shift = words, 64 - (int(len(words)).bit_length() - 1 + 6)

    def passes(self, key: bytes) -> bool:
        slot = xxhash.xxh64_intdigest(key) >> self.shift
        return bool(int(self.words[slot >> 6]) >> (slot & 63) & 1)

    def __missing__(self, word: bytes) -> bool:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = self.passes(word)
        return out


# --- benchmark side ----------------------------------------------------------------

def windows(bench: DataFrame, window: int) -> DataFrame:
    """``words`` (an array) and ``items`` (the ids that have it, sorted; without NULL) of each distinct window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                w = [x.decode() for x in words_of(text)]
                last = max(1, len(w) - window + 1) if w else 0
                for s in range(0, last, PIECE_WORDS):
                    cut = [w[i:i + window] for i in range(s, min(s + PIECE_WORDS, last))]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(cut), pa.string()), pa.array(cut, pa.list_(pa.string()))], names=["item_id", "words"])
    items = bench.where("text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(run, "item_id string, words array<string>").groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def document_counts(spark: SparkSession, docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``word, n`` over all documents for the words that pass the vocabulary's filter (added up in
    each partition before the shuffle)."""
    passing = spark.sparkContext.broadcast(bit_filter(vocabulary.select("h"), vocabulary.count()))

    def run(batches):
        known, total = Known(passing.value), Counter()
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                total.update([w for w in words_of(t) if known[w]])
            if len(total) > REMEMBERED:
                yield _counts(total)
                total = Counter()
        if total:
            yield _counts(total)
    return (docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")))


def _counts(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total]), pa.array(list(total.values()), pa.int64())], names=["word", "n"])


def _hash(col: str) -> Column:
    @F.arrow_udf("bigint")
    def hashed(words: pa.Array) -> pa.Array:
        return pa.array([word_hash(w) for w in words.cast(pa.binary()).to_pylist()], pa.int64())
    return hashed(F.col(col))


def prefixes(spark: SparkSession, docs: DataFrame, bench: DataFrame, window: int) -> DataFrame:
    """``word, offset, words, items, beside`` of each window that can occur: its rarest word, and that word
    with the next (or previous) one as a key (the word alone, if the window has no other)."""
    w = written(spark, windows(bench, window).withColumn("window", F.monotonically_increasing_id()), "windows")
    parts = w.select("window", F.posexplode("words").alias("offset", "word"))
    vocabulary = parts.select("word").distinct().withColumn("h", _hash("word"))
    counts = document_counts(spark, docs, written(spark, vocabulary, "vocabulary"))
    first = (parts.join(counts, "word", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("first"))
             .where("first.n > 0"))
    at = F.col("first.offset")
    beside = F.when(at + 1 < F.size("words"), F.concat(F.lit(">"), F.col("first.word"), F.lit(" "), F.get("words", at + 1))).when(
        at > 0, F.concat(F.lit("<"), F.col("first.word"), F.lit(" "), F.get("words", at - 1))).otherwise(F.concat(F.lit("="), F.col("first.word")))
    return written(spark, w.join(first, "window").select(F.col("first.word").alias("word"), at.alias("offset"), "words", "items", beside.alias("beside")), "prefixes")


# --- document side -------------------------------------------------------------------

SENT = "row bigint, doc_id bigint, n_words bigint, h1 bigint, h2 bigint, word string, place int, here int, around array<string>"


def occurrences(spark: SparkSession, docs: DataFrame, prefix: DataFrame, window: int) -> DataFrame:
    """A written table: a row for each document (``word`` NULL) with its number of words and text digest, and one for
    each place of a prefix word with the words around it (``here`` is its place among those)."""
    n = prefix.count()
    keys = [spark.sparkContext.broadcast(bit_filter(prefix.select(_hash(c).alias("h")), n)) for c in ("word", "beside")]

    def run(batches):
        known, pairs = Known(keys[0].value), Known(keys[1].value)
        for b in batches:
            out = [[] for _ in range(9)]

            def send(*row):
                for col, v in zip(out, row):
                    col.append(v)
            for row, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                w = words_of(text)
                h = xxhash.xxh3_128_intdigest(text)
                send(row, doc, len(w), (h >> 64) - _SIGNED, (h & (1 << 64) - 1) - _SIGNED, None, None, None, None)
                for p in [p for p, x in enumerate(w) if known[x]]:
                    x = w[p]
                    if (p + 1 < len(w) and pairs.passes(b">%b %b" % (x, w[p + 1]))) or (p and pairs.passes(b"<%b %b" % (x, w[p - 1]))) or pairs.passes(b"=" + x):
                        s = max(0, p - window + 1)
                        send(row, doc, len(w), None, None, x.decode(), p, p - s, [y.decode() for y in w[s:p + window]])
            types = [pa.int64()] * 5 + [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=[x.split()[0] for x in SENT.split(", ")])
    t = id_text(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return written(spark, t.mapInArrow(run, SENT), "occurrences")


def hits(sent: DataFrame, prefix: DataFrame) -> DataFrame:
    """``row, n_hit, items`` of the documents that contain a window."""
    o = sent.where("word IS NOT NULL").select("row", "n_words", "word", "place", "here", "around")
    start = F.col("place") - F.col("offset")
    same = F.slice("around", F.greatest(F.col("here") - F.col("offset"), F.lit(0)) + 1, F.size("words")) == F.col("words")
    found = o.join(prefix, "word").where((start >= 0) & (start + F.size("words") <= F.col("n_words")) & same).select(
        "row", F.struct(start.alias("s"), (start + F.size("words")).alias("e")).alias("at"), "items")
    g = found.groupBy("row").agg(F.sort_array(F.collect_set("at")).alias("at"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))  # one document's
    covered = F.aggregate("at", F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")), lambda acc, x: F.struct(
        F.greatest(acc["upto"], x["e"]).alias("upto"), (acc["n"] + F.greatest(x["e"] - F.greatest(x["s"], acc["upto"]), F.lit(0))).alias("n")), lambda acc: acc["n"])
    return g.select("row", covered.alias("n_hit"), F.array_sort("items").alias("items"))


def contamination(spark: SparkSession, docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row."""
    prefix = prefixes(spark, docs, bench, window)
    sent = occurrences(spark, docs, prefix, window)
    j = sent.where("word IS NULL").select("row", "doc_id", "n_words").join(hits(sent, prefix), "row", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return j.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                    F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that contain a benchmark window. Whether one does is a matter of
    its text alone, so rows are told apart by the text's 128-bit digest."""
    prefix = prefixes(spark, docs, bench, window)
    sent = occurrences(spark, docs, prefix, window)
    bad = written(spark, sent.where("word IS NULL").join(hits(sent, prefix).select("row"), "row", "left_semi").select("h1", "h2").distinct(), "contaminated")

    @F.arrow_udf("struct<h1:bigint,h2:bigint>")
    def digest(texts: pa.Array) -> pa.Array:
        h = [xxhash.xxh3_128_intdigest(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
        return pa.StructArray.from_arrays([pa.array([(x >> 64) - _SIGNED for x in h], pa.int64()), pa.array([(x & (1 << 64) - 1) - _SIGNED for x in h], pa.int64())], names=["h1", "h2"])
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), digest(F.col("text").cast("string")).alias("of"))
    kept = whole.join(bad, (F.col("of.h1") == F.col("h1")) & (F.col("of.h2") == F.col("h2")), "left_anti")
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
