"""Phrase collocation mining (operator 11) by SON partitioning.

A text (A-Z lower-cased) is cut at ``. , ; : ! ?`` and line ends into pieces and those at
blanks and tabs into words; phrases are runs of up to ``MAX_WORDS`` words inside a piece. All
counts are per language. A shard is ``SHARD_BYTES`` of text at most, in the memory of one task.

* **Local mining.** With ``w`` the shard's share of all text bytes, a phrase that occurs ``support``
  times in all occurs ``ceil(support * w)`` times in one shard at least (the shares add up to 1).
  Each shard is mined completely at that local support, level by level: a phrase of ``k`` words
  is looked at only where both its parts of ``k - 1`` words are still in. Locally frequent phrases
  are united by hash and their counts added up with what the shards that left a phrase out may
  hold at most; only phrases whose bound reaches the support are candidates.
* **Global count.** The candidates' hashes are a bit filter of bounded size; every occurrence that
  passes it is counted under its own words, so a false positive costs a row and never a count.

Four sweeps over the texts: words are counted; pairs of frequent words are mined; candidate
pairs are counted while longer phrases of candidate pairs are mined; candidates among those
are counted. What is known globally of a level thins out the next: the support is an absolute
number, so with more than ``support`` shards the local support is 1 and every pair of frequent
words meets in the aggregation (once a shard, as a 64-bit hash), but longer phrases only where
all their pairs are frequent. The driver gets a few numbers and the filter (16 MB at most).

A cut of a phrase after its first ``k`` words scores ``floor(2000000 a / (l + r))`` with ``a, l, r``
the counts of phrase, first and second part; the lowest-scoring cut counts. A phrase goes if a
longer one holds it and has at least four fifths of its occurrences. The best ``top`` of each
language are returned.

Defined results: a NULL text is empty, a NULL ``lang`` is ``und``; ids are not used, repeated rows
count each; empty tables and languages without a candidate give no row. One word of any length
is a word. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bit_filter, in_filter, written

SUPPORT = 30
MAX_WORDS = 4
TOP = 2_000
SHARD_BYTES = 64 << 20   # text of a shard; a task needs about five times that
PART = 1 << 21           # places whose phrases are sorted at once
ROWS = 1 << 16
SLICE_BYTES = 4 << 20    # longer texts are taken in slices that end at a piece's end
BREAK = b"\xff"          # no byte of UTF-8
_TABLE = bytes(0xFF if c in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if c == 0x09 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: int) -> int:
    """A word's place in the filter, as ``Shard.hashes`` has it for phrases of one word."""
    h = (1 ^ h) * int(_SPREAD) & (1 << 64) - 1
    return h ^ h >> 29


class _Ids(dict):
    """Word -> number within a shard, 0 for words that the filter leaves out; ``names`` and
    ``langs`` (shared by the languages) have the words back."""

    def __init__(self, lang: str, names: list, langs: list, passing: np.ndarray | None):
        super().__init__({BREAK: 0})
        self.lang, self.names, self.langs, self.passing = lang, names, langs, passing
        self.seed = xxhash.xxh64_intdigest(lang.encode())
        if passing is not None:
            self.shift = 64 - (int(len(passing)).bit_length() - 1 + 6)

    def __missing__(self, word: bytes) -> int:
        if self.passing is not None:
            slot = _mixed(xxhash.xxh64_intdigest(word, self.seed)) >> self.shift
            if not int(self.passing[slot >> 6]) >> (slot & 63) & 1:
                self[word] = 0
                return 0
        n = self[word] = len(self.names)
        self.names.append(word)
        self.langs.append(self.lang)
        return n


def slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, ``BREAK`` between pieces, a slice at a time."""
    text = text.translate(_TABLE)
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= SLICE_BYTES else text.find(BREAK, at + SLICE_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].replace(BREAK, b" \xff ").split()
        at = end + 1


class Shard:
    """Numbered words of many texts, 0 between pieces and for words that the filter leaves out.
    Numbers differ between languages."""

    def __init__(self, passing: np.ndarray | None = None):
        self.passing = passing
        self.names: list[bytes] = [BREAK]
        self.lang_of: list[str] = [""]
        self.langs: dict[str, _Ids] = {}
        self.parts: list[np.ndarray] = []
        self.bytes = 0

    def add(self, lang: str, text: bytes) -> None:
        ids = self.langs.get(lang)
        if ids is None:
            ids = self.langs[lang] = _Ids(lang, self.names, self.lang_of, self.passing)
        for words in slices(text):
            words.append(BREAK)
            self.parts.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
        self.bytes += len(text)

    def levels(self, choose: Callable[[int, np.ndarray, np.ndarray], np.ndarray], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(k, words, counts)`` of the chosen phrases of each length: ``words`` has a row of
        word numbers for each. ``choose(k, words, counts)`` gives a mask over the phrases whose
        parts were chosen."""
        now = np.concatenate(self.parts) if self.parts else np.zeros(1, np.int32)
        self.parts = []
        for ids in self.langs.values():
            ids.clear()  # only the names are needed from here on
        counts = np.bincount(now, minlength=len(self.names))
        counts[0] = 0
        words = np.arange(len(self.names), dtype=np.int32)[:, None]
        chosen = choose(1, words, counts) & (counts > 0)
        code = np.zeros(len(self.names), np.int32)
        code[chosen] = np.arange(1, chosen.sum() + 1)
        words, counts = words[chosen], counts[chosen]
        yield 1, words, counts
        now = code[now]  # number of the chosen phrase that begins here, 0 if none
        for k in range(2, longest + 1):
            at = np.flatnonzero((now[:-1] > 0) & (now[1:] > 0)).astype(np.int32)
            width, above = len(words) + 1, np.zeros(max(len(now) - 1, 0), np.int32)
            parts = -(-len(at) // PART)  # phrases of a part begin with a part of the shorter phrases: less memory at once
            part_of = (now[at] % max(parts, 1)).astype(np.int16)
            found = [(np.empty((0, k), np.int32), np.empty(0, np.int64))]
            for part in range(parts):
                own = at[part_of == part]
                key = now[own].astype(np.int64)
                key *= width
                key += now[own + 1]
                distinct, counts = np.unique(key, return_counts=True)
                both = lambda d: np.concatenate([words[d // width - 1], words[d % width - 1][:, -1:]], axis=1)  # noqa: B023, E731
                chosen = np.zeros(len(distinct), bool)
                for i in range(0, len(distinct), ROWS):
                    chosen[i:i + ROWS] = choose(k, both(distinct[i:i + ROWS]), counts[i:i + ROWS])
                distinct, counts = distinct[chosen], counts[chosen]
                if k < longest and len(distinct):
                    slot = np.minimum(np.searchsorted(distinct, key), len(distinct) - 1)
                    above[own] = np.where(distinct[slot] == key, slot + 1 + sum(len(c) for _, c in found), 0)
                found.append((both(distinct), counts))
            words, counts = (np.concatenate(x) for x in zip(*found))
            now = above
            yield k, words, counts

    def hashes(self) -> Callable[[int, np.ndarray], np.ndarray]:
        """Hash of phrases given as rows of word numbers (the same in every shard)."""
        digest = xxhash.xxh64_intdigest
        seeds = {lang: digest(lang.encode()) for lang in self.langs} | {"": digest(b"")}
        own = np.fromiter((digest(w, seeds[lang]) for lang, w in zip(self.lang_of, self.names)), np.uint64, len(self.names))

        def of(k: int, words: np.ndarray) -> np.ndarray:
            h = np.full(len(words), k, np.uint64)
            for j in range(k):
                h = (h ^ own[words[:, j]]) * _SPREAD
                h ^= h >> np.uint64(29)
            return h
        return of


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int, passing: np.ndarray | None) -> Iterator[Shard]:
    shard = Shard(passing)
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            if shard.bytes and shard.bytes + len(text) > shard_bytes:
                yield shard
                shard = Shard(passing)
            shard.add(lang, text)
    if shard.langs:
        yield shard


def local_support(support: int, own: int, total: int) -> int:
    """``ceil(support * own / total)``, 1 at least."""
    return max(1, -(-support * own // total)) if total else 1


SWEEP_SCHEMA = "lang string, k int, phrase string, h bigint, n bigint"


class Miner:
    """The sweeps over ``texts(lang, text)``."""

    def __init__(self, spark: SparkSession, texts: DataFrame, support: int, shard_bytes: int):
        self.spark, self.texts, self.support, self.shard_bytes = spark, texts, support, shard_bytes
        self.total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def sweep(self, count: range, mine: range, known: DataFrame | None = None) -> DataFrame:
        """A written table of ``lang, k, phrase, h, n``. Phrases of the lengths in ``count`` that
        pass the filter of ``known`` hashes (all, if there is none) are counted; ``k`` = 0 has the number of words. Of the lengths in
        ``mine``, ``h`` alone tells the locally frequent, with the part of the count that lies above what a shard leaves
        out; the row without ``h`` has the sum of what the shards leave out."""
        passing = None
        if known is not None:
            passing = self.spark.sparkContext.broadcast(bit_filter(known, known.count()))
        total, support, shard_bytes = self.total, self.support, self.shard_bytes
        longest = max(*count, *mine, 1)

        def run(batches):
            for shard in _shards(batches, shard_bytes, None if passing is None else passing.value):
                least = local_support(support, shard.bytes, total)
                of = shard.hashes()
                words_of = dict.fromkeys(shard.langs, 0)

                def choose(k, words, counts):
                    if k == 1 and 1 in count:
                        for lang, c in zip(shard.lang_of[1:], counts[1:].tolist()):  # noqa: B023
                            words_of[lang] += c  # noqa: B023
                    if k in mine:
                        return counts >= least  # noqa: B023
                    return np.ones(len(words), bool) if passing is None else in_filter(passing.value, of(k, words))  # noqa: B023
                for k, words, counts in shard.levels(choose, longest):
                    for i in range(0, len(words) if k in count or k in mine else 0, ROWS):
                        w, n = words[i:i + ROWS], counts[i:i + ROWS]
                        h = pa.array(of(k, w).view(np.int64))
                        if k in count:
                            rows = w.tolist()
                            text = pa.array([b" ".join([shard.names[x] for x in r]) for r in rows], pa.binary()).cast(pa.string())
                            yield _rows(pa.array([shard.lang_of[r[0]] for r in rows], pa.string()), k, text, h, n)
                        else:
                            yield _rows(pa.nulls(len(w), pa.string()), k, pa.nulls(len(w), pa.string()), h, n - (least - 1))
                if mine:
                    yield _rows(pa.nulls(1, pa.string()), -1, pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), np.array([least - 1]))
                if 1 in count:
                    yield _rows(pa.array(list(words_of), pa.string()), 0, pa.array([""] * len(words_of)), pa.nulls(len(words_of), pa.int64()),
                                np.array(list(words_of.values()), np.int64))
        texts = self.texts
        if mine:  # fewer, larger shards have a higher local support; coalescing moves no data
            texts = texts.coalesce(max(1, -(-total // shard_bytes)))
        swept = texts.mapInArrow(run, SWEEP_SCHEMA).groupBy("lang", "k", "phrase", "h").agg(F.sum("n").alias("n"))
        return written(self.spark, swept.where((F.col("k") <= 0) | F.col("lang").isNull() | (F.col("n") >= support)), "sweep")

    def candidates(self, swept: DataFrame) -> DataFrame:
        """Hashes ``h`` of the mined phrases that may reach the support."""
        # A shard that left a phrase out has it at most (its local support - 1) times.
        rest = swept.where("k = -1").agg(F.sum("n")).first()[0] or 0
        return swept.where("k > 0 AND lang IS NULL").where(F.col("n") + rest >= self.support).select("h")


def _rows(lang: pa.Array, k: int, phrase: pa.Array, h: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(lang), k, np.int32)), phrase, h, pa.array(n, pa.int64())], names=["lang", "k", "phrase", "h", "n"])


def phrase_counts(spark: SparkSession, docs: DataFrame, support: int = SUPPORT, longest: int = MAX_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``lang, k, phrase, n``: the exact count of every phrase of 1 to ``longest`` words that
    occurs ``support`` times or more; ``k`` = 0 has the number of words of the language."""
    miner = Miner(spark, docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                                     F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), support, shard_bytes)
    none = range(0)
    words = miner.sweep(range(1, 2), none)
    known = words.where("k = 1").select("h")
    out = [words]
    if longest >= 2:
        known = known.union(miner.candidates(miner.sweep(none, range(2, 3), known)))
        pairs = miner.sweep(range(2, 3), range(3, longest + 1), known)
        out.append(pairs)
    if longest >= 3:
        out.append(miner.sweep(range(3, longest + 1), none, known.union(miner.candidates(pairs))))
    counts = out[0]
    for more in out[1:]:
        counts = counts.unionByName(more.where("lang IS NOT NULL"))
    return counts.select("lang", "k", "phrase", "n")


def _big(name: str):
    return F.col(name).cast("decimal(20,0)")


def collocations(spark: SparkSession, docs: DataFrame, support: int = SUPPORT, longest: int = MAX_WORDS, top: int = TOP,
                 shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the best ``top`` phrases of each language."""
    counts = phrase_counts(spark, docs, support, longest, shard_bytes)  # written tables
    phrases = counts.where("k >= 2").select("lang", "k", "phrase", F.col("n").alias("a"))
    # every cut, with the counts of its two parts (which occur at least as often as the phrase)
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "*", F.expr("substring_index(phrase, ' ', cut)").alias("first"), F.expr("substring_index(phrase, ' ', cut - k)").alias("second"))
    of = lambda part, n: counts.where("k >= 1").select("lang", F.col("phrase").alias(part), F.col("n").alias(n))
    both = cuts.join(of("first", "l"), ["lang", "first"]).join(of("second", "r"), ["lang", "second"])
    score = F.expr("(cast(2000000 AS decimal(7,0)) * cast(a AS decimal(20,0))) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))")
    scored = (both.select("lang", "phrase", "a", F.struct(score.alias("score"), "cut", "l", "r").alias("x"))
              .groupBy("lang", "phrase", "a").agg(F.min("x").alias("x")))
    # the most frequent longer phrase around each phrase
    w = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("k") - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))))
    around = (phrases.where("k >= 3").select("lang", F.col("a").alias("f"), F.explode(inner).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("f").alias("f")))
    kept = scored.join(around, ["lang", "phrase"], "left").where(F.col("f").isNull() | (_big("f") * 100 < _big("a") * 80))
    order = Window.partitionBy("lang").orderBy(F.desc("x.score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    words = counts.where("k = 0").select("lang", "n")
    return best.join(words, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "x.l", "x.r", "n", "x.score")
