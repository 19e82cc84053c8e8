"""Quality classifier (operator 2) from weak labels.

Overlapping heuristic labellers vote good (1), bad (0) or nothing (-1) on every text. The
votes of all documents are counted by pattern in Spark (3**L patterns at most, L labellers),
and expectation-maximisation over the patterns estimates the share of good texts and each
labeller's accuracy, without any gold label. Each pattern's posterior is the label on which
a hashed linear scorer is trained; the scorer sees character shapes and short words, not the
votes, and scores every whole text.

The scorer is fitted on a bounded sample (``SAMPLE`` documents in hash order); votes, pattern
counts and scores cover all documents.

Defined results: NULL and empty texts are scored like any other; they are short, which is a
bad vote. Repeated rows and rows without ``doc_id`` each give a row; an empty table gives an
empty result. Ids, labels, language and source are no inputs.
"""

from __future__ import annotations

import functools
import operator
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, map_texts

SAMPLE = 12_000     # documents that the scorer is fitted on at most
HASH_BITS = 12      # of the scorer's feature space
THRESHOLD = 0.5
PRECISE = 0.995     # prior accuracy of labellers on good texts
# Common short words of English, French, German and Spanish.
COMMON = frozenset("""the of and to a in is it that for on as with was be by at this are or an from not
de la le les des et un une du en que qui dans pour par sur est au il pas plus
der die das und zu den von mit ist im ein eine nicht auf dem des sich
el los las se del al lo con para su como y o es no""".encode().split())
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_UPPER = bytes(range(65, 91))
_SPACE = b" \t\n\r\x0b\x0c"
_PLAIN = b".,;:'\"()-?"  # marks that prose uses
_DIGITS = b"0123456789"


def between(value: float, good, bad) -> int:
    """1 inside ``good`` bounds, 0 beyond ``bad`` ones, else no vote."""
    if good[0] <= value <= good[1]:
        return 1
    return 0 if value < bad[0] or value > bad[1] else -1


def votes(text: bytes) -> list[int]:
    """One vote per labeller."""
    words = text.split()
    n, size = len(words), max(len(text), 1)
    letters = size - len(text.translate(None, _LETTERS))
    odd = len(text.translate(None, _LETTERS + _SPACE + _PLAIN + _DIGITS))
    upper = size - len(text.translate(None, _UPPER))
    bare = [w.strip(b".,;:!?\"'()").lower() for w in words]
    common = sum(map(COMMON.__contains__, bare)) / max(n, 1)
    no_letter = sum(1 for w in words if not w.translate(None, _DIGITS + b"|*#&%$-_=+~<>/\\.,;:!?")) / max(n, 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 1 - len(set(lines)) / max(len(lines), 1)
    distinct = len(set(bare)) / max(n, 1)
    again = sum(map(operator.eq, bare, bare[1:])) / max(n, 1)
    ended = sum(1 for x in lines if x.rstrip()[-1:] in (b".", b"!", b"?")) / max(len(lines), 1)
    return [
        between(odd / size, (0, .02), (0, .05)),                      # unusual marks
        between(upper / max(letters, 1), (0, .12), (0, .3)),          # capitals
        between(common, (.08, .7), (.03, .8)) if n >= 20 else -1,     # common words
        between(no_letter, (0, .03), (0, .15)) if n >= 5 else -1,     # words without letters
        between(repeated, (0, .1), (0, .4)) if len(lines) >= 4 else -1,  # repeated lines
        between(distinct, (.3, 1), (.1, 1)) if 50 <= n <= 2_000 else -1,  # vocabulary
        between(letters / size, (.7, .95), (.6, .98)) if n >= 5 else -1,  # letters
        between(ended, (.5, 1), (.1, 1)) if len(lines) >= 2 else -1,  # sentences that end
        between(again, (0, .03), (0, .1)) if n >= 20 else -1,         # words said twice
        0 if n < 3 else -1,                                           # hardly any text
    ]


LABELLERS = 10


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200):
    """Share of good texts, per labeller its accuracy on good and on bad texts, and each
    pattern's posterior of good, from vote patterns and their counts.

    Texts are bad in different ways, so a labeller may miss most bad texts; what the labellers
    have in common is that a bad vote on a good text is rare. A prior says so (accuracy
    ``PRECISE`` on good texts, as heavy as half of the documents); without it, one kind of bad
    text can take the whole bad class.
    """
    share, weight = 0.8, counts.sum() / 2
    ok = np.column_stack([np.full(LABELLERS, PRECISE), np.full(LABELLERS, 0.5)])
    one, zero = patterns == 1, patterns == 0

    def posterior():
        good = np.log(share) + one @ np.log(ok[:, 0]) + zero @ np.log(1 - ok[:, 0])
        bad = np.log(1 - share) + one @ np.log(1 - ok[:, 1]) + zero @ np.log(ok[:, 1])
        return 1 / (1 + np.exp(np.clip(bad - good, -50, 50)))
    for _ in range(rounds):
        p = posterior()
        g, b = counts * p, counts * (1 - p)
        new = np.column_stack([(g @ one + PRECISE * weight) / (g @ (one | zero) + weight), (b @ zero + 1) / (b @ (one | zero) + 2)])
        share_new = float((g.sum() + 4) / (counts.sum() + 5))
        done = np.abs(new - ok).max() < 1e-7 and abs(share_new - share) < 1e-7
        ok, share = new, share_new
        if done:
            break
    return share, ok, posterior()


# --- hashed linear scorer ----------------------------------------------------------

_SHAPE = bytes(97 if 97 <= c <= 122 or c > 127 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))


@functools.lru_cache(maxsize=1 << 16)
def _slot(feature: bytes) -> int:
    return xxhash.xxh32_intdigest(feature) >> (32 - HASH_BITS)


def shape_features(text: bytes) -> dict[int, float]:
    """Hashed features: shares of word shapes, of pairs of first characters' classes, of short
    words and of words that repeat their predecessor."""
    words = text.lower().split()
    if not words:
        return {_slot(b"empty"): 1.0}
    shaped = text.translate(_SHAPE).split()
    first = np.frombuffer(b"".join([w[:1] for w in shaped]), np.uint8).astype(np.int64)
    pair, times = np.unique(first[:-1] << 8 | first[1:], return_counts=True)
    counts = [(b"s" + k, c) for k, c in Counter([w[:1] + w[-2:] for w in shaped]).items()]   # how words begin and end
    counts += [(b"p%d" % k, c) for k, c in zip(pair.tolist(), times.tolist())]               # how neighbours begin
    counts += [(b"w" + k, c) for k, c in Counter([w for w in words if len(w) < 4]).items()]
    counts.append((b"repeat", sum(map(operator.eq, words, words[1:]))))
    out: dict[int, float] = {}
    for k, c in counts:
        if c:
            i = _slot(k)
            out[i] = out.get(i, 0.0) + c / len(words)
    return out


def train(rows: list[dict[int, float]], target: np.ndarray, epochs: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels (full-batch gradient steps with AdaGrad)."""
    idx = np.concatenate([np.fromiter(r, np.int64, len(r)) for r in rows])
    val = np.sqrt(np.concatenate([np.fromiter(r.values(), float, len(r)) for r in rows]))
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, seen = np.zeros((1 << HASH_BITS) + 1), np.full((1 << HASH_BITS) + 1, 1e-8)
    for _ in range(epochs):
        s = np.bincount(row, w[idx] * val, len(rows)) + w[-1]
        err = 1 / (1 + np.exp(-np.clip(s, -30, 30))) - target
        g = np.r_[np.bincount(idx, err[row] * val, 1 << HASH_BITS), err.sum()] / len(rows) + ridge * np.r_[w[:-1], 0]
        seen += g * g
        w -= 0.5 * g / np.sqrt(seen)
    return w


def score(text: bytes, w: np.ndarray) -> float:
    s = w[-1] + sum(w[i] * v ** 0.5 for i, v in shape_features(text).items())
    return float(1 / (1 + np.exp(-np.clip(s, -30, 30))))


def pattern_counts(docs: DataFrame) -> DataFrame:
    """``votes, n`` over all documents, counted in each partition first."""
    def run(batches):
        total = Counter()
        for b in batches:
            total.update(bytes(v + 1 for v in votes(t)) for t in b.column(0).cast(pa.binary()).to_pylist())
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["votes", "n"])
    return id_text(docs).select("text").mapInArrow(run, "votes binary, n bigint").groupBy("votes").agg(F.sum("n").alias("n"))


def fit(spark: SparkSession, docs: DataFrame) -> np.ndarray | None:
    """The scorer's weights; None for an empty table."""
    counted = pattern_counts(docs).toArrow()  # at most 3**10 rows, whatever the input
    if not counted.num_rows:
        return None
    # Byte columns hold one vote a byte, stored plus one.
    keys = [bytes(v) for v in counted["votes"].to_pylist()]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    keys, n = [keys[i] for i in order], counted["n"].to_numpy()[order].astype(float)
    _share, _ok, post = expectation_maximisation(np.array([[b - 1 for b in k] for k in keys]), n)
    label = dict(zip(keys, post.tolist()))
    total = n.sum()

    def featured(batches):
        for b in batches:
            f = [shape_features(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            y = [label[bytes(v + 1 for v in votes(t))] for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(y, pa.float64()), pa.array([list(x) for x in f], pa.list_(pa.int32())), pa.array([list(x.values()) for x in f], pa.list_(pa.float64()))],
                names=["h", "y", "slots", "shares"])
    share = min(1.0, 2 * SAMPLE / total)
    low = id_text(docs).select(F.xxhash64("doc_id", "text").alias("h"), "text").where(F.shiftrightunsigned("h", 44) <= int(share * (1 << 20)))
    # The sample is the rows of the SAMPLE smallest hashes (repeated rows count once): only hashes are
    # sorted, and the features of what is chosen are computed where the rows are.
    last = low.select("h").distinct().orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    got = (low.where(F.col("h") <= last).mapInArrow(featured, "h bigint, y double, slots array<int>, shares array<double>")
           .groupBy("h").agg(F.first("y").alias("y"), F.first("slots").alias("slots"), F.first("shares").alias("shares")).toArrow().sort_by("h"))  # bounded by SAMPLE
    rows = [dict(zip(s, v)) for s, v in zip(got["slots"].to_pylist(), got["shares"].to_pylist())]
    return train(rows, got["y"].to_numpy())


def scores(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, accepted`` for every row."""
    w = fit(spark, docs)

    def per_batch(ids, texts):
        s = [score(t, w) for t in texts]
        return pa.RecordBatch.from_arrays([ids, pa.array(s, pa.float64()), pa.array([x >= threshold for x in s])], names=["doc_id", "score", "accepted"])
    return map_texts(id_text(docs), per_batch, "doc_id bigint, score double, accepted boolean")


def keep_good(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that the classifier rejects."""
    w = fit(spark, docs)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([score(t or b"", w) for t in texts.cast(pa.binary()).to_pylist()], pa.float64())
    return docs.where(scored(F.col("text")) >= threshold)
