"""Toxicity (operator 3) by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary labelled texts.
Each window of a text is compressed with both; a window that the toxic dictionary shortens
more speaks for toxicity. A calibration on labelled texts that neither dictionary has seen
turns a text's windows into a probability whose threshold is 0.5.

A dictionary's content is chosen from word beginnings counted in Spark: the ordinary one
takes the commonest in ordinary texts, the toxic one also those that toxic texts hold far
more often. (The library's own dictionary builder picks the prose that both share, and
told the classes apart far worse on held-out rows.)

Labels are learned only from rows whose ``crc32(doc_id as text) mod 5`` is not 0, from a
bounded sample (``MAX_TOXIC`` and ``MAX_ORDINARY`` texts); a score uses the text alone.

Defined results: labels that are NULL are ignored, of contradicting ones the toxic one
counts; NULL and empty texts get the score of a text without evidence; with no labels of
one class, every score is the share of toxic labels (0 without labels). Repeated rows and
rows without ``doc_id`` (not held out) each give a row; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, map_texts, written

MAX_TOXIC, MAX_ORDINARY = 4_000, 6_000  # labelled texts used at most
WINDOW = 192                            # bytes
SHORTEST, LONGEST = 4, 9                # bytes of a word beginning
BASE_PIECES, TOXIC_PIECES = 2_000, 256
MIN_SHARE, MIN_Z, MIN_LIFT = 0.02, 6.0, 10  # for a toxic piece: share of toxic texts, z score, ratio of shares


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def sample(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, toxic, fit``: labelled training texts, ``fit`` for the dictionaries,
    the rest for the calibration."""
    known = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
             .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic")))
    h = F.xxhash64("doc_id")
    chosen = (known.where("toxic = 1").orderBy(h).limit(MAX_TOXIC)
              .union(known.where("toxic = 0").orderBy(h).limit(MAX_ORDINARY)))
    # At most MAX_TOXIC + MAX_ORDINARY ids, so the broadcast is bounded.
    return written(spark, id_text(docs).join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) > 0).alias("fit")), "toxic-sample")


def beginnings(text: bytes) -> set[bytes]:
    out = set()
    for w in set(text.lower().split()):
        w = w.rstrip(b".,;:!?\"')")
        out.update(b" " + w[:k] for k in range(SHORTEST, min(len(w), LONGEST) + 1))
    return out


def piece_counts(rows: DataFrame) -> DataFrame:
    """``piece, in_toxic, in_ordinary``: number of sample texts with each word beginning."""
    def run(batches):
        count = {0: Counter(), 1: Counter()}
        for b in batches:
            for text, toxic in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist()):
                count[toxic].update(beginnings(text))
        keys = list(count[0].keys() | count[1].keys())
        for i in range(0, len(keys), 50_000):
            part = keys[i:i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), *(pa.array([count[c][k] for k in part], pa.int64()) for c in (1, 0))],
                                             names=["piece", "in_toxic", "in_ordinary"])
    return (rows.where("fit").select("text", F.col("toxic").cast("int").alias("toxic"))
            .mapInArrow(run, "piece binary, in_toxic bigint, in_ordinary bigint")
            .groupBy("piece").agg(F.sum("in_toxic").alias("in_toxic"), F.sum("in_ordinary").alias("in_ordinary")))


def longest_forms(counts: dict[bytes, int]) -> list[bytes]:
    """Of pieces that begin alike, one: the shortest, grown while nearly all of its texts
    have the longer one too."""
    out: list[bytes] = []
    for p in sorted(counts, key=lambda x: (len(x), x)):
        if any(p.startswith(q) or q.startswith(p) for q in out):
            continue
        while longer := [x for x in counts if len(x) == len(p) + 1 and x.startswith(p) and counts[x] >= 0.85 * counts[p]]:
            p = max(longer, key=lambda x: (counts[x], x))
        out.append(p)
    return out


def train_dictionaries(rows: DataFrame) -> tuple[bytes, bytes]:
    """Contents of the ordinary and of the toxic dictionary (the commonest pieces last, where
    references are cheapest). Both end alike, so what ordinary prose costs is the same with
    either, and the difference is what the toxic pieces save."""
    n = {r["toxic"]: r["n"] for r in rows.where("fit").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    nt, no = n.get(1, 0), n.get(0, 0)
    pieces = piece_counts(rows)
    base = [bytes(r["piece"]) for r in pieces.orderBy(F.desc("in_ordinary"), "piece").limit(BASE_PIECES).collect()]
    a, b = F.col("in_toxic") / max(nt, 1), F.col("in_ordinary") / max(no, 1)
    p = (F.col("in_toxic") + F.col("in_ordinary")) / max(nt + no, 1)
    z = (a - b) / F.sqrt(p * (1 - p) * (1 / max(nt, 1) + 1 / max(no, 1)) + F.lit(1e-12))
    toxic = {bytes(r["piece"]): r["in_toxic"] for r in pieces.where((z >= MIN_Z) & (a >= MIN_SHARE) & (F.col("in_toxic") >= 3)
                                                                        & (a * max(no, 1) >= MIN_LIFT * (F.col("in_ordinary") + 0.5)))
             .orderBy(z.desc(), "piece").limit(16 * TOXIC_PIECES).collect()}
    best = sorted(longest_forms(toxic), key=lambda x: (toxic[x], x))[-TOXIC_PIECES:]
    shared = b"".join(reversed(base)) or b" "
    return shared, b"".join(best) + shared


@functools.lru_cache(maxsize=2)
def _compressors(shared: Broadcast):
    def of(content: bytes):
        params = zstandard.ZstdCompressionParameters(
            window_log=10, hash_log=12, chain_log=12, search_log=3, min_match=4, strategy=zstandard.STRATEGY_GREEDY,
            write_checksum=False, write_content_size=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(compression_params=params, dict_data=d).compress
    return tuple(of(c) for c in shared.value)


def windows(text: bytes) -> list[bytes]:
    """Pieces of at most ``WINDOW`` bytes that end before a space where there is one."""
    out, at = [], 0
    while at < len(text):
        end = at + WINDOW
        if end < len(text):
            space = text.rfind(b" ", at + 1, end)
            end = space if space > at else end
        out.append(text[at:end])
        at = end
    return out or [b""]


FEATURES = 12


def features(text: bytes, shared: Broadcast) -> tuple[float, ...]:
    """What the windows' compression lengths say, from each window's advantage ``d`` of the
    toxic dictionary in bytes: mean, extremes, sums, and the shares of windows beyond bounds."""
    ordinary, toxic = _compressors(shared)
    d = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text.lower())], float)
    top = np.sort(d)[-2:]
    return (float(d.mean()), float(top[-1]), float(top.mean()), float(np.log1p(np.maximum(d - 1, 0).sum())), float(np.log1p(len(d))),
            *(float((d > k).mean()) for k in (1, 2, 3, 4)), float((d < 0).mean()), *(float(np.log1p((d > k).sum())) for k in (3, 4)))


def calibrate(x: np.ndarray, y: np.ndarray, prior: float):
    """Weights of a logistic regression (Newton steps, ridge), moved so that 0.5 is the
    threshold with the best F1 at the labels' own share of toxic texts."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    share = y.mean()
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + 1e-2 * np.r_[0, w[1:]]
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    s = z @ w
    order = np.argsort(-s)
    hit = np.cumsum((weight * y)[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + (weight * y).sum())
    k = int(f1.argmax())
    cut = (s[order][k] + (s[order][k + 1] if k + 1 < len(s) else s[order][k])) / 2
    w[0] -= cut
    return mean, scale, w


def scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    rows = sample(spark, docs, labels)
    share = labels.where("toxic IS NOT NULL").where(~held_out()).agg(F.avg("toxic")).first()[0] or 0.0
    model = None
    if 0 < share < 1 and rows.groupBy("fit", "toxic").count().count() == 4:
        shared = spark.sparkContext.broadcast(train_dictionaries(rows))
        names = [f"f{k}" for k in range(FEATURES)]

        def featured(batches):
            for b in batches:
                f = np.array([features(t, shared) for t in b.column(1).cast(pa.binary()).to_pylist()]).reshape(-1, FEATURES)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(f[:, k]) for k in range(FEATURES))], names=["toxic", *names])
        got = (rows.where("NOT fit").select(F.col("toxic").cast("int").alias("toxic"), "text")
               .mapInArrow(featured, "toxic int, " + ", ".join(f"{n} double" for n in names)).toArrow())  # bounded by the sample
        model = calibrate(np.column_stack([got[n].to_numpy() for n in names]), got["toxic"].to_numpy(), float(share))

    def per_batch(ids, texts):
        if model is None:
            s = np.full(len(texts), float(share))
        else:
            mean, scale, w = model
            f = np.array([features(t, shared) for t in texts]).reshape(-1, FEATURES)
            s = 1 / (1 + np.exp(-np.clip(w[0] + ((f - mean) / scale) @ w[1:], -30, 30)))
        return pa.RecordBatch.from_arrays([ids, pa.array(s, pa.float64())], names=["doc_id", "score"])
    scored = map_texts(id_text(docs), per_batch, "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
