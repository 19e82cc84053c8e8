"""Byte-level BPE encoding and decoding (operator 4) by a global distinct-word shuffle.

1. Tasks split texts into pre-tokens and number them by position. Positions stay packed: a
   block of documents has a local dictionary, and a document is a list of local numbers.
2. Dictionaries are exploded into buckets by word hash and shuffled, so all occurrences of
   a word meet: a block sends a word once, however often it occurs (the map-side combine;
   the commonest word costs one entry per block).
3. A bucket encodes each distinct word once.
4. Ids go back to their blocks; every document is put together by position.

Decoding joins ids with the token-byte table (a bounded vocabulary file, broadcast).

Blocks are named after their content, so a re-run task whose input came in another order
can't be mixed up with the lost one: a block with missing words fails instead.

Defined results: a NULL or empty text has no tokens and decodes to no bytes; repeated rows
and rows without ``doc_id`` each give a row; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text
from .pretoken import BYTE_LEVEL_PATTERN, gather, join_parts, pack_ints, split_parts, splitter, unpack_ints

BLOCK_WORDS = 400_000   # distinct words of a block (some 60 MB in a task)
CHUNK_TOKENS = 1 << 17  # pre-tokens packed in one row, whole documents
WORDS, DOCS = 0, 1
PARTS = "bucket int, block bigint, kind byte, n_words int, doc_ids array<bigint>, sizes array<int>, payload binary"
_NAMES = ["bucket", "block", "kind", "n_words", "doc_ids", "sizes", "payload"]
_TYPES = [pa.int32(), pa.int64(), pa.int8(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file (one base64 token and its rank a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def _row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _TYPES)], names=_NAMES)


class _Numbers(dict):
    """word -> local number, in order of first occurrence."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def split_blocks(batches: Iterator[pa.RecordBatch], pattern: str, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of packed documents (spread over the buckets) and of words (by their bucket)."""
    split, pack = splitter(pattern), zstandard.ZstdCompressor(level=3).compress
    task, closed = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
    numbers, chunks, ids, sizes, flat = _Numbers(), [], [], [], []

    def close_chunk():
        if ids:
            chunks.append((ids[:], sizes[:], np.array(flat, np.uint32)))
            ids.clear(), sizes.clear(), flat.clear()

    def close_block():
        nonlocal numbers, closed
        close_chunk()
        # Number anew, common words first: their numbers take one byte.
        times = sum(np.bincount(local, minlength=len(numbers)) for _, _, local in chunks)
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        words = [w.encode() for w in numbers]
        words = [words[i] for i in order.tolist()]
        digest = xxhash.xxh64(b"%d-%d" % (task, closed))
        for w in words:
            digest.update(w)
        block = np.uint64(digest.intdigest()).astype(np.int64).item()
        bucket = np.fromiter((xxhash.xxh32_intdigest(w) for w in words), np.int64, len(words)) % buckets
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            own = order[cuts[b]:cuts[b + 1]]
            mine = [words[i] for i in own.tolist()]
            yield _row(b, block, WORDS, len(words), None, None, join_parts(
                [pack_ints(np.diff(own, prepend=0), pack), pack_ints([len(w) for w in mine], pack), pack(b"".join(mine))]))
        for k, (i, s, local) in enumerate(chunks):
            yield _row((block + k) % buckets, block, DOCS, len(words), i, s, pack_ints(rank[local], pack))
        numbers, closed = _Numbers(), closed + 1
        chunks.clear()

    for b in batches:
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            local = list(map(numbers.__getitem__, split(text)))
            ids.append(i)
            sizes.append(len(local))
            flat += local
            if len(flat) >= CHUNK_TOKENS:
                close_chunk()
            if len(numbers) >= BLOCK_WORDS:
                yield from close_block()
    if ids or chunks:
        yield from close_block()


def _words(payload: bytes, unpack):
    """Local numbers and words of a word row."""
    own, lens, data = split_parts(payload)
    data = unpack(data)
    ends = list(accumulate(unpack_ints(lens, unpack).tolist(), initial=0))
    return np.cumsum(unpack_ints(own, unpack)), [data[s:e] for s, e in zip(ends, ends[1:])]


@functools.lru_cache(maxsize=2)
def _merges(ranks: Broadcast):
    """``word -> ids`` for one whole pre-token (loaded once per Python worker)."""
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks.value, special_tokens={}).encode_ordinary


def encode_words(batches: Iterator[pa.RecordBatch], ranks: Broadcast) -> Iterator[pa.RecordBatch]:
    """Encode each distinct word of a bucket once; document rows pass through."""
    encode, vocabulary = _merges(ranks), ranks.value
    pack, unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
    bucket, known = None, {}
    for batch in batches:
        kinds, at = batch.column("kind").to_pylist(), batch.column("bucket").to_pylist()
        payloads = []
        for kind, b, payload in zip(kinds, at, batch.column("payload").to_pylist()):
            if kind == DOCS:
                payloads.append(payload)
                continue
            if b != bucket:
                bucket, known = b, {}
            own, words = _words(payload, unpack)
            found = []
            for w in words:
                ids = known.get(w)
                if ids is None:
                    r = vocabulary.get(w)
                    known[w] = ids = encode(w.decode()) if r is None else [r]
                found.append(ids)
            payloads.append(join_parts([pack_ints(np.diff(own, prepend=0), pack), pack_ints([len(x) for x in found], pack),
                                        pack_ints([i for x in found for i in x], pack)]))
        yield batch.set_column(batch.schema.get_field_index("payload"), "payload", pa.array(payloads, pa.binary()))


def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, ids``: block after block, its words first, then its documents."""
    block, parts, table = None, [], None
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for b, kind, n_words, ids, sizes, payload in zip(*(batch.column(c).to_pylist() for c in _NAMES[1:])):
            if b != block:
                block, parts, table = b, [], None
            if kind == WORDS:
                own, n, flat = (unpack_ints(p, unpack) for p in split_parts(payload))
                parts.append((np.cumsum(own), n, flat.astype(np.int32)))
                continue
            if table is None:
                own = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int64)
                if len(own) != n_words or len(np.unique(own)) != n_words:
                    raise RuntimeError("a block of documents has lost words; run the query again")
                n = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.int64)
                pool = np.concatenate([p[2] for p in parts]) if parts else np.empty(0, np.int32)
                starts, size = np.empty(n_words, np.int64), np.empty(n_words, np.int64)
                starts[own], size[own] = np.cumsum(n) - n, n
                table, parts = (pool, starts, size), []
            pool, starts, size = table
            local = unpack_ints(payload, unpack)
            tokens = size[local]
            flat = gather(pool, starts[local], tokens)
            upto = np.r_[0, np.cumsum(tokens)]
            offsets = upto[np.r_[0, np.cumsum(sizes)].astype(np.int64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))],
                names=["doc_id", "ids"])


def encode(spark: SparkSession, docs: DataFrame, ranks: dict[bytes, int], pattern: str = BYTE_LEVEL_PATTERN) -> DataFrame:
    """``doc_id, ids array<int>`` for every row."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = parts
    shared = spark.sparkContext.broadcast(ranks)
    split = id_text(docs).mapInArrow(lambda it: split_blocks(it, pattern, buckets), PARTS)
    met = split.repartition(parts, "bucket").sortWithinPartitions("bucket")
    back = met.mapInArrow(lambda it: encode_words(it, shared), PARTS)
    home = back.repartition(parts, "block").sortWithinPartitions("block", "kind")
    return home.mapInArrow(assemble, "doc_id bigint, ids array<int>")


def decode(spark: SparkSession, encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``doc_id, ids, decoded binary``: each id joined with its bytes, in order. An id that
    the table lacks is an error."""
    size = max(ranks.values(), default=-1) + 1
    token = [b""] * size
    for t, r in ranks.items():
        token[r] = t
    lens = np.array([len(t) for t in token], np.int64)
    shared = spark.sparkContext.broadcast((np.frombuffer(b"".join(token), np.uint8), np.cumsum(lens) - lens, lens))

    def run(batches):
        pool, starts, lens = shared.value
        for b in batches:
            lists = b.column("ids")
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() >= len(lens) or not lens[ids].all()):
                raise ValueError("a token id is not in the vocabulary")
            data = gather(pool, starts[ids], lens[ids]).tobytes()
            upto = np.r_[0, np.cumsum(lens[ids])]
            cuts = upto[np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)].tolist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, pa.array([data[s:e] for s, e in zip(cuts, cuts[1:])], pa.binary())],
                                             names=["doc_id", "ids", "decoded"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, decoded binary")


def round_trip(spark: SparkSession, docs: DataFrame, path: str, pattern: str = BYTE_LEVEL_PATTERN) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row."""
    ranks = load_ranks(path)
    decoded = decode(spark, encode(spark, docs, ranks, pattern), ranks)
    return decoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
