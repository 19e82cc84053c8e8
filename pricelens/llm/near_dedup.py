"""SimHash near-duplicates (operator 6) by vantage-point trees.

Fingerprint: 64 majority bits over the XXH64 hashes (seed 42) of word shingles. Two
fingerprints link at ``max_distance`` or fewer differing bits; a component is all that
links reach.

The 64 bits are cut into bands, each with a radius, so that ``sum(radius + 1) >
max_distance``: a linked pair differs by at most the radius in one band at least. Hamming
distance inside a band obeys the triangle inequality and bounds the whole distance from
below, so each band has its own vantage-point tree:

* the top levels come from a bounded sample and split at the median distance from a
  vantage point; below them, as many levels as the table asks for, vantage points follow from the node's
  path by a rule (and split at half the band's width), so no tree grows with the table. Every fingerprint is a
  member of one leaf (shard) per band;
* as a query it visits each shard whose ball it may overlap: branches with
  ``|d - mu| > radius`` on the far side are pruned by the triangle inequality;
* a task continues the same search inside its shard and verifies all 64 bits.

Shorter distances per band cross far fewer branches than one tree over 64 bits would (there,
distances gather around 32 and a radius of 4 crosses three branches in four).

Tasks emit a spanning forest of the links they find, never all pairs; exact copies collapse
into their fingerprint first. Shards with many queries are cut into chunks.

Defined results: NULL and empty texts, and texts of white space alone, have fingerprint
zero. Repeated rows each give a row. A row without ``doc_id`` is linked like any other; its
component takes the smallest id that is not NULL (NULL if there is none). An empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, map_texts, written

SEED = 42
RADII = (1, 1, 0)              # 2 + 2 + 1 = 5 > 4 differing bits
WIDTHS = (23, 23, 18)          # bits of each band, from the highest
SAMPLE = 16_384                # fingerprints that the trees' top levels are fitted on
SHARD = 2_048                  # members aimed at in a shard
SAMPLE_DEPTH = 11              # levels fitted on the sample; deeper ones follow a rule
MAX_QUERIES = 16_384           # queries of a shard that one task takes
TILE = 1 << 20                 # comparisons made at once


# --- fingerprints ---------------------------------------------------------------

def simhash(text: bytes, shingle: int = 4) -> int:
    """The 64-bit fingerprint of a UTF-8 text (A-Z lower-cased)."""
    words = text.lower().split()  # on bytes, both are ASCII-only
    if not words:
        return 0
    s = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(s, SEED)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lens) - 1
    starts = ends - lens + 1
    starts, ends = starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(starts), 16_384):
        h = np.array([digest(s[i:j], SEED) for i, j in zip(starts[k:k + 16_384], ends[k:k + 16_384])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed bigint) for every row."""
    def per_batch(ids, texts):
        fp = np.array([simhash(t, shingle) for t in texts], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([ids, pa.array(fp)], names=["doc_id", "fp"])
    return map_texts(id_text(docs), per_batch, "doc_id bigint, fp bigint")


# --- vantage-point trees -----------------------------------------------------------

def band_masks(widths=WIDTHS) -> list[np.uint64]:
    out, at = [], 64
    for w in widths:
        at -= w
        out.append(np.uint64(((1 << w) - 1) << at))
    return out


def hamming(a, b):
    return np.bitwise_count(a ^ b).astype(np.int64)


def split_point(values: np.ndarray, rng: np.random.Generator):
    """A vantage point and median radius that part ``values`` best, or None."""
    best = None
    for v in values[rng.integers(0, len(values), 8)]:
        d = hamming(values, v)
        for mu in (int(np.median(d)) - 1, int(np.median(d))):
            small = min(n := int((d <= mu).sum()), len(values) - n)
            if small and (best is None or small > best[0]):
                best = (small, v, mu)
    return best and best[1:]


def build_tree(values: np.ndarray, depth: int, seed: int = 0):
    """Nested ``(vantage, mu, inside, outside)``; a leaf is its number."""
    rng, leaves = np.random.default_rng(seed), iter(range(1 << 30))

    def grow(v, depth):
        cut = split_point(v, rng) if depth and len(v) > 1 else None
        if cut is None:
            return next(leaves)
        inside = hamming(v, cut[0]) <= cut[1]
        return (*cut, grow(v[inside], depth - 1), grow(v[~inside], depth - 1))
    return grow(values, depth)


def route(tree, values: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(leaf, indices)`` of the values whose ball of ``radius`` may reach the leaf;
    with radius 0 each value has the one leaf that it is a member of."""
    todo = [(tree, np.arange(len(values)))]
    while todo:
        node, idx = todo.pop()
        if not len(idx):
            continue
        if isinstance(node, int):
            yield node, idx
            continue
        vantage, mu, inside, outside = node
        d = hamming(values[idx], vantage)
        todo += [(inside, idx[d - radius <= mu]), (outside, idx[d + radius > mu])]


def by_rule(leaf: int, path: int, level: int, mask: np.uint64) -> np.uint64:
    """The vantage point of a node below the fitted levels, from its place in the tree alone."""
    x = ((leaf << 40) ^ (path << 8) ^ level ^ int(mask)) & (1 << 64) - 1
    for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):  # mixed as a counter-based generator does
        x = (x ^ x >> 30) * k & (1 << 64) - 1
    return np.uint64(x ^ x >> 31) & mask


def descend(leaf: int, values: np.ndarray, idx: np.ndarray, radius: int, mask: np.uint64, levels: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(shard, indices)`` below a fitted leaf, ``levels`` deeper; the same pruning as ``route``."""
    mu = int(mask).bit_count() // 2 - (int(mask).bit_count() % 2 == 0)  # about half of all distances are that or less
    todo = [(0, 0, idx)]
    while todo:
        level, path, idx = todo.pop()
        if not len(idx):
            continue
        if level == levels:
            yield leaf << levels | path, idx
            continue
        d = hamming(values[idx], by_rule(leaf, path, level, mask))
        todo += [(level + 1, path << 1, idx[d - radius <= mu]), (level + 1, path << 1 | 1, idx[d + radius > mu])]


def links_between(q: np.ndarray, m: np.ndarray, mask: np.uint64, radius: int, max_distance: int,
                  rng: np.random.Generator, depth: int = 24) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of linked ``(query, member)`` values with query > member; the tree goes on
    inside the shard until a block of comparisons is small or can't be split."""
    if not len(q) or not len(m):
        return
    cut = split_point(m & mask, rng) if depth and len(q) * len(m) > TILE // 4 else None
    if cut is None:
        step = max(1, TILE // len(m)) if len(m) < TILE else 1
        for i in range(0, len(q), step):
            for j in range(0, len(m), TILE):
                a, b = q[i:i + step], m[j:j + TILE]
                x, y = np.nonzero((np.bitwise_count(a[:, None] ^ b[None, :]) <= max_distance) & (a[:, None] > b[None, :]))
                if len(x):
                    yield a[x], b[y]
        return
    dq, dm = hamming(q & mask, cut[0]), hamming(m & mask, cut[0])
    for qs, ms in ((dq - radius <= cut[1], dm <= cut[1]), (dq + radius > cut[1], dm > cut[1])):
        yield from links_between(q[qs], m[ms], mask, radius, max_distance, rng, depth - 1)


def forest(q: np.ndarray, m: np.ndarray, mask, radius: int, max_distance: int):
    """A spanning forest ``(node, smallest node of its tree)`` of a shard's links."""
    nodes = np.unique(np.concatenate([q, m]))
    root = np.arange(len(nodes))
    for a, b in links_between(q, m, mask, radius, max_distance, np.random.default_rng(0)):
        while True:  # hook the larger root under the smaller, then flatten
            x, y = root[np.searchsorted(nodes, a)], root[np.searchsorted(nodes, b)]
            differ = x != y
            if not differ.any():
                break
            a, b = a[differ], b[differ]
            np.minimum.at(root, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
            while (root != (up := root[root])).any():
                root = up
    kids = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[kids], nodes[root[kids]]


def links(spark: SparkSession, prints: DataFrame, max_distance: int = 4, radii=RADII, widths=WIDTHS) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the linked fingerprints of ``prints`` (distinct
    ``fp``), as spanning forests of the shards."""
    if sum(r + 1 for r in radii) <= max_distance or sum(widths) != 64:
        raise ValueError("the bands' radii do not cover the distance")
    n = prints.count()
    depth = max(0, math.ceil(math.log2(max(n, 1) / SHARD)))
    fitted = min(depth, SAMPLE_DEPTH)
    # The trees only need to balance: a bounded sample by hash order is enough.
    share = min(1.0, 2 * SAMPLE / max(n, 1))
    sample = (prints.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
              .orderBy(F.xxhash64("fp")).limit(SAMPLE).toArrow()["fp"].to_numpy().view(np.uint64))
    masks = band_masks(widths)
    trees = [build_tree(np.unique(sample & k), fitted, i) for i, k in enumerate(masks)]

    def shards(v: np.ndarray, band: int, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        k, deeper = masks[band], min(depth - fitted, widths[band])
        for leaf, idx in route(trees[band], v & k, radius):
            yield from descend(leaf, v & k, idx, radius, k, deeper)

    def routed(member: bool) -> DataFrame:
        def rows(v: np.ndarray) -> Iterator[pa.RecordBatch]:
            for band, r in enumerate(radii):
                for shard, idx in shards(v, band, 0 if member else r):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(idx), band << 56 | shard, np.int64)), pa.array(v[idx].view(np.int64))], names=["cell", "fp"])

        def run(batches):
            held, size = [], 0
            for b in batches:
                held.append(b.column(0).to_numpy().view(np.uint64))
                size += b.num_rows
                if size >= 1 << 16:
                    yield from rows(np.concatenate(held))
                    held, size = [], 0
            if size:
                yield from rows(np.concatenate(held))
        return prints.select("fp").mapInArrow(run, "cell bigint, fp bigint")

    # Shards with many queries are cut into chunks; members go to each chunk of their shard.
    cut = written(spark, routed(False).groupBy("cell").count().where(F.col("count") > MAX_QUERIES)
                  .select("cell", F.ceil(F.col("count") / MAX_QUERIES).cast("int").alias("parts")), "hot-shards")
    hot = not cut.isEmpty()
    queries, members = routed(False), routed(True)
    if hot:
        parts_of = F.coalesce("parts", F.lit(1))
        queries = queries.join(cut, "cell", "left").select("cell", F.pmod(F.xxhash64("fp"), parts_of).cast("int").alias("chunk"), F.lit(0).cast("byte").alias("member"), "fp")
        members = members.join(cut, "cell", "left").select("cell", F.explode(F.sequence(F.lit(0), parts_of - 1)).alias("chunk"), F.lit(1).cast("byte").alias("member"), "fp")
    else:
        queries, members = (x.select("cell", F.lit(0).alias("chunk"), F.lit(m).cast("byte").alias("member"), "fp") for x, m in ((queries, 0), (members, 1)))

    def search(batches):
        key, held = None, ([], [])

        def found():
            q, m = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in held)
            a, b = forest(q, m, masks[key[0] >> 56], radii[key[0] >> 56], max_distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
        for batch in batches:
            cell, chunk, member, fp = (c.to_numpy() for c in batch.columns)
            cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (chunk[1:] != chunk[:-1]) | (member[1:] != member[:-1])) + 1).tolist(), len(cell)]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                now = (int(cell[s]), int(chunk[s]))
                if key is not None and now != key:
                    yield found()
                    held = ([], [])
                key = now
                held[member[s]].append(fp[s:e].view(np.uint64).copy())
        if key is not None:
            yield found()

    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = queries.unionByName(members).repartition(parts, "cell", "chunk").sortWithinPartitions("cell", "chunk", "member")
    return dealt.mapInArrow(search, "a bigint, b bigint").distinct()


# --- components -----------------------------------------------------------------

def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``(fp, root)`` for every node of ``edges``: minimum labels spread along the edges and
    jump to their label's label, until nothing changes (rounds grow with the logarithm of
    the longest path). Every round is a written table; only a count reaches the driver."""
    both = written(spark, edges.union(edges.select("b", "a")).distinct(), "edges")
    lab = written(spark, both.groupBy(F.col("a").alias("fp")).agg(F.min("b").alias("m"))
                  .select("fp", F.least("fp", "m").alias("root")), "labels")
    while True:
        near = (both.join(lab.select(F.col("fp").alias("b"), "root"), "b")
                .groupBy(F.col("a").alias("fp")).agg(F.min("root").alias("near")))
        step = written(spark, lab.join(near, "fp").select(
            "fp", F.col("root").alias("old"), F.least("root", "near").alias("up")), "step")
        top = step.select(F.col("fp").alias("up"), F.col("up").alias("top"))
        nxt = written(spark, step.join(top, "up").select("fp", "old", F.least("up", "top").alias("root")), "labels")
        if nxt.where("root <> old").isEmpty():
            return nxt.select("fp", "root")
        lab = nxt.select("fp", "root")


def near_groups(spark: SparkSession, docs: DataFrame, shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits), ``component_id`` for every row."""
    rows = written(spark, fingerprints(docs, shingle), "fingerprints")
    prints = written(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    lab = components(spark, links(spark, prints, max_distance))
    linked = prints.join(lab, "fp")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    group = lab.join(smallest, "root").select("fp", "component_id")
    # A table of its own: rows of one hot fingerprint can then be split over tasks.
    of_print = written(spark, prints.join(group, "fp", "left").select(
        "fp", F.coalesce("component_id", "first").alias("component_id")), "components")
    return rows.join(of_print, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(spark: SparkSession, docs: DataFrame, shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """``docs`` with one row of every component left, the one with the smallest ``doc_id``
    (rows without an id rank last). Each row is judged by its own text, whatever other rows
    have its id or none."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    # Written once, so that the numbers hold for every later read.
    numbered = written(spark, docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*cols).alias("doc")), "numbered")
    prints_of = fingerprints(numbered.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")), shingle)
    rows = written(spark, prints_of.select(F.col("doc_id").alias("row"), "fp"), "fingerprints")
    ids = numbered.select("row", F.col("doc.doc_id").cast("bigint").alias("doc_id"))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    prints = written(spark, rows.join(ids, "row").groupBy("fp").agg(F.min(rank).alias("first")), "prints")
    lab = components(spark, links(spark, prints, max_distance))
    keep = prints.join(lab, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    return numbered.join(keep.select(F.col("first.row").alias("row")), "row", "left_semi").select("doc.*")
