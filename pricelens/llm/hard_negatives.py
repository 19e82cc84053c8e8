"""Hard-negative mining (operator 12) with cover trees over norm-augmented vectors.

Components are ``floor(256 x)``, scores integer inner products. A candidate ``x`` gets one more
component ``sqrt(M - |x|^2)`` (``M`` the largest squared norm), an anchor ``q`` a zero: inner products
stay, all candidates have one norm, so distance and inner product order them alike. For a
node with centre ``c`` and covering radius ``R`` (the largest distance of any vector below it),

    q.c - |q| R  <=  q.x  <=  q.c + |q| R    for every x below.

1. The top level: centres spread by farthest-first choice over a bounded sample; each vector
   belongs to its nearest centre (cell), whose exact count and radius are aggregated. Cells are
   cut into chunks of about ``SHARD`` vectors, and anchors into blocks of ``BLOCK``: a task holds one chunk and
   the anchors of one block stream past it, ``QUERIES`` at a time. An anchor goes only to cells whose bounds meet its
   windows.
2. In a task the tree goes on: each node splits at farthest-first centres (its own centre is the
   first; centres are farther apart than the radius that they then cover) down to leaves.
   Level by level, nodes whose bounds miss all windows of an anchor are dropped.
3. Leaves are taken best first: the ``FIRST`` leaves of highest bound, then those whose bound still
   reaches what has been found; each is verified by exact inner products.

The first pass finds each anchor's positives (same label, any score), the second, per positive,
the negatives in the window of its score. A chunk gives at most ``k`` rows for each window, and
they merge by a limit per window with a map-side part. Results are exact; the tree only decides what is not looked at (for
vectors without any structure that is little).

Defined results: rows with a NULL label or vector, or a NULL or non-finite component (256-fold,
too) take no part. Vectors of other lengths are padded with zeros. Repeated rows are rows of
their own: a copy of the anchor may be its positive, but the anchor itself is not. A NULL
``vec_id`` is no anchor and ranks last among ties; further ties are taken in row order. Scores that
a long can't hold fail the job. Empty tables and anchors without positives or negatives give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90       # a negative's score in hundredths of the positive's
SAMPLE = 8_192           # vectors that the top level's centres are chosen from
MAX_CELLS = 1_024
SHARD = 4_096            # vectors of a chunk, about
BLOCK = 65_536           # anchors of a block, about
QUERIES = 512            # anchors searched at once
FANOUT, LEAF = 16, 64
FIRST = 8                # leaves that every anchor visits before bounds are compared with what was found
EXACT = 2.0 ** 53
NEVER = np.int64(2**63 - 1)
VECTOR_SCHEMA = "row bigint, vec_id bigint, label bigint, v array<double>, n2 double"


# --- tree ----------------------------------------------------------------------------

def spread(points: np.ndarray, k: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Farthest-first choice of up to ``k`` centres from ``first`` on: their indices, and each
    point's nearest of them. Distinct centres are at least the final radius apart."""
    chosen, near = [first], np.zeros(len(points), np.int64)
    d = _distances(points, points[first])
    while len(chosen) < k and d.max() > 0:
        chosen.append(int(d.argmax()))
        new = _distances(points, points[chosen[-1]])
        near[new < d] = len(chosen) - 1
        d = np.minimum(d, new)
    return np.array(chosen), near


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    x = points - centre
    return np.sqrt(np.einsum("ij,ij->i", x, x))


class Tree:
    """A cover tree over augmented vectors: levels of ``(centres, radii, parents)``; ``leaves``
    holds node and members (in the order of the given rows) of each leaf."""

    def __init__(self, points: np.ndarray, fanout: int = FANOUT, leaf: int = LEAF):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.leaves: list[tuple[int, int, np.ndarray]] = []  # level, node, members
        # the root's centre is a point too, so that centres nest
        nodes = [(0, np.arange(len(points)), -1)] if len(points) else []
        while nodes:
            centres = points[[c for c, _, _ in nodes]]
            radii = np.array([_distances(points[m], points[c]).max() for c, m, _ in nodes])
            self.levels.append((centres, radii, np.array([p for _, _, p in nodes])))
            below = []
            for i, ((c, members, _), radius) in enumerate(zip(nodes, radii)):
                if len(members) <= leaf or radius == 0:
                    self.leaves.append((len(self.levels) - 1, i, members))
                    continue
                chosen, near = spread(points[members], fanout, int(np.flatnonzero(members == c)[0]))
                below += [(int(members[chosen[j]]), members[near == j], i) for j in range(len(chosen))]
            nodes = below


def bounds(q: np.ndarray, norms: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores below each node, widened by rounding."""
    d = q @ centres[:, :q.shape[1]].T
    r = norms[:, None] * radii[None, :]
    r += 1 + 1e-9 * (r + np.abs(d))
    return d - r, d + r


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer-valued rows, exact: as floats where no sum can pass 2**53, else as Python's integers."""
    most = np.sqrt((a * a).sum(1).max(initial=0) * (b * b).sum(1).max(initial=0))
    if most < EXACT / 4:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return whole(a).dot(whole(b).T)


def search(tree: Tree, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, q: np.ndarray, own: np.ndarray,
           q_labels: np.ndarray, lo: np.ndarray, hi: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, ...]:
    """``(anchor, window, member, score)`` of the best ``k`` members of each window ``lo <= score
    <= hi`` (whole numbers, anchors x windows; none: ``lo > hi``) with the anchor's label
    (``same``) or any other. Members are in tie order."""
    norms = np.sqrt((q * q).sum(1))
    least, most = lo.min(axis=1), hi.max(axis=1)
    alive, upper = [], []
    for centres, radii, parents in tree.levels:
        low, up = bounds(q, norms, centres, radii)
        ok = (up >= least[:, None]) & (low <= most[:, None])
        alive.append(ok & alive[-1][:, parents] if alive else ok)
        upper.append(up)
    found: list[tuple[np.ndarray, ...]] = []
    if not tree.leaves:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    ok = np.stack([alive[level][:, i] for level, i, _ in tree.leaves], axis=1)
    top = np.where(ok, np.stack([upper[level][:, i] for level, i, _ in tree.leaves], axis=1), -np.inf)
    kth = lo.copy()  # below this a member can't matter
    first = np.zeros(ok.shape, bool)
    best = np.argsort(-top, axis=1, kind="stable")[:, :FIRST]
    np.put_along_axis(first, best, True, axis=1)
    for visit in (ok & first, ok & ~first):
        for j, (_, _, members) in enumerate(tree.leaves):
            a = np.flatnonzero(visit[:, j] & (top[:, j] >= kth.min(axis=1)))
            if not len(a):
                continue
            s = exact(q[a], vectors[members])
            fits = (labels[members][None, :] == q_labels[a][:, None]) == same
            if same:
                fits &= rows[members][None, :] != own[a][:, None]
            for w in range(lo.shape[1]):
                x, y = np.nonzero(fits & (s >= kth[a, w][:, None]) & (s <= hi[a, w][:, None]))
                if len(x):
                    found.append((a[x], np.full(len(x), w), members[y], s[x, y]))
        found = [_best(found, k)] if found else []
        if found:  # the k-th score of a full window
            a, w, _, s = found[0]
            place = a * lo.shape[1] + w
            starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            full = np.diff(np.r_[starts, len(place)]) == k
            last = (starts + k - 1)[full]
            kth[a[last], w[last]] = s[last].astype(np.int64)
    return found[0] if found else tuple(np.empty(0, np.int64) for _ in range(4))


def _best(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The first ``k`` of each (anchor, window) by score descending, then member."""
    a, w, m, s = (np.concatenate(x) for x in zip(*found))
    if s.dtype == object:
        order = np.array(sorted(range(len(a)), key=lambda i: (a[i], w[i], -s[i], m[i])), np.int64)
    else:
        order = np.lexsort((m, -s, w, a))
    a, w, m, s = a[order], w[order], m[order], s[order]
    starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (w[1:] != w[:-1])])
    place = np.arange(len(a)) - np.repeat(starts, np.diff(np.r_[starts, len(a)]))
    keep = place < k
    return a[keep], w[keep], m[keep], s[keep]


# --- rows ----------------------------------------------------------------------------

def _matrix(col: pa.ListArray, width: int) -> np.ndarray:
    flat, offsets = col.flatten().to_numpy(), col.offsets.to_numpy()
    offsets = offsets - offsets[0]
    if len(col) and (np.diff(offsets) == width).all():
        return flat.reshape(len(col), width)
    out = np.zeros((len(col), width))
    for i, (s, e) in enumerate(zip(offsets, offsets[1:])):
        out[i, :e - s] = flat[s:e]
    return out


def _windows(lows: pa.ListArray, highs: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number windows as two matrices, padded with empty ones."""
    los, his = lows.to_pylist(), highs.to_pylist()
    w = max(map(len, los))
    lo, hi = np.full((len(los), w), NEVER), np.full((len(los), w), -NEVER)
    for i, (x, y) in enumerate(zip(los, his)):
        lo[i, :len(x)], hi[i, :len(y)] = x, y
    return lo, hi


def vectors(rows: DataFrame, label: Column) -> DataFrame:
    """Numbered rows that take part: ``row, vec_id, label, v, n2`` with integer-valued ``v``."""
    def run(batches):
        for b in batches:
            offsets = b.column(3).offsets.to_numpy()
            offsets = offsets - offsets[0]
            with np.errstate(over="ignore", invalid="ignore"):
                v = np.floor(b.column(3).flatten().to_numpy(zero_copy_only=False) * SCALE)  # NULL is NaN
            bad = np.r_[0, np.cumsum(~np.isfinite(v))]
            keep = pa.array(bad[offsets[1:]] == bad[offsets[:-1]])
            part = pa.RecordBatch.from_arrays([*b.columns[:3], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v))],
                                              names=["row", "vec_id", "label", "v"]).filter(keep)
            if part.num_rows:
                m = _matrix(part.column(3), max(1, int(np.diff(part.column(3).offsets.to_numpy()).max())))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array((m * m).sum(1))], names=["row", "vec_id", "label", "v", "n2"])
    return (rows.where("label IS NOT NULL AND embedding IS NOT NULL")
            .select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"), label.alias("label"),
                    F.col("embedding").cast("array<double>").alias("v")).mapInArrow(run, VECTOR_SCHEMA))


def augmented(m: np.ndarray, n2: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([m, np.sqrt(np.maximum(most - n2, 0))[:, None]], axis=1)


class Cells:
    """The top level: centres (bounded), and each cell's radius and number of chunks."""

    def __init__(self, spark: SparkSession, rows: DataFrame, shard: int):
        self.rows, self.shard = rows, shard
        self.n, self.most, self.width = rows.agg(F.count("*"), F.coalesce(F.max("n2"), F.lit(0.0)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
        self.width = max(self.width, 1)
        share = min(1.0, 2 * SAMPLE / max(self.n, 1))
        sample = (rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
                  .orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("v", "n2").toArrow())
        points = augmented(_matrix(sample["v"].combine_chunks(), self.width), sample["n2"].to_numpy(), self.most) if sample.num_rows else np.zeros((1, self.width + 1))
        self.centres = points[spread(points, min(MAX_CELLS, max(1, math.ceil(self.n / shard))))[0]]
        self.placed = written(spark, self._placed(), "placed")
        own = {r["cell"]: r for r in self.placed.groupBy("cell").agg(F.max("d").alias("radius"), F.count("*").alias("n")).collect()}  # a row a cell
        self.radii = np.array([own[c]["radius"] if c in own else -np.inf for c in range(len(self.centres))])
        self.chunks = np.array([math.ceil(own[c]["n"] / shard) if c in own else 0 for c in range(len(self.centres))])

    def _placed(self) -> DataFrame:
        centres, most, width = self.centres, self.most, self.width
        c2 = (centres * centres).sum(1)

        def run(batches):
            for b in batches:
                m = augmented(_matrix(b.column(3), width), b.column(4).to_numpy(), most)
                cell = (c2[None, :] - 2 * m @ centres.T).argmin(axis=1)
                x = m - centres[cell]
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(np.sqrt((x * x).sum(1))), *b.columns],
                                                 names=["cell", "d", "row", "vec_id", "label", "v", "n2"])
        return self.rows.mapInArrow(run, "cell int, d double, " + VECTOR_SCHEMA)

    def best(self, spark: SparkSession, anchors: DataFrame, n_anchors: int, same: bool, k: int) -> DataFrame:
        """``anchor (row), slot, score, vec_id, row`` of the best ``k`` rows for each window of ``anchors(row, vec_id, label, v,
        windows array<struct<slot, lo, hi>>)``."""
        blocks = max(1, math.ceil(n_anchors / BLOCK))
        centres, radii, chunks, width, most = self.centres, self.radii, self.chunks, self.width, self.most
        schema = "cell int, chunk int, block int, anchor boolean, row bigint, vec_id bigint, label bigint, v array<double>, n2 double, slots array<int>, lo array<bigint>, hi array<bigint>"
        names = [x.split()[0] for x in schema.split(", ")]

        def routed(batches):  # an anchor to every chunk of the cells whose bounds meet its windows
            for b in batches:
                q = _matrix(b.column(3), width)
                lo, hi = _windows(b.column(5), b.column(6))
                low, up = bounds(q, np.sqrt((q * q).sum(1)), centres, np.maximum(radii, 0))
                x, cell = np.nonzero((up >= lo.min(axis=1)[:, None]) & (low <= hi.max(axis=1)[:, None]) & (chunks > 0)[None, :])
                x, cell = np.repeat(x, chunks[cell]), np.repeat(cell, chunks[cell])
                starts = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (cell[1:] != cell[:-1])]) if len(x) else np.empty(0, np.int64)
                chunk = np.arange(len(x)) - np.repeat(starts, np.diff(np.r_[starts, len(x)]))
                for i in range(0, len(x), 4_096):
                    p = pa.RecordBatch.from_arrays(list(b.columns), names=b.schema.names).take(pa.array(x[i:i + 4_096]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell[i:i + 4_096].astype(np.int32)), pa.array(chunk[i:i + 4_096].astype(np.int32)), p.column(7), pa.array(np.ones(p.num_rows, bool)),
                         p.column(0), p.column(1), p.column(2), p.column(3), pa.nulls(p.num_rows, pa.float64()), p.column(4), p.column(5), p.column(6)], names=names)
        block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
        asked = anchors.select("row", "vec_id", "label", "v", F.col("windows.slot").alias("slots"), F.col("windows.lo").alias("lo"), F.col("windows.hi").alias("hi"),
                               block.alias("block")).mapInArrow(routed, schema)
        count = F.element_at(F.array(*[F.lit(int(max(c, 1))) for c in chunks]), F.col("cell") + 1)
        members = self.placed.select("cell", F.pmod(F.xxhash64("row"), count).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                                     F.lit(False).alias("anchor"), "row", "vec_id", "label", "v", "n2",
                                     *[F.lit(None).cast(t).alias(c) for c, t in (("slots", "array<int>"), ("lo", "array<bigint>"), ("hi", "array<bigint>"))])
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        dealt = members.unionByName(asked).repartition(parts, "cell", "chunk", "block").sortWithinPartitions("cell", "chunk", "block", "anchor")

        def visit(batches):
            key, held, tree = None, [], None

            def grown(parts):
                t = pa.Table.from_batches(parts)
                ids, numbers = t["vec_id"].to_pylist(), t["row"].to_pylist()
                t = t.take(pa.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, numbers[i])), pa.int64())).combine_chunks()
                v = _matrix(t["v"].combine_chunks(), width)
                return Tree(augmented(v, t["n2"].to_numpy(), most)), v, t["vec_id"].combine_chunks(), t["row"].to_numpy(), t["label"].to_numpy()
            for b in batches:
                code = np.stack([b.column(i).to_numpy() for i in range(3)])
                is_anchor = b.column(3).to_numpy(zero_copy_only=False)
                change = np.flatnonzero((code[:, 1:] != code[:, :-1]).any(axis=0) | (is_anchor[1:] != is_anchor[:-1])) + 1
                for s, e in zip([0, *change.tolist()], [*change.tolist(), b.num_rows]):
                    if s == e:
                        continue
                    now, part = tuple(code[:, s].tolist()), b.slice(s, e - s)
                    if now != key:
                        key, held, tree = now, [], None
                    if not is_anchor[s]:  # members come first
                        held.append(part)
                        continue
                    if tree is None:
                        if not held:
                            continue  # a chunk without members
                        tree, held = grown(held), []
                    for i in range(0, part.num_rows, QUERIES):
                        yield answer(tree, part.slice(i, QUERIES))

        def answer(own, part):
            tree, v, ids, rows, labels = own
            slots = part.column(9).to_pylist()
            lo, hi = _windows(part.column(10), part.column(11))
            anchor = part.column(4).to_numpy()
            a, j, m, s = search(tree, v, ids, rows, labels, _matrix(part.column(7), width), anchor, part.column(6).to_numpy(), lo, hi, same, k)
            return pa.RecordBatch.from_arrays(
                [pa.array(anchor[a]), pa.array([slots[x][y] for x, y in zip(a.tolist(), j.tolist())], pa.int32()), pa.array(s.tolist(), pa.int64()),
                 ids.take(pa.array(m, pa.int64())), pa.array(rows[m])], names=["anchor", "slot", "score", "vec_id", "row"])
        found = dealt.mapInArrow(visit, "anchor bigint, slot int, score bigint, vec_id bigint, row bigint")
        order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.col("vec_id").isNull(), "vec_id", "row")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(spark: SparkSession, rows: DataFrame, label: Column | None = None, anchor: Column | None = None, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, shard: int = SHARD) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``rows(vec_id,
    embedding, label)``. ``label`` and ``anchor`` are columns over ``rows`` and over ``vec_id``; by default
    the label as it is, and every row an anchor."""
    label = (F.col("label") if label is None else label).cast("bigint")
    table = written(spark, vectors(rows, label), "vectors")
    cells = Cells(spark, table, shard)
    chosen = table.where("vec_id IS NOT NULL" if anchor is None else anchor)
    n = chosen.count()
    everything = F.array(F.struct(F.lit(0).alias("slot"), F.lit(-int(NEVER)).alias("lo"), F.lit(int(NEVER)).alias("hi")))
    first = written(spark, cells.best(spark, chosen.select("row", "vec_id", "label", "v", everything.alias("windows")), n, True, positives)
                    .select("anchor", F.col("rank").cast("int").alias("slot"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")), "positives")
    # low * p <= 100 * s <= high * p; no window where it is empty
    p = F.col("positive_score").cast("decimal(20,0)")
    lo, hi = F.ceil(p * low / 100).cast("bigint"), F.floor(p * high / 100).cast("bigint")
    asked = chosen.select("row", "vec_id", "label", "v").join(
        first.where(lo <= hi).groupBy(F.col("anchor").alias("row")).agg(  # at most ``positives`` in a list
            F.sort_array(F.collect_list(F.struct("slot", lo.alias("lo"), hi.alias("hi")))).alias("windows")), "row")
    best = cells.best(spark, asked, n, False, negatives)
    return (best.select("anchor", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(first, ["anchor", "slot"]).join(chosen.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
