import re

import numpy as np
import pytest
import xxhash

from pricelens.llm import near_dedup as N
from . import data


def brute_print(text, k=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """rows: (doc_id, fp); component ids by plain search."""
    fps = sorted({f for _, f in rows})
    seen, comp = set(), {}
    for f in fps:
        if f in seen:
            continue
        todo, group = [f], {f}
        while todo:
            x = todo.pop()
            for y in fps:
                if y not in group and bin(x ^ y).count("1") <= 4:
                    group.add(y)
                    todo.append(y)
        seen |= group
        ids = [d for d, g in rows if g in group and d is not None]
        comp |= {g: min(ids) if ids else None for g in group}
    return comp


def test_edge_documents(spark):
    rows = [(r[0], brute_print(r[1])) for r in data.documents() if len(r[1] or "") < 10_000]
    long = [r for r in data.documents() if len(r[1] or "") >= 10_000]
    rows += [(r[0], N.simhash(r[1].encode())) for r in long]
    comp = brute_components(rows)
    got = N.near_groups(spark, data.frame(spark))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((d, f"{f:016x}", comp[f]) for d, f in rows), key=repr)
    assert N.near_groups(spark, data.empty(spark)).count() == 0


def test_long_texts_are_summed_in_pieces():
    words = [f"w{i % 777}" for i in range(40_000)]
    assert N.simhash(" ".join(words).encode()) == brute_print(" ".join(words))


def clusters(seed, n=1500):
    """Random fingerprints, chains of close ones, and one dense ball."""
    rng = np.random.default_rng(seed)
    out = list(rng.integers(0, 1 << 64, n, dtype=np.uint64))
    for base in out[:60]:
        x = int(base)
        for _ in range(int(rng.integers(1, 6))):
            for b in rng.choice(64, int(rng.integers(1, 7)), replace=False):
                x ^= 1 << int(b)
            out.append(np.uint64(x))
    ball = int(out[100])
    for _ in range(400):
        x = ball
        for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
            x ^= 1 << int(b)
        out.append(np.uint64(x))
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("fitted", [11, 2, 0])
def test_links_equal_brute_force(spark, monkeypatch, fitted):
    monkeypatch.setattr(N, "SAMPLE_DEPTH", fitted)  # the other levels follow the rule
    monkeypatch.setattr(N, "SHARD", 64)
    monkeypatch.setattr(N, "MAX_QUERIES", 100)
    monkeypatch.setattr(N, "TILE", 1 << 10)
    fps = clusters(5)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp bigint").repartition(3)
    for radii, widths in (((1, 1, 0), (23, 23, 18)), ((4,), (64,)), ((0,) * 5, (13, 13, 13, 13, 12))):
        edges = N.links(spark, df, 4, radii, widths)
        for a, b in edges.limit(50).collect():
            assert a != b
        lab = {r.fp & (1 << 64) - 1: r.root for r in N.components(spark, edges).collect()}
        comp = brute_components([(i, int(f)) for i, f in enumerate(fps)])
        groups, mine = {}, {}
        for f in map(int, fps):
            groups.setdefault(comp[f], set()).add(f)
            mine.setdefault(lab.get(f, ("alone", f)), set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_levels_by_rule_halve_the_shards():
    """Whatever the depth: a member has one shard, a query of the radius meets all members within it, and shards
    shrink with the levels, so that members and visits follow the table."""
    rng = np.random.default_rng(3)
    v = np.unique(rng.integers(0, 1 << 64, 20_000, dtype=np.uint64))
    for mask, radius in zip(N.band_masks(), N.RADII):
        largest = []
        for levels in (0, 3, 6, 9):
            home, visits = np.full(len(v), -1), [set() for _ in range(300)]
            for shard, idx in N.descend(5, v & mask, np.arange(len(v)), 0, mask, levels):
                assert (home[idx] == -1).all() and shard >> levels == 5
                home[idx] = shard
            assert (home >= 0).all()
            near = v[:300].copy()
            for i in range(radius):  # change a bit of the band
                bits = np.flatnonzero(np.array([int(mask) >> b & 1 for b in range(64)]))
                near ^= np.uint64(1) << rng.choice(bits, 300).astype(np.uint64)
            for shard, idx in N.descend(5, near & mask, np.arange(300), radius, mask, levels):
                for i in idx.tolist():
                    visits[i].add(shard)
            assert all(home[i] in visits[i] for i in range(300))
            largest.append(int(np.bincount(home).max()))
        assert largest[0] == len(v) and largest[-1] < len(v) / 30


def test_keep_first(spark):
    rows = [(5, "a b c d e f g h i j"), (3, "A b c d e f g h i j"), (9, "something else entirely here now"), (None, "a b c d e f g h i j")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in N.keep_first(spark, df).collect()) == [3, 9]


def test_keep_first_decides_by_row(spark):
    near, other, third = "a b c d e f g h i j", "something else entirely here now", "one more text that nobody else has"
    def kept(*rows):
        df = spark.createDataFrame(list(rows), "doc_id bigint, text string").repartition(3)
        return sorted(map(tuple, N.keep_first(spark, df).collect()), key=repr)
    # an unrelated text without an id stays, whatever another row without an id is
    assert kept((3, near), (None, near.upper()), (None, other)) == sorted([(3, near), (None, other)], key=repr)
    # near copies without any id: one is left
    assert [d for d, _ in kept((None, near), (None, near.upper()), (None, near))] == [None]
    # one id with two texts: only the near copy goes
    assert kept((3, near), (5, other), (5, near.upper())) == [(3, near), (5, other)]
    # an id that is first in two components stays in both; repeated rows are copies
    assert kept((5, near), (5, near), (5, other), (6, near.upper()), (7, other.upper()), (8, third)) == sorted([(5, near), (5, other), (8, third)], key=repr)
