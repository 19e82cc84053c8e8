import hashlib
import random
import re

import pytest

from pricelens.llm import decontaminate as D
from . import data


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, k=10):
    w, at, own = words(text), set(), set()
    for item, t in items:
        b = words(t)
        if not b:
            continue
        size = min(k, len(b))
        wins = [b[i:i + size] for i in range(len(b) - size + 1)]
        for s in range(len(w) - size + 1):
            if w[s:s + size] in wins:
                at.update(range(s, s + size))
                own |= set() if item is None else {str(item)}
    return len(w), len(at), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(at)


ITEMS = [(1, "The quick brown fox jumps over the lazy dog, it's a well-known sentence."), (2, "one TWO three"), (3, None), (4, ""),
         (5, "--- !!!"), (6, "lorem " * 25), (10, "the end"), (10, "the end"), (None, "emoji zwj"), (7, " ".join(f"w{i}" for i in range(9000)))]


def test_edge_documents(spark, monkeypatch):
    rows = data.documents() + [(50, " ".join(f"w{i}" for i in range(4090, 4120)), *[None] * 7), (51, "a b " + "W8990 " + " ".join(f"w{i}" for i in range(8985, 9000)), *[None] * 7)]
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    want = sorted(((r[0], *brute(r[1], ITEMS)) for r in rows), key=repr)
    for piece, remembered in ((D.PIECE_WORDS, D.REMEMBERED), (100, 3)):
        monkeypatch.setattr(D, "PIECE_WORDS", piece)
        monkeypatch.setattr(D, "REMEMBERED", remembered)
        got = D.contamination(spark, data.frame(spark, rows), bench)
        assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert any(w[2] and not w[3] for w in want)  # hit by an item without an id
    kept = D.drop_contaminated(spark, data.frame(spark, rows), bench)
    assert kept.columns == data.frame(spark).columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(w[0]) for w in want if not w[-1])


def test_empty_tables(spark):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert D.contamination(spark, data.empty(spark), bench).count() == 0
    none = D.contamination(spark, data.frame(spark), bench.limit(0)).collect()
    assert len(none) == len(data.documents()) and not any(r.contaminated for r in none)


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_random_texts_equal_brute_force(spark, k):
    rng = random.Random(k)
    text = lambda n: " ".join(rng.choice("abcdeFG") for _ in range(rng.randint(0, n)))
    items = [(rng.choice([None, 1, 2, 3, 4, 5]), text(14)) for _ in range(8)]
    rows = [(i, text(40), *[None] * 7) for i in range(300)] + [(900, "g " * 3000 + items[0][1] + " g" * 3000, *[None] * 7)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = D.contamination(spark, data.frame(spark, rows), bench, k)
    assert sorted(map(tuple, got.collect())) == sorted((r[0], *brute(r[1], items, k)) for r in rows)


def test_benchmark_stays_on_the_cluster(spark, monkeypatch):
    """Ten times the words, the same bounded things at the driver: two filters and counts of rows."""
    rng = random.Random(1)
    sizes = []
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda sc, v: sizes.append(getattr(v, "nbytes", None)) or broadcast(sc, v))
    for n in (20, 200):
        bench = spark.createDataFrame([(i, " ".join(f"w{rng.randint(0, 5000)}" for _ in range(60))) for i in range(n)], "item_id bigint, text string")
        assert D.contamination(spark, data.frame(spark), bench).where("contaminated").count() == 0
    assert None not in sizes and max(sizes) <= 1 << 24  # bit arrays only
