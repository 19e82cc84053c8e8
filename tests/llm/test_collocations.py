"""Phrase mining against a plain count of everything."""

import random
import re
from collections import Counter

import pytest

from pricelens.llm import collocations as C
from . import data


def brute(rows, support=30, longest=4, top=2000):
    """Every phrase counted, every rule applied as it is stated."""
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= support}
    out = []
    for (lang, p), a in cand.items():
        score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = any(g == lang and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) and 100 * b >= 80 * a for (g, q), b in cand.items())
        if not inside:
            out.append((lang, score, a, " ".join(p), f[lang, p[:k]], f[lang, p[k:]]))
    out.sort(key=lambda x: (x[0], -x[1], -x[2], x[3].encode()))
    rank, got = Counter(), []
    for lang, score, a, phrase, left, right in out:
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], phrase, a, left, right, n[lang], score))
    return got


def texts():
    rng = random.Random(11)
    words = ["the", "of", "New", "york", "york", "times", "é🙂", "naïve", "x\x1cy", "A", "a", "\x85", "b\xa0c", "ſ", "0", "long" * 50]
    rows = []
    for lang in ("en", "en", "de", None, "und", "", "x y"):
        for _ in range(40):
            rows.append(("".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", " \r\n"]) for _ in range(rng.randint(0, 60))), lang))
    rows += [(None, "en"), ("", None), (" \t ", "en"), ("?!\n", "fr"), ("san francisco bay area " * 3000, "en"), ("z" * 100_000, "en"), ("hot hot " * 20_000, "de")]
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    rows = texts()
    return spark.createDataFrame([(i, t, g, "p", 1, 2) for i, (t, g) in enumerate(rows)], "doc_id bigint, text string, lang string, phrase string, n bigint, k bigint").repartition(5)


@pytest.mark.parametrize("shard_bytes", [64 << 20, 40_000, 3_000])
def test_equals_a_full_count(spark, frame, shard_bytes, monkeypatch):
    monkeypatch.setattr(C, "PART", 500)
    got = C.collocations(spark, frame, shard_bytes=shard_bytes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and dict(got.dtypes)["rank"] == "bigint"
    assert sorted(map(tuple, got.collect())) == sorted(brute(texts()))


def test_top_and_support(spark, frame):
    got = C.collocations(spark, frame, support=7, longest=3, top=5)
    assert sorted(map(tuple, got.collect())) == sorted(brute(texts(), 7, 3, 5))


def test_repeats_and_ties(spark):
    rows = [("b a. a b. c a", "en")] * 30 + [("Z a", None)] * 30 + [("z A", "und")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    assert sorted(map(tuple, C.collocations(spark, df).collect())) == sorted(brute(rows))
    assert C.collocations(spark, data.empty(spark)).collect() == []
    assert C.collocations(spark, data.frame(spark)).columns[0] == "lang"


def test_local_supports_cover_the_support():
    for sizes in ([5, 5, 90], [1] * 45, [100], [33, 33, 34], [0, 10]):
        total = sum(sizes)
        rest = sum(C.local_support(30, s, total) - 1 for s in sizes)
        assert rest < 30  # a phrase below the local support everywhere can't reach the support


def test_slices_end_at_pieces(monkeypatch):
    monkeypatch.setattr(C, "SLICE_BYTES", 10)
    text = b"aa bb cc dd ee ff. gg hh, ii jj kk ll mm nn oo pp qq rr ss tt\nuu"
    flat = [w for part in C.slices(text) for w in [*part, C.BREAK]]
    runs = b" ".join(flat).split(b" \xff")
    assert [r.split() for r in runs if r.split()] == [p.split() for p in re.split(rb"[.,\n]", text)]


def test_candidates_hold_all_that_is_frequent(spark, frame):
    texts = frame.selectExpr("coalesce(lang, 'und') AS lang", "coalesce(text, '') AS text")
    miner = C.Miner(spark, texts, 30, 10_000)
    swept = miner.sweep(range(0), range(1, 5))
    found = {r.h for r in miner.candidates(swept).collect()}
    assert swept.where("h IS NOT NULL").count() > len(found)  # some were locally frequent only
    counted = miner.sweep(range(1, 5), range(0)).where("k > 0").collect()
    assert counted and {r.h for r in counted} <= found
