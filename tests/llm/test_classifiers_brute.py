"""The classifiers' arithmetic, said again in plain loops over a few dozen texts."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
import zstandard

from pricelens.llm import quality as Q, toxicity as X
from pricelens.sources.tables import load
from tests.conftest import SMALL
from . import data

SPACE = b" \t\n\r\x0b\x0c"


def letter(c):
    return 65 <= c <= 90 or 97 <= c <= 122 or c >= 128


def vote(value, good, bad):
    return 1 if good[0] <= value <= good[1] else 0 if not bad[0] <= value <= bad[1] else -1


def plain_votes(text: bytes):
    if not text:  # no share has a meaning; only the vote on its length counts
        return Q.votes(text)
    words, size = text.split(), max(len(text), 1)
    n = len(words)
    letters = sum(letter(c) for c in text)
    odd = sum(not (letter(c) or c in SPACE or c in b".,;:'\"()-?" or 48 <= c <= 57) for c in text)
    bare = [w.strip(b".,;:!?\"'()").lower() for w in words]
    lines = [x for x in text.split(b"\n") if x.strip()]
    without = sum(all(48 <= c <= 57 or c in b"|*#&%$-_=+~<>/\\.,;:!?" for c in w) for w in words)
    share = lambda k, of: k / max(of, 1)
    return [
        vote(odd / size, (0, .02), (0, .05)), vote(share(sum(65 <= c <= 90 for c in text), letters), (0, .12), (0, .3)),
        vote(share(sum(w in Q.COMMON for w in bare), n), (.08, .7), (.03, .8)) if n >= 20 else -1,
        vote(share(without, n), (0, .03), (0, .15)) if n >= 5 else -1,
        vote(1 - len(set(lines)) / max(len(lines), 1), (0, .1), (0, .4)) if len(lines) >= 4 else -1,
        vote(share(len(set(bare)), n), (.3, 1), (.1, 1)) if 50 <= n <= 2000 else -1,
        vote(letters / size, (.7, .95), (.6, .98)) if n >= 5 else -1,
        vote(share(sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines), len(lines)), (.5, 1), (.1, 1)) if len(lines) >= 2 else -1,
        vote(share(sum(a == b for a, b in zip(bare, bare[1:])), n), (0, .03), (0, .1)) if n >= 20 else -1,
        0 if n < 3 else -1,
    ]


def plain_em(rows, rounds=200):
    """Posterior of good for each document, document by document."""
    k, n = len(rows[0]), len(rows)
    share, ok = 0.8, [[Q.PRECISE, 0.5] for _ in range(k)]

    def posterior(v):
        good, bad = math.log(share), math.log(1 - share)
        for j, x in enumerate(v):
            if x >= 0:
                good += math.log(ok[j][0] if x else 1 - ok[j][0])
                bad += math.log(1 - ok[j][1] if x else ok[j][1])
        return 1 / (1 + math.exp(min(max(bad - good, -50), 50)))
    for _ in range(rounds):
        p = [posterior(v) for v in rows]
        new = []
        for j in range(k):
            right = sum(q for q, v in zip(p, rows) if v[j] == 1)
            voted = sum(q for q, v in zip(p, rows) if v[j] >= 0)
            caught = sum(1 - q for q, v in zip(p, rows) if v[j] == 0)
            bad = sum(1 - q for q, v in zip(p, rows) if v[j] >= 0)
            new.append([(right + Q.PRECISE * n / 2) / (voted + n / 2), (caught + 1) / (bad + 2)])
        share_new = (sum(p) + 4) / (n + 5)
        done = max(abs(a - b) for x, y in zip(new, ok) for a, b in zip(x, y)) < 1e-7 and abs(share_new - share) < 1e-7
        ok, share = new, share_new
        if done:
            break
    return [posterior(v) for v in rows]


def plain_features(text: bytes):
    words = text.lower().split()
    if not words:
        return {xxhash.xxh32_intdigest(b"empty") >> (32 - Q.HASH_BITS): 1.0}
    kind = lambda c: 97 if 97 <= c <= 122 or c > 127 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c
    shaped = [bytes(map(kind, w)) for w in text.split()]
    names = [b"s" + w[:1] + w[-2:] for w in shaped]
    names += [b"p%d" % (a[0] << 8 | b[0]) for a, b in zip(shaped, shaped[1:])] + [b"w" + w for w in words if len(w) < 4]
    names += [b"repeat" for a, b in zip(words, words[1:]) if a == b]
    out = defaultdict(float)
    for name in names:
        out[xxhash.xxh32_intdigest(name) >> (32 - Q.HASH_BITS)] += 1 / len(words)
    return dict(out)


def plain_train(rows, target, epochs=300, ridge=1e-4):
    w, seen, bias, bias_seen = defaultdict(float), defaultdict(lambda: 1e-8), 0.0, 1e-8
    used = sorted({i for r in rows for i in r})
    for _ in range(epochs):
        g, gb = defaultdict(float), 0.0
        for r, y in zip(rows, target):
            s = bias + sum(w[i] * math.sqrt(v) for i, v in r.items())
            err = 1 / (1 + math.exp(-min(max(s, -30), 30))) - y
            gb += err / len(rows)
            for i, v in r.items():
                g[i] += err * math.sqrt(v) / len(rows)
        for i in used:
            d = g[i] + ridge * w[i]
            seen[i] += d * d
            w[i] -= 0.5 * d / math.sqrt(seen[i])
        bias_seen += gb * gb
        bias -= 0.5 * gb / math.sqrt(bias_seen)
    return lambda r: 1 / (1 + math.exp(-min(max(bias + sum(w[i] * math.sqrt(v) for i, v in r.items()), -30), 30)))


def texts(spark, n=45):
    rows = [(r.doc_id, r.text) for r in load(spark, SMALL, "documents").orderBy("doc_id").limit(n).collect()]
    return rows + [(1000 + i, r[1]) for i, r in enumerate(data.documents()) if len(r[1] or "") < 5000]


def test_quality_equals_plain_loops(spark):
    rows = texts(spark)
    raw = [(t or "").encode() for _, t in rows]
    assert [Q.votes(t) for t in raw] == [plain_votes(t) for t in raw]
    for t in raw:
        got, want = Q.shape_features(t), plain_features(t)
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    post = plain_em([plain_votes(t) for t in raw])
    score = plain_train([plain_features(t) for t in raw], post)
    got = {r.doc_id: r.score for r in Q.scores(spark, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert len(got) == len(rows)
    for (d, _), t in zip(rows, raw):
        assert abs(got[d] - score(plain_features(t))) < 1e-6


class Held:
    """As a broadcast holds it."""

    def __init__(self, value):
        self.value = value


def plain_lengths(text: bytes, dictionary: bytes):
    """Compressed length of each window, cut by walking back to a space, each with a compressor of its own."""
    out, at = [], 0
    while at < len(text) or not out:
        end = min(at + X.WINDOW, len(text))
        if end < len(text):
            k = end - 1
            while k > at and text[k:k + 1] != b" ":
                k -= 1
            end = k if k > at else end
        params = zstandard.ZstdCompressionParameters(window_log=10, hash_log=12, chain_log=12, search_log=3, min_match=4, strategy=zstandard.STRATEGY_GREEDY,
                                                     write_checksum=False, write_content_size=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        c = zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        out.append(len(c.compress(text[at:end])))
        at = max(end, at + 1)
    return out


@pytest.mark.parametrize("toxic", [b" scum idiot", b" worthless stupid moron"])
def test_window_lengths_equal_plain_ones(spark, toxic):
    shared = b" the and of to in with from that this thing ouble" * 20
    held = Held((shared, toxic + shared))
    for _, t in texts(spark, 20) + [(0, "you stupid scum, worthless idiot " * 30)]:
        raw = (t or "").encode()
        d = [a - b for a, b in zip(plain_lengths(raw.lower(), shared), plain_lengths(raw.lower(), toxic + shared))]
        top = sorted(d)[-2:]
        over = lambda k: sum(x > k for x in d)
        want = [sum(d) / len(d), top[-1], sum(top) / len(top), math.log1p(sum(max(x - 1, 0) for x in d)), math.log1p(len(d)),
                *[over(k) / len(d) for k in (1, 2, 3, 4)], sum(x < 0 for x in d) / len(d), *[math.log1p(over(k)) for k in (3, 4)]]
        assert np.allclose(X.features(raw, held), want)


def test_piece_counts_equal_plain_ones(spark):
    rows = [(t, i % 3 == 0) for i, (_, t) in enumerate(texts(spark, 30))]
    df = spark.createDataFrame([(t or "", int(x), i % 4 > 0) for i, (t, x) in enumerate(rows)], "text string, toxic int, fit boolean").repartition(3)
    want = {0: Counter(), 1: Counter()}
    for i, (t, x) in enumerate(rows):
        if i % 4 > 0:
            seen = set()
            for w in (t or "").encode().lower().split():
                w = w.rstrip(b".,;:!?\"')")
                seen |= {b" " + w[:k] for k in range(X.SHORTEST, X.LONGEST + 1) if k <= len(w)}
            want[int(x)].update(seen)
    got = {bytes(r.piece): (r.in_toxic, r.in_ordinary) for r in X.piece_counts(df).collect()}
    assert got == {p: (want[1][p], want[0][p]) for p in want[0].keys() | want[1].keys()}
