import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from pricelens.llm import exact_dedup as X
from . import data


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    out, seen = [], set()
    for r in rows:
        n = norm(r[1])
        ids = [i for i in groups[n] if i is not None]
        keep = min(ids) if ids else None
        kept = r[0] == keep and (n, r[0]) not in seen
        seen.add((n, r[0]))
        out.append((r[0], keep, len(groups[n]), kept, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_decisions(spark):
    got = X.decisions(spark, data.frame(spark))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(data.documents())
    assert X.decisions(spark, data.empty(spark)).count() == 0


def test_drop_copies(spark):
    kept = X.drop_copies(spark, data.frame(spark))
    assert kept.columns == data.frame(spark).columns
    rows = kept.collect()
    texts = [norm(r.text) for r in rows]
    assert len(texts) == len(set(texts)) == len({norm(r[1]) for r in data.documents()})
    assert {r.doc_id for r in rows} == {d for d, _, _, k, _ in expected(data.documents()) if k}
    assert X.drop_copies(spark, data.empty(spark)).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a", " a", "a ", "\t\n", "a \x0b\x0c b\r\n", "  x"])
def test_normalise(text):
    assert X.normalise(text.encode()).decode() == norm(text)


def test_filter_is_lossless():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 1 << 64, 500, dtype=np.uint64) for _ in range(4)]
    parts[1][:100] = parts[0][:100]
    parts[2][:50] = parts[0][:50]
    parts[3][:200] = parts[3][0]
    parts.append(np.array([0, 0, (1 << 64) - 1], np.uint64))
    for bits in (1, 5, 20):
        blocks = defaultdict(list)
        for p in parts:
            for b in X.build_blocks(*np.unique(p, return_counts=True), bits):
                blocks[b[0]].append(X.read_block(*b, bits))
        merged = [X.merge(v) for _, v in sorted(blocks.items())]
        want, count = np.unique(np.concatenate(parts), return_counts=True)
        assert (np.concatenate([m[0] for m in merged]) == want).all()
        assert (np.concatenate([m[1] for m in merged]) == count).all()
