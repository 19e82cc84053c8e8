"""Secret scan (operator 1): known shapes, and windows of high entropy.

Base spans are leftmost, non-overlapping matches per kind: ``assign`` (a credential word, an
operator and a value of 6 or more characters), ``access`` (an access-key id of 20 or more),
``hex`` (24 or more hex digits); matches that are too short are dropped after matching.

The entropy scan adds spans of kind ``entropy``: candidate strings are runs of token
characters; for each character class a window slides over the class's runs, and the Shannon
entropy of its characters is updated from one count that leaves and one that enters. A
window at or above the class's threshold is a finding; touching findings join. The allow-list
removes what is known not to be a secret; a dummy word (``example``) in a candidate removes
only the ``/``- or ``=``-separated segment that holds it, and the rest is scanned on both sides
of it (of a documented dummy with ``/`` inside, other segments may be found). A finding needs
letters and digits both: strings of letters alone are not told from prose, names and paths,
so a key without any digit is not found. Findings inside a base span are not repeated.

Offsets count code points, ends are exclusive. Defined results: a NULL or empty text has no
spans; repeated rows and rows without ``doc_id`` each give a row; an empty table gives an
empty result. Whole texts are scanned, of any length.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, map_texts

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_PARTS = ("passw", "secret", "token", "api")  # every match holds one of these
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

# Class: its characters, window length, threshold in bits per character.
CLASSES = (("hex", re.compile(r"[0-9a-fA-F]{20,}"), 20, 3.0), ("base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.6))
ALLOWED = (
    re.compile(r"[0-9]+"),                                                        # counters, dates, phone numbers
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),            # UUIDs are names
    re.compile(r"[A-Z]?[a-z]+([-_/=+]+[A-Z]?[a-z]+)*|[A-Z]+([-_/=+]+[A-Z]+)*"),   # words, slugs, paths, constants
    re.compile(r"(?:[A-Z]?[a-z]{2,}+)++"),                                        # joined words; possessive: no way back into a run
)
_DUMMY = re.compile(r"example|sample|placeholder|abcdefgh|01234567", re.I)         # documented dummies
_SEGMENT = re.compile(r"[^/=]+")


def hot_windows(run: str, width: int, threshold: float) -> Iterator[tuple[int, int]]:
    """Maximal spans covered by windows of ``width`` characters with at least ``threshold``
    bits per character."""
    cost = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    counts: dict[str, int] = {}
    total, most = 0.0, width * (math.log2(width) - threshold)  # entropy = log2(width) - total / width
    start = end = None
    for i, ch in enumerate(run):
        if i >= width:  # the leaving character first: no count goes beyond the width
            c = counts[run[i - width]]
            counts[run[i - width]] = c - 1
            total += cost[c - 1] - cost[c]
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += cost[c + 1] - cost[c]
        if i >= width - 1 and total <= most + 1e-9:
            if end is not None and i - width + 1 > end:
                yield start, end
                start = None
            start, end = i - width + 1 if start is None else start, i + 1
    if start is not None:
        yield start, end


def allowed(text: str) -> bool:
    return any(p.fullmatch(text) for p in ALLOWED)


def mixed(text: str) -> bool:
    """Letters and digits both: prose and numbers alone are no keys."""
    return any(c.isdigit() for c in text) and any(c.isalpha() for c in text)


def stretches(cand: str) -> Iterator[tuple[int, str]]:
    """``cand`` without its segments that hold a dummy word: each rest with its start."""
    at = 0
    if _DUMMY.search(cand):
        for seg in _SEGMENT.finditer(cand):
            if _DUMMY.search(seg[0]):
                yield at, cand[at:seg.start()]
                at = seg.end()
    yield at, cand[at:]


def entropy_spans(text: str) -> list[tuple[int, int]]:
    found = set()
    for cand in _CANDIDATE.finditer(text):
        for start, part in stretches(cand[0]):
            if not mixed(part) or allowed(part):
                continue
            for _name, chars, width, threshold in CLASSES:
                for run in chars.finditer(part):
                    for s, e in hot_windows(run[0], width, threshold):
                        piece = run[0][s:e]
                        if mixed(piece) and not allowed(piece):
                            found.add((cand.start() + start + run.start() + s, cand.start() + start + run.start() + e))
    out: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    low = text.lower()
    return {
        "assign": [m.span() for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if any(p in low for p in _ASSIGN_PARTS) else [],
        "access": [m.span() for m in _ACCESS.finditer(text) if len(m[0]) >= 20] if "AKIA" in text else [],
        "hex": [m.span() for m in _HEX.finditer(text)],
    }


def scan(text: str) -> tuple[dict[str, list[tuple[int, int]]], str, str]:
    """Base spans by kind, base spans as text, all spans as text."""
    base = base_spans(text)
    flat = [(s, k, e) for k, kind in enumerate(KINDS[:3]) for s, e in base[kind]]
    more = [(s, 3, e) for s, e in entropy_spans(text) if not any(a <= s and e <= b for a, _, b in flat)]

    def joined(spans):
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return base, joined(flat), joined(flat + more)


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row."""
    def per_batch(ids, texts):
        found = [scan(t) for t in texts]
        return pa.RecordBatch.from_arrays(
            [ids, *(pa.array([len(b[k]) for b, _, _ in found], pa.int64()) for k in KINDS[:3]),
             pa.array([hashlib.sha256(b.encode()).hexdigest() for _, b, _ in found]), pa.array([a for _, _, a in found], pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    return map_texts(id_text(docs), per_batch, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, "
                                               "base_sha256 string, spans string", binary=False)
