"""Token counts (operator 10) with the whole-token shortcut.

Offline, the vocabulary proves which of its strings encode alone as one token. A pre-token
that is such a string counts one without any merging; only the rest is merged, and a word
met again in the same worker is looked up.

Defined results: a NULL or empty text has no tokens; repeated rows and rows without
``doc_id`` each give a row; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import os
import re

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from .common import id_text, map_texts
from .pretoken import splitter

REMEMBERED = 400_000  # merged words that a worker remembers


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies:
    visible Latin-1 characters stand for themselves, the others for U+0100 onwards."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def whole_tokens(spec: str) -> dict[str, int]:
    """The proof: each vocabulary string that is one pre-token and encodes as one token."""
    tok, chars, split = Tokenizer.from_str(spec), byte_characters(), splitter()
    strings = []
    for s in json.loads(spec)["model"]["vocab"]:
        try:
            strings.append(bytes(chars[c] for c in s).decode())
        except (KeyError, UnicodeDecodeError):  # special strings, parts of characters
            continue
    strings = [s for s in strings if split(s) == [s]]
    return {s: 1 for s, e in zip(strings, tok.encode_batch(strings, add_special_tokens=False)) if len(e.ids) == 1}


def special_strings(spec: str) -> list[str]:
    """Special strings that the library recognises inside texts by default."""
    added = json.loads(spec)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("added tokens with matching options are not supported")
    return sorted((t["content"] for t in added), key=len, reverse=True)


@functools.lru_cache(maxsize=2)
def _worker(shared: Broadcast):
    """Tokenizer, costs of known words and the special strings, once per Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    spec, whole, special = shared.value
    return Tokenizer.from_str(spec), dict(whole), special and re.compile("|".join(map(re.escape, special))), len(whole)


def count_batch(texts: list[str], shared: Broadcast) -> list[int]:
    tok, cost, special, fixed = _worker(shared)
    split, known = splitter(), cost.get
    words, extra = [], []
    for t in texts:
        parts = special.split(t) if special else [t]
        extra.append(len(parts) - 1)
        words.append(split(parts[0]) if len(parts) == 1 else [w for p in parts for w in split(p)])
    out = [list(map(known, w)) for w in words]
    new = {w for ws, ns in zip(words, out) if None in ns for w, n in zip(ws, ns) if n is None}
    if new:
        if len(cost) + len(new) > fixed + REMEMBERED:
            for w in list(cost)[fixed:]:  # the proven words come first and stay
                del cost[w]
        new = list(new)
        merged = dict(zip(new, (len(e.ids) for e in tok.encode_batch(new, add_special_tokens=False))))
        cost.update(merged)
        for ws, ns in zip(words, out):
            if None in ns:
                ns[:] = [n if n is not None else merged[w] for w, n in zip(ws, ns)]
    return [sum(ns) + x for ns, x in zip(out, extra)]


def token_counts(spark: SparkSession, docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row; ``path``: a byte-level
    BPE file of the ``tokenizers`` library."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    shared = spark.sparkContext.broadcast((spec, whole_tokens(spec), special_strings(spec)))

    def per_batch(ids, texts):
        n = count_batch(texts, shared)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return map_texts(id_text(docs), per_batch, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", binary=False)
