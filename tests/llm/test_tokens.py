import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import regex
from pricelens.llm import byte_bpe as B, pretoken as P, token_counts as T
from . import data

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern_is_the_published_one():
    assert P.BYTE_LEVEL_PATTERN == public_tokenizers.PATTERN


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\x0b\x0c\r'stremvld0123abcXYZ_-.!éßÿ×÷ɏ"), st.characters(exclude_categories=["Cs"]))))
def test_split_equals_pattern(text):
    assert P.splitter()(text) == regex.findall(public_tokenizers.PATTERN, text)


@given(st.lists(st.integers(0, (1 << 32) - 1)))
def test_int_packing(values):
    assert P.unpack_ints(P.pack_ints(values, bytes), bytes).tolist() == values


@given(st.lists(st.binary()))
def test_parts(parts):
    assert P.split_parts(P.join_parts(parts)) == parts


def test_encode_decode(spark, library, monkeypatch):
    want = sorted(((r[0], library.encode_ordinary(r[1] or "")) for r in data.documents()), key=repr)
    ranks = B.load_ranks(RANKS)
    for block, chunk in ((B.BLOCK_WORDS, B.CHUNK_TOKENS), (20, 50)):
        monkeypatch.setattr(B, "BLOCK_WORDS", block)
        monkeypatch.setattr(B, "CHUNK_TOKENS", chunk)
        got = B.encode(spark, data.frame(spark), ranks)
        assert sorted(((r.doc_id, r.ids) for r in got.collect()), key=repr) == want
    back = B.decode(spark, got, ranks).collect()
    assert sorted(((r.doc_id, bytes(r.decoded).decode()) for r in back), key=repr) == sorted(((r[0], r[1] or "") for r in data.documents()), key=repr)
    assert B.encode(spark, data.empty(spark), ranks).count() == 0
    with pytest.raises(Exception):
        B.decode(spark, spark.createDataFrame([(1, [50256])], "doc_id bigint, ids array<int>"), ranks).collect()


def test_round_trip_columns(spark, library):
    got = B.round_trip(spark, data.frame(spark), RANKS)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    for r, (i, text) in zip(sorted(got.collect(), key=lambda r: (repr(r.doc_id), r.decoded_sha256)),
                            sorted(((r[0], r[1] or "") for r in data.documents()), key=lambda x: (repr(x[0]), hashlib.sha256(x[1].encode()).hexdigest()))):
        ids = library.encode_ordinary(text)
        assert tuple(r) == (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_lost_words_fail(monkeypatch):
    import pyarrow as pa
    rows = list(B.split_blocks(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a b c d e f"])], names=["doc_id", "text"])]), P.BYTE_LEVEL_PATTERN, 3))
    docs = [b for b in rows if b["kind"][0].as_py() == B.DOCS]
    with pytest.raises(RuntimeError):
        list(B.assemble(iter(docs)))


def test_token_counts(spark, monkeypatch):
    tok = Tokenizer.from_file(JSON)
    want = sorted(((r[0], len((r[1] or "").encode()), n := len(tok.encode(r[1] or "", add_special_tokens=False).ids), n > 1024) for r in data.documents()), key=repr)
    got = T.token_counts(spark, data.frame(spark), JSON)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert T.token_counts(spark, data.empty(spark), JSON).count() == 0


def test_worker_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 10)
    spec = open(JSON, encoding="utf-8").read()

    class Shared:
        value = (spec, T.whole_tokens(spec), T.special_strings(spec))
    tok, shared = Tokenizer.from_file(JSON), Shared()
    rng = np.random.default_rng(0)
    for _ in range(20):
        texts = [" ".join("".join(rng.choice(list("abcdefgh"), 9)) for _ in range(9)) for _ in range(3)]
        assert T.count_batch(texts, shared) == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_proof_covers_only_single_tokens():
    spec = open(JSON, encoding="utf-8").read()
    whole, tok = T.whole_tokens(spec), Tokenizer.from_file(JSON)
    assert len(whole) > 40_000 and "<|endoftext|>" not in whole
    sample = sorted(whole)[::97]
    assert all(len(e.ids) == 1 for e in tok.encode_batch(sample, add_special_tokens=False))
