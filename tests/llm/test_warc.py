"""WARC archives: the round trip, and what is left of damaged ones."""

import gzip
import hashlib
import io

import pytest

from pricelens.llm import warc as W

SCHEMA = "page_id bigint, url string, html string, digest string, size bigint, row bigint, error string"


def pages():
    big, small = "<p>" + "same é🙂 " * 40 + "</p>", "<p>tiny</p>"
    texts = {1: big, 2: big, 3: small, 4: small, 5: None, 6: "", 7: "x" * 99, 8: "x" * 99, 9: "y" * 100, 10: "y" * 100, 11: "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 20,
             12: "z" * 3_000_000, 13: "\x00\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" * 30}
    rows = [(k, f"http://h/{k}\r\nX: y z", v) for k, v in texts.items()]
    return rows + [(1, None, big), (None, "u", big), (None, "u", "only null " * 20), (None, "u", "only null " * 20), (9, "v", "other " * 30)]


def brute(rows):
    first = {}
    ranked = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    out = []
    for i in ranked:
        p, _, html = rows[i]
        b = (html or "").encode()
        again = len(b) >= 100 and b in first
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
        first.setdefault(b, p)
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, 2, "e") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("archive, span", [(W.ARCHIVE_BYTES, W.RANGE_BYTES), (2_000, 500), (3_000, 1)])
def test_round_trip(spark, archive, span):
    index = W.write_archives(spark, frame(spark, pages()), archive_bytes=archive, range_bytes=span)
    read = W.read_archives(spark, index)
    assert sorted(map(tuple, W.page_records(read).collect()), key=repr) == brute(pages())
    assert W.gaps(read).count() == 0
    got = {r.page_id: bytes(r.payload) for r in read.where("warc_type = 'response' AND page_id IN (5, 11, 12, 13)").collect()}
    assert got == {k: (t or "").encode() for k, _, t in pages() if k in (5, 11, 12, 13)}
    whole = index.select("path").distinct().selectExpr("path", "0L AS start", "CAST(NULL AS BIGINT) AS end")  # without the index
    assert sorted(map(tuple, W.page_records(W.read_archives(spark, whole, False)).collect()), key=repr) == brute(pages())


def test_no_rows(spark):
    index = W.write_archives(spark, frame(spark, []))
    assert index.count() == 0 and W.page_records(W.read_archives(spark, index)).collect() == []


def read(data, start=0, end=None):
    return list(W.salvage(W.Bytes(io.BytesIO(data), len(data)), start, len(data) if end is None else end))


def some(n=6):
    return [W.page_record(i, f"http://h/{i}", (f"page {i} " * (50 + i)).encode(), hashlib.sha256((f"page {i} " * (50 + i)).encode()).hexdigest(), 1, None, False, "d")
            for i in range(n)]


def ids(rows):
    return [int(f["page-id"]) for _, _, e, f, _ in rows if e is None]


def lost(rows):
    return [(o, n, e) for o, n, e, _, _ in rows if e is not None]


@pytest.mark.parametrize("packed", [True, False])
def test_every_damaged_byte_is_quarantined(packed):
    parts = [W.gzip_member(r) if packed else r for r in some(3)]
    data = b"".join(parts)
    assert ids(read(data)) == [0, 1, 2] and lost(read(data)) == []
    s, e = len(parts[0]), len(parts[0]) + len(parts[1])
    harmless = set(range(s + 4, s + 10)) if packed else set()  # time, flags and system of a gzip header
    block = s if packed else s + parts[1].index(b"\r\n\r\n")  # a plain record's headers have no check but their form
    for at in [*range(s, s + 8), *range(max(block, s + 8), e)]:
        bad = bytearray(data)
        bad[at] ^= 0x15
        rows = read(bytes(bad))
        got = ids(rows)
        assert got[0] == 0 and got[-1] == 2, at
        if got == [0, 1, 2]:
            assert at in harmless, at
        else:
            assert [(o, n) for o, n, _ in lost(rows)] == [(s, e - s)], at


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    parts = [W.gzip_member(r) if packed else r for r in some()]
    junk = b"\x1f\x8b\x08\x00junk WARC/1.0\r\nnot a record\r\n\r\n\x1f\x8b\x08\x00"
    data = junk + parts[0] + parts[1][:-30] + parts[2] + parts[3] + junk + parts[4] + parts[5][:40]
    rows = read(data)
    assert ids(rows) == [0, 2, 3, 4]
    starts = [0, len(junk + parts[0]), len(junk + parts[0] + parts[1][:-30] + parts[2] + parts[3]), len(data) - 40]
    assert [(o, n) for o, n, _ in lost(rows)] == list(zip(starts, [len(junk), len(parts[1]) - 30, len(junk), 40]))
    assert all(e for _, _, e in lost(rows))
    covered = sorted([(o, n) for o, n, *_ in rows])
    assert [o for o, _ in covered] == [0, *[o + n for o, n in covered[:-1]]] and sum(covered[-1]) == len(data)  # no byte is unaccounted for
    cut = read(data, 0, starts[1] + 10)  # a range that ends inside a gap
    assert ids(cut) == [0] and lost(cut)[-1][:2] == (starts[1], 10)


def test_reasons():
    good = some(1)[0]
    cases = {"length": good.replace(b"Content-Length: ", b"Content-Length: 9"), "version": b"WARK" + good[4:], "trailer": good[:-4] + b"....",
             "payload digest": good.replace(b"WARC-Payload-Digest: sha256:", b"WARC-Payload-Digest: sha256:0"),
             "block digest": good.replace(b"page 0 page", b"page 1 page"), "headers": good.replace(b"WARC-Date: d", b"WARC-Date d")}
    for reason, data in cases.items():
        assert [e for _, _, e in lost(read(W.gzip_member(data)))] == [reason]
    bad = bytearray(W.gzip_member(good))
    bad[-6] ^= 1
    assert lost(read(bytes(bad)))[0][2].startswith("member: ")
    assert lost(read(W.gzip_member(good)[:-3]))[0][2] == "truncated member"
    assert lost(read(b"\x00" * 3_000_000)) == [(0, 3_000_000, "version")]


def test_other_writers():
    body = b"hello"
    sha1 = "sha1:" + __import__("base64").b32encode(hashlib.sha1(body).digest()).decode()
    rec = b"WARC/1.0\r\nwarc-type: resource\r\nX-Long: a\r\n  b\r\nWARC-Block-Digest: %s\r\ncontent-length: 5\r\n\r\nhello\r\n\r\n" % sha1.encode()
    assert [(f["x-long"], p) for _, _, _, f, p in read(rec * 2)] == [("a b", body)] * 2
    assert len(read(gzip.compress(rec * 3))) == 3  # several records in one member
    assert lost(read(rec.replace(b"hello", b"hellO")))[0][2] == "block digest"
    assert [f for _, _, _, f, _ in read(rec.replace(b"sha1:", b"blake9:"))] and W.digest_holds("md5:" + hashlib.md5(body).hexdigest(), body)


def test_damaged_archive_through_spark(spark, tmp_path):
    parts = [W.gzip_member(r) for r in some()]
    data = bytearray(b"".join(parts))
    data[len(parts[0]) + 50] ^= 0xFF
    path = tmp_path / "a.warc.gz"
    path.write_bytes(bytes(data))
    ranges = spark.createDataFrame([(str(path), 0, None), (f"file://{path}", 0, None)], "path string, start bigint, end bigint")
    rows = W.read_archives(spark, ranges)
    assert sorted(r.page_id for r in W.page_records(rows).collect()) == sorted([0, 2, 3, 4, 5] * 2)
    assert [(r.offset, r.length) for r in W.gaps(rows).collect()] == [(len(parts[0]), len(parts[1]))] * 2
