"""Windows and line chunkers: expected tables, and properties on random texts."""

import random

from pyspark.sql import functions as F

from pricelens.functions import rules
from pricelens.functions import text as TX

random.seed(7)
WORDS = ["price", "buy", "item", "$12", "₵ 50", "USD 9", "laptop", "phone", "x" * 30, "delivery", "a", "the",
         "GH₵1,200.50", "Shop", "cart", "Total 123", "ok"]


def _texts(n, lines=(0, 40)):
    out = []
    for _ in range(n):
        ls = []
        for _ in range(random.randint(*lines)):
            ls.append(" " * random.randint(0, 2) + " ".join(random.choice(WORDS) for _ in range(random.randint(0, 12))))
        out.append("\n".join(ls))
    return out


def _check_windows(text, got, limit):
    assert "".join(got) == text
    if len(text) <= limit:
        assert got == [text]
        return
    for w, after in zip(got, got[1:]):
        assert 0 < len(w) <= limit
        # cut before the last space that fits (a space at the start can't be cut at), else at the limit
        assert (after[0] == " " and " " not in (w + after)[len(w) + 1:limit]) or (len(w) == limit and " " not in w[1:])
    assert 0 < len(got[-1]) <= limit


def test_window_table(spark):
    table = [("", [""]), ("abc", ["abc"]), ("a" * 12, ["a" * 12]), ("a" * 13, ["a" * 12, "a"]),
             ("ab cd ef gh ij kl", ["ab cd ef gh", " ij kl"]), ("abcdefgh ijklmnop", ["abcdefgh", " ijklmnop"])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(table)], "i int, t string")
    for r in df.select("i", F.regexp_extract_all("t", F.lit(TX.window_pattern(12)), F.lit(0)).alias("w")).collect():
        assert list(r["w"]) == table[r["i"]][1]


def test_window_properties(spark):
    texts = ["".join(random.choice("ab  c") for _ in range(random.randint(0, 60))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", F.regexp_extract_all("t", F.lit(TX.window_pattern(12)), F.lit(0)).alias("w")).collect():
        _check_windows(texts[r["i"]], list(r["w"]), 12)


def test_full_size_windows_on_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for r in d.select("doc_id", "text", TX.window_chunks(F.col("text")).alias("w")).collect():
        _check_windows(r["text"], list(r["w"]), 1536)


def test_chunk_tables(spark):
    long = "y" * 300
    table = [
        # generic: closes from the second line on at a price or an indicator word; over 500 characters regardless
        ("Red ring\n₵ 50\nnothing here\nmore\nbuy now\ntail", ["Red ring\n₵ 50", "nothing here\nmore\nbuy now", "tail"]),
        ("₵ 50\nplain\nplain", ["₵ 50\nplain\nplain"]),
        (f"{long}\n{long}\nend", [f"{long}\n{long}", "end"]),
        ("  \n\n", []),
    ]
    ebay = [
        ("Red ring\n$ 50\nplain\n" + "z" * 90 + "\nUSD 3", ["Red ring\n$ 50", "plain\n" + "z" * 90, "USD 3"]),
        ("a\n₵ 5", ["a\n₵ 5"]),
    ]
    for rule, rows in (("generic", table), ("ebay", ebay)):
        df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, text string")
        for r in TX.with_chunks(df, "text", "c", rule=rule).collect():
            assert list(r["c"]) == rows[r["i"]][1]


def test_chunks_keep_every_line(spark):
    texts = _texts(200)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for rule in ("generic", "ebay"):
        for r in TX.with_chunks(df, "text", "c", rule=rule).collect():
            lines = [ln.strip() for ln in texts[r["i"]].split("\n") if ln.strip()]
            assert "\n".join(r["c"]).split("\n") == (lines or [""])
            for c in r["c"][:-1]:
                assert c.count("\n") or len(c) > rules.GENERIC_CHUNK_MAX
    # Limits are explicit arguments.
    c = TX.chunk_array(F.col("text"))
    few = TX.chunk_array(F.col("text"), cap=2)
    for r in df.select(c.alias("c"), few.alias("f")).collect():
        assert r["f"] == r["c"][:2]


def test_lines_of_links(spark):
    long = "a product title that is longer than the limit"
    table = [
        ('<div><a href="/">Home</a> | <a href="/d">Deals</a></div><p>text</p>', ["text"]),
        (f'<div><a href="/1">{long}</a></div>', [long]),                                   # long: stays
        ('<a href="/x"><div>Phones</div><div>and rings</div></a><p>₵ 50</p>', ["₵ 50"]),     # one anchor around lines
        ('<p>See <a href="/x">it</a> now</p>', ["See it now"]),                              # half or less of it
        ('<p><a href="/x">abc</a> de f</p>', ["abc de f"]), ('<p><a href="/x">abcd</a> de f</p>', []),
        ('<p><a href="/x">never closed</p><p>more</p>', ["never closed", "more"]),           # no anchor
        ('<p>x</a> y</p><a href="/">z</a>', ["x y"]), ("<p>\x01a\x02b</p>", ["ab"]), ("<abbr>short</abbr>", ["short"]), ("", []),
        ("<A HREF=x>Menu</A >\n<p>12</p>", ["12"]), ('<a href="/">\n<p>one</p>\n<p>two</p>\n</a>three', ["three"]),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(table)], "i int, h string")
    for r in df.select("i", TX.main_text_lines(F.col("h")).alias("l")).collect():
        assert list(r["l"]) == table[r["i"]][1], table[r["i"]][0]
