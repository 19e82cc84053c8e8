"""BIO encoding and decoding: expected tables and the encode -> decode round trip."""

import json
import random

from pyspark.sql import functions as F

from pricelens.operators import training as TR

random.seed(11)


def test_bio_labels_table(spark):
    # B-/I- ids: TITLE 1/2, PRICE 3/4, URL 5/6, IMG 7/8
    from pricelens.functions.rules import LABEL2ID as ID
    bt, it, bp, bu = ID["B-TITLE"], ID["I-TITLE"], ID["B-PRICE"], ID["B-URL"]
    table = [
        ("Query: phone\n[TITLE]Small  Ring[/TITLE] [PRICE]123.5[/PRICE] [URL]http://x/item/1[/URL] ",
         ["Query:", "phone", "Small", "Ring", "123.5", "http://x/item/1"], [0, 0, bt, it, bp, bu]),
        ("[TITLE]a[/TITLE][TITLE]b c[/TITLE]", ["a", "b", "c"], [bt, bt, it]),                          # adjacent entities
        ("before [FOO]unknown tag[/FOO] after", ["before", "unknown", "tag", "after"], [0, 0, 0, 0]),  # unknown tag
        ("[TITLE][/TITLE] empty tag", ["empty", "tag"], [0, 0]),
        ("[TITLE]line\nbreak[/TITLE]", ["[TITLE]line", "break[/TITLE]"], [0, 0]),                      # no entity
        ("plain words only", ["plain", "words", "only"], [0, 0, 0]), ("", [], []),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(table)], "i int, t string")
    for r in df.select("i", TR.bio_labels(F.col("t")).alias("b")).collect():
        assert (list(r["b"]["tokens"]), list(r["b"]["labels"])) == table[r["i"]][1:], table[r["i"]][0]


def test_decode_table(spark):
    table = [
        ("iphone/B-TITLE ##s/I-TITLE 13/I-TITLE $/B-PRICE 999/I-PRICE ##.00/I-PRICE", [{"title": "iphones 13", "price": "$ 999.00"}]),
        ("a/B-TITLE x/O b/B-TITLE", [{"title": "a"}, {"title": "b"}]),                       # O ends a record
        ("u/B-URL x/O a/B-TITLE", [{"url": "u", "title": "a"}]),                             # incomplete: carried on
        ("u/B-URL x/O", []),                                                                # never complete
        ("[CLS]/O a/B-TITLE [SEP]/O [PAD]/B-TITLE b/I-TITLE", [{"title": "a b"}]),          # special tokens are skipped
        ("a/I-TITLE b/I-PRICE", []),                                                        # nothing opened
        ("a/B-TITLE q/X b/I-TITLE", [{"title": "a b"}]),                                    # unknown label
        ("a/B-TITLE b/B-TITLE", [{"title": "b"}]),                                          # the later one stays
        ("", []),
    ]
    rows = []
    for i, (t, _) in enumerate(table):
        pairs = [x.rsplit("/", 1) for x in t.split()]
        rows.append((i, [a for a, _ in pairs], [b for _, b in pairs]))
    df = spark.createDataFrame(rows, "i int, t array<string>, l array<string>")
    for r in df.select("i", TR.decode_bio(F.col("t"), F.col("l")).alias("d")).collect():
        assert [dict(m) for m in r["d"]] == table[r["i"]][1], table[r["i"]][0]


def test_random_records_come_back(spark):
    cases = []
    for _ in range(200):
        recs = [{"title": " ".join(random.choice(["red", "ring", "pro", "13"]) for _ in range(random.randint(1, 4))),
                 "price": str(random.randint(1, 999))} for _ in range(random.randint(0, 4))]
        toks, labs = ["[CLS]"], ["O"]
        for r in recs:
            for k, v in r.items():
                toks += v.split()
                labs += ["B-" + k.upper()] + ["I-" + k.upper()] * (len(v.split()) - 1)
            toks.append("sep")
            labs.append("O")
        cases.append((toks, labs, recs))
    df = spark.createDataFrame([(i, t, l) for i, (t, l, _) in enumerate(cases)], "i int, t array<string>, l array<string>")
    for r in df.select("i", TR.decode_bio(F.col("t"), F.col("l")).alias("d")).collect():
        assert [dict(m) for m in r["d"]] == cases[r["i"]][2]


def test_encode_decode_round_trip(spark):
    text = "Query: q\n[TITLE]Blue Bolt Brand 4[/TITLE] [PRICE]12.5[/PRICE] [URL]https://s/item/1[/URL] "
    df = spark.createDataFrame([(text,)], "t string").select(TR.bio_labels(F.col("t")).alias("b"))
    d = df.select(TR.decode_bio(F.col("b.tokens"), TR.id_labels_to_names(F.col("b.labels"))).alias("d")).first()["d"]
    assert d[0]["title"] == "Blue Bolt Brand 4" and d[0]["price"] == "12.5"


def test_align_labels(spark):
    df = spark.createDataFrame([([None, 0, 0, 1, 2, 2, None], [1, 2, 0])], "w array<int>, l array<int>")
    al = df.select(TR.align_labels(F.col("w"), F.col("l"), max_len=10).alias("a")).first()["a"]
    assert list(al) == [-100, 1, -100, 2, 0, -100, -100, -100, -100, -100]


def brute_pieces(words, vocab, longest=8):
    out = {}
    for w in words:
        i, p = 0, []
        while i < len(w):
            m = next((m for m in range(longest, 1, -1) if i + m <= len(w) and w[i:i + m] in vocab), 1)
            p.append(w[i:i + m])
            i += m
        out[w] = p or [""]
    return out


def test_word_pieces(spark):
    from collections import Counter
    rng = random.Random(3)
    words = ["a", "ab", "", "é🙂é🙂é", "aaaaaaaaaaaa", "$12.50", "https://shop/item/1", "x" * 300] + ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 14))) for _ in range(300)]
    counts = Counter(words)
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    for size in (0, 5, 60):
        total = Counter()
        for w, n in counts.items():
            total.update({(w[i:i + m]): 0 for m in range(2, 9) for i in range(len(w) - m + 1)})
            for m in range(2, 9):
                for i in range(len(w) - m + 1):
                    total[w[i:i + m]] += n
        vocab = [p for p, _ in sorted(total.items(), key=lambda x: (-x[1] * (len(x[0]) - 1), x[0].encode()))[:size]]
        v = TR.vocabulary(df, size)
        assert {r.piece for r in v.collect()} == set(vocab)
        got = {r.word: list(r.pieces) for r in TR.word_pieces(df.select("word"), v).collect()}
        assert got == brute_pieces(counts, set(vocab)) and all("".join(p) == w for w, p in got.items())


def test_long_examples_take_several_sequences(spark):
    # 20 positions hold 18 pieces
    words = ["x" * n for n in (3, 7, 13, 20, 6, 1)] * 9
    labels = [(7 * i) % 9 for i in range(len(words))]
    df = spark.createDataFrame([(1, words, labels), (2, [], [])], "id int, tokens array<string>, labels array<int>")
    pieces = TR.word_pieces(spark.createDataFrame([(w,) for w in set(words)], "word string"), spark.createDataFrame([("xxxxxx",)], "piece string"))
    ids = TR.with_word_ids(df, pieces, ["id"])
    rows = {r["id"]: r["p"] for r in ids.select("id", TR.aligned_parts(F.col("word_ids"), F.col("labels"), 20).alias("p")).collect()}
    flat = [x for w, lab in zip(words, labels) for x in [lab] + [-100] * (len(w) // 6 + len(w) % 6 - 1)]
    assert len(rows[1]) == -(-len(flat) // 18) and rows[2] == [[-100] * 20]
    assert all(len(p) == 20 and p[0] == p[-1] == -100 for p in rows[1])
    assert [x for p in rows[1] for x in p[1:-1]][:len(flat)] == flat


def test_exact_split_sizes(spark):
    df = spark.range(0, 1003).withColumn("h", F.md5(F.col("id").cast("string")))
    s = TR.split_examples(df, ["h", "id"]).groupBy("split").count().collect()
    got = {r["split"]: r["count"] for r in s}
    assert got == {"validation": 201, "train": 802}
    for n, digits, share in ((0, 4, 0.2), (1, 4, 0.2), (4, 1, 0.2), (1003, 1, 0.2), (1003, 2, 0.5), (50, 4, 0.0), (50, 1, 1.0)):
        hashed = spark.range(0, n).withColumn("h", F.md5((F.col("id") % 7).cast("string")))  # ties in the hash
        rows = sorted((r["h"], r["id"], r["split"]) for r in TR.split_examples(hashed, ["h", "id"], share, digits).collect())
        k = -(-n * share // 1)
        assert [s for *_, s in rows] == ["validation" if i < k else "train" for i in range(n)]


def test_training_document_layouts(spark, tmp_path):
    rows = [{"text": "t1", "query": "q", "site": "jiji", "source": "x", "product_data": {"title": "T", "price": 2.5}},
            {"text": "t2", "query": "q", "timestamp": "2024", "source": "x"},
            {"text": "", "query": "q"}, {"query": "q"}, {"text": "t"}]
    for sub, body in (("a", {"metadata": {"total_examples": len(rows)}, "training_data": rows}), ("b", rows)):
        (tmp_path / sub).mkdir()
        (tmp_path / sub / "examples.json").write_text(json.dumps(body, indent=2), encoding="utf-8")
        got = TR.read_training_set(spark, str(tmp_path / sub), layout="document")
        assert sorted((*r[:4], tuple(sorted(r.product_data.items()))) for r in got.collect()) == [
            ("", "q", "unknown", "", ()), ("t1", "q", "jiji", "", (("price", "2.5"), ("title", "T"))), ("t2", "q", "unknown", "2024", ())]
