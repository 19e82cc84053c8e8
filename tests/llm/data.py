"""Small adversarial documents shared by the tests."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, norm string, fp bigint, row string, component_id bigint"


def documents():
    """Nulls, empty and white-space texts, odd characters, repeated rows, a very long text,
    columns whose names operators use inside."""
    t = {
        1: "The quick brown fox jumps over the lazy dog, it's a well-known sentence.",
        2: "The quick  brown fox\tjumps over the lazy dog, it's a well-known sentence.",
        3: None, 4: "", 5: " \n\t ", 6: "\x1c\x85   ​ odd spaces ",
        7: "naïve café — ₵120 ²½ ⅷ 漢字かな 🙂🙂 áb don't we'll I'VE 12345 ___ x_y",
        8: "lorem " * 30_000, 9: "x" * 60_000, 10: "the end\n\n\nthe end  \n", 11: " ", 12: "  ",
        13: "<|endoftext|>start <|endoftext|> end<|endoftext|><|endoftext|>", 14: "K and ſ İ",
        15: "one two three", 16: "ONE TWO THREE", 17: "\U0001f9d1‍\U0001f4bb emoji zwj \t\t tabs   ",
    }
    rows = [(k, v, "en" if k % 2 else None, "s", None if v is None else len(v), "c", 1, "r", 7) for k, v in t.items()]
    rows += [rows[0], rows[0], (None, t[1], None, None, None, None, None, None, None), (None, "only here", None, None, 1, None, None, None, None)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
