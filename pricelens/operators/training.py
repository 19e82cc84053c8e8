"""Training-set preparation and decoding.

Annotated examples, token/label arrays and decoded entities are array
expressions per row; the only cross-row steps are the exact 80/20 split (a
distributed global rank) and the statistics (one grouping-sets aggregate).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions import rules
from ..functions.prices import number_text
from ..functions.regex import pystrip
from ..session import shuffles_removed
from ..sources.json_arrays import RANGE_BYTES, exists, read_json_array

_TAG = r"(?Ud)\[(\w+)\](.*?)\[/\1\]"
_SEP_SEG, _SEP_TYPE = "\u0001", "\u0002"
ENTITY_TYPES = ["TITLE", "PRICE", "URL", "IMG"]


def _lists(offsets: np.ndarray, values: np.ndarray | pa.Array, null: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values), mask=pa.array(null) if null.any() else None)


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


# ---------------------------------------------------------------- T1
def annotate(query: Column, title: Column, price: Column, currency: Column, url: Column,
             image_url: Column, description: Column) -> Column:
    """Offer -> annotated text with [TITLE]/[PRICE]/[URL]/[IMG] spans; NULL without title or price."""
    def opt(c: Column, fmt) -> Column:
        return F.when(c.isNotNull() & (c != ""), fmt(c)).otherwise(F.lit(""))
    price_str = pystrip(F.concat_ws(" ", F.coalesce(currency, F.lit("")), number_text(price.cast("double"))))
    text = F.concat(
        F.lit("Query: "), query, F.lit("\n"),
        F.lit("[TITLE]"), title, F.lit("[/TITLE] "),
        F.lit("[PRICE]"), price_str, F.lit("[/PRICE] "),
        opt(url, lambda c: F.concat(F.lit("[URL]"), c, F.lit("[/URL] "))),
        opt(image_url, lambda c: F.concat(F.lit("[IMG]"), c, F.lit("[/IMG] "))),
        opt(description, lambda c: F.concat(F.lit("Description: "), c)))
    ok = title.isNotNull() & (title != "") & price.isNotNull() & (price != 0)
    return F.when(ok, text)


# ---------------------------------------------------------------- T2, T3
def _parts(a: pa.Array, sign: str, limit: int | None = None) -> tuple[pa.Array, np.ndarray]:
    """The parts of all texts, split at ``sign``, and how many each text has (a null one none)."""
    lists = pc.split_pattern(a, sign, max_splits=limit)
    return lists.flatten(), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def bio_labels(text: Column) -> Column:
    """Annotated text -> struct(tokens, labels): whitespace tokens; an entity's first
    token gets B-<type>, the rest I-<type>; unknown types and plain text get O.

    Tags and white space are found by Java's regexes; the segments between the marks are split and labelled for a
    batch of rows together."""
    marked = F.regexp_replace(text, F.lit(_TAG), F.lit(_SEP_SEG + "$1" + _SEP_TYPE + "$2" + _SEP_SEG))
    spaced = F.regexp_replace(marked, F.lit(r"(?U)\s+"), F.lit(" "))

    def batch(texts: pa.Array) -> pa.Array:
        segs, n_segs = _parts(texts.cast(pa.string()), _SEP_SEG)
        halves, n_halves = _parts(segs, _SEP_TYPE, 1)
        end = np.cumsum(n_halves)
        typed = n_halves == 2
        kinds = halves.take(pa.array((end - n_halves)[typed]))
        begins, goes_on = np.zeros((2, len(segs)), np.int32)
        for t in ENTITY_TYPES:
            own = np.flatnonzero(typed)[pc.equal(kinds, t).to_numpy(zero_copy_only=False)]
            begins[own], goes_on[own] = rules.LABEL2ID["B-" + t], rules.LABEL2ID["I-" + t]
        words, n_words = _parts(halves.take(pa.array(end - 1)), " ")
        kept = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        seg = np.repeat(np.arange(len(segs)), n_words)[kept]
        first = np.ones(len(seg), bool)
        first[1:] = seg[1:] != seg[:-1]
        row = np.repeat(np.arange(len(texts)), n_segs)[seg]
        offsets, null = _offsets(np.bincount(row, minlength=len(texts))), texts.is_null().to_numpy(zero_copy_only=False)
        return pa.StructArray.from_arrays([_lists(offsets, words.filter(pa.array(kept)), null),
                                           _lists(offsets, np.where(first, begins[seg], goes_on[seg]), null)], names=["tokens", "labels"])
    return arrow_udf(batch, "tokens array<string>, labels array<int>")(spaced)


def bio_valid(tokens: Column, labels: Column) -> Column:
    """Non-empty and equally long."""
    return (F.size(tokens) > 0) & (F.size(tokens) == F.size(labels))


# ---------------------------------------------------------------- T4
def align_labels(word_ids: Column, labels: Column, max_len: int = rules.MAX_SEQ_LEN) -> Column:
    """First sub-token of a word takes the word's label (0 past the end), other
    sub-tokens and special positions -100; padded / cut to ``max_len``."""
    ign = F.lit(rules.IGNORE_LABEL)
    al = F.transform(word_ids, lambda w, k: F.when(w.isNull(), ign)
                     .when((k == 0) | ~F.get(word_ids, k - 1).eqNullSafe(w),
                           F.coalesce(F.get(labels, w), F.lit(0)))
                     .otherwise(ign))
    return F.slice(F.concat(al, F.array_repeat(ign, max_len)), 1, max_len)


VOCABULARY = 1_000   # pieces of two or more characters
PIECE_CHARS = 8      # of the longest piece
COUNTED_TOKENS = 200_000  # of a task's texts, before their counts are sent on
KNOWN_WORDS = 100_000     # whose number of pieces a task remembers


def word_counts(examples: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``word, n``: the distinct words of ``examples``, counted. A task adds up some ``COUNTED_TOKENS`` words before they
    are grouped, as most of a text's words come again in the next ones."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def added() -> pa.RecordBatch:
            c = pa.chunked_array(held, pa.string()).value_counts()
            return pa.RecordBatch.from_arrays([c.field("values"), c.field("counts")], names=["word", "n"])
        for b in batches:
            held.append(b.column(0).flatten().cast(pa.string()))
            n += len(held[-1])
            if n >= COUNTED_TOKENS:
                yield added()
                held, n = [], 0
        if n:
            yield added()
    return examples.select(tokens).mapInArrow(counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(words: DataFrame, size: int = VOCABULARY, longest: int = PIECE_CHARS) -> DataFrame:
    """``piece``: the ``size`` runs of characters that save most (occurrences in ``words(word, n)`` times
    characters beyond the first). Single characters are pieces without being listed. Runs of ``longest`` characters
    (shorter at a word's end) are counted first; each is then cut into the runs that it begins with."""
    at = words.where(F.length("word") > 1).select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i"))
    runs = at.select(F.substring("word", F.col("i"), F.lit(longest)).alias("run"), "n").groupBy("run").agg(F.sum("n").alias("n"))
    s = runs.select("run", "n", F.explode(F.sequence(F.lit(2), F.length("run"))).alias("m"))
    s = s.select(F.substring("run", F.lit(1), F.col("m")).alias("piece"), "n").groupBy("piece").agg(F.sum("n").alias("n"))
    return s.orderBy((F.col("n") * (F.length("piece") - 1)).desc(), "piece").limit(size).select("piece")


def piece_pattern(vocab: DataFrame, longest: int = PIECE_CHARS) -> str:
    """One regex whose successive matches cut a word longest match first. The vocabulary (at most ``VOCABULARY``
    rows reach the driver) becomes a tree of characters: what is longer is tried first, at each place at most one branch fits."""
    tree: dict = {}
    for (piece,) in vocab.where(F.length("piece").between(2, longest)).select("piece").collect():
        at = tree
        for c in piece:
            at = at.setdefault(c, {})
        at[""] = {}

    def below(node: dict) -> str:
        rest = "|".join(f"\\x{{{ord(c):x}}}" + below(node[c]) for c in sorted(node) if c)
        return (f"(?:{rest})" + ("?" if "" in node else "")) if rest else ""
    return f"(?s){below(tree)}|." if tree else "(?s)."


def word_pieces(words: DataFrame, vocab: DataFrame, longest: int = PIECE_CHARS) -> DataFrame:
    """``word, pieces``: each distinct word cut longest match first, in its own row (``piece_pattern``)."""
    w = F.col("word")
    return words.select("word", F.when(w == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(w, F.lit(piece_pattern(vocab, longest)), F.lit(0))).alias("pieces"))


def _int_list(a: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths (0 for null), null rows, values, null values of lists of numbers."""
    v = a.flatten()
    return (pc.list_value_length(a).fill_null(0).to_numpy(zero_copy_only=False), a.is_null().to_numpy(zero_copy_only=False),
            v.fill_null(0).to_numpy(zero_copy_only=False), v.is_null().to_numpy(zero_copy_only=False))


def word_ids(tokens: Column, pattern: str) -> Column:
    """The word (from 0) of each piece of an example's tokens, in order, by the ``piece_pattern``: as
    ``with_word_ids`` has it for a table of pieces, without leaving the row. Of a batch of rows each distinct token is
    cut once, and not at all if its number of pieces is still known."""
    python = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern)

    def batches(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cut, known = re.compile(python).findall, {"": 1}
        for a in arrays:
            flat = a.flatten().dictionary_encode()
            if len(known) > KNOWN_WORDS:
                known = {"": 1}
            words = flat.dictionary.to_pylist()
            for w in words:
                if w not in known:
                    known[w] = len(cut(w))
            n = np.array([known[w] for w in words] + [0], np.int64)[flat.indices.fill_null(len(words)).to_numpy(zero_copy_only=False)]
            lengths = pc.list_value_length(a).fill_null(0).to_numpy(zero_copy_only=False)
            null, start = a.is_null().to_numpy(zero_copy_only=False), _offsets(lengths)
            if flat.null_count:  # an example with a token that is null has no ids
                null = null | (np.diff(_offsets(flat.is_null().to_numpy(zero_copy_only=False))[start]) > 0)
            k = np.arange(len(n)) - np.repeat(start[:-1], lengths)
            yield _lists(_offsets(n)[start], np.repeat(k, n).astype(np.int32), null)
    return arrow_udf(batches, "array<int>")(tokens)


def with_word_ids(examples: DataFrame, pieces: DataFrame, key: Sequence[str]) -> DataFrame:
    """``key``, ``word_ids`` (the word of each piece, in order) and ``labels`` of ``examples(key, tokens, labels)``;
    rows that share a key stay rows of their own."""
    examples = examples.withColumn("_row", F.monotonically_increasing_id())
    n = pieces.select(F.col("word").alias("token"), F.size("pieces").alias("n"))
    t = examples.select(*key, F.posexplode_outer(F.arrays_zip(F.col("tokens").alias("token"), F.col("labels").alias("label"))).alias("k", "x"), "_row")
    t = t.select(*key, "_row", "k", "x.token", "x.label").join(n, "token", "left")
    row = F.when(F.col("k").isNotNull(), F.struct("k", "n", "label"))
    g = t.groupBy("_row", *key).agg(F.sort_array(F.collect_list(row)).alias("r"))  # one example's words
    return g.select(*key, F.flatten(F.transform("r", lambda x: F.array_repeat(x["k"], x["n"]))).alias("word_ids"), F.transform("r", lambda x: x["label"]).alias("labels"))


def aligned_parts(word_ids: Column, labels: Column, max_len: int = rules.MAX_SEQ_LEN) -> Column:
    """The aligned labels of an example of any length as sequences of ``max_len`` positions, each
    framed by two special positions and padded; a word that goes on in the next sequence is
    not labelled again. The sequences of a batch of rows are filled together."""
    ign, room = rules.IGNORE_LABEL, max_len - 2

    def batch(ids: pa.Array, names: pa.Array) -> pa.Array:
        n, null, w, w_null = _int_list(ids)
        n_labels, _, lab, _ = _int_list(names)  # a label that is null counts as 0
        n, w = n.astype(np.int64), w.astype(np.int64)
        start, row = _offsets(n), np.repeat(np.arange(len(n)), n)
        k = np.arange(len(w)) - start[row]
        first = k == 0
        first[1:] |= (w[1:] != w[:-1]) & ~w_null[1:] & ~w_null[:-1]
        has = ~w_null & (w >= 0) & (w < n_labels[row])
        own = np.zeros(len(w), np.int32)
        own[has] = lab[(_offsets(n_labels)[row] + w)[has]]
        parts = _offsets(np.maximum(1, -(-n // room)))
        out = np.full((parts[-1], max_len), ign, np.int32)
        out[parts[row] + k // room, 1 + k % room] = np.where(first, own, ign)
        no_ids = np.repeat(null, np.diff(parts))
        inner = _lists(np.arange(parts[-1] + 1) * max_len, out.reshape(-1), no_ids)
        return _lists(parts, inner, np.zeros(len(n), bool))
    return arrow_udf(batch, "array<array<int>>")(word_ids, labels)


def labels_text(labels: Column, used: Column) -> Column:
    """An aligned sequence as text, by commas: the first ``used`` positions one by one, the padding after them at once."""
    used = F.least(F.greatest(F.lit(1), used), F.size(labels))
    return F.concat(F.array_join(F.slice(labels, F.lit(1), used).cast("array<string>"), ","),
                    F.repeat(F.lit(f",{rules.IGNORE_LABEL}"), F.size(labels) - used))


# ---------------------------------------------------------------- T5
def split_examples(df: DataFrame, order: list[str], validation: float = 0.2, digits: int = 4) -> DataFrame:
    """T5: exact split: the first ceil(0.2 n) rows in hash order are validation.

    ``order[0]`` is a hash in hex, the other columns break ties. The last validation row is
    selected, not sorted for: a histogram over the hash's first ``digits`` (16^digits rows at most) tells the bin that
    holds it, and only that bin's rows (n / 16^digits) are numbered. The split is then a comparison
    in the same pass that returns the rows; nothing but the histogram is shuffled.
    """
    bin_of = F.substring(order[0], 1, digits)
    hist = df.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.select("bin", "n", F.sum("n").over(upto).alias("upto"), F.ceil(F.sum("n").over(Window.partitionBy()) * validation).alias("k"))
    edge = hist.where("upto - n < k AND upto >= k")  # one row, none if there are no rows
    at = Window.orderBy(*order)
    in_bin = df.where(bin_of == edge.select("bin").scalar()).select(*order, F.row_number().over(at).alias("at"))
    last = in_bin.where(F.col("at") == edge.select(F.col("k") - F.col("upto") + F.col("n")).scalar()).select(F.struct(*order)).scalar()
    return df.withColumn("split", F.when(F.struct(*order) <= last, F.lit("validation")).otherwise(F.lit("train")))


# ---------------------------------------------------------------- T6, T7
def training_ready(df: DataFrame) -> DataFrame:
    """Example count and the two gates (>= 10 to train, >= 20 to auto-train)."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("n_examples"), (n >= rules.TRAIN_MIN_EXAMPLES).alias("can_train"),
                  (n >= rules.AUTO_TRAIN_MIN_EXAMPLES).alias("auto_train"))


def training_stats(df: DataFrame) -> DataFrame:
    """Totals per source, per query and overall, with the earliest/latest
    timestamp (string order), in one grouping-sets aggregate."""
    g = df.groupingSets([["source"], ["query"], []], "source", "query").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("earliest"), F.max("timestamp").alias("latest"),
        F.grouping_id().alias("_g"))
    kind = F.when(F.col("_g") == 1, F.lit("source")).when(F.col("_g") == 2, F.lit("query")).otherwise(F.lit("total"))
    key = F.coalesce(F.when(F.col("_g") == 1, F.col("source")).when(F.col("_g") == 2, F.col("query")),
                     F.when(F.col("_g") == 3, F.lit("")).otherwise(F.lit("unknown")))
    return g.select(kind.alias("kind"), key.alias("key"), "n", "earliest", "latest")


# ---------------------------------------------------------------- T8, T9
def join_pieces(tokens: Column) -> Column:
    """Word pieces ('##x') glued to the previous token; others space-separated."""
    j = F.aggregate(tokens, F.lit(""), lambda acc, t: F.when(t.startswith("##"), F.concat(acc, F.substring(t, 3, 1 << 30)))
                    .when(acc == "", t).otherwise(F.concat(acc, F.lit(" "), t)))
    return pystrip(j)


def _put(m: Column, k: Column, v: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda x, _y: x != k), F.create_map(k, v))


def decode_bio(tokens: Column, labels: Column) -> Column:
    """(tokens, label names) -> ARRAY<MAP<entity, text>>. B- starts an entity,
    I- extends the open one, O closes it and emits the record if it has a title
    or a price; special tokens are skipped; a repeated entity overwrites."""
    empty_map = F.create_map().cast("map<string,string>")
    init = F.struct(F.lit(None).cast("string").alias("ent"), F.array().cast("array<string>").alias("toks"),
                    empty_map.alias("cur"), F.array().cast("array<map<string,string>>").alias("out"))
    specials = F.array(*[F.lit(s) for s in rules.SPECIAL_TOKENS])

    def saved(acc):
        return F.when(acc["ent"].isNotNull() & (F.size(acc["toks"]) > 0),
                      _put(acc["cur"], acc["ent"], join_pieces(acc["toks"]))).otherwise(acc["cur"])

    def complete(m):
        return (F.size(m) > 0) & (F.array_contains(F.map_keys(m), "title") | F.array_contains(F.map_keys(m), "price"))

    def step(acc, p):
        tok, lab = p["t"], p["l"]
        b = F.struct(F.lower(F.substring(lab, 3, 1 << 30)).alias("ent"), F.array(tok).alias("toks"),
                     saved(acc).alias("cur"), acc["out"].alias("out"))
        i = F.struct(acc["ent"].alias("ent"), F.concat(acc["toks"], F.array(tok)).alias("toks"),
                     acc["cur"].alias("cur"), acc["out"].alias("out"))
        had = acc["ent"].isNotNull() & (F.size(acc["toks"]) > 0)
        c = saved(acc)
        o = F.struct(
            F.when(had, F.lit(None).cast("string")).otherwise(acc["ent"]).alias("ent"),
            F.when(had, F.array().cast("array<string>")).otherwise(acc["toks"]).alias("toks"),
            F.when(complete(c), empty_map).otherwise(c).alias("cur"),
            F.when(complete(c), F.concat(acc["out"], F.array(c))).otherwise(acc["out"]).alias("out"))
        return (F.when(F.array_contains(specials, tok), acc)
                .when(lab.startswith("B-"), b)
                .when(lab.startswith("I-") & acc["ent"].isNotNull(), i)
                .when(lab == "O", o)
                .otherwise(acc))

    def finish(acc):
        c = saved(acc)
        return F.when(complete(c), F.concat(acc["out"], F.array(c))).otherwise(acc["out"])

    pairs = F.arrays_zip(tokens.alias("t"), labels.alias("l"))
    return F.aggregate(F.transform(pairs, lambda x: F.struct(x["t"].alias("t"), x["l"].alias("l"))), init, step, finish)


def id_labels_to_names(labels: Column) -> Column:
    names = F.create_map(*[x for k, v in rules.LABEL2ID.items() for x in (F.lit(v), F.lit(k))])
    return F.transform(labels, lambda x: F.coalesce(F.try_element_at(names, x), F.lit("O")))


# ---------------------------------------------------------------- S3, S4
DOCUMENT_BYTES = 32 << 20
FILE_EXAMPLES = 500_000

EXAMPLE_SCHEMA = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("query", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("product_data", T.MapType(T.StringType(), T.StringType())),
])


def write_training_set(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Append examples (UTF-8 JSON Lines, or parquet), partitioned by source; a record
    carries its source as ``site`` and its product data as an object. JSON Lines are compressed (most of
    an example repeats others), in files of at most ``FILE_EXAMPLES``, as such a file is read by one task."""
    w = df.withColumn("site", F.col("source")).write.mode("append").partitionBy("source").format(fmt)
    (w.option("compression", "gzip").option("maxRecordsPerFile", FILE_EXAMPLES) if fmt == "json" else w).save(path)


def write_training_documents(df: DataFrame, path: str, file_bytes: int = DOCUMENT_BYTES, compression: str = "none") -> None:
    """S4, document layout: ``{"training_data": [...], "metadata": {"total_examples": n}}`` files of at most about
    ``file_bytes`` each (before ``compression``), whatever the number of examples; columns as in ``EXAMPLE_SCHEMA``.

    A document is one row and a file one row, so a task writes as many files as its examples fill and no example is
    shuffled; tasks that have fewer are put together, as many as the bytes of all examples ask for."""
    ex = df.select(F.to_json(F.struct("text", "query", F.col("source").alias("site"), "timestamp", "product_data")).alias("value"))
    with shuffles_removed(df.sparkSession):
        total = ex.agg(F.sum(F.octet_length("value"))).collect()[0][0] or 0

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def document() -> pa.RecordBatch:
            text = '{"training_data": [' + "\n,".join(held) + f'], "metadata": {{"total_examples": {len(held)}}}}}'
            return pa.RecordBatch.from_arrays([pa.array([text], pa.string())], names=["value"])
        for b in batches:
            for x, n in zip(b.column(0).to_pylist(), pc.binary_length(b.column(0)).to_pylist()):
                if held and size + n > file_bytes:
                    yield document()
                    held, size = [], 0
                held.append(x)
                size += n
        if held or not total:
            yield document()
    docs = ex.coalesce(max(1, -(-total // file_bytes))).mapInArrow(documents, "value string")
    docs.write.option("maxRecordsPerFile", 1).option("compression", compression).text(path)


def read_training_set(spark: SparkSession, path: str, layout: str = "lines", fallback: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """S3: load examples; keep rows that have a text and a query (even empty ones); source is
    the record's 'site', else 'unknown'; timestamp defaults to '', product data to {}. Where nothing
    is at ``path``, ``fallback`` is read.

    ``layout='lines'``: JSON Lines (what ``write_training_set`` writes), compressed or not.
    ``layout='document'``: JSON documents, either a bare array of examples or ``{"metadata": ...,
    "training_data": [...]}``, compressed or not, read by byte ranges (``sources.json_arrays``).
    """
    if fallback is not None and not exists(path):
        path = fallback
    raw = read_json_array(spark, path, "training_data", range_bytes) if layout == "document" else spark.read.text(path)
    ex = raw.select(F.try_parse_json(F.col("value")).alias("ex")).filter(F.col("ex").isNotNull())

    def g(p, typ="string"):
        return F.try_variant_get(F.col("ex"), p, typ)
    out = ex.select(g("$.text").alias("text"), g("$.query").alias("query"),
                    F.coalesce(g("$.site"), F.lit("unknown")).alias("source"),
                    F.coalesce(g("$.timestamp"), F.lit("")).alias("timestamp"),
                    F.coalesce(g("$.product_data", "map<string,string>"),
                               F.create_map().cast("map<string,string>")).alias("product_data"))
    return out.filter(F.col("text").isNotNull() & F.col("query").isNotNull())
