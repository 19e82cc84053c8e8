"""Training-set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as TX
from ..functions.prices import number_text
from ..operators import ranking as RK
from ..operators import training as TR
from ..operators.windows import stored
from ..session import scratch_path
from ..sources import fixtures as fx
from .registry import query

FXT = ["offers", "searches"]


def _offer_fields(u):
    """Offer fields for annotation: image on even lines, description on the first two."""
    img = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.replace(F.col("url"), F.lit("/item/"), F.lit("/img/")), F.lit(".jpg")))
    desc = F.when(F.col("l_linenumber") <= 2, F.concat(F.lit("Buy "), F.col("title"), F.lit(" from "), F.col("source")))
    return u.withColumn("image_url", img).withColumn("description", desc)


def examples_df(spark, sf_dir, *more):
    """T1 over all offers of every search (with ``more`` columns of the offer)."""
    u = _offer_fields(fx.offers(spark, sf_dir))
    text = TR.annotate(F.col("query"), F.col("title"), F.col("price"), F.lit(""), F.col("url"),
                       F.col("image_url"), F.col("description"))
    return u.select("query_id", "site_key", "l_orderkey", "l_linenumber", F.explode(TX.if_present(text)).alias("text"), "query", "source",
                    F.date_format("last_updated", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), *more)


_IMG_SQL = "CASE WHEN l_linenumber % 2 = 0 THEN replace(url, '/item/', '/img/') || '.jpg' END"
_DESC_SQL = "CASE WHEN l_linenumber <= 2 THEN 'Buy ' || title || ' from ' || source END"
EXAMPLES_SQL = f"""SELECT query_id, site_key, l_orderkey, l_linenumber,
  'Query: ' || query || chr(10) || '[TITLE]' || title || '[/TITLE] ' ||
  '[PRICE]' || CAST(price AS VARCHAR) || '[/PRICE] ' ||
  CASE WHEN coalesce(url, '') <> '' THEN '[URL]' || url || '[/URL] ' ELSE '' END ||
  CASE WHEN coalesce(img, '') <> '' THEN '[IMG]' || img || '[/IMG] ' ELSE '' END ||
  CASE WHEN coalesce(descr, '') <> '' THEN 'Description: ' || descr ELSE '' END AS text,
  query, source, strftime(last_updated, '%Y-%m-%dT%H:%M:%S') AS timestamp, title, price, url
FROM (SELECT *, {_IMG_SQL} AS img, {_DESC_SQL} AS descr FROM offers) x
WHERE coalesce(title, '') <> '' AND coalesce(price, 0) <> 0"""


@query("annotate_offers", sql=f"SELECT query_id, site_key, l_orderkey, l_linenumber, text, query, source, timestamp FROM ({EXAMPLES_SQL}) e",
       fixtures=FXT)
def annotate_offers(spark, sf_dir):
    """Offers turned into annotated training texts."""
    return examples_df(spark, sf_dir)


def bio_df(spark, sf_dir):
    e = examples_df(spark, sf_dir)
    return e.withColumn("bio", TR.bio_labels(F.col("text"))).select(
        "query_id", "site_key", "l_orderkey", "l_linenumber", "text", F.col("bio.tokens").alias("tokens"), F.col("bio.labels").alias("labels"))


def _bio_sql() -> str:
    """T2 in SQL: a recursive scan for the next ``[NAME]`` whose ``[/NAME]`` follows on
    the same line (shortest content), i.e. the tag rule with its back-reference spelled out."""
    b = "CASE nm " + " ".join(f"WHEN '{t}' THEN {rules.LABEL2ID['B-' + t]}" for t in TR.ENTITY_TYPES) + " ELSE 0 END"
    i = "CASE nm " + " ".join(f"WHEN '{t}' THEN {rules.LABEL2ID['I-' + t]}" for t in TR.ENTITY_TYPES) + " ELSE 0 END"

    def words(x):
        return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: length(w) > 0)"
    return f"""WITH RECURSIVE ex AS ({EXAMPLES_SQL}),
  scan AS (
    SELECT query_id, site_key, l_orderkey, l_linenumber, text, 1::BIGINT AS cur, 1::BIGINT AS srch, []::VARCHAR[] AS toks,
           []::INTEGER[] AS labs, FALSE AS done FROM ex
    UNION ALL
    SELECT query_id, site_key, l_orderkey, l_linenumber, text,
      CASE WHEN nm = '' THEN cur WHEN ok THEN cl_end ELSE cur END,
      CASE WHEN nm = '' THEN srch WHEN ok THEN cl_end ELSE o + 1 END,
      CASE WHEN nm = '' THEN list_concat(toks, {words('substr(text, cur)')})
           WHEN ok THEN list_concat(toks, {words('substr(text, cur, o - cur)')}, {words('content')})
           ELSE toks END,
      CASE WHEN nm = '' THEN list_concat(labs, list_transform({words('substr(text, cur)')}, lambda w: 0))
           WHEN ok THEN list_concat(labs, list_transform({words('substr(text, cur, o - cur)')}, lambda w: 0),
                                    list_transform({words('content')}, lambda w, j: CASE WHEN j = 1 THEN {b} ELSE {i} END))
           ELSE labs END,
      nm = ''
    FROM (SELECT *, c > 0 AND (nl = 0 OR c < nl) AS ok, substr(seg, 1, c - 1) AS content,
                 after + c - 1 + length(nm) + 3 AS cl_end FROM (
      SELECT *, strpos(seg, '[/' || nm || ']') AS c, strpos(seg, chr(10)) AS nl FROM (
        SELECT *, substr(text, after) AS seg FROM (
          SELECT *, o + length(nm) + 2 AS after FROM (
            SELECT *, CASE WHEN nm = '' THEN 0 ELSE srch + strpos(substr(text, srch), '[' || nm || ']') - 1 END AS o
            FROM (SELECT *, regexp_extract(substr(text, srch), '\\[(\\w+)\\]', 1) AS nm FROM scan WHERE NOT done) a) b) c) d) e) f
  )
  SELECT query_id, site_key, l_orderkey, l_linenumber, toks AS tokens, labs AS labels FROM scan WHERE done"""


BIO_SQL = _bio_sql()


@query("bio_labels", sql=f"""SELECT query_id, site_key, l_orderkey, l_linenumber, CAST(len(tokens) AS INTEGER) AS n_tokens,
  array_to_string(tokens, ' ') AS tokens, array_to_string(list_transform(labels, lambda x: CAST(x AS VARCHAR)), ',') AS labels
  FROM ({BIO_SQL}) b""", fixtures=FXT)
def bio_labels(spark, sf_dir):
    """Annotated texts -> whitespace tokens and BIO label ids."""
    b = bio_df(spark, sf_dir)
    return b.select("query_id", "site_key", "l_orderkey", "l_linenumber", F.size("tokens").alias("n_tokens"),
                    F.array_join("tokens", " ").alias("tokens"),
                    F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"))


@query("bio_valid", sql=f"""SELECT query_id, site_key, l_orderkey, l_linenumber, CAST(len(tokens) AS INTEGER) AS n_tokens FROM ({BIO_SQL}) b
  WHERE len(tokens) > 0 AND len(tokens) = len(labels)""", fixtures=FXT)
def bio_valid(spark, sf_dir):
    """Examples with non-empty, equally long token and label lists."""
    b = bio_df(spark, sf_dir)
    return b.filter(TR.bio_valid(F.col("tokens"), F.col("labels"))).select("query_id", "site_key", "l_orderkey", "l_linenumber",
                                                                        F.size("tokens").alias("n_tokens"))


# Words, their runs of characters, the vocabulary, and each word cut longest match first.
_PIECE_CTES = f"""bio AS MATERIALIZED (SELECT *, row_number() OVER () AS row FROM ({BIO_SQL}) b0),
  w AS (SELECT word, count(*) AS n FROM (SELECT unnest(tokens) AS word FROM bio) t GROUP BY word),
  places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
  subs AS (SELECT word, n, i, m, substr(word, i, m) AS piece FROM (SELECT word, n, i, unnest(range(2, {TR.PIECE_CHARS} + 1)) AS m FROM places) p WHERE i + m <= length(word) + 1),
  voc AS (SELECT piece FROM (SELECT piece, sum(n) AS n FROM subs GROUP BY piece) s ORDER BY n * (length(piece) - 1) DESC, piece LIMIT {TR.VOCABULARY}),
  best AS (SELECT word, i, max(m) AS m FROM subs JOIN voc USING (piece) GROUP BY word, i),
  steps AS (SELECT word, list(coalesce(m, 1) ORDER BY i) AS step FROM places LEFT JOIN best USING (word, i) GROUP BY word),
  pieces AS (SELECT word, list_reduce(range(1, length(word) + 1), lambda acc, i: CASE WHEN i = acc.nxt THEN struct_pack(nxt := acc.nxt + step[i],
      out := list_append(acc.out, substr(word, i, step[i]))) ELSE acc END, struct_pack(nxt := 1::BIGINT, out := []::VARCHAR[])).out AS pieces FROM steps),
  ids AS (SELECT row, query_id, site_key, l_orderkey, l_linenumber, labels, flatten(list(list_transform(range(len(pieces)), lambda z: CAST(k - 1 AS INTEGER)) ORDER BY k)) AS wid
          FROM (SELECT *, unnest(tokens) AS word, unnest(range(1, len(tokens) + 1)) AS k FROM bio) t JOIN pieces USING (word) GROUP BY ALL)"""
_ROOM = rules.MAX_SEQ_LEN - 2
_ALIGNED = (f"list_transform(wid, lambda w, i: CASE WHEN i = 1 OR wid[i - 1] <> w THEN coalesce(labels[w + 1], 0) "
            f"ELSE {rules.IGNORE_LABEL} END)")
_PART = (f"list_concat([{rules.IGNORE_LABEL}], al[part * {_ROOM} + 1:(part + 1) * {_ROOM}], "
         f"list_transform(range({rules.MAX_SEQ_LEN}), lambda z: {rules.IGNORE_LABEL}))[1:{rules.MAX_SEQ_LEN}]")


_KEY = ["query_id", "site_key", "l_orderkey", "l_linenumber"]


def _words(spark, sf_dir):
    """``word, n``: the distinct words of the training texts, counted once for the vocabulary and what follows."""
    return stored(TR.word_counts(bio_df(spark, sf_dir)), "words")


@query("word_pieces", sql=f"WITH {_PIECE_CTES} SELECT word, array_to_string(pieces, ' ') AS pieces, CAST(len(pieces) AS INTEGER) AS n_pieces FROM pieces", fixtures=FXT)
def word_pieces(spark, sf_dir):
    """T4: every word of the training texts cut into pieces of a vocabulary counted from them, longest match first."""
    words = _words(spark, sf_dir)
    return TR.word_pieces(words.select("word"), TR.vocabulary(words)).select("word", F.array_join("pieces", " ").alias("pieces"), F.size("pieces").alias("n_pieces"))


@query("align_labels", sql=f"""WITH {_PIECE_CTES}
  SELECT query_id, site_key, l_orderkey, l_linenumber, CAST(part AS INTEGER) AS part,
  CAST(len(ap) AS INTEGER) AS n_positions,
  CAST(len(list_filter(ap, lambda x: x <> {rules.IGNORE_LABEL})) AS INTEGER) AS n_labelled,
  array_to_string(list_transform(ap, lambda x: CAST(x AS VARCHAR)), ',') AS aligned
  FROM (SELECT *, {_PART} AS ap FROM (
    SELECT *, unnest(range(CAST(greatest(1, ceil(len(al) / {_ROOM})) AS BIGINT))) AS part FROM (
      SELECT *, {_ALIGNED} AS al FROM ids) a) p) q""", fixtures=FXT)
def align_labels(spark, sf_dir):
    """T4: labels aligned to sub-word positions (first piece labelled, others -100), in
    sequences of 512."""
    ids = TR.word_ids(F.col("tokens"), TR.piece_pattern(TR.vocabulary(_words(spark, sf_dir))))
    b = bio_df(spark, sf_dir).select(*_KEY, F.explode(F.array(F.struct(ids.alias("word_ids"), "labels"))).alias("x"))  # bound once
    b = b.select(*_KEY, F.size("x.word_ids").alias("n"), F.posexplode(TR.aligned_parts(F.col("x.word_ids"), F.col("x.labels"))).alias("part", "al"))
    used = 1 + F.least(F.lit(_ROOM), F.greatest(F.lit(0), F.col("n") - F.col("part") * _ROOM))  # the special position before, and the pieces
    return b.select(*_KEY, "part", F.size("al").alias("n_positions"),
                    F.size(F.array_remove("al", rules.IGNORE_LABEL)).alias("n_labelled"),
                    TR.labels_text(F.col("al"), used).alias("aligned"))


@query("split_examples", sql=f"""SELECT query_id, site_key, l_orderkey, l_linenumber,
  CASE WHEN row_number() OVER (ORDER BY md5(text), query_id, site_key, l_orderkey, l_linenumber) - 1 < ceil(0.2 * count(*) OVER ())
       THEN 'validation' ELSE 'train' END AS split FROM ({EXAMPLES_SQL}) e""", fixtures=FXT)
def split_examples(spark, sf_dir):
    """T5: exact 80/20 train/validation split in hash order."""
    e = examples_df(spark, sf_dir).withColumn("_h", F.md5("text"))
    return TR.split_examples(e, ["_h", "query_id", "site_key", "l_orderkey", "l_linenumber"]).select("query_id", "site_key", "l_orderkey", "l_linenumber", "split")


@query("training_ready", sql=f"""SELECT count(*) AS n_examples, count(*) >= {rules.TRAIN_MIN_EXAMPLES} AS can_train,
  count(*) >= {rules.AUTO_TRAIN_MIN_EXAMPLES} AS auto_train FROM ({EXAMPLES_SQL}) e""", fixtures=FXT)
def training_ready(spark, sf_dir):
    """Size gates for training."""
    return TR.training_ready(examples_df(spark, sf_dir))


@query("training_stats", sql=f"""SELECT CASE WHEN grouping(source, query) = 1 THEN 'source'
    WHEN grouping(source, query) = 2 THEN 'query' ELSE 'total' END AS kind,
  coalesce(CASE WHEN grouping(source, query) = 1 THEN source WHEN grouping(source, query) = 2 THEN query END,
    CASE WHEN grouping(source, query) = 3 THEN '' ELSE 'unknown' END) AS key,
  count(*) AS n, min(timestamp) AS earliest, max(timestamp) AS latest
  FROM ({EXAMPLES_SQL}) e GROUP BY GROUPING SETS ((source), (query), ())""", fixtures=FXT)
def training_stats(spark, sf_dir):
    """Example counts per source, per query and in total, with the date range."""
    return TR.training_stats(examples_df(spark, sf_dir))


def _decode_sql() -> str:
    names = "CASE x " + " ".join(f"WHEN {v} THEN '{k}'" for k, v in rules.LABEL2ID.items()) + " ELSE 'O' END"
    src = (f"SELECT query_id, site_key, l_orderkey, l_linenumber, list_concat(['[CLS]'], tokens, ['[SEP]']) AS t2, "
           f"list_concat(['O'], list_transform(labels, lambda x: {names}), ['O']) AS l2 FROM ({BIO_SQL}) b")
    return decode_records_sql(src, ["query_id", "site_key", "l_orderkey", "l_linenumber"], "k")


def decode_records_sql(src: str, keys: list[str], kname: str) -> str:
    """T8 in SQL over ``src(keys..., t2 tokens, l2 label names)``: one row per decoded record."""
    fields = [t.lower() for t in TR.ENTITY_TYPES]
    rec_t = "STRUCT(" + ", ".join(f"{f} VARCHAR" for f in fields) + ")"
    empty = "struct_pack(" + ", ".join(f"{f} := NULL::VARCHAR" for f in fields) + ")"
    join = ("trim(list_reduce(acc.toks, lambda a, t: CASE WHEN starts_with(t, '##') THEN a || substr(t, 3) "
            "WHEN a = '' THEN t ELSE a || ' ' || t END, ''))")
    put = "struct_pack(" + ", ".join(f"{f} := CASE WHEN acc.ent = '{f}' THEN {join} ELSE acc.cur.{f} END" for f in fields) + ")"
    saved = f"(CASE WHEN acc.ent IS NOT NULL AND len(acc.toks) > 0 THEN {put} ELSE acc.cur END)"
    complete = f"({saved}.title IS NOT NULL OR {saved}.price IS NOT NULL)"
    had = "(acc.ent IS NOT NULL AND len(acc.toks) > 0)"
    special = "[" + ", ".join(f"'{t}'" for t in rules.SPECIAL_TOKENS) + "]"
    step = f"""CASE WHEN list_contains({special}, x.t) THEN acc
      WHEN starts_with(x.l, 'B-') THEN struct_pack(ent := lower(substr(x.l, 3)), toks := [x.t], cur := {saved}, out := acc.out)
      WHEN starts_with(x.l, 'I-') AND acc.ent IS NOT NULL THEN struct_pack(ent := acc.ent, toks := list_append(acc.toks, x.t),
        cur := acc.cur, out := acc.out)
      WHEN x.l = 'O' THEN struct_pack(ent := CASE WHEN {had} THEN NULL ELSE acc.ent END,
        toks := CASE WHEN {had} THEN []::VARCHAR[] ELSE acc.toks END,
        cur := CASE WHEN {complete} THEN {empty} ELSE {saved} END,
        out := CASE WHEN {complete} THEN list_append(acc.out, {saved}) ELSE acc.out END)
      ELSE acc END"""
    init = f"struct_pack(ent := NULL::VARCHAR, toks := []::VARCHAR[], cur := {empty}, out := []::{rec_t}[])"
    fin = f"CASE WHEN {complete} THEN list_append(acc.out, {saved}) ELSE acc.out END"
    pairs = ("list_transform(range(len(t2)), lambda k: struct_pack(t := t2[k + 1], l := l2[k + 1]))")
    ks = ", ".join(keys)
    return f"""SELECT {ks}, CAST(kk - 1 AS INTEGER) AS {kname}, r.title AS title, r.price AS price,
    r.url AS url, r.img AS img FROM (
  SELECT {ks}, unnest(outs) AS r, generate_subscripts(outs, 1) AS kk FROM (
    SELECT {ks}, (SELECT {fin} FROM (SELECT st AS acc)) AS outs FROM (
      SELECT *, list_reduce({pairs}, lambda acc, x: {step}, {init}) AS st FROM ({src}) a) c) d) e"""


@query("decode_bio", sql=_decode_sql(), fixtures=FXT)
def decode_bio(spark, sf_dir):
    """BIO predictions decoded back to records (here: the T2 labels framed by
    [CLS]/[SEP], so decoding must recover each example's title and price)."""
    b = bio_df(spark, sf_dir)
    toks = F.concat(F.array(F.lit("[CLS]")), F.col("tokens"), F.array(F.lit("[SEP]")))
    labs = F.concat(F.array(F.lit("O")), TR.id_labels_to_names(F.col("labels")), F.array(F.lit("O")))
    d = b.select("query_id", "site_key", "l_orderkey", "l_linenumber", F.posexplode(TR.decode_bio(toks, labs)).alias("k", "rec"))
    return d.select("query_id", "site_key", "l_orderkey", "l_linenumber", "k", F.col("rec")["title"].alias("title"),
                    F.col("rec")["price"].alias("price"), F.col("rec")["url"].alias("url"),
                    F.col("rec")["img"].alias("img"))


@query("join_pieces", sql=f"""SELECT query_id, site_key, l_orderkey, l_linenumber,
  array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: length(w) > 0), ' ') AS text
  FROM ({EXAMPLES_SQL}) e""", fixtures=FXT)
def join_pieces(spark, sf_dir):
    """Words split into 4-character pieces ('##' continuations) and joined back."""
    e = examples_df(spark, sf_dir)
    words = F.filter(F.split("text", r"(?U)\s+"), lambda w: F.length(w) > 0)
    pieces = F.flatten(F.transform(words, lambda w: F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.length(w) / 4) - 1, F.lit(0)).cast("int")),
        lambda k: F.when(k == 0, F.substring(w, 1, 4)).otherwise(F.concat(F.lit("##"), F.substring(w, k * 4 + 1, 4))))))
    return e.select("query_id", "site_key", "l_orderkey", "l_linenumber", TR.join_pieces(pieces).alias("text"))


def _rule_predictions(tokens):
    """Stand-in for a token-classification model's output over page windows:
    price-like tokens -> PRICE, links -> URL, runs of capitalised words -> TITLE."""
    def lab(t, k):
        cap = t.rlike(r"^[A-Z][a-z]+$")
        prev_cap = (k > 0) & F.coalesce(F.get(tokens, k - 1).rlike(r"^[A-Z][a-z]+$"), F.lit(False))
        return (F.when(t.rlike(r"^(?:[\$₵€£]|GH₵|USD)?\d[\d,]*(?:\.\d\d)?$"), F.lit("B-PRICE"))
                .when(t.startswith("http"), F.lit("B-URL"))
                .when(cap & prev_cap, F.lit("I-TITLE")).when(cap, F.lit("B-TITLE")).otherwise(F.lit("O")))
    return F.transform(tokens, lab)


def _decode_pages_sql() -> str:
    from .text_queries import clean_html_sql, windows_sql
    win = windows_sql(f"SELECT page_id, {clean_html_sql('html')} AS text FROM listing_pages", key="page_id")
    toks = "list_filter(string_split(chunk, ' '), lambda x: length(x) > 0)"
    cap = "regexp_matches(t, '^[A-Z][a-z]+$')"
    lab = (f"list_transform(tk, lambda t, i: CASE WHEN regexp_matches(t, '^(?:[$₵€£]|GH₵|USD)?[0-9][0-9,]*(?:[.][0-9][0-9])?$') "
           f"THEN 'B-PRICE' WHEN starts_with(t, 'http') THEN 'B-URL' "
           f"WHEN {cap} AND i > 1 AND coalesce(regexp_matches(tk[i - 1], '^[A-Z][a-z]+$'), FALSE) THEN 'I-TITLE' "
           f"WHEN {cap} THEN 'B-TITLE' ELSE 'O' END)")
    src = f"SELECT page_id, chunk_no AS win, tk AS t2, {lab} AS l2 FROM (SELECT *, {toks} AS tk FROM ({win}) w) x"
    recs = decode_records_sql(src, ["page_id", "win"], "k")
    t = "lower(regexp_replace(coalesce(title, ''), '^\\s+|\\s+$', '', 'g'))"
    pz = "lower(regexp_replace(coalesce(price, ''), '^\\s+|\\s+$', '', 'g'))"
    return f"""SELECT page_id, signature, win, k, title, price FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, signature ORDER BY win, k) AS rn FROM (
    SELECT *, {t} || '|' || {pz} AS signature FROM ({recs}) r WHERE {t} <> '' OR {pz} <> '') s) d WHERE rn = 1"""


@query("decode_pages", sql=_decode_pages_sql(), fixtures=["listing_pages"])
def decode_pages(spark, sf_dir):
    """Pages -> cleaned html -> fixed windows -> token labels -> records ->
    signature de-duplication per page."""
    p = fx.listing_pages(spark, sf_dir).select("page_id", TX.clean_html(F.col("html")).alias("clean"))
    w = p.select("page_id", F.posexplode(TX.window_chunks(F.col("clean"))).alias("win", "chunk"))
    t = w.withColumn("tokens", F.filter(F.split("chunk", " "), lambda x: F.length(x) > 0))
    t = t.withColumn("labels", _rule_predictions(F.col("tokens")))
    recs = t.select("page_id", "win", F.posexplode(TR.decode_bio(F.col("tokens"), F.col("labels"))).alias("k", "rec"))
    recs = recs.select("page_id", "win", "k", F.col("rec")["title"].alias("title"), F.col("rec")["price"].alias("price"))
    return RK.dedupe_signature(recs, key=["page_id"], order=["win", "k"])


STORED_SQL = f"""SELECT text, query, source, timestamp, CAST(json_object('price', CAST(price AS VARCHAR), 'title', title, 'url', url)
  AS VARCHAR) AS product_data FROM ({EXAMPLES_SQL}) e"""


def _stored(spark, sf_dir):
    data = F.create_map(F.lit("title"), F.col("title"), F.lit("price"), number_text(F.col("price")), F.lit("url"), F.col("url"))
    return examples_df(spark, sf_dir, "title", "price", "url").select("text", "query", "source", "timestamp", data.alias("product_data"))


def _loaded(df):
    return df.withColumn("product_data", F.to_json("product_data"))


@query("training_roundtrip", sql=STORED_SQL, fixtures=FXT)
def training_roundtrip(spark, sf_dir):
    """S4 + S3: examples with their product data written as JSON Lines (partitioned by source)
    into the shared checkpoint folder, then loaded back (objects come back in key order)."""
    path = scratch_path(spark, "training")
    TR.write_training_set(_stored(spark, sf_dir), path)
    return _loaded(TR.read_training_set(spark, path))


@query("training_load", sql=STORED_SQL, fixtures=FXT)
def training_load(spark, sf_dir):
    """S3 (document layout): examples stored as ``{"training_data": [...], "metadata": ...}``
    documents, as many as their bytes ask for and compressed (most of an example repeats others), loaded
    back by ranges, a document each; the first place looked at has none, so the fallback is read."""
    path = scratch_path(spark, "training-docs")
    TR.write_training_documents(_stored(spark, sf_dir), path, compression="gzip")
    return _loaded(TR.read_training_set(spark, f"{path}-none", layout="document", fallback=path))
