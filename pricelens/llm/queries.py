"""One query per operator, over the whole of its table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..sources.tables import load
from . import (byte_bpe, collocations, decontaminate, exact_dedup, hard_negatives, licenses, near_dedup, quality, secrets, substring_dedup, token_counts,
               toxicity, warc)
from .registry import query

_SPACE = r"[\x20\x09-\x0D]+"


@query("op1_secret_scan")
def secret_scan(spark, sf_dir):
    """Secrets of every document: known shapes and windows of high entropy."""
    return secrets.find_secrets(load(spark, sf_dir, "documents"))


@query("op2_quality_classifier")
def quality_score(spark, sf_dir):
    """Quality score of every document, learned from weak labels alone."""
    return quality.scores(spark, load(spark, sf_dir, "documents"))


@query("op3_toxicity")
def toxic_score(spark, sf_dir):
    """Toxicity score of every document, learned from four fifths of the labels."""
    return toxicity.scores(spark, load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query("op4_byte_bpe")
def byte_bpe_round_trip(spark, sf_dir):
    """Token ids of every document and the bytes that they decode to."""
    return byte_bpe.round_trip(spark, load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                               public_tokenizers.PATTERN)


_OP5_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n.!?,;:]+[\n.!?,;:]*') AS us FROM documents),
p AS (SELECT doc_id, length(text) - list_sum(list_transform(us, lambda x: length(x))) AS skipped, unnest(us) AS u, unnest(range(len(us))) AS i FROM t WHERE len(us) > 0),
n AS (SELECT *, trim(regexp_replace(translate(regexp_replace(u, '[\n.!?,;:]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm,
             skipped + coalesce(sum(length(u)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p),
k AS (SELECT doc_id, norm, start::BIGINT AS start, (start + length(u))::BIGINT AS stop, length(norm) - length(replace(norm, ' ', '')) + 1 AS n_words,
             row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM n WHERE norm <> ''),
g AS (SELECT norm, count(*) AS copies, min(struct_pack(d := doc_id, s := start)) AS keep FROM k GROUP BY norm HAVING count(DISTINCT doc_id) > 1),
r AS (SELECT k.*, copies, keep, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM k JOIN g USING (norm)),
w AS (SELECT *, sum(n_words) OVER (PARTITION BY doc_id, run) AS run_words FROM r)
SELECT doc_id, start, stop AS "end", n_words::INTEGER AS n_words, run_words::BIGINT AS run_words, keep.d AS keep_doc_id, keep.s AS keep_start, copies,
       doc_id = keep.d AND start = keep.s AS kept FROM w WHERE run_words >= 30
"""


@query("op5_substring_dedup", _OP5_SQL)
def substring_dedup_passages(spark, sf_dir):
    """Every clause of a passage of 30 or more words that repeats across documents, with its offsets; all but the first occurrence go."""
    return substring_dedup.repeats(spark, load(spark, sf_dir, "documents"), "clause", 1, substring_dedup.MIN_RUN_WORDS, across=True)


@query("op6_simhash_near_dedup")
def simhash_near_dedup(spark, sf_dir):
    """Component of every document: 4-word shingles, at most 4 differing bits."""
    return near_dedup.near_groups(spark, load(spark, sf_dir, "documents"))


_OP7_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, s, size, array_to_string(w[s:s + size - 1], ' ') AS win
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT DISTINCT doc_id, s, dw.size, item_id FROM dw JOIN bw USING (size, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hit) GROUP BY 1),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN own USING (doc_id)
"""


@query("op7_benchmark_decontamination", _OP7_SQL)
def benchmark_decontamination(spark, sf_dir):
    """Words of every document inside a 10-word window of a benchmark item."""
    return decontaminate.contamination(spark, load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def _licenses_sql() -> str:
    def lit(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"
    same = ", ".join(f"{lit(a)}: {lit(b)}" for a, b in licenses.SPELLINGS.items())
    known = ", ".join(f"({lit(i)}, {lit(t)})" for i, t in licenses.KNOWN)

    def canon(text: str) -> str:
        plain = rf"trim(regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
        word = f"coalesce(MAP {{{same}}}[w], w)"
        return (rf"list_transform(string_split_regex({text}, '\r\n|\r|\n'), lambda x: "
                f"array_to_string(list_transform(string_split({plain}, ' '), lambda w: {word}), ' '))")
    whole = (r"array_to_string(list_filter(lines, lambda x: x <> '' AND NOT regexp_matches(x, "
             rf"{lit(licenses._COPYRIGHT)})), ' ')")
    return f"""
WITH k AS (SELECT license_id, {canon('t')} AS lines FROM (VALUES {known}) v(license_id, t)),
known AS (SELECT license_id, 'text' AS scope, {whole} AS c FROM k UNION SELECT license_id, 'line', array_to_string(lines, ' ') FROM k),
d AS (SELECT doc_id, {canon('text')} AS lines FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, 'text' AS scope, NULL::INTEGER AS line, {whole} AS c FROM d
      UNION ALL SELECT doc_id, 'line', unnest(range(len(lines)))::INTEGER, unnest(lines) FROM d)
SELECT doc_id, license_id, scope, line FROM u JOIN known USING (scope, c) WHERE c <> ''
"""


@query("op8_license_scan", _licenses_sql())
def license_scan(spark, sf_dir):
    """Documents and lines that are known licence texts or notices."""
    return licenses.find_licenses(spark, load(spark, sf_dir, "documents"))


@query("op9_exact_dedup", rf"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
""")
def exact(spark, sf_dir):
    """The kept document of every group of texts equal up to white space."""
    return exact_dedup.decisions(spark, load(spark, sf_dir, "documents"))


@query("op10_token_counts")
def count_tokens(spark, sf_dir):
    """Number of tokens of every document, and whether it is over 1024."""
    return token_counts.token_counts(spark, load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


_OP11_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM t),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS f FROM (
        SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') AS phrase FROM (
          SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) ks WHERE len(w) >= k))
      GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT c.lang, c.phrase, c.a, j.cut, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f::HUGEINT + r.f) AS score
        FROM c JOIN (SELECT unnest([1, 2, 3]) AS cut) j ON j.cut < c.k
        JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j.cut], ' ')
        JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j.cut + 1:], ' ')),
low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS rn FROM cut) WHERE rn = 1),
part AS (SELECT lang, array_to_string(w[s:s + size - 1], ' ') AS phrase, max(a) AS longer FROM (
           SELECT lang, w, a, size, unnest(range(1, k - size + 2)) AS s FROM c JOIN (SELECT unnest([2, 3]) AS size) z ON size < k) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN part USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM best JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op11_phrase_collocations", _OP11_SQL)
def phrase_collocations(spark, sf_dir):
    """The best phrases of 2 to 4 words of each language."""
    return collocations.collocations(spark, load(spark, sf_dir, "documents"))


_OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
       row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


@query("op12_hard_negatives", _OP12_SQL)
def mine_hard_negatives(spark, sf_dir):
    """Ten hard negatives for each of an anchor's five best positives; anchors are the rows whose id 100 divides."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(spark, load(spark, sf_dir, "embeddings"), label, "vec_id % 100 = 0")


@query("op13_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
f AS (SELECT *, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f
""")
def warc_round_trip(spark, sf_dir):
    """Every page written to WARC archives and read back with all checks."""
    index = warc.write_archives(spark, load(spark, sf_dir, "pages"))
    return warc.page_records(warc.read_archives(spark, index, with_payload=False))
