"""Image-analysis queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import vision as V
from ..sources import fixtures as fx
from .registry import query

_S = "regexp_replace(response, '^\\s+|\\s+$', '', 'g')"
_OK = f"(CASE WHEN coalesce({_S}, '') <> '' AND json_valid({_S}) THEN json_type({_S}) = 'OBJECT' ELSE FALSE END)"
_NAME = f"regexp_replace(coalesce(json_extract_string(response, '$.product_name'), 'Unknown Product'), '^\\s+|\\s+$', '', 'g')"
_CONF = (f"least(greatest(coalesce(CAST(json_extract(response, '$.confidence') AS DOUBLE), "
         f"{rules.ANALYSIS_DEFAULT_CONFIDENCE}), 0.0), 1.0)")
NORM_SQL = f"""SELECT image_id, ok AS success,
  CASE WHEN NOT ok THEN 'Analysis Failed' WHEN nm = '' OR nm = 'Unknown Product' THEN 'Unidentified Product' ELSE nm END
    AS product_name,
  CASE WHEN ok THEN regexp_replace(coalesce(json_extract_string(response, '$.category'), 'Unknown'), '^\\s+|\\s+$', '', 'g')
       ELSE 'Error' END AS category,
  CASE WHEN ok THEN nullif(regexp_replace(json_extract_string(response, '$.brand'), '^\\s+|\\s+$', '', 'g'), '') END AS brand,
  CASE WHEN ok THEN coalesce(CAST(json_extract(response, '$.features') AS VARCHAR[]), [])
       ELSE []::VARCHAR[] END AS features,
  CASE WHEN ok THEN coalesce(CAST(json_extract(response, '$.search_terms') AS VARCHAR[]), [])
       ELSE []::VARCHAR[] END AS search_terms,
  CASE WHEN NOT ok THEN 0.0 WHEN nm = '' OR nm = 'Unknown Product' THEN {rules.ANALYSIS_UNIDENTIFIED_CONFIDENCE}
       ELSE {_CONF} END AS confidence,
  CASE WHEN ok THEN NULL WHEN coalesce({_S}, '') <> '' THEN 'invalid response' ELSE 'empty response' END AS error
FROM (SELECT image_id, response, {_OK} AS ok, CASE WHEN {_OK} THEN {_NAME} END AS nm FROM analyses) a"""


def norm_df(spark, sf_dir):
    return V.normalize_analysis(fx.analyses(spark, sf_dir))


@query("analysis_parse", sql=f"""SELECT image_id, {_OK} AS parsed,
  CASE WHEN {_OK} THEN json_extract_string(response, '$.product_name') END AS product_name_raw FROM analyses""",
       fixtures=["analyses"])
def analysis_parse(spark, sf_dir):
    """Stored responses parsed; empty or malformed text gives NULL, not an error."""
    a = fx.analyses(spark, sf_dir)
    v = V.parse_analysis(F.col("response"))
    return a.select("image_id", v.isNotNull().alias("parsed"),
                    F.try_variant_get(v, "$.product_name", "string").alias("product_name_raw"))


@query("normalize_analysis", sql=f"""SELECT image_id, success, product_name, category, brand,
  array_to_string(features, '|') AS features, array_to_string(search_terms, '|') AS search_terms, confidence, error
  FROM ({NORM_SQL}) n""", fixtures=["analyses"])
def normalize_analysis(spark, sf_dir):
    """V1: normalised analyses (features and terms shown '|'-joined)."""
    n = norm_df(spark, sf_dir)
    return n.select("image_id", "success", "product_name", "category", "brand",
                    F.array_join("features", "|").alias("features"),
                    F.array_join("search_terms", "|").alias("search_terms"), "confidence", "error")


def _q_sql() -> str:
    named = "(product_name IS NOT NULL AND product_name <> '' AND product_name NOT IN ('Unknown Product', 'Unidentified Product'))"
    parts = (f"list_concat(CASE WHEN coalesce(brand, '') <> '' THEN [brand] ELSE []::VARCHAR[] END, "
             f"CASE WHEN {named} THEN [product_name] ELSE []::VARCHAR[] END)")
    parts = f"CASE WHEN len({parts}) < 2 AND len(search_terms) > 0 THEN list_concat({parts}, search_terms[1:2]) ELSE {parts} END"
    q = f"regexp_replace(array_to_string({parts}, ' '), '^\\s+|\\s+$', '', 'g')"
    q = f"CASE WHEN {q} = '' AND coalesce(category, '') <> '' THEN category ELSE {q} END"
    qa = f"CASE WHEN NOT success THEN 'product' WHEN {q} = '' THEN 'product' ELSE {q} END"
    partsb = (f"list_concat(CASE WHEN coalesce(brand, '') <> '' THEN [brand] ELSE []::VARCHAR[] END, "
              f"CASE WHEN coalesce(product_name, '') <> '' THEN [product_name] ELSE []::VARCHAR[] END)")
    prim = f"array_to_string({partsb}, ' ')"
    words = f"len(list_filter(string_split_regex({prim}, '\\s+'), lambda w: length(w) > 0))"
    prim = f"CASE WHEN {words} < 2 AND len(search_terms) > 0 THEN array_to_string(search_terms[1:2], ' ') ELSE {prim} END"
    qb = f"regexp_replace({prim}, '^\\s+|\\s+$', '', 'g')"
    qb = f"CASE WHEN error IS NOT NULL THEN 'product' WHEN {qb} = '' THEN 'product' ELSE {qb} END"
    return f"SELECT image_id, {qa} AS query_a, {qb} AS query_b FROM ({NORM_SQL}) n"


@query("analysis_query", sql=_q_sql(), fixtures=["analyses"])
def analysis_query(spark, sf_dir):
    """V2: search text from an analysis, under both rule sets."""
    n = norm_df(spark, sf_dir)
    return n.select("image_id",
                    V.analysis_query(F.col("success"), F.col("brand"), F.col("product_name"), F.col("category"),
                                     F.col("search_terms")).alias("query_a"),
                    V.analysis_query_b(F.col("error"), F.col("brand"), F.col("product_name"),
                                       F.col("search_terms")).alias("query_b"))


_ALT = (f"list_reduce(search_terms, lambda acc, t: CASE WHEN NOT list_contains(acc, t) AND len(acc) < {rules.ALTERNATIVE_QUERIES} "
        f"THEN list_append(acc, t) ELSE acc END, list_concat("
        f"CASE WHEN coalesce(category, '') <> '' AND coalesce(product_name, '') <> '' THEN [category || ' ' || product_name] ELSE []::VARCHAR[] END, "
        f"CASE WHEN coalesce(product_name, '') <> '' THEN list_transform(features[1:2], lambda f: product_name || ' ' || f) ELSE []::VARCHAR[] END))")


@query("alternative_queries", sql=f"""SELECT image_id, CAST(i - 1 AS INTEGER) AS pos, alt FROM (
  SELECT image_id, unnest(L) AS alt, generate_subscripts(L, 1) AS i FROM (
    SELECT image_id, CASE WHEN success THEN ({_ALT})[1:{rules.ALTERNATIVE_QUERIES}] ELSE []::VARCHAR[] END AS L
    FROM ({NORM_SQL}) n) a) b""", fixtures=["analyses"])
def alternative_queries(spark, sf_dir):
    """V3: up to three alternative searches per analysis."""
    n = norm_df(spark, sf_dir)
    alts = V.alternative_queries(F.col("success"), F.col("product_name"), F.col("category"),
                                 F.col("features"), F.col("search_terms"))
    return n.select("image_id", F.posexplode(alts).alias("pos", "alt"))


LENIENT_SQL = f"""SELECT image_id, ok AS success,
  CASE WHEN NOT ok THEN 'Image Analysis Failed' WHEN nm = '' THEN 'Unknown Product' ELSE nm END AS product_name,
  CASE WHEN ok THEN regexp_replace(coalesce(json_extract_string(response, '$.category'), ''), '^\\s+|\\s+$', '', 'g')
       ELSE 'Unknown' END AS category,
  CASE WHEN ok AND json_extract_string(response, '$.brand') <> ''
       THEN regexp_replace(json_extract_string(response, '$.brand'), '^\\s+|\\s+$', '', 'g') END AS brand,
  CASE WHEN ok THEN coalesce(CAST(json_extract(response, '$.features') AS VARCHAR[]), []) ELSE []::VARCHAR[] END AS features,
  CASE WHEN ok THEN coalesce(CAST(json_extract(response, '$.search_terms') AS VARCHAR[]), []) ELSE []::VARCHAR[] END AS search_terms,
  CASE WHEN NOT ok THEN 0.0 WHEN nm = '' THEN {rules.ANALYSIS_UNIDENTIFIED_CONFIDENCE} ELSE {_CONF} END AS confidence,
  CASE WHEN ok THEN NULL WHEN coalesce({_S}, '') <> '' THEN 'invalid response' ELSE 'empty response' END AS error
FROM (SELECT image_id, response, {_OK} AS ok, CASE WHEN {_OK} THEN
        regexp_replace(coalesce(json_extract_string(response, '$.product_name'), ''), '^\\s+|\\s+$', '', 'g') END AS nm FROM analyses) a"""


@query("normalize_analysis_lenient", sql=f"""SELECT image_id, success, product_name, category, brand,
  array_to_string(features, '|') AS features, array_to_string(search_terms, '|') AS search_terms, confidence, error
  FROM ({LENIENT_SQL}) n""", fixtures=["analyses"])
def normalize_analysis_lenient(spark, sf_dir):
    """V1: the lenient variant with its own defaults and failure row."""
    return V.normalize_analysis_lenient(fx.analyses(spark, sf_dir)).select(
        "image_id", "success", "product_name", "category", "brand", F.array_join("features", "|").alias("features"),
        F.array_join("search_terms", "|").alias("search_terms"), "confidence", "error")


_ALT_B = (f"list_reduce(search_terms[1:{rules.ALTERNATIVE_QUERIES}], lambda acc, t: CASE WHEN list_contains(acc, t) THEN acc "
          f"ELSE list_append(acc, t) END, list_concat("
          f"CASE WHEN coalesce(category, '') <> '' AND coalesce(product_name, '') <> '' THEN [category || ' ' || product_name] ELSE []::VARCHAR[] END, "
          f"CASE WHEN coalesce(product_name, '') <> '' THEN list_transform(features[1:2], lambda f: product_name || ' ' || f) ELSE []::VARCHAR[] END))")


@query("alternative_queries_b", sql=f"""SELECT image_id, CAST(i - 1 AS INTEGER) AS pos, alt FROM (
  SELECT image_id, unnest(L) AS alt, generate_subscripts(L, 1) AS i FROM (
    SELECT image_id, CASE WHEN error IS NULL THEN ({_ALT_B})[1:{rules.ALTERNATIVE_QUERIES}] ELSE []::VARCHAR[] END AS L
    FROM ({LENIENT_SQL}) n) a) b""", fixtures=["analyses"])
def alternative_queries_b(spark, sf_dir):
    """V3: alternative searches by rule set B, over the lenient analyses."""
    n = V.normalize_analysis_lenient(fx.analyses(spark, sf_dir))
    alts = V.alternative_queries_b(F.col("error"), F.col("product_name"), F.col("category"), F.col("features"), F.col("search_terms"))
    return n.select("image_id", F.posexplode(alts).alias("pos", "alt"))


@query("confidence_band", sql=f"""SELECT image_id, CAST(floor(confidence * 100 + 0.5) AS INTEGER) AS percent,
  CASE WHEN floor(confidence * 100 + 0.5) >= {rules.CONFIDENCE_HIGH} THEN 'high'
       WHEN floor(confidence * 100 + 0.5) >= {rules.CONFIDENCE_MEDIUM} THEN 'medium' ELSE 'low' END AS band
  FROM ({NORM_SQL}) n""", fixtures=["analyses"])
def confidence_band(spark, sf_dir):
    """V4: confidence shown as a rounded percent and a band."""
    b = V.confidence_band(F.col("confidence"))
    return norm_df(spark, sf_dir).select("image_id", b["percent"].alias("percent"), b["band"].alias("band"))


@query("attach_analysis", sql=f"""SELECT image_id, product_name AS detected_product,
  CAST(len(CASE WHEN array_to_string(features, ',') <> '' THEN string_split(array_to_string(features, ','), ',')
           ELSE []::VARCHAR[] END) AS INTEGER) AS n_features FROM ({NORM_SQL}) n""", fixtures=["analyses"])
def attach_analysis(spark, sf_dir):
    """V5: analyses carried on search requests (features travel as one comma-separated field)."""
    n = norm_df(spark, sf_dir).select("image_id", F.col("product_name").alias("detected_product"),
                                      F.array_join("features", ",").alias("detected_features"))
    return V.attach_analysis(n).select("image_id", "detected_product", F.size("features").alias("n_features"))
