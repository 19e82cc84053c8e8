"""Image-analysis tables (S7, V1-V5): stored analysis responses -> normalised
analyses -> search text. The analysis service itself is not called; its
responses are an input table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.regex import let, pystrip

_UNNAMED = ["Unknown Product", "Unidentified Product"]


def _nonempty(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def parse_analysis(response: Column) -> Column:
    """JSON text -> VARIANT, NULL when empty, malformed or no object (no exception)."""
    v = F.try_parse_json(F.nullif(pystrip(response), F.lit("")))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def normalize_analysis(df: DataFrame, response: str = "response") -> DataFrame:
    """V1: trimmed names, brand '' -> NULL (NULL allowed), all features and
    search terms, confidence default 0.8 clamped to [0, 1]; no usable name ->
    'Unidentified Product' at 0.3; unreadable responses -> a failure row."""
    def build(v: Column) -> Column:
        def get(path, typ):
            return F.try_variant_get(v, path, typ)

        ok = v.isNotNull()
        name = pystrip(F.coalesce(get("$.product_name", "string"), F.lit("Unknown Product")))
        unnamed = (name == "") | (name == "Unknown Product")
        conf = F.least(F.greatest(F.coalesce(get("$.confidence", "double"),
                                             F.lit(rules.ANALYSIS_DEFAULT_CONFIDENCE)), F.lit(0.0)), F.lit(1.0))
        empty = F.array().cast("array<string>")
        return F.struct(
            ok.alias("success"),
            F.when(ok, F.when(unnamed, F.lit("Unidentified Product")).otherwise(name))
             .otherwise(F.lit("Analysis Failed")).alias("product_name"),
            F.when(ok, pystrip(F.coalesce(get("$.category", "string"), F.lit("Unknown"))))
             .otherwise(F.lit("Error")).alias("category"),
            F.when(ok, F.nullif(pystrip(get("$.brand", "string")), F.lit(""))).alias("brand"),
            F.when(ok, F.coalesce(get("$.features", "array<string>"), empty))
             .otherwise(empty).alias("features"),
            F.when(ok, F.coalesce(get("$.search_terms", "array<string>"), empty))
             .otherwise(empty).alias("search_terms"),
            F.when(ok, F.when(unnamed, F.lit(rules.ANALYSIS_UNIDENTIFIED_CONFIDENCE)).otherwise(conf))
             .otherwise(F.lit(0.0)).alias("confidence"),
            F.when(~ok, F.when(_nonempty(pystrip(F.col(response))), F.lit("invalid response"))
                   .otherwise(F.lit("empty response"))).alias("error"))

    # the response is parsed once per row (bound), then every field reads the parsed value
    return df.select("*", let(parse_analysis(F.col(response)), build).alias("_a")).select(
        *[F.col(c) for c in df.columns], "_a.*")


def normalize_analysis_lenient(df: DataFrame, response: str = "response") -> DataFrame:
    """V1, lenient variant: fields trimmed, missing ones empty, brand NULL only when missing or
    empty; no name -> 'Unknown Product' at 0.3; unreadable responses -> its own failure row."""
    def build(v: Column) -> Column:
        def get(path, typ):
            return F.try_variant_get(v, path, typ)

        ok = v.isNotNull()
        name = pystrip(F.coalesce(get("$.product_name", "string"), F.lit("")))
        brand = get("$.brand", "string")
        conf = F.least(F.greatest(F.coalesce(get("$.confidence", "double"),
                                             F.lit(rules.ANALYSIS_DEFAULT_CONFIDENCE)), F.lit(0.0)), F.lit(1.0))
        empty = F.array().cast("array<string>")
        return F.struct(
            ok.alias("success"),
            F.when(ok, F.when(name == "", F.lit("Unknown Product")).otherwise(name))
             .otherwise(F.lit("Image Analysis Failed")).alias("product_name"),
            F.when(ok, pystrip(F.coalesce(get("$.category", "string"), F.lit("")))).otherwise(F.lit("Unknown")).alias("category"),
            F.when(ok & (brand != ""), pystrip(brand)).alias("brand"),
            F.coalesce(get("$.features", "array<string>"), empty).alias("features"),
            F.coalesce(get("$.search_terms", "array<string>"), empty).alias("search_terms"),
            F.when(ok, F.when(name == "", F.lit(rules.ANALYSIS_UNIDENTIFIED_CONFIDENCE)).otherwise(conf))
             .otherwise(F.lit(0.0)).alias("confidence"),
            F.when(~ok, F.when(_nonempty(pystrip(F.col(response))), F.lit("invalid response"))
                   .otherwise(F.lit("empty response"))).alias("error"))
    return df.select("*", let(parse_analysis(F.col(response)), build).alias("_a")).select(
        *[F.col(c) for c in df.columns], "_a.*")


def analysis_query(success: Column, brand: Column, name: Column, category: Column, terms: Column) -> Column:
    """V2 (rule set A): brand + product name; too few parts -> add the first two
    search terms; else the category; else 'product'."""
    empty = F.array().cast("array<string>")
    named = _nonempty(name) & ~name.isin(*_UNNAMED)
    parts = F.concat(F.when(_nonempty(brand), F.array(brand)).otherwise(empty),
                     F.when(named, F.array(name)).otherwise(empty))
    parts = F.when((F.size(parts) < 2) & (F.size(terms) > 0), F.concat(parts, F.slice(terms, 1, 2))).otherwise(parts)
    q = pystrip(F.array_join(parts, " "))
    q = F.when((q == "") & _nonempty(category), category).otherwise(q)
    return F.when(~success, F.lit("product")).when(q == "", F.lit("product")).otherwise(q)


def analysis_query_b(error: Column, brand: Column, name: Column, terms: Column) -> Column:
    """V2 (rule set B): brand + name; fewer than two words -> the first two search terms."""
    empty = F.array().cast("array<string>")
    parts = F.concat(F.when(_nonempty(brand), F.array(brand)).otherwise(empty),
                     F.when(_nonempty(name), F.array(name)).otherwise(empty))
    primary = F.array_join(parts, " ")
    words = F.size(F.filter(F.split(primary, r"(?U)\s+"), lambda w: F.length(w) > 0))
    primary = F.when((words < 2) & (F.size(terms) > 0), F.array_join(F.slice(terms, 1, 2), " ")).otherwise(primary)
    q = pystrip(primary)
    return F.when(error.isNotNull(), F.lit("product")).when(q == "", F.lit("product")).otherwise(q)


def alternative_queries(success: Column, name: Column, category: Column, features: Column, terms: Column,
                        n: int = rules.ALTERNATIVE_QUERIES) -> Column:
    """V3: category + name, name + each of the first two features, then search terms
    not already listed while fewer than ``n``; at most ``n``."""
    empty = F.array().cast("array<string>")
    base = F.concat(
        F.when(_nonempty(category) & _nonempty(name), F.array(F.concat_ws(" ", category, name))).otherwise(empty),
        F.when(_nonempty(name), F.transform(F.slice(features, 1, 2), lambda f: F.concat_ws(" ", name, f)))
         .otherwise(empty))
    alts = F.aggregate(terms, base, lambda acc, t: F.when(~F.array_contains(acc, t) & (F.size(acc) < n),
                                                           F.concat(acc, F.array(t))).otherwise(acc))
    return F.when(success, F.slice(alts, 1, n)).otherwise(empty)


def alternative_queries_b(error: Column, name: Column, category: Column, features: Column, terms: Column,
                          n: int = rules.ALTERNATIVE_QUERIES) -> Column:
    """V3 (rule set B): category + name, name + each of the first two features, then those of
    the first ``n`` search terms that are not listed yet; the first ``n`` of all."""
    empty = F.array().cast("array<string>")
    base = F.concat(
        F.when(_nonempty(category) & _nonempty(name), F.array(F.concat_ws(" ", category, name))).otherwise(empty),
        F.when(_nonempty(name), F.transform(F.slice(features, 1, 2), lambda f: F.concat_ws(" ", name, f)))
         .otherwise(empty))
    alts = F.aggregate(F.slice(terms, 1, n), base, lambda acc, t: F.when(F.array_contains(acc, t), acc)
                       .otherwise(F.concat(acc, F.array(t))))
    return F.when(error.isNotNull(), empty).otherwise(F.slice(alts, 1, n))


def confidence_band(conf: Column) -> Column:
    """V4: struct(percent, band) -- percent rounded half up; >= 80 high, >= 60 medium, else low."""
    pct = F.floor(conf * 100 + 0.5).cast("int")
    band = F.when(pct >= rules.CONFIDENCE_HIGH, F.lit("high")).when(pct >= rules.CONFIDENCE_MEDIUM, F.lit("medium")) \
        .otherwise(F.lit("low"))
    return F.struct(pct.alias("percent"), band.alias("band"))


def attach_analysis(df: DataFrame, features_text: str = "detected_features") -> DataFrame:
    """V5: a search request carrying an analysis; the feature list arrives as a
    comma-separated parameter (empty -> no features)."""
    f = F.col(features_text)
    return df.withColumn("features", F.when(_nonempty(f), F.split(f, ",")).otherwise(F.array().cast("array<string>")))
