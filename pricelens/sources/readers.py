"""Scans: pages, seed products, training sets, images, analysis responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules
from .tables import load


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured pages (page_id, url, html); pages without a body are dropped at the scan."""
    return load(spark, sf_dir, "pages").filter(F.length("html") > 0)


SEED_PRODUCT_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("price", T.DoubleType()),
    T.StructField("category", T.StringType()), T.StructField("image_url", T.StringType()),
    T.StructField("product_url", T.StringType()),
])


def read_seed_products(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Seed products (explicit schema, no inference).

    ``multiline=True``: each file is one (pretty-printed) JSON array, the seed
    file layout. ``multiline=False``: JSON Lines where a line may itself be an
    array of products -- splittable, each element becomes a row.
    """
    return spark.read.schema(SEED_PRODUCT_SCHEMA).option("multiLine", multiline).json(path)


def intake_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files: allowed extension, at most 20 MiB, a known image header; base64 body.

    The size test runs on the ``length`` column before the content is touched.
    """
    df = spark.read.format("binaryFile").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    magic = F.hex(F.substring("content", 1, 4))
    ok_magic = F.lit(False)
    for m in rules.IMAGE_MAGIC_PREFIXES:
        ok_magic = ok_magic | magic.startswith(m)
    return (df.filter(ext.isin(*rules.IMAGE_EXTENSIONS) & (F.col("length") <= rules.IMAGE_MAX_BYTES))
            .withColumn("valid_header", ok_magic)
            .select("path", "length", ext.alias("extension"), "valid_header",
                    F.when(ok_magic, F.base64("content")).alias("base64")))
