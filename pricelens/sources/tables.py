"""Reading the input tables.

Each reader returns a lazily-planned parquet scan; callers select the columns they
need, so the scan's ReadSchema is pruned and filters are pushed into it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """A scan that has fewer pieces than the session has cores, dealt over the cores; a larger
    one as it is. (A table in one row group is read by one task, which would also do all the
    work up to the next shuffle.)"""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table as a parquet scan."""
    return spark.read.parquet(table_path(sf_dir, name))
