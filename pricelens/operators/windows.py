"""Window helpers that stay parallel when one key is very large."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: read as often as needed, lineage ends here."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def coarse(x: Column) -> Column:
    """An order-preserving bucket number of a number: 256 buckets for each power of two, NULL
    for NULL. (Where the logarithm rounds to a neighbouring power, the second term makes up for it.)"""
    def up(v: Column) -> Column:
        v = F.least(v, F.lit(1e300))  # infinity and NaN too
        e = F.floor(F.log2(v))
        return (e + 1100) * 256 + F.floor((v / F.pow(F.lit(2.0), e) - 1) * 256)
    d = x.cast("double")
    return F.when(d > 0, up(d)).when(d < 0, -up(-d)).when(d.isNotNull(), F.lit(0)).cast("long")


def skew_safe_row_number(df: DataFrame, key: str, order: Sequence[str], name: str = "row_no", lead: int = 0) -> DataFrame:
    """``row_number() OVER (PARTITION BY key ORDER BY order)`` without sorting a hot key in one
    task. The first order column (with ``lead``, also the one after the leading ones) is a number.

    A key's rows are cut into slices that follow each other in the order: by ``coarse`` of the first
    order column; with ``lead`` > 0 each of those by the exact values of the first ``lead`` columns and
    ``coarse`` of the next one (for keys where one value of the first column has many rows). A row's
    number is the count of rows in the slices before its own plus its number inside it: windows
    hold one slice, or one row a slice. The count before a slice comes as one more row of it, its first,
    so the rows are shuffled and sorted once and joined to nothing. No job runs while the plan is built; ``df`` is
    evaluated twice, for the counts (whose shuffle is reused) with the order columns only.
    Same result as the plain window for unique order keys.
    """
    d = df.withColumn("_c", coarse(F.col(order[0])))
    fine = list(order[:lead])
    if 0 < lead < len(order):
        d = d.withColumn("_f", coarse(F.col(order[lead])))
        fine.append("_f")
    before = lambda part, by: Window.partitionBy(*part).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(key, "_c", *fine).agg(F.count(F.lit(1)).alias("_n"))
    buckets = counts.groupBy(key, "_c").agg(F.sum("_n").alias("_n")) if fine else counts
    up = F.coalesce(F.sum("_n").over(before([key], ["_c"])), F.lit(0))
    if fine:
        buckets = buckets.select(F.col(key).alias("_k"), F.col("_c").alias("_b"), up.alias("_up"))
        inside = F.coalesce(F.sum("_n").over(before([key, "_c"], fine)), F.lit(0))
        heads = counts.withColumn("_in", inside).join(buckets.hint("merge"), F.col(key).eqNullSafe(F.col("_k")) & F.col("_c").eqNullSafe(F.col("_b")))
        heads = heads.select(key, "_c", *fine, (F.col("_up") + F.col("_in")).alias("_before"))
    else:
        heads = buckets.select(key, "_c", up.alias("_before"))
    # In a slice the leading columns are the same; the column of most values comes first, so that sorting seldom looks further.
    parts = [*reversed(fine), key] if fine else ["_c", key]
    by_slice = Window.partitionBy(*parts).orderBy(F.col("_before").isNull(), *order[lead if fine else 0:])
    upto = by_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = d.withColumn("_before", F.lit(None).cast("long"))
    numbered = heads.unionByName(own, allowMissingColumns=True).drop(*(["_c"] if fine else [])).withColumn(
        name, (F.max("_before").over(upto) + F.row_number().over(by_slice) - 1).cast("long"))
    return numbered.where(F.col("_before").isNull()).select(*df.columns, name)
