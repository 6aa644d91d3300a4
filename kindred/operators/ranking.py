"""Global positions without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_start(df: DataFrame, key: str, amount: Column, out: str, per_bucket: int = 4096) -> DataFrame:
    """Add `out`: the sum of `amount` over all rows with a smaller integer `key`, ties in any fixed order.

    Keys fall into ranges of `per_bucket`; sums per range are small and get their running total in one
    window, and rows only meet the others of their own range. Nulls in `key` come first.
    """
    bucket = F.coalesce(F.floor(F.col(key) / per_bucket), F.lit(None).cast("long"))
    rows = df.withColumn("_bucket", bucket).withColumn("_amount", amount)
    sums = rows.groupBy("_bucket").agg(F.sum("_amount").alias("_sum"))
    before = Window.orderBy(F.col("_bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(starts, F.col("_bucket").eqNullSafe(F.col("_b")))
        .withColumn(out, F.col("_base") + F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
        .drop("_bucket", "_amount", "_b", "_base")
    )
