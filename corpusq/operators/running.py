"""Running numbers and totals per key that never put one key into one task.

Rows are cut into buckets of the order column. Each (key, bucket) is sorted on its
own; totals of whole buckets, one small row each, carry over from bucket to bucket.
A key that holds a third of all rows spreads over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    value: Column,
    out: str,
    descending: bool = False,
) -> DataFrame:
    """Adds ``out``: the total of ``value`` up to and including the row.

    ``bucket`` must not decrease along ``order``.
    """

    def direction(name: str) -> Column:
        return F.desc(name) if descending else F.asc(name)

    tagged = df.withColumn("_bucket", bucket).withColumn("_value", value)
    local = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(*[direction(o) for o in order])
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    before = (
        Window.partitionBy(*[f"_k{n}" for n in range(len(keys))])
        .orderBy(direction("_b"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = (
        tagged.groupBy(*keys, "_bucket")
        .agg(F.sum("_value").alias("_total"))
        .select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.col("_bucket").alias("_b"), "_total")
        .withColumn("_carried", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .drop("_total")
    )
    match = F.col("_bucket").eqNullSafe(F.col("_b"))
    for n, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{n}"))
    return (
        tagged.withColumn("_local", F.sum("_value").over(local))
        .join(totals, match)
        .withColumn(out, F.col("_local") + F.col("_carried"))
        .drop("_bucket", "_value", "_local", "_carried", "_b", *[f"_k{n}" for n in range(len(keys))])
    )


def running_number(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, out: str
) -> DataFrame:
    return running_total(df, keys, order, bucket, F.lit(1).cast("long"), out)


def next_value(
    df: DataFrame, keys: list[str], order: str, bucket: Column, out: str
) -> DataFrame:
    """Adds ``out``: the order value of the following row of the key, or null.

    Inside a bucket this is a window; the last row of a bucket takes the first value
    of the next bucket that has any.
    """
    tagged = df.withColumn("_bucket", bucket)
    local = Window.partitionBy(*keys, "_bucket").orderBy(order)
    names = [f"_k{n}" for n in range(len(keys))]
    firsts = (
        tagged.groupBy(*keys, "_bucket")
        .agg(F.min(order).alias("_first"))
        .select(*[F.col(k).alias(n) for n, k in zip(names, keys, strict=True)], F.col("_bucket").alias("_b"), "_first")
        .withColumn("_following", F.lead("_first").over(Window.partitionBy(*names).orderBy("_b")))
        .drop("_first")
    )
    match = F.col("_bucket").eqNullSafe(F.col("_b"))
    for n, k in zip(names, keys, strict=True):
        match = match & F.col(k).eqNullSafe(F.col(n))
    return (
        tagged.withColumn("_next", F.lead(order).over(local))
        .join(firsts, match)
        .withColumn(out, F.coalesce("_next", "_following"))
        .drop("_bucket", "_next", "_following", "_b", *names)
    )
