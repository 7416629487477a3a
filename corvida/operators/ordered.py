"""Ranks and running sums over a whole table without one task for all rows.

A window without a partition key runs in a single task. Here rows are sorted
into range partitions, whose bounds Spark samples from the data, so that no
stretch of close values comes together in one; totals by partition are a small
table whose running sums are exact offsets, and the rest is a window within
each partition. Equal values are in one partition, so values should be reduced
to counts first where they repeat. A table of ``FEW`` rows or less is no load
for a task, and there a plain window does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvida.session import Stage


FEW = 10_000


def running_sums(df: DataFrame, part: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """``df`` with, for each ``name: column`` of ``sums``, the sum over all earlier rows of its part."""
    stage = Stage(df.sparkSession, "ordered")
    held = stage.write(df)
    if held.limit(FEW + 1).count() <= FEW:
        before = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return held.select("*", *((F.lit(0) + F.coalesce(F.sum(c).over(before), F.lit(0))).alias(n) for n, c in sums.items()))
    rows = held.repartitionByRange(*part, *order).withColumn("_bucket", F.spark_partition_id())
    # a table fixes the partition that a row is in
    rows = stage.write(rows)
    totals = rows.groupBy(*part, "_bucket").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    over = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*part, "_bucket", *(F.coalesce(F.sum(f"_t_{n}").over(over), F.lit(0)).alias(f"_o_{n}") for n in sums))
    inside = Window.partitionBy(*part, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(offsets, [*part, "_bucket"])
    for n, c in sums.items():
        out = out.withColumn(n, F.col(f"_o_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop("_bucket", *(f"_o_{n}" for n in sums))


def percentiles(df: DataFrame, part: list[str], value: str, shares: list[float]) -> DataFrame:
    """``part, n, share, value``: exact percentiles with linear interpolation, of any number of values.

    Values are reduced to counts first; running counts over sampled ranges tell
    which two values stand around each rank, and only those are kept, so no
    task holds all values of a part. Null values don't count and NaN is the
    largest number, as in ``percentile``; a part without values has null. Rows
    with a null in ``part`` are in no part.
    """
    if not shares or any(not 0 <= s <= 1 for s in shares):
        raise ValueError("shares must be from 0 to 1")
    if not part:
        return percentiles(df.withColumn("_all", F.lit(0)), ["_all"], value, shares).drop("_all")
    df = df.na.drop(subset=part)
    shares = sorted(set(map(float, shares)))
    stage = Stage(df.sparkSession, "percentiles")
    counts = stage.write(df.groupBy(*part, F.col(value).cast("double").alias("_v")).agg(F.count(value).alias("_c")))
    held = counts.where("_v IS NOT NULL")
    placed = running_sums(held, part, ["_v"], {"_before": "_c"})
    totals = counts.groupBy(*part).agg(F.sum("_c").cast("long").alias("n"))
    share = F.explode(F.array(*map(F.lit, shares))).alias("share")
    at = (F.greatest(F.col("n") - 1, F.lit(0)) * F.col("share")).alias("_at")
    wanted = totals.select(*part, "n", share).select("*", at)
    # a value covers the ranks from _before on; the two ranks around a place may be one value's
    lower, upper = F.floor("_at"), F.ceil("_at")
    covers = lambda rank: (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_c"))
    # a row for each part, so every row meets the few shares of its own
    few = wanted.groupBy(*part).agg(F.collect_list(F.struct("share", "_at")).alias("_w"))
    near = placed.join(few, part).select(*part, "_v", "_before", "_c", F.inline("_w"))
    near = near.where(covers(lower) | covers(upper))
    found = near.groupBy(*part, "share").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    weight = F.col("_at") - lower
    mixed = F.when(weight == 0, F.col("_low")).otherwise(F.col("_low") + (F.col("_high") - F.col("_low")) * weight)
    return wanted.join(found, [*part, "share"], "left").select(*part, "n", "share", mixed.alias("value"))
