"""Confusion counts of a stream of scored samples, each counted once within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_confusion(stream: DataFrame, thresholds: dict[str, float], late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """``start, model, n, tn, fp, fn, tp`` per tumbling window of ``stream(ts, model, sample_id, y, p)``."""
    cut = F.create_map(*(F.lit(x) for item in thresholds.items() for x in item))
    said = (F.col("p") >= F.element_at(cut, F.col("model"))).cast("int")
    rows = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["model", "sample_id"]).withColumn("said", said)
    cell = lambda y, s, n: F.count_if((F.col("y") == y) & (F.col("said") == s)).alias(n)
    out = rows.groupBy(F.window("ts", window), "model").agg(F.count("*").alias("n"), cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(1, 1, "tp"))
    return out.select(F.col("window.start").alias("start"), "model", "n", "tn", "fp", "fn", "tp")
