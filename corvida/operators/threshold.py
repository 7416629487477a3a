"""Decision thresholds from labelled scores.

The best threshold maximises balanced accuracy, compared as an exact integer
objective; ties go to the one nearest 0.5, then to the smaller. Scores are
reduced to counts by distinct value first, so only distinct values are ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvida.operators.ordered import running_sums

#: Thresholds that are always tried.
FIXED = (0.0, 0.5, 1.0)


def score_counts(scores: DataFrame) -> DataFrame:
    """``model, p, pos, neg`` for each distinct score of ``scores(model, y, p)``."""
    return scores.groupBy("model", "p").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))


def threshold_curve(scores: DataFrame) -> DataFrame:
    """``model, threshold, tp, tn, objective, balanced_accuracy`` of every candidate; none for a model with one class only."""
    counts = score_counts(scores)
    totals = counts.groupBy("model").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg")).where("all_pos > 0 AND all_neg > 0")
    zero = F.lit(0).cast("long")
    extra = totals.select("model", F.explode(F.array(*map(F.lit, FIXED))).alias("p"), zero.alias("pos"), zero.alias("neg"))
    points = counts.unionByName(extra).groupBy("model", "p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    below = running_sums(points, ["model"], ["p"], {"pos_below": "pos", "neg_below": "neg"}).join(totals, "model")
    tp, tn = F.col("all_pos") - F.col("pos_below"), F.col("neg_below")
    wide = lambda c: c.cast("decimal(19,0)")
    objective = wide(tp) * wide(F.col("all_neg")) + wide(tn) * wide(F.col("all_pos"))
    balanced = (tp / F.col("all_pos") + tn / F.col("all_neg")) / 2
    return below.select("model", F.col("p").alias("threshold"), tp.alias("tp"), tn.alias("tn"), objective.alias("objective"), balanced.alias("balanced_accuracy"))


def choose_threshold(scores: DataFrame) -> DataFrame:
    """The best row of the curve for each model."""
    t = F.col("threshold")
    best = F.max_by(F.struct("threshold", "tp", "tn", "objective", "balanced_accuracy"), F.struct(F.col("objective"), -F.abs(t - 0.5), -t))
    return threshold_curve(scores).groupBy("model").agg(best.alias("b")).select("model", "b.*")
