"""Binary classification metrics from ``scores(model, y, p)``; undefined values are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvida.operators.ordered import running_sums
from corvida.operators.threshold import score_counts

ENSEMBLE = "ensemble"


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def confusion(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``model, n, tn, fp, fn, tp`` with p >= threshold positive; ``thresholds`` has one row per model."""
    said = (F.col("p") >= F.col("threshold")).cast("int")
    rows = scores.join(thresholds.select("model", "threshold"), "model")
    cell = lambda y, s: F.sum(F.when((F.col("y") == y) & (said == s), 1).otherwise(0)).alias(
        {(0, 0): "tn", (0, 1): "fp", (1, 0): "fn", (1, 1): "tp"}[y, s]
    )
    return rows.groupBy("model").agg(F.count("*").alias("n"), cell(0, 0), cell(0, 1), cell(1, 0), cell(1, 1))


def rates(matrix: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy, sensitivity and specificity of confusion rows."""
    tn, fp, fn, tp = map(F.col, ("tn", "fp", "fn", "tp"))
    sensitivity, specificity = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    return matrix.withColumns({"accuracy": _ratio(tp + tn, F.col("n")), "sensitivity": sensitivity, "specificity": specificity, "balanced_accuracy": (sensitivity + specificity) / 2})


def by_class(matrix: DataFrame) -> DataFrame:
    """``model, class, support, predicted, precision, recall, f1``, two rows for each model."""
    tn, fp, fn, tp = map(F.col, ("tn", "fp", "fn", "tp"))
    sides = F.array(
        F.struct(F.lit(0).alias("class"), (tn + fp).alias("support"), (tn + fn).alias("predicted"), tn.alias("correct")),
        F.struct(F.lit(1).alias("class"), (tp + fn).alias("support"), (tp + fp).alias("predicted"), tp.alias("correct")),
    )
    rows = matrix.select("model", F.explode(sides).alias("s")).select("model", "s.*")
    correct = F.col("correct")
    precision, recall = _ratio(correct, F.col("predicted")), _ratio(correct, F.col("support"))
    f1 = _ratio(2 * correct, F.col("predicted") + F.col("support"))
    return rows.select("model", "class", "support", "predicted", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def roc_auc(scores: DataFrame) -> DataFrame:
    """``model, positives, negatives, roc_auc`` from mid-ranks of tied scores; null for one class."""
    counts = score_counts(scores).withColumn("n", F.col("pos") + F.col("neg"))
    ranked = running_sums(counts, ["model"], ["p"], {"before": "n"})
    share = F.col("pos") * (F.col("before") + (F.col("n") + 1) / 2)
    sums = ranked.groupBy("model").agg(F.sum(share).alias("r"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    P, N = F.col("P").cast("double"), F.col("N").cast("double")
    return sums.select("model", F.col("P").alias("positives"), F.col("N").alias("negatives"), _ratio(F.col("r") - P * (P + 1) / 2, P * N).alias("roc_auc"))


def losses(scores: DataFrame, edge: float = 1e-15) -> DataFrame:
    """``model, brier, log_loss``; only the logarithm sees clipped scores."""
    y, p = F.col("y"), F.col("p")
    clipped = F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))
    return scores.groupBy("model").agg(F.avg((p - y) * (p - y)).alias("brier"), (-F.avg(y * F.log(clipped) + (1 - y) * F.log(1 - clipped))).alias("log_loss"))


def binary_metrics(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """All metrics, one row per model."""
    matrix = rates(confusion(scores, thresholds))
    return matrix.join(roc_auc(scores).select("model", "roc_auc"), "model").join(losses(scores), "model")


def _exact_mean(values: Column) -> Column:
    """Mean of an array whatever the order of its items: sorted, with compensated addition."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def add(a: Column, x: Column) -> Column:
        t = a["s"] + x
        lost = F.when(F.abs(a["s"]) >= F.abs(x), (a["s"] - t) + x).otherwise((x - t) + a["s"])
        return F.struct(t.alias("s"), (a["c"] + lost).alias("c"))

    return F.aggregate(F.array_sort(values), zero, add, lambda a: (a["s"] + a["c"]) / F.size(values))


def with_ensemble(scores: DataFrame, key: str = "sample_id") -> DataFrame:
    """``scores`` with an unweighted mean of all models as one more model, if there are two or more.

    The name ``ensemble`` is reserved, and every model must score every sample.
    """
    named = scores.agg(F.count_distinct("model"), F.max(F.coalesce(F.col("model") == ENSEMBLE, F.lit(False)))).first()
    if named[1]:
        raise ValueError(f"a model may not be named {ENSEMBLE!r}")
    if named[0] < 2:
        return scores
    other = [c for c in scores.columns if c not in (key, "model", "p")]
    mean = scores.groupBy(key).agg(*(F.first(c).alias(c) for c in other), F.collect_list("p").alias("ps"))
    if mean.where(F.size("ps") != named[0]).take(1):
        raise ValueError("every model must score every sample once")
    return scores.unionByName(mean.select(key, *other, F.lit(ENSEMBLE).alias("model"), _exact_mean(F.col("ps")).alias("p")))


def evaluation_samples(scores: DataFrame, thresholds: DataFrame, class_names: tuple[str, str] = ("0", "1"), key: str = "sample_id") -> DataFrame:
    """Per sample: true class by name, and maps from model to score and to predicted class."""
    names = F.array(*map(F.lit, class_names))
    rows = scores.join(thresholds.select("model", "threshold"), "model")
    said = F.get(names, (F.col("p") >= F.col("threshold")).cast("int"))
    rows = rows.groupBy(key).agg(
        F.first(F.get(names, F.col("y"))).alias("true_class"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "p")))).alias("probabilities"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("model"), said.alias("said"))))).alias("predictions"),
    )
    return rows
