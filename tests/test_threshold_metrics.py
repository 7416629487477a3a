import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from corvida.operators import metrics, threshold


def scores(spark, cases):
    """``cases``: model to (labels, scores)."""
    rows = [(m, i, y, float(p)) for m, (ys, ps) in cases.items() for i, (y, p) in enumerate(zip(ys, ps))]
    return spark.createDataFrame(rows, "model string, sample_id long, y int, p double")


def half(spark, cases):
    return spark.createDataFrame([(m, 0.5) for m in cases], "model string, threshold double")


def best_threshold(ys, ps):
    P, N = sum(ys), len(ys) - sum(ys)
    best = None
    for t in {0.0, 0.5, 1.0, *ps}:
        tp, tn = sum(y and p >= t for y, p in zip(ys, ps)), sum((not y) and p < t for y, p in zip(ys, ps))
        key = (-(tp * N + tn * P), abs(t - 0.5), t)
        best = min(best or key, key)
    return best[2]


def auc(ys, ps):
    pairs = [(a > b) + 0.5 * (a == b) for a, y in zip(ps, ys) if y for b, z in zip(ps, ys) if not z]
    return sum(pairs) / len(pairs) if pairs else None


def test_known_metrics(spark):
    # Labels and scores with metrics worked out by hand.
    cases = {"a": ([0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8]), "b": ([0, 1], [0.5, 0.5]), "c": ([1, 1], [0.9, 0.8])}
    got = {r.model: r for r in metrics.binary_metrics(scores(spark, cases), half(spark, cases)).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.tn, a.fp, a.fn, a.tp) == (2, 0, 1, 1) and a.roc_auc == 0.75 and a.accuracy == 0.75 and math.isclose(a.brier, 0.158125)
    assert b.roc_auc == 0.5
    assert c.roc_auc is None and c.specificity is None and c.balanced_accuracy is None and c.sensitivity == 1


def test_known_thresholds(spark):
    cases = {"a": ([0, 1], [0.2, 0.4]), "b": ([0, 1], [0.6, 0.8]), "c": ([0, 1], [0.5, 0.5]), "d": ([0, 1, 0, 1], [0, 0.25, 0.5, 0.75]), "e": ([1, 1], [0.1, 0.2])}
    got = {r.model: r for r in threshold.choose_threshold(scores(spark, cases)).collect()}
    assert {m: r.threshold for m, r in got.items()} == {"a": 0.4, "b": 0.8, "c": 0.5, "d": 0.25}
    assert got["d"].balanced_accuracy == 0.75


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0])), min_size=2, max_size=30), min_size=5, max_size=10))
def test_thresholds_and_auc_against_exhaustive_search(spark, many):
    cases = {f"m{i}": ([y for y, _ in rows], [p for _, p in rows]) for i, rows in enumerate(many)}
    df = scores(spark, cases)
    chosen = {r.model: r.threshold for r in threshold.choose_threshold(df).collect()}
    areas = {r.model: r.roc_auc for r in metrics.roc_auc(df).collect()}
    for m, (ys, ps) in cases.items():
        if 0 < sum(ys) < len(ys):
            assert chosen[m] == best_threshold(ys, ps) and math.isclose(areas[m], auc(ys, ps))
        else:
            assert m not in chosen and areas[m] is None


def test_classes_with_zero_denominators(spark):
    cases = {"a": ([0, 0], [0.1, 0.2])}
    rows = {r["class"]: r for r in metrics.by_class(metrics.confusion(scores(spark, cases), half(spark, cases))).collect()}
    assert rows[0].f1 == 1 and rows[1].precision is None and rows[1].recall is None and rows[1].f1 is None


def test_ensemble(spark):
    r = random.Random(1)
    df = scores(spark, {"a": ([0, 1], [0.1, 0.9]), "b": ([0, 1], [0.3, 0.7])})
    got = {(x.model, x.sample_id): x.p for x in metrics.with_ensemble(df).collect()}
    assert math.isclose(got["ensemble", 0], 0.2) and math.isclose(got["ensemble", 1], 0.8)
    values = [[r.random() for _ in range(20)] for _ in range(7)]
    many = scores(spark, {f"m{i}": ([0] * 20, v) for i, v in enumerate(values)})
    means = {x.sample_id: x.p for x in metrics.with_ensemble(many).where("model = 'ensemble'").collect()}
    assert means == {i: math.fsum(v[i] for v in values) / 7 for i in range(20)}
    one = scores(spark, {"a": ([0], [0.1])})
    assert metrics.with_ensemble(one).count() == 1
    with pytest.raises(ValueError):
        metrics.with_ensemble(scores(spark, {"ensemble": ([0], [0.1]), "b": ([0], [0.1])}))
    with pytest.raises(ValueError):
        metrics.with_ensemble(scores(spark, {"a": ([0, 1], [0.1, 0.2]), "b": ([0], [0.1])}))


def test_samples_carry_maps(spark):
    cases = {"a": ([0, 1], [0.1, 0.9]), "b": ([0, 1], [0.6, 0.7])}
    got = {r.sample_id: r for r in metrics.evaluation_samples(scores(spark, cases), half(spark, cases), ("no", "yes")).collect()}
    assert got[0].true_class == "no" and got[0].predictions == {"a": "no", "b": "yes"} and got[1].probabilities == {"a": 0.9, "b": 0.7}
