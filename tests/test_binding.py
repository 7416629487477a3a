import json
import os

import numpy as np
import pytest

from corvida.operators import binding, lineage, scoring, split


def faults(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_empty_and_null(spark):
    history = spark.createDataFrame([("a", 1, 0.5, 0.5), ("a", 2, 0.4, float("inf")), ("b", 2, 0.1, 0.1), ("c", None, 0.1, 0.1), ("d", 1, 0.1, None), ("e", 1, 0.0, 0.0), ("e", 1, 0.0, 0.0)], "run string, epoch int, loss double, val_loss double")
    assert faults(binding.history_faults(history)) == [("a", "values"), ("b", "epochs"), ("c", "epochs"), ("d", "values"), ("e", "epochs")]
    assert faults(binding.history_faults(history.limit(0))) == []
    schema = "seed long, model_sha256 string, selection_sha256 string, manifest_sha256 string, threshold double"
    none = spark.createDataFrame([], f"{schema}, split string, mode string")
    assert faults(binding.run_faults(none, none)) == [(None, "one_manifest"), (None, "runs")]
    both = spark.createDataFrame([(1, "m", "s", "d", 0.5), (2, "n", "t", "d", 0.5)], schema)
    told = both.selectExpr("*", "'test' AS split", "'validation_selection' AS mode")
    assert faults(binding.run_faults(told, both)) == []
    assert faults(binding.run_faults(told, both.selectExpr("seed", "model_sha256", "selection_sha256", "manifest_sha256", "threshold + 0.1 AS threshold"))) == [(1, "threshold"), (2, "threshold")]


def test_paths_and_models(spark):
    rows = spark.createDataFrame([("test/a/1", 0, "test"), ("test/a/1", 0, "test"), ("test/b/2", 0, "test"), ("train/a/3", 0, "test"), ("test/a/../4", 0, "test"), (None, 0, "test"), ("test/a/5", None, "test"), ("x", 1, "test")], "path string, label int, split string")
    assert faults(binding.path_faults(rows, ("a", "b"))) == sorted(
        [("test/a/1", "unique"), ("test/b/2", "class"), ("train/a/3", "split"), ("test/a/../4", "plain"), (None, "plain"), (None, "split"), (None, "class"), ("test/a/5", "class"), ("x", "split"), ("x", "class")], key=str
    )
    one, two = "1" * 64, "2" * 64
    models = spark.createDataFrame([("m", one, ["a", "b"], "s"), ("n", one, ["a", "b"], "s"), ("o", two, ["b", "a"], "t"), ("p", None, ["a", "b"], "s"), ("q", "3" * 64, ["a", "b"], "s"), ("q", "4" * 64, None, "s")], "model string, model_sha256 string, class_names array<string>, manifest string")
    assert faults(binding.model_faults(models, ("a", "b"), "s")) == sorted([("m", "own_content"), ("n", "own_content"), ("o", "classes"), ("o", "manifest"), ("p", "digest"), ("q", "unique"), ("q", "classes")], key=str)


def test_models_and_batches(spark):
    rows = spark.createDataFrame([(f"s{i:03d}",) for i in range(103)], "sample_id string")
    got = binding.batches(rows, 10, "sample_id").collect()
    assert {r.sample_id: r.place for r in got} == {f"s{i:03d}": i for i in range(103)} and all(r.batch == r.place // 10 for r in got)
    mixed = {s: [r.sample_id for r in sorted(binding.batches(rows, 10, "sample_id", s).collect(), key=lambda r: r.place)] for s in (1, 2)}
    assert mixed[1] != mixed[2] and sorted(mixed[1]) == sorted(mixed[2]) == sorted(f"s{i:03d}" for i in range(103))
    assert binding.batches(rows.limit(0), 3, "sample_id").count() == 0
    with pytest.raises(ValueError):
        binding.batches(rows, 0, "sample_id")
    given = spark.createDataFrame([("x", 7), ("y", 2), ("z", 40)], "id string, ordinal int")
    assert {r.id: r.model for r in binding.named_models(given).collect()} == {"y": "model_1", "x": "model_2", "z": "model_3"}


def test_allocation_against_exhaustive_costs():
    rng = np.random.default_rng(5)
    for _ in range(30):
        parts = sorted(((int(a), int(b)) for a, b in rng.integers(0, 6, (25, 2)) if a + b), key=lambda p: -sum(p))
        shares, n = (0.7, 0.15, 1 - 0.7 - 0.15), [sum(p[k] for p in parts) for k in (0, 1)]
        held, want = {s: [0, 0] for s in split.SPLITS}, []
        for part in parts:
            def cost(s):
                target = [shares[split.SPLITS.index(s)] * x for x in n]
                after = [h + x for h, x in zip(held[s], part)]
                grows = sum(((after[k] - target[k]) ** 2 - (held[s][k] - target[k]) ** 2) / target[k] for k in (0, 1) if target[k])
                return -sum(x > 0 and h == 0 for h, x in zip(held[s], part)), grows
            best = min(split.SPLITS, key=cost)
            held[best] = [h + x for h, x in zip(held[best], part)]
            want.append(best)
        assert split.allocate(parts, 0.7, 0.15) == want


def test_experiment_files_attempts_and_results(spark, tmp_path):
    e = lineage.Experiment(str(tmp_path / "x"), spark)
    e.prepare([3, 5], 1, 8, 2, {"code": lineage.digest(lineage.source_digests(os.path.dirname(lineage.__file__)))})

    def fit(seed):
        with open(os.path.join(e.job_folder("fit", seed), "weights.bin"), "wb") as f:
            f.write(bytes([seed]))
        return {"seed": seed}

    def fails(seed, fitted):
        raise RuntimeError("lost")

    with pytest.raises(ValueError):
        e.summarize(len)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    with pytest.raises(RuntimeError):
        e.run(fit, fails)
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == before
    with pytest.raises(ValueError):
        e.summarize(len)
    e.run(fit, lambda seed, fitted: {"score": seed / 10})
    assert [(x["phase"], x["seed"], x["status"]) for x in e.attempts()] == [("fit", 3, "finished"), ("fit", 5, "finished"), ("test", 3, "failed"), ("test", 3, "finished"), ("test", 5, "finished")]
    mean = lambda runs: {"mean": sum(t["details"]["score"] for _, _, t in runs) / len(runs)}
    assert e.summarize(mean) == e.summarize(mean) and e.summarize(mean)["results"] == {"mean": 0.4}
    with pytest.raises(ValueError):
        e.summarize(lambda runs: {"mean": 0})
    extra = os.path.join(e.job_folder("fit", 3), "new.bin")
    for path, data in ((extra, b"x"), (os.path.join(e.job_folder("fit", 3), "weights.bin"), b"y")):
        with open(path, "wb") as f:
            f.write(data)
        with pytest.raises(ValueError, match="extra|changed"):
            e.summarize(mean)
        if path == extra:
            os.remove(path)


def test_training_stops_early_and_keeps_its_best(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + rng.normal(scale=0.8, size=400) > 0).astype(int)
    rows = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(400)], "id long, x array<double>, y int")
    train, held = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    scorer, history = scoring.train_scorer(train, held, 200, 32, 7, patience=3, rate=0.3)
    losses = [h["val_loss"] for h in history]
    assert len(history) < 200 and len(losses) - 1 - losses.index(min(losses)) == 3
    assert scoring.log_loss(y[::4], scorer.score(x[::4])) == pytest.approx(min(losses))
    again, repeated = scoring.train_scorer(train, held, 200, 32, 7, patience=3, rate=0.3)
    assert repeated == history and np.array_equal(again.w, scorer.w)
    assert binding.history_faults(spark.createDataFrame([("r", h["epoch"], h["loss"], h["val_loss"]) for h in history], "run string, epoch int, loss double, val_loss double")).count() == 0
    path = str(tmp_path / "m.json")
    scoring.save_scorer(path, scorer, history)
    assert np.array_equal(scoring.load_scorer(path).w, scorer.w)
    with open(f"{path}.history.json") as f:
        assert json.load(f) == history
    with pytest.raises(FileExistsError):
        scoring.save_scorer(path, scorer, history)
    for bad in ({"epochs": 0}, {"epochs": 1, "patience": 0}):
        with pytest.raises(ValueError):
            scoring.train_scorer(train, held, **bad)
    with pytest.raises(ValueError):
        scoring.train_scorer(train.where("y = 1"), held, 2)

    class Wrong:
        def score(self, x):
            return x

    with pytest.raises(ValueError):
        scoring.check_scores(Wrong(), 3)
