import itertools
import math
import os
import random

import numpy as np
import pytest

from corvida.operators import contracts, lineage, resampling


def rows_of(seed, groups=9, per=4):
    r = random.Random(seed)
    out = []
    for g in range(groups):
        for k in range(per):
            y = int(r.random() < 0.6)
            for s in (1, 2):
                for c in ("selected", "fixed"):
                    out.append((10 * g, s, c, y, int(r.random() < 0.4 + 0.3 * y)))
    return out


def oracle(rows, draws, wanted):
    """Resample whole groups and average balanced accuracies over seeds."""
    groups = sorted({r[0] for r in rows})
    values, attempted = {}, 0
    for attempt, drawn in enumerate(draws):
        ys = {c: {s: [r for g in drawn for r in rows if r[0] == groups[g] and r[1] == s and r[2] == c] for s in (1, 2)} for c in ("selected", "fixed")}
        first = ys["selected"][1]
        attempted = attempt + 1
        if len({r[3] for r in first}) < 2:
            continue
        for c, by_seed in ys.items():
            got = []
            for rs in by_seed.values():
                tp, P = sum(r[3] and r[4] for r in rs), sum(r[3] for r in rs)
                tn, N = sum((not r[3]) and (not r[4]) for r in rs), sum(not r[3] for r in rs)
                got.append((tp / P + tn / N) / 2)
            values.setdefault(c, []).append(sum(got) / len(got))
        if len(values["fixed"]) == wanted:
            break
    return {c: (len(v), attempted, *np.percentile(v, [2.5, 97.5])) for c, v in values.items()}


def test_twister_bootstrap_against_resampling(spark):
    rows = rows_of(4)
    sums = resampling.group_sums(spark.createDataFrame(rows, "group long, seed int, comparator string, y int, said int"))
    generator = random.Random(7)
    draws = ([generator.randrange(9) for _ in range(9)] for _ in range(20 * 30))
    want = oracle(rows, draws, 30)
    got = {r.comparator: (r.valid, r.attempted, r.low, r.high) for r in resampling.bootstrap(sums, 30, 7, "twister").collect()}
    for c in want:
        assert got[c][:2] == want[c][:2] and all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got[c][2:], want[c][2:]))


def test_too_few_valid_draws_give_no_interval(spark):
    rows = [(0, 1, "fixed", 1, 1), (1, 1, "fixed", 1, 0)]
    sums = resampling.group_sums(spark.createDataFrame(rows, "group long, seed int, comparator string, y int, said int"))
    # Twenty attempts for each of two wanted draws, all of one class.
    assert [tuple(r) for r in resampling.bootstrap(sums, 2, 1).collect()] == [("fixed", 0, 40, 40, None, None)]
    assert [tuple(r) for r in resampling.bootstrap(sums, 2, 1, "twister").collect()] == [("fixed", 0, 40, 40, None, None)]
    mixed = resampling.group_sums(spark.createDataFrame([*rows, (2, 1, "fixed", 0, 0)], "group long, seed int, comparator string, y int, said int"))
    got = resampling.bootstrap(mixed, 5, 1).first()
    assert got.valid == 5 and got.attempted >= 5 and got.rejected == got.attempted - 5 and got.low <= got.high
    with pytest.raises(ValueError):
        resampling.bootstrap(sums, 1, 1)


def test_seed_statistics(spark):
    v = [0.5, 0.6, 0.65, 0.52]
    got = resampling.across_seeds(spark.createDataFrame([("a", x) for x in v], "metric string, value double")).first()
    assert got.n == 4 and math.isclose(got.sd, np.std(v, ddof=1)) and math.isclose(got.variance, np.var(v, ddof=1)) and (got.low, got.high) == (0.5, 0.65)


def test_experiment_order_resume_and_tampering(tmp_path):
    e = lineage.Experiment(str(tmp_path / "x"))
    e.prepare([17, 29], 1, 8, 10, {"data": "d1"})
    calls = []
    with pytest.raises(ValueError):
        e.record("test", 17, {})
    with pytest.raises(ValueError):
        e.lock()
    e.record("fit", 17, {"loss": 0.5})
    fit = lambda s: calls.append(("fit", s)) or {"loss": 0.1}
    test = lambda s, d: calls.append(("test", s)) or {"of": d}
    done = e.run(fit, test)
    assert calls == [("fit", 29), ("test", 17), ("test", 29)] and done[0]["details"]["of"] == {"loss": 0.5}
    assert e.run(fit, test) == done and len(calls) == 3
    with pytest.raises(ValueError):
        e.record("fit", 17, {"loss": 0.5})
    with pytest.raises(ValueError):
        e.plan({"data": "d2"})
    with open(os.path.join(e.folder, "fit-17.json"), "r+") as f:
        text = f.read().replace("0.5", "0.4")
        f.seek(0)
        f.write(text)
    os.remove(os.path.join(e.folder, "test-17.json"))
    with pytest.raises(ValueError):
        e.run(fit, test)
    for seeds, epochs in (([1], 1), ([1, 1], 1), ([True, 2], 1), ([1, 1 << 32], 1), ([1, 2], 0)):
        with pytest.raises(ValueError):
            lineage.check_plan(seeds, epochs, 1, 2)


def test_history_and_groups(spark):
    manifest = spark.createDataFrame([("a", "g1", "test"), ("a", "g2", "test"), ("b", "g1", "test"), ("c", "g1", "train")], "content_hash string, group string, split string")
    history = spark.createDataFrame([("m1", "a"), ("m1", "a"), ("m1", "b"), ("m1", "c"), ("m2", "c"), ("m3", "b")], "model string, content_hash string")
    assert sorted(map(tuple, contracts.history_leaks(history, manifest).collect())) == [("m1", 2), ("m3", 1)]
    assert [tuple(r) for r in contracts.in_several_groups(manifest).collect()] == [("a", 2)]
    paths = ["a/b.jpg", "/a", "a//b", "../a", "a\\b", "", None, "a/.", "x"]
    bad = contracts.unsafe_paths(spark.createDataFrame([(p,) for p in paths], "path string"), "path").collect()
    assert sorted(str(r.path) for r in bad) == sorted(map(str, ["/a", "a//b", "../a", "a\\b", "", None, "a/."]))


def test_contracts(spark):
    schema = "sample_id long, group string, content_hash string, label int, split string"
    good = [(i, f"g{i}", f"h{i}", y, s) for i, (y, s) in enumerate(itertools.product((0, 1), ("train", "validation", "test")))]
    df = spark.createDataFrame(good, schema)
    contracts.check_manifest(df)
    for bad in ([(9, " ", "h9", 0, "test")], [(9, "g9", "h9", 2, "test")], [(9, "g9", "h9", None, "test")], [(9, "g9", "h9", 0, "dev")], [(0, "g9", "h9", 0, "test")], [(9, "g0", "h9", 0, "test")], [(9, "g9", "h0", 0, "test")], [(9, "g9", "h0", 1, "train")]):
        with pytest.raises(ValueError):
            contracts.check_manifest(df.union(spark.createDataFrame(bad, schema)))
    with pytest.raises(ValueError):
        contracts.check_manifest(df.where("split != 'test'"))
    p = spark.createDataFrame([(x,) for x in (0.0, 1.0, 0.5, None, float("nan"), -0.1, 1.1, float("inf"))], "p double")
    assert contracts.bad_scores(p).count() == 5
    assert [contracts.check_threshold(x) for x in (0, 0.5, 1)] == [0, 0.5, 1]
    for x in (True, -1, 2, float("nan"), "0.5", None):
        with pytest.raises(ValueError):
            contracts.check_threshold(x)
    for x in ("/a", "a//b", "../a", "a\\b", "", "a/."):
        with pytest.raises(ValueError):
            contracts.check_relative_path(x)
    assert contracts.check_relative_path("a/b.txt") == "a/b.txt"
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x long"), spark.createDataFrame([(1,), (3,)], "x long")
    assert sorted(map(tuple, contracts.difference(a, b).collect())) == [(1, "left"), (2, "left"), (3, "right")]
    assert sorted(map(tuple, contracts.unmatched(a, b, "x").collect())) == [(2, True), (3, False)]
