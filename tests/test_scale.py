import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvida.operators import ordered, resampling, scoring, split, splitting


def test_counts_are_multinomial_and_agree_between_tasks():
    draws = splitting.Draws(7, 0, 4000, 37)
    counts = draws.counts(np.arange(37))
    assert (counts.sum(axis=0) == 37).all()
    assert np.abs(counts.mean(axis=1) - 1).max() < 0.08 and abs(counts.var(axis=1).mean() - 36 / 37) < 0.03
    together = np.corrcoef(counts)[~np.eye(37, dtype=bool)]
    assert abs(together.mean() + 1 / 36) < 0.003 and together.std() < 0.02
    # any part of the places has the counts that the whole has
    for places in ([0], [36], [3, 4, 20], list(range(10, 30))):
        assert (splitting.Draws(7, 0, 4000, 37).counts(np.array(places)) == counts[places]).all()
    assert (splitting.Draws(7, 1000, 1100, 37).counts(np.arange(37)) == counts[:, 1000:1100]).all()


@pytest.mark.parametrize("n,p", [(1, 0.5), (5, 0.2), (60, 0.47), (3000, 0.5)])
def test_binomials_are_the_smallest_numbers_that_reach_u(n, p):
    from math import lgamma, log

    logs = [lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p) for k in range(n + 1)]
    sums = np.cumsum(np.exp(logs))
    u = np.random.default_rng(n).random(3000)
    want = np.minimum(np.searchsorted(sums, u, "left"), n)
    assert (splitting.binomials(np.full(3000, n), p, u) == want).all()


def sums_of(rng, groups):
    rows = []
    for g in range(groups):
        P, N = rng.randrange(4), rng.randrange(1, 4)
        for seed in ("a", "b"):
            rows += [(f"g{g:05d}", seed, c, P, N, rng.randint(0, P), rng.randint(0, N)) for c in ("selected", "fixed")]
    return rows


SUMS = "group string, seed string, comparator string, P long, N long, tp long, tn long"


def test_paired_bootstrap_against_plain_python(spark):
    rng, repetitions = random.Random(4), 200
    rows = sums_of(rng, 40)
    counts = splitting.Draws(11, 0, 4 * repetitions, 40).counts(np.arange(40))
    values = {n: [] for n in resampling.SERIES}
    for attempt in range(counts.shape[1]):
        total = {}
        for g, seed, c, *four in rows:
            have = total.setdefault((seed, c), [0, 0, 0, 0])
            total[seed, c] = [h + int(counts[int(g[1:]), attempt]) * x for h, x in zip(have, four)]
        if any(P == 0 or N == 0 for P, N, _, _ in total.values()) or len(values["fixed"]) == repetitions:
            continue
        value = {k: (tp / P + tn / N) / 2 for k, (P, N, tp, tn) in total.items()}
        for name, of in {"selected": lambda s: value[s, "selected"], "fixed": lambda s: value[s, "fixed"], "delta": lambda s: value[s, "selected"] - value[s, "fixed"], "over_baseline": lambda s: value[s, "selected"] - 0.5}.items():
            values[name].append((of("a") + of("b")) / 2)
    got = {r.comparator: r for r in resampling.bootstrap(spark.createDataFrame(rows, SUMS), repetitions, 11, "splitting", paired=True).collect()}
    assert set(got) == set(resampling.SERIES)
    for name, r in got.items():
        low, high = np.percentile(values[name], [2.5, 97.5])
        assert r.valid == repetitions and abs(r.low - low) < 1e-12 and abs(r.high - high) < 1e-12


def test_bootstrap_without_a_valid_draw_and_unknown_kinds(spark):
    rows = [(g, s, c, 2, 0, 1, 0) for g in "xyz" for s in ("a", "b") for c in ("selected", "fixed")]
    sums = spark.createDataFrame(rows, SUMS)
    got = sorted(tuple(r) for r in resampling.bootstrap(sums, 2, 1, "splitting", paired=True).collect())
    assert got == sorted((n, 0, 40, 40, None, None) for n in resampling.SERIES)
    with pytest.raises(ValueError, match="unknown draws"):
        resampling.bootstrap(sums, 2, 1, "other")


def test_many_groups_are_summed_where_they_are(spark):
    sized = spark.range(20_000).select(F.col("id").alias("place"), F.lit("a").alias("seed"), F.lit("selected").alias("comparator"), F.lit(1).alias("P"), F.lit(2).alias("N"), (F.col("id") % 2).alias("tp"), F.lit(1).alias("tn"))
    drawn = splitting.split_draw_sums(sized, 3, 0, 50, 20_000)
    got = {r.attempt: r for r in drawn.collect()}
    counts = splitting.Draws(3, 0, 50, 20_000).counts(np.arange(20_000))
    assert len(got) == 50 and all(r.P == r.tn == 20_000 and r.N == 40_000 and r.tp == counts[1::2, a].sum() for a, r in got.items())
    # no slot is shuffled: the rows of the last exchange are those of draws and tasks
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange") == 2 and "rangepartitioning(place" in plan


@pytest.mark.parametrize("few", [0, 10_000])
def test_percentiles_equal_sparks_own(spark, monkeypatch, few):
    monkeypatch.setattr(ordered, "FEW", few)
    rng = random.Random(8)
    rows = [(rng.choice("abc"), rng.choice([None, 1.0, 2.0, 2.0, 7.5, rng.random() * 9])) for _ in range(3000)] + [("one", 4.0), ("none", None), ("two", 1.0), ("two", 2.0), ("nan", float("nan")), ("nan", 1.0)]
    df = spark.createDataFrame(rows, "part string, v double")
    shares = [0.0, 0.025, 0.3, 0.5, 0.975, 1.0]
    got = {(r.part, r.share): (r.n, r.value) for r in ordered.percentiles(df, ["part"], "v", shares).collect()}
    want = {r.part: r for r in df.groupBy("part").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()}
    assert len(got) == 6 * len(want)
    for (part, share), (n, value) in got.items():
        other = want[part].q[shares.index(share)] if want[part].q else None
        assert n == want[part].n and (value == other or abs(value - other) < 1e-12 or (value != value and other != other)), (part, share)
    whole = ordered.percentiles(df.where("part != 'nan'"), [], "v", [0.5]).collect()
    assert [(r.n, round(r.value, 9)) for r in whole] == [tuple(r) for r in df.where("part != 'nan'").agg(F.count("v"), F.round(F.percentile("v", 0.5), 9)).collect()]
    assert ordered.percentiles(df.limit(0), ["part"], "v", [0.5]).count() == 0
    with pytest.raises(ValueError):
        ordered.percentiles(df, ["part"], "v", [1.5])


def fold(pairs, weights):
    """Splits of components one after another, in exact fractions."""
    totals = [sum(p[k] for p in pairs) for k in (0, 1)]
    wanted = [[Fraction(w * t, sum(weights)) for t in totals] for w in weights]
    held, out = [[0, 0] for _ in weights], []
    for pair in pairs:
        def cost(s):
            after = [h + n for h, n in zip(held[s], pair)]
            grows = sum(((a - t) ** 2 - (h - t) ** 2) / t for a, h, t in zip(after, held[s], wanted[s]) if t)
            return -sum(h == 0 and n > 0 for h, n in zip(held[s], pair)), grows, s

        best = min(range(len(weights)), key=cost)
        held[best] = [h + n for h, n in zip(held[best], pair)]
        out.append(split.SPLITS[best])
    return out


def test_runs_against_the_fold_of_single_components():
    rng = random.Random(2)
    for _ in range(150):
        weights = split.whole_shares(*rng.choice([(0.7, 0.15), (0.6, 0.2), (0.8, 0.1), (0.5, 0.25), (0.33, 0.3)]))
        runs = [(n0, size - n0, rng.randrange(1, 30)) for size in range(rng.randrange(1, 6), 0, -1) for n0 in range(size, -1, -1) if rng.random() < 0.6]
        totals, got = tuple(sum(r[k] * r[2] for r in runs) for k in (0, 1)), []
        for (n0, n1, many), (singles, held) in zip(runs, split.fold_runs(runs, weights)):
            run, counts = split.Run((n0, n1), totals, held, weights), [0, 0, 0]
            got += [split.SPLITS[s] for s in singles]
            for j in range(many - len(singles)):
                assert run.counts(j) == counts
                s = run.next(counts)
                counts[s] += 1
                got.append(split.SPLITS[s])
        assert got == fold([r[:2] for r in runs for _ in range(r[2])], weights)
    assert split.whole_shares(0.7, 0.15) == [14, 3, 3]


def test_run_split_of_many_components_against_the_fold(spark):
    n = 20_000
    parts = spark.range(n).select(F.col("id").alias("component"), (F.pmod(F.xxhash64("id"), F.lit(4)) + 1).alias("size"))
    rows = parts.select("component", F.explode(F.sequence(F.lit(1).cast("long"), F.col("size"))).alias("k")).withColumn("label", (F.pmod(F.xxhash64("component", "k"), F.lit(10)) < 3).cast("int"))
    rows = rows.unionByName(spark.createDataFrame([(n + 5, 1, None)], rows.schema))
    got = {r.component: r.split for r in split.greedy_run_split(rows, seed=6).collect()}
    import hashlib

    pairs = {r.component: (r.n0, r.n1) for r in split.component_table(rows).collect()}
    order = sorted(pairs, key=lambda c: (-sum(pairs[c]), -pairs[c][0], hashlib.md5(f"6:{c}".encode()).hexdigest(), c))
    assert got == dict(zip(order, fold([pairs[c] for c in order], [14, 3, 3])))


def vectors(spark, n=900, width=6):
    r = np.random.default_rng(1)
    x = r.normal(size=(n, width))
    y = (x[:, 0] - 0.5 * x[:, 1] + r.normal(size=n) > 0).astype(int)
    return x, y, spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i])) for i in range(n)], "id long, x array<double>, y int")


def test_fits_on_all_rows_equal_numpy(spark):
    x, y, df = vectors(spark)
    odd = spark.createDataFrame([(-1, None, 1), (-2, [0.0] * 6, None)], df.schema)
    assert np.abs(scoring.fit_all(df.repartition(5).unionByName(odd)).w - scoring.Logistic().fit(x, y).w).max() < 1e-9
    w, ones = np.zeros(7), np.hstack([np.ones((len(x), 1)), x])
    for _ in range(5):
        w = w - 2.0 * (ones.T @ (1 / (1 + np.exp(-ones @ w)) - y) / len(x) + 0.01 * w)
    assert np.abs(scoring.fit_descent(df, 2.0, 5, 0.01).w - w).max() < 1e-9
    for bad in (df.where("y = 1"), df.limit(0), df.unionByName(spark.createDataFrame([(-3, [1.0], 1)], df.schema))):
        with pytest.raises(ValueError):
            scoring.fit_all(bad)


def test_seeds_train_apart_as_they_do_alone(spark):
    _, _, df = vectors(spark)
    train, validation = df.where("id % 4 != 0"), df.where("id % 4 = 0")
    got = scoring.train_seeds(train, validation, [3, 8], 9, batch_size=32, patience=2, most=500).collect()
    for seed in (3, 8):
        scorer, history = scoring.train_scorer(train, validation, 9, 32, seed, 2, 500)
        mine = sorted((r for r in got if r.seed == seed), key=lambda r: r.epoch)
        assert [(r.epoch, r.loss, r.val_loss) for r in mine] == [(h["epoch"], h["loss"], h["val_loss"]) for h in history]
        (best,) = [r for r in mine if r.best]
        assert best.weights == scorer.w.tolist() and all(r.weights is None for r in mine if not r.best)
    for bad in ({"seeds": []}, {"seeds": [1, 1]}, {"seeds": [1], "epochs": 0}):
        with pytest.raises(ValueError):
            scoring.train_seeds(train, validation, **{"epochs": 3} | bad)


def test_staged_tables_go_with_their_block_or_by_age(spark):
    import os

    from corvida import session

    root = session.shared_dir(spark).removeprefix("file://")
    with session.Stage(spark, "kept") as stage:
        assert stage.write(spark.range(3)).count() == 3
        name = os.path.basename(stage.root)
        assert name in os.listdir(root)
    assert name not in os.listdir(root)
    old, new = session.Stage(spark, "old"), session.Stage(spark, "new")
    for s in (old, new):
        s.write(spark.range(2))
    for at in (old.root, f"{old.root}/0001"):
        os.utime(at.removeprefix("file://"), (1, 1))
    os.makedirs(f"{root}/somebody-else", exist_ok=True)
    os.utime(f"{root}/somebody-else", (1, 1))
    assert session.sweep_stages(spark, 24) == [os.path.basename(old.root)]
    assert {os.path.basename(new.root), "somebody-else"} <= set(os.listdir(root))
