import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvida.llm import embeddings
from corvida.session import Stage


def brute(rows, threshold=0.95):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float64)
            good.setdefault(i, x / np.sqrt((x * x).sum()))
    ids = sorted(good)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = dict.fromkeys([i for i, _ in rows], 0)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold:
                links[a] += 1
                links[b] += 1
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (links[i], find(i) if i in parent else i) for i in links}


def vectors(seed, n, dims=16):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, dims))
    rows = [base[i] for i in range(n)]
    rows += [base[i] + r.normal(size=dims) * 0.08 for i in range(0, n, 3)]
    rows += [base[5] + r.normal(size=dims) * r.choice([0.0, 0.05, 0.1]) for _ in range(150)]
    rows += [base[7] * k for k in (1.0, 2.0, 0.5)]
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


def test_against_brute_force_with_a_large_group(spark):
    rows = vectors(1, 300)
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 16), (n + 3, [float("nan")] + [1.0] * 15), (n + 4, [float("inf")] + [1.0] * 15), (n + 5, [None] + [1.0] * 15), (n + 6, [1.0, 0.0]), (n + 7, [1.0, 0.01])]
    df = spark.createDataFrame([(v, i, 3) for i, v in rows], "embedding array<float>, vec_id long, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    want = brute(rows)
    assert got == want


def planted(seed, groups, singles, dims=24):
    """Groups of two to thirty near vectors, one of 900, one so wide that its ends don't link, and single vectors."""
    r = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = r.normal(size=dims)
        rows += [base + r.normal(size=dims) * 0.1 for _ in range(2 + g % 29)]
    base = r.normal(size=dims)
    rows += [base + r.normal(size=dims) * 0.06 for _ in range(900)]
    x, y = np.linalg.qr(r.normal(size=(dims, 2)))[0].T
    rows += [np.cos(t) * x + np.sin(t) * y + r.normal(size=dims) * 0.01 for t in np.linspace(0, 1.5, 700)]
    rows += [r.normal(size=dims) for _ in range(singles)]
    r.shuffle(rows)
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rows)]


def test_against_brute_force_on_five_thousand_planted_vectors(spark):
    rows = planted(11, 120, 1500)
    x = np.array([v for _, v in rows])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    close = x @ x.T >= 0.95
    np.fill_diagonal(close, False)
    top = np.arange(len(rows))
    while True:
        low = np.minimum(top, np.where(close, top[None, :], len(rows)).min(axis=1))
        if (low == top).all():
            break
        top = low
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    wrong = [i for i, _ in rows if got[i] != (close[i].sum(), top[i])]
    assert len(rows) > 4500 and not wrong


def test_an_id_with_different_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [0.0, 1.0])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1)]


def test_lists_grow_while_they_are_saturated(spark):
    sims = lambda n, s: [s - 1e-6 * i for i in range(n)]
    lists = {1: sims(9, 0.9), 2: sims(30, 0.9), 3: sims(10, 0.99) + sims(30, 0.9), 4: sims(20, 0.99) + sims(30, 0.9), 5: sims(200, 0.99), 6: sims(15, 0.99)}
    edges = spark.createDataFrame([(u, 1000 + v, s) for u, ss in lists.items() for v, s in enumerate(ss)], "u long, v long, sim double")
    got = {r.u: (r["count"], r.n) for r in embeddings._lists(edges.unionAll(edges), 0.95).groupBy("u", "n").count().collect()}
    assert got == {1: (9, 9), 2: (10, 10), 3: (20, 20), 4: (40, 40), 5: (80, 80), 6: (15, 15)}


def test_nothing_to_link(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(empty).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0]), (4, None)], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in embeddings.near_duplicates(one).collect()) == [(0, 0, 0), (1, 0, 1), (4, 0, 4)]
    same = spark.createDataFrame([(3, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (8, [2.0, 4.0])], "vec_id long, embedding array<double>")
    assert sorted(set((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(same).collect())) == [(1, 2, 1), (3, 2, 1), (8, 2, 1)]


def two_tight_groups(seed, n, start=0, dims=16):
    """Two groups of ``n`` distinct vectors, far closer within than the links at about 0.96 between them."""
    r = np.random.default_rng(seed)
    a, b = np.linalg.qr(r.normal(size=(dims, 2)))[0].T
    b = 0.96 * a + np.sqrt(1 - 0.96**2) * b
    rows = [c + r.normal(size=dims) * 0.002 for c in (a, b) for _ in range(n)]
    return [(start + i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


def test_links_beyond_the_lists_join_groups(spark):
    rows = two_tight_groups(3, 15)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == brute(rows)
    assert set(got.values()) == {(29, 0)}


def test_saturated_groups_that_never_met_are_compared(spark):
    rows = two_tight_groups(4, 150) + two_tight_groups(5, 15, 300)
    nodes = spark.createDataFrame(rows, "id long, vec array<float>")
    group = lambda i: i // 150 if i < 300 else 2 + (i - 300) // 15
    first = {group(i): i for i, _ in reversed(rows)}
    most = embeddings.MOST
    graph = spark.createDataFrame([(i, first[group(i)], 0.999, most, most) for i, _ in rows], "u long, v long, sim double, rank int, n long")
    linked = spark.createDataFrame([(i, first[group(i)]) for i, _ in rows], "node long, component long")
    found = embeddings._across(nodes, graph, linked, 16, 0.95, Stage(spark, "across")).collect()
    assert {tuple(sorted((group(r.u), group(r.v)))) for r in found} == {(0, 1), (2, 3)}
    assert all(r.sim >= 0.95 for r in found)
    # an end with room in its list would have shown the link there
    open_ = graph.withColumn("sim", F.when(F.col("u") < 150, 0.5).otherwise(F.col("sim")))
    found = embeddings._across(nodes, open_, linked, 16, 0.95, Stage(spark, "across")).collect()
    assert {tuple(sorted((group(r.u), group(r.v)))) for r in found} == {(2, 3)}


def test_forest_spans_what_the_matrix_joins():
    r = np.random.default_rng(6)
    for density in (0.0, 0.01, 0.05, 0.5, 1.0):
        close = r.random((40, 60)) < density
        i, j = embeddings._forest(close)
        assert close[i, j].all() and len(i) <= 99
        kept = np.zeros_like(close)
        kept[i, j] = True

        def reach(m):
            full = np.block([[np.eye(40, dtype=bool), m], [m.T, np.eye(60, dtype=bool)]])
            for _ in range(7):
                full = (full.astype(int) @ full.astype(int)) > 0
            return full

        assert (reach(close) == reach(kept)).all()


def test_audit_sees_small_groups_beside_a_large_one(spark):
    r = np.random.default_rng(7)
    base = r.normal(size=(41, 16))
    rows = [base[40] + r.normal(size=16) * 0.01 for _ in range(100)] + [base[i // 2] + r.normal(size=16) * 0.01 for i in range(80)]
    nodes = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, vec array<double>")
    hot = spark.createDataFrame([(i, 0) for i in range(100)], "node long, component long")
    pairs = spark.createDataFrame([(i, i - i % 2) for i in range(100, 180)], "node long, component long")
    assert embeddings._audit(nodes, hot, 0.95) == 0.0
    assert embeddings._audit(nodes, hot.unionAll(pairs), 0.95) == 1.0


def test_all_vectors_are_compared_if_the_audit_never_passes(spark, monkeypatch):
    for name, value in (("MAX_ROUNDS", 1), ("ROUNDS", 0), ("BUCKET", 2), ("CHUNK", 400)):
        monkeypatch.setattr(embeddings, name, value)
    monkeypatch.setattr(embeddings, "_audit", lambda *_: 0.0)
    rows = vectors(8, 40)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("seed", [1])
def test_no_planted_pair_is_lost_among_many_unrelated_vectors(spark, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(20_000, 64))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    other = r.normal(size=(400, 64))
    other -= (other * x[:400]).sum(axis=1, keepdims=True) * x[:400]
    other /= np.sqrt((other * other).sum(axis=1, keepdims=True))
    x[10_000:10_400] = 0.952 * x[:400] + np.sqrt(1 - 0.952**2) * other
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(20_000), "embedding": pa.array(x.astype(np.float64).tolist())}))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).where("n_links > 0").collect()}
    assert got == {i: (1, i % 10_000) for i in [*range(400), *range(10_000, 10_400)]}


def test_the_sweep_alone_finds_pairs_at_the_threshold(spark):
    # the miss of a pair at the threshold is computed, more tables for longer codes
    assert embeddings.sweep_tables(500, 0.95) < embeddings.sweep_tables(20_000, 0.95) < embeddings.sweep_tables(10**6, 0.95)
    met = (1 - np.arccos(0.95) / np.pi) ** (embeddings._bits(20_000) + 2)
    assert (1 - met) ** embeddings.sweep_tables(20_000, 0.95) <= embeddings.MISS
    x = np.random.default_rng(5).normal(size=(300, 8))
    nodes = spark.createDataFrame([(i, 1, [float(v) for v in x[i % 150] * (1 + i)]) for i in range(300)], "id long, size long, vec array<double>")
    none = spark.createDataFrame([(0, 0), (150, 0)], "node long, component long")
    found = {(r.u, r.v) for r in embeddings._sweep(nodes, none, 8, 300, 0.95, Stage(spark, "sweep")).collect()}
    # of all but the pair whose ends are linked already
    assert {(i, i + 150) for i in range(1, 150)} <= found and (0, 150) not in found
