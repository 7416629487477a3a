import random

import pytest
from pyspark.sql import functions as F

from corvida.operators import contracts, identity, split
from corvida.operators.components import connected_components


def brute(edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", range(4))
def test_components_against_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(r.randint(5, 50))]
    edges = [e for e in edges if e[0] != e[1]] + [(100 + i, 101 + i) for i in range(40)]
    df = spark.createDataFrame([*edges, (7, 7), (None, 3)], "src long, dst long")
    assert {x.node: x.component for x in connected_components(df).collect()} == brute(edges)


def test_components_with_hubs_among_other_nodes(spark, monkeypatch):
    from corvida.operators import components

    monkeypatch.setattr(components, "HUB", 3)
    r = random.Random(8)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(70)] + [(7, i) for i in range(60, 100)] + [(200 + i, 260) for i in range(60)] + [(260, 90)]
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {x.node: x.component for x in connected_components(df).collect()} == brute([e for e in edges if e[0] != e[1]])


def test_components_of_a_hub_and_of_nothing(spark):
    star = spark.range(1, 5000).selectExpr("0L as src", "id as dst")
    got = connected_components(star)
    assert got.count() == 5000 and got.where("component = 0").count() == 5000
    assert connected_components(star.limit(0)).count() == 0


ROWS = [(0, "a", "x"), (1, "a", "y"), (2, "b", "y"), (3, "b", "z"), (4, "c", "z"), (5, "d", "w")]


def test_support(spark):
    df = spark.createDataFrame(ROWS, "id long, grp string, content string")
    assert tuple(identity.group_support(df, "id", "grp", "content").first()) == (6, 4, 2)
    assert tuple(identity.group_support(df.limit(0), "id", "grp", "content").first()) == (0, 0, 0)
    with pytest.raises(ValueError):
        identity.group_support(df.union(spark.createDataFrame([(9, " ", "q")], df.schema)), "id", "grp", "content")


def test_an_excluded_case_bridges_others(spark):
    df = spark.createDataFrame([(1, "p", 0), (2, "p", None), (2, "q", None), (3, "q", 0), (4, "r", 1)], "case_id long, h string, label int")
    comp = {r.case_id: r.component for r in identity.link_components(df, "case_id", ["h"]).collect()}
    assert comp == {1: 1, 2: 1, 3: 1, 4: 4}
    kept, out = identity.exclude_missing(df)
    assert kept.count() == 3 and {r.reason for r in out.collect()} == {"missing_label"}
    counts = identity.cohort_counts(df.join(identity.link_components(df, "case_id", ["h"]), "case_id")).first()
    assert (counts.cases_all, counts.cases_included, counts.cases_excluded, counts.components_all, counts.components_included) == (4, 3, 1, 2, 2)
    assert [tuple(r) for r in identity.conflicting(df.withColumn("label", df.case_id % 2), "h", "label").orderBy("h").collect()] == [("p", 2), ("q", 2)]


def test_fingerprint_follows_content_not_order(spark):
    df = spark.createDataFrame(ROWS, "id long, grp string, content string")
    f = lambda x: tuple(identity.fingerprint(x, ["id", "grp"]).first())
    assert f(df) == f(df.repartition(3).orderBy("content")) and f(df) != f(df.where("id > 0")) and f(df.limit(0))[0] == 0


def greedy(parts, train, validation):
    """Another way to the same allocation: total cost of every choice."""
    shares = [train, validation, 1 - train - validation]
    total = [sum(p[k] for p in parts) for k in (0, 1)]
    held, out = [[0, 0], [0, 0], [0, 0]], []
    for p in parts:
        def cost(s):
            fresh = sum(1 for k in (0, 1) if p[k] > 0 and held[s][k] == 0)
            gain = sum(((held[s][k] + p[k] - shares[s] * total[k]) ** 2 - (held[s][k] - shares[s] * total[k]) ** 2) / (shares[s] * total[k]) for k in (0, 1) if total[k])
            return (-fresh, gain, s)
        s = min(range(3), key=cost)
        held[s] = [held[s][0] + p[0], held[s][1] + p[1]]
        out.append(split.SPLITS[s])
    return out


def samples(spark, n=80, seed=0):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        y = int(r.random() < 0.7)
        rows += [(1000 * c + k, c, y) for k in range(r.randint(1, 4))]
    return rows, spark.createDataFrame(rows, "sample_id long, component long, label int")


@pytest.mark.parametrize("shuffle", ["md5", "twister"])
def test_greedy_split(spark, shuffle):
    import hashlib

    rows, df = samples(spark)
    got = {r.component: r.split for r in split.greedy_split(df, seed=3, shuffle=shuffle).collect()}
    comps = sorted({c for _, c, _ in rows})
    if shuffle == "twister":
        random.Random(3).shuffle(comps)
    else:
        comps.sort(key=lambda c: hashlib.md5(f"3:{c}".encode()).hexdigest())
    sizes = {c: [sum(1 for _, d, y in rows if d == c and y == k) for k in (0, 1)] for c in comps}
    comps.sort(key=lambda c: -sum(sizes[c]))
    assert got == dict(zip(comps, greedy([sizes[c] for c in comps], 0.7, 0.15)))


def test_rank_split_fills_all_pairs_and_leaks_nothing(spark):
    rows, df = samples(spark, 200, 5)
    out = df.join(split.rank_split(df), "component")
    assert out.count() == len(rows) and split.coverage(out).first().pairs == 6
    assert contracts.crossing(out, "component").count() == 0
    for bad in ((0.8, 0.2), (0, 0.5), (float("nan"), 0.1)):
        with pytest.raises(ValueError):
            split.rank_split(df, *bad)


def test_components_send_no_table_that_grows_to_the_driver(spark, monkeypatch):
    from corvida.session import Stage

    plans, write = [], Stage.write
    monkeypatch.setattr(Stage, "write", lambda self, df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(self, df))[1])
    # fewer nodes than a hub has edges, as the bounded table of hubs is broadcast
    rows = spark.range(240).select(F.col("id"), (F.col("id") / 4).cast("long").alias("g"), (F.col("id") % 150).alias("k"))
    linked = identity.link_components(rows, "id", ["g", "k"])
    assert linked.count() == 240
    plans.append(linked._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 3 and not any("BroadcastHashJoin" in p for p in plans)


def test_rounds_of_a_small_graph_are_written_in_few_files(spark, monkeypatch):
    from corvida.session import Stage

    files, write = [], Stage.write

    def counted(self, df):
        out = write(self, df)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(Stage, "write", counted)
    settings = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        edges = [(i, i + 1) for i in range(60) if i % 20 != 19]
        got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute(edges)
    # the first table is written before its edges are counted
    assert len(files) > 2 and max(files[1:]) == 1
