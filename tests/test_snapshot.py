import pytest
from pyspark.sql import functions as F

from corvida.operators import binding, snapshot

FILES = "folder long, name string, sha256 string, size long"


def inventory(n, change=None, drop=(), add=()):
    rows = [(i % 7, f"f{i}", f"{i:064d}", i) for i in range(n) if i not in drop]
    return [r if change is None or r[3] not in change else (*r[:2], change[r[3]], r[3]) for r in rows] + [(9, f"new{i}", "x", 1) for i in add]


def written(spark, tmp_path, name, rows, depth=None):
    return snapshot.write_snapshot(spark.createDataFrame(rows, FILES), f"{tmp_path}/{name}", depth)


def test_only_branches_that_differ_are_read(spark, tmp_path):
    n = 9000
    depth = written(spark, tmp_path, "a", inventory(n))
    assert depth == 2
    written(spark, tmp_path, "b", inventory(n, {5: "other", 6: None}, drop=(70,), add=(1,)), depth)
    changes, read = snapshot.snapshot_changes(spark, f"{tmp_path}/a", f"{tmp_path}/b", depth)
    assert sorted(map(tuple, changes.collect())) == [(0, "f70", "missing"), (5, "f5", "changed"), (6, "f6", "changed"), (9, "new1", "extra")]
    # four leaves of 256 prefixes
    assert 0 < read < n / 30
    same, none = snapshot.snapshot_changes(spark, f"{tmp_path}/a", f"{tmp_path}/a", depth)
    assert none == 0 and same.count() == 0


@pytest.mark.parametrize("named", [1, 1000])
def test_many_changes_equal_the_plain_comparison(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(snapshot, "NAMED", named)
    a, b = inventory(700, drop=range(0, 700, 9)), inventory(700, {i: "z" for i in range(0, 700, 5)}, drop=range(0, 700, 8), add=range(20))
    written(spark, tmp_path, "a", a, 2)
    written(spark, tmp_path, "b", b, 2)
    changes, _ = snapshot.snapshot_changes(spark, f"{tmp_path}/a", f"{tmp_path}/b", 2)
    want = binding.file_faults(spark.createDataFrame(a, FILES), spark.createDataFrame(b, FILES))
    assert sorted(map(tuple, changes.collect())) == sorted(map(tuple, want.collect()))


def test_empty_null_and_repeated(spark, tmp_path):
    written(spark, tmp_path, "none", [], 1)
    written(spark, tmp_path, "nulls", [(1, "a", None, None), (None, "b", "x", 1)], 1)
    changes, _ = snapshot.snapshot_changes(spark, f"{tmp_path}/none", f"{tmp_path}/nulls", 1)
    assert {(r.name, r.rule) for r in changes.collect()} == {("a", "extra"), ("b", "extra")}
    assert snapshot.snapshot_changes(spark, f"{tmp_path}/none", f"{tmp_path}/none", 1)[0].count() == 0
    with pytest.raises(ValueError, match="repeated"):
        written(spark, tmp_path, "twice", [(1, "a", "x", 1), (1, "a", "y", 1)])
    with pytest.raises(FileExistsError):
        written(spark, tmp_path, "none", [], 1)


def test_file_faults_count_what_cannot_be_compared(spark):
    f = lambda rows: spark.createDataFrame(rows, "folder long, name string, sha256 string")
    got = binding.file_faults(f([(1, "a", None), (1, "b", "x"), (1, "c", "x"), (1, "d", None), (1, "e", "x"), (1, "e", "x"), (1, "g", "x")]), f([(1, "a", "x"), (1, "b", None), (1, "c", "x"), (1, "d", None), (1, "e", "x"), (2, "h", "x")]))
    assert sorted(map(tuple, got.collect())) == [(1, "a", "changed"), (1, "b", "changed"), (1, "d", "changed"), (1, "e", "repeated"), (1, "g", "missing"), (2, "h", "extra")]


def test_tensor_batches_are_whole_and_repeatable(spark):
    rows = spark.range(1000).select("id", F.array(*(F.col("id") * k for k in range(3))).cast("array<double>").alias("v"), (F.col("id") % 2).alias("y"))
    of = lambda df, **kw: sorted((r.shard, r.batch, r.n, tuple(r.ids), tuple(r.x), tuple(r.y)) for r in binding.tensor_batches(df, 16, 3, "id", "v", "y", **kw).collect())
    first = of(rows, seed=4, shards=5)
    assert first == of(rows.repartition(7), seed=4, shards=5)
    assert sorted(i for b in first for i in b[3]) == list(range(1000))
    for shard, batch, n, ids, x, y in first:
        assert len(ids) == len(y) == n and len(x) == 3 * n and x == tuple(float(i * k) for i in ids for k in range(3)) and y == tuple(float(i % 2) for i in ids)
        assert n == 16 or batch == max(b[1] for b in first if b[0] == shard)
    second = of(rows, seed=4, epoch=2, shards=5)
    assert [b[3] for b in second] != [b[3] for b in first] and sorted(i for b in second for i in b[3]) == list(range(1000))
    assert of(rows.limit(0), seed=1) == []
    for bad in ([(1, [1.0], 1)], [(1, [1.0, None, 2.0], 1)], [(None, [1.0, 2.0, 3.0], 1)], [(1, None, 1)], [(1, [1.0, 2.0, 3.0], None)]):
        with pytest.raises(ValueError, match="no tensor"):
            binding.tensor_batches(spark.createDataFrame(bad, "id long, v array<double>, y int"), 4, 3, "id", "v", "y", 1)
