import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corvida.llm import hardneg, queries

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, scale=256, positives=5, negatives=5):
    good = [(i, lab, [int(np.floor(scale * x)) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, lab, v in good:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), b, other) for b, other, w in good if b != a and len(w) == len(v))
        for s, b, _ in [x for x in scored if x[2] == lab][:positives]:
            fits = [(n, t) for t, n, other in scored if other != lab and 80 * -s <= 100 * -t <= 100 * -s][:negatives]
            out += [(a, b, k + 1, n, -s, -t) for k, (n, t) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in hardneg.hard_negatives(df, F.col("vec_id") % 100 == 0, scale=256.0, **kw).collect())


def vectors(seed, n, dims=8, hot=0.4):
    r = np.random.default_rng(seed)
    return [(i, 1 if r.random() < hot else int(r.integers(0, 4)), [float(np.float32(x)) for x in r.choice([0.1, 0.11, 0.2, -0.05, 0.3], size=dims)]) for i in range(n)]


def test_against_brute_force_with_ties_and_a_hot_label(spark):
    rows = vectors(1, 900)
    assert mined(spark, rows) == brute(rows)


def test_small_blocks_and_chunks_give_the_same(spark, monkeypatch):
    rows = vectors(2, 700)
    monkeypatch.setattr(hardneg, "BLOCK_ROWS", 3)
    want = brute(rows)
    assert len(want) and mined(spark, rows) == want


def test_odd_rows(spark):
    rows = vectors(3, 320)
    rows += [(None, 1, rows[0][2]), (400, None, rows[1][2]), (500, 1, None), (600, 1, [0.1, None]), (700, 1, [float("nan")] * 8), (800, 2, [float("inf")] * 8)]
    # other lengths meet only their own; empty vectors score 0 with one another
    rows += [(900, 1, [0.5, 0.5]), (901, 1, [0.4, 0.4]), (902, 2, [0.35, 0.4]), (1000, 1, []), (1001, 1, []), (1002, 3, []), (-100, 1, rows[5][2]), (1100, 2, [-0.3] * 8)]
    # a repeated row is another candidate, an anchor that repeats is another anchor
    rows += [rows[7], rows[11], rows[200], (300, 0, rows[3][2])]
    got = mined(spark, rows)
    assert got == brute(rows) and {900, 1000, -100, 200} <= {r[0] for r in got}


def test_scores_beyond_doubles_are_exact_and_beyond_longs_refused(spark):
    big = float(1 << 22)
    rows = [(0, 1, [big, 1.0]), (1, 1, [big, 1.0]), (2, 1, [big, 0.5]), (3, 2, [big - 1 / 256, 1.0]), (4, 2, [big - 1 / 128, 1.0]), (5, 2, [1.0, 1.0])]
    got = mined(spark, rows)
    assert got == brute(rows) and got[0][4] > 1 << 53
    with pytest.raises(Exception, match="exceeds 64 bits"):
        mined(spark, [(0, 1, [1e20]), (1, 1, [1e20])])


def test_none_to_mine(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []
    assert mined(spark, [(100, 1, [1.0])]) == []


def test_query_with_clashing_columns_and_its_sql(spark, tmp_path):
    rows = [(*x, "x", 0) for x in vectors(4, 600, hot=0.1)]
    spark.createDataFrame(rows, SCHEMA + ", v string, anchor int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_hard_negatives(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(queries.OP11_SQL).fetchdf()
    have = got.toPandas()[list(want.columns)]
    assert len(want) > 20 and sorted(map(tuple, have.values.tolist())) == sorted(map(tuple, want.values.tolist()))
    assert dict(got.dtypes)["rank"] == "int"
