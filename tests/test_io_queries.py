import hashlib
import os

import duckdb
import pytest

import __spark_entry__
from corvida.operators import scoring
from corvida.plans import catalog, checks
from corvida.sources import sinks, tables
from corvida.streaming.scores import running_confusion

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL | checks.SQL))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    rows = (catalog.QUERIES | checks.QUERIES)[name](spark, DATA)
    want = db.sql(f"SELECT {', '.join(rows.columns)} FROM ({(catalog.SQL | checks.SQL)[name]})").fetchall()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, rows.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("kind", ["chained", "conflicting"])
def test_lopsided_splits_are_judged_as_their_sql_does(spark, tmp_path, kind):
    # chained: copies under ids shifted by half a case link all cases, so one component is all of the training part
    db = duckdb.connect()
    for name in ("documents", "labels"):
        rows = f"SELECT * FROM '{DATA}/{name}.parquet'"
        if kind == "chained":
            rows += f" UNION ALL SELECT * REPLACE (doc_id + 202 AS doc_id) FROM '{DATA}/{name}.parquet'"
        elif name == "documents":
            rows += f" UNION ALL SELECT * REPLACE (doc_id + 400 AS doc_id) FROM '{DATA}/{name}.parquet' WHERE doc_id < 40"
        else:
            rows += f" UNION ALL SELECT * REPLACE (doc_id + 400 AS doc_id, 1 - quality AS quality) FROM '{DATA}/{name}.parquet' WHERE doc_id < 40"
        db.sql(f"COPY ({rows}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    key = lambda r: tuple((x is None, x) for x in r)
    for name in ("evaluation_report", "measurement"):
        rows = checks.QUERIES[name](spark, str(tmp_path))
        want = db.sql(f"SELECT {', '.join(rows.columns)} FROM ({checks.SQL[name]})").fetchall()
        assert sorted(map(tuple, rows.collect()), key=key) == sorted(want, key=key)
        assert want or kind == "chained"


@pytest.mark.parametrize("kind", ["unlabelled", "few", "missing"])
def test_splits_without_labels_validation_or_texts_are_measured_as_their_sql_does(spark, tmp_path, kind):
    # few: four components, of which three are training and one is test; missing: texts that are null are no common content
    db = duckdb.connect()
    docs, labels = f"SELECT * FROM '{DATA}/documents.parquet'", f"SELECT * FROM '{DATA}/labels.parquet'"
    if kind == "unlabelled":
        labels = labels.replace("*", "* REPLACE (doc_id + 100000 AS doc_id)")
    elif kind == "few":
        docs = docs.replace("*", "* REPLACE (text || ' case ' || doc_id // 4 AS text)") + " WHERE doc_id < 16"
        labels = "SELECT range AS doc_id, CAST(range % 2 AS INTEGER) AS quality FROM range(16)"
    else:
        docs = docs.replace("*", "* REPLACE (CASE WHEN doc_id % 4 = 0 THEN NULL ELSE text END AS text)")
        labels = "SELECT doc_id, CAST(doc_id // 4 % 2 AS INTEGER) AS quality FROM (SELECT * FROM range(200) t(doc_id))"
    for name, rows in (("documents", docs), ("labels", labels)):
        db.sql(f"COPY ({rows}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    key = lambda r: tuple((x is None, x) for x in r)
    names = {"unlabelled": ("measurement", "group_bootstrap"), "few": ("measurement", "paired_intervals", "group_bootstrap", "flagship", "paired_deltas"), "missing": ("measurement",)}
    for name in names[kind]:
        rows = (catalog.QUERIES | checks.QUERIES)[name](spark, str(tmp_path))
        want = db.sql(f"SELECT {', '.join(rows.columns)} FROM ({(catalog.SQL | checks.SQL)[name]})").fetchall()
        assert sorted(map(tuple, rows.collect()), key=key) == sorted(want, key=key)
        assert name != "measurement" or len(want) == {"unlabelled": 5, "few": 29, "missing": 71}[kind]


def test_entry_and_keys(spark):
    assert __spark_entry__.entry(spark).count() == 6
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_class_directories_and_inventory(spark, tmp_path):
    for name in ("b/x/2.PNG", "b/3.jpg", "a/1.jpeg", "a/skip.txt"):
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode())
    got = {r.source: (r.label, r.sha256, r["size"]) for r in tables.class_directories(spark, str(tmp_path / "root")).collect()}
    assert {k: v[0] for k, v in got.items()} == {"b/x/2.PNG": 1, "b/3.jpg": 1, "a/1.jpeg": 0}
    assert got["b/3.jpg"][1] == hashlib.sha256(b"b/3.jpg").hexdigest()
    flat = tmp_path / "flat"
    flat.mkdir()
    case = "<case><number>{0}</number><tirads>{1}</tirads><mark><image>2</image></mark><mark><image>1</image></mark></case>"
    (flat / "7.xml").write_text(case.format(7, "4a"))
    (flat / "10.xml").write_text("﻿" + case.format(10, ""))
    (flat / "7_1.jpg").write_bytes(b"x")
    rows = {r.name: (r.case_id, r.view) for r in tables.inventory(spark, str(flat)).collect()}
    assert rows == {"7.xml": (7, None), "10.xml": (10, None), "7_1.jpg": (7, 1)}
    cases = {r.case_id: (r.category, r.views) for r in tables.case_files(spark, str(flat)).collect()}
    assert cases == {7: ("4a", [1, 2]), 10: (None, [1, 2])}
    (flat / "11.xml").write_text(case.format(12, "2"))
    with pytest.raises(ValueError):
        tables.case_files(spark, str(flat))
    (flat / "07.xml").write_text("x")
    with pytest.raises(ValueError):
        tables.inventory(spark, str(flat))


def test_group_csv(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_text("﻿path,group\na/1.jpg, g1 \nb/2.jpg,g2\n", encoding="utf-8")
    assert sorted(map(tuple, tables.group_csv(spark, str(path)).collect())) == [("a/1.jpg", "g1"), ("b/2.jpg", "g2")]
    for text in ("path,grp\na,b\n", "path,group\na,\n", "path,group\na,b\na,c\n"):
        path.write_text(text)
        with pytest.raises(ValueError):
            tables.group_csv(spark, str(path))


def test_publish_is_whole_and_never_overwrites(spark, tmp_path):
    import itertools

    rows = [(i, f"g{i}", f"h{i}", y, s) for i, (y, s) in enumerate(itertools.product((0, 1), ("train", "validation", "test")))]
    df = spark.createDataFrame(rows, "sample_id long, group string, content_hash string, label int, split string")
    target = str(tmp_path / "split")
    with pytest.raises(ValueError):
        sinks.publish_split(df.where("label = 0"), target)
    assert not os.path.exists(target) and not os.listdir(tmp_path)
    sinks.publish_split(df, target)
    assert spark.read.parquet(target).where("split = 'test'").count() == 2
    with pytest.raises(FileExistsError):
        sinks.publish_split(df, target)
    report = str(tmp_path / "r.json")
    assert sinks.write_report({"a": 1}, report) == sinks.write_report({"a": 1}, report)
    for value in ({"a": 2}, {"a": float("nan")}):
        with pytest.raises(ValueError):
            sinks.write_report(value, report)
    html = sinks.metrics_html(spark.createDataFrame([("<b>", 0.5, None)], "model string, p double, q double"), "<t>")
    assert "&lt;b&gt;" in html and "0.5000" in html and "—" in html and "<b>" not in html
    assert sinks.metrics_json(df.limit(1))[0]["sample_id"] in range(6)


def test_scorer_registry(spark):
    rows = spark.createDataFrame([(i, [float(i % 2), 1.0], i % 2) for i in range(40)], "id long, x array<double>, y int")
    got = {r.id: r.p for r in scoring.apply_scorer(rows, scoring.fit_scorer(rows)).collect()}
    assert all((got[i] > 0.5) == bool(i % 2) for i in got) and "logistic" in scoring.SCORERS


def test_stream_counts_each_sample_once(spark, tmp_path):
    rows = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00'::timestamp AS ts, 'm' AS model, id AS sample_id, CAST(id % 2 AS INT) AS y, CAST(id % 2 AS DOUBLE) AS p FROM range(10)")
    rows.union(rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = running_confusion(stream, {"m": 0.5}).writeStream.outputMode("update").format("memory").queryName("confusion").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("confusion").collect()
    assert [(r.n, r.tn, r.tp, r.fp, r.fn) for r in got] == [(10, 5, 5, 0, 0)]
