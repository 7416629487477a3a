import hashlib
import json
import random

import pytest

from corvida.__main__ import main
from corvida.plans import workflow
from corvida.sources import sinks, tables

CASE = "<case><number>{0}</number><tirads>{1}</tirads>{2}</case>"


def folder(tmp_path, cases):
    for n, category, images in cases:
        marks = "".join(f"<mark><image>{k}</image></mark>" for k in images)
        (tmp_path / f"{n}.xml").write_text(CASE.format(n, category, marks))
        for k, data in images.items():
            (tmp_path / f"{n}_{k}.jpg").write_bytes(data)
    return str(tmp_path)


def test_cohort_import(spark, tmp_path):
    src = folder(tmp_path, [(1, "2", {1: b"a"}), (2, "", {1: b"a", 2: b"b"}), (3, "3", {1: b"b"}), (4, "4a", {1: b"c", 2: b"d"}), (10, "5", {1: b"e"})])
    got = workflow.import_cohort(spark, src)
    assert sorted((r.component, r.cases) for r in got["components"].collect()) == [(1, [1, 2, 3]), (4, [4]), (10, [10])]
    assert {(r.case_id, r.label) for r in got["included"].collect()} == {(1, 0), (3, 0), (4, 1), (10, 1)}
    assert {(r.case_id, r.reason) for r in got["excluded"].collect()} == {(2, "missing_label")}
    counts = got["counts"].first()
    assert (counts.cases_all, counts.images_all, counts.components_all, counts.class_0, counts.class_1) == (5, 7, 3, 2, 3)
    files = spark.createDataFrame([("1.xml", "x", 1)], "name string, sha256 string, size long")
    with pytest.raises(ValueError):
        workflow.import_cohort(spark, src, expected=files)
    (tmp_path / "10_2.jpg").write_bytes(b"z")
    with pytest.raises(ValueError):
        workflow.import_cohort(spark, src)


def test_cohort_rejects_conflicts_and_unknown_categories(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    with pytest.raises(ValueError):
        workflow.import_cohort(spark, folder(tmp_path / "a", [(1, "2", {1: b"a"}), (2, "5", {1: b"a"})]))
    with pytest.raises(Exception, match="unsupported category"):
        workflow.import_cohort(spark, folder(tmp_path / "b", [(1, "9", {1: b"a"})]))


def rows(spark):
    r = random.Random(2)
    data = [(i, f"g{i // 2}", f"h{i}" if i % 9 else f"h{i - i % 2}", int((i // 2) % 3 > 0)) for i in range(120)]
    scores = [(s, i, min(1.0, max(0.0, 0.25 + 0.4 * y + r.random() * 0.4 - 0.05))) for s in (3, 5) for i, _, _, y in data]
    return spark.createDataFrame(data, "sample_id long, group string, content_hash string, label int"), spark.createDataFrame(scores, "seed long, sample_id long, p double")


@pytest.mark.parametrize("method", ["runs", "greedy", "rank"])
def test_split_select_evaluate_measure(spark, tmp_path, method):
    samples, scores = rows(spark)
    manifest = workflow.create_split(samples, method=method)
    assert manifest.count() == 120
    by_model = scores.selectExpr("concat('m', seed) AS model", "sample_id", "p")
    record = workflow.selection_record(manifest, by_model)
    assert set(record["decisions"]) == {"m3", "m5", "ensemble"}
    path = str(tmp_path / "selection.json")
    sinks.write_report(record, path)
    assert workflow.load_selection(path, manifest, by_model) == record
    got = {r.model: r for r in workflow.evaluate(manifest, by_model, selection=record).collect()}
    assert set(got) == set(record["decisions"]) and all(r.roc_auc > 0.9 for r in got.values())
    assert {r.model for r in workflow.evaluate(manifest, by_model, fixed=0.5).collect()} == set(got)
    for bad in ({}, {"fixed": 0.5, "selection": record}, {"fixed": 1.5}, {"selection": record | {"manifest": "0" * 64}}):
        with pytest.raises(ValueError):
            workflow.evaluate(manifest, by_model, **bad)
    with pytest.raises(ValueError):
        workflow.load_selection(path, manifest, by_model.withColumn("p", by_model.p / 2))
    with pytest.raises(ValueError):
        workflow.evaluate(manifest, by_model.where("sample_id > 3"), fixed=0.5)
    out = workflow.measure(manifest, scores, 30, 4)
    page = sinks.measurement_html(out, "measured", {"manifest": "0" * 64})
    assert page.count("<h2>") == 6 and "seed_3" in page
    assert out["per_seed"].count() == 2 and {r.metric for r in out["across_seeds"].collect()} == {"selected", "fixed", "delta", "over_baseline"}
    assert {r.comparator for r in out["intervals"].collect()} == {"selected", "fixed", "delta", "over_baseline"}
    assert all(r.valid == 30 and r.low <= r.high for r in out["intervals"].collect())
    with pytest.raises(ValueError):
        workflow.measure(manifest, scores.where("seed = 3"), 30, 4)


def test_sidecar(spark, tmp_path):
    samples, _ = rows(spark)
    manifest = workflow.create_split(samples)
    path = str(tmp_path / "m.json")
    record = workflow.save_sidecar(path, b"weights", manifest, 3, epochs=2)
    assert workflow.load_sidecar(path, b"weights", manifest) == record
    for bad in ((b"other", None), (None, manifest.where("sample_id > 0"))):
        with pytest.raises(ValueError):
            workflow.load_sidecar(path, *bad)
    history = workflow.load_history(spark, path)
    assert history.count() == manifest.where("split != 'test'").select("content_hash").distinct().count()
    assert record["inputs"] == [1] and record["training"] == {"epochs": 2}
    with pytest.raises(ValueError):
        workflow.save_sidecar(str(tmp_path / "n.json"), b"w", manifest, 3, inputs=(0,))
    stored = str(tmp_path / "split")
    sinks.publish_split(manifest, stored)
    assert workflow.load_split(spark, stored, record["manifest"]).count() == manifest.count()
    with pytest.raises(ValueError):
        workflow.load_split(spark, stored, "0" * 64)
    with open(path) as f:
        changed = json.load(f) | {"trained": "0" * 64}
    with open(path, "w") as f:
        json.dump(changed, f)
    with pytest.raises(ValueError):
        workflow.load_history(spark, path)


def test_cohort_is_published_whole(spark, tmp_path):
    (tmp_path / "src").mkdir()
    src = folder(tmp_path / "src", [(1, "2", {1: b"a"}), (2, "", {1: b"b"}), (3, "5", {1: b"c"})])
    files = [{"name": p.name, "sha256": hashlib.sha256(p.read_bytes()).hexdigest(), "size": p.stat().st_size} for p in (tmp_path / "src").iterdir()]
    stated = tmp_path / "files.json"
    stated.write_text(json.dumps(files))
    cohort = workflow.import_cohort(spark, src, expected=tables.expected_files(spark, str(stated)))
    for inside in (f"{src}/out", str(tmp_path), f"{src}/../src/x"):
        with pytest.raises((ValueError, FileExistsError)):
            workflow.publish_cohort(cohort, inside, src)
    target = tmp_path / "cohort"
    (tmp_path / "src" / "3_2.jpg").write_bytes(b"d")
    with pytest.raises(ValueError):
        workflow.publish_cohort(cohort, str(target), src)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["files.json", "src"]
    (tmp_path / "src" / "3_2.jpg").unlink()
    workflow.publish_cohort(cohort, str(target), src)
    assert sorted(p.name for p in target.iterdir()) == ["components", "counts", "excluded", "included", "record"]
    with pytest.raises(FileExistsError):
        workflow.publish_cohort(cohort, str(target), src)
    for bad in ([files[0] | {"x": 1}], [files[0], files[0]], [files[0] | {"sha256": "0"}], [files[0] | {"size": 0}]):
        stated.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            tables.expected_files(spark, str(stated))


def test_fixture_and_report(spark, tmp_path):
    samples = [{"source": f"{s}/{i}.png", "group": f"{s}{i}", "label": i % 2, "split": s, "sha256": hashlib.sha256(f"{s}{i}".encode()).hexdigest()} | ({} if s == "train" else {"probability": i / 4}) for s in ("train", "validation", "test") for i in range(4)]
    path = tmp_path / "fixture.json"

    def write(changes, **doc):
        path.write_text(json.dumps({"kind": "made up", "class_names": ["a", "b"], "samples": [x | changes.get(i, {}) for i, x in enumerate(samples)]} | doc))
        return hashlib.sha256(path.read_bytes()).hexdigest()

    rows = tables.fixture(spark, str(path), write({}))
    assert rows.count() == 12 and rows.where("p IS NULL").count() == 4
    with pytest.raises(ValueError):
        tables.fixture(spark, str(path), "0" * 64)
    for changes, doc in (({5: {"probability": 2}}, {}), ({5: {"probability": None}}, {}), ({0: {"source": "../x"}}, {}), ({0: {"group": "test1"}}, {}), ({0: {"sha256": samples[1]["sha256"]}}, {}), ({0: {"label": 1}, 2: {"label": 1}}, {}), ({}, {"class_names": ["a", "a"]})):
        write(changes, **doc)
        with pytest.raises(ValueError):
            tables.fixture(spark, str(path))
    page = sinks.report_html("<t>", {"<a>": rows.limit(2), "note": "<script>"}, {"plan": "<d>"})
    assert "<script>" not in page and "&lt;script&gt;" in page and "&lt;d&gt;" in page and "—" in page


def test_command_line(spark, tmp_path, capsys):
    samples, scores = rows(spark)
    samples.write.parquet(str(tmp_path / "rows"))
    scores.selectExpr("concat('m', seed) AS model", "sample_id", "p").write.parquet(str(tmp_path / "scores"))
    p = lambda n: str(tmp_path / n)
    main(["split", p("rows"), p("split")])
    main(["select", p("split"), p("scores"), p("s.json")])
    split = spark.read.parquet(p("split"))
    workflow.trained_history(split, "m3").write.parquet(p("h3"))
    workflow.trained_history(split, "m5").write.parquet(p("h5"))
    with pytest.raises(SystemExit):
        main(["evaluate", p("split"), p("scores"), p("e.json"), "--selection", p("s.json")])
    with pytest.raises(ValueError, match="without a history"):
        main(["evaluate", p("split"), p("scores"), p("e.json"), "--selection", p("s.json"), "--history", p("h3")])
    split.selectExpr("'m3' AS model", "content_hash").write.parquet(p("seen"))
    with pytest.raises(ValueError, match="saw test content"):
        main(["evaluate", p("split"), p("scores"), p("e.json"), "--selection", p("s.json"), "--history", p("seen"), p("h5")])
    main(["evaluate", p("split"), p("scores"), p("e.json"), "--selection", p("s.json"), "--history", p("h3"), p("h5")])
    with open(p("e.json")) as f:
        assert len(json.load(f)["metrics"]) == 3
    main(["ensemble", p("split"), p("scores"), p("n.json"), "--threshold", "0.5", "--history", p("h3"), p("h5")])
    scores.where("seed = 3").selectExpr("'m' AS model", "sample_id", "p").write.parquet(p("alone"))
    with pytest.raises(SystemExit):
        main(["ensemble", p("split"), p("alone"), p("a.json"), "--threshold", "0.5", "--history", p("h3")])


def test_class_folders_meet_their_groups(spark, tmp_path):
    root = tmp_path / "images"
    for name in ("a/1.jpg", "a/2.png", "b/3.jpg"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(name.encode())
    alone = {r.sample_id: (r.group, r.label) for r in workflow.import_classes(spark, str(root), independent=True).collect()}
    assert alone == {"a/1.jpg": ("a/1.jpg", 0), "a/2.png": ("a/2.png", 0), "b/3.jpg": ("b/3.jpg", 1)}
    for both in ({}, {"groups": "x", "independent": True}):
        with pytest.raises(ValueError):
            workflow.import_classes(spark, str(root), **both)
    named = tmp_path / "groups.csv"
    named.write_text("path,group\na/1.jpg,p\na/2.png,p\nb/3.jpg, q \n")
    assert {r.sample_id: r.group for r in workflow.import_classes(spark, str(root), str(named)).collect()} == {"a/1.jpg": "p", "a/2.png": "p", "b/3.jpg": "q"}
    for rows in ("a/1.jpg,p\n", "a/1.jpg,p\na/2.png,p\nb/3.jpg,q\nb/4.jpg,q\n", "a/1.jpg,p\na/2.png,p\nb/../b/3.jpg,q\n"):
        named.write_text("path,group\n" + rows)
        with pytest.raises(ValueError):
            workflow.import_classes(spark, str(root), str(named))


def test_split_is_bound_to_its_cohort(spark, tmp_path):
    (tmp_path / "src").mkdir()
    src = folder(tmp_path / "src", [(n, "2" if n % 2 else "5", {1: f"image {n}".encode()}) for n in range(1, 41)] + [(50, "", {1: b"left out"})])
    p = lambda n: str(tmp_path / n)
    main(["cohort", src, p("cohort")])
    cohort = workflow.load_cohort(spark, p("cohort"))
    rows = workflow.cohort_samples(cohort)
    rows.write.parquet(p("rows"))
    main(["split", p("rows"), p("split"), "--cohort", p("cohort")])
    assert spark.read.parquet(p("split")).count() == 40
    faults = {
        "in_split": rows.where("sample_id != '3_1.jpg'"),
        "in_cohort": rows.unionByName(rows.limit(1).selectExpr("'99_1.jpg' AS sample_id", "group", "content_hash", "label", "size")),
        "group": rows.selectExpr("sample_id", "IF(sample_id = '4_1.jpg', 'x', group) AS group", "content_hash", "label", "size"),
        "label": rows.selectExpr("sample_id", "group", "content_hash", "IF(sample_id = '4_1.jpg', 0, label) AS label", "size"),
        "sha256": rows.selectExpr("sample_id", "group", "IF(sample_id = '4_1.jpg', 'x', content_hash) AS content_hash", "label", "size"),
        "size": rows.selectExpr("sample_id", "group", "content_hash", "label", "IF(sample_id = '4_1.jpg', 1L, size) AS size"),
    }
    for rule, changed in faults.items():
        with pytest.raises(ValueError, match=f"differ from the cohort.*'{rule}'"):
            workflow.create_split(changed, cohort=cohort)
    record = workflow.cohort_record(cohort)
    workflow.check_cohort(cohort, record)
    for change in ({"kind": "other"}, {"class_names": ["high", "low"]}, {"categories": {"2": 1}}, {"included": "0" * 64}, {"excluded": "0" * 64}, {"schema_version": 2}, {"more": 1}):
        with pytest.raises(ValueError, match=next(iter(change))):
            workflow.create_split(rows, cohort=cohort, record=record | change)


@pytest.mark.parametrize("name", ["50.xml", "50_1.jpg", "3.xml", "3_1.jpg"])
def test_any_file_that_changes_during_the_import_stops_it(spark, tmp_path, name):
    (tmp_path / "src").mkdir()
    src = folder(tmp_path / "src", [(3, "2", {1: b"a"}), (4, "5", {1: b"b"}), (50, "", {1: b"c"})])
    cohort = workflow.import_cohort(spark, src)
    at = tmp_path / "src" / name
    at.write_bytes(at.read_bytes() + b" ")
    with pytest.raises(ValueError, match="changed during the import"):
        workflow.publish_cohort(cohort, str(tmp_path / "cohort"), src)
    assert not (tmp_path / "cohort").exists()


def test_evaluation_and_measurement_are_bound_to_models_and_runs(spark):
    samples, scores = rows(spark)
    manifest = workflow.create_split(samples)
    by_model = scores.selectExpr("concat('m', seed) AS model", "sample_id", "p")
    own = workflow.manifest_fingerprint(manifest)
    models = lambda *rows: spark.createDataFrame(rows, "model string, model_sha256 string, class_names array<string>, manifest string")
    good = [("m3", "3" * 64, ["0", "1"], own), ("m5", "5" * 64, ["0", "1"], own)]
    assert workflow.evaluate(manifest, by_model, 0.5, models=models(*good)).count() == 3
    for rule, bad in {"classes": ("m5", "5" * 64, ["1", "0"], own), "manifest": ("m5", "5" * 64, ["0", "1"], "0" * 64), "own_content": ("m5", "3" * 64, ["0", "1"], own), "digest": ("m5", "5", ["0", "1"], own), "models and scores": ("m6", "5" * 64, ["0", "1"], own)}.items():
        with pytest.raises(ValueError, match=rule):
            workflow.evaluate(manifest, by_model, 0.5, models=models(good[0], bad))
    bound = "seed long, model_sha256 string, selection_sha256 string, manifest_sha256 string, threshold double"
    fits = spark.createDataFrame([(s, f"{s}" * 64, "a" * 64, own, 0.4) for s in (3, 5)], bound)
    reports = fits.selectExpr("*", "'test' AS split", "'validation_selection' AS mode")
    told = scores.join(manifest.where("split = 'test'").drop("split"), "sample_id")
    history = spark.createDataFrame([(s, e, 0.5, 0.5) for s in (3, 5) for e in (1, 2)], "run long, epoch int, loss double, val_loss double")
    runs = {"reports": reports, "fits": fits, "reported": told, "histories": history}
    assert workflow.measure(manifest, scores, 20, 4, **runs)["per_seed"].count() == 2
    for match, changed in {
        "model_sha256": {"reports": reports.withColumn("model_sha256", reports.selection_sha256)},
        "'mode'": {"reports": reports.selectExpr("* EXCEPT (mode)", "'fixed' AS mode")},
        "one_fit": {"fits": fits.where("seed = 3")},
        "another split": {"reports": reports.selectExpr("* EXCEPT (manifest_sha256)", "'x' AS manifest_sha256"), "fits": fits.selectExpr("* EXCEPT (manifest_sha256)", "'x' AS manifest_sha256")},
        "coverage": {"reported": told.where("seed = 3 OR sample_id % 2 = 0")},
        "'label'": {"reported": told.withColumn("label", 1 - told.label)},
        "epochs": {"histories": history.where("epoch = 2")},
        "together": {"fits": None},
    }.items():
        with pytest.raises(ValueError, match=match):
            workflow.measure(manifest, scores, 20, 4, **runs | changed)


def test_training_by_the_command_line(spark, tmp_path):
    import numpy as np

    r = np.random.default_rng(4)
    data = [(i, [float(x) for x in r.normal(size=3) + (i % 2)], i % 2, ("train", "validation", "test")[i % 3]) for i in range(240)]
    spark.createDataFrame(data, "id long, x array<double>, y int, split string").write.parquet(str(tmp_path / "rows"))
    main(["train", str(tmp_path / "rows"), str(tmp_path / "fits"), "--seeds", "1", "2", "--epochs", "6"])
    got = spark.read.parquet(str(tmp_path / "fits"))
    assert {r.seed for r in got.collect()} == {1, 2} and got.where("best").where("size(weights) = 4").count() == 2


def test_class_folders_by_the_command_line(spark, tmp_path):
    for name in ("in/a/1.jpg", "in/b/2.jpg"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    main(["classes", str(tmp_path / "in"), str(tmp_path / "rows"), "--independent"])
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 2
