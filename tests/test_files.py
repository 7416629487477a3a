import hashlib
import os
import threading

import pytest

from corvida.operators import lineage
from corvida.plans import workflow
from corvida.sources import files, store

CASE = "<case><number>{0}</number><tirads>{1}</tirads>{2}</case>"


def folder(root, cases):
    for n, category, images in cases:
        (root / f"{n}.xml").write_text(CASE.format(n, category, "".join(f"<mark><image>{k}</image></mark>" for k in images)))
        for k, data in images.items():
            (root / f"{n}_{k}.jpg").write_bytes(data)
    return str(root)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def tree(root, names):
    for name, data in names.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)
    return str(root)


def test_listing_tells_links_from_files(spark, tmp_path):
    root = tree(tmp_path / "r", {"a/b/c.txt": b"123", "d.txt": b""})
    os.symlink("/nowhere", f"{root}/a/gone")
    os.symlink(f"{root}/a", f"{root}/again")
    os.mkfifo(f"{root}/a/pipe")
    got = {r.path: (r.kind, r.size, r.target) for r in files.listing(spark, root).collect()}
    assert got == {"a": ("folder", None, None), "a/b": ("folder", None, None), "a/b/c.txt": ("file", 3, None), "a/gone": ("link", None, "/nowhere"), "a/pipe": ("other", None, None), "again": ("link", None, f"{root}/a"), "d.txt": ("file", 0, None)}
    assert {r.path for r in files.listing(spark, f"file://{root}").collect()} == set(got)
    with pytest.raises(ValueError, match="links or odd"):
        files.refuse_links(spark, root)
    with pytest.raises(ValueError, match="is a link"):
        files.refuse_links(spark, f"{root}/again")
    files.refuse_links(spark, f"{root}/a/b")
    (tmp_path / "none").mkdir()
    assert files.listing(spark, str(tmp_path / "none")).count() == 0


def test_imports_refuse_links(spark, tmp_path):
    (tmp_path / "src").mkdir()
    src = folder(tmp_path / "src", [(1, "2", {1: b"a"}), (2, "5", {1: b"b"})])
    workflow.import_cohort(spark, src)
    os.symlink(f"{src}/1_1.jpg", f"{src}/1_2.jpg")
    with pytest.raises(ValueError, match="links or odd"):
        workflow.import_cohort(spark, src)
    root = tree(tmp_path / "classes", {"a/1.jpg": b"1", "b/2.jpg": b"2"})
    os.symlink(f"{root}/a", f"{root}/b/more")
    with pytest.raises(ValueError, match="links or odd"):
        workflow.import_classes(spark, root, independent=True)


def test_files_are_published_whole(spark, tmp_path):
    data = {f"in/{i}.bin": os.urandom(10 + i) for i in range(30)} | {"in/large.bin": os.urandom(3 * files.BLOCK + 7)}
    source = tree(tmp_path / "s", data)
    rows = [(name, f"out/{k % 3}/{name[3:]}", sha(x), len(x)) for k, (name, x) in enumerate(data.items())]
    df = lambda rows: spark.createDataFrame(rows, "source string, path string, sha256 string, size long")
    target = str(tmp_path / "t")
    changed = [(a, b, "0" * 64 if a == "in/3.bin" else h, n) for a, b, h, n in rows]
    for bad, match in ((changed, "changed on the way"), (rows + [rows[0][:1] + ("OUT/0/0.bin",) + rows[0][2:]], "collide"), (rows + [rows[0][:1] + ("../x",) + rows[0][2:]], "unsafe"), (rows + [("../s/in/1.bin", "y", "", 0)], "unsafe"), ([(a, b, h, None) for a, b, h, n in rows], "changed on the way")):
        with pytest.raises(ValueError, match=match):
            files.publish_files(df(bad), source, target)
        assert sorted(p.name for p in tmp_path.iterdir()) == ["s"]
    with pytest.raises(Exception):
        files.publish_files(df(rows + [("in/none.bin", "z", "", 0)]), source, target)
    with pytest.raises(ValueError, match="share the names"):
        files.publish_files(df(rows), source, target, {"out": df(rows)})
    for inside in (source + "/t", str(tmp_path)):
        with pytest.raises((ValueError, FileExistsError)):
            files.publish_files(df(rows), source, inside)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["s"]
    files.publish_files(df(rows).repartition(4), f"file://{source}", target, {"table": df(rows)})
    found = {r.path: r.size for r in files.listing(spark, target + "/out").where("kind = 'file'").collect()}
    assert found == {b.removeprefix("out/"): n for _, b, _, n in rows}
    assert all((tmp_path / "t" / b).read_bytes() == data[a] for a, b, _, _ in rows) and spark.read.parquet(target + "/table").count() == len(rows)
    with pytest.raises(FileExistsError):
        files.publish_files(df(rows), source, target)


def test_a_split_and_its_files(spark, tmp_path):
    source = tree(tmp_path / "in", {f"{'ab'[i % 2]}/{i}.jpg": b"image %d" % i for i in range(40)})
    rows = workflow.import_classes(spark, source, independent=True)
    manifest = workflow.create_split(rows)
    target = str(tmp_path / "out")
    (tmp_path / "in/a/4.jpg").write_bytes(b"other")
    with pytest.raises(ValueError, match="changed on the way"):
        workflow.publish_split_files(manifest, rows, source, target, ("a", "b"))
    (tmp_path / "in/a/4.jpg").write_bytes(b"image 4")
    workflow.publish_split_files(manifest, rows, source, target, ("a", "b"))
    for r in spark.read.parquet(f"{target}/manifest").collect():
        assert r.path == f"{r.split}/{r.sample_id}" and sha((tmp_path / "out" / r.path).read_bytes()) == r.content_hash
    crossed = manifest.withColumn("label", 1 - manifest.label).withColumn("sample_id", manifest.sample_id)
    with pytest.raises(ValueError):
        workflow.publish_split_files(crossed.where("sample_id > 'b'"), rows, source, str(tmp_path / "no"), ("a", "b"))


def test_a_cohort_and_its_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    src = folder(tmp_path / "src", [(1, "2", {1: b"a"}), (2, "", {1: b"b"}), (3, "5", {1: b"c", 2: b"d"})])
    cohort = workflow.import_cohort(spark, src)
    (tmp_path / "src/2.xml").write_text((tmp_path / "src/2.xml").read_text() + " ")
    with pytest.raises(ValueError, match="changed during"):
        workflow.publish_cohort_files(cohort, src, str(tmp_path / "out"))
    workflow.publish_cohort_files(workflow.import_cohort(spark, src), src, str(tmp_path / "out"))
    found = sorted(r.path for r in files.listing(spark, str(tmp_path / "out/data")).where("kind = 'file'").collect())
    assert found == ["high/3_1.jpg", "high/3_2.jpg", "low/1_1.jpg"]
    assert workflow.load_cohort(spark, str(tmp_path / "out"))["included"].count() == 3
    assert {(r.path, r.group) for r in spark.read.parquet(str(tmp_path / "out/groups")).collect()} == {("data/low/1_1.jpg", "case-1"), ("data/high/3_1.jpg", "case-3"), ("data/high/3_2.jpg", "case-3")}


@pytest.mark.parametrize("through_hadoop", [False, True])
def test_one_of_two_writers_wins(spark, tmp_path, monkeypatch, through_hadoop):
    if through_hadoop:
        monkeypatch.setattr(store, "local_path", lambda path: None)
    path = f"file://{tmp_path}/doc.json"
    won, lost = [], []

    def write(k):
        try:
            store.create_once(path, b"%d" % k * 1000)
            won.append(k)
        except FileExistsError:
            lost.append(k)

    if through_hadoop:  # one gateway: writers come one after another
        for k in range(2):
            write(k)
    else:
        writers = [threading.Thread(target=write, args=(k,)) for k in range(8)]
        for t in writers:
            t.start()
        for t in writers:
            t.join()
    assert len(won) == 1 and store.read_bytes(path) == b"%d" % won[0] * 1000 and store.exists(path)
    assert not [p for p in tmp_path.iterdir() if p.name.endswith(".part")]
    doc = f"file://{tmp_path}/other.json"
    assert lineage.write_once(doc, {"a": 1}) == lineage.write_once(doc, {"a": 1})
    with pytest.raises(ValueError, match="another document"):
        lineage.write_once(doc, {"a": 2})


def test_an_experiment_lies_apart_from_its_data(tmp_path):
    (tmp_path / "data").mkdir()
    for inside in (tmp_path / "data/runs", tmp_path):
        with pytest.raises(ValueError, match="hold each other"):
            lineage.Experiment(str(inside)).prepare([1, 2], 3, 4, 5, {}, data=str(tmp_path / "data"))
    assert lineage.Experiment(str(tmp_path / "runs")).prepare([1, 2], 3, 4, 5, {}, data=str(tmp_path / "data"))["seeds"] == [1, 2]
