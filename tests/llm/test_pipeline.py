import os

import corpus_pipeline
import duckdb

from corvida.llm import queries, simhash

DATA = "/root/testdata/sf0.001"


def test_stages_and_end_to_end(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "byte_bpe":
            assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and len(after) == len(before)
            break
        assert docs.columns == columns
        if name != "line_dedup":
            assert all(after[i] == before[i] for i in after)
        if name == "simhash":
            groups = {}
            for r in simhash.simhash_groups(spark.createDataFrame(list(before.values()))).collect():
                groups.setdefault(r.component_id, []).append(r.doc_id)
            assert set(after) == set(groups)
        before = after
    whole = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert whole == after


def test_sql_agrees(spark):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    for name, sql in queries.SQL.items():
        rows = queries.QUERIES[name](spark, DATA)
        want = db.sql(f"SELECT {', '.join(rows.columns)} FROM ({sql})").fetchall()
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted(map(tuple, rows.collect()), key=key) == sorted(want, key=key), name


def test_contract_columns(spark):
    want = {
        "op1_licenses": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        "op2_quality": ["doc_id", "held_out", "score", "predicted"],
        "op5_simhash": ["doc_id", "fingerprint", "component_id"],
        "op6_url_filter": ["page_id", "host", "path", "rule", "verdict"],
        "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op9_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op10_embeddings": ["vec_id", "n_links", "component_id", "kept"],
    }
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, DATA).columns == columns


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    item = " ".join(f"item{i}" for i in range(20))
    rows = [(1, "plain words of a first text", "x"), (1, "plain words of a first text", "x"), (None, None, None), (None, "no id here at all", "y"), (2, "", "z"), (3, None, "u"), (4, "word " * 60_000, "v"), (5, f"before {item} after", "w"), (6, "PLAIN words of a first text", "k")]
    schema = "doc_id long, text string, r string"
    columns = ("lang", "source", "n_chars", "fp", "tkey", "maybe", "bucket", "score", "component_id", "runs", "item_id")
    docs = spark.createDataFrame(rows, schema).selectExpr("*", *(f"cast(7 as long) as {c}" for c in columns))
    spark.createDataFrame([(1, 0, 0), (4, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(9, item), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[1:4]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
    # near copies and repeats of 1 are one row, null and empty texts one group of the ids that name it, the item's text goes
    assert sorted((x.doc_id or 0, len(x.text or "")) for x in kept.collect()) == [(0, 0), (0, 17), (1, 27), (2, 0), (4, 300_000)]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 1
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
