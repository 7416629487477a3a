import random

import pytest

from corvida.llm import linededup


def brute(docs, least, least_lines=None):
    """Lines covered by a run of enough words, or lines with a word, that occurs at an earlier place."""
    places = [(i, n) for i, t in docs for n in range(len(t))]
    text, deleted = dict(docs), set()
    for doc, n in places:
        for other, m in places:
            if (other, m) >= (doc, n):
                continue
            k = words = full = 0
            while n + k < len(text[doc]) and m + k < len(text[other]) and text[doc][n + k] == text[other][m + k]:
                words += len(text[doc][n + k].split())
                full += bool(text[doc][n + k].split())
                k += 1
            if least and words >= least or least_lines and full >= least_lines:
                deleted |= {(doc, n + x) for x in range(k)}
    return {i: "\n".join(s for n, s in enumerate(t) if (i, n) not in deleted) for i, t in docs}


@pytest.mark.parametrize("seed,least,lines", [(2, 5, None), (3, 8, 3), (4, 1, None), (5, None, 2), (6, None, 1)])
def test_against_brute_force(spark, seed, least, lines):
    r = random.Random(seed)
    some = ["", "a", "b b", "c c c", "d", "e e"]
    docs = [(i, [r.choice(some) for _ in range(r.randint(1, 12))]) for i in range(25)]
    docs += [(30, docs[3][1] * 2), (31, [""] * 20), (32, docs[5][1])]
    df = spark.createDataFrame([("\n".join(t), i, "p") for i, t in docs], "text string, doc_id long, tkey string")
    got = {x.id: x.kept_text for x in linededup.dedup_lines(df, least, lines).selectExpr("r.doc_id as id", "kept_text").collect()}
    want = brute(docs, least, lines)
    assert {i: t for i, t in got.items()} == {i: t for i, t in want.items()}


def test_stage_keeps_columns_drops_whole_copies_and_counts(spark):
    passage = "\n".join(" ".join(f"w{i}x{j}" for j in range(20)) for i in range(4))
    docs = spark.createDataFrame(
        [(1, passage, 7, "s"), (2, passage, 7, "s"), (3, "own start\n" + passage + "\nown end", 9, "s"), (4, None, None, None), (5, "", 0, "s"), (None, "short", 5, "s")],
        "doc_id long, text string, n_chars long, runs string",
    )
    rows = {x.doc_id: x for x in linededup.without_repeats(docs).collect()}
    assert set(rows) == {None, 1, 3, 4, 5}
    assert rows[1].text == passage and rows[3].text == "own start\nown end" and rows[3].n_chars == len("own start\nown end")
    assert rows[4].text is None and rows[5].text == "" and rows[None].text == "short"


def test_repeated_rows_count_once_and_long_texts(spark):
    text = "\n".join(f"line {i} " + "x " * 60 for i in range(300))
    docs = spark.createDataFrame([(1, text), (1, text), (2, "z\n" + text)], "doc_id long, text string")
    rows = sorted((x.id, x.n_deleted) for x in linededup.dedup_lines(docs).selectExpr("r.doc_id as id", "n_deleted").collect())
    assert rows == [(1, 0), (1, 0), (2, 300)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert linededup.without_repeats(docs).count() == 0
