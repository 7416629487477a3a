import hashlib
import random
import zlib

import numpy as np
import pytest

from corvida.llm import periodic, queries


def brute(words, least=24, periods=3):
    out = []
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            run = words[start : i + q]
            smallest = i > start and not any(run[d:] == run[:-d] for d in range(1, q))
            if smallest and len(run) >= max(least, periods * q):
                out.append((start, len(run), q))
            i += 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def some_words(rng):
    words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(90))]
    if words and rng.random() < 0.6:
        a, p = rng.randrange(len(words)), rng.randrange(1, 12)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
    return words


@pytest.mark.parametrize("least,periods", [(24, 3), (2, 2), (5, 3)])
def test_runs_against_brute_force(least, periods):
    rng, met = random.Random(least), 0
    for _ in range(600):
        words = some_words(rng)
        want = brute(words, least, periods)
        met += len(want)
        assert periodic.word_runs(words, least, periods) == want
    assert met > 100


def test_lyndon_words_and_prefixes_against_their_definition():
    rng = np.random.default_rng(3)
    for _ in range(60):
        s = rng.integers(0, 3, size=int(rng.integers(2, 40)))
        text = s.tolist()
        order, rank = periodic.suffix_order(s)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        is_lyndon = lambda w: all(w < w[k:] for k in range(1, len(w)))
        want = [max(j for j in range(i + 1, len(text) + 1) if is_lyndon(text[i:j])) for i in range(len(text))]
        assert periodic.lyndon_ends(rank).tolist() == want
        a, b = np.array([(i, j) for i in range(len(text)) for j in range(len(text)) if i != j]).T
        common = lambda i, j: next((k for k in range(len(text)) if max(i, j) + k >= len(text) or text[i + k] != text[j + k]), len(text))
        assert periodic.Prefixes(s, order, rank).common(a, b).tolist() == [common(i, j) for i, j in zip(a.tolist(), b.tolist())]


def digest(doc_id, text):
    words, h = [w for w in (text or "").encode().translate(bytes(32 if i in (9, 10, 11, 12, 13) else i for i in range(256))).split(b" ") if w], zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    lines = "".join("%d,%d,%d\n" % r for r in runs)
    kept = b" ".join(w for i, w in enumerate(words) if not any(s + p <= i < s + n_ for s, n_, p in runs))
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(w.decode() for w in some_words(rng)), "k") for i in range(120)]
    rows += [(200, None, None), (201, "", ""), (202, " \t\n ", ""), (None, "a b " * 40, ""), (204, "é x " * 30, ""), (205, "x\x0by\x1cz\f" * 30, ""), (206, "one", ""), (3, rows[3][1], "again")]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: (r[0] is None, r[0] or 0, r[6])
    have, want = sorted(map(tuple, got.collect()), key=key), sorted((digest(i, t) for i, t, _ in rows), key=key)
    assert have == want and sum(r[1] > 0 for r in want) > 20


def test_a_long_text_that_is_one_run(spark):
    words = [f"w{i % 7919}" for i in range(60_000)]
    (row,) = periodic.periodic_runs(spark.createDataFrame([("x", " ".join(words))], "doc_id string, text string")).collect()
    assert [tuple(r) for r in row.runs] == [(0, 60_000, 7919)] and row.collapsed.split(" ") == words[:7919] and row.n_words == 60_000


def test_empty_table(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
