import random

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from corvida.llm import simhash


def brute(texts):
    def fp(t):
        w = (t or "").encode().lower().split()
        if not w:
            return 0
        s = [b" ".join(w)] if len(w) < 4 else [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)]
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    return [fp(t) for t in texts]


def components(ids, fps, radius=4):
    parent = {i: i for i in range(len(ids))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                parent[find(i)] = find(j)
    best = {}
    for i, doc in enumerate(ids):
        best[find(i)] = min(best.get(find(i), doc), doc)
    return [best[find(i)] for i in range(len(ids))]


def test_groups_against_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    texts = [None, "", " \t\n", "one", "One", "a b c", "É é"] + [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(40)]
    for t in list(texts[10:25]):
        parts = t.split()
        parts[r.randrange(len(parts))] = "changed"
        texts += [t, " ".join(parts), t + " tail"]
    texts.append("word " * 70000)
    ids = list(range(5, 5 + len(texts)))
    docs = spark.createDataFrame([(t, "x", i) for i, t in zip(ids, texts)], "text string, fp string, doc_id long")
    got = {x.doc_id: x for x in simhash.simhash_groups(docs).collect()}
    fps = brute(texts)
    assert [got[i].fp & (1 << 64) - 1 for i in ids] == fps
    assert [got[i].component_id for i in ids] == components(ids, fps)


@pytest.mark.parametrize("limit", [2, 8])
def test_pairs_of_dense_groups_with_small_buckets(spark, limit):
    r = random.Random(limit)
    base = [r.getrandbits(64) for _ in range(3)]
    fps = sorted({b ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 4))) & (1 << 64) - 1 for b in base for _ in range(40)} | {r.getrandbits(64) for _ in range(50)})
    signed = [simhash._signed(f) for f in fps]
    got = simhash.similar_pairs(spark.createDataFrame([(f,) for f in signed], "fp long"), bucket_limit=limit).collect()
    assert len(got) == len(set(got))
    want = {tuple(sorted((a, b))) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4}
    assert {tuple(x) for x in got} == want


def test_one_per_group_keeps_columns_and_handles_repeats(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "x"), (1, "a b c d e", "y"), (2, "a b c d e", "z"), (3, None, "n"), (None, "q", "m"), (4, "other words here now", "w")], "doc_id long, text string, component_id string")
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted((x.doc_id or 0, x.text or "") for x in kept.collect()) == [(0, "q"), (1, "a b c d e"), (3, ""), (4, "other words here now")]


def test_rows_that_share_an_id_alone_are_judged_apart(spark):
    rows = [(1, "a b c d e"), (5, "a b c d e"), (5, "quite another text with words"), (7, "quite another text with words"), (2, "one more text of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.one_per_group(docs).collect())) == [(1, "a b c d e"), (2, "one more text of its own"), (5, "quite another text with words")]
    got = sorted((x.doc_id, x.component_id) for x in simhash.simhash_groups(docs).collect())
    assert got == [(1, 1), (2, 2), (5, 1), (5, 5), (7, 5)]


def test_more_fingerprints_ask_for_more_bits():
    assert [simhash.blocks_that_agree(10**n) for n in (0, 6, 7, 8, 9, 10, 12)] == [2, 2, 2, 3, 3, 4, 6]
    for agree in (2, 3, 4):
        keys = simhash._Keys.first(4, agree)
        r = random.Random(agree)
        for _ in range(300):
            x = sum(1 << b for b in r.sample(range(64), r.randint(0, 4)))
            claims = [m for m, d in zip(keys.masks, keys.differ) if not x & m and all(x & b for b in d)]
            assert len(claims) == 1


def test_key_filter_passes_all_keys_and_few_others(spark, monkeypatch):
    from corvida.llm import common
    from corvida.session import Stage

    rows, stage = spark.range(100_000).withColumn("b", F.col("id") % 7), Stage(spark, "filter")
    keys = rows.where("id % 10 = 0")
    found = common.KeyFilter(keys, ["id", "b"], stage).may_match(rows, "maybe").where("maybe")
    assert found.where("id % 10 = 0").count() == 10_000 and found.count() < 10_000 + 0.13 * 90_000
    monkeypatch.setattr(common, "MOST_BITS", 1 << 16)
    assert common.KeyFilter(keys, ["id", "b"], stage).may_match(rows, "maybe").where("maybe").count() == 100_000
    assert common.KeyFilter(keys.limit(0), ["id", "b"], stage).may_match(rows, "maybe").where("maybe").count() == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(docs).count() == 0
    assert simhash.one_per_group(docs).count() == 0


def test_references_spread():
    refs = np.array(simhash.references(), dtype=np.int64).view(np.uint64)
    assert len(set(refs.tolist())) == simhash.PIVOTS and all(20 < bin(int(x)).count("1") < 44 for x in refs)
