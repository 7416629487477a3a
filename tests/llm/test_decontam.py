import math
import random
from itertools import combinations

from corvida.llm import decontam
from corvida.llm.common import ascii_words

R = random.Random(9)
VOCABULARY = [f"t{i}" for i in range(400)]


def words(n):
    return [R.choice(VOCABULARY) for _ in range(n)]


def brute(text, test, similarity=0.8, least=13):
    best = 0
    for diagonal in range(-len(test), len(text)):
        lo, hi = max(0, -diagonal), min(len(test), len(text) - diagonal)
        same = [test[i] == text[i + diagonal] for i in range(lo, hi)]
        if len(same) == len(test) and sum(same) >= similarity * len(test) - 1e-9:
            return len(test)
        for a in range(len(same)):
            for b in range(len(same), a, -1):
                if same[a] and same[b - 1] and sum(same[a:b]) >= similarity * (b - a) - 1e-9:
                    best = max(best, b - a)
                    break
    return best if best >= min(len(test), least) else 0


def test_longest_overlap_against_brute_force():
    for _ in range(500):
        same = [R.random() < 0.75 for _ in range(R.randint(0, 25))]
        want = max([b - a for a in range(len(same)) for b in range(a + 1, len(same) + 1) if same[a] and same[b - 1] and sum(same[a:b]) >= 0.8 * (b - a) - 1e-9], default=0)
        assert decontam.longest_overlap(same, 0.8)[1] == want


def test_spans_against_brute_force(spark):
    tests = [(i, words(R.randint(15, 40))) for i in range(12)] + [(50, words(3)), (51, words(6)), (52, [])]
    docs = []
    for i in range(60):
        text = words(R.randint(5, 60))
        if i % 2:
            leak = list(R.choice(tests[:12])[1])
            for k in R.sample(range(len(leak)), R.choice([0, 0, 1, len(leak) // 8])):
                leak[k] = "other"
            at = R.randint(0, len(text))
            text[at:at] = leak
        docs.append((i, text))
    docs += [(100, tests[13][1] + words(3)), (101, tests[12][1]), (102, tests[12][1] + ["more"])]
    df = spark.createDataFrame([(i, " ".join(t).upper() + ".", "s") for i, t in docs] + [(200, None, "s"), (201, "", "s")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, ", ".join(t), 1) for i, t in tests] + [(60, None, 1)], "item_id long, text string, doc_id int")
    want = {(d, i) for d, t in docs for i, w in tests if (brute(t, w) if len(w) >= 5 else w and t == w)}
    got = decontam.contaminated_spans(df, bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want
    small = decontam.contaminated_spans(df, bench, block_words=50).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, got))
    clean = decontam.without_contaminated(df, bench, block_words=50)
    assert clean.columns == df.columns
    assert {x.doc_id for x in clean.collect()} == ({d for d, _ in docs} | {200, 201}) - {d for d, _ in want}


def test_every_pattern_of_substitutions_is_found_at_every_place_and_length():
    for n in range(1, 26):
        item = [f"w{i}".encode() for i in range(n)]
        index = decontam.SeedIndex([(7, item)])
        most = n - math.ceil(0.8 * n - 1e-9) if n >= decontam.SEED_WORDS else 0
        patterns = [gone for k in range(most + 1) for gone in combinations(range(n), k)]
        for gone in R.sample(patterns, min(len(patterns), 1500)):
            text = [b"x" if i in gone else w for i, w in enumerate(item)]
            around = [b"a", b"b"] if n >= decontam.SEED_WORDS else []
            got = decontam.overlaps(around + text + around, index)
            if n <= 13 or not {0, n - 1} & set(gone):
                assert got == [(7, len(around), n, n - len(gone))]
            else:  # what begins and ends with agreement
                assert len(got) == 1 and got[0][2] >= 13 and len(around) <= got[0][1] and got[0][1] + got[0][2] <= len(around) + n
        if 0 < n < decontam.SEED_WORDS:
            assert not decontam.overlaps([b"a", *item], index)


def test_every_passage_is_listed_once():
    item = [f"w{i}".encode() for i in range(20)]
    index = decontam.SeedIndex([(7, item), (8, item[2:18]), (None, item[:15]), (7, item[:14])])
    text = [b"a"] * 5 + item[:15] + [b"b"] * 40 + item + [b"c"] + item[4:]
    assert decontam.overlaps(text, index) == [(7, 5, 15, 15), (7, 60, 20, 20), (7, 81, 16, 16), (8, 7, 13, 13), (8, 62, 16, 16), (8, 81, 14, 14), (None, 5, 15, 15), (None, 60, 15, 15)]
    # a stretch that substitutions cut in two
    long = [f"v{i}".encode() for i in range(60)]
    text = [b"x" if 20 <= i < 40 else w for i, w in enumerate(long)]
    assert decontam.overlaps(text, decontam.SeedIndex([(1, long)])) == [(1, 0, 20, 20), (1, 40, 20, 20)]


def test_long_texts_repeated_and_other_ids(spark):
    item = words(30)
    long = words(150_000)
    long[120_000:120_000] = item
    rows = [("d1", " ".join(long)), ("d1", " ".join(words(50) + item)), ("d1", "t1 t2"), (None, " ".join(item)), ("d2", "t1 t2 t3")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, "t1 T2")], "item_id int, text string")
    got = sorted(map(tuple, decontam.contaminated_spans(docs, bench).drop("similarity").collect()), key=str)
    assert got == sorted([("d1", 1, 120_000, 30, 30), ("d1", 1, 50, 30, 30), ("d1", 2, 0, 2, 2), (None, 1, 0, 30, 30)], key=str)
    assert [r.doc_id for r in decontam.without_contaminated(docs, bench).collect()] == ["d2"]


def test_every_tenth_word_replaced_is_always_found():
    for n in (15, 30, 59):
        for shift in range(10):
            item = words(n)
            text = [w if i % 10 != shift else "zz" for i, w in enumerate(item)]
            index = decontam.SeedIndex([(1, [w.encode() for w in item])])
            assert decontam.overlaps([w.encode() for w in words(20) + text + words(20)], index)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated_spans(docs, bench).count() == 0
    assert decontam.without_contaminated(docs, bench).count() == 1
    assert decontam.without_contaminated(docs.limit(0), bench).count() == 0


def test_words():
    assert ascii_words("It's É9, naïve\x00ß_A".encode()) == [x.encode() for x in ["it", "s", "É9", "naïve", "ß", "a"]]
