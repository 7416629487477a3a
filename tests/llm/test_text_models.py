import random
from array import array

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from corvida.llm import bpe, quality, tokencount, toxicity
from corvida.llm.queries import BYTE_VOCABULARY, PIECE_VOCABULARY

R = random.Random(3)
MIXED = "aab  bcthe\n\t!!1239éßñ漢字🙂'sre<0x4>"


def mixed(n):
    return "".join(R.choice(MIXED) for _ in range(n))


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path(BYTE_VOCABULARY))


def test_bpe_equals_the_public_library(spark, ranks):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "a" * 3000, " " * 500, "<|endoftext|>"] + [mixed(R.randint(1, 80)) for _ in range(400)]
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    for t in texts[1:]:
        ids = codec.encode(t)
        assert array("I", library.encode_ordinary(t)).tobytes() == ids and codec.decode(ids) == t.encode()
    docs = spark.createDataFrame([(i % 300, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    rows = bpe.encode_texts(docs, ranks, public_tokenizers.PATTERN).collect()
    assert sorted(x.n_tokens for x in rows) == sorted(len(library.encode_ordinary(t or "")) for t in texts)
    assert bpe.encode_texts(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_bpe_appends_and_edits(ranks):
    v = bpe.Vocabulary(ranks)
    for _ in range(200):
        s = mixed(R.randint(0, 60)).encode()
        a = R.randint(0, len(s))
        b, new = R.randint(a, len(s)), mixed(R.randint(0, 6)).encode()
        p = bpe.Prefixes(v, s[:a]).append(s[a:])
        assert p.last == bpe.Prefixes(v, s).last
        p.replace(a, b, new)
        assert p.last == bpe.Prefixes(v, s[:a] + new + s[b:]).last
    p = bpe.Prefixes(v, b"the cat sat on " * 60)
    assert p.replace(4, 7, b"dog") < 200


def test_token_counts_equal_the_public_library(spark):
    pieces = tokencount.read_pieces(public_tokenizers.path(PIECE_VOCABULARY))
    hidden = [("\x01" + p if p in ("<s>", "</s>", "<unk>") else p, s) for p, s in pieces]
    library = Tokenizer(models.Unigram(hidden, unk_id=0, byte_fallback=True))
    marked = lambda t: tokencount.MARK + t.replace(" ", tokencount.MARK)
    texts = [mixed(R.randint(1, 60)) for _ in range(500)] + ["word " * 400]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None), (-2, "")], "doc_id long, text string")
    got = {x.doc_id: x.n_tokens for x in tokencount.count_tokens(docs, pieces).collect()}
    assert [got[i] for i in range(len(texts))] == [len(library.encode(marked(t)).ids) for t in texts]
    assert got[-1] == got[-2] == 0


def test_token_counts_with_ties_and_unknowns():
    pieces = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aa", -2.0), ("▁", -1.0)]
    library = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    ours = tokencount.Unigram(pieces, ("<unk>",))
    for _ in range(300):
        t = "".join(R.choice("abz ") for _ in range(R.randint(1, 15)))
        assert ours.text(t)[1] == len(library.encode(tokencount.MARK + t.replace(" ", tokencount.MARK)).ids), t
    assert tokencount.Unigram([], ()).text("ab")[1] == 1


def sentence(n, extra=()):
    return " ".join([R.choice(["river", "stone", "light", "green", "walks", "under", "over", "house"]) + R.choice("abcdefgh") for _ in range(n)] + list(extra))


def test_toxicity_learns_rare_words_and_scores_long_texts_whole(spark):
    bad = ["vilea", "vileb", "grimx", "grimy"]
    rows = [(i, sentence(R.randint(3, 60), [R.choice(bad)] if i % 5 == 0 else []), int(i % 5 == 0)) for i in range(700)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, "toxic", labels["doc_id"] < 500)
    got = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    y, s = np.array([r[2] for r in rows[500:]]), np.array([got[i] for i in range(500, 700)])
    assert np.mean((s >= toxicity.THRESHOLD) == y) > 0.97
    words = toxicity.Words(model.embed)
    long = [w.encode() for w in sentence(50_000).split()]
    assert model.scores([long], words)[0] < 0.3 <= model.scores([long + [b"vilea"]], words)[0]
    odd = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "vilea", "x")], "doc_id long, text string, score string")
    assert toxicity.score(odd, model).count() == 3
    kept = toxicity.without_toxic(odd, model)
    assert kept.columns == odd.columns and {x.text for x in kept.collect()} == {None, ""}


def test_models_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    assert {x.score for x in toxicity.score(docs, toxicity.fit(docs, labels, "toxic", F.lit(True))).collect()} == {0.0}
    assert all(x.score > 0.9 for x in quality.score(docs, quality.fit(docs, labels, "quality", F.lit(True))).collect())
    none = labels.limit(0)
    assert {x.score for x in quality.score(docs, quality.fit(docs, none, "quality", F.lit(True))).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), toxicity.Model()).count() == 0


def test_quality_marginals_against_enumeration():
    model, r = quality.Model(), np.random.default_rng(2)
    for p in (model.own, model.to_next, model.to_previous):
        p += r.normal(size=p.shape) * 0.3
    model.step = r.normal(size=4)
    model.bias = r.normal(size=3)
    texts = [b"Some line.\nOTHER!! LINE!!\n\n12 | 3", b"", b"x\nx\nx"]
    ids, _, offsets = quality.features(texts)
    u, got = model.emissions(ids, offsets), model.marginals(ids, offsets)
    for a, b in zip(offsets[:-1], offsets[1:]):
        alone = quality.features([b"\n".join(texts[list(offsets).index(a)].split(b"\n"))])
        assert np.allclose(model.emissions(alone[0], alone[2]), u[a:b])
        weights = np.zeros(b - a)
        total = 0.0
        for code in range(1 << (b - a)):
            s = [code >> k & 1 for k in range(b - a)]
            w = np.exp(sum(u[a + k] * s[k] for k in range(b - a)) + sum(model.step[2 * s[k] + s[k + 1]] for k in range(b - a - 1)))
            total += w
            weights += w * np.array(s)
        assert np.allclose(weights / total, got[a:b])


def test_quality_learns_bad_lines(spark):
    good = lambda: "\n".join(sentence(R.randint(4, 15)).capitalize() + "." for _ in range(R.randint(1, 8)))
    junk = lambda: "\n".join(R.choice([sentence(8).upper() + "!!", "$$$ %%% " * 6, "buy buy buy buy buy buy"]) for _ in range(R.randint(1, 8)))
    rows = [(i, good() if i % 4 else junk(), int(bool(i % 4))) for i in range(500)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels, "quality", labels["doc_id"] < 300)
    got = {x.doc_id: x.score for x in quality.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, _, y in rows[300:]]) > 0.97


def naive_pooled(model, words):
    """Largest response of every filter, window by window, from the definition."""
    def vector(w):
        if not w:
            return np.zeros(toxicity.DIM)
        rows = toxicity.buckets(w)
        return sum(model.embed[r].astype(float) for r in rows) / len(rows)

    x = [vector(w) for w in words or [b""]] + [np.zeros(toxicity.DIM)] * (max(toxicity.WIDTHS) - 1)
    out = []
    for weights, bias in zip(model.conv, model.bias):
        places = range(len(x) - max(toxicity.WIDTHS) + 1)
        out.append(np.maximum(0, np.max([sum(x[p + j] @ weights[j] for j in range(len(weights))) + bias for p in places], axis=0)))
    return np.concatenate(out)


def test_toxicity_pools_over_whole_texts_like_the_definition(monkeypatch):
    monkeypatch.setattr(toxicity, "_PIECE", 7)
    monkeypatch.setattr(toxicity, "_TOKENS", 20)
    model = toxicity.Model(3)
    texts = [[], [b"a"], [b"x%d" % i for i in range(50)], [b"word"] * 7, [b"w%d" % (i % 5) for i in range(23)], [b"y"] * 8]
    got = model.pooled(texts, toxicity.Words(model.embed, most=12))
    for row, text in zip(got, texts):
        assert np.allclose(row, naive_pooled(model, text), atol=1e-5)


def test_toxicity_gradients_are_those_of_the_loss():
    r = np.random.default_rng(5)
    model = toxicity.Model(4)
    model.embed, model.out, model.base = r.normal(0, 0.4, model.embed.shape), r.normal(0, 0.4, model.out.shape), model.base.astype(float)
    model.conv, model.bias = [w.astype(float) for w in model.conv], [r.normal(0, 0.1, b.shape) for b in model.bias]
    model.embed[0] = 0
    features = np.array([[0, 0, 0]] + [[1 + 3 * i, 2 + 3 * i, 3 + 3 * i if i % 2 else 0] for i in range(12)])
    held = np.maximum(1, (features > 0).sum(axis=1, keepdims=True)).astype(float)
    ids = [r.integers(0, 13, n) for n in (1, 4, 9, 15)]
    y = np.array([0.0, 1.0, 1.0, 0.0])

    def loss():
        total = 0.0
        for words, target in zip(ids, y):
            x = np.concatenate([model.embed[features[words]].sum(axis=1) / held[words], np.zeros((2, toxicity.DIM))])
            n = len(words)
            top = np.concatenate([np.max([sum(x[p + j] @ w[j] for j in range(len(w))) + b for p in range(n)], axis=0) for w, b in zip(model.conv, model.bias)])
            p = 1 / (1 + np.exp(-(np.maximum(top, 0) @ model.out + model.base[0])))
            total -= target * np.log(p) + (1 - target) * np.log(1 - p)
        return total / len(y)

    used, grads = toxicity.gradients(model, ids, features, held, y)
    params = [model.embed, *model.conv, *model.bias, model.out, model.base]
    dense = np.zeros_like(model.embed)
    dense[used] = grads[0]
    for value, grad in zip(params, [dense, *grads[1:]]):
        flat = np.flatnonzero(np.abs(grad)) if value is model.embed else np.arange(value.size)
        for k in r.choice(flat, min(len(flat), 25), replace=False):
            at = np.unravel_index(k, value.shape)
            old = value[at]
            value[at] = old + 1e-6
            up = loss()
            value[at] = old - 1e-6
            down = loss()
            value[at] = old
            assert abs((up - down) / 2e-6 - grad[at]) < 1e-5


def test_toxicity_cut_is_the_best_of_all_cuts():
    r = np.random.default_rng(6)
    for _ in range(200):
        z, y = r.integers(0, 6, 12).astype(float), r.integers(0, 2, 12).astype(float)
        if not 0 < y.sum() < 12:
            continue
        f1 = lambda cut: 2 * y[z >= cut].sum() / ((z >= cut).sum() + y.sum())
        cut = toxicity._best_cut(z, y)
        assert cut not in z and abs(f1(cut) - max(f1(c) for c in [*z, 9.0])) < 1e-12


def test_long_labelled_texts_are_learned_whole(spark):
    # the telling word stands anywhere in 200,000 characters
    rng = random.Random(6)
    plain = [f"w{i}" for i in range(400)]

    def text(n, bad):
        words = [rng.choice(plain) for _ in range(n)]
        if bad:
            words[rng.randrange(n)] = "vexaqor"
        return " ".join(words)

    rows = [(i, text(60_000 if i < 4 else 40, i % 2 == 0), i % 2 ^ 1) for i in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(900, 1)], "doc_id long, toxic int")
    texts, y = toxicity.sample(docs, labels, "toxic", F.lit(True))
    whole = dict(zip(texts, y))
    assert len(texts) == 121 and all(whole[t.encode()] == label for _, t, label in rows) and min(len(t) for _, t, _ in rows[:4]) > 200_000
    odd = spark.createDataFrame([(2, "short", "b"), (2, "again", "c"), (3, None, "d"), (None, "x", "e")], "doc_id long, text string, toxic string")
    told = spark.createDataFrame([(2, 0), (2, 1), (3, 1), (None, 1), (7, 0)], "doc_id long, toxic int")
    assert sorted(zip(*toxicity.sample(odd, told, "toxic", F.lit(True)))) == [(b"", 1), (b"again", 1)]
    model = toxicity.train(texts, y)
    scores = model.scores([toxicity.ascii_words(t.encode()) for _, t, _ in rows[:4]], toxicity.Words(model.embed))
    assert [s >= toxicity.THRESHOLD for s in scores] == [bool(label) for _, _, label in rows[:4]]


def test_quality_and_token_counts_of_odd_tables(spark):
    rows = [(1, "good line\nother line", "x"), (1, "good line", "y"), (None, None, "z"), (2, "w " * 200_000, "u"), (3, "", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    scored = quality.score(docs, quality.fit(docs, labels, "quality", F.lit(True)))
    assert scored.columns == ["doc_id", "score"] and sorted((x.doc_id or 0) for x in scored.collect()) == [0, 1, 1, 2, 3]
    assert all(0 <= x.score <= 1 for x in scored.collect())
    assert quality.score(docs.limit(0), quality.fit(docs, labels.limit(0), "quality", F.lit(True))).count() == 0
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("w", -2.0), ("▁w", -1.5)]
    named = docs.withColumnRenamed("score", "n_tokens")
    counts = sorted((x.doc_id or 0, x.n_tokens) for x in tokencount.count_tokens(named, pieces).collect())
    # every word is one piece; the last space is a mark of its own
    assert [n for d, n in counts if d == 2] == [200_001] and [n for d, n in counts if d in (0, 3)] == [0, 0]
    assert tokencount.count_tokens(named.limit(0), pieces).count() == 0
