"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the mean of the hashed embeddings of the word and its
shorter prefixes, so unseen inflections are near seen ones. Filters one, two and three
words wide run over the whole text; each keeps its largest response (max
pooling over all positions, whatever the length), and a logistic layer weighs
them. Weights are fitted by Adam with sparse back-propagation: only the
positions that won the pooling carry a gradient. Words are dropped at random
meanwhile, so that every telling word is learned and not only the commonest.

Thresholds are calibrated by the language that the *text* shows, judged by
function words; the ``lang`` column is never read. For each language the
threshold with the best F1 on a part of the sample kept out of the fit is
moved to ``THRESHOLD`` by a shift of the logit, so one cut fits all languages.
The fewer positives a language has there, the more it takes the threshold of
all texts.

The model is fitted on at most ``SAMPLE_ROWS`` labelled rows, those of the
smallest hashed ids, and on their whole texts: the driver's memory is that of so
many texts, with 64 bytes for a word of a batch. Scoring reads every text whole,
in pieces.

Null texts are empty; an empty text gets the score of pooling over no words.
Unlabelled rows and null ids are scored too. Without labels of both classes
every score is 0. Extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvida.llm.common import ascii_words, bounded_batches, map_texts, texts_of, worker_state

SAMPLE_ROWS = 8000
THRESHOLD = 0.3
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 16, (1, 2, 3)
PREFIXES = (4, 5, 6, 7, 8, 9)
STEPS, EPOCHS, BATCH, RATE, DECAY = 2000, (8, 60), 32, 1e-2, 2e-4
#: Shares of words that are dropped, and of those that show their prefixes alone, in a step of training.
DROPOUT, HIDDEN = 0.3, 0.5
#: Spread of embeddings at the start: words never seen in training hardly respond.
SPREAD = 0.05
#: Positives at which a language's own threshold counts half.
TRUST = 10
_PIECE, _TOKENS, _WORDS = 15_000, 30_000, 200_000

# Frequent function words of four languages.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on with as be by are this from".split(),
    "de": "der die und das nicht mit den von zu ist ein eine auf für sich dem des".split(),
    "fr": "le la les des et que qui du dans un une pour par au est ce avec sur".split(),
    "es": "el los las de que y en un una por con para del se su al lo es".split(),
}
LANGUAGES = (*FUNCTION_WORDS, "other")


def buckets(word: bytes) -> list[int]:
    """Places of a word and its shorter prefixes in the embedding table; 0 is the padding's."""
    return [1 + zlib.crc32(x) % (BUCKETS - 1) for x in (b"<" + word + b">", *(b"^" + word[:n] for n in PREFIXES if n < len(word)))]


_SAID = {w.encode(): [i for i, name in enumerate(FUNCTION_WORDS) if w in FUNCTION_WORDS[name]] for words in FUNCTION_WORDS.values() for w in words}


def language_of(words: list[bytes]) -> int:
    """Place in LANGUAGES of the language whose function words are most of the text."""
    votes = [0] * len(FUNCTION_WORDS)
    for w in _SAID.keys() & set(words):
        for i in _SAID[w]:
            votes[i] += 1
    best = max(votes)
    return votes.index(best) if best else len(FUNCTION_WORDS)


class Words:
    """Rows of embeddings by word, kept between batches while there are not too many."""

    def __init__(self, table: np.ndarray, most: int = _WORDS):
        self.table, self.most = table, most
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = {b"": 0}
        self.rows = np.zeros((4096, self.table.shape[1]), dtype=np.float32)

    def ids_of(self, words: list[bytes]) -> np.ndarray:
        new = set(words).difference(self.ids)
        if len(self.ids) + len(new) > self.most and len(self.ids) > 1:
            self.clear()
            new = set(words).difference(self.ids)
        if new:
            at = len(self.ids)
            if at + len(new) > len(self.rows):
                self.rows = np.resize(self.rows, (2 * (at + len(new)), self.rows.shape[1]))
            flat, starts = [], []
            for word in new:
                self.ids[word] = len(self.ids)
                starts.append(len(flat))
                flat += buckets(word)
            counts = np.diff([*starts, len(flat)])[:, None]
            self.rows[at : at + len(new)] = np.add.reduceat(self.table[flat], starts, axis=0) / counts
        return np.fromiter(map(self.ids.__getitem__, words), dtype=np.int64, count=len(words))


class Model:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, SPREAD, (BUCKETS, DIM)).astype(np.float32)
        self.embed[0] = 0
        self.conv = [r.normal(0, (2 / (w * DIM)) ** 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
        self.out = r.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
        self.base = np.full(1, -2.0, dtype=np.float32)
        self.shift = np.zeros(len(LANGUAGES))
        self.fitted = False

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        """Of all filters at all positions of ``x``, which ends with the padding."""
        n = len(x) - max(WIDTHS) + 1
        return [sum(x[j : j + n] @ w[j] for j in range(len(w))) + b for w, b in zip(self.conv, self.bias)]

    def pooled(self, texts: list[list[bytes]], words: Words) -> np.ndarray:
        """Largest responses, texts by filters; long texts in pieces that share their border words."""
        more = max(WIDTHS) - 1
        out = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf, dtype=np.float32)
        todo = [(i, at) for i, t in enumerate(texts) for at in range(0, max(1, len(t)), _PIECE)]
        while todo:
            flat: list[bytes] = []
            starts, owners = [], []
            while todo and (not flat or len(flat) + min(_PIECE, len(texts[todo[-1][0]])) <= _TOKENS):
                i, at = todo.pop()
                starts.append(len(flat))
                owners.append(i)
                piece = texts[i][at : at + _PIECE + more]
                flat += piece or [b""]
                if at + _PIECE + more > len(texts[i]):
                    flat += [b""] * more
            flat += [b""] * more
            ids = words.ids_of(flat)
            z = self.responses(words.rows[ids])
            # what starts at the last words of a piece runs into the next one; they lead the text's next piece, or are padding
            over = (np.array([*starts[1:], len(flat) - more])[:, None] - np.arange(1, more + 1)).ravel()
            for r in z:
                r[over] = -np.inf
            top = np.concatenate([np.maximum.reduceat(r, starts, axis=0) for r in z], axis=1)
            np.maximum.at(out, owners, top)
        return np.maximum(out, 0)

    def raw(self, texts: list[list[bytes]], words: Words) -> np.ndarray:
        return self.pooled(texts, words) @ self.out + self.base[0]

    def scores(self, texts: list[list[bytes]], words: Words) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(texts))
        z = self.raw(texts, words) + self.shift[[language_of(t) for t in texts]]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The logit between two neighbours that has the best F1; the middle of ties."""
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
    ranked = z[order]
    last = np.append(ranked[:-1] > ranked[1:], True)
    f1 = np.where(last, f1, -1)
    k = int(np.flatnonzero(f1 >= f1.max() - 1e-12)[0])
    return float((ranked[k] + (ranked[k + 1] if k + 1 < len(ranked) else ranked[k] - 2)) / 2)


def gradients(model: Model, ids: list[np.ndarray], features: np.ndarray, held: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of the mean log loss of some texts: the embedding rows that carry a gradient, and the gradients of those and of all other weights.

    ``ids`` are the texts' words as rows of ``features``, which name the
    embeddings whose mean (over ``held``) a word is; row 0 is the padding.
    """
    more = max(WIDTHS) - 1
    flat = np.concatenate([np.append(i, [0] * more) for i in ids]).astype(np.int64)
    starts = np.cumsum([0] + [len(i) + more for i in ids])
    known, back = np.unique(flat, return_inverse=True)
    shown, held = features[known], held[known]
    x = (model.embed[shown].sum(axis=1) / held)[back]
    z = model.responses(np.concatenate([x, np.zeros((more, DIM), dtype=x.dtype)]))
    at = [np.stack([a + r[a : b - more].argmax(axis=0) for a, b in zip(starts[:-1], starts[1:])]) for r in z]
    top = np.concatenate([r[p, np.arange(FILTERS)] for r, p in zip(z, at)], axis=1)
    pooled = np.maximum(top, 0)
    p = 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.base[0], -30, 30)))
    g = ((p - y) / len(y)).astype(x.dtype)
    # only the positions that won the pooling carry a gradient
    d_top = np.where(top > 0, g[:, None] * model.out, 0).astype(x.dtype)
    d_x = np.zeros_like(x)
    d_conv, d_bias = [], []
    for k, (w, where) in enumerate(zip(model.conv, at)):
        d = d_top[:, k * FILTERS : (k + 1) * FILTERS]
        d_bias.append(d.sum(axis=0))
        d_conv.append(np.zeros_like(w))
        for j in range(len(w)):
            place = np.minimum(where + j, len(x) - 1)
            dj = np.where(where + j < len(x), d, 0)
            d_conv[k][j] = np.einsum("bf,bfe->ef", dj, x[place])
            np.add.at(d_x, place, dj[:, :, None] * w[j].T[None])
    touched = np.flatnonzero(np.abs(d_x).sum(axis=1))
    used, at_used = np.unique(shown[back[touched]], return_inverse=True)
    d_embed = np.zeros((len(used), DIM), dtype=x.dtype)
    np.add.at(d_embed, at_used.reshape(-1, shown.shape[1]), (d_x[touched] / held[back[touched]])[:, None, :])
    d_embed[used == 0] = 0
    return used, [d_embed, *d_conv, *d_bias, pooled.T @ g, np.array([g.sum()])]


def train(texts: list[bytes], labels: list[int], seed: int = 7) -> Model:
    """Fit on four fifths of the rows, calibrate on the rest. Words are held as numbers only."""
    model, y = Model(seed), np.array(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return model
    rows = np.arange(len(y))
    fit, rest = rows[rows % 5 != 4], rows[rows % 5 == 4]
    if not len(rest) or y[rest].min() == y[rest].max() or y[fit].min() == y[fit].max():
        fit = rest = rows
    vocabulary = {b"": 0}
    ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in (ascii_words(t) or [b""])], dtype=np.int32) for t in texts]
    features = np.zeros((len(vocabulary), 1 + len(PREFIXES)), dtype=np.int64)
    for word, i in vocabulary.items():
        if word:
            b = buckets(word)
            features[i, : len(b)] = b
    held = np.maximum(1, (features > 0).sum(axis=1, keepdims=True)).astype(np.float32)
    # a word hides once for all its places in a step: without itself, what it shares with others has to tell
    hidden = features.copy()
    hidden[held[:, 0] > 1, 0] = 0
    features, held = np.concatenate([features, hidden]), np.concatenate([held, np.maximum(1, held - 1)])
    params = [model.embed, *model.conv, *model.bias, model.out, model.base]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    random, step = np.random.default_rng(seed), 0
    epochs = min(max(EPOCHS[0], STEPS * BATCH // len(fit)), EPOCHS[1])
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for lot in np.array_split(random.permutation(fit), max(1, len(fit) // BATCH)):
            hides = (random.random(len(vocabulary)) < HIDDEN) * len(vocabulary)
            some = [np.where(random.random(len(ids[i])) < DROPOUT, 0, ids[i] + hides[ids[i]]) for i in lot]
            used, grads = gradients(model, some, features, held, y[lot])
            step += 1
            # of the embedding only those rows move
            for at, value, m, v, grad in zip([used, *[slice(None)] * (len(params) - 1)], params, first, second, grads):
                grad = grad + DECAY * value[at]
                m[at] = 0.9 * m[at] + 0.1 * grad
                v[at] = 0.999 * v[at] + 0.001 * grad * grad
                value[at] -= (rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            model.embed[0] = 0
    model.fitted = True
    words, z, spoken, target = Words(model.embed), [], [], y[rest]
    for part in np.array_split(rest, max(1, len(rest) // 50)):
        some = [ascii_words(texts[i]) for i in part]
        z.append(model.raw(some, words))
        spoken += map(language_of, some)
    z, spoken = np.concatenate(z), np.array(spoken)
    # few positives move a shift little: from none to that of all texts, and from there to the language's own
    wanted, overall = _logit(THRESHOLD), 0.0
    for k in (None, *range(len(LANGUAGES))):
        mine = np.ones(len(spoken), dtype=bool) if k is None else spoken == k
        positives, shift = target[mine].sum(), overall
        if 0 < positives < mine.sum():
            shift += positives / (positives + TRUST) * (wanted - _best_cut(z[mine], target[mine]) - overall)
        if k is None:
            overall = shift
        else:
            model.shift[k] = shift
    return model


def sample(docs: DataFrame, labels: DataFrame, target: str, allowed, rows: int = SAMPLE_ROWS) -> tuple[list[bytes], list[int]]:
    """Whole texts and labels of at most ``rows`` labelled rows whose id fulfils ``allowed``, in the order of their hashed ids.

    Of rows that repeat an id with other labels the larger label counts, with other texts the smallest text.
    """
    wanted = labels.select(F.col("doc_id"), F.col(target).alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & allowed)
    wanted = wanted.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most `rows` pairs of numbers, whatever the size of the tables
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).join(F.broadcast(wanted), "doc_id")
    texts = texts.select("doc_id", F.encode("t", "utf-8").alias("t"), "y")
    found = texts.groupBy("doc_id").agg(F.min("t").alias("t"), F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    return found["t"].to_pylist(), found["y"].to_pylist()


def fit(docs: DataFrame, labels: DataFrame, target: str, allowed) -> Model:
    texts, y = sample(docs, labels, target, allowed)
    return train(texts, y)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` for every row."""
    sent, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(texts: list[bytes]) -> dict[str, pa.Array]:
        scores = sent.value.scores([ascii_words(t) for t in texts], worker_state(key, lambda: Words(sent.value.embed)))
        return {"score": pa.array(scores, pa.float64())}

    return map_texts(docs, run, "score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``; all columns stay."""
    bounded_batches(docs.sparkSession)
    sent, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = sent.value.scores([ascii_words(t) for t in texts_of(batch)], worker_state(key, lambda: Words(sent.value.embed)))
            yield batch.filter(pa.array(scores < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
