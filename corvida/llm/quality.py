"""Quality classifier: a linear-chain conditional random field over lines.

Every line is good or bad. Its emission score adds weights of its own binned
features (shares of character classes, repetition of words and lines, length,
first and last character) and of the features of the line before and after
it; transition weights tie neighbours. Training maximises the likelihood of
the lines' labels, which are their document's, by Adam on exact gradients;
forward and backward messages of a two-state chain are one log ratio each.
Lines of bad documents that the first fit finds good are relabelled once.

A document's quality is the mean marginal of its lines weighted by their
length, put on the scale of a probability by a logistic fit.

The model is fitted on a bounded sample (``toxicity.sample``); every text is
scored whole. A null text is empty and has one empty line. Without labels of
both classes every score is the share of label 1 (0.5 without labels). Null
and repeated ids and extra columns are of no effect; empty tables give empty
results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvida.llm.common import map_texts
from corvida.llm.toxicity import sample

SAMPLE_ROWS = 6000
EPOCHS, BATCH, RATE = 12, 64, 0.05
_SHARES = np.array([1e-9, 0.01, 0.03, 0.08, 0.15, 0.3, 0.5])
_WORD_LENGTHS = np.array([1, 2, 3, 4, 5, 6, 7, 9, 12])
_BINS = 16

#: Upper case, lower case, digits, spaces, stops, exclamation marks, bars, other ASCII signs, longer characters.
_CLASS = np.full(256, 8, dtype=np.uint8)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b".,;:?'\"-()", b"!", b"|")):
    _CLASS[list(_chars)] = _k
_CLASS[[b for b in range(128) if _CLASS[b] == 8]] = 7
_SHARED = (0, 2, 3, 4, 5, 6, 7, 8)
#: Features of a line: shares, then repeated words, word length, line length, seen before, first and last character.
WIDTH = len(_SHARED) + 6


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all lines, their lengths in bytes, and where each text's lines start (and the end)."""
    lines, offsets = [], [0]
    for text in texts:
        lines += text.split(b"\n")
        offsets.append(len(lines))
    n = len(lines)
    lengths = np.fromiter(map(len, lines), dtype=np.int64, count=n)
    out = np.zeros((n, WIDTH), dtype=np.int64)
    if not n:
        return out, lengths, np.array(offsets)
    # each line keeps one byte after it, so that no stretch of reduceat is empty
    classes = _CLASS[np.frombuffer(b"\n".join(lines) + b"\n", dtype=np.uint8)]
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    classes[starts + lengths] = 255
    long = np.maximum(lengths, 1)
    for k, c in enumerate(_SHARED):
        share = np.add.reduceat(classes == c, starts, dtype=np.int64) / long
        out[:, k] = np.searchsorted(_SHARES, share, side="right")
    at = len(_SHARED)
    repeats, sizes, seen = np.zeros(n), np.zeros(n), np.zeros(n, dtype=np.int64)
    for a, b in zip(offsets[:-1], offsets[1:]):
        known: set[bytes] = set()
        for i in range(a, b):
            line = lines[i]
            words = line.split()
            if words:
                repeats[i] = 1 - len(set(words)) / len(words)
                sizes[i] = len(line) / len(words)
                if line in known:
                    seen[i] = 1
                known.add(line)
    out[:, at] = np.searchsorted(_SHARES, repeats, side="right")
    out[:, at + 1] = np.searchsorted(_WORD_LENGTHS, sizes, side="right")
    out[:, at + 2] = np.minimum(_BINS - 1, np.ceil(np.log2(lengths + 1)).astype(np.int64))
    out[:, at + 3] = seen
    out[:, at + 4] = np.where(lengths > 0, classes[starts], 9)
    out[:, at + 5] = np.where(lengths > 0, classes[starts + long - 1], 9)
    return out + np.arange(WIDTH) * _BINS, lengths, np.array(offsets)


class Model:
    def __init__(self):
        n = WIDTH * _BINS
        #: Log odds of "good" that a feature adds to its line, to the next and to the one before.
        self.own, self.to_next, self.to_previous = np.zeros(n), np.zeros(n), np.zeros(n)
        #: Scores of staying bad, bad to good, good to bad, staying good; bias, bias of a text's first and last line.
        self.step = np.array([0.5, 0.0, 0.0, 0.5])
        self.bias = np.zeros(3)
        self.scale = np.array([0.0, 0.0])
        self.fitted = False

    def emissions(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        u = self.own[ids].sum(axis=1) + self.bias[0]
        if len(u):
            forward, backward = self.to_next[ids].sum(axis=1), self.to_previous[ids].sum(axis=1)
            u[1:] += forward[:-1]
            u[:-1] += backward[1:]
            first, last = offsets[:-1], offsets[1:] - 1
            u[first] += self.bias[1]
            u[last] += self.bias[2]
            # neighbours across a border between texts are none
            inner = first[first > 0]
            u[inner] -= forward[inner - 1]
            u[inner - 1] -= backward[inner]
        return u

    def messages(self, u: list[float]) -> tuple[list[float], list[float]]:
        """Forward log odds (own emission included) and backward log odds of each line of one text."""
        bb, bg, gb, gg = (math.exp(x) for x in self.step)
        log, exp, n = math.log, math.exp, len(u)
        forward, backward = [0.0] * n, [0.0] * n
        f = forward[0] = max(-30.0, min(30.0, u[0]))
        for t in range(1, n):
            e = exp(f)
            f = forward[t] = max(-30.0, min(30.0, u[t] + log((bg + e * gg) / (bb + e * gb))))
        b = 0.0
        for t in range(n - 2, -1, -1):
            e = exp(max(-30.0, min(30.0, u[t + 1] + b)))
            b = backward[t] = log((gb + e * gg) / (bb + e * bg))
        return forward, backward

    def marginals(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of "good" of each line."""
        u, z = self.emissions(ids, offsets).tolist(), []
        for a, b in zip(offsets[:-1], offsets[1:]):
            forward, backward = self.messages(u[a:b])
            z += [f + g for f, g in zip(forward, backward)]
        return 1 / (1 + np.exp(-np.array(z)))

    def document_logits(self, texts: list[bytes]) -> np.ndarray:
        ids, lengths, offsets = features(texts)
        if not len(texts):
            return np.zeros(0)
        weights = lengths + 1.0
        good = np.add.reduceat(self.marginals(ids, offsets) * weights, offsets[:-1]) / np.add.reduceat(weights, offsets[:-1])
        good = np.clip(good, 1e-4, 1 - 1e-4)
        return np.log(good / (1 - good))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = self.document_logits(texts) if self.fitted else np.zeros(len(texts))
        return 1 / (1 + np.exp(-(self.scale[0] + self.scale[1] * z)))


def _epochs(model: Model, ids: np.ndarray, offsets: np.ndarray, labels: np.ndarray, seed: int) -> None:
    """Adam on the likelihood of line labels."""
    params = [model.own, model.to_next, model.to_previous, model.step, model.bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    random = np.random.default_rng(seed)
    docs = len(offsets) - 1
    for epoch in range(EPOCHS):
        for lot in np.array_split(random.permutation(docs), max(1, docs // BATCH)):
            rows = np.concatenate([np.arange(offsets[d], offsets[d + 1]) for d in lot])
            ends = np.concatenate([[0], np.cumsum([offsets[d + 1] - offsets[d] for d in lot])])
            x, y = ids[rows], labels[rows]
            u = model.emissions(x, ends).tolist()
            forward, backward = [], []
            for a, b in zip(ends[:-1], ends[1:]):
                f, g = model.messages(u[a:b])
                forward += f
                backward += g
            f, g, u = np.array(forward), np.array(backward), np.array(u)
            error = y - 1 / (1 + np.exp(-(f + g)))
            inside = np.ones(len(rows), dtype=bool)
            inside[ends[1:] - 1] = False
            at = np.flatnonzero(inside)
            # joint odds of the states of a line and the next
            nxt = u[at + 1] + g[at + 1]
            joint = np.stack([model.step[0] + 0 * nxt, model.step[1] + nxt, model.step[2] + f[at], model.step[3] + f[at] + nxt], axis=1)
            joint = np.exp(joint - joint.max(axis=1, keepdims=True))
            joint /= joint.sum(axis=1, keepdims=True)
            truth = np.zeros_like(joint)
            truth[np.arange(len(at)), (2 * y[at] + y[at + 1]).astype(int)] = 1
            grads = [np.zeros_like(p) for p in params]
            np.add.at(grads[0], x, error[:, None])
            np.add.at(grads[1], x[at], error[at + 1][:, None])
            np.add.at(grads[2], x[at + 1], error[at][:, None])
            grads[3] = (truth - joint).sum(axis=0)
            grads[4] = np.array([error.sum(), error[ends[:-1]].sum(), error[ends[1:] - 1].sum()])
            step += 1
            for k, (p, grad) in enumerate(zip(params, grads)):
                grad = grad / len(rows) - 1e-4 * p
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.99 * second[k] + 0.01 * grad * grad
                p += RATE * (1 - epoch / EPOCHS) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)


def train(texts: list[bytes], labels: list[int], seed: int = 7) -> Model:
    model, y = Model(), np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        share = min(0.999, max(0.001, y.mean())) if len(y) else 0.5
        model.scale[0] = math.log(share / (1 - share))
        return model
    ids, lengths, offsets = features(texts)
    lines = np.repeat(y, np.diff(offsets))
    _epochs(model, ids, offsets, lines, seed)
    good = model.marginals(ids, offsets)
    worst = np.repeat(np.minimum.reduceat(good, offsets[:-1]), np.diff(offsets))
    lines = np.where((lines == 0) & (good > 0.9) & (good > worst), 1.0, lines)
    _epochs(model, ids, offsets, lines, seed + 1)
    model.fitted = True
    z = model.document_logits(texts)
    w = np.array([0.0, 1.0])
    x = np.stack([np.ones_like(z), z], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w + np.clip(np.linalg.solve(hessian, x.T @ (y - p) - 1e-3 * w), -2, 2)
    model.scale = w
    return model


def fit(docs: DataFrame, labels: DataFrame, target: str, allowed) -> Model:
    return train(*sample(docs, labels, target, allowed, rows=SAMPLE_ROWS))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, lambda texts: {"score": pa.array(sent.value.scores(texts), pa.float64())}, "score double")
