"""Periodic runs of words in a text, by the runs theorem, and texts collapsed to one period of each.

A run is a stretch of words with smallest period q that no neighbouring word
extends. By the runs theorem each run holds a longest Lyndon word, under the
order of words or under the reversed one, that is one period long. So for each
word and both orders the longest Lyndon word that starts there is found (up to
the next smaller value of the inverse suffix array), and extended to both
sides as far as words ``p`` apart agree: by longest common prefixes of
suffixes, and of suffixes of the reversed text, each the minimum of a stretch
of an LCP array, looked up in a sparse table.

In a run of three periods or more each word occurs three times at least. Rarer
words lie in no such run, so the text falls apart at them, and only stretches
between them that are long enough for a run are sorted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvida.llm.common import bounded_batches, texts_of

#: Words and periods of a run at least.
MIN_WORDS, MIN_PERIODS = 24, 3


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse, by prefix doubling; the end comes before every symbol."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    width = 1
    while True:
        key = rank * (n + 1)
        key[: n - width] += rank[width:]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.ones(n, dtype=np.int64)
        np.cumsum(key[1:] != key[:-1], out=new[1:])
        new[1:] += 1
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if new[-1] == n:
            return order, rank - 1
        width *= 2


class Prefixes:
    """Longest common prefixes of any two suffixes: the LCP array under a sparse table of minima."""

    def __init__(self, symbols: np.ndarray, order: np.ndarray, rank: np.ndarray):
        n = len(symbols)
        text, before, places = symbols.tolist(), order.tolist(), rank.tolist()
        lcp, h = [0] * n, 0
        for i, r in enumerate(places):
            if r:
                j = before[r - 1]
                most = n - max(i, j)
                while h < most and text[i + h] == text[j + h]:
                    h += 1
                lcp[r] = h
                h = max(h - 1, 0)
            else:
                h = 0
        self.n, self.rank = n, rank
        self.table = [np.array(lcp, dtype=np.int32)]
        half = 1
        while 2 * half <= n:
            last = self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))
            half *= 2
        # a level at a time, so that a lookup of many pairs is one pass over each level
        self.level = np.zeros(n + 1, dtype=np.int64)
        for k in range(1, len(self.table)):
            self.level[1 << k :] = k

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``a`` and ``b``, which differ; a place after the end has none."""
        out = np.zeros(len(a), dtype=np.int64)
        inside = np.flatnonzero((a < self.n) & (b < self.n) & (a >= 0) & (b >= 0))
        ra, rb = self.rank[a[inside]], self.rank[b[inside]]
        lo, hi = np.minimum(ra, rb) + 1, np.maximum(ra, rb)
        level = self.level[hi - lo + 1]
        for k in np.unique(level).tolist():
            at = level == k
            out[inside[at]] = np.minimum(self.table[k][lo[at]], self.table[k][hi[at] - (1 << k) + 1])
        return out


def lyndon_ends(rank: np.ndarray) -> np.ndarray:
    """For each place the end of the longest Lyndon word that starts there: the next place of smaller rank."""
    ranks, n = rank.tolist(), len(rank)
    ends, open_ = [n] * n, []
    for i in range(n - 1, -1, -1):
        while open_ and ranks[open_[-1]] > ranks[i]:
            open_.pop()
        if open_:
            ends[i] = open_[-1]
        open_.append(i)
    return np.array(ends, dtype=np.int64)


def runs_of(symbols: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """``start, length, period`` of all runs of ``min_words`` symbols and ``min_periods`` (2 or more) periods, by start and period."""
    n = len(symbols)
    if n < max(min_words, min_periods, 2):
        return []
    order, rank = suffix_order(symbols)
    forward = Prefixes(symbols, order, rank)
    back = symbols[::-1].copy()
    backward = Prefixes(back, *suffix_order(back))
    at = np.arange(n, dtype=np.int64)
    found = []
    for r in (rank, suffix_order(symbols.max() - symbols)[1]):
        period = lyndon_ends(r) - at
        i = at[period * min_periods <= n]
        p = period[i]
        # words p apart agree from i on, and before i back to the start of the run
        after, before = forward.common(i, i + p), backward.common(n - i, n - i - p)
        start, end = i - before, i + p + after
        good = end - start >= np.maximum(min_words, min_periods * p)
        found.append(np.stack([start[good], (end - start)[good], p[good]], axis=1))
    runs = np.unique(np.concatenate(found), axis=0)
    return [tuple(x) for x in runs[np.lexsort((runs[:, 2], runs[:, 0]))].tolist()]


def stretches(words: list[bytes], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> Iterator[tuple[int, int]]:
    """First place and end of the stretches in which every word occurs ``min_periods`` times in the text; shorter than ``min_words`` they hold no run."""
    counts, start = Counter(words), 0
    for i, w in enumerate(words):
        if counts[w] < min_periods:
            if i - start >= min_words:
                yield start, i
            start = i + 1
    if len(words) - start >= min_words:
        yield start, len(words)


def word_runs(words: list[bytes], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """Runs of a whole text's words."""
    out = []
    for start, end in stretches(words, min_words, min_periods):
        numbers: dict[bytes, int] = {}
        symbols = np.array([numbers.setdefault(w, len(numbers)) for w in words[start:end]], dtype=np.int64)
        out += [(start + s, length, period) for s, length, period in runs_of(symbols, min_words, min_periods)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, without those that a run holds after its first period."""
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(keep).tolist()) if runs else b" ".join(words)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each text: ``key, n_words, runs, collapsed``.

    ``runs`` are structs of start (word number), length and period, by start
    and then period. Words are stretches of anything but the six ASCII white
    space characters. A null or empty text has no words and collapses to the
    empty text; repeated rows and ids, null ids too, each give a row; other
    columns are left. Texts are read whole; a worker's memory grows with the
    longest stretch of a text whose words all occur three times or more, by
    some 300 bytes a word.
    """
    if min_periods < 2 or min_words < 1:
        raise ValueError("a run has two periods and a word at least")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, texts = [], [], []
            for t in texts_of(batch):
                words = t.split()
                own = word_runs(words, min_words, min_periods)
                counts.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in own])
                texts.append(collapsed(words, own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, _RUNS), pa.array(texts, pa.binary()).cast(pa.string())], names=[key, "n_words", "runs", "collapsed"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def words_repeated_from(text: Column, number: Column) -> Column:
    """``text`` with its words from a place on replaced by repeats of a first few, place and number of these derived from ``number``.

    With ``n`` words the place is ``a = number % n`` and the few are ``1 + (n - a) div (3 + number % 8)``.
    """
    words = F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (number % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + number % 8))).cast("int")
        rest = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), rest), " ")

    # a bound variable, so that the words are split once
    return F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise("")), F.lit(0))


def highest_run(runs: Column) -> Column:
    """The run of greatest exact length by period; of equal ones the first by start and period, as ``runs`` are ordered. Null if there is none."""
    better = lambda a, x: x["length"] * a["period"] > a["length"] * x["period"]
    return F.reduce(runs, F.get(runs, F.lit(0)), lambda a, x: F.when(better(a, x), x).otherwise(a))
