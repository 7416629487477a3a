"""Multinomial draws by binomial splitting: a task makes the counts of its own groups and no row for a slot exists.

A draw of ``G`` groups with replacement is a multinomial count of each. Its
``G`` slots are split over halves of the range of places, those over halves
again, each time by a binomial number that a hash of the seed, the draw and the
range decides. So a task that holds some places follows the ranges around them
from the top, and tasks agree on the ranges they share without a word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvida.session import ship_package

#: Ranges wider than this are kept while a task runs, and places counted at once.
_WIDE, _PLACES = 1 << 14, 1024
_MASK = (1 << 32) - 1
#: Fixed value: the multiplier of a public 32-bit integer hash.
MULTIPLIER = 0x45D9F3B


def mixed(x: np.ndarray) -> np.ndarray:
    """A 32-bit hash of 32-bit numbers, all in 64 bits."""
    for _ in range(2):
        x = ((x >> np.uint64(16)) ^ x) * np.uint64(MULTIPLIER) & np.uint64(_MASK)
    return (x >> np.uint64(16)) ^ x


def uniforms(seed: int, attempts: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """A number between 0 and 1 for each draw at the range from ``lo`` to ``hi``."""
    h = mixed(mixed(np.array([seed & _MASK], dtype=np.uint64)) ^ attempts.astype(np.uint64))
    # one after the other, so that for each range all draws have numbers of their own
    word = mixed((mixed((h + np.uint64(lo)) & np.uint64(_MASK)) + np.uint64(hi)) & np.uint64(_MASK))
    return (mixed(word).astype(np.float64) + 0.5) / 4294967296.0


def _cumulated(n: int, p: float) -> tuple[int, np.ndarray]:
    """First number and cumulated probabilities of a binomial, without tails of less than 1e-30."""
    mean, sd = n * p, math.sqrt(n * p * (1 - p))
    low, high = max(0, math.floor(mean - 12 * sd - 12)), min(n, math.ceil(mean + 12 * sd + 12))
    if high - low < 2:
        return low, np.array([(1 - p) ** n if low == 0 else 0.0, 1.0])[: high - low + 1]
    k = np.arange(low, high, dtype=np.float64)
    # ratios of neighbouring probabilities, from the mode outwards
    logs = np.concatenate([[0.0], np.cumsum(np.log((n - k) / (k + 1)) + math.log(p / (1 - p)))])
    mode = int(logs.argmax())
    at = low + mode
    peak = math.lgamma(n + 1) - math.lgamma(at + 1) - math.lgamma(n - at + 1) + at * math.log(p) + (n - at) * math.log(1 - p)
    return low, np.cumsum(np.exp(logs - logs[mode] + peak))


#: Halves of equal ranges ask for the same few tables.
_small = lru_cache(maxsize=1 << 14)(_cumulated)


def binomials(n: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """For each ``n`` the smallest number whose cumulated probability is ``u`` or more."""
    out = np.zeros(len(n), dtype=np.int64)
    order = np.argsort(n, kind="stable")
    values, first = np.unique(n[order], return_index=True)
    for value, at in zip(values.tolist(), np.split(order, first[1:])):
        if value:
            low, sums = (_small if value < 1024 else _cumulated)(value, p)
            out[at] = np.minimum(low + np.searchsorted(sums, u[at], "left"), value)
    return out


class Draws:
    """Counts of places in the draws ``first`` to ``last``, of ``groups`` places each."""

    def __init__(self, seed: int, first: int, last: int, groups: int):
        self.seed, self.attempts, self.groups = seed, np.arange(first, last), groups
        self.kept: dict[tuple[int, int], np.ndarray] = {}

    def counts(self, places: np.ndarray) -> np.ndarray:
        """A row for each of the sorted places, a column for each draw."""
        out = np.zeros((len(places), len(self.attempts)), dtype=np.int64)
        todo = [(0, self.groups, np.full(len(self.attempts), self.groups), 0, len(places))]
        while todo:
            lo, hi, n, a, b = todo.pop()
            if a == b:
                continue
            if hi - lo == 1:
                out[a:b] = n
                continue
            mid = (lo + hi) // 2
            left = self.kept.get((lo, hi))
            if left is None:
                left = binomials(n, (mid - lo) / (hi - lo), uniforms(self.seed, self.attempts, lo, hi))
                if hi - lo > _WIDE:
                    self.kept[lo, hi] = left
            cut = a + int(np.searchsorted(places[a:b], mid))
            todo += [(lo, mid, left, a, cut), (mid, hi, n - left, cut, b)]
        return out


SUMS = ["P", "N", "tp", "tn"]


def split_draw_sums(sized: DataFrame, seed: int, first: int, last: int, groups: int) -> DataFrame:
    """``attempt, seed, comparator, P, N, tp, tn``: sums over the draws ``first`` to ``last`` of ``sized(place, seed, comparator, P, N, tp, tn)``.

    Rows are dealt by ranges of places; a task sums its own draws before
    anything is shuffled, so it hands on a row for each draw, seed and
    comparator, however many groups it holds.
    """
    if groups > _MASK:
        raise ValueError("more than 2^32 - 1 groups")
    ship_package(sized.sparkSession)
    rows = sized.select("place", "seed", "comparator", *(F.col(c).cast("long").alias(c) for c in SUMS)).repartitionByRange("place").sortWithinPartitions("place")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws, sums, types = Draws(seed, first, last, groups), {}, None
        for batch in batches:
            types = [batch.schema.field(n).type for n in ("seed", "comparator")]
            place = batch.column(0).to_numpy()
            keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            own = np.stack([batch.column(3 + k).to_numpy(zero_copy_only=False) for k in range(4)], axis=1).astype(np.float64)
            unique, at = np.unique(place, return_inverse=True)
            number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            series = np.array([number[k] for k in keys], dtype=np.int64)
            for lo in range(0, len(unique), _PLACES):
                counts = draws.counts(unique[lo : lo + _PLACES]).astype(np.float64)
                for key, i in number.items():
                    rows_of = np.flatnonzero((series == i) & (at >= lo) & (at < lo + _PLACES))
                    # whole numbers under 2^53 are exact in double precision
                    part = counts[at[rows_of] - lo].T @ own[rows_of]
                    sums[key] = sums.get(key, 0) + part.astype(np.int64)
        for (one, comparator), s in sums.items():
            n = len(s)
            yield pa.RecordBatch.from_arrays([pa.array(draws.attempts, pa.int64()), pa.array([one] * n, types[0]), pa.array([comparator] * n, types[1]), *(pa.array(s[:, k], pa.int64()) for k in range(4))], names=["attempt", "seed", "comparator", *SUMS])

    made = rows.mapInArrow(run, f"attempt long, seed {kinds['seed']}, comparator {kinds['comparator']}, " + ", ".join(f"{c} long" for c in SUMS))
    return made.groupBy("attempt", "seed", "comparator").agg(*(F.sum(c).alias(c) for c in SUMS))


def splitting_sql(seed: int, attempts: int, sums: str) -> str:
    """CTEs ``groups_of`` to ``drawn(attempt, seed, comparator, P, N, tp, tn)`` that make the same draws of the relation ``sums(component, seed, comparator, P, N, tp, tn)``; the query must be ``WITH RECURSIVE``."""
    step, last = f"lambda x: (xor(x >> 16, x) * {MULTIPLIER}) & {_MASK}", "lambda x: xor(x >> 16, x)"
    mix = lambda x: f"list_transform(list_transform(list_transform([{x}], {step}), {step}), {last})[1]"
    word = mix(f"({mix(f'(h + lo) & {_MASK}')} + hi) & {_MASK}")
    # k is how many cumulated probabilities stay under u
    logs = "lgamma(c + 1) - lgamma(j + 1) - lgamma(c - j + 1) + j * ln(p) + (c - j) * ln(1 - p)"
    return f"""groups_of AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS place, count(*) OVER () AS n_groups FROM (SELECT DISTINCT component FROM {sums})),
ranges AS (SELECT a.range AS attempt, {mix(f"xor({mix(f'CAST({seed & _MASK} AS BIGINT)')}, a.range)")} AS h, CAST(0 AS BIGINT) AS lo, g.n_groups AS hi, g.n_groups AS c FROM range({attempts}) a, (SELECT DISTINCT n_groups FROM groups_of) g
  UNION ALL SELECT attempt, h, CASE WHEN right_half THEN mid ELSE lo END, CASE WHEN right_half THEN hi ELSE mid END, CASE WHEN right_half THEN c - k ELSE k END
  FROM (SELECT *, len(list_filter(list_transform(range(c), lambda j: list_sum(list_transform(range(j + 1), lambda j: exp({logs})))), lambda s: s < u)) AS k
    FROM (SELECT *, (lo + hi) // 2 AS mid, ((lo + hi) // 2 - lo) / CAST(hi - lo AS DOUBLE) AS p, ({mix(word)} + 0.5) / CAST(4294967296 AS DOUBLE) AS u FROM ranges WHERE hi - lo > 1 AND c > 0)), (VALUES (true), (false)) v(right_half)),
drawn AS (SELECT r.attempt, s.seed, s.comparator, sum(c * P) AS P, sum(c * N) AS N, sum(c * tp) AS tp, sum(c * tn) AS tn
  FROM ranges r JOIN groups_of g ON r.hi - r.lo = 1 AND r.lo = g.place JOIN {sums} s USING (component) WHERE r.c > 0 GROUP BY ALL)"""
