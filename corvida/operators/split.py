"""Group-disjoint, stratified train, validation and test splits."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvida.operators.ordered import running_sums
from corvida.session import Stage, ship_package

SPLITS = ("train", "validation", "test")


def check_ratios(train: float, validation: float) -> tuple[float, float, float]:
    """All three shares; each must be finite and positive."""
    shares = (train, validation, 1 - train - validation)
    if not all(math.isfinite(x) and x > 1e-12 for x in shares):
        raise ValueError("train and validation must be positive and leave a positive remainder")
    return shares


def component_table(rows: DataFrame, component: str = "component", label: str = "label") -> DataFrame:
    """``component, size, n0, n1`` of labelled rows."""
    return rows.where(F.col(label).isNotNull()).groupBy(F.col(component).alias("component")).agg(F.count("*").alias("size"), F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))


def rank_split(rows: DataFrame, train: float = 0.7, validation: float = 0.15, component: str = "component", label: str = "label") -> DataFrame:
    """``component, split``: components by their place in the order of their hashed ids, within strata with and without class 0.

    Fully distributed; needs five or more components in each stratum to fill all splits.
    """
    check_ratios(train, validation)
    parts = component_table(rows, component, label).select("component", (F.col("n0") > 0).cast("int").alias("stratum"), F.md5(F.col("component").cast("string").cast("binary")).alias("h"), F.lit(1).cast("long").alias("one"))
    totals = parts.groupBy("stratum").agg(F.count("*").alias("total"))
    placed = running_sums(parts, ["stratum"], ["h", "component"], {"before": "one"}).join(F.broadcast(totals), "stratum")
    share = (F.col("before") + 0.5) / F.col("total")
    return placed.select("component", F.when(share < train, "train").when(share < train + validation, "validation").otherwise("test").alias("split"))


def allocate(parts: list[tuple], train: float, validation: float) -> list[str]:
    """Greedy allocation of ``(n0, n1)`` pairs in the order given.

    Each goes to the split where it covers most labels the split lacks; then
    where the squared, target-weighted gap to the wanted counts grows least;
    then to the first in the order of SPLITS.
    """
    counts = np.array(parts, dtype=float).reshape(-1, 2)
    wanted = np.outer(check_ratios(train, validation), counts.sum(axis=0))
    held, out = np.zeros_like(wanted), []
    for row in counts:
        lacking = ((held == 0) & (row > 0)).sum(axis=1)
        growth = np.divide((held + row - wanted) ** 2 - (held - wanted) ** 2, wanted, out=np.zeros_like(wanted), where=wanted > 0)
        # a stable sort leaves ties in the order of SPLITS
        best = int(np.lexsort((growth.sum(axis=1), -lacking))[0])
        held[best] += row
        out.append(SPLITS[best])
    return out


def greedy_split(rows: DataFrame, train: float = 0.7, validation: float = 0.15, seed: int = 0, shuffle: str = "md5", component: str = "component", label: str = "label", row_order: str = "sample_id") -> DataFrame:
    """``component, split`` by greedy allocation of components, largest first.

    The order before the stable sort by size is a seeded shuffle: ``md5`` of
    seed and id, or ``twister``, Python's generator over components in the
    order of their first row. Each step depends on all before it, so one task
    folds over the component table, which has a row per component and no data.
    """
    check_ratios(train, validation)
    ship_package(rows.sparkSession)
    first = rows.where(F.col(label).isNotNull()).groupBy(F.col(component).alias("component")).agg(F.min(row_order).alias("first"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("component").cast("string")).cast("binary"))
    parts = component_table(rows, component, label).join(first, "component").withColumn("h", key)
    kind = rows.schema[component].dataType.simpleString()

    def fold(pdf):
        pdf = pdf.sort_values("first" if shuffle == "twister" else ["h", "component"], kind="stable").reset_index(drop=True)
        if shuffle == "twister":
            order = list(range(len(pdf)))
            random.Random(seed).shuffle(order)
            pdf = pdf.iloc[order]
        pdf = pdf.sort_values("size", ascending=False, kind="stable")
        pdf["split"] = allocate(list(zip(pdf["n0"].tolist(), pdf["n1"].tolist())), train, validation)
        return pdf[["component", "split"]]

    return parts.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fold, f"component {kind}, split string")


def whole_shares(train: float, validation: float) -> list[int]:
    """The three shares as smallest whole numbers, of their decimal digits: 0.7, 0.15 and the rest are 14, 3 and 3."""
    check_ratios(train, validation)
    exact = [Fraction(repr(float(train))), Fraction(repr(float(validation)))]
    exact.append(1 - sum(exact))
    scale = math.lcm(*(x.denominator for x in exact))
    whole = [int(x * scale) for x in exact]
    return [x // math.gcd(*whole) for x in whole]


class Run:
    """Allocation of equal ``(n0, n1)`` components, in whole numbers, so that ties are ties.

    The squared, target-weighted gap of a split grows by ``(b + i * d) / w``
    with the ``i``-th component it gets, up to what all splits share: three
    arithmetic progressions. The greedy choice merges them by value, so how
    many of the first ``m`` go to each split follows by bisection.
    """

    def __init__(self, pair: tuple[int, int], totals: tuple[int, int], held: list[list[int]], weights: list[int]):
        other = (totals[1] or 1, totals[0] or 1)
        self.pair, self.weights = pair, weights
        self.b = [sum(n * (2 * h + n) * t for n, h, t in zip(pair, own, other)) for own in held]
        self.d = 2 * sum(n * n * t for n, t in zip(pair, other))

    def place(self, s: int, i: int) -> int:
        """How many choices come before the ``i``-th of split ``s``."""
        value, out = self.b[s] + i * self.d, i
        for t, w in enumerate(self.weights):
            if t != s:
                # those of t below value * w / weight, or equal to it if t comes first
                most = value * w - self.b[t] * self.weights[s]
                step = self.d * self.weights[s]
                out += max(0, (most // step + 1 if t < s else -(-most // step)))
        return out

    def counts(self, m: int) -> list[int]:
        """How many of the first ``m`` each split gets."""
        out = []
        for s in range(len(self.weights)):
            lo, hi = 0, m
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if self.place(s, mid) < m else (lo, mid)
            out.append(lo)
        return out

    def next(self, counts: list[int]) -> int:
        """The split of the next component after ``counts`` of them."""
        keys = [Fraction(b + c * self.d, w) for b, c, w in zip(self.b, counts, self.weights)]
        return keys.index(min(keys))


def fold_runs(runs: list[tuple[int, int, int]], weights: list[int]) -> list[tuple[list[int], list[list[int]]]]:
    """For each run ``(n0, n1, how many)``, in order: the splits of its first few components, one by one while a split lacks a label that they have, and what all splits hold after those."""
    totals = tuple(sum(r[k] * r[2] for r in runs) for k in (0, 1))
    held, out = [[0, 0] for _ in weights], []
    for n0, n1, many in runs:
        pair, singles = (n0, n1), []
        while len(singles) < many:
            lacking = [sum(h == 0 and n > 0 for h, n in zip(own, pair)) for own in held]
            if not any(lacking):
                break
            run = Run(pair, totals, held, weights)
            s = min(range(len(weights)), key=lambda s: (-lacking[s], Fraction(run.b[s], weights[s]), s))
            singles.append(s)
            held[s] = [h + n for h, n in zip(held[s], pair)]
        out.append((singles, [own[:] for own in held]))
        for s, c in enumerate(Run(pair, totals, held, weights).counts(many - len(singles))):
            held[s] = [h + c * n for h, n in zip(held[s], pair)]
    return out


def greedy_run_split(rows: DataFrame, train: float = 0.7, validation: float = 0.15, seed: int = 0, component: str = "component", label: str = "label") -> DataFrame:
    """``component, split`` by greedy allocation, largest first, without a task for all components.

    Components are taken by size, then by more rows of class 0, then by the md5
    of seed and id. Those with equal counts stand together, so the allocation
    folds over the distinct pairs of counts (of ``n`` rows ``n ** (2 / 3)`` at
    most, however many components) and a component's place among its equals,
    from sampled ranges, tells its split. Costs are whole numbers.
    """
    weights, stage = whole_shares(train, validation), Stage(rows.sparkSession, "runs")
    ship_package(rows.sparkSession)
    spark, kind = rows.sparkSession, rows.schema[component].dataType.simpleString()
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("component").cast("string")).cast("binary"))
    parts = stage.write(component_table(rows, component, label).select("component", "n0", "n1", key.alias("h"), F.lit(1).cast("long").alias("one")))
    runs = [tuple(r) for r in parts.groupBy("n0", "n1").agg(F.count("*")).orderBy(F.desc(F.col("n0") + F.col("n1")), F.desc("n0")).collect()]
    totals = tuple(sum(r[k] * r[2] for r in runs) for k in (0, 1))
    made = [(n0, n1, singles, [str(x) for own in held for x in own]) for (n0, n1, _), (singles, held) in zip(runs, fold_runs(runs, weights))]
    placed = running_sums(parts, ["n0", "n1"], ["h", "component"], {"place": "one"})
    joined = placed.join(spark.createDataFrame(made, "n0 long, n1 long, singles array<int>, held array<string>"), ["n0", "n1"])
    ordered = joined.select("component", "n0", "n1", F.col("place").cast("long").alias("place"), "singles", "held").repartitionByRange("n0", "n1", "place").sortWithinPartitions("n0", "n1", "place")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, pair, at, counts = None, None, -1, []
        for batch in batches:
            said = []
            for n0, n1, place, singles, held in zip(*(batch.column(k).to_pylist() for k in range(1, 6))):
                if (n0, n1) != pair:
                    numbers = [int(x) for x in held]
                    pair, run, at = (n0, n1), Run((n0, n1), totals, [numbers[k : k + 2] for k in range(0, len(numbers), 2)], weights), -1
                if place < len(singles):
                    said.append(SPLITS[singles[place]])
                    continue
                if place - len(singles) != at:
                    at = place - len(singles)
                    counts = run.counts(at)
                s = run.next(counts)
                counts[s] += 1
                at += 1
                said.append(SPLITS[s])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], names=["component", "split"])

    return ordered.mapInArrow(deal, f"component {kind}, split string")


def coverage(rows: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """One row: how many of the six pairs of split and class have rows."""
    return rows.where(F.col(label).isNotNull()).agg(F.count_distinct(split, label).alias("pairs"))
