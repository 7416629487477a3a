"""Pluggable scorers. A scorer is fitted on labelled vectors and scores every row in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvida.operators.lineage import write_once
from corvida.session import ship_package
from corvida.sources.store import exists, read_bytes

#: Builders by name; each takes a seed and has fit(x, y) and score(x).
SCORERS: dict[str, type] = {}


def register(name: str):
    def add(cls):
        SCORERS[name] = cls
        return cls

    return add


@register("logistic")
class Logistic:
    """Ridge logistic regression by Newton steps."""

    def __init__(self, seed: int = 0, ridge: float = 1.0, steps: int = 25):
        self.seed, self.ridge, self.steps = seed, ridge, steps

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        x = np.hstack([np.ones((len(x), 1)), x])
        w = np.zeros(x.shape[1])
        penalty = np.full(len(w), self.ridge)
        penalty[0] = 1e-9
        for _ in range(self.steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
            w = w - np.linalg.solve(hessian, x.T @ (p - y) + penalty * w)
        self.w = w
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.w[0] + x @ self.w[1:], -30, 30)))


@register("gradual")
class Gradual(Logistic):
    """The same model by seeded steps over small batches, epoch by epoch, for what must stop early."""

    def __init__(self, seed: int = 0, rate: float = 0.05, ridge: float = 1e-4):
        self.generator, self.rate, self.ridge, self.w = np.random.default_rng(seed), rate, ridge, None

    def epoch(self, x: np.ndarray, y: np.ndarray, batch_size: int) -> None:
        x = np.hstack([np.ones((len(x), 1)), x])
        if self.w is None:
            self.w, self.first, self.second, self.t = (np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0)
        order = self.generator.permutation(len(x))
        for k in range(0, len(x), batch_size):
            b = order[k : k + batch_size]
            g = x[b].T @ (1 / (1 + np.exp(-np.clip(x[b] @ self.w, -30, 30))) - y[b]) / len(b) + self.ridge * self.w
            self.t += 1
            self.first, self.second = 0.9 * self.first + 0.1 * g, 0.999 * self.second + 0.001 * g * g
            self.w = self.w - self.rate * (self.first / (1 - 0.9**self.t)) / (np.sqrt(self.second / (1 - 0.999**self.t)) + 1e-8)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 20, batch_size: int = 64) -> Gradual:
        for _ in range(epochs):
            self.epoch(x, y, batch_size)
        return self


def log_loss(y: np.ndarray, p: np.ndarray) -> float:
    p = np.clip(p, 1e-15, 1 - 1e-15)
    return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


def check_scores(scorer, width: int) -> None:
    """A scorer takes rows of one width and returns a number from 0 to 1 for each, or ValueError."""
    p = np.asarray(scorer.score(np.zeros((2, width))))
    if p.shape != (2,) or not np.all((p >= 0) & (p <= 1)):
        raise ValueError(f"a scorer must return one number from 0 to 1 a row, not shape {p.shape}")


def _sample(rows: DataFrame, seed: int, most: int) -> DataFrame:
    """``most`` rows at most, those of the smallest hashed ids, with their order."""
    return rows.withColumn("h", F.xxhash64("id", F.lit(seed))).orderBy("h", "id").limit(most).select("id", "h", "x", "y")


def _ordered(sample: pa.Table, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and labels of a sample in the order of the hashed ids, wherever its rows met."""
    got = sample.sort_by([("h", "ascending"), ("id", "ascending")])
    return np.array(got["x"].to_pylist(), dtype=float), np.array(got["y"].to_pylist(), dtype=float)


def _arrays(rows: DataFrame, seed: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    return _ordered(_sample(rows, seed, most).toArrow(), seed)


def check_training(epochs: int, batch_size: int, patience: int) -> None:
    if epochs < 1 or batch_size < 1 or patience < 1:
        raise ValueError("epochs, batch_size and patience must be positive")


def _train(x: np.ndarray, y: np.ndarray, vx: np.ndarray, vy: np.ndarray, epochs: int, batch_size: int, seed: int, patience: int, options: dict) -> tuple[Gradual, list[dict], int]:
    if {*np.unique(y)} != {0.0, 1.0} or {*np.unique(vy)} != {0.0, 1.0}:
        raise ValueError("training and validation need both classes")
    scorer, history, best = Gradual(seed, **options), [], None
    for epoch in range(1, epochs + 1):
        scorer.epoch(x, y, batch_size)
        history.append({"epoch": epoch, "loss": log_loss(y, scorer.score(x)), "val_loss": log_loss(vy, scorer.score(vx))})
        if best is None or history[-1]["val_loss"] < best[1]:
            best = epoch, history[-1]["val_loss"], scorer.w.copy()
        elif epoch - best[0] >= patience:
            break
    scorer.w = best[2]
    check_scores(scorer, x.shape[1])
    return scorer, history, best[0]


def train_scorer(train: DataFrame, validation: DataFrame, epochs: int, batch_size: int = 64, seed: int = 0, patience: int = 5, most: int = 20_000, **options) -> tuple[Gradual, list[dict]]:
    """A ``gradual`` scorer and its history ``epoch, loss, val_loss``; it keeps the weights of its best epoch.

    Training ends after ``patience`` epochs without a lower validation loss. Both
    parts are samples of at most ``most`` rows, as in ``fit_scorer``.
    """
    check_training(epochs, batch_size, patience)
    return _train(*_arrays(train, seed, most), *_arrays(validation, seed, most), epochs, batch_size, seed, patience, options)[:2]


class _Sums:
    """Weighted sums over all rows, made in the tasks that hold them and added by Spark."""

    def __init__(self, rows: DataFrame):
        ship_package(rows.sparkSession)
        self.rows = rows.select(F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
        first = self.rows.agg(F.min(F.size("x")), F.max(F.size("x")), F.count_distinct("y"), F.min("y"), F.max("y")).first()
        if first[2] != 2 or (first[3], first[4]) != (0.0, 1.0):
            raise ValueError("rows of both classes are needed")
        if first[0] != first[1]:
            raise ValueError("vectors of different lengths")
        self.width = first[0] + 1

    def over(self, w: np.ndarray, gram: bool) -> np.ndarray:
        """Gradient of the log loss at ``w``, then the number of rows and, with ``gram``, the flattened second derivative."""
        width, sent = self.width, self.rows.sparkSession.sparkContext.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(width + 1 + (width * width if gram else 0))
            for batch in batches:
                x = np.hstack([np.ones((batch.num_rows, 1)), batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width - 1)])
                p = 1 / (1 + np.exp(-np.clip(x @ sent.value, -30, 30)))
                out[:width] += x.T @ (p - batch.column(1).to_numpy())
                out[width] += batch.num_rows
                if gram:
                    out[width + 1 :] += ((x * (p * (1 - p))[:, None]).T @ x).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out)), pa.int64()), pa.array(out)], names=["k", "v"])

        # a row for each number: no task adds more than one number of each other task
        added = self.rows.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").toArrow()
        sent.destroy()
        return added["v"].to_numpy()


def fit_all(rows: DataFrame, ridge: float = 1.0, steps: int = 25, tolerance: float = 1e-12) -> Logistic:
    """``Logistic`` fitted on all ``rows(x, y)`` by Newton steps over sums that Spark adds; the driver holds a matrix of the vectors' width.

    Rows with a null are left; a vector of another length or a single class is an error.
    """
    sums = _Sums(rows)
    penalty = np.full(sums.width, float(ridge))
    penalty[0] = 1e-9
    scorer = Logistic(ridge=ridge, steps=steps)
    scorer.w = np.zeros(sums.width)
    for _ in range(steps):
        got = sums.over(scorer.w, True)
        step = np.linalg.solve(got[sums.width + 1 :].reshape(sums.width, -1) + np.diag(penalty), got[: sums.width] + penalty * scorer.w)
        scorer.w = scorer.w - step
        if np.abs(step).max() <= tolerance * max(1.0, np.abs(scorer.w).max()):
            break
    return scorer


def fit_descent(rows: DataFrame, rate: float = 1.0, steps: int = 10, ridge: float = 0.0) -> Logistic:
    """``Logistic`` by ``steps`` full gradient steps over all rows, for vectors too wide for a matrix: mean gradient, fixed rate, from zero."""
    sums = _Sums(rows)
    scorer = Logistic(ridge=ridge, steps=steps)
    scorer.w = np.zeros(sums.width)
    for _ in range(steps):
        got = sums.over(scorer.w, False)
        scorer.w = scorer.w - rate * (got[: sums.width] / got[sums.width] + ridge * scorer.w)
    return scorer


_HISTORY = "seed long, epoch int, loss double, val_loss double, best boolean, weights array<double>"


def train_seeds(train: DataFrame, validation: DataFrame, seeds: list[int], epochs: int, batch_size: int = 64, patience: int = 5, most: int = 20_000, **options) -> DataFrame:
    """``seed, epoch, loss, val_loss, best, weights``: a row for each epoch of each seed's training; weights stand with the best epoch, which is kept.

    What ``train_scorer`` does for one seed runs here for all of them, each in a
    task of its own on its samples of ``most`` rows at most (a documented bound,
    so a task's memory doesn't grow with the data); the driver collects no row.
    """
    if len(set(seeds)) != len(seeds) or not seeds:
        raise ValueError("seeds must be given and differ")
    check_training(epochs, batch_size, patience)
    ship_package(train.sparkSession)

    def sampled(rows: DataFrame) -> DataFrame:
        # both sides may come from one table; a column of the same origin is lost where they meet
        rows, out = rows.select(F.col("id").alias("id"), F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y")), None
        for seed in seeds:
            part = _sample(rows, seed, most).withColumn("seed", F.lit(seed).cast("long"))
            out = part if out is None else out.unionAll(part)
        return out

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        seed = key[0].as_py()
        scorer, history, best = _train(*_ordered(left, seed), *_ordered(right, seed), epochs, batch_size, seed, patience, options)
        rows = [{"seed": seed, **h, "best": h["epoch"] == best, "weights": scorer.w.tolist() if h["epoch"] == best else None} for h in history]
        return pa.Table.from_pylist(rows, schema=pa.schema([("seed", pa.int64()), ("epoch", pa.int32()), ("loss", pa.float64()), ("val_loss", pa.float64()), ("best", pa.bool_()), ("weights", pa.list_(pa.float64()))]))

    return sampled(train).groupBy("seed").cogroup(sampled(validation).groupBy("seed")).applyInArrow(run, _HISTORY)


def save_scorer(path: str, scorer: Logistic, history: list[dict]) -> str:
    """Weights and history in two new JSON files, ``path`` and ``path.history.json``; the digest of the weights."""
    if exists(path) or exists(f"{path}.history.json"):
        raise FileExistsError(path)
    write_once(f"{path}.history.json", history)
    return write_once(path, {"schema_version": 1, "weights": scorer.w.tolist()})


def load_scorer(path: str) -> Logistic:
    stored = json.loads(read_bytes(path))
    if stored.get("schema_version") != 1 or not np.all(np.isfinite(stored["weights"])):
        raise ValueError(f"{path} holds no scorer")
    scorer = Logistic()
    scorer.w = np.array(stored["weights"])
    return scorer


def fit_scorer(rows: DataFrame, name: str = "logistic", seed: int = 0, most: int = 20_000, **options):
    """Fit on at most ``most`` rows of ``(id, x, y)``, those of the smallest hashed ids."""
    return SCORERS[name](seed, **options).fit(*_arrays(rows, seed, most))


def apply_scorer(rows: DataFrame, scorer) -> DataFrame:
    """``id, p`` of ``rows(id, x)``."""
    ship_package(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(x) if len(x) else np.zeros(0))], names=["id", "p"])

    return rows.select("id", "x").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, p double")
