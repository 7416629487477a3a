"""Hard negatives of anchors: blocked dense products against all vectors, in two passes.

Anchors are packed into blocks of bounded size, and one block at a time is
broadcast and multiplied with every chunk of the candidates as they are
scanned. Products of whole numbers are exact in double precision while they
stay under 2^53; vectors for which a bound of the product says otherwise are
multiplied as Python integers instead.

The first pass keeps each anchor's best rows of its own label: every task holds
a few for each anchor of the block, and those of all tasks are merged by a
window. The second pass multiplies again and keeps, for each anchor and
positive, the best rows of another label within a window of scores under the
positive's. A label that holds most rows costs no more than any other, as no
row is shuffled: only the few kept ones are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvida.llm.common import bounded_batches
from corvida.session import Stage

#: Positives of an anchor, negatives of a positive.
POSITIVES, NEGATIVES = 5, 5
#: Per cent of the positive's score that a negative has at least and at most.
WINDOW = (80, 100)
#: Numbers and anchors in a block at most (16 MB), rows and numbers of a chunk of candidates.
BLOCK_NUMBERS, BLOCK_ROWS, CHUNK_ROWS, CHUNK_NUMBERS = 1 << 21, 1 << 15, 1024, 1 << 20
_EXACT, _LONG = float(1 << 53), (1 << 63) - 1


def _vectors(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimension, rows and whole-number matrix of the vectors of a batch, by dimension."""
    vectors = batch.column(batch.schema.get_field_index("v"))
    ends = vectors.offsets.to_numpy()
    flat, sizes = vectors.values.to_numpy(zero_copy_only=False), np.diff(ends)
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield dim, rows, np.floor(scale * flat[ends[rows][:, None] + np.arange(dim)])


def _largest(m: np.ndarray) -> np.ndarray:
    return np.abs(m).max(axis=1, initial=0)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b``, which hold whole numbers; one that exceeds 64 bits is refused."""
    out = (a @ b.T).astype(np.int64) if a.shape[1] * _largest(a).max(initial=0) * _largest(b).max(initial=0) < _EXACT else None
    if out is None:
        wide = [[int(x) for x in row] for row in b.tolist()]
        exact = [[sum(int(x) * y for x, y in zip(row, other)) for other in wide] for row in a.tolist()]
        if any(abs(s) > _LONG for row in exact for s in row):
            raise ValueError("an inner product exceeds 64 bits")
        out = np.array(exact, dtype=np.int64).reshape(len(a), len(b))
    return out


class Block:
    """Anchors of one dimension and, of each, windows of scores in which its best rows are wanted."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, m: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, most: int):
        self.ids, self.labels, self.m, self.low, self.high, self.same, self.most = ids, labels, m, low, high, same, most
        shape = (*low.shape, most)
        self.scores, self.found, self.held = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, bool)
        self.large = _largest(m)

    def meet(self, ids: np.ndarray, labels: np.ndarray, m: np.ndarray) -> None:
        """Keep the best of these rows and of those kept so far."""
        # the few rows that need integers are multiplied apart
        wide = self.m.shape[1] * self.large.max(initial=0) * _largest(m) >= _EXACT
        for rows in (np.flatnonzero(~wide), np.flatnonzero(wide)):
            for first in range(0, len(self.ids) if len(rows) else 0, CHUNK_ROWS):
                self._meet(slice(first, first + CHUNK_ROWS), ids[rows], labels[rows], m[rows])

    def _meet(self, part: slice, ids: np.ndarray, labels: np.ndarray, m: np.ndarray) -> None:
        s = products(self.m[part], m)
        may = self.labels[part, None] == labels
        if not self.same:
            may = ~may
        may &= self.ids[part, None] != ids
        for k in range(self.low.shape[1]):
            full = self.held[part, k].all(axis=1)
            worst = np.where(full, self.scores[part, k].min(axis=1), self.low[part, k])
            good = may & (s >= np.maximum(worst, self.low[part, k])[:, None]) & (s <= self.high[part, k, None])
            at, col = np.nonzero(good)
            if len(at):
                self._keep(part, k, at, s[at, col], ids[col])

    def _keep(self, part: slice, k: int, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(at)
        old, slot = np.nonzero(self.held[part, k][touched])
        old = touched[old]
        at, scores, ids = np.concatenate([at, old]), np.concatenate([scores, self.scores[part, k][old, slot]]), np.concatenate([ids, self.found[part, k][old, slot]])
        order = np.lexsort((ids, -scores, at))
        at, scores, ids = at[order], scores[order], ids[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        first = place < self.most
        at, place = at[first], place[first]
        for mine, new in ((self.scores, scores), (self.found, ids)):
            mine[part, k][at, place] = new[first]
        self.held[part, k][at, place] = True

    def rows(self) -> list[np.ndarray]:
        """Anchor, window, score and id of all that is kept."""
        anchor, k, slot = np.nonzero(self.held)
        return [anchor, k, self.scores[anchor, k, slot], self.found[anchor, k, slot]]


_COLUMNS = ["anchor", "k", "score", "vec_id"]


def _best(rows: DataFrame, make: dict, scale: float) -> DataFrame:
    """``anchor, k, score, vec_id, rank``: what is best over all rows for each anchor and window of a block; anchors are numbers in the block."""
    sent = rows.sparkSession.sparkContext.broadcast(make)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, dim = Block(**sent.value), [], sent.value["m"].shape[1]

        def empty() -> None:
            if held:
                block.meet(*(np.concatenate(x) for x in zip(*held)))
                held.clear()

        for batch in batches:
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for d, at, m in _vectors(batch, scale):
                if d == dim:
                    held.append((ids[at], labels[at], m))
            if sum(len(x[0]) for x in held) >= CHUNK_ROWS or sum(x[2].size for x in held) >= CHUNK_NUMBERS:
                empty()
        empty()
        found = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in block.rows()], names=_COLUMNS)
        for first in range(0, found.num_rows, 1 << 14):
            yield found.slice(first, 1 << 14)

    order = Window.partitionBy("anchor", "k").orderBy(F.desc("score"), "vec_id")
    kept = rows.mapInArrow(run, ", ".join(f"{c} long" for c in _COLUMNS))
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= make["most"])


def _blocks(anchors: DataFrame, scale: float, stage: Stage) -> DataFrame:
    """``block, dim, ids, labels, numbers``: anchors packed as bytes, each block of one dimension and bounded size."""
    count, numbers = anchors.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list[tuple[np.ndarray, ...]]] = {}

        def packed(dim: int) -> pa.RecordBatch:
            made = [pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in zip(*open_.pop(dim))]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *made], names=["dim", "ids", "labels", "numbers"])

        for batch in batches:
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for dim, rows, m in _vectors(batch, scale):
                most = min(BLOCK_ROWS, max(1, BLOCK_NUMBERS // max(1, dim)))
                while len(rows):
                    room = most - sum(len(x[0]) for x in open_.get(dim, []))
                    open_.setdefault(dim, []).append((ids[rows[:room]].astype(np.int64), labels[rows[:room]].astype(np.int64), m[:room]))
                    rows, m = rows[room:], m[room:]
                    if sum(len(x[0]) for x in open_[dim]) == most:
                        yield packed(dim)
        for dim in sorted(open_):
            yield packed(dim)

    parts = max(1, math.ceil(count / BLOCK_ROWS), math.ceil(numbers / BLOCK_NUMBERS))
    packed = anchors.repartition(parts).mapInArrow(pack, "dim int, ids binary, labels binary, numbers binary")
    return stage.write(packed.withColumn("block", F.monotonically_increasing_id()))


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(vectors: DataFrame, is_anchor: Column, scale: float = 1.0, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``vectors(vec_id, label, embedding)``.

    A score is the inner product with the anchor after each component becomes
    ``floor(scale * x)``; higher ones come first, equal ones by smaller id. An
    anchor's positives are its first rows of the same label; for each, the
    first rows of another label with a score within ``window`` (per cent of the
    positive's) are returned, ranked from 1. ``is_anchor`` is a condition on
    the columns.

    Rows with a null id, label or vector or any null or non-finite component
    take no part. Vectors of another length than the anchor's aren't compared
    with it; empty vectors have score 0 with one another. An id names one
    thing: a row that repeats the anchor's id is none of its positives or
    negatives, while repeated rows are anchors, positives and negatives of
    their own. Extra columns are left; an empty table and one without anchors
    give no row. A product over 64 bits is an error.
    """
    spark, stage = vectors.sparkSession, Stage(vectors.sparkSession, "hardneg")
    bounded_batches(spark)
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.withColumn("_anchor", F.coalesce(is_anchor, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"), "_anchor")
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))
    blocks = _blocks(rows.where("_anchor").drop("_anchor"), scale, stage)
    candidates, paths = rows.drop("_anchor"), []
    for number, dim in sorted(tuple(r) for r in blocks.select("block", "dim").collect()):
        # one block at a time passes through the driver, as a broadcast does
        packed = blocks.where(F.col("block") == number).first()
        ids, labels = (np.frombuffer(bytes(packed[c]), dtype=np.int64) for c in ("ids", "labels"))
        n = len(ids)
        block = {"ids": ids, "labels": labels, "m": np.frombuffer(bytes(packed["numbers"]), dtype=np.float64).reshape(n, dim)}
        every = np.full((n, 1), _LONG, dtype=np.int64)
        first = stage.write(_best(candidates, block | {"low": -every, "high": every, "same": True, "most": positives}, scale))
        anchor, place, score, positive = first.select("anchor", "rank", "score", "vec_id").toArrow().columns
        anchor, place, score = (x.to_numpy().astype(np.int64) for x in (anchor, place, score))
        low, high = np.full((n, positives), _LONG, dtype=np.int64), np.full((n, positives), -_LONG, dtype=np.int64)
        # whole scores within the window, in Python integers as a product of per cent may exceed 64 bits
        low[anchor, place - 1] = [-(-window[0] * s // 100) for s in score.tolist()]
        high[anchor, place - 1] = [window[1] * s // 100 for s in score.tolist()]
        best = _best(candidates, block | {"low": low, "high": high, "same": False, "most": negatives}, scale)
        named = first.select("anchor", (F.col("rank") - 1).cast("long").alias("k"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        anchor_ids = spark.createDataFrame(pa.table({"anchor": np.arange(n), "anchor_id": ids}))
        found = best.join(named, ["anchor", "k"]).join(anchor_ids, "anchor")
        out = stage.write(found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
        paths.append(stage.at[id(out)][1])
        stage.drop(first)
    return spark.read.schema(_RESULT).parquet(*paths) if paths else spark.createDataFrame([], _RESULT)
