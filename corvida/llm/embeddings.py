"""Embedding near-duplicates through NN-descent.

Equal vectors form one class first, and every class is a node with a number of
its own. A neighbour graph over the nodes starts from buckets of random
hyperplane codes, split to a fixed size where a code is common, and is refined
by local joins: each node shows its neighbours, in both directions, to one
another, and every node keeps the best it has seen. A list holds ``K``
neighbours; while all of them reach the threshold it is saturated and grows to
twice its length, up to ``MOST``. Of all links that a bucket or local join
computes and that the lists leave out a spanning forest is staged, and
components come from both.

A list that is saturated at ``MOST`` may hide more, outside its component too.
The exact way for those: saturated nodes of different components are compared
tile by tile, but for tiles whose centres and radii show that they are too far
apart. Links within a component are counted to the last: a component within
half the threshold's angle of its centre is linked throughout, and of any other
the members are dealt to tiles of near directions; two tiles whose centres and
radii show that all or none of their pairs link are settled by that, the rest
is compared. So no link within a component is lost and no group meets in one
task.

Recall is audited: the links of sampled nodes are found by comparing them with
all vectors, and each node with links counts once, by its share of links that
lie within one component. Nodes of groups of more than ``K`` and the other ones
are drawn and averaged apart, so a large group can't hide that small ones are
lost. The draw is enlarged until ``AUDIT_NODES`` nodes with links are met, or
all nodes or ``CHUNK`` numbers are. Rounds with fresh codes are added while
either average is below ``RECALL``; after ``MAX_ROUNDS`` all vectors are
compared, chunk by chunk.

An average says nothing of a few rare links, and a draw that meets no link says
nothing at all. So a sweep follows: so many more tables of codes, the links in
their buckets alone, that a pair at the threshold shares no bucket with a
chance of ``MISS`` at most, by the angle of the threshold, the bits of a code
and two more for codes that are common. If an audit after it still meets a lost
link, all vectors are compared.

Cosines are computed in double precision. Vectors that are null, empty, zero
or hold null or non-finite components link with nothing, nor do vectors of
different length. Every row is judged by its own vector: rows that repeat a
``vec_id`` with the same vector are one row of the class, with different ones
they are different nodes that share an id and nothing else. A null ``vec_id``
keeps its row without links. Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvida.llm.common import bounded_batches, salted_join
from corvida.operators.components import connected_components
from corvida.session import Stage

THRESHOLD = 0.95
#: Length of a neighbour list, of a saturated one at most, tables of a round, local joins of the first round.
K, MOST, TABLES, ROUNDS, MAX_ROUNDS = 10, 80, 4, 2, 6
BUCKET, TILE = 48, 128
#: Numbers in a chunk of vectors that is compared with a whole table at once.
CHUNK = 1 << 20
AUDITED, AUDIT_NODES, RECALL = 256, 64, 0.97
#: Chance that the sweep loses a pair at the threshold, tables of one of its steps.
MISS, SWEPT = 1e-6, 8
#: Angles nearer to a limit than this are settled by cosines.
_MARGIN = 1e-5


def _matrix(values: pa.Array, n: int) -> np.ndarray:
    """Unit rows in double precision."""
    x = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _groups(batch: pa.RecordBatch, ids: str, flat: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row, member ids and unit vectors of each group of a batch."""
    a, b = batch.column(ids), batch.column(flat)
    for i in range(batch.num_rows):
        members = a[i].values.to_numpy(zero_copy_only=False)
        yield i, members, _matrix(b[i].values, len(members))


def _forest(close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a spanning forest of the graph that joins row i and column j where ``close`` holds."""
    at_i, at_j = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
    close = close[np.ix_(at_i, at_j)]
    rows, cols = np.ones(len(at_i), bool), np.ones(len(at_j), bool)  # not reached yet
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while rows.any():
        front = np.array([rows.argmax()])
        rows[front] = False
        while len(front):
            reach = close[front] & cols
            j = np.flatnonzero(reach.any(axis=0))
            out_i.append(front[reach[:, j].argmax(axis=0)])
            out_j.append(j)
            cols[j] = False
            reach = close[:, j] & rows[:, None]
            front = np.flatnonzero(reach.any(axis=1))
            out_i.append(front)
            out_j.append(j[reach[front].argmax(axis=1)] if len(front) else front)
            rows[front] = False
    return at_i[np.concatenate(out_i)], at_j[np.concatenate(out_j)]


def _best(members: np.ndarray, sims: np.ndarray, worst: np.ndarray | None, threshold: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The best ``K`` others of every member that beat its worst neighbour so far, ``MOST`` if that many are links, and a forest of all links if these leave out any."""
    np.fill_diagonal(sims, -2)
    n = len(members)
    if n < 2:
        return []
    close = sims >= threshold
    most = int(min(n - 1, max(K, min(MOST, close.sum(axis=1).max()))))
    top = np.argpartition(-sims, most - 1, axis=1)[:, :most]
    s = np.take_along_axis(sims, top, axis=1)
    order = np.argsort(-s, axis=1, kind="stable")
    top, s = np.take_along_axis(top, order, axis=1), np.take_along_axis(s, order, axis=1)
    good = ((np.arange(most) < K) | (s >= threshold)) & (s > (worst[:, None] if worst is not None else -1.5))
    rows, _ = np.nonzero(good)
    out = [(members[rows], members[top[good]], s[good])]
    told = np.zeros_like(close)
    told[rows, top[good]] = True
    if (close & ~told & ~told.T).any():
        i, j = _forest(close)
        out.append((members[i], members[j], sims[i, j]))
    return out


_EDGES = "u long, v long, sim double"


def _edge_batch(parts: list) -> pa.RecordBatch:
    u, v, s = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64)), pa.array(s)], names=["u", "v", "sim"])


def _bucket_edges(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _edge_batch([x for _, ids, unit in _groups(batch, "ids", "flat") for x in _best(ids, unit @ unit.T, None, threshold)])


def _local_join(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        worst = batch.column("worst")
        yield _edge_batch([x for i, ids, unit in _groups(batch, "ids", "flat") for x in _best(ids, unit @ unit.T, worst[i].values.to_numpy(zero_copy_only=False), threshold)])


def _gathered(rows: DataFrame, by: list[str]) -> DataFrame:
    cols = [c for c in rows.columns if c not in by]
    out = rows.groupBy(*by).agg(F.collect_list(F.struct(*cols)).alias("x")).where(F.size("x") > 1)
    return out.select(*by, *(F.flatten(f"x.{c}").alias("flat") if c == "vec" else F.col(f"x.{c}").alias({"id": "ids"}.get(c, c)) for c in cols))


def _bits(count: int) -> int:
    """Bits of a code by which a bucket of spread vectors has ``BUCKET`` of them or some more."""
    return min(24, max(1, int(np.log2(max(2, count / BUCKET)))))


def _codes(nodes: DataFrame, dims: int, count: int, round_: int, tables: int) -> DataFrame:
    """``table, code, id, vec``: signs of random projections, with a salt where a code is common."""
    bits = _bits(count)
    planes = np.random.default_rng(1000 + round_).normal(size=(tables, bits, dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(bits)
        for batch in batches:
            vec, n = batch.column(1), batch.num_rows
            unit = _matrix(vec.flatten(), n)
            code = np.stack([((unit @ planes[t].T) > 0) @ powers for t in range(tables)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), vec, pa.array(code.tolist(), pa.list_(pa.int64()))], names=["id", "vec", "codes"])

    coded = nodes.select("id", "vec").mapInArrow(run, f"id long, vec {nodes.schema['vec'].dataType.simpleString()}, codes array<long>")
    return coded.select("id", "vec", F.posexplode("codes").alias("table", "code"))


def _bucket_graph(nodes: DataFrame, dims: int, count: int, round_: int, threshold: float, stage: Stage, tables: int = TABLES) -> DataFrame:
    """``u, v, sim`` found in the buckets of one round, staged."""
    coded = stage.write(_codes(nodes, dims, count, round_, tables))
    # a table of its own, so that the join can split a common code
    sizes = stage.write(coded.groupBy("table", "code").agg(F.count("*").alias("n")).where("n > 1"))
    # common codes are dealt over parts at random, others than in the next table or round
    part = F.pmod(F.xxhash64("id", "table", F.lit(round_)), F.ceil(F.col("n") / (2 * BUCKET)))
    rows = coded.join(sizes, ["table", "code"]).select("table", "code", part.alias("part"), "id", "vec")
    found = stage.write(_gathered(rows, ["table", "code", "part"]).select("ids", "flat").mapInArrow(lambda batches: _bucket_edges(batches, threshold), _EDGES))
    stage.drop(coded, sizes)
    return found


def _lists(edges: DataFrame, threshold: float) -> DataFrame:
    """``u, v, sim, rank, n``: the best neighbours of every node, ``K`` or, where those are links, twice as many, and so on up to ``MOST``."""
    best = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    rows = edges.groupBy("u", "v").agg(F.max("sim").alias("sim")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= MOST)
    kept, k = F.col("rank") <= K, K
    while k < MOST:
        full = F.max(F.when(F.col("rank") == k, F.col("sim"))).over(Window.partitionBy("u")) >= threshold
        kept, k = kept | (F.coalesce(full, F.lit(False)) & (F.col("rank") <= 2 * k)), 2 * k
    return rows.withColumn("kept", kept).where("kept").drop("kept").withColumn("n", F.count("*").over(Window.partitionBy("u")))


def _descend(graph: DataFrame, nodes: DataFrame, threshold: float, stage: Stage) -> DataFrame:
    """``u, v, sim`` found by one round of local joins, staged. A long list shows its first and last ``K``."""
    lengths = [K]
    while lengths[-1] < MOST:
        lengths.append(2 * lengths[-1])
    full = (F.col("n") >= MOST) | (F.col("n").isin(*lengths) & (F.col("least") < threshold))
    worst = graph.groupBy("u").agg(F.max("n").alias("n"), F.min("sim").alias("least")).select("u", F.when(full, F.col("least")).otherwise(-1.5).alias("worst"))
    known = nodes.join(worst, nodes["id"] == worst["u"]).select("id", "vec", "worst")
    # ranked straight from the table, so that a hub's rows are cut to K in every task before they are shuffled
    seen = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim")
    seen = seen.withColumn("place", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))).where(F.col("place") <= K)
    shown = graph.where((F.col("rank") <= K) | (F.col("rank") > F.col("n") - K))
    around = shown.select("u", "v").unionAll(seen.select("u", "v")).unionAll(graph.where("rank = 1").select("u", F.col("u").alias("v"))).distinct()
    rows = around.join(known, around["v"] == known["id"]).select("u", "id", "vec", "worst")
    return stage.write(_gathered(rows, ["u"]).select("ids", "flat", "worst").mapInArrow(lambda batches: _local_join(batches, threshold), _EDGES))


def _ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Centre of each tile and its largest angle from there."""
    for batch in batches:
        centres, radii = [], []
        for _, _, unit in _groups(batch, "ids", "flat"):
            mean = unit.mean(axis=0)
            norm = np.sqrt(mean @ mean)
            centre = mean / norm if norm > 1e-6 else unit[0]
            centres.append(centre)
            radii.append(float(np.arccos(np.clip(unit @ centre, -1, 1)).max()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tolist() for c in centres], pa.list_(pa.float64())), pa.array(radii, pa.float64())], names=["tile", "component", "centre", "radius"])


def _close_tiles(balls: DataFrame, dims: int, threshold: float, stage: Stage) -> DataFrame:
    """``a, b``: tiles of different components that may hold a link, chunk by chunk."""
    chunks = -(-balls.count() * dims // CHUNK)
    out = None
    for k in range(chunks):
        rows = balls.where(F.pmod(F.xxhash64("tile"), F.lit(chunks)) == k).collect()  # a share of fixed size
        if not rows:
            continue
        tile, component, radius = (np.array([r[i] for r in rows]) for i in (0, 1, 3))
        centre = np.array([r[2] for r in rows])

        def run(batches: Iterator[pa.RecordBatch], tile=tile, component=component, radius=radius, centre=centre) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                other, of, r = (batch.column(c).to_numpy() for c in ("tile", "component", "radius"))
                angle = np.arccos(np.clip(centre @ _matrix(batch.column("centre").flatten(), batch.num_rows).T, -1, 1))
                # rounding must not part what meets exactly
                near = (angle <= radius[:, None] + r + np.arccos(threshold) + _MARGIN) & (component[:, None] != of) & (tile[:, None] < other)
                i, j = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(tile[i]), pa.array(other[j])], names=["a", "b"])

        found = stage.write(balls.mapInArrow(run, "a long, b long"))
        out = found if out is None else out.unionAll(found)
    return out


def _across(nodes: DataFrame, graph: DataFrame, linked: DataFrame, dims: int, threshold: float, stage: Stage) -> DataFrame | None:
    """``u, v, sim``: links that join nodes of different components whose lists are saturated at ``MOST``, a spanning forest for each two tiles."""
    full = graph.where((F.col("n") >= MOST) & (F.col("rank") == F.col("n")) & (F.col("sim") >= threshold)).select(F.col("u").alias("node"))
    rows = linked.join(full, "node").select("component", F.col("node").alias("id"))
    rows = rows.join(nodes.select("id", "vec"), "id")
    sizes = rows.groupBy("component").agg(F.ceil(F.count("*") / TILE).alias("parts"))
    rows = rows.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    made = rows.groupBy("component", "part").agg(F.collect_list(F.struct("id", "vec")).alias("x"), F.min("id").alias("tile"))
    made = stage.write(made.select("tile", "component", F.col("x.id").alias("ids"), F.flatten("x.vec").alias("flat")))
    balls = stage.write(made.mapInArrow(_ball, "tile long, component long, centre array<double>, radius double"))
    near = _close_tiles(balls, dims, threshold, stage)
    if near is None:
        return None
    left = made.select(F.col("tile").alias("a"), "ids", "flat")
    right = made.select(F.col("tile").alias("b"), F.col("ids").alias("ids2"), F.col("flat").alias("flat2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for (_, a, x), (_, b, y) in zip(_groups(batch, "ids", "flat"), _groups(batch, "ids2", "flat2")):
                sims = x @ y.T
                i, j = _forest(sims >= threshold)
                parts.append((a[i], b[j], sims[i, j]))
            yield _edge_batch(parts)

    pairs = near.join(left, "a").join(right, "b").select("ids", "flat", "ids2", "flat2")
    found = stage.write(pairs.mapInArrow(run, _EDGES))
    stage.drop(made, balls)
    return found


def _angle(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def _tile_counts(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Linked rows of the members of each tile, or of each pair of tiles, by cosines."""
    for batch in batches:
        ids, links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        same = batch.column("same").to_pylist()
        for (i, a, x), (_, b, y) in zip(_groups(batch, "ids", "flat"), _groups(batch, "ids2", "flat2")):
            close = x @ y.T >= threshold
            size_a, size_b = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("size", "size2"))
            if same[i]:
                np.fill_diagonal(close, False)
            ids.append(a)
            links.append(close @ size_b)
            if not same[i]:
                ids.append(b)
                links.append(size_a @ close)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids).astype(np.int64)), pa.array(np.concatenate(links).astype(np.int64))], names=["id", "links"])


_TILE_KEY = ["component", "part"]


def _collected(rows: DataFrame, stage: Stage) -> DataFrame:
    made = rows.groupBy(*_TILE_KEY).agg(F.collect_list(F.struct("id", "size", "vec")).alias("x"))
    return stage.write(made.select(*_TILE_KEY, F.col("x.id").alias("ids"), F.col("x.size").alias("size"), F.flatten("x.vec").alias("flat")))


def _per_tile(made: DataFrame, fn, schema: str) -> DataFrame:
    """The tile's key and what ``fn`` makes of its unit vectors (and of a unit centre, if the table has one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with_centre = "centre" in batch.schema.names
            out = [fn(unit, np.array(batch.column("centre")[i].as_py()) if with_centre else None) for i, _, unit in _groups(batch, "ids", "flat")]
            yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("part"), *map(pa.array, zip(*out))], names=names)

    names = [*_TILE_KEY, *(x.split()[0] for x in schema.split(", "))]
    return made.mapInArrow(run, f"component long, part long, {schema}")


def _unit(x: np.ndarray, other: np.ndarray) -> np.ndarray:
    norm = np.sqrt(x @ x)
    return x / norm if norm > 1e-6 else other


def _centre_and_radius(unit: np.ndarray, _) -> tuple[list[float], float]:
    centre = _unit(unit.mean(axis=0), unit[0])
    return centre.tolist(), float(_angle(unit, centre[None]).max())


def _centres(made: DataFrame, parts: DataFrame, stage: Stage) -> DataFrame:
    """``component, part, centre``: a unit vector in the middle of each component, for each of its tiles."""
    sums = _per_tile(made, lambda unit, _: (unit.sum(axis=0).tolist(),), "total array<double>")
    sums = sums.select("component", F.posexplode("total").alias("at", "x")).groupBy("component", "at").agg(F.sum("x").alias("x"))
    whole = sums.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("s"))  # as many numbers as a vector has
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda n, x: n + x * x))
    whole = whole.select("component", F.when(norm > 1e-6, F.transform("s", lambda x: x / norm)).otherwise(F.transform("s", lambda x: F.lit(0.0))).alias("centre"))
    return stage.write(whole.join(parts, "component").select("component", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "centre"))


def _cells(made: DataFrame, centres: DataFrame, dims: int, stage: Stage) -> DataFrame:
    """``component, id, size, vec, cell``: members with the signs of random projections of what sets them apart from the centre."""
    planes = np.random.default_rng(99).normal(size=(16, dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centre, sizes, bits = batch.column("centre"), batch.column("size"), batch.column("bits").to_pylist()
            for i, ids, unit in _groups(batch, "ids", "flat"):
                apart = unit - np.array(centre[i].as_py())
                cell = ((apart @ planes[: bits[i]].T) > 0) @ (1 << np.arange(bits[i])) if bits[i] else np.zeros(len(ids), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), batch.column("component")[i].as_py())), pa.array(ids), sizes[i].values, pa.array(unit.tolist(), pa.list_(pa.float64())), pa.array(cell.astype(np.int64))], names=["component", "id", "size", "vec", "cell"])

    return made.join(centres, _TILE_KEY).mapInArrow(run, "component long, id long, size long, vec array<double>, cell long")


def _tiles(members: DataFrame, dims: int, threshold: float, stage: Stage) -> DataFrame:
    """``id, links``: rows linked with each member of a component, other than those of its own class."""
    limit = float(np.arccos(threshold))
    sizes = stage.write(members.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("all"), F.ceil(F.count("*") / TILE).alias("parts")))
    dealt = members.join(sizes, "component").withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(F.lit(0).cast("long")))
    made = _collected(dealt, stage)
    own = [F.lit(True).alias("same"), "ids", "size", "flat", F.col("ids").alias("ids2"), F.col("size").alias("size2"), F.col("flat").alias("flat2")]
    count = lambda pairs: pairs.mapInArrow(lambda batches: _tile_counts(batches, threshold), "id long, links long")
    large = stage.write(sizes.where("parts > 1"))
    if not large.take(1):
        return count(made.select(*own))
    of_large = stage.write(made.join(large.select("component", "all", F.greatest(F.lit(0), F.least(F.lit(16), F.ceil(F.log2("parts")))).cast("int").alias("bits")), "component"))
    small = count(made.join(large, "component", "left_anti").select(*own))
    centres = _centres(of_large, large.select("component", "parts"), stage)
    reach = _per_tile(of_large.join(centres, _TILE_KEY), lambda unit, centre: (float(_angle(unit, centre[None]).max()),), "reach double")
    tight = stage.write(reach.groupBy("component").agg((F.max("reach") <= (limit - _MARGIN) / 2).alias("tight")))
    of_large = of_large.join(tight, "component")
    whole = of_large.where("tight").select("all", F.explode(F.arrays_zip("ids", "size")).alias("x")).select(F.col("x.ids").alias("id"), (F.col("all") - F.col("x.size")).alias("links"))
    # the members of the other ones again, now in tiles of near directions
    spread = stage.write(_cells(of_large.where("not tight"), centres, dims, stage))
    cells = spread.groupBy("component", "cell").agg(F.ceil(F.count("*") / TILE).alias("parts"))
    spread = spread.join(cells, ["component", "cell"]).withColumn("part", F.col("cell") * (1 << 40) + F.pmod(F.xxhash64("id"), F.col("parts")))
    fine = _collected(spread, stage)
    balls = _per_tile(fine, _centre_and_radius, "centre array<double>, radius double").join(fine.select(*_TILE_KEY, F.aggregate("size", F.lit(0).cast("long"), lambda n, x: n + x).alias("all")), _TILE_KEY)
    balls = stage.write(balls)
    # a ball meets those of its component in shares of about TILE, so that no component comes together in one task
    shares = balls.groupBy("component").agg(F.ceil(F.count("*") / TILE).alias("shares"))
    balls = stage.write(balls.join(shares, "component"))
    left = balls.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    right = balls.select("component", F.pmod(F.xxhash64("part"), F.col("shares")).alias("share"), *(F.col(c).alias(f"{c}2") for c in ("part", "centre", "radius", "all")))
    dot = F.aggregate(F.zip_with("centre", "centre2", lambda x, y: x * y), F.lit(0.0), lambda n, x: n + x)
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))
    pairs = left.join(right, ["component", "share"]).where("part <= part2").withColumn("apart", F.when(F.col("part") == F.col("part2"), F.lit(0.0)).otherwise(apart)).withColumn("radii", F.col("radius") + F.col("radius2"))
    pairs = pairs.where(F.col("apart") - F.col("radii") <= limit + _MARGIN).withColumn("sure", (F.col("part") != F.col("part2")) & (F.col("apart") + F.col("radii") <= limit - _MARGIN))
    pairs = stage.write(pairs.select("component", "part", "part2", "all", "all2", "sure"))
    sure = pairs.where("sure")
    sure = sure.select("component", "part", F.col("all2").alias("links")).unionAll(sure.select("component", F.col("part2").alias("part"), F.col("all").alias("links"))).groupBy(*_TILE_KEY).agg(F.sum("links").alias("links"))
    told = fine.join(sure, _TILE_KEY).select(F.explode("ids").alias("id"), "links")
    other = fine.select("component", F.col("part").alias("part2"), *(F.col(c).alias(f"{c}2") for c in ("ids", "size", "flat")))
    asked = pairs.where("not sure").join(fine, _TILE_KEY).join(other, ["component", "part2"]).select((F.col("part") == F.col("part2")).alias("same"), "ids", "size", "flat", "ids2", "size2", "flat2")
    return small.unionAll(whole).unionAll(told).unionAll(count(asked)).groupBy("id").agg(F.sum("links").alias("links"))


def _true_links(nodes: DataFrame, asked: list, threshold: float) -> DataFrame:
    """``a, b``: links of the rows ``asked``, ids and vectors, with all nodes."""
    ids = np.array([r[0] for r in asked], dtype=np.int64)
    x = np.array([r[1] for r in asked], dtype=np.float64)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            other, unit = batch.column(0).to_numpy(), _matrix(batch.column(1).flatten(), batch.num_rows)
            i, j = np.nonzero(x @ unit.T >= threshold)
            i, j = i[ids[i] != other[j]], j[ids[i] != other[j]]
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(other[j])], names=["a", "b"])

    return nodes.select("id", "vec").mapInArrow(run, "a long, b long")


def _audit(nodes: DataFrame, linked: DataFrame, threshold: float) -> float:
    """Share of a node's true links whose ends are in one component: the mean over audited nodes, the lower one of nodes in groups of more than ``K`` and of the others; 1 if no link is met."""
    large = linked.groupBy("component").count().where(F.col("count") > K).select("component")
    inside = linked.join(large, "component", "left_semi").select(F.col("node").alias("id"))
    of = lambda c: linked.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    means = []
    for how in ("left_semi", "left_anti"):
        most = AUDITED
        while True:
            asked = nodes.select("id", "vec").join(inside, "id", how).orderBy(F.xxhash64("id"), "id").limit(most).collect()  # CHUNK numbers at most
            if not asked:
                break
            true = _true_links(nodes, asked, threshold)
            rows = true.join(of("a"), "a", "left").join(of("b"), "b", "left").groupBy("a").agg(F.count("*"), F.count_if(F.col("of_a") == F.col("of_b"))).collect()  # a row per audited node at most
            if len(rows) >= AUDIT_NODES or len(asked) < most or 4 * most * len(asked[0][1]) > CHUNK:
                if rows:
                    means.append(float(np.mean([r[2] / r[1] for r in rows])))
                break
            most *= 4
    return min(means, default=1.0)


def sweep_tables(count: int, threshold: float) -> int:
    """Tables of the sweep by which a pair at the threshold shares a bucket but for a chance of ``MISS``."""
    met = (1 - np.arccos(threshold) / np.pi) ** (_bits(count) + 2)
    return int(np.ceil(np.log(MISS) / np.log1p(-met)))


def _bucket_links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links in each bucket."""
    for batch in batches:
        parts = []
        for _, ids, unit in _groups(batch, "ids", "flat"):
            close = unit @ unit.T >= threshold
            np.fill_diagonal(close, False)
            if close.any():
                i, j = _forest(close)
                parts.append((ids[i], ids[j], np.full(len(i), threshold)))
        yield _edge_batch(parts)


def _sweep(nodes: DataFrame, linked: DataFrame, dims: int, count: int, threshold: float, stage: Stage) -> DataFrame:
    """``u, v``: links between different components in the buckets of all tables of the sweep, staged step by step.

    A common code is cut by the signs of further projections, which seldom part
    a close pair; what is common after 16 of these is one dense group, whose
    links the lists have, and is dealt over parts.
    """
    bits, todo, out = _bits(count), sweep_tables(count, threshold), None
    for step in range(0, todo, SWEPT):
        tables = min(SWEPT, todo - step)
        planes = np.random.default_rng(5000 + step).normal(size=(tables, bits + 16, dims))

        def run(batches: Iterator[pa.RecordBatch], planes=planes, tables=tables) -> Iterator[pa.RecordBatch]:
            powers = 1 << np.arange(bits + 16)
            for batch in batches:
                unit = _matrix(batch.column(1).flatten(), batch.num_rows)
                code = np.stack([((unit @ planes[t].T) > 0) @ powers for t in range(tables)], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code.tolist(), pa.list_(pa.int64()))], names=["id", "vec", "codes"])

        coded = nodes.select("id", "vec").mapInArrow(run, f"id long, vec {nodes.schema['vec'].dataType.simpleString()}, codes array<long>")
        coded = stage.write(coded.select("id", "vec", F.posexplode("codes").alias("table", "all")).withColumn("code", F.col("all") % (1 << bits)))
        sizes = stage.write(coded.groupBy("table", "code").agg(F.count("*").alias("n")).where("n > 1"))
        more = F.greatest(F.lit(0), F.least(F.lit(16), F.ceil(F.log2(F.col("n") / (2 * BUCKET))))).cast("int")
        cell = F.shiftright("all", bits) % F.expr("shiftleft(CAST(1 AS BIGINT), more)")
        cut = stage.write(coded.join(sizes, ["table", "code"]).withColumn("more", more).withColumn("cell", cell).select("table", "code", "cell", "id", "vec"))
        cells = stage.write(cut.groupBy("table", "code", "cell").agg(F.count("*").alias("n")).where("n > 1"))
        part = F.pmod(F.xxhash64("id", "table"), F.ceil(F.col("n") / (8 * BUCKET)))
        # a key of its own, so that the parts of one cell don't stay where the join has them; buckets that share it are compared together
        rows = cut.join(cells, ["table", "code", "cell"]).select("table", F.xxhash64("code", "cell", part).alias("bucket"), "id", "vec")
        found = _gathered(rows, ["table", "bucket"]).select("ids", "flat").mapInArrow(lambda batches: _bucket_links(batches, threshold), _EDGES)
        found = found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        for end in ("u", "v"):
            found = found.join(linked.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
        new = stage.write(found.where(F.coalesce("of_u", "u") != F.coalesce("of_v", "v")).select("u", "v"))
        out = new if out is None else out.unionAll(new)
        stage.drop(coded, sizes, cut, cells)
    return out


def _all_links(nodes: DataFrame, count: int, dims: int, threshold: float, stage: Stage) -> DataFrame:
    """``u, v, sim``: a spanning forest of the links of every chunk with every batch of all vectors."""
    chunks = -(-count * dims // CHUNK)
    out = None
    for k in range(chunks):
        rows = nodes.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == k).select("id", "vec").collect()  # a share of fixed size
        if not rows:
            continue
        asked = np.array([r[0] for r in rows], dtype=np.int64)
        x = np.array([r[1] for r in rows], dtype=np.float64)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))

        def run(batches: Iterator[pa.RecordBatch], asked=asked, x=x) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                sims = x @ _matrix(batch.column(1).flatten(), batch.num_rows).T
                i, j = _forest((sims >= threshold) & (asked[:, None] != ids))
                yield _edge_batch([(asked[i], ids[j], sims[i, j])])

        found = stage.write(nodes.select("id", "vec").mapInArrow(run, _EDGES))
        out = found if out is None else out.unionAll(found)
    return out


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id``."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    stage = Stage(spark, "embeddings")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    nonzero = F.exists("vec", lambda x: x != 0)
    usable = F.coalesce(finite & nonzero, F.lit(False)) & F.col("vec_id").isNotNull()
    rows = rows.withColumn("vec", F.when(usable, F.col("vec")))
    rows = stage.write(rows.withColumn("key", F.sha2(F.to_json(F.struct("vec")), 256)))
    classes = rows.where("vec is not null").groupBy("key").agg(F.min("vec_id").alias("first_id"), F.count_distinct("vec_id").alias("size"), F.first("vec").alias("vec"))
    # the number of a class is fixed by the table that holds it
    classes = stage.write(classes.withColumn("id", F.monotonically_increasing_id()))
    found = None
    for (dims,) in classes.select(F.size("vec")).distinct().collect():
        nodes = stage.write(classes.where(F.size("vec") == dims).select("id", "size", "vec"))
        part = _of_one_length(nodes, dims, threshold, stage)
        found = part if found is None else found.unionByName(part)
    own = classes.select("key", "id", "size", "first_id")
    if found is None:
        own = own.withColumns({"component_id": F.col("first_id"), "links": F.lit(0).cast("long")})
    else:
        found = stage.write(found.join(classes.select("id", "first_id"), "id"))
        top = found.groupBy("component").agg(F.min("first_id").alias("component_id"))
        own = salted_join(own.join(found.select("id", "component", "links"), "id", "left"), top, "component", "id")
    own = own.select("key", F.coalesce("component_id", "first_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    joined = rows.select("vec_id", F.when(F.col("vec").isNotNull(), F.col("key")).alias("key")).join(own, "key", "left")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def _of_one_length(nodes: DataFrame, dims: int, threshold: float, stage: Stage) -> DataFrame:
    """``id, component, links`` of the linked nodes among vectors of one length."""
    count = nodes.count()
    graph, linked, links = None, None, None

    def learn(found: DataFrame, graph: DataFrame | None, links: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Lists and links with what was found; the tables before are dropped."""
        close = found.where(F.col("sim") >= threshold).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        new = stage.write(_lists(found if graph is None else found.unionAll(graph.select("u", "v", "sim")), threshold))
        kept = stage.write((close if links is None else close.unionAll(links)).distinct())
        stage.drop(found, graph, links)
        return new, kept

    for round_ in range(MAX_ROUNDS):
        graph, links = learn(_bucket_graph(nodes, dims, count, round_, threshold, stage), graph, links)
        for _ in range(ROUNDS if round_ == 0 else 1):
            graph, links = learn(_descend(graph, nodes, threshold, stage), graph, links)
        stage.drop(linked)
        linked = stage.write(connected_components(links, "u", "v"))
        more = _across(nodes, graph, linked, dims, threshold, stage)
        if more is not None and not more.isEmpty():
            links = stage.write(links.unionAll(more.select("u", "v")))
            linked = stage.write(connected_components(links, "u", "v"))
        if _audit(nodes, linked, threshold) >= RECALL:
            links = stage.write(links.unionAll(_sweep(nodes, linked, dims, count, threshold, stage)).distinct())
            linked = stage.write(connected_components(links, "u", "v"))
            lost = _audit(nodes, linked, threshold) < 1
            break
    else:
        lost = True
    if lost:
        linked = stage.write(connected_components(_all_links(nodes, count, dims, threshold, stage), "u", "v"))
    stage.drop(graph, links)
    members = nodes.join(linked, nodes["id"] == linked["node"]).select("component", "id", "size", "vec")
    return linked.withColumnRenamed("node", "id").join(_tiles(members, dims, threshold, stage), "id")
