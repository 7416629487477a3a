"""Connected components of an undirected graph given as an edge table.

Alternating star contraction: the large-star step hangs every larger neighbour
of a node on the smallest member of its neighbourhood, the small-star step does
so for the smaller ones. Both are a map-side-combined ``min`` and one equi join.
Nodes with more than ``HUB`` edges, or more than the ``1 / MOST_HUBS`` part of
all of them, are hubs: there are at most ``2 * MOST_HUBS`` of those, so their
minima are broadcast and their edges stay where they are, and no node brings
more than a fixed share of the edges to one task. The other joins are told to
merge, as both sides grow with the edges and many rounds that each broadcast
what is just small enough add up in the driver. Every round is written to the
shared folder; the loop ends when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvida.session import Stage


HUB, MOST_HUBS = 256, 50_000
#: Edges for each file of a round at least, so that a small graph isn't written in hundreds of files.
FILE_EDGES = 1 << 15


def _state(edges: DataFrame) -> tuple[int, int, int]:
    """Number of edges, a sum of their hashes, and the largest degree, in one job."""
    # the sum of 31-bit hashes can't overflow a long
    marked = edges.select("u", "v", F.shiftrightunsigned(F.xxhash64("u", "v"), 33).alias("h"), F.lit(1).alias("one"))
    none = F.lit(0)
    ends = marked.union(marked.select("v", "u", none.cast("long"), none))
    row = ends.groupBy("u").agg(F.count("*").alias("n"), F.sum("h").alias("h"), F.sum("one").alias("one")).agg(F.sum("one"), F.sum("h"), F.max("n")).first()
    return row[0] or 0, row[1] or 0, row[2] or 0


def _hub(count: int) -> int:
    return max(HUB, count // MOST_HUBS)


def _files(count: int) -> int:
    return max(1, -(-count // FILE_EDGES))


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _with_low(edges: DataFrame, wanted: str, hub: int | None, stage: Stage, files: int) -> DataFrame:
    """The edges that fulfil ``wanted``, with ``m``, the smallest of ``u`` and its neighbours; ``hub`` is None if no node is one."""
    low = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
    edges = edges.where(wanted)
    if hub is None:
        return edges.join(low.select("u", "m").hint("merge"), "u")
    low = stage.write(low.coalesce(files))
    hubs = F.broadcast(low.where(F.col("n") > hub).select("u", F.col("m").alias("hub_m")))  # 2 * MOST_HUBS rows at most
    met = edges.join(hubs, "u", "left")
    cold = met.where("hub_m is null").select("u", "v").join(low.where(F.col("n") <= hub).select("u", "m").hint("merge"), "u")
    return met.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m")).unionAll(cold.select("u", "v", "m"))


def _large_star(edges: DataFrame, hub: int | None, stage: Stage, files: int) -> DataFrame:
    return _with_low(_both(edges), "v > u", hub, stage, files).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, hub: int | None, stage: Stage, files: int) -> DataFrame:
    # u is larger than all its neighbours here, which are no more than before the large star
    rows = _with_low(edges, "v < u", hub, stage, files)
    moved = rows.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(rows.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that has an edge; component is the smallest node reachable.

    Self loops, repeated and null edges are ignored; an edgeless table gives an
    empty result. Nodes may be of any ordered type.
    """
    stage = Stage(edges.sparkSession, "components")
    s, d = F.col(src), F.col(dst)
    current = stage.write(edges.where(s.isNotNull() & d.isNotNull() & (s != d)).select(F.greatest(s, d).alias("u"), F.least(s, d).alias("v")).distinct())
    seen = _state(current)
    if seen[0]:
        for _ in range(max_rounds):
            hub = _hub(seen[0]) if seen[2] > _hub(seen[0]) else None
            files = _files(seen[0])
            wide = _large_star(current, hub, stage, files)
            step = stage.write(_small_star(stage.write(wide.coalesce(files)) if hub else wide, hub, stage, files).coalesce(files))
            stage.drop(current)
            current, now = step, _state(step)
            if now == seen:
                break
            seen = now
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
