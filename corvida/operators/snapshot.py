"""Snapshots of file inventories as a tree of digests, compared from the top so that equal branches aren't read.

A file's place in the tree is the MD5 of its folder and name in hexadecimal: a
leaf holds the files of one prefix, a branch the digests of its sixteen
children. Rows and digests are stored sorted by prefix, so a reader that asks
for a few prefixes skips the rest of the table by its statistics.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvida.operators.contracts import require
from corvida.session import Stage
from corvida.sources.sinks import publish_all

#: Files of a leaf, by intent. Prefixes that a level's filter names; more are joined.
LEAF, NAMED = 256, 1000
_FILE = ["folder", "name", "sha256", "size"]


def _key() -> Column:
    return F.md5(F.to_json(F.struct(F.col("folder").cast("string").alias("folder"), "name")).cast("binary"))


def _digest(rows: DataFrame, by: str, key: str, value: Column) -> DataFrame:
    """``prefix, digest, n`` of each prefix: the digest of its members' in the order of their keys."""
    held = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("d"))))
    return rows.groupBy(F.col(by).alias("prefix")).agg(F.sha2(F.array_join(F.transform(held, lambda x: x["d"]), ","), 256).alias("digest"), F.sum("n").alias("n"))


def write_snapshot(files: DataFrame, path: str, depth: int | None = None) -> int:
    """Store ``files(folder, name, sha256, size)`` and the tree over them in a new folder; the tree's depth.

    Files come once; a null digest or size is a value of its own. The depth is
    chosen by their number, or given so that two trees can be compared.
    """
    rows = files.select("folder", "name", "sha256", F.col("size").cast("long").alias("size"))
    require(rows.groupBy("folder", "name").count().where("count > 1"), "repeated files")
    if depth is None:
        depth = max(1, math.ceil(math.log(max(1, rows.count() / LEAF), 16)))
    rows = rows.withColumn("key", _key()).withColumn("prefix", F.substring("key", 1, depth))
    leaf = _digest(rows.withColumn("n", F.lit(1).cast("long")), "prefix", "key", F.sha2(F.to_json(F.struct(*_FILE), {"ignoreNullFields": "false"}), 256))
    # levels hang on one another, so each is a table of sixteen times fewer rows than the one below
    levels = {depth: leaf}
    for k in range(depth - 1, -1, -1):
        levels[k] = _digest(levels[k + 1].withColumn("up", F.substring("prefix", 1, k)), "up", "prefix", F.col("digest"))
    stored = {f"level_{k}": x.repartitionByRange("prefix").sortWithinPartitions("prefix") for k, x in levels.items()}
    publish_all(stored | {"files": rows.repartitionByRange("prefix").sortWithinPartitions("prefix", "key")}, path)
    return depth


def _among(rows: DataFrame, prefixes: DataFrame, width: int) -> DataFrame:
    """Rows below some prefixes: by a filter that reaches the scan while these are few, else by a join."""
    few = [r[0] for r in prefixes.select("prefix").limit(NAMED + 1).collect()]
    if width == 0:
        return rows
    if len(few) <= NAMED:
        # ranges of the sorted column, which its statistics can rule out
        below = F.lit(False)
        for p in few if len(few) <= 32 else []:
            below = below | ((F.col("prefix") >= p) & (F.col("prefix") < p + "g"))
        return rows.where(below if len(few) <= 32 else F.substring("prefix", 1, width).isin(few))
    return rows.withColumn("_up", F.substring("prefix", 1, width)).join(prefixes.select(F.col("prefix").alias("_up")), "_up", "left_semi").drop("_up")


def snapshot_changes(spark: SparkSession, before: str, after: str, depth: int) -> tuple[DataFrame, int]:
    """``folder, name, rule`` (``missing``, ``extra`` or ``changed``) between two snapshots of one depth, and how many files of the first had to be read.

    Levels are compared from the top; below a prefix with equal digests nothing
    is read. A file whose digest or size is null on one side alone is changed,
    as every other that isn't equal.
    """
    stage, differ = Stage(spark, "snapshot"), None
    for k in range(depth + 1):
        a, b = (spark.read.parquet(f"{p.rstrip('/')}/level_{k}") for p in (before, after))
        if differ is not None:
            a, b = _among(a, differ, k - 1), _among(b, differ, k - 1)
        both = a.select("prefix", F.col("digest").alias("a"), "n").join(b.select("prefix", F.col("digest").alias("b")), "prefix", "full_outer")
        differ = both.where("a IS NULL OR b IS NULL OR a <> b").select("prefix", F.coalesce("n", F.lit(0)).alias("n"))
        differ = stage.write(differ)
    read = differ.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    a, b = (_among(spark.read.parquet(f"{p.rstrip('/')}/files"), differ, depth) for p in (before, after))
    flags = lambda rows, side: rows.select("folder", "name", F.struct("sha256", "size").alias(side), F.lit(True).alias(f"in_{side}"))
    both = flags(a, "a").join(flags(b, "b"), ["folder", "name"], "full_outer")
    rule = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.withColumn("rule", rule).where("rule IS NOT NULL").select("folder", "name", "rule"), read
