"""Contract checks. Each returns the rows that break a rule; ``require`` aborts on the first of them."""

from __future__ import annotations

import math
import os
import posixpath
import re
from numbers import Real

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvida.operators.split import SPLITS


def require(violations: DataFrame, what: str) -> None:
    """Raise ValueError with a few examples if there are violations."""
    if rows := violations.take(3):
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")


def check_relative_path(path: str) -> str:
    """A relative path without empty, ``.`` or ``..`` parts and without backslashes."""
    if not path or path.startswith("/") or "\\" in path or any(x in ("", ".", "..") for x in path.split("/")):
        raise ValueError(f"unsafe path {path!r}")
    return path


def check_apart(source: str, target: str) -> None:
    """Two folders of which neither holds the other, whatever links and dots their paths have."""
    a, b = (re.sub("^file:/+", "/", x) for x in (source, target))
    a, b = (posixpath.normpath(x) if ":/" in x else os.path.realpath(x) for x in (a, b))
    if f"{a}/".startswith(f"{b}/") or f"{b}/".startswith(f"{a}/"):
        raise ValueError(f"{source} and {target} hold each other")


def check_threshold(value) -> float:
    """A real number from 0 to 1, no bool."""
    if isinstance(value, bool) or not isinstance(value, Real) or not math.isfinite(value) or not 0 <= value <= 1:
        raise ValueError(f"not a threshold: {value!r}")
    return float(value)


def check_digest(value) -> str:
    """64 lower-case hexadecimal digits."""
    if not isinstance(value, str) or not re.fullmatch("[0-9a-f]{64}", value):
        raise ValueError(f"not a SHA-256 digest: {value!r}")
    return value


def bad_scores(scores: DataFrame) -> DataFrame:
    """Scores that are null, not a number or outside 0 to 1. NaN is in no range, so one test covers it."""
    return scores.where(~F.coalesce(F.col("p").between(0.0, 1.0) & ~F.isnan("p"), F.lit(False)))


def bad_samples(rows: DataFrame) -> DataFrame:
    """Rows whose label is not 0 or 1, whose split is unknown or whose group is blank."""
    good = F.col("label").isin(0, 1) & F.col("split").isin(*SPLITS) & (F.trim(F.col("group").cast("string")) != "")
    return rows.where(~F.coalesce(good, F.lit(False)))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Values of a key that should be unique."""
    return rows.groupBy(key).count().where("count > 1")


def crossing(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Groups or digests found in more than one split."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def leaked(trained: DataFrame, tested: DataFrame, key: str) -> DataFrame:
    """Digests of the tested rows that a model was trained on."""
    return tested.select(key).join(trained.select(key), key, "left_semi").distinct()


def history_leaks(history: DataFrame, manifest: DataFrame, key: str = "content_hash") -> DataFrame:
    """``model, n_leaked``: models whose history (``model`` and the digests it was fitted or chosen on, a row for each) holds test digests.

    Test digests are made distinct before they meet the history, so a digest that
    many models saw is one row on that side.
    """
    tested = manifest.where("split = 'test'").select(key).distinct()
    met = history.select("model", key).join(tested, key, "left_semi")
    return met.groupBy("model").agg(F.count_distinct(key).alias("n_leaked"))


def in_several_groups(manifest: DataFrame, key: str = "content_hash") -> DataFrame:
    """Test digests of more than one group, which a group bootstrap would draw apart."""
    return manifest.where("split = 'test'").groupBy(key).agg(F.count_distinct("group").alias("n_groups")).where("n_groups > 1")


def unsafe_paths(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose path is no relative one with plain parts, by the rule of ``check_relative_path``."""
    path = F.col(column)
    return rows.where(F.coalesce((path == "") | path.startswith("/") | path.contains("\\") | F.arrays_overlap(F.split(path, "/"), F.array(F.lit(""), F.lit("."), F.lit(".."))), F.lit(True)))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with ``side``; multiplicities count."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def unmatched(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, from one full outer join."""
    x = a.select(F.col(key).alias("k")).distinct().withColumn("in_a", F.lit(True))
    y = b.select(F.col(key).alias("k")).distinct().withColumn("in_b", F.lit(True))
    return x.join(y, "k", "full_outer").where("in_a IS NULL OR in_b IS NULL").select(F.col("k").alias(key), F.col("in_a").isNotNull().alias("left_only"))


def check_manifest(rows: DataFrame) -> None:
    """All rules of a split table ``sample_id, group, content_hash, label, split``."""
    require(bad_samples(rows), "invalid label, split or group")
    require(repeated(rows, "sample_id"), "repeated sample_id")
    for key in ("group", "content_hash"):
        require(crossing(rows, key), f"{key} in several splits")
    require(rows.groupBy("content_hash").agg(F.count_distinct("label").alias("n")).where("n > 1"), "content with conflicting labels")
    require(rows.agg(F.count_distinct("split", "label").alias("pairs")).where("pairs < 6"), "a split lacks a class")
