"""Rules that tie runs, histories, cohorts and files to what they came from.

Each check returns ``rule`` and the key of what breaks it, so that a caller
sees every fault at once; ``contracts.require`` aborts on them. A rule that
can't be decided, as a value is null, counts as broken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvida.functions import known_label
from corvida.operators.contracts import require
from corvida.operators.ordered import running_sums
from corvida.session import ship_package

#: What a test report and the fit of its seed must agree on.
BOUND = ("model_sha256", "selection_sha256", "manifest_sha256", "threshold")
#: What an imported sample and its row of the split must agree on.
CARRIED = ("group", "label", "sha256", "size")


def broken(rows: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """``key, rule``: a row for each rule that a row of the table breaks."""
    names = F.array_compact(F.array(*(F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items())))
    return rows.select(*key, F.explode(names).alias("rule"))


def run_faults(reports: DataFrame, fits: DataFrame) -> DataFrame:
    """``seed, rule``: test reports that don't follow from their seed's fit.

    Both tables have ``seed`` and the columns of ``BOUND``; reports have also
    ``split`` and ``mode``, how their threshold was found. Seeds come once on
    each side and on both, all reports name one manifest, and two seeds are
    needed, or the rule ``runs`` is broken for the null seed.
    """
    left = reports.groupBy("seed").agg(F.count("*").alias("n_reports"), *(F.max(c).alias(c) for c in (*BOUND, "split", "mode")))
    right = fits.groupBy("seed").agg(F.count("*").alias("n_fits"), *(F.max(c).alias(f"fit_{c}") for c in BOUND))
    rules = {"one_report": F.col("n_reports") == 1, "one_fit": F.col("n_fits") == 1, "split": F.col("split") == "test", "mode": F.col("mode") == "validation_selection"}
    rules |= {c: F.col(c) == F.col(f"fit_{c}") for c in BOUND}
    rules["threshold_range"] = F.col("threshold").between(0.0, 1.0) & ~F.isnan("threshold")
    own = broken(left.join(right, "seed", "full_outer"), ["seed"], rules)
    whole = reports.agg(F.count_distinct("seed").alias("n"), F.count_distinct("manifest_sha256").alias("m"))
    return own.unionByName(broken(whole.withColumn("seed", F.lit(None).cast(reports.schema["seed"].dataType)), ["seed"], {"runs": F.col("n") >= 2, "one_manifest": F.col("m") == 1}))


def sample_faults(reported: DataFrame, manifest: DataFrame) -> DataFrame:
    """``seed, sample_id, rule``: reported samples that differ from the test part of a split.

    ``reported(seed, sample_id, content_hash, group, label, p)``. A seed that
    doesn't report each test sample once breaks ``coverage`` for the null sample.
    """
    want = manifest.where("split = 'test'").select("sample_id", *(F.col(c).alias(f"want_{c}") for c in ("content_hash", "group", "label")))
    met = reported.join(want.withColumn("known", F.lit(True)), "sample_id", "left")
    rules = {"known": F.col("known")} | {c: F.col(c) == F.col(f"want_{c}") for c in ("content_hash", "group", "label")}
    rules["p"] = F.col("p").between(0.0, 1.0) & ~F.isnan("p")
    n = want.count()
    seen = met.groupBy("seed").agg(F.count("*").alias("rows"), F.count_distinct(F.when(F.col("known"), F.col("sample_id"))).alias("ids"))
    short = seen.withColumn("sample_id", F.lit(None).cast(reported.schema["sample_id"].dataType))
    return broken(met, ["seed", "sample_id"], rules).unionByName(broken(short, ["seed", "sample_id"], {"coverage": (F.col("rows") == n) & (F.col("ids") == n)}))


def path_faults(rows: DataFrame, class_names: tuple[str, str]) -> DataFrame:
    """``path, rule``: rows of ``(path, label, split)`` whose path isn't plain and relative, below the folders of their split and class, and their own.

    A null path breaks all rules but the last.
    """
    part = lambda k: F.get(F.split("path", "/"), F.lit(k))
    plain = ~F.col("path").contains("\\") & ~F.arrays_overlap(F.split("path", "/"), F.array(F.lit(""), F.lit("."), F.lit("..")))
    rules = {"plain": plain, "split": part(0) == F.col("split"), "class": part(1) == F.get(F.array(*map(F.lit, class_names)), F.col("label").cast("int"))}
    again = rows.where("path IS NOT NULL").groupBy("path").agg(F.count("*").alias("n"))
    return broken(rows, ["path"], rules).unionByName(broken(again, ["path"], {"unique": F.col("n") == 1}))


def model_faults(models: DataFrame, class_names: tuple[str, str], manifest: str) -> DataFrame:
    """``model, rule``: models of ``(model, model_sha256, class_names, manifest)`` that can't be judged together.

    All have the same two classes in one order and the same split; no two are
    the same model under another name, and no name comes twice.
    """
    first = models.groupBy("model_sha256").agg(F.count_distinct("model").alias("names"))
    named = models.groupBy("model").agg(F.count("*").alias("n"))
    rules = {"classes": F.col("class_names") == F.array(*map(F.lit, class_names)), "manifest": F.col("manifest") == manifest, "digest": F.col("model_sha256").rlike("^[0-9a-f]{64}$"), "own_content": F.coalesce(F.col("names"), F.lit(1)) == 1}
    return broken(models.join(first, "model_sha256", "left"), ["model"], rules).unionByName(broken(named, ["model"], {"unique": F.col("n") == 1}))


def history_faults(history: DataFrame) -> DataFrame:
    """``run, rule``: runs of ``history(run, epoch, loss, val_loss)`` with values that aren't finite (``values``) or epochs that aren't 1, 2, … (``epochs``)."""
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))
    runs = history.groupBy("run").agg(
        F.count_if(finite("loss") & finite("val_loss")).alias("good"), F.count("*").alias("n"), F.count_distinct("epoch").alias("d"), F.min("epoch").alias("low"), F.max("epoch").alias("high")
    )
    return broken(runs, ["run"], {"values": F.col("good") == F.col("n"), "epochs": (F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("d") == F.col("n"))})


def cohort_faults(cohort: DataFrame, rows: DataFrame) -> DataFrame:
    """``path, rule``: where an imported cohort (``path, category`` and ``CARRIED``) and the rows of a split (``path`` and ``CARRIED``) differ.

    Every path is on each side once, carries the same values, and its label is
    the one that its category stands for.
    """
    left = cohort.groupBy("path").agg(F.count("*").alias("n_cohort"), *(F.max(c).alias(c) for c in (*CARRIED, "category")))
    right = rows.groupBy("path").agg(F.count("*").alias("n_rows"), *(F.max(c).alias(f"row_{c}") for c in CARRIED))
    rules = {"in_cohort": F.col("n_cohort") == 1, "in_split": F.col("n_rows") == 1, "category": known_label(F.col("category")) == F.col("label")}
    return broken(left.join(right, "path", "full_outer"), ["path"], rules | {c: F.col(c) == F.col(f"row_{c}") for c in CARRIED})


def file_faults(stated: DataFrame, found: DataFrame) -> DataFrame:
    """``folder, name, rule``: files of a folder that a record states and no one finds (``missing``), or the reverse (``extra``), whose digests differ (``changed``), or that one side names twice (``repeated``).

    A digest that is null on either side can't be compared, so the file counts as changed.
    """
    side = lambda rows, c: rows.groupBy("folder", "name").agg(F.max("sha256").alias(c), F.count("*").alias(f"n_{c}"))
    both = side(stated, "a").join(side(found, "b"), ["folder", "name"], "full_outer")
    rule = F.when(F.col("n_b").isNull(), "missing").when(F.col("n_a").isNull(), "extra").when((F.col("n_a") > 1) | (F.col("n_b") > 1), "repeated").when(~F.coalesce(F.col("a") == F.col("b"), F.lit(False)), "changed")
    return both.withColumn("rule", rule).where("rule IS NOT NULL").select("folder", "name", "rule")


def named_models(records: DataFrame, order: str = "ordinal") -> DataFrame:
    """``records`` with ``model``: ``model_1``, ``model_2``, … in the order in which they were given, however the ordinals are spaced."""
    placed = running_sums(records.withColumn("_one", F.lit(1).cast("long")), [], [order], {"_place": "_one"})
    return placed.withColumn("model", F.concat(F.lit("model_"), (F.col("_place") + 1).cast("long").cast("string"))).drop("_one", "_place")


def batches(rows: DataFrame, size: int, key: str, seed: int | None = None) -> DataFrame:
    """``rows`` with ``place`` and ``batch``, whole numbers from 0: batches of ``size`` rows, the last may be smaller.

    Rows come in the order of ``key``, or for a seed in that of a hash of seed
    and key, which is a shuffle over the whole table and not over a buffer.
    """
    if size < 1:
        raise ValueError("a batch has one row or more")
    order = [key] if seed is None else ["_h", key]
    hashed = rows.withColumns({"_one": F.lit(1).cast("long"), "_h": F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))})
    placed = running_sums(hashed, [], order, {"_place": "_one"}).withColumn("place", F.col("_place").cast("long"))
    return placed.withColumn("batch", F.expr(f"place div {int(size)}")).drop("_one", "_h", "_place")


def tensor_batches(rows: DataFrame, size: int, width: int, key: str, vector: str, label: str, seed: int, epoch: int = 1, shards: int = 16) -> DataFrame:
    """``shard, batch, n, ids, x, y``: an epoch's batches of ``size`` rows, each a flat tensor of ``n * width`` numbers and ``n`` labels.

    A row's shard comes from the md5 of its key, its place there from that of
    seed, epoch and key: every row comes once an epoch, epochs differ, and the
    same seed gives the same batches on any cluster. Shards are sorted by
    Spark, which spills; a task holds one batch. The last batch of a shard may
    be smaller. Rows with a null, a vector of another width or a null in it are refused.
    """
    if size < 1 or width < 1 or shards < 1:
        raise ValueError("size, width and shards must be positive")
    good = F.col(key).isNotNull() & F.col(label).isNotNull() & (F.size(vector) == width) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))
    require(rows.where(~F.coalesce(good, F.lit(False))).select(key), "rows that make no tensor")
    ship_package(rows.sparkSession)
    hashed = lambda *parts: F.md5(F.concat_ws(":", *parts, F.col(key).cast("string")).cast("binary"))
    shard = (F.conv(F.substring(hashed(), 1, 8), 16, 10).cast("long") % shards).cast("int")
    named = rows.select(shard.alias("shard"), hashed(F.lit(str(seed)), F.lit(str(epoch))).alias("h"), F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("x"), F.col(label).cast("float").alias("y"))
    dealt = named.repartition(shards, "shard").sortWithinPartitions("shard", "h", "id")
    kind = named.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, number = None, None, 0

        def made(part: pa.Table) -> pa.RecordBatch:
            part = part.combine_chunks()
            one = lambda values, t: pa.array([values.to_pylist()], pa.list_(t))
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([number], pa.int64()), pa.array([part.num_rows], pa.int32()), one(part["id"], part.schema.field("id").type), one(pa.chunked_array([part["x"].combine_chunks().flatten()]), pa.float32()), one(part["y"], pa.float32())], names=["shard", "batch", "n", "ids", "x", "y"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            shards_of = table["shard"].to_numpy()
            for first, last in zip(*_stretches(shards_of)):
                if shards_of[first] != at:
                    if held is not None and held.num_rows:
                        yield made(held)
                    held, at, number = None, int(shards_of[first]), 0
                part = table.slice(first, last - first)
                held = part if held is None else pa.concat_tables([held, part])
                while held.num_rows >= size:
                    yield made(held.slice(0, size))
                    held, number = held.slice(size), number + 1
        if held is not None and held.num_rows:
            yield made(held)

    return dealt.mapInArrow(run, f"shard int, batch long, n int, ids array<{kind.simpleString()}>, x array<float>, y array<float>")


def _stretches(values: np.ndarray) -> tuple[list[int], list[int]]:
    """First place and end of each stretch of equal values."""
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return (cuts[:-1], cuts[1:]) if len(values) else ([], [])
