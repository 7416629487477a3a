"""Repeated-seed statistics and the paired group bootstrap."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvida.operators.ordered import running_sums
from corvida.operators.splitting import split_draw_sums
from corvida.session import Stage

#: Attempts for each wanted draw at most.
ATTEMPTS_PER_DRAW = 20
#: Attempts made at once at least.
LEAST_BATCH = 200
#: What a paired bootstrap has intervals of.
SERIES = ("selected", "fixed", "delta", "over_baseline")


def across_seeds(values: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """``metric, n, mean, sd, variance, low, high`` with the sample variance."""
    v = F.col(value)
    return values.groupBy(metric).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.var_samp(v).alias("variance"), F.min(v).alias("low"), F.max(v).alias("high"))


def group_sums(rows: DataFrame, group: str = "group") -> DataFrame:
    """``group, seed, comparator, P, N, tp, tn`` of ``rows(group, seed, comparator, y, said)``: all that a draw needs."""
    y, said = F.col("y"), F.col("said")
    return rows.groupBy(F.col(group).alias("group"), "seed", "comparator").agg(F.sum(y).alias("P"), F.sum(1 - y).alias("N"), F.sum(y * said).alias("tp"), F.sum((1 - y) * (1 - said)).alias("tn"))


def numbered_groups(sums: DataFrame) -> DataFrame:
    """``group, place``: places from 0 in the order of the groups."""
    groups = sums.select("group").distinct().withColumn("one", F.lit(1).cast("long"))
    return running_sums(groups, [], ["group"], {"place": "one"}).select("group", F.col("place").cast("long").alias("place"))


def hashed_draws(spark, seed: int, first: int, last: int, groups: int) -> DataFrame:
    """``attempt, place, times``: groups drawn with replacement, by a hash of seed, attempt and slot; a row for each slot.

    Repeats aren't counted here: that would shuffle attempts times groups, while
    sums after the join are combined before their shuffle.
    """
    slots = spark.range(first * groups, last * groups).select(F.expr(f"id div {groups}").alias("attempt"), (F.col("id") % groups).alias("slot"))
    text = F.concat_ws(":", F.lit(str(seed)), F.col("attempt").cast("string"), F.col("slot").cast("string"))
    number = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    return slots.select("attempt", (number % groups).alias("place"), F.lit(1).cast("long").alias("times"))


def twister_draws(spark, generator: random.Random, first: int, last: int, groups: int) -> DataFrame:
    """The same from Python's generator, which draws one after another on the driver."""
    attempts, places, times = [], [], []
    for attempt in range(first, last):
        place, n = np.unique(np.array([generator.randrange(groups) for _ in range(groups)]), return_counts=True)
        attempts.append(np.full(len(place), attempt))
        places.append(place)
        times.append(n)
    columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in (attempts, places, times)]
    return spark.createDataFrame(pa.table(columns, names=["attempt", "place", "times"]))


def slot_sums(sized: DataFrame, draws: DataFrame) -> DataFrame:
    """``attempt, seed, comparator, P, N, tp, tn`` of drawn slots; ``sized`` has the groups' places."""
    # one row for each place, so that drawn slots aren't multiplied before they meet it
    packed = sized.groupBy("place").agg(F.collect_list(F.struct("seed", "comparator", "P", "N", "tp", "tn")).alias("s"))
    return draws.join(packed, "place").select("attempt", "times", F.inline("s")).groupBy("attempt", "seed", "comparator").agg(*(F.sum(F.col("times") * F.col(c)).alias(c) for c in ("P", "N", "tp", "tn")))


def draw_values(drawn: DataFrame, paired: bool = False) -> DataFrame:
    """``attempt, comparator, value`` of each attempt that drew both classes: balanced accuracy, averaged over seeds.

    ``paired`` adds what ``selected`` gains over ``fixed`` and over a constant
    class, seed by seed in the same draw.
    """
    balanced = (F.col("tp") / F.col("P") + F.col("tn") / F.col("N")) / 2
    rows = drawn.where("P > 0 AND N > 0").select("attempt", "seed", "comparator", balanced.alias("value"))
    if paired:
        wide = rows.groupBy("attempt", "seed").pivot("comparator", ["selected", "fixed"]).agg(F.first("value"))
        # a constant class has all of one class right and none of the other
        wide = wide.withColumns({"delta": F.col("selected") - F.col("fixed"), "over_baseline": F.col("selected") - 0.5})
        rows = wide.unpivot(["attempt", "seed"], list(SERIES), "comparator", "value").where("value IS NOT NULL")
    return rows.groupBy("attempt", "comparator").agg(F.avg("value").alias("value"))


def percentile_interval(values: Column, low: float = 0.025, high: float = 0.975) -> Column:
    """Exact percentiles with linear interpolation."""
    return F.percentile(values, F.array(F.lit(low), F.lit(high)))


def bootstrap(sums: DataFrame, repetitions: int, seed: int, kind: str = "md5", paired: bool = False, least: int = 2) -> DataFrame:
    """``comparator, valid, attempted, rejected, low, high``: intervals over the first ``repetitions`` valid attempts.

    Draws of one class are rejected; attempts come in batches until enough are
    valid or ``ATTEMPTS_PER_DRAW`` times as many were made. Then the intervals
    are null, and every comparator still has its record. Where the groups lack a
    class all attempts are rejected without being drawn. All seeds and
    comparators share the draws, so differences are paired; ``paired`` adds
    intervals of them (``SERIES``), from ``sums`` with the comparators
    ``selected`` and ``fixed``. ``splitting`` draws are multinomial counts made
    where the groups are (``operators/splitting.py``), ``md5`` ones have a row
    for each slot, ``twister`` ones are made on the driver, for equal draws
    with Python's generator. Fewer than ``least`` groups are refused.
    """
    if repetitions < 2:
        raise ValueError("repetitions must be 2 or more")
    if kind not in ("splitting", "md5", "twister"):
        raise ValueError(f"unknown draws {kind}")
    spark, stage = sums.sparkSession, Stage(sums.sparkSession, "bootstrap")
    sized = stage.write(sums.join(numbered_groups(sums), "group"))
    groups = sized.select("group").distinct().count()
    if groups < least:
        raise ValueError("two groups or more are needed")
    generator, done, valid, values, most = random.Random(seed), 0, 0, None, ATTEMPTS_PER_DRAW * repetitions
    if not sized.groupBy("seed", "comparator").agg(F.sum("P").alias("P"), F.sum("N").alias("N")).where("P > 0 AND N > 0").take(1):
        done = most
    while done < most and valid < repetitions:
        upto = min(most, done + max(repetitions, LEAST_BATCH))
        if kind == "splitting":
            drawn = split_draw_sums(sized, seed, done, upto, groups)
        else:
            drawn = slot_sums(sized, hashed_draws(spark, seed, done, upto, groups) if kind == "md5" else twister_draws(spark, generator, done, upto, groups))
        part = stage.write(draw_values(drawn, paired))
        values = part if values is None else values.unionAll(part)
        valid += part.select("attempt").distinct().count()
        done = upto
    enough = valid >= repetitions
    if enough:
        last = values.select("attempt").distinct().orderBy("attempt").limit(repetitions).agg(F.max("attempt")).first()[0]
        values, valid, done = values.where(F.col("attempt") <= last), repetitions, last + 1
    number = lambda n, name: F.lit(n).cast("long").alias(name)
    null = F.lit(None).cast("double")
    counts = [number(valid, "valid"), number(done, "attempted"), number(done - valid, "rejected")]
    names = spark.createDataFrame([(n,) for n in SERIES], "comparator string") if paired else sized.select("comparator").distinct()
    out = names.join(values.groupBy("comparator").agg(percentile_interval(F.col("value")).alias("i")), "comparator", "left") if enough else names
    return out.select("comparator", *counts, *((F.get("i", F.lit(k)) if enough else null).alias(n) for k, n in enumerate(("low", "high"))))
