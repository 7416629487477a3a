"""Line dedup: repeated line runs by a distributed suffix order over line ids, DataFrame operations only.

Texts are sequences of line ids. Prefix doubling orders their suffixes: a rank
of level k orders suffixes by their first 2**k lines, and the pair of ranks at
a line and 2**k lines further on gives level k + 1. A rank is the place of the
distinct pair in a range-partitioned sort, so no global counter or single task
is needed. All suffixes of one rank are one interval of the suffix array whose
longest common prefix is at least 2**k lines; intervals of one suffix can't
repeat and leave at once.

A run counts if it holds at least ``min_lines`` lines with a word, or at least
``min_words`` words; either may be None. Every such repeated run is the union of
the shortest windows of so many lines, or words, that start, or end, at each of
its lines. A window of m lines is named by the ranks
of the two 2**k-line windows, 2**k <= m < 2**(k+1), at its start and at its
end, which is its interval at depth m exactly. Of an interval's occurrences
the first in the order (doc_id, text hash, line) stays and the lines of all
later ones are deleted; together they are the maximal repeated runs. Doubling
need only reach the longest window.

``doc_id`` is an integer. Null texts are empty texts of one empty line. Rows that repeat ``doc_id`` and
text count as one document and get the same result; a null ``doc_id`` orders
first. Extra columns pass through untouched whatever their names. An empty
table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvida.llm.common import KeyFilter
from corvida.session import Stage

#: A run of either so many lines with a word, or so many words, is deleted where it repeats.
MIN_LINES, MIN_WORDS = 3, 50
_NONE = -(1 << 63)
_KEY = ["did", "tkey"]


def _text() -> Column:
    return F.coalesce(F.col("r.text").cast("string"), F.lit(""))


def _keyed(docs: DataFrame) -> DataFrame:
    """``r``, the whole row, and its key; nested, so that no name of the input can clash."""
    return docs.select(F.struct("*").alias("r")).select("r", F.coalesce(F.col("r.doc_id").cast("long"), F.lit(_NONE)).alias("did"), F.xxhash64(_text()).alias("tkey"))


def _named(pairs: DataFrame, by: list[str], stage: Stage) -> DataFrame:
    """Rows with ``rank``: it grows in the order of ``by`` over all partitions."""
    return stage.write(pairs.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()))


def _line_ids(docs: DataFrame) -> DataFrame:
    lines = _keyed(docs).select(*_KEY, F.posexplode(F.split(_text(), "\n")).alias("line", "s"))
    return lines.select(*_KEY, "line", F.xxhash64("s").alias("h1"), F.hash("s").alias("h2"), F.regexp_count("s", F.lit("[^ \\t\\n\\x0B\\f\\r]+")).alias("words"))


def _segments(lines: DataFrame, kinds: DataFrame, floors: dict[str, int]) -> DataFrame:
    """Lines in stretches of repeated lines that hold enough of one of ``floors``."""
    rows = lines.join(kinds, ["h1", "h2"]).select(*_KEY, "line", "words", F.least(F.col("words"), F.lit(1)).alias("lines"), "rank").repartition(*_KEY).dropDuplicates([*_KEY, "line"])
    rows = rows.withColumn("seg", F.col("line") - F.row_number().over(Window.partitionBy(*_KEY).orderBy("line")))
    part = Window.partitionBy(*_KEY, "seg")
    for c in floors:
        rows = rows.withColumn(f"{c}_total", F.sum(c).over(part))
    enough = reduce(lambda a, b: a | b, (F.col(f"{c}_total") >= n for c, n in floors.items()))
    return rows.where(enough)


def _windows(rows: DataFrame, what: str, least: int) -> DataFrame:
    """``start``, ``m``: the shortest windows with ``least`` of the column ``what`` that start or end at each line."""
    key = [*_KEY, "seg"]
    rows = rows.where(F.col(f"{what}_total") >= least).withColumn("total", F.col(f"{what}_total"))
    until = F.sum(what).over(Window.partitionBy(*key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("until", until)
    before = F.col("until") - F.col(what)
    # past lines of no weight at the end, the last line ends the stretch
    ends = rows.groupBy(*key).agg(F.first("total").alias("at"), (F.max("line") + 1).alias("data"))
    none = F.lit(None).cast("int")
    here = rows.select(*key, before.alias("at"), F.col("line").alias("data"), none.alias("ask"))
    stop = ends.select(*key, "at", "data", none.alias("ask"))

    ask = rows.select(*key, (before + least).alias("at"), none.alias("data"), F.col("line").alias("ask"))
    down = Window.partitionBy(*key).orderBy(F.desc("at"), F.col("data").desc_nulls_last())
    seen = F.last("data", ignorenulls=True)
    first = here.union(stop).union(ask).withColumn("edge", seen.over(down.rowsBetween(Window.unboundedPreceding, 0)))
    first = first.where("ask is not null and edge is not null").select(*_KEY, F.col("ask").alias("start"), (F.col("edge") - F.col("ask")).alias("m"))

    ask = rows.select(*key, (F.col("until") - least).alias("at"), none.alias("data"), (F.col("line") + 1).alias("ask"))
    up = Window.partitionBy(*key).orderBy(F.asc("at"), F.col("data").asc_nulls_last())
    last = here.union(ask).withColumn("edge", seen.over(up.rowsBetween(Window.unboundedPreceding, 0)))
    last = last.where("ask is not null and edge is not null").select(*_KEY, F.col("edge").alias("start"), (F.col("ask") - F.col("edge")).alias("m"))
    return first.union(last)


def _doubled(level: DataFrame, k: int, stage: Stage) -> DataFrame:
    """Ranks of level k + 1 of all suffixes whose first 2**(k+1) lines repeat."""
    ahead = Window.partitionBy(*_KEY).orderBy("line").rangeBetween(1 << k, 1 << k)
    pairs = level.withColumn("then", F.first("rank").over(ahead)).where("then is not null")
    kinds = _named(pairs.groupBy("rank", "then").count().where("count > 1").select(F.col("rank").alias("r1"), F.col("then").alias("r2")), ["r1", "r2"], stage)
    out = stage.write(pairs.select(*_KEY, "line", F.col("rank").alias("r1"), F.col("then").alias("r2")).join(kinds, ["r1", "r2"]).select(*_KEY, "line", "rank"))
    stage.drop(kinds)
    return out


def repeated_runs(docs: DataFrame, min_words: int | None = MIN_WORDS, min_lines: int | None = MIN_LINES) -> DataFrame:
    """``did``, ``tkey``, ``runs``: for each text the merged line intervals ``[s, e)`` that are later copies."""
    floors = {c: n for c, n in (("words", min_words), ("lines", min_lines)) if n is not None}
    if not floors or min(floors.values()) < 1:
        raise ValueError("give a least number of lines or words, 1 or more")
    stage = Stage(docs.sparkSession, "linededup")
    lines = stage.write(_line_ids(docs))
    kinds = _named(lines.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2"), ["h1", "h2"], stage)
    rows = stage.write(_segments(lines, kinds, floors))
    windows = stage.write(reduce(DataFrame.union, (_windows(rows, c, n) for c, n in floors.items())).distinct())
    stage.drop(lines, kinds)
    longest = windows.agg(F.max("m")).first()[0] or 0
    level, named, levels = rows.select(*_KEY, "line", "rank"), None, []
    for k in range(max(1, longest.bit_length())):
        of_level = windows.where((F.col("m") >= 1 << k) & (F.col("m") < 2 << k))
        head = level.select(*_KEY, F.col("line").alias("start"), F.col("rank").alias("ra"))
        tail = level.select(*_KEY, F.col("line").alias("last"), F.col("rank").alias("rb"))
        if k:
            ranked = of_level.withColumn("last", F.expr(f"start + m - {1 << k}")).join(head, [*_KEY, "start"]).join(tail, [*_KEY, "last"])
        else:
            ranked = of_level.join(head, [*_KEY, "start"]).withColumn("rb", F.col("ra"))
        ranked = ranked.select("m", "ra", "rb", *_KEY, "start")
        named = ranked if named is None else named.unionAll(ranked)
        if longest >> (k + 1):
            level = _doubled(level, k, stage)
            levels.append(level)
            if not level.take(1):
                break
    named = stage.write(named)
    stage.drop(*levels, rows, windows)
    place = F.struct(*_KEY, "start")
    # a table of its own, so that both sides of the join come straight from a shuffle and a common interval can be split
    intervals = stage.write(named.groupBy("m", "ra", "rb").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1"))
    later = named.join(intervals, ["m", "ra", "rb"]).where(place != F.col("first")).select(*_KEY, "start", (F.col("start") + F.col("m")).alias("stop"))
    by = Window.partitionBy(*_KEY).orderBy("start")
    reach = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    later = later.groupBy(*_KEY, "start").agg(F.max("stop").alias("stop")).withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    later = later.withColumn("island", F.sum("new").over(by)).groupBy(*_KEY, "island").agg(F.min("start").alias("s"), F.max("stop").alias("e"))
    return later.groupBy(*_KEY).agg(F.collect_list(F.struct("s", "e")).alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int | None = MIN_WORDS, min_lines: int | None = MIN_LINES) -> DataFrame:
    """``r``, the row as it came, ``kept_text``, ``n_lines`` and ``n_deleted``.

    Only texts that may lose lines are shuffled to meet their runs.
    """
    stage = Stage(docs.sparkSession, "lineruns")
    runs = stage.write(repeated_runs(docs, min_words, min_lines))
    rows = KeyFilter(runs, _KEY, stage).may_match(_keyed(docs), "maybe")
    whole, none = F.size(F.split(_text(), "\n")), F.lit(0)
    same = rows.where("not maybe").select("r", _text().alias("kept_text"), whole.alias("n_lines"), none.alias("n_deleted"))

    lines = F.split(_text(), "\n")
    gone = F.flatten(F.transform("runs", lambda x: F.sequence(x["s"], x["e"] - 1)))
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    text = F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n")
    lost = F.when(F.col("runs").isNull(), none).otherwise(F.aggregate("runs", F.lit(0), lambda n, x: n + x["e"] - x["s"]))
    joined = rows.where("maybe").join(runs.hint("shuffle_hash"), _KEY, "left")
    cut = joined.select("r", F.when(F.col("runs").isNull(), _text()).otherwise(text).alias("kept_text"), whole.alias("n_lines"), lost.alias("n_deleted"))
    return same.unionAll(cut)


def without_repeats(docs: DataFrame, min_words: int | None = MIN_WORDS, min_lines: int | None = MIN_LINES) -> DataFrame:
    """``docs`` with later copies of repeated runs cut from ``text`` (and ``n_chars`` to match).

    A document all of whose lines are later copies has nothing left and goes;
    one that lost no line stays as it is, an empty one too.
    """
    done = dedup_lines(docs, min_words, min_lines).where("n_deleted < n_lines")
    changed = F.col("n_deleted") > 0
    columns = []
    for f in docs.schema.fields:
        own = F.col("r").getField(f.name)
        if f.name == "text":
            own = F.when(changed, F.col("kept_text")).otherwise(own)
        elif f.name == "n_chars":
            own = F.when(changed, F.length("kept_text").cast(f.dataType)).otherwise(own)
        columns.append(own.alias(f.name))
    return done.select(*columns)
