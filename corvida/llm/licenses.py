"""License scans: an exact set-similarity join of text blocks with license templates, DataFrame operations only.

Blocks are the whole text, for short phrases that may run over a line's end;
its lines of up to twice a notice's words, for notices; and, as a notice is mostly
wrapped over lines or part of a longer one, windows of twice its words that start
at every multiple of their number, so that any stretch as long as the notice lies
within one. A block meets a template if it
holds at least ``threshold`` of the template's distinct words (all of them for a
phrase). Words no template has can't add to an overlap, so blocks are reduced
to template words first, whose number the templates fix. A text that as a whole
holds too few words of a notice has no window that meets it, and none is made.

Template words are ordered by the number of blocks of the whole table that hold
them and are long enough for some template, rarest first. With an overlap of ``need`` words asked for, a block
and a template that meet share a word within the first ``size - need + 1`` of
either (prefix filter); blocks of fewer than ``need`` words are out (length
filter); and the words from the shared one on must still suffice on both sides
(positional filter). What passes is verified by the full intersection. The
template side of the join has a fixed size and is broadcast: templates are the
built-in ones or a table's, ``MOST_TEMPLATES`` and ``MOST_WORDS`` at most.

For a phrase that meets a whole text an exact check of consecutive words
follows and gives its places. Null texts are empty: no words, no label, score
0. Rows that repeat ``doc_id`` and text get equal rows; a null ``doc_id`` is a
value like any other. Extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvida.llm.common import KeyFilter
from corvida.session import Stage

THRESHOLD = 0.8
#: Templates of a table, and their distinct words, at most.
MOST_TEMPLATES, MOST_WORDS = 2000, 5000

# Phrases with their labels, and the opening words of public license notices.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "licensed under the gnu general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: One character of a word, and one between words, of a text in any case.
WORD = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]"
GAP = "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    whole_text: bool
    threshold: float

    @property
    def window(self) -> int:
        """Words between the starts of its windows; 0 for a phrase."""
        return 0 if self.whole_text else len(self.words)

    @property
    def need(self) -> int:
        """Distinct words that a block must share."""
        return math.ceil(self.threshold * len(set(self.words)) - 1e-9)


def templates(threshold: float = THRESHOLD) -> list[Template]:
    return [Template(label, tuple(text.split()), True, 1.0) for label, text in PHRASES] + [Template(label, tuple(text.split()), False, threshold) for label, text in NOTICES]


def templates_of(table: DataFrame, threshold: float = THRESHOLD) -> list[Template]:
    """Templates from rows of ``label, text, whole_text``; texts without a word and null labels are refused, as is more than the bounds allow."""
    rows = table.select("label", "text", "whole_text").distinct().limit(MOST_TEMPLATES + 1).collect()
    made = [Template(label, tuple(re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").translate(_LOWER))), bool(whole), 1.0 if whole else threshold) for label, text, whole in rows]
    if any(t.label is None or not t.words for t in made):
        raise ValueError("templates need a label and words")
    if len(made) > MOST_TEMPLATES or len({w for t in made for w in t.words}) > MOST_WORDS:
        raise ValueError(f"more than {MOST_TEMPLATES} templates or {MOST_WORDS} words")
    return sorted(made, key=lambda t: (not t.whole_text, t.label, t.words))


_LOWER = {c: c + 32 for c in range(65, 91)}


def _trie(words: list[str]) -> str:
    """A pattern for any of ``words`` that branches letter by letter."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    branches = [head + _trie(tails) for head, tails in sorted(heads.items())]
    if not branches:
        return ""
    return "(?:" + "|".join(branches) + ")" + ("?" if "" in words else "")


#: Kinds of blocks beside windows, whose kind is the words between their starts.
WHOLE, LINE = -1, 0


def _token_sets(docs: DataFrame, wanted: list[Template]) -> DataFrame:
    """``doc_id, tkey, kind, tokens, n_words``: distinct template words of every block, and how many words a line has in all."""
    least = min((t.need for t in wanted if t.window), default=1)
    words_of = lambda ts: F.array(*(F.lit(w) for w in sorted({w for t in ts for w in t.words})))
    pattern = f"(?<!{WORD})(?i:{_trie(sorted({w for t in wanted for w in t.words}))})(?!{WORD})"
    lines = F.transform("raw", lambda line: F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), F.lower)))
    rows = docs.select("doc_id", "tkey", "text", F.split("text", "\n").alias("raw")).withColumn("lines", lines)
    rows = rows.withColumn("whole", F.array_distinct(F.flatten("lines")))
    # only of lines that may match a notice
    sizes = F.zip_with("raw", "lines", lambda line, x: F.when(F.size(x) >= least, F.regexp_count(line, F.lit(f"{WORD}+"))).otherwise(0))
    rows = rows.withColumn("sizes", sizes)
    classes: dict[int, list[Template]] = {}
    for t in wanted:
        if t.window:
            classes.setdefault(t.window, []).append(t)
    may = {n: reduce(lambda a, b: a | b, (F.size(F.array_intersect("whole", words_of([t]))) >= t.need for t in ts)) for n, ts in sorted(classes.items())}
    rows = rows.select("doc_id", "tkey", "text", "lines", "sizes", "whole", *(x.alias(f"may{n}") for n, x in may.items()))
    some = reduce(lambda a, b: a | b, (F.col(f"may{n}") for n in may), F.lit(False))
    all_words = F.when(some, F.transform(F.regexp_extract_all("text", F.lit(f"{WORD}+"), F.lit(0)), lambda w: F.translate(w, UPPER, UPPER.lower())))
    rows = rows.withColumn("words", all_words)

    block = lambda kind, x, size=None: F.struct(F.lit(kind).alias("kind"), x.alias("tokens"), (F.lit(0) if size is None else size).alias("n_words"))

    def windows(n: int) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / n).cast("int"))
        sets = F.transform(starts, lambda i: F.array_intersect(F.slice("words", i * n + 1, 2 * n), words_of(classes[n])))
        met = F.filter(sets, lambda x: F.size(x) >= min(t.need for t in classes[n]))
        return F.when(F.col(f"may{n}"), F.transform(met, lambda x: block(n, x))).otherwise(F.array())

    blocks = F.concat(F.array(block(WHOLE, F.col("whole"))), F.zip_with("lines", "sizes", lambda x, size: block(LINE, x, size)), *map(windows, classes))
    return rows.select("doc_id", "tkey", F.explode(blocks).alias("b")).select("doc_id", "tkey", "b.kind", "b.tokens", "b.n_words")


def matches(docs: DataFrame, wanted: list[Template], stage: Stage) -> DataFrame:
    """``doc_id, tkey, template, containment``: best block of each text for every template that it meets."""
    universe = sorted({w for t in wanted for w in t.words})
    least: dict[int, int] = {}
    for t in wanted:
        for kind in (WHOLE,) if t.whole_text else (LINE, t.window):
            least[kind] = min(t.need, least.get(kind, t.need))
    needed = F.element_at(F.create_map(*(F.lit(x) for pair in sorted(least.items()) for x in pair)), F.col("kind"))
    sets = stage.write(_token_sets(docs, wanted).where(F.size("tokens") >= needed))
    counted = {r[0]: r[1] for r in sets.select(F.explode("tokens").alias("t")).groupBy("t").count().collect()}  # a row per template word at most
    order = sorted(universe, key=lambda w: (counted.get(w, 0), w))
    rank = {w: i + 1 for i, w in enumerate(order)}
    ordered = F.array(*map(F.lit, order))
    ranks = F.array_sort(F.transform("tokens", lambda t: F.array_position(ordered, t).cast("int")))
    blocks = sets.select("doc_id", "tkey", "kind", "n_words", ranks.alias("ranks"))

    heads, sides = [], []
    for k, t in enumerate(wanted):
        own = sorted({rank[w] for w in t.words})
        sides.append((k, own))
        for kind in (WHOLE,) if t.whole_text else (LINE, t.window):
            # a longer line is what its windows are
            most = 2 * t.window if kind == LINE else 0
            heads += [(k, kind, token, j, len(own), t.need, most) for j, token in enumerate(own[: len(own) - t.need + 1])]
    spark = docs.sparkSession
    heads = spark.createDataFrame(heads, "template int, kind int, token int, j int, n int, need int, most int")
    sides = spark.createDataFrame(sides, "template int, own array<int>")
    size = F.size("ranks")
    probes = blocks.withColumn("needed", needed).select("doc_id", "tkey", "kind", "n_words", "ranks", F.posexplode(F.slice("ranks", F.lit(1), size - F.col("needed") + 1)).alias("i", "token"))
    fits = (F.col("n_words") <= F.col("most")) & (size >= F.col("need")) & (F.col("i") <= size - F.col("need")) & (F.least(size - F.col("i"), F.col("n") - F.col("j")) >= F.col("need"))
    found = probes.join(F.broadcast(heads), ["kind", "token"]).where(fits)
    found = found.join(F.broadcast(sides), "template").withColumn("shared", F.size(F.array_intersect("ranks", "own")))
    found = found.where("shared >= need").withColumn("containment", F.col("shared") / F.col("n"))
    return found.groupBy("doc_id", "tkey", "template").agg(F.max("containment").alias("containment"))


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def license_scan(docs: DataFrame, threshold: float = THRESHOLD, wanted: list[Template] | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    wanted, stage = wanted or templates(threshold), Stage(docs.sparkSession, "licenses")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).withColumn("tkey", F.xxhash64("text"))
    met = matches(keyed, wanted, stage)
    met = met.groupBy("doc_id", "tkey").agg(F.map_from_entries(F.collect_list(F.struct("template", "containment"))).alias("met"))
    met = stage.write(met)
    # only texts that may have met a template are shuffled
    rows = KeyFilter(met, ["doc_id", "tkey"], stage).may_match(keyed, "maybe")
    plain = rows.where("not maybe").select("doc_id", "text", F.lit(None).cast(met.schema["met"].dataType).alias("met"))
    met = met.select(F.col("doc_id").alias("id"), F.col("tkey").alias("key"), "met").hint("shuffle_hash")
    rows = rows.where("maybe")
    rows = rows.join(met, rows["doc_id"].eqNullSafe(F.col("id")) & (F.col("tkey") == F.col("key")), "left").select("doc_id", "text", "met")
    return _report(plain, wanted).unionAll(_report(rows, wanted))


def _report(rows: DataFrame, wanted: list[Template]) -> DataFrame:
    """The result's columns from a text and the templates that it met."""

    def place(t: Template) -> str:
        return f"(?<!{WORD})(?i:{(GAP + '+').join(t.words)})(?!{WORD})"

    phrases = [(k, t) for k, t in enumerate(wanted) if t.whole_text]
    candidate = F.coalesce(F.arrays_overlap(F.map_keys("met"), F.array(*(F.lit(k) for k, _ in phrases))), F.lit(False))
    any_place = "|".join(f"(?:{place(t)})" for _, t in phrases)
    # cut before every place; the words of the first and last part say where those places are
    parts = F.when(candidate, F.split("text", f"(?={any_place})"))
    words = lambda x: F.regexp_count(x, F.lit(f"{WORD}+")).cast("long")
    rows = rows.select("doc_id", "text", "met", words("text").alias("n_words"), parts.alias("parts"))
    starts = F.col("text").rlike(f"^(?:{any_place})")
    n_parts = F.coalesce(F.size("parts"), F.lit(0))
    # a place at the very start makes no empty first part
    at_start = F.when(F.col("parts").isNotNull(), starts).otherwise(False)
    n_base = F.when(F.col("parts").isNull(), 0).otherwise(n_parts - 1 + at_start.cast("int")).cast("long")
    base = F.array_compact(F.array(*(F.when(F.coalesce(F.map_contains_key("met", k), F.lit(False)) & F.col("text").rlike(place(t)), t.label) for k, t in phrases)))
    own = F.array_compact(F.array(*(F.when(F.coalesce(F.map_contains_key("met", F.lit(k)), F.lit(False)), t.label) for k, t in enumerate(wanted) if not t.whole_text)))
    rows = rows.withColumns({"n_base": n_base, "base": base, "own": own, "at_start": at_start})
    first = F.when(F.col("n_base") > 0, F.when(F.col("at_start"), F.lit(0).cast("long")).otherwise(words(F.get("parts", F.lit(0)))))
    last = F.when(F.col("n_base") > 0, F.col("n_words") - words(F.get("parts", n_parts - 1)))
    best = F.array_max(F.transform(F.map_entries(F.map_filter("met", lambda k, v: ~k.isin([k for k, _ in phrases]))), lambda e: e["value"]))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", first.alias("first_word"), last.alias("last_word"), _joined(F.col("base")).alias("base_labels"), _joined(F.concat("base", "own")).alias("labels"), score.alias("score"))
