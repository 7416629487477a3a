"""SimHash near-duplicates found through pivot distance tables.

Every text gets a 64-bit fingerprint. For every distinct fingerprint the
Hamming distances to fixed reference fingerprints (pivots) are computed once.
Two fingerprints within ``radius`` differ by at most ``radius`` in every such
coordinate, so a pair whose largest coordinate difference is above it is
discarded unseen; survivors are verified by a population count.

Full-width distances of unrelated fingerprints are all near 32, so they prune
but can't be an index: a scan of the whole table would compare all pairs.
Candidates come from a block index, which is the part of the method that this
module adds: equality on some blocks of bits (in the terms of the method,
*partial* pivot tables, the distances within a block to the references that have
one bit of it). Of ``radius + e`` blocks a pair of ``radius`` or fewer differing
bits leaves ``e`` untouched at least; ``e`` is 2 or more, chosen by the number of
fingerprints so that a bucket of unrelated ones stays small. A bucket of more
than ``bucket_limit`` fingerprints is never compared as a whole; its free bits are
cut into ``radius + 1`` blocks, of which one must again agree, and so on down to
``DEPTH``, where over 40 bits agree and near copies alone are left. The lowest
agreeing blocks claim a pair, so it appears once.

Nulls count as the empty text, whose fingerprint is zero and which links like
any other. Rows that repeat a ``doc_id`` each keep their row. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvida.llm.common import SALTS, KeyFilter, map_texts, salted_join
from corvida.operators.components import connected_components
from corvida.session import Stage

SEED, WORDS, RADIUS, BITS = 42, 4, 4, 64
PIVOTS = 8
BUCKET_LIMIT = 64
DEPTH = 3
_CHUNK = 1 << 15


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Signed 64-bit fingerprint of a whole text."""
    w = text.lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else list(map(b" ".join, zip(*(w[i:] for i in range(words)))))
    votes = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(shingles), _CHUNK):
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles[i : i + _CHUNK]], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(shingles), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id``, ``tkey``, the text's hash, and ``fp`` for every row."""
    rows = docs.select(F.struct("doc_id", _text_key().alias("tkey")).alias("key"), "text")
    made = map_texts(rows, lambda texts: {"fp": pa.array([fingerprint(t, words) for t in texts], pa.int64())}, "fp long", key="key")
    return made.select("key.doc_id", "key.tkey", "fp")


def _text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def references(n: int = PIVOTS) -> list[int]:
    """Pivot fingerprints by the SplitMix64 rule, from zero on."""
    out, state, all_bits = [], 0, (1 << 64) - 1
    for _ in range(n):
        state = (state + 0x9E3779B97F4A7C15) & all_bits
        z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & all_bits
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & all_bits
        out.append(_signed(z ^ (z >> 31)))
    return out


def _cut(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` blocks of nearly equal size."""
    return [sum(1 << b for b in block.tolist()) for block in np.array_split(np.array(bits, dtype=int), parts) if len(block)]


class _Keys:
    """Masks of one level: what each fixes, and blocks that must differ for it to be a pair's first."""

    def __init__(self, masks: list[int], differ: list[list[int]]):
        self.masks, self.differ = masks, differ

    @classmethod
    def first(cls, radius: int, agree: int = 2) -> _Keys:
        blocks = _cut(list(range(BITS)), radius + agree)
        chosen = list(combinations(range(len(blocks)), agree))
        return cls([sum(blocks[i] for i in c) for c in chosen], [[blocks[x] for x in range(c[-1]) if x not in c] for c in chosen])

    def below(self, radius: int) -> tuple[_Keys, list[list[int]]]:
        """The next level and, for each mask here, the places of its children there."""
        masks, differ, children = [], [], []
        for mask, must in zip(self.masks, self.differ):
            blocks = _cut([b for b in range(BITS) if not mask >> b & 1], radius + 1)
            children.append(list(range(len(masks), len(masks) + len(blocks))))
            masks += [mask | b for b in blocks]
            differ += [must + blocks[:i] for i in range(len(blocks))]
        return _Keys(masks, differ), children


def blocks_that_agree(count: int, radius: int = RADIUS, bucket: int = BUCKET_LIMIT // 4) -> int:
    """The fewest of the blocks whose bits tell ``count`` unrelated fingerprints apart, ``bucket`` or fewer to a key."""
    return next(e for e in range(2, BITS) if BITS * e // (radius + e) >= np.log2(max(1, count) / bucket) or e == 6)


def _longs(values: list[int]) -> str:
    """An array of whole numbers in SQL: deep levels have thousands of masks, and a call of the JVM for each takes longer than the job."""
    return f"array({', '.join(f'{_signed(v)}L' for v in values)})" if values else "cast(array() AS array<bigint>)"


def similar_pairs(fps: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT, stage: Stage | None = None) -> DataFrame:
    """``a < b``: every pair of distinct fingerprints of column ``fp`` with at most ``radius`` differing bits."""
    stage = stage or Stage(fps.sparkSession, "simhash")
    refs = references()
    packed = None
    for i, ref in enumerate(refs):
        coordinate = F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(ref))).cast("long"), 8 * i)
        packed = coordinate if packed is None else packed.bitwiseOR(coordinate)
    keys, found = _Keys.first(radius, blocks_that_agree(fps.count(), radius)), None
    rows = fps.select("fp", F.posexplode(F.expr(_longs(keys.masks))).alias("k", "mask"))
    for depth in range(DEPTH + 1):
        rows = rows.select("k", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        # counted in shares, so that a common key's rows are in no task together
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
        shares = rows.groupBy("k", "key", "salt").agg(F.count("*").alias("n"))
        sizes = stage.write(shares.drop("n").join(shares.groupBy("k", "key").agg(F.sum("n").alias("n")).where("n > 1"), ["k", "key"]))
        # the pivot table, of all that shares a bucket with another
        rows = stage.write(rows.join(sizes, ["k", "key", "salt"]).drop("salt").withColumn("pivots", packed))
        stage.drop(sizes)
        cold = rows.where(F.col("n") <= bucket_limit) if depth < DEPTH else rows
        a, b = cold.alias("a"), cold.alias("b")
        differing = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
        close = (F.col("a.k") == F.col("b.k")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
        for i in range(len(refs)):
            at = [F.shiftright(F.col(f"{side}.pivots"), 8 * i).bitwiseAND(F.lit(255)) for side in "ab"]
            close = close & (F.abs(at[0] - at[1]) <= radius)
        close = close & (F.bit_count(differing) <= radius)
        earlier = F.expr(f"array({', '.join(_longs(x) for x in keys.differ)})")
        close = close & F.forall(F.get(earlier, F.col("a.k")), lambda m: differing.bitwiseAND(m) != 0)
        pairs = a.join(b, close).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
        found = pairs if found is None else found.unionAll(pairs)
        if depth == DEPTH:
            break
        hot = rows.where(F.col("n") > bucket_limit)
        if not hot.take(1):
            break
        keys, children = keys.below(radius)
        masks = [[f"named_struct('k', {i}, 'mask', {_signed(keys.masks[i])}L)" for i in c] for c in children]
        to = F.expr(f"array({', '.join(f'array({", ".join(c)})' for c in masks)})")
        rows = hot.select("fp", F.explode(F.get(to, F.col("k"))).alias("x")).select("fp", "x.k", "x.mask")
    return found


def simhash_groups(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per document: ``doc_id``, ``tkey``, ``fp``, ``component_id``, the smallest ``doc_id`` reachable by links."""
    stage = Stage(docs.sparkSession, "simhash")
    held = stage.write(fingerprints(docs, words))
    classes = stage.write(held.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    pairs = similar_pairs(classes.select("fp"), radius, stage=stage)
    # fingerprints are the nodes, as an id may have several
    linked = connected_components(pairs, "a", "b")
    # every row of the components table holds a different node, and of classes a different fingerprint
    met = stage.write(classes.join(linked, classes["fp"] == linked["node"], "left").select("fp", "first_id", "component"))
    least = met.where("component is not null").groupBy("component").agg(F.min("first_id").alias("least"))
    top = salted_join(met, least, "component", "fp").select("fp", F.coalesce("least", "first_id").alias("component_id"))
    return held.join(top, "fp").select("doc_id", "tkey", "fp", "component_id")


def one_per_group(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group: of the rows with its smallest ``doc_id`` the one with the smallest hash of its text.

    Rows are judged by their own texts, so rows that share nothing but a
    ``doc_id`` each stand for their own group; of rows that repeat id and text
    one stays. Rows without a ``doc_id`` stay, as nothing can name their group.
    Only rows that a bitmap of those that go lets through are shuffled.
    """
    stage, key = Stage(docs.sparkSession, "simhashkeep"), ["doc_id", "tkey"]
    groups = stage.write(simhash_groups(docs).where("doc_id is not null"))
    first = groups.where("doc_id = component_id").groupBy(*key).agg(F.count("*").alias("n"))
    best = first.groupBy("doc_id").agg(F.min("tkey").alias("best"))
    first = stage.write(first.join(best, "doc_id"))
    gone = stage.write(groups.where("doc_id != component_id").select(*key).unionAll(first.where("tkey != best").select(*key)).distinct())
    again = stage.write(first.where("tkey = best AND n > 1").select(*key))
    # nested, so that no name of the input can clash
    rows = docs.select(F.struct("*").alias("r"), "doc_id", _text_key().alias("tkey"))
    rows = KeyFilter(gone.unionAll(again), key, stage).may_match(rows, "maybe")
    mine = rows.where("maybe").join(gone, key, "left_anti")
    single = mine.join(again, key, "left_anti").select("r.*")
    one = mine.join(again, key, "left_semi").groupBy(*key).agg(F.first("r").alias("r"))
    return rows.where("not maybe").select("r.*").unionAll(single).unionAll(one.select("r.*"))
