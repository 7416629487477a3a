"""Benchmark decontamination by spaced seeds.

A seed mask fixes five of six or seven neighbouring word positions and ignores
the others, so a substituted word under an ignored position leaves the hash
alone. Hashes of all test items under all masks are joined with those of every
training text; each hit names a diagonal (text position minus item position).
Around the diagonals of the hits the item is laid over the text word by word,
and the longest stretch of which at least ``similarity`` of the words agree,
bounded by agreeing words, is a verified overlap; so are those before and after
it on the diagonal. Where no stretch is long enough, a whole item of which so
many words agree is one too, whatever its first and last words. Of overlaps with one item that share words of the text the
longest is reported, so every passage of the text appears once for each item.

An overlap of at least ``min_words`` words, or of the whole item if it is
shorter, marks the text. Items of five to ``LEFT_OUT`` words are found by
whole-item hashes that leave out one word each, as no seed need fit into what
is left of them. A shorter item tolerates no substitution and says little:
it marks a text that consists of it and nothing else. An item without words
marks nothing.

The test set is read in blocks of at most ``block_words`` words. A block, and
never more, is broadcast, so memory has a fixed bound whatever the size of the
test set; texts are read once for each block. Texts are never shuffled.

Null texts and items count as empty. Rows that repeat a ``doc_id`` are judged
each on their own; items that share an id, or have none, are one item of several
texts. Ids may be of any type. Extra columns are ignored; either table may be
empty.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvida.llm.common import ascii_words, bounded_batches, texts_of, worker_state

#: 1 is a position that must agree, 0 one that is ignored.
MASKS = ("111101", "110111", "1101011", "1110011")
SEED_WORDS, LEFT_OUT = 5, 7
SIMILARITY = 0.8
MIN_WORDS = 13
BLOCK_WORDS = 1_000_000
_FILTER_BITS = 22

Item = tuple[object, list[bytes]]


def _multipliers(n: int) -> np.ndarray:
    odd = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return odd | np.uint64(1)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)


def _keys(tokens: np.ndarray, offsets: list[int], salt: int) -> np.ndarray:
    """Hash of the words at ``offsets`` from each position at which all of them exist."""
    n = len(tokens) - offsets[-1]
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, salt, dtype=np.uint64)
    for offset, multiplier in zip(offsets, _multipliers(len(offsets))):
        out += tokens[offset : offset + n] * multiplier
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def seeds(masks: tuple[str, ...] = MASKS) -> list[tuple[int, list[int]]]:
    """Number and offsets of every mask."""
    return [(i + 1, [j for j, c in enumerate(m) if c == "1"]) for i, m in enumerate(masks)]


class SeedIndex:
    """Hashes of a block of items, sorted, with a bit table before them."""

    def __init__(self, items: list[Item], masks: tuple[str, ...] = MASKS):
        self.items = items
        self.whole: dict[tuple[bytes, ...], list[int]] = {}
        by_length: dict[int, list[int]] = {}
        for at, (_, words) in enumerate(items):
            by_length.setdefault(len(words), []).append(at)
            if 0 < len(words) < SEED_WORDS:
                self.whole.setdefault(tuple(words), []).append(at)
        long = [at for n, some in by_length.items() if n > LEFT_OUT for at in some]
        shapes = [(salt, offsets, long) for salt, offsets in seeds(masks)]
        for n in range(SEED_WORDS, LEFT_OUT + 1):
            shapes += [(1000 + 32 * n + gone, [i for i in range(n) if i != gone], by_length[n]) for gone in range(n) if n in by_length]
        self.shapes = [(salt, offsets) for salt, offsets, _ in shapes]
        tables = []
        for salt, offsets, some in shapes:
            keys, where = [], []
            for at in some:
                k = _keys(_hashes(items[at][1]), offsets, salt)
                keys.append(k)
                where.append(np.stack([np.full(len(k), at, dtype=np.int64), np.arange(len(k), dtype=np.int64)], axis=1))
            k = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
            w = np.concatenate(where) if where else np.zeros((0, 2), dtype=np.int64)
            order = np.argsort(k, kind="stable")
            tables.append((k[order], w[order]))
        self.tables = tables
        self.bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
        for k, _ in tables:
            self.bits[k >> np.uint64(64 - _FILTER_BITS)] = True

    def diagonals(self, words: list[bytes]) -> set[tuple[int, int]]:
        """Item places and diagonals of all hits."""
        out = {(at, 0) for at in self.whole.get(tuple(words), [])} if len(words) < SEED_WORDS else set()
        tokens = _hashes(words)
        for (salt, offsets), (keys, where) in zip(self.shapes, self.tables):
            mine = _keys(tokens, offsets, salt)
            at = np.flatnonzero(self.bits[mine >> np.uint64(64 - _FILTER_BITS)])
            if not len(at) or not len(keys):
                continue
            low, high = np.searchsorted(keys, mine[at], "left"), np.searchsorted(keys, mine[at], "right")
            for pos, lo, hi in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                out.update((item, pos - start) for item, start in where[lo:hi].tolist())
        return out


def longest_overlap(same: list[bool], similarity: float) -> tuple[int, int, int]:
    """Start, length and agreeing words of the longest stretch that begins and ends with agreement and holds enough of it; 0, 0, 0 if none."""
    n = len(same)
    sums = [0] * (n + 1)
    for i, s in enumerate(same):
        sums[i + 1] = sums[i] + s
    score = [sums[i] - similarity * i for i in range(n + 1)]
    starts: list[int] = []
    for i in range(n):
        if same[i] and (not starts or score[i] < score[starts[-1]]):
            starts.append(i)
    best = (0, 0, 0)
    for end in range(n, 0, -1):
        if not same[end - 1]:
            continue
        while starts and score[end] - score[starts[-1]] >= -1e-9:
            start = starts.pop()
            if end - start > best[1]:
                best = (start, end - start, sums[end] - sums[start])
    return best


def _stretches(same: list[bool], similarity: float, least: int) -> list[tuple[int, int, int]]:
    """All stretches of ``least`` or more: the longest one, and those of what lies before and after it."""
    out, todo = [], [(0, len(same))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo >= max(1, least):
            start, length, agreeing = longest_overlap(same[lo:hi], similarity)
            if length >= max(1, least):
                out.append((lo + start, length, agreeing))
                todo += [(lo, lo + start), (lo + start + length, hi)]
    return out


def overlaps(words: list[bytes], index: SeedIndex, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> list[tuple[object, int, int, int]]:
    """The verified overlaps with each item: its id, first word in the text, words, agreeing words."""
    found: dict[object, list[tuple[int, int, int]]] = {}
    for at, diagonal in index.diagonals(words):
        item, test = index.items[at]
        lo, hi = max(0, -diagonal), min(len(test), len(words) - diagonal)
        same = [a == b for a, b in zip(test[lo:hi], words[lo + diagonal : hi + diagonal])]
        stretches = _stretches(same, similarity, min(len(test), min_words))
        if not stretches and hi - lo == len(test) and sum(same) >= similarity * len(test) - 1e-9:
            stretches = [(0, len(test), sum(same))]
        for start, length, agreeing in stretches:
            found.setdefault(item, []).append((lo + diagonal + start, length, agreeing))
    out = []
    for item, spans in found.items():
        kept: list[tuple[int, int]] = []
        for start, length, agreeing in sorted(set(spans), key=lambda x: (-x[1], -x[2], x[0])):
            place = bisect_left(kept, (start, 0))
            if (place == 0 or kept[place - 1][1] <= start) and (place == len(kept) or kept[place][0] >= start + length):
                kept.insert(place, (start, start + length))
                out.append((item, start, length, agreeing))
    return sorted(out, key=lambda x: (x[0] is None, x[0] or 0, *x[1:]))


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[Item]]:
    """The test set in blocks of bounded size; at least one, which may be empty."""
    block: list[Item] = []
    size, any_block = 0, False
    rows = benchmark.select("item_id", F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8")).distinct()
    for item, text in rows.toLocalIterator():
        words = ascii_words(bytes(text))
        if not words:
            continue
        if block and size + len(words) > block_words:
            yield block
            block, size, any_block = [], 0, True
        block.append((item, words))
        size += len(words)
    if block or not any_block:
        yield block


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each text and item that overlap: ``doc_id, item_id, first_word, n_words, n_agreeing, similarity``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    names = ["doc_id", "item_id", "first_word", "n_words", "n_agreeing"]
    item_type = benchmark.schema["item_id"].dataType
    arrow_item, kinds = to_arrow_type(item_type), (docs.schema["doc_id"].dataType.simpleString(), item_type.simpleString(), "long", "long", "long")
    out = None
    for block in item_blocks(benchmark, block_words):
        sent, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            # word hashes differ between processes, so each worker builds its own index
            index = worker_state(key, lambda: SeedIndex(sent.value, masks))
            for batch in batches:
                rows = [(k, *x) for k, text in enumerate(texts_of(batch)) for x in overlaps(ascii_words(text), index, similarity, min_words)]
                at, items, *numbers = zip(*rows) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(items, arrow_item), *(pa.array(c, pa.int64()) for c in numbers)], names=names)

        part = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
        out = part if out is None else out.unionAll(part)
    return out.withColumn("similarity", F.col("n_agreeing") / F.col("n_words"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that overlap no item; all columns stay."""
    spark = docs.sparkSession
    bounded_batches(spark)
    out = docs
    for block in item_blocks(benchmark, block_words):
        sent, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            # word hashes differ between processes, so each worker builds its own index
            index = worker_state(key, lambda: SeedIndex(sent.value, masks))
            for batch in batches:
                clean = [not overlaps(ascii_words(text), index, similarity, min_words) for text in texts_of(batch)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
