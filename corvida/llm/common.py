"""What several operators of this package share: bounded Arrow batches and word splitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvida.session import Stage, ship_package

#: A-Z to a-z and every other ASCII byte that is no letter or digit to a space; bytes of longer characters stay.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

#: Rows of an Arrow batch at most. A batch is all that a Python worker holds of the table.
BATCH_ROWS = 256


def ascii_words(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of letters, digits and non-ASCII characters."""
    return text.translate(WORD_TABLE).split()


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, as a row may hold a very long text, and let the workers import this package."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null is the empty text."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def map_texts(docs: DataFrame, fn: Callable[[list[bytes]], dict[str, pa.Array]], schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the columns that ``fn`` makes of whole texts, batch by batch, without a shuffle."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = fn(texts_of(batch))
                yield pa.RecordBatch.from_arrays([batch.column(0), *made.values()], names=[key, *made])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, {schema}")


_STATE: dict[str, object] = {}


def worker_state(key: str, make: Callable[[], object]):
    """What a Python worker keeps between batches: one object, dropped when another operator or model comes."""
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = make()
    return _STATE[key]


#: Shares into which the rows of one key are dealt.
SALTS = 16


def salted_join(rows: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` left joined with ``few``, which has a row for each ``key``; a key's rows are dealt over ``SALTS`` shares by ``by``."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copies, [key, "_salt"], "left").drop("_salt")


#: Bits of a key filter for each key, in all at most (32 MB), and of one of its rows.
KEY_BITS, MOST_BITS, _ROW_BITS = 16, 1 << 28, 1 << 15


class KeyFilter:
    """A bitmap of hashed keys, in rows of fixed size, by which rows without a partner need no shuffle.

    It has at least 8 and up to ``KEY_BITS`` bits for each key, so 12 % of other
    rows at most pass, and never more than ``MOST_BITS``. Of more keys than that
    allows no bitmap is made and every row passes: a join then shuffles all.
    """

    def __init__(self, keys: DataFrame, cols: list[str], stage: Stage):
        count = keys.count()
        self.cols, self.bits = cols, _ROW_BITS
        while self.bits < KEY_BITS // 2 * count:
            self.bits *= 2
        self.rows = None
        if self.bits <= MOST_BITS:
            at = F.pmod(F.xxhash64(*cols), F.lit(self.bits))
            rows = keys.select(F.shiftright(at, 15).alias("bucket"), (at % _ROW_BITS).alias("at"))
            self.rows = stage.write(rows.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")))

    def may_match(self, rows: DataFrame, flag: str) -> DataFrame:
        """``rows`` with a boolean that is false only where no key equals."""
        if self.rows is None:
            return rows.withColumn(flag, F.lit(True))
        at = F.pmod(F.xxhash64(*self.cols), F.lit(self.bits))
        place = (at % _ROW_BITS).cast("int")
        found = rows.withColumns({"bucket": F.shiftright(at, 15), "at_byte": F.shiftright(place, 3) + 1, "at_bit": place % 8}).join(F.broadcast(self.rows), "bucket", "left")
        return found.withColumn(flag, F.coalesce(F.expr("shiftright(cast(conv(hex(substring(bits, at_byte, 1)), 16, 10) AS int), at_bit) & 1 = 1"), F.lit(False))).drop("bucket", "bits", "at_byte", "at_bit")
