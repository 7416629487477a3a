"""Five stages from raw documents to token counts; each reads what the one before it kept.

Toxic documents go, later copies of repeated line runs are cut (a document
made of nothing else goes), one document of each near-duplicate group stays,
documents that overlap the benchmark go, and the rest is encoded. All but the
last stage return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corvida.llm import bpe, decontam, linededup, queries, simhash, toxicity
from corvida.session import Stage
from corvida.sources.tables import table

#: No SQL expresses a trained classifier or SimHash; tests compare with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, queries.toxicity_model(spark, sf_dir))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.without_repeats(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_per_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(docs, queries.byte_vocabulary(), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    stage, docs = Stage(spark, "pipeline"), table(spark, sf_dir, "documents")
    last = None
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage.write(docs)
            stage.drop(last)
            last = docs
    return docs
