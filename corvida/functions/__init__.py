"""Scalar helpers that keep engines and seeds comparable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by colons; the same in any SQL engine."""
    text = F.concat_ws(":", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def content_digest(text: Column) -> Column:
    """SHA-256 of a text's bytes."""
    return F.sha2(text, 256)


#: Which categories belong to which class.
CATEGORY_LABELS = {"2": 0, "3": 0, "4a": 1, "4b": 1, "4c": 1, "5": 1}


def known_label(category: Column) -> Column:
    """0 or 1 of an ordinal category, null of any other value."""
    of = lambda label: category.isin(*(c for c, x in CATEGORY_LABELS.items() if x == label))
    return F.when(of(0), 0).when(of(1), 1)


def mapped_label(category: Column) -> Column:
    """0 or 1 of an ordinal category; null stays null and an unknown category aborts the query."""
    return F.when(category.isNull(), None).otherwise(F.coalesce(known_label(category), F.raise_error(F.concat(F.lit("unsupported category "), category)).cast("int")))
