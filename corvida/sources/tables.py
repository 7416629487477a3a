"""Readers: the driver tables, a group CSV, a class-directory scan and an XML case file scan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables; only Spark opens the path, so any store will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Names of case files and of their images; a fixed value of the input format.
FILE_NAME = r"^([1-9][0-9]*)(?:\.xml|_([1-9][0-9]*)\.jpg)$"


def has_suffix(name: Column, suffixes: tuple[str, ...]) -> Column:
    """Whether a name ends in one of the suffixes, whatever their case."""
    return F.lower(name).rlike(rf"\.({'|'.join(map(re.escape, suffixes))})$")


def case_of(name: Column) -> Column:
    """The case number in a file name; null if the name is none of ``FILE_NAME``."""
    return F.nullif(F.regexp_extract(name, FILE_NAME, 1), F.lit("")).cast("long")


def view_of(name: Column) -> Column:
    """The view number in the name of an image; null for any other name."""
    return F.nullif(F.regexp_extract(name, FILE_NAME, 2), F.lit("")).cast("long")


def class_directories(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("jpg", "jpeg", "png")) -> DataFrame:
    """``source, class_name, label, sha256, size`` of the files below exactly two class folders; label 0 is the first by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub("^[a-z0-9]+:/+", "/", root).rstrip("/")
    relative = F.expr("substring(path, locate(base, path) + length(base) + 1)")
    rows = files.withColumn("base", F.lit(base)).select(relative.alias("source"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size")).where(has_suffix(F.col("source"), suffixes) & F.col("source").contains("/"))
    rows = rows.withColumn("class_name", F.substring_index("source", "/", 1))
    names = sorted(r[0] for r in rows.select("class_name").distinct().limit(3).collect())
    if len(names) != 2:
        raise ValueError(f"two class folders with files are needed, not {names}")
    return rows.withColumn("label", (F.col("class_name") == names[1]).cast("int"))


def group_csv(spark: SparkSession, path: str) -> DataFrame:
    """``path, group`` of a CSV file with exactly these columns; groups are stripped, blanks and repeats refused."""
    header = spark.read.text(path).limit(1).collect()
    if not header or header[0][0].removeprefix("﻿").strip() != "path,group":
        raise ValueError("the header must be path,group")
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("group", T.StringType())])
    rows = spark.read.schema(schema).option("mode", "FAILFAST").csv(path, header=True, enforceSchema=True)
    rows = rows.select("path", F.trim("group").alias("group"))
    bad = rows.where(F.col("path").isNull() | (F.trim("path") == "") | F.col("group").isNull() | (F.col("group") == ""))
    if bad.take(1) or rows.groupBy("path").count().where("count > 1").take(1):
        raise ValueError("blank or repeated entries")
    return rows


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """``name, case_id, view, sha256, size`` of a flat folder of ``N.xml`` and ``N_M.jpg``; any other name is refused."""
    files = spark.read.format("binaryFile").load(root)
    name = F.substring_index("path", "/", -1)
    rows = files.select(name.alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))
    if odd := rows.where(case_of(F.col("name")).isNull()).select("name").take(3):
        raise ValueError(f"unexpected files {odd}")
    return rows.select("name", case_of(F.col("name")).alias("case_id"), view_of(F.col("name")).alias("view"), "sha256", "size")


#: Elements of a case file, fixed by its format: number, category, and where the views are.
CASE_TAGS = ("number", "tirads", "mark/image")


def case_files(spark: SparkSession, root: str, tags: tuple[str, str, str] = CASE_TAGS) -> DataFrame:
    """``case_id, category, views`` of ``N.xml`` files: one number equal to the name, one category (blank is null), view numbers.

    ``tags`` name the elements below ``case`` that hold them.
    """
    if not all(re.fullmatch("[A-Za-z_][A-Za-z0-9_.-]*(/[A-Za-z_][A-Za-z0-9_.-]*)*", t) for t in tags):
        raise ValueError(f"no element names: {tags}")
    number, category, view = tags
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(root)
    text = F.decode("content", "UTF-8")
    rows = files.select(F.regexp_extract(F.substring_index("path", "/", -1), r"^([1-9][0-9]*)\.xml$", 1).alias("named"), F.regexp_replace(text, "^﻿", "").alias("x"))
    if rows.where(F.upper("x").rlike("<!(DOCTYPE|ENTITY)") | F.col("x").contains("\x00")).take(1):
        raise ValueError("declarations and NUL are refused")
    one = lambda tag: F.expr(f"xpath_int(x, 'count(/case/{tag})')")
    value = lambda tag: F.trim(F.expr(f"xpath_string(x, '/case/{tag}')"))
    rows = rows.select("named", one(number).alias("n_number"), one(category).alias("n_category"), value(number).alias("number"), value(category).alias("category"), F.expr(f"xpath(x, '/case/{view}/text()')").alias("views"))
    views = F.transform("views", lambda v: F.trim(v))
    bad = (F.col("n_number") != 1) | (F.col("n_category") != 1) | (F.col("number") != F.col("named")) | (F.size("views") == 0) | F.exists(views, lambda v: ~v.rlike("^[1-9][0-9]*$")) | (F.size(F.array_distinct(views)) != F.size(views))
    if rows.where(bad).take(1):
        raise ValueError("malformed case file")
    return rows.select(F.col("number").cast("long").alias("case_id"), F.nullif("category", F.lit("")).alias("category"), F.array_sort(F.transform(views, lambda v: v.cast("long"))).alias("views"))


def expected_files(spark: SparkSession, path: str) -> DataFrame:
    """``name, sha256, size`` of a JSON list of objects with exactly these keys; digests are whole, sizes positive and names unique."""
    rows = spark.read.json(path, multiLine=True, mode="FAILFAST")
    if sorted(rows.columns) != ["name", "sha256", "size"]:
        raise ValueError(f"keys must be name, sha256 and size, not {rows.columns}")
    good = F.col("name").isNotNull() & F.col("sha256").cast("string").rlike("^[0-9a-f]{64}$") & (F.col("size").cast("long") > 0)
    if rows.where(~F.coalesce(good, F.lit(False))).take(1) or rows.groupBy("name").count().where("count > 1").take(1):
        raise ValueError("an invalid or repeated file")
    return rows.select("name", "sha256", F.col("size").cast("long").alias("size"))


_FIXTURE = "kind string, class_names array<string>, samples array<struct<source: string, group: string, label: int, split: string, sha256: string, probability: double>>"


def fixture(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """Samples of a small JSON document with their scores: ``sample_id, group, label, split, content_hash, p``.

    The document's digest is compared if one is given. Sources and digests are
    unique, groups are within one split, every split has both classes, and all
    but training samples have a score from 0 to 1.
    """
    from corvida.operators import contracts

    if sha256 is not None:
        held = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
        if held != contracts.check_digest(sha256):
            raise ValueError(f"{path} has changed")
    doc = spark.read.schema(_FIXTURE).json(path, multiLine=True, mode="FAILFAST")
    named = doc.select("kind", "class_names").first()
    if named is None or not named.kind or len(set(named.class_names or [])) != 2:
        raise ValueError(f"{path} has no kind or not two classes")
    rows = doc.select(F.inline("samples")).select(F.col("source").alias("sample_id"), "group", "label", "split", F.col("sha256").alias("content_hash"), F.col("probability").alias("p"))
    contracts.check_manifest(rows)
    contracts.require(contracts.unsafe_paths(rows, "sample_id"), "unsafe paths")
    contracts.require(contracts.repeated(rows, "content_hash"), "repeated content")
    contracts.require(contracts.bad_scores(rows.where("split != 'train'")), "invalid scores")
    return rows
