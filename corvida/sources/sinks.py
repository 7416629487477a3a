"""Sinks: split and cohort tables published whole or not at all, and reports written once."""

from __future__ import annotations

import json
import math
import uuid
from html import escape

from pyspark.sql import DataFrame

from corvida.operators.contracts import check_manifest, check_relative_path
from corvida.operators.lineage import write_once


def publish(df: DataFrame, path: str, partition_by: list[str] | None = None, check=None) -> None:
    """Write beside the target, check what was written, then rename; an existing target is refused."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"
    try:
        df.write.partitionBy(*(partition_by or [])).parquet(staged)
        if check:
            check(spark.read.parquet(staged))
        if fs.exists(target) or not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(staged), target):
            raise FileExistsError(path)
    finally:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(staged), True)


def publish_all(frames: dict[str, DataFrame], path: str, check=None) -> None:
    """Several tables in one new folder, which appears with all of them or not at all.

    ``check`` is called after the last write and before the folder appears.
    """
    spark = next(iter(frames.values())).sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    target = jvm.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"
    try:
        for name, rows in frames.items():
            rows.write.parquet(f"{staged}/{check_relative_path(name)}")
        if check:
            check()
        if fs.exists(target) or not fs.rename(jvm.Path(staged), target):
            raise FileExistsError(path)
    finally:
        fs.delete(jvm.Path(staged), True)


def publish_split(rows: DataFrame, path: str) -> None:
    """A split table, partitioned by split, so that reading one split prunes the others."""
    publish(rows, path, ["split"], check_manifest)


def write_report(report: dict, path: str) -> str:
    """A JSON report in a new file; NaN is refused."""
    return write_once(path, report)


#: Rows of a report at most; a longer one is refused, as it belongs in a table.
MOST_ROWS = 100_000


def _all_rows(rows: DataFrame) -> DataFrame:
    if rows.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise ValueError(f"a report holds {MOST_ROWS} rows at most; publish a table instead")
    return rows


def _cell(value) -> str:
    """A value as escaped text; a dash where it isn't defined."""
    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return "—"
    return f"{value:.4f}" if isinstance(value, float) else escape(str(value))


def _table(rows: DataFrame) -> str:
    head = "".join(f"<th>{escape(c)}</th>" for c in rows.columns)
    body = "".join("<tr>" + "".join(f"<td>{_cell(v)}</td>" for v in row) + "</tr>" for row in _all_rows(rows).collect())
    return f"<table><tr>{head}</tr>{body}</table>"


def report_html(title: str, sections: dict[str, DataFrame | str], digests: dict[str, str] | None = None) -> str:
    """A page without scripts or outside parts: a heading and a table or a paragraph for each section, and what it rests on.

    Every text is escaped, and the page's own policy forbids it to load anything.
    """
    parts = "".join(f"<h2>{escape(name)}</h2>" + (f"<p>{escape(x)}</p>" if isinstance(x, str) else _table(x)) for name, x in sections.items())
    rests = "".join(f"<dt>{escape(k)}</dt><dd><code>{escape(v)}</code></dd>" for k, v in (digests or {}).items())
    policy = "default-src 'none'; base-uri 'none'; form-action 'none'"
    return f"<!DOCTYPE html><meta charset=utf-8><meta http-equiv=Content-Security-Policy content=\"{policy}\"><title>{escape(title)}</title><h1>{escape(title)}</h1>{parts}" + (f"<dl>{rests}</dl>" if rests else "")


def measurement_html(measured: dict[str, DataFrame], title: str, digests: dict[str, str] | None = None) -> str:
    """What ``workflow.measure`` returns as a page: seeds, their summary, intervals, support and resolution."""
    names = {"per_seed": "Seeds", "across_seeds": "Across seeds", "intervals": "Intervals over test groups", "baseline": "Constant class", "support": "Support", "resolution": "Worth of one error"}
    return report_html(title, {text: measured[k] for k, text in names.items() if k in measured}, digests)


def metrics_html(rows: DataFrame, title: str) -> str:
    """A page with the table of a metrics frame."""
    return report_html(title, {"Metrics": rows})


def metrics_json(rows: DataFrame) -> list[dict]:
    """Rows of a metrics frame as JSON values; null stays null."""
    return [json.loads(x) for x in _all_rows(rows).toJSON().collect()]
