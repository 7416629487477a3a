"""Identity graph: records linked by shared keys, exclusion after linking, and cohort counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvida.operators.components import connected_components


def link_components(rows: DataFrame, node: str, keys: list[str]) -> DataFrame:
    """``node, component`` for every node; nodes that share a value of any key column are linked.

    A key's nodes are all linked to its smallest one, so a value that many
    nodes share makes as many edges and not their square. The component is the
    smallest node. Null keys link nothing. All joins merge, so nothing that grows
    with the rows passes through the driver.
    """
    edges = None
    for name in keys:
        pairs = rows.where(F.col(name).isNotNull() & F.col(node).isNotNull()).select(F.col(node).alias("n"), F.col(name).alias("k")).distinct()
        hub = pairs.groupBy("k").agg(F.min("n").alias("src"))
        part = pairs.join(hub.hint("merge"), "k").where("n != src").select("src", F.col("n").alias("dst"))
        edges = part if edges is None else edges.unionByName(part)
    found = connected_components(edges).withColumnRenamed("node", node)
    nodes = rows.select(node).where(F.col(node).isNotNull()).distinct()
    return nodes.join(found.hint("merge"), node, "left").select(node, F.coalesce("component", node).alias("component"))


def exclude_missing(rows: DataFrame, label: str = "label", reason: str = "missing_label") -> tuple[DataFrame, DataFrame]:
    """Rows with a label, and the others with a recorded reason. Components must be known before."""
    return rows.where(F.col(label).isNotNull()), rows.where(F.col(label).isNull()).withColumn("reason", F.lit(reason))


def group_support(rows: DataFrame, row_id: str, group: str, content: str, strict: bool = True) -> DataFrame:
    """One row: rows, distinct groups, components linked by group or content. Blank groups and contents are rejected, or link nothing if null without ``strict``."""
    blank = rows.where(F.col(group).isNull() | (F.trim(F.col(group).cast("string")) == "") | F.col(content).isNull() | (F.trim(content) == ""))
    if strict and blank.take(1):
        raise ValueError(f"blank or missing {group} or {content}")
    linked = link_components(rows, row_id, [group, content])
    sides = linked.agg(F.count_distinct("component").alias("n_components")).unionByName(rows.agg(F.count("*").alias("n_rows"), F.count_distinct(group).alias("n_groups")), allowMissingColumns=True)
    return sides.agg(*(F.max(c).alias(c) for c in ("n_rows", "n_groups", "n_components")))


def conflicting(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key, n_values``: keys whose rows carry more than one value; a grouped count, never a self join."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def cohort_counts(rows: DataFrame, case: str = "case_id", label: str = "label", component: str = "component") -> DataFrame:
    """One row of counts of cases, images and components, all, included and excluded, and images by class."""
    has = F.col(label).isNotNull()
    return rows.agg(
        F.count_distinct(case).alias("cases_all"),
        F.count("*").alias("images_all"),
        F.count_distinct(F.when(has, F.col(case))).alias("cases_included"),
        F.count_if(has).alias("images_included"),
        F.count_distinct(F.when(~has, F.col(case))).alias("cases_excluded"),
        F.count_if(~has).alias("images_excluded"),
        F.count_distinct(component).alias("components_all"),
        F.count_distinct(F.when(has, F.col(component))).alias("components_included"),
        F.count_if(F.col(label) == 0).alias("class_0"),
        F.count_if(F.col(label) == 1).alias("class_1"),
    )


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: ``n_rows``, ``fingerprint``, a digest of the rows' content whatever their order and partitions.

    Row digests are sorted and joined within the 65,536 chunks of their first
    four digits, chunk digests within their first two, and those at the end, so
    a task holds a small share of the digests only.
    """
    row = F.sha2(F.to_json(F.struct(*(F.col(c) for c in columns)), {"ignoreNullFields": "false"}), 256)
    joined = lambda by, d: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, d))), lambda x: x["d"]), ""), 256).alias("d")
    held = rows.select(row.alias("d")).withColumn("c", F.substring("d", 1, 4)).groupBy("c").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"))
    held = held.groupBy(F.substring("c", 1, 2).alias("b")).agg(F.sum("n").alias("n"), joined("c", F.col("d")))
    return held.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), joined("b", F.col("d")).alias("fingerprint"))
