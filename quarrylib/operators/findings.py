"""Findings about a project graph, as one table, and what to do about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylib.functions import names

COLUMNS = ("kind", "project", "detail")
# Fixed values.
SEVERITY = {
    "cycle": "error",
    "version_conflict": "error",
    "forbidden_area_edge": "error",
    "unresolved": "warning",
    "unused": "warning",
    "undeclared": "warning",
    "orphan": "info",
}


def severity(kind: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, s in SEVERITY.items():
        out = out.when(kind == k, s)
    return out


def rows(df: DataFrame, kind: str, project: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), project.cast("string").alias("project"), detail.cast("string").alias("detail"))


def collect_findings(
    cycles: DataFrame | None = None, orphans: DataFrame | None = None, unresolved: DataFrame | None = None,
    unused: DataFrame | None = None, undeclared: DataFrame | None = None, conflicts: DataFrame | None = None, forbidden: DataFrame | None = None,
) -> DataFrame:
    """``kind, severity, project, detail`` of the operators' results; each is a branch of one union."""
    parts = []
    text = lambda c: F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ", ")
    if cycles is not None:
        parts.append(rows(cycles, "cycle", F.col("component"), text("members")))
    if orphans is not None:
        parts.append(rows(orphans, "orphan", F.col("node"), F.lit("")).distinct())
    if unresolved is not None:
        parts.append(rows(unresolved, "unresolved", F.col("src"), F.col("dst")))
    if unused is not None:
        parts.append(rows(unused, "unused", F.col("project"), F.col("name")).distinct())
    if undeclared is not None:
        parts.append(rows(undeclared, "undeclared", F.col("project"), F.col("ns")).distinct())
    if conflicts is not None:
        entries = F.array_join(F.transform("entries", lambda e: F.concat_ws("=", e["project"].cast("string"), e["version"])), ", ")
        parts.append(rows(conflicts, "version_conflict", F.col("name"), entries))
    if forbidden is not None:
        parts.append(rows(forbidden, "forbidden_area_edge", F.col("src"), F.concat_ws(": ", F.col("dst").cast("string"), F.col("reason"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("severity", severity(F.col("kind")))


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.agg(
        *[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "info")]
    )


def buckets(findings: DataFrame) -> DataFrame:
    """``kind, n, entries``: findings by kind, sorted."""
    return findings.groupBy("kind").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.concat_ws(" ", "project", F.nullif("detail", F.lit(""))))).alias("entries")
    )


def merge_candidates(nodes: DataFrame, edges: DataFrame, in_cycle: DataFrame) -> DataFrame:
    """``project, into, reason, confidence, loc`` of ``nodes(node, name, loc)`` that one project uses.

    Neither may be test-like, and the used one not on a cycle.
    """
    one = edges.groupBy(F.col("dst").alias("project")).agg(F.count("*").alias("n"), F.min("src").alias("into")).filter("n = 1")
    own = nodes.filter(~names.is_test_like(F.col("name"))).select(F.col("node").alias("project"), "loc")
    user = nodes.filter(~names.is_test_like(F.col("name"))).select(F.col("node").alias("into"))
    return (
        one.join(own, "project").join(user, "into", "left_semi")
        .join(in_cycle.select(F.col("node").alias("project")), "project", "left_anti")
        .select("project", "into", F.lit("single consumer").alias("reason"), F.lit("high").alias("confidence"), "loc")
    )


def cluster_candidates(nodes: DataFrame, edges: DataFrame, in_cycle: DataFrame) -> DataFrame:
    """``members, consumers, size, loc, confidence``: projects that the same projects use, two or more of them."""
    fit = nodes.filter(~names.is_test_like(F.col("name"))).join(in_cycle.select("node"), "node", "left_anti")
    users = edges.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("consumers"))
    return (
        fit.join(users, "node")
        .groupBy("consumers")
        .agg(F.array_sort(F.collect_list("node")).alias("members"), F.count("*").alias("size"), F.sum("loc").cast("long").alias("loc"))
        .filter("size >= 2")
        .withColumn("confidence", F.when(F.col("size") >= 3, "high").otherwise("medium"))
        .select("members", "consumers", "size", "loc", "confidence")
    )
