"""Areas: overrides from a specification, rules between areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylib.functions import paths


def matched_entries(projects: DataFrame, spec: dict[str, list[str]]) -> tuple[DataFrame, list[str]]:
    """``project, area, entry, weight`` for each specification entry that claims a project, and warnings.

    A plain entry claims a path or all under it; one with glob characters a path or a folder above it.
    The weight is the length before the first of these. The specification is hand-written, so its
    few patterns are literals of the plan: each path is looked at once, without a join.
    """
    warnings, entries = [], []
    p = F.col("path")
    for area in sorted(spec):
        for entry in spec[area]:
            meta = paths.GLOB.search(entry)
            try:
                if meta:
                    hit = _glob(p, paths.glob_to_regex(entry))
                else:
                    hit = (p == entry) | p.startswith(entry.rstrip("/") + "/")
            except ValueError as e:
                warnings.append(f"area `{area}` entry `{entry}`: {e}")
                continue
            weight = meta.start() if meta else len(entry)
            entries.append(F.when(hit, F.struct(F.lit(area).alias("area"), F.lit(entry).alias("entry"), F.lit(weight).alias("weight"))))
    found = F.filter(F.array(*entries), lambda e: e.isNotNull()) if entries else F.array().cast("array<struct<area:string,entry:string,weight:int>>")
    return projects.select("project", F.explode(found).alias("e")).select("project", "e.*"), warnings


def _glob(path, rx: str):
    return path.rlike(rx) | F.exists(F.filter(paths.ancestors(path), lambda a: a != ""), lambda a: a.rlike(rx))


def overrides(matched: DataFrame) -> DataFrame:
    """``project, area``: the entry of most weight; of equals the first area by name."""
    return matched.groupBy("project").agg(F.min_by("area", F.struct(-F.col("weight"), "area")).alias("area"))


def tied(matched: DataFrame) -> DataFrame:
    """``project, areas``: projects that several areas claim with the same, highest weight."""
    best = matched.groupBy("project").agg(F.max("weight").alias("weight"))
    return matched.join(best, ["project", "weight"]).groupBy("project").agg(F.array_sort(F.collect_set("area")).alias("areas")).filter(F.size("areas") > 1)


def with_areas(projects: DataFrame, spec: dict[str, list[str]] | None = None) -> DataFrame:
    """``projects`` with ``area``: its own or, where the specification claims it, the claimed one."""
    derived = projects.withColumn("area", paths.area(F.col("path")))
    if not spec:
        return derived
    found = overrides(matched_entries(projects, spec)[0]).withColumnRenamed("area", "_area")
    return derived.join(found, "project", "left").withColumn("area", F.coalesce("_area", "area")).drop("_area")


def roll_up(projects: DataFrame) -> DataFrame:
    """``area, size, members, root``: number and sorted ids of each area's projects, and the folder."""
    return projects.groupBy("area").agg(
        F.count("*").alias("size"), F.array_sort(F.collect_list("project")).alias("members"), F.min(paths.area_root(F.col("path"))).alias("root")
    )


def forbidden_edges(edges: DataFrame, areas: DataFrame, rules: DataFrame) -> DataFrame:
    """``src, src_area, dst, dst_area, reason`` of edges between areas that a rule forbids.

    ``rules`` has ``area, allow, deny`` and, if an area has several, ``ord``: the first counts. What ``allow`` lists, where
    it is given, may be used, else what ``deny`` doesn't list.
    """
    if "ord" in rules.columns:
        rules = rules.groupBy("area").agg(F.min_by(F.struct("allow", "deny"), "ord").alias("r")).select("area", "r.*")
    r = F.broadcast(rules.select(F.col("area").alias("src_area"), "allow", "deny"))  # hand-written, so small
    between = (
        edges.join(areas.select(F.col("project").alias("src"), F.col("area").alias("src_area")), "src")
        .join(areas.select(F.col("project").alias("dst"), F.col("area").alias("dst_area")), "dst")
        .filter("src_area <> dst_area")
        .join(r, "src_area")
    )
    a, b, quote = F.col("src_area"), F.col("dst_area"), F.lit("`")
    name = lambda c: F.concat(quote, c, quote)
    reason = (
        F.when(F.col("allow").isNotNull() & (F.size("allow") == 0), F.concat(F.lit("area "), name(a), F.lit(" is isolated (allow: [])")))
        .when(F.col("allow").isNotNull() & ~F.array_contains("allow", b), F.concat(F.lit("area "), name(a), F.lit(" may only depend on: "), F.array_join("allow", ", ")))
        .when(F.col("deny").isNotNull() & F.array_contains("deny", b), F.concat(F.lit("area "), name(a), F.lit(" denies "), name(b)))
    )
    return between.withColumn("reason", reason).filter("reason is not null").select("src", "src_area", "dst", "dst_area", "reason")


def unknown_areas(rules: DataFrame, areas: DataFrame) -> DataFrame:
    """``rule_area, named``: areas that rules name, their own included, and no project has."""
    named = rules.select(F.col("area").alias("rule_area"), F.explode(F.concat(F.array("area"), *[F.coalesce(c, F.array().cast("array<string>")) for c in (F.col("allow"), F.col("deny"))])).alias("named"))
    return named.distinct().join(areas.select(F.col("area").alias("named")).distinct(), "named", "left_anti").select("rule_area", "named")
