"""The atlas: one row for each project with all that is known about its place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import areas, graph


def atlas(projects: DataFrame, edges: DataFrame, weights: DataFrame | None = None, spec: dict[str, list[str]] | None = None) -> DataFrame:
    """``project, name, path, area, fan_in, fan_out, layer, in_cycle, is_root, loc, deps``.

    ``projects`` has ``project, name, path``, ``edges`` the references between them, ``weights`` ``project, loc`` where types
    were scanned (else ``loc`` is null). The parts are made apart and meet by equi-joins on the project.
    """
    from quarrylib.functions import names

    nodes = projects.select(F.col("project").alias("node"))
    degree = graph.degrees(nodes, edges).withColumnRenamed("node", "project")
    layer = graph.layers(nodes, edges).withColumnRenamed("node", "project")
    cyclic = graph.strong_components(edges).select(F.col("node").alias("project"), F.lit(True).alias("in_cycle"))
    deps = edges.groupBy(F.col("src").alias("project")).agg(F.array_sort(F.collect_set("dst")).alias("deps"))
    out = areas.with_areas(projects, spec).join(degree, "project", "left").join(layer, "project", "left").join(cyclic, "project", "left").join(deps, "project", "left")
    if weights is not None:
        out = out.join(weights.select("project", "loc"), "project", "left")
    else:
        out = out.withColumn("loc", F.lit(None).cast("long"))
    root = (F.col("fan_in") == 0) & (F.col("fan_out") >= 3) & ~names.is_test_like(F.col("name"))
    return out.select(
        "project", "name", "path", "area", "fan_in", "fan_out", "layer", F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"),
        root.alias("is_root"), "loc", F.coalesce("deps", F.array().cast(edges.select(F.array("dst")).schema[0].dataType)).alias("deps"),
    )


def build_deps(projects: DataFrame, edges: DataFrame) -> DataFrame:
    """``project, wave, deps, dependents, rebuild``: sets, each sorted; ``rebuild`` by wave, then name."""
    nodes = projects.select(F.col("project").alias("node"))
    e = edges.distinct()
    layer = graph.layers(nodes, e)
    deps = e.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("deps"))
    users = e.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("dependents"))
    again = graph.dependents(nodes, e).join(layer.select(F.col("node").alias("rebuild"), "layer"), "rebuild")
    again = again.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("layer", "rebuild"))).alias("r"))
    empty = F.array().cast(e.select(F.array("dst")).schema[0].dataType)
    return (
        layer.join(deps, "node", "left").join(users, "node", "left").join(again, "node", "left")
        .select(F.col("node").alias("project"), F.col("layer").alias("wave"), F.coalesce("deps", empty).alias("deps"), F.coalesce("dependents", empty).alias("dependents"),
                F.transform("r", lambda x: x["rebuild"]).alias("rebuild"))
    )
