"""Packages: central versions, conflicts, external references, use and declaration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylib.functions import names, paths


def nearest_central(projects: DataFrame, central: DataFrame) -> DataFrame:
    """``project, name, version``: the central versions that hold for each ``project, path``.

    The file of the deepest folder above a project counts alone; in it a name's last entry (``ord``) does.
    """
    last = central.groupBy("props_dir", "name").agg(F.max_by("version", "ord").alias("version"))
    dirs = last.select("props_dir").distinct()
    above = projects.select("project", F.explode(paths.ancestors(F.col("path"))).alias("props_dir"))
    deepest = above.join(dirs, "props_dir").groupBy("project").agg(F.max_by("props_dir", F.length("props_dir")).alias("props_dir"))
    return deepest.join(last, "props_dir").select("project", "name", "version")


def with_central_versions(package_refs: DataFrame, central: DataFrame) -> DataFrame:
    """``package_refs`` with missing versions from ``central(project, name, version)``; explicit ones stay."""
    found = central.select(F.col("project").alias("_p"), F.col("name").alias("_n"), F.col("version").alias("_v"))
    on = package_refs["version"].isNull() & (package_refs["project"] == found["_p"]) & (package_refs["name"] == found["_n"])
    return package_refs.join(found, on, "left").withColumn("version", F.coalesce("version", "_v")).drop("_p", "_n", "_v")


def version_conflicts(package_refs: DataFrame) -> DataFrame:
    """``name, versions, entries``: packages in more than one version; entries are sorted (project, version)."""
    known = package_refs.filter("version is not null")
    return (
        known.groupBy("name")
        .agg(F.array_sort(F.collect_set("version")).alias("versions"), F.array_sort(F.collect_list(F.struct("project", "version"))).alias("entries"))
        .filter(F.size("versions") > 1)
    )


def promote_assemblies(projects: DataFrame, assembly_refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assembly references that name a sibling project: ``(project, target)`` of these, and the other references.

    The name is what stands before the first comma, compared without case; a project isn't its own
    sibling; of projects of one name the last path counts.
    """
    by_name = projects.groupBy(F.lower("name").alias("key")).agg(F.max("project").alias("target"))
    key = F.lower(F.trim(F.substring_index("raw_include", ",", 1)))
    joined = assembly_refs.withColumn("key", key).join(by_name, "key", "left")
    is_sibling = F.col("target").isNotNull() & (F.col("target") != F.col("project"))
    return (
        joined.filter(is_sibling).select("project", "target").distinct(),
        joined.filter(~F.coalesce(is_sibling, F.lit(False))).select("project", "raw_include"),
    )


def external_refs(package_refs: DataFrame, assembly_refs: DataFrame) -> DataFrame:
    """``project, name, version`` of packages and assemblies from outside, each once."""
    plain = assembly_refs.select("project", F.trim(F.substring_index("raw_include", ",", 1)).alias("name"), F.lit(None).cast("string").alias("version"))
    return package_refs.select("project", "name", "version").unionByName(plain).distinct()


def using_prefixes(usings: DataFrame) -> DataFrame:
    """``project, ns, prefix``: every namespace that a using lies in, so that a prefix match is an equi-join."""
    return usings.select("project", "ns").distinct().select("project", "ns", F.explode(names.dotted_prefixes(F.col("ns"))).alias("prefix"))


def unused_packages(package_refs: DataFrame, usings: DataFrame, is_tool=None) -> DataFrame:
    """``project, name``: packages whose namespace no using of the project lies in.

    Projects without usings, which weren't scanned, have none; tool packages aren't expected in code.
    """
    tool = names.is_tool_package(F.col("name"), F.col("private_assets")) if is_tool is None else is_tool
    wanted = package_refs.filter(~tool).select("project", "name", names.package_namespace(F.col("name")).alias("prefix")).distinct()
    scanned = usings.select("project").distinct()
    served = using_prefixes(usings).select("project", "prefix").distinct()
    return wanted.join(scanned, "project", "left_semi").join(served, ["project", "prefix"], "left_anti").select("project", "name").distinct()


def undeclared_usings(usings: DataFrame, declared: DataFrame) -> DataFrame:
    """``project, ns``: usings under no namespace of ``declared(project, prefix)`` and not built in."""
    open_ = usings.select("project", "ns").distinct().filter(~names.is_builtin(F.col("ns")))
    served = using_prefixes(open_).join(declared.select("project", "prefix").distinct(), ["project", "prefix"], "left_semi")
    return open_.join(served.select("project", "ns").distinct(), ["project", "ns"], "left_anti")


def declared_namespaces(package_refs: DataFrame, project_refs: DataFrame, assembly_refs: DataFrame, namespaces: DataFrame) -> DataFrame:
    """``project, prefix``: what a project may use: its packages', the names of projects and assemblies it
    refers to, and its own namespaces."""
    parts = [
        package_refs.select("project", names.package_namespace(F.col("name")).alias("prefix")),
        project_refs.select("project", paths.stem(F.col("target_path")).alias("prefix")),
        assembly_refs.select("project", F.trim(F.substring_index("raw_include", ",", 1)).alias("prefix")),
        namespaces.select("project", F.col("ns").alias("prefix")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def derived_ids(projects: DataFrame) -> DataFrame:
    """``project, name, id``: short ids: names without a prefix that most share, ``#2``, ``#3``... where they collide."""
    strip = strip_prefix(projects).select(F.col("prefix").alias("_strip"))
    cut = projects.select("project", "name").crossJoin(F.broadcast(strip.agg(F.max("_strip").alias("_strip"))))  # one row
    rest = F.when(F.col("name").startswith(F.col("_strip")) & (F.length("name") > F.length("_strip")), F.substring(F.col("name"), F.length("_strip") + 1, F.length("name")))
    order = Window.partitionBy("short").orderBy("project")
    return cut.withColumn("short", F.coalesce(rest, "name")).withColumn("n", F.row_number().over(order)).select(
        "project", "name", F.when(F.col("n") == 1, F.col("short")).otherwise(F.concat("short", F.lit("#"), F.col("n").cast("string"))).alias("id")
    )


def strip_prefix(projects: DataFrame) -> DataFrame:
    """``prefix``: one row with a dotted prefix to leave out of names, or no row.

    Of six names or more, the most frequent prefix of three segments, else of two, that names with more
    segments share, if half of all names have it and what is left clashes with no other name.
    """
    all_names = projects.select("name")
    parts = F.split("name", r"\.")
    votes = all_names.select(F.explode(F.array(F.lit(3), F.lit(2))).alias("segments"), "name").filter(F.size(parts) > F.col("segments"))
    votes = votes.select("segments", F.concat(F.array_join(F.slice(parts, F.lit(1), F.col("segments")), "."), F.lit(".")).alias("prefix"))
    counts = votes.groupBy("segments", "prefix").count()
    best = counts.groupBy("segments").agg(F.min_by("prefix", F.struct(-F.col("count"), "prefix")).alias("prefix"), F.max("count").alias("votes"))
    total = all_names.agg(F.count("*").alias("total"))
    good = best.crossJoin(F.broadcast(total)).filter((F.col("total") >= 6) & (F.col("votes") * 2 >= F.col("total")))  # two rows, one row
    named = all_names.distinct().join(F.broadcast(good), F.lit(True))  # at most two rows broadcast
    has = F.col("name").startswith(F.col("prefix"))
    rest = F.substring(F.col("name"), F.length("prefix") + 1, F.length("name"))
    split = named.select("segments", "prefix", has.alias("has"), F.when(has, rest).otherwise(F.col("name")).alias("id")).filter("id <> ''")
    clash = split.groupBy("segments", "prefix", "id").agg(F.countDistinct("has").alias("kinds")).groupBy("segments", "prefix").agg(F.max("kinds").alias("kinds"))
    return clash.filter("kinds = 1").orderBy(F.desc("segments")).limit(1).select("prefix")
