"""A folder of projects as the canonical tables."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylib.functions import paths
from quarrylib.operators import packages, types
from quarrylib.session import durable

from . import project_files, source_code


def files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``path`` (below the root), ``content``, ``mtime``, ``length`` of all files of a name pattern, hidden ones included.

    The pattern is matched while folders are listed, before any content is read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    here = root if ":" in root.split("/")[0] else "file:" + os.path.abspath(root)
    name = F.url_decode(F.replace(F.regexp_replace("path", "^(file|hdfs|viewfs):/+", "/"), F.lit("+"), F.lit("%2B")))
    base = "/" + here.split(":", 1)[1].lstrip("/")
    return raw.select(paths.relative(name, base).alias("path"), "content", F.col("modificationTime").alias("mtime"), "length")


def texts(df: DataFrame) -> DataFrame:
    return df.select("path", F.col("content").cast("string").alias("text"))


@dataclass
class Repository:
    """The tables of a folder; those of source code are there after ``scan``."""

    spark: SparkSession
    root: str
    projects: DataFrame
    package_refs: DataFrame
    project_refs: DataFrame
    assembly_refs: DataFrame
    errors: DataFrame
    missing: DataFrame
    source: dict[str, DataFrame] = field(default_factory=dict)
    source_files: DataFrame | None = None

    def edges(self) -> DataFrame:
        """``src, dst`` of references between projects that exist."""
        known = self.projects.select(F.col("project").alias("target_path"))
        return self.project_refs.join(known, "target_path", "left_semi").select(F.col("project").alias("src"), F.col("target_path").alias("dst"))

    def unresolved(self) -> DataFrame:
        known = self.projects.select(F.col("project").alias("target_path"))
        return self.project_refs.join(known, "target_path", "left_anti").select(F.col("project").alias("src"), F.col("target_path").alias("dst"))

    def graph(self, with_packages: bool = False) -> tuple[DataFrame, DataFrame]:
        """``nodes(key, label, kind)`` and ``edges(src, dst, kind)``, packages included if asked for."""
        nodes = self.projects.select(F.col("project").alias("key"), F.col("name").alias("label"), F.lit("project").alias("kind"))
        edges = self.edges().withColumn("kind", F.lit("project"))
        if with_packages:
            key = F.concat(F.lit("k:"), "name")
            nodes = nodes.union(self.package_refs.select(key, F.concat(F.lit("📦 "), "name"), F.lit("package")).distinct())
            edges = edges.union(self.package_refs.select("project", key, F.lit("package")))
        return nodes, edges

    def scan(self, cache: str | None = None) -> Repository:
        """Reads the projects' C# files; with a cache folder only those that changed since (``streaming.parse_cache``)."""
        found = files(self.spark, self.root, "*.[cC][sS]").filter(~paths.is_build_output(F.col("path")))
        if cache:
            from quarrylib.streaming.parse_cache import refresh

            parsed = refresh(found, cache)
        else:
            parsed = durable(source_code.parse_sources(source_code.decoded(found)), "parsed")
        self.source_files = types.file_ids(types.own_files(parsed.select("path"), self.projects))
        self.source = source_code.source_tables(parsed, self.source_files)
        return self


def load(spark: SparkSession, root: str) -> Repository:
    """Reads the projects that the solutions below a folder name and all others in it, or those of one file.

    Versions that a project leaves out come from the nearest central file above it; references to assemblies
    that are projects here become references to these. Files that can't be read are listed in
    ``errors``, projects that solutions name and that aren't there in ``missing``.
    """
    only: DataFrame | None = None
    if os.path.isfile(root):
        kind = root.rsplit(".", 1)[-1].lower()
        if kind not in ("sln", "csproj"):
            raise ValueError(f"neither a folder nor a solution or project: {root}")
        folder, name = os.path.split(os.path.abspath(root))
        root = os.path.dirname(folder) if kind == "csproj" else folder
        below = os.path.relpath(os.path.join(folder, name), root)
        if kind == "csproj":
            only = spark.range(1).select(F.lit(below).alias("path"))
        else:
            lines = _lines(texts(files(spark, folder, name)).filter(F.col("path") == name))
            only = project_files.solution_projects(lines).select("path")
    named = project_files.solution_projects(_lines(texts(files(spark, root, "*.[sS][lL][nN]")))).select("path") if only is None else only
    found = files(spark, root, "*.[cC][sS][pP][rR][oO][jJ]")
    missing = named.distinct().join(found.select("path"), "path", "left_anti")
    if only is not None:
        found = found.join(only.distinct(), "path", "left_semi")
    parsed = durable(project_files.parse_projects(texts(found)), "projects")
    t = project_files.project_tables(parsed)
    central = project_files.parse_central_versions(texts(files(spark, root, "Directory.Packages.props")))
    here = packages.nearest_central(t["projects"], central)
    promoted, outside = packages.promote_assemblies(t["projects"], t["assembly_refs"])
    listed = t["project_refs"].select("project", "target_path", "ord")
    extra = promoted.select("project", F.col("target").alias("target_path")).join(listed, ["project", "target_path"], "left_anti")
    return Repository(
        spark, root, t["projects"], packages.with_central_versions(t["package_refs"], here), listed.union(extra.withColumn("ord", F.lit(10**6))),
        outside, parsed.filter("error is not null").select("path", "error"), missing,
    )


def _lines(df: DataFrame) -> DataFrame:
    return df.select("path", F.explode(F.split(F.regexp_replace("text", "\r", ""), "\n")).alias("value"))
