"""Types: totals, merged partial types, namespaces, references between projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylib.functions import names

#: Kinds of types in the order in which they are declared first. Fixed values.
KINDS = ("class", "interface", "struct", "record", "record_struct", "enum", "delegate")


def project_totals(types: DataFrame) -> DataFrame:
    """``project, types, loc, members, complexity``."""
    return types.groupBy("project").agg(
        F.count("*").alias("types"), *[F.sum(c).cast("long").alias(c) for c in ("loc", "members", "complexity")]
    )


def totals_with_grand(types: DataFrame) -> DataFrame:
    """``project_totals`` and a row of a null project that adds all up, in one pass."""
    return types.rollup("project").agg(
        F.count("*").alias("types"), *[F.sum(c).cast("long").alias(c) for c in ("loc", "members", "complexity")]
    )


def top_methods(methods: DataFrame, n: int = 20, project_like: str | None = None) -> DataFrame:
    """The ``n`` methods of most complexity, then lines, then by project, type, name and place; all if ``n`` is 0."""
    if project_like is not None:
        methods = methods.filter(F.contains("project", F.lit(project_like)))
    if not n:
        return methods
    return methods.orderBy(F.desc("complexity"), F.desc("loc"), "project", "fqn", "name", "line_start").limit(n)


def merge_partial(parts: DataFrame) -> DataFrame:
    """Types from their parts ``project, fqn, file_ord, pos, loc, members, complexity, bases, attributes, referenced_types``.

    Numbers add up; bases and attributes stay in the order in which they come first; referenced types are sorted.
    """
    listed = F.array_sort(F.collect_list(F.struct("file_ord", "pos", "bases", "attributes")))
    once = lambda c: F.array_distinct(F.flatten(F.transform("p", lambda x: x[c])))
    return (
        parts.groupBy("project", "fqn")
        .agg(
            F.count("*").alias("parts"), *[F.sum(c).cast("long").alias(c) for c in ("loc", "members", "complexity")],
            listed.alias("p"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("referenced_types")))).alias("referenced_types"),
        )
        .withColumns({"bases": once("bases"), "attributes": once("attributes")})
        .drop("p")
    )


def declared_kind(declared: DataFrame, last: bool = False) -> DataFrame:
    """``project, fqn, kind``: of a name declared in several kinds the first in ``KINDS``, or the last."""
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    pick = F.max_by if last else F.min_by
    return declared.groupBy("project", "fqn").agg(pick("kind", order).alias("kind"))


def split_namespaces(types: DataFrame, namespaces: DataFrame, none: str = "<global>") -> DataFrame:
    """``types(project, fqn, ...)`` with ``ns``, the longest declared namespace that the name lies in, and ``local``."""
    keys = types.select("project", "fqn").distinct()
    above = keys.select("project", "fqn", F.explode(names.dotted_prefixes(names.namespace_part(F.col("fqn")))).alias("ns"))
    found = above.join(namespaces.select("project", "ns").distinct(), ["project", "ns"]).groupBy("project", "fqn").agg(
        F.max_by("ns", F.length("ns")).alias("ns")
    )
    out = types.join(found, ["project", "fqn"], "left")
    local = F.when(F.col("ns").isNull(), F.col("fqn")).otherwise(F.substring(F.col("fqn"), F.length("ns") + 2, F.length("fqn")))
    return out.withColumn("local", local).withColumn("ns", F.coalesce("ns", F.lit(none)))


def grouped_classes(types: DataFrame) -> DataFrame:
    """``project, ns, kind, locals`` of ``project, ns, kind, local``: the sorted names of each namespace and kind."""
    return types.groupBy("project", "ns", "kind").agg(F.array_sort(F.collect_set("local")).alias("locals"))


def classify_references(referenced: DataFrame, catalog: DataFrame, usings: DataFrame | None = None) -> DataFrame:
    """``project, simple, n, class, targets`` for each ``referenced(project, simple)``.

    A catalogued type (``project, simple``, and ``ns`` where ``usings`` are given) is visible without a
    namespace, from its own project's namespace, or by a using of its namespace or one under it. A
    name that its own project declares is ``self``; else ``external``, ``resolved`` or ``ambiguous`` by
    the number of projects that declare it.
    """
    refs = referenced.select("project", "simple").distinct()
    owners = catalog.withColumnRenamed("project", "target")
    seen = refs.join(owners, "simple", "left")
    if usings is not None:
        # a using shows its own namespace and all above it
        shown = usings.select("project", F.explode(names.dotted_prefixes(F.col("ns"))).alias("ns")).distinct().withColumn("shown", F.lit(True))
        seen = seen.join(shown, ["project", "ns"], "left")
        visible = F.col("shown") | (F.coalesce("ns", F.lit("")) == "") | (F.col("target") == F.col("project"))
        seen = seen.withColumn("target", F.when(F.coalesce(visible, F.lit(False)), F.col("target")))
    return (
        seen.groupBy("project", "simple")
        .agg(F.array_sort(F.collect_set("target")).alias("targets"), F.coalesce(F.bool_or(F.col("target") == F.col("project")), F.lit(False)).alias("own"))
        .withColumn("n", F.size("targets").cast("long"))
        .withColumn("class", F.when(F.col("own"), "self").when(F.col("n") == 0, "external").when(F.col("n") == 1, "resolved").otherwise("ambiguous"))
        .select("project", "simple", "n", "class", "targets")
    )


def primary_spans(spans: DataFrame) -> DataFrame:
    """The first span of each type, by file, then place in it."""
    first = F.min_by(F.struct("file_id", "line_start", "line_end"), F.struct("file_id", "pos")).alias("s")
    return spans.groupBy("project", "fqn").agg(first).select("project", "fqn", "s.*")


def file_ids(files: DataFrame) -> DataFrame:
    """``files(project, path)`` with ``file_id``, from 0 by folder and name in each project."""
    from quarrylib.functions import paths

    order = Window.partitionBy("project").orderBy(paths.parent(F.col("path")), paths.file_name(F.col("path")))
    return files.withColumn("file_id", (F.row_number().over(order) - 1).cast("long"))


def own_files(files: DataFrame, projects: DataFrame) -> DataFrame:
    """``project, path``: files with the projects of the deepest project folder above; several if they share it."""
    from quarrylib.functions import paths

    dirs = projects.select("project", paths.parent(F.col("path")).alias("dir"))
    above = files.filter(~paths.is_build_output(F.col("path"))).select("path", F.explode(paths.ancestors(F.col("path"))).alias("dir"))
    deepest = above.join(dirs.select("dir").distinct(), "dir").groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("dir"))
    return deepest.join(dirs, "dir").select("project", "path")


def grouped_files(files: DataFrame) -> DataFrame:
    """``project, dir, files``: names by folder, ``.`` for the root."""
    from quarrylib.functions import paths

    folder = paths.parent(F.col("path"))
    return files.groupBy("project", F.when(folder == "", ".").otherwise(folder).alias("dir")).agg(
        F.array_sort(F.collect_set(paths.file_name(F.col("path")))).alias("files")
    )
