"""Batch lookup: projects, types and files by what a user types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylib.functions import names


def resolve_projects(projects: DataFrame, queries: DataFrame, most: int = 20) -> DataFrame:
    """``query, outcome, name, n, candidates`` for each of ``queries(query)`` against ``projects(name)``.

    Three tiers, without case: equal, ends with, contains. One equal name, else one that ends so, else one that
    contains it is ``found``; several equal or up to ``most`` of a lower tier are ``ambiguous``; more that end so
    leave it to the last tier, where more are ``too_many``; none is ``not_found``. One pass counts all tiers.
    The queries are typed, so few, and broadcast.
    """
    q = F.lower("query")
    n = F.lower("name")
    tier = F.when(n == q, 1).when(n.endswith(q), 2).otherwise(3)
    hits = projects.select("name").join(F.broadcast(queries.select("query").distinct()), F.contains(n, q)).withColumn("tier", tier)
    at = lambda k: F.array_sort(F.collect_list(F.when(F.col("tier") <= k, F.col("name"))))
    listed = hits.groupBy("query").agg(*[F.count_if(F.col("tier") <= k).alias(f"n{k}") for k in (1, 2, 3)], *[at(k).alias(f"t{k}") for k in (1, 2, 3)])
    use = F.when(F.col("n1") > 0, 1).when((F.col("n2") > 0) & (F.col("n2") <= most), 2).otherwise(3)
    pick = lambda p: F.when(use == 1, F.col(f"{p}1")).when(use == 2, F.col(f"{p}2")).otherwise(F.col(f"{p}3"))
    got = queries.select("query").distinct().join(listed, "query", "left").withColumns({"n": F.coalesce(pick("n"), F.lit(0)).cast("long"), "all": pick("t")})
    outcome = F.when(F.col("n") == 0, "not_found").when(F.col("n") == 1, "found").when((F.col("n") <= most) | (F.col("n1") > 1), "ambiguous").otherwise("too_many")
    got = got.withColumn("outcome", outcome)
    return got.select(
        "query", "outcome", F.when(F.col("outcome") == "found", F.get("all", F.lit(0))).alias("name"), "n",
        F.when(F.col("outcome") == "ambiguous", F.col("all")).otherwise(F.array().cast("array<string>")).alias("candidates"),
    )


def lookup_types(types: DataFrame, queries: DataFrame) -> DataFrame:
    """``query`` and the columns of ``types(project, fqn, ns, local, ...)`` for each match.

    A simple name matches a type of that name, nested or not; a dotted one the namespace before its last
    dot with what is after it, or a full name.
    """
    q = F.broadcast(queries.select("query").distinct())
    dotted = F.instr("query", ".") > 0
    before, last = names.namespace_part(F.col("query")), names.simple_name(F.col("query"))
    simple = names.matches_type(F.col("local"), F.col("query"))
    full = (F.col("fqn") == F.col("query")) | ((F.col("ns") == before) & F.col("local").endswith(last))
    return types.join(q, names.simple_name(F.col("local")) == last, "inner").filter(F.when(dotted, full).otherwise(simple)).select("query", *types.columns)


def callers(matches: DataFrame, references: DataFrame) -> DataFrame:
    """``query, project, fqn, callers, ambiguous_in``: projects whose mentions of the name mean this type, or may."""
    simple = names.simple_name(F.col("fqn"))
    used = references.filter(F.col("class").isin("resolved", "ambiguous")).select(F.col("project").alias("caller"), "simple", "class", F.explode("targets").alias("project"))
    joined = matches.select("query", "project", "fqn", simple.alias("simple")).distinct().join(used, ["project", "simple"], "left")
    of = lambda c: F.array_sort(F.collect_set(F.when(F.col("class") == c, F.col("caller"))))
    return joined.groupBy("query", "project", "fqn").agg(of("resolved").alias("callers"), of("ambiguous").alias("ambiguous_in"))


def subclasses(types: DataFrame, queries: DataFrame) -> DataFrame:
    """``query, project, subclasses``: types with the name among their bases."""
    bases = types.select("project", "fqn", F.explode("bases").alias("base")).distinct()
    q = F.broadcast(queries.select("query").distinct())
    return bases.join(q, F.col("base") == names.simple_name(F.col("query"))).groupBy("query", "project").agg(F.array_sort(F.collect_set("fqn")).alias("subclasses"))


def lookup_files(files: DataFrame, spans: DataFrame, queries: DataFrame) -> DataFrame:
    """``query, project, path, types`` for each file whose path ends in a query; its types as ``name La-b``, sorted."""
    q = F.broadcast(queries.select("query").distinct().withColumn("needle", F.replace("query", F.lit("\\"), F.lit("/"))))
    hit = files.join(q, F.col("path").endswith(F.col("needle"))).select("query", "project", "path", "file_id")
    named = spans.select("project", "file_id", F.concat("fqn", F.lit(" L"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string")).alias("t"))
    return hit.join(named, ["project", "file_id"], "left").groupBy("query", "project", "path").agg(F.array_sort(F.collect_set("t")).alias("types"))


def located(spans: DataFrame, files: DataFrame) -> DataFrame:
    """``spans`` with ``at``: the file's path, or ``f`` and its number where it isn't known, with the lines."""
    joined = spans.join(files.select("project", "file_id", "path"), ["project", "file_id"], "left")
    where = F.coalesce("path", F.concat(F.lit("f"), F.col("file_id").cast("string")))
    return joined.withColumn("at", F.concat(where, F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string")))


def with_signatures(methods: DataFrame, signatures: DataFrame) -> DataFrame:
    """``methods`` with ``signature``, by ``path, line_start``, or the name where there's none."""
    s = signatures.select("path", "line_start", F.col("signature").alias("_s"))
    return methods.join(s, ["path", "line_start"], "left").withColumn("signature", F.coalesce("_s", "name")).drop("_s")
