"""The commands: scan, graph, atlas, metrics, focus, lookup, init and usings, over a folder of projects.

Each gives DataFrames, or text for those that draw. ``python -m quarrylib.app COMMAND PATH`` prints them.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylib import sinks
from quarrylib.functions import names
from quarrylib.operators import areas, endpoints, findings, graph, lookup, packages, types
from quarrylib.operators.atlas import atlas as atlas_of
from quarrylib.operators.atlas import build_deps
from quarrylib.sources import csharp, spec
from quarrylib.sources.repository import Repository, load

FOLDER = ".quarry"


def scan(spark: SparkSession, path: str) -> Repository:
    return load(spark, path)


def graph_tables(repo: Repository, with_packages: bool = False) -> dict[str, DataFrame]:
    nodes, edges = repo.graph(with_packages)
    plain = repo.edges()
    keys = repo.projects.select(F.col("project").alias("node"))
    return {
        "nodes": nodes, "edges": edges, "cycles": graph.cycles(plain), "orphans": graph.orphans(keys, plain), "unresolved": repo.unresolved(),
    }


def draw_graph(repo: Repository, form: str = "text", with_packages: bool = False) -> str:
    t = graph_tables(repo, with_packages)
    if form == "json":
        return sinks.text(_json_lines(t))
    lines = {"dot": lambda: sinks.dot(t["nodes"], t["edges"]), "mermaid": lambda: sinks.mermaid(t["nodes"], t["edges"]), "text": lambda: sinks.graph_text(**t)}
    return sinks.text(lines[form]())


def _json_lines(t: dict[str, DataFrame]) -> DataFrame:
    out = None
    for k, (name, df) in enumerate(t.items()):
        rows = sinks.as_json(df).select(F.lit(k).alias("part"), F.col("value").alias("ord"), F.concat(F.lit(f'{{"{name}":'), "value", F.lit("}")).alias("line"))
        out = rows if out is None else out.union(rows)
    return out


def check(repo: Repository, rules: DataFrame | None = None, placed: DataFrame | None = None) -> DataFrame:
    """All findings of a scanned repository."""
    t = graph_tables(repo)
    declared = packages.declared_namespaces(repo.package_refs, repo.project_refs, repo.assembly_refs, repo.source["namespaces"])
    forbidden = areas.forbidden_edges(repo.edges(), placed, rules) if rules is not None and placed is not None else None
    return findings.collect_findings(
        t["cycles"], t["orphans"], t["unresolved"], packages.unused_packages(repo.package_refs, repo.source["usings"]),
        packages.undeclared_usings(repo.source["usings"], declared), packages.version_conflicts(repo.package_refs.select("project", "name", "version")), forbidden,
    )


def catalog(repo: Repository) -> DataFrame:
    """``project, fqn, simple, ns`` of all declared types."""
    d = repo.source["declared_types"].select("project", "fqn").distinct()
    return d.select("project", "fqn", names.simple_name(F.col("fqn")).alias("simple"), names.namespace_part(F.col("fqn")).alias("ns"))


def references(repo: Repository) -> DataFrame:
    own = repo.source["namespaces"].unionByName(repo.source["usings"])
    return types.classify_references(repo.source["referenced_types"], catalog(repo).select("project", "simple", "ns").distinct(), own)


def endpoint_tables(repo: Repository) -> dict[str, DataFrame]:
    kind = types.declared_kind(repo.source["declared_types"])
    found = endpoints.classify(repo.source["type_metrics"].join(kind, ["project", "fqn"]), repo.source["methods"])
    offered = endpoints.endpoint_methods(found, repo.source["methods"])
    return {
        "endpoints": found, "endpoint_methods": offered, "endpoint_dtos": endpoints.endpoint_dtos(offered),
        "endpoint_users": endpoints.endpoint_users(found, repo.source["mentions"]),
    }


def atlas(repo: Repository, scanned: bool = True) -> dict[str, DataFrame]:
    """The tables of the atlas; those that need source code if the repository was scanned."""
    given = spec.areas(os.path.join(repo.root, FOLDER, "spec", "areas.yaml"))
    rules = spec.rules(os.path.join(repo.root, FOLDER, "spec", "rules.yaml"))
    named = repo.projects.select("project", "name", "path")
    edges = repo.edges()
    totals = types.project_totals(repo.source["type_metrics"]) if scanned else None
    main = atlas_of(named, edges, totals, given)
    ids = packages.derived_ids(named).select("project", "id")
    out = {
        "atlas": main.join(ids, "project"), "areas": areas.roll_up(main), "external_refs": packages.external_refs(repo.package_refs, repo.assembly_refs),
        "build_deps": build_deps(named, edges), "build_plan": graph.waves(main.select(F.col("project").alias("node"), "layer")),
        "critical_path": graph.critical_path(main.select(F.col("project").alias("node"), "layer"), edges),
        "projects": repo.projects,
    }
    if scanned:
        split = types.split_namespaces(repo.source["type_metrics"].join(types.declared_kind(repo.source["declared_types"], last=True), ["project", "fqn"]), repo.source["namespaces"])
        nodes = main.select(F.col("project").alias("node"), "name", "loc")
        cyclic = main.filter("in_cycle").select(F.col("project").alias("node"))
        placed = main.select("project", "area")
        out |= {
            "metrics": split, "classes": types.grouped_classes(split), "methods": repo.source["methods"], "type_spans": repo.source["type_spans"],
            "source_files": repo.source_files, "references": references(repo), **endpoint_tables(repo),
            "merge_tips": findings.merge_candidates(nodes, edges, cyclic), "cluster_tips": findings.cluster_candidates(nodes, edges, cyclic),
            "checks": check(repo, spec.rules_table(repo.spark, rules) if rules else None, placed),
        }
    return out


def write_atlas(repo: Repository, folder: str | None = None, form: str = "parquet") -> str:
    folder = folder or os.path.join(repo.root, FOLDER, "gen")
    sinks.write_artifacts(atlas(repo), folder, form)
    return folder


def metrics(repo: Repository, top: int = 20, project: str | None = None) -> tuple[DataFrame, DataFrame]:
    name = repo.projects.select("project", "name")
    rows = repo.source["type_metrics"].join(name, "project").drop("project").withColumnRenamed("name", "project")
    methods = repo.source["methods"].withColumnRenamed("name", "method").join(name, "project").drop("project").withColumnRenamed("name", "project").withColumnRenamed("method", "name")
    return types.totals_with_grand(rows), types.top_methods(methods, top, project)


def find_folder(start: str) -> str:
    """The results' folder of the nearest repository at or above ``start``."""
    at = os.path.abspath(start)
    while not os.path.isdir(os.path.join(at, FOLDER, "gen")):
        if at == os.path.dirname(at):
            raise FileNotFoundError(f"no {FOLDER}/gen at or above {start}")
        at = os.path.dirname(at)
    return os.path.join(at, FOLDER, "gen")


class NotFound(LookupError):
    """No project, or not one, is meant by a name."""


def focus(repo: Repository, query: str, up: int = 1, down: int = 1, form: str = "text") -> str:
    asked = repo.spark.createDataFrame([(query,)], "query string")
    got = lookup.resolve_projects(repo.projects, asked).first()
    if got["outcome"] != "found":
        raise NotFound(f"{query}: {got['outcome']} ({got['n']}) {', '.join(got['candidates'])}")
    main = atlas(repo, scanned=False)["atlas"].withColumnRenamed("project", "node")
    at = main.filter(F.col("name") == got["name"]).select("node")
    edges = repo.edges()
    kept = graph.neighbourhood(edges, at, up, down)
    key = at.first()["node"]
    nodes = main.join(kept, "node", "left_semi").withColumnRenamed("node", "key")
    inner = graph.induced(edges, kept)
    if form == "json":
        return sinks.text(_json_lines({"nodes": nodes.select("key", "name", "layer", "area"), "edges": inner}))
    lines = {"dot": sinks.focus_dot, "mermaid": sinks.focus_mermaid}
    return sinks.text(lines[form](nodes, inner, key) if form in lines else sinks.focus_text(nodes, inner, key, up, down))


def look_up(spark: SparkSession, folder: str, queries: list[str], paths: list[str] = ()) -> dict[str, DataFrame]:
    """Types and files by name, from the written tables of an atlas, all names in one plan."""
    t = sinks.read_artifacts(spark, folder, "metrics", "references", "type_spans", "source_files", "endpoints", "methods")
    asked = spark.createDataFrame([(q,) for q in queries], "query string")
    found = lookup.lookup_types(t["metrics"], asked)
    out = {
        "types": found, "callers": lookup.callers(found, t["references"]), "subclasses": lookup.subclasses(t["metrics"], asked),
        "spans": lookup.located(found.select("query", "project", "fqn").join(t["type_spans"], ["project", "fqn"]), t["source_files"]),
        "methods": found.select("query", "project", "fqn").join(t["methods"], ["project", "fqn"]),
        "endpoints": found.select("query", "project", "fqn").join(t["endpoints"], ["project", "fqn"]),
    }
    if paths:
        out["files"] = lookup.lookup_files(t["source_files"], t["type_spans"], spark.createDataFrame([(p,) for p in paths], "query string"))
    return out


def usings(path: str) -> list[str]:
    """The using directives of one file."""
    with open(path, encoding="utf-8") as f:
        return csharp.parse(f.read()).usings


def init(spark: SparkSession, path: str) -> str:
    spec.seed(path, FOLDER)
    return write_atlas(load(spark, path).scan(os.path.join(path, FOLDER, "cache")))


def main(argv: list[str] | None = None) -> int:
    from quarrylib.session import build_session

    p = argparse.ArgumentParser(prog="quarrylib")
    p.add_argument("command", choices=["scan", "graph", "atlas", "metrics", "focus", "lookup", "init", "usings"])
    p.add_argument("path")
    p.add_argument("names", nargs="*")
    p.add_argument("--format", default="text")
    p.add_argument("--packages", action="store_true")
    p.add_argument("--up", type=int, default=1)
    p.add_argument("--down", type=int, default=1)
    p.add_argument("--top", type=int, default=20)
    p.add_argument("--project")
    p.add_argument("--file", action="append", default=[])
    p.add_argument("--output-dir")
    a = p.parse_args(argv)
    if a.command == "usings":
        print("\n".join(usings(a.path)))
        return 0
    spark = build_session()
    if a.command == "lookup":
        folder = a.path if os.path.isdir(os.path.join(a.path, "metrics")) else find_folder(a.path)
        for name, df in look_up(spark, folder, a.names, a.file).items():
            print(name)
            for row in sinks.as_json(df).toLocalIterator():
                print(row["value"])
        return 0
    if a.command == "init":
        print(init(spark, a.path))
        return 0
    repo = load(spark, a.path)
    if a.command == "scan":
        print(sinks.text(sinks.scan_lines(repo.projects, repo.package_refs, repo.project_refs)))
    elif a.command == "graph":
        print(draw_graph(repo, a.format, a.packages))
    elif a.command == "atlas":
        print(write_atlas(repo.scan(), a.output_dir, "json" if a.format == "json" else "parquet"))
    elif a.command == "metrics":
        totals, top = metrics(repo.scan(), a.top, a.project)
        print(sinks.text(sinks.metrics_lines(totals)))
        print(sinks.text(sinks.top_method_lines(top)))
    elif a.command == "focus":
        try:
            print(focus(repo, a.names[0], a.up, a.down, a.format))
        except NotFound as e:
            print(e)
            return 2
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
