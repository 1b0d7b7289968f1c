"""Renderings of graphs, metrics and facts as lines, and results as files.

Renderers give DataFrames of numbered lines, so that what is drawn never has to fit a driver; ``text`` joins
the lines of what a person will read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PACKAGE_STYLE = ', shape=ellipse, style="filled,rounded", fillcolor="#eeeeee"'
FOCUS_STYLE = ', style="filled,rounded", fillcolor="#ffd966"'


def span_text(file_id: Column, first: Column, last: Column) -> Column:
    return F.format_string("f%d:%d-%d", file_id, first, last)


def method_text(name: Column, first: Column, last: Column, loc: Column, complexity: Column, file_id: Column, attributes: Column) -> Column:
    file = F.when(file_id.isNotNull(), F.concat(F.lit(" f="), file_id.cast("string"))).otherwise("")
    attrs = F.when(F.size(attributes) > 0, F.concat(F.lit(" ["), F.array_join(attributes, ", "), F.lit("]"))).otherwise("")
    return F.concat(name, F.format_string(" L%d-%d loc=%d cx=%d", first, last, loc, complexity), file, attrs)


def parse_span(text: Column) -> Column:
    """``file_id, line_start, line_end`` of a span's text, or null."""
    part = lambda i: F.regexp_extract(text, r"^f(\d+):(\d+)-(\d+)$", i).cast("long")
    return F.when(text.rlike(r"^f\d+:\d+-\d+$"), F.struct(*[part(i).alias(n) for i, n in ((1, "file_id"), (2, "line_start"), (3, "line_end"))]))


METHOD = r"^(.*?) L(\d+)-(\d+) loc=(\d+) cx=(\d+)(?: f=(\d+))?(?: \[(.*)\])?$"


def parse_method(text: Column) -> Column:
    """The fields of a method's text, or null; what stands in its attributes can't be taken for a line number."""
    part = lambda i: F.regexp_extract(text, METHOD, i)
    number = lambda i, n: F.nullif(part(i), F.lit("")).cast("long").alias(n)
    return F.when(
        text.rlike(METHOD),
        F.struct(part(1).alias("name"), number(2, "line_start"), number(3, "line_end"), number(4, "loc"), number(5, "complexity"), number(6, "file_id"), part(7).alias("attributes")),
    )


def _numbered(*parts: DataFrame) -> DataFrame:
    """``line`` of parts of ``line, ord`` one after the other."""
    out = None
    for k, p in enumerate(parts):
        p = p.select(F.lit(k).alias("part"), F.col("ord").cast("string").alias("ord"), "line")
        out = p if out is None else out.union(p)
    return out


def _fixed(like: DataFrame, *lines: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(f"{i:04}").alias("ord"), F.lit(x).alias("line")) for i, x in enumerate(lines)])
    return like.sparkSession.range(1, numPartitions=1).select(F.explode(rows).alias("r")).select("r.*")


def text(lines: DataFrame) -> str:
    """The lines in order, for the driver."""
    return "\n".join(r["line"] for r in lines.orderBy("part", "ord").select("line").toLocalIterator()) + "\n"


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a DOT graph of ``nodes(key, label, kind)`` and ``edges(src, dst, kind)``; kinds project and package."""
    style = lambda yes: F.when(F.col("kind") == "package", yes).otherwise("")
    n = nodes.select(F.col("key").alias("ord"), F.concat(F.lit('  "'), "key", F.lit('" [label="'), "label", F.lit('"'), style(PACKAGE_STYLE), F.lit("];")).alias("line"))
    e = edges.select(F.concat_ws(" ", "src", "dst").alias("ord"), F.concat(F.lit('  "'), "src", F.lit('" -> "'), "dst", F.lit('"'), style(" [style=dashed, color=gray]"), F.lit(";")).alias("line"))
    head = _fixed(nodes, "digraph projects {", "  rankdir=LR;", "  node [shape=box, style=rounded];")
    return _numbered(head, n, e, _fixed(nodes, "}"))


def _short(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` with ``n0``, ``n1``... in their order; a drawing is small."""
    return nodes.withColumn("short", F.concat(F.lit("n"), (F.row_number().over(Window.orderBy(*order)) - 1).cast("string")))


def _ends(edges: DataFrame, short: DataFrame) -> DataFrame:
    a = short.select(F.col("key").alias("src"), F.col("short").alias("a"))
    b = short.select(F.col("key").alias("dst"), F.col("short").alias("b"))
    return edges.join(a, "src").join(b, "dst")


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    short = _short(nodes, "key")
    n = short.select(F.lpad(F.substring("short", 2, 12), 12, "0").alias("ord"), F.concat(F.lit("  "), "short", F.lit('["'), "label", F.lit('"]')).alias("line"))
    arrow = F.when(F.col("kind") == "package", " -.-> ").otherwise(" --> ")
    e = _ends(edges, short).select(F.concat_ws(" ", "src", "dst").alias("ord"), F.concat(F.lit("  "), "a", arrow, "b").alias("line"))
    return _numbered(_fixed(nodes, "flowchart LR"), n, e)


def graph_text(nodes: DataFrame, edges: DataFrame, cycles: DataFrame, orphans: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Lines: each project with its sorted targets, then cycles, orphans and unresolved references."""
    label = nodes.select(F.col("key").alias("dst"), "label")
    own = nodes.filter("kind = 'project'").select(F.col("key").alias("ord"), F.concat(F.lit("■ "), "label").alias("line"))
    to = edges.join(label, "dst").select(F.concat_ws("\u0001", "src", "label").alias("ord"), F.concat(F.lit("    → "), "label").alias("line"))
    body = own.union(to)
    name = nodes.select(F.col("key").alias("k"), F.col("label").alias("name"))
    ring = cycles.select("component", F.explode("members").alias("k")).join(name, "k").groupBy("component").agg(F.array_join(F.array_sort(F.collect_list("name")), " → ").alias("r"))
    section = lambda title, df, line: _numbered_section(nodes, title, df.select(line.alias("line")))
    counts = nodes.filter("kind = 'project'").agg(F.count("*").alias("n")).crossJoin(edges.agg(F.count("*").alias("m")))
    head = counts.select(F.lit("0").alias("ord"), F.format_string("Graph: %d project(s), %d edge(s)", "n", "m").alias("line"))
    return _numbered(
        head, body,
        section("Cycles:", ring, F.concat(F.lit("  - "), "r")),
        section("Orphans:", orphans.join(name, orphans["node"] == name["k"]), F.concat(F.lit("  - "), "name")),
        section("Unresolved project refs:", unresolved.join(name, unresolved["src"] == name["k"]), F.concat(F.lit("  - "), "name", F.lit(" → "), "dst")),
    )


def _numbered_section(like: DataFrame, title: str, lines: DataFrame) -> DataFrame:
    rows = lines.select(F.concat(F.lit("1"), "line").alias("ord"), "line")
    head = lines.limit(1).select(F.lit("0").alias("ord"), F.lit(title).alias("line"))
    return head.union(rows)


def focus_dot(nodes: DataFrame, edges: DataFrame, focus: str) -> DataFrame:
    """``nodes(key, name, layer, area)`` around one of them."""
    is_focus = F.col("key") == focus
    n = nodes.select(
        F.concat(F.lpad(F.col("layer").cast("string"), 9, "0"), "name").alias("ord"),
        F.concat(F.lit('  "'), "key", F.lit('" [label="'), "name", F.lit("\\nL"), F.col("layer").cast("string"), F.lit(" · "), "area", F.lit('"'), F.when(is_focus, FOCUS_STYLE).otherwise(""), F.lit("];")).alias("line"),
    )
    e = edges.select(F.concat_ws(" ", "src", "dst").alias("ord"), F.concat(F.lit('  "'), "src", F.lit('" -> "'), "dst", F.lit('";')).alias("line"))
    return _numbered(_fixed(nodes, "digraph focus {", "  rankdir=LR;", "  node [shape=box, style=rounded];"), n, e, _fixed(nodes, "}"))


def focus_mermaid(nodes: DataFrame, edges: DataFrame, focus: str) -> DataFrame:
    short = _short(nodes, "layer", "name", "key")
    mark = F.when(F.col("key") == focus, ":::focus").otherwise("")
    n = short.select(
        F.lpad(F.substring("short", 2, 12), 12, "0").alias("ord"),
        F.concat(F.lit("  "), "short", F.lit('["'), "name", F.lit("<br/>L"), F.col("layer").cast("string"), F.lit(" · "), "area", F.lit('"]'), mark).alias("line"),
    )
    e = _ends(edges, short).select(F.concat_ws(" ", "src", "dst").alias("ord"), F.concat(F.lit("  "), "a", F.lit(" --> "), "b").alias("line"))
    return _numbered(_fixed(nodes, "flowchart LR"), n, e, _fixed(nodes, "  classDef focus fill:#ffd966,stroke:#c08000,stroke-width:2px;"))


def focus_text(nodes: DataFrame, edges: DataFrame, focus: str, up: int, down: int) -> DataFrame:
    """``nodes(key, name, layer, area, fan_in, fan_out)``."""
    one = nodes.filter(F.col("key") == focus)
    head = one.select(F.lit("0").alias("ord"), F.concat(F.lit("focus: "), "name", F.lit("\n  area="), "area", F.format_string("  layer=%d  fan_in=%d  fan_out=%d", "layer", "fan_in", "fan_out")).alias("line"))
    counts = nodes.agg(F.count("*").alias("n")).crossJoin(edges.agg(F.count("*").alias("m")))
    size = counts.select(F.lit("0").alias("ord"), F.concat(F.format_string("\nnodes: %d  edges: %d", "n", "m"), F.lit(f"  (up={up} down={down})")).alias("line"))

    def side(title: str, arrow: str, mine: str, other: str) -> DataFrame:
        found = edges.filter(F.col(mine) == focus).join(nodes, F.col(other) == F.col("key"))
        lines = found.select(F.concat(F.lit("1"), "name").alias("ord"), F.concat(F.lit(f"  {arrow} "), "name", F.lit(" ["), "area", F.lit(" L"), F.col("layer").cast("string"), F.lit("]")).alias("line"))
        top = found.agg(F.count("*").alias("n")).select(F.lit("0").alias("ord"), F.concat(F.lit(f"\n{title} (depth 1, "), F.col("n").cast("string"), F.lit(" shown):")).alias("line"))
        return top.union(lines)

    return _numbered(head, size, side("depended on by", "←", "dst", "src"), side("depends on", "→", "src", "dst"))


def scan_lines(projects: DataFrame, package_refs: DataFrame, project_refs: DataFrame) -> DataFrame:
    """Lines: each project's path, kind and frameworks, its packages (``<cpm>`` without a version) and references."""
    kind = F.when(F.col("sdk_style"), "sdk").otherwise("legacy")
    own = projects.select(F.concat("name", F.lit("\u0001"), "project").alias("ord"), F.concat(F.lit("■ "), "name", F.lit(" ["), kind, F.lit("] "), F.array_join("target_frameworks", ", "), F.lit("\n  path: "), "path").alias("line"))
    name = projects.select("project", "name")
    pk = package_refs.select("project", "ord", F.concat(F.col("name"), F.lit(" "), F.coalesce("version", F.lit("<cpm>"))).alias("x")).join(name, "project")
    refs = project_refs.select("project", "ord", F.col("target_path").alias("x")).join(name, "project")
    line = lambda df, k: df.select(F.concat("name", F.lit("\u0001"), "project", F.lit(k), F.lpad(F.col("ord").cast("string"), 6, "0")).alias("ord"), F.concat(F.lit("    - "), "x").alias("line"))
    return _numbered(own.union(line(pk, "\u0001p")).union(line(refs, "\u0001r")))


def metrics_lines(totals: DataFrame) -> DataFrame:
    """A row for each project, most complex first, and the total of ``totals_with_grand``."""
    numbers = ("types", "loc", "members", "complexity")
    row = F.concat(F.rpad(F.coalesce("project", F.lit("TOTAL")), 40, " "), *[F.lpad(F.col(c).cast("string"), 12, " ") for c in numbers])
    head = F.lit("project".ljust(40) + "".join(c.rjust(12) for c in numbers))
    body = totals.filter("project is not null").select(F.concat(F.lpad((F.lit(10**12) - F.col("complexity")).cast("string"), 13, "0"), "project").alias("ord"), row.alias("line"))
    total = totals.filter("project is null").select(F.lit("0").alias("ord"), row.alias("line"))
    return _numbered(totals.sparkSession.range(1).select(F.lit("0").alias("ord"), head.alias("line")), body, total)


def top_method_lines(top: DataFrame) -> DataFrame:
    """A line for each of ``top_methods``, without the project where all are of one."""
    one = top.agg((F.countDistinct("project") <= 1).alias("one"))
    label = F.concat(F.when(F.col("one"), "").otherwise(F.concat("project", F.lit("::"))), "fqn", F.lit("."), "name")
    order = Window.orderBy(F.desc("complexity"), F.desc("loc"), "project", "fqn", "name", "line_start")  # a few rows
    rows = top.crossJoin(F.broadcast(one)).withColumn("n", F.row_number().over(order))
    line = F.concat(F.lpad(F.col("complexity").cast("string"), 12, " "), F.lpad(F.col("loc").cast("string"), 7, " "), F.lit("  "), label)
    return _numbered(rows.select(F.lpad(F.col("n").cast("string"), 9, "0").alias("ord"), line.alias("line")))


def endpoint_method_json(methods: DataFrame) -> DataFrame:
    """``project, fqn, value``: a method's bare name as JSON, or an object where there is more to say."""
    more = F.col("verb").isNotNull() | F.col("route").isNotNull() | (F.size("dtos") > 0) | (F.size("extras") > 0)
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    whole = F.to_json(F.struct("name", "verb", "route", some("dtos"), some("extras")))
    return methods.select("project", "fqn", F.when(more, whole).otherwise(F.concat(F.lit('"'), "name", F.lit('"'))).alias("value"))


def finding_lines(findings: DataFrame) -> DataFrame:
    return findings.select(F.col("severity").alias("ord"), F.concat(F.lit("["), "severity", F.lit("] "), "kind", F.lit(": "), F.concat_ws(" ", "project", F.nullif("detail", F.lit("")))).alias("line"))


def without_empty(df: DataFrame) -> DataFrame:
    """Empty arrays and maps as nulls, which JSON leaves out."""
    empty = {f.name: F.when(F.size(f.name) > 0, F.col(f.name)) for f in df.schema.fields if f.dataType.typeName() in ("array", "map")}
    return df.withColumns(empty) if empty else df


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text for each row, without nulls and empty collections."""
    return without_empty(df).select(F.to_json(F.struct("*")).alias("value"))


def write_artifacts(tables: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """Each table in a folder of its own, as ``parquet`` or ``json``; those of an earlier run are replaced."""
    for name, df in tables.items():
        (without_empty(df) if form == "json" else df).write.mode("overwrite").format(form).save(f"{folder}/{name}")


def read_artifacts(spark, folder: str, *names: str) -> dict[str, DataFrame]:
    """The tables that were written; those that weren't are left out."""
    from pyspark.errors import AnalysisException

    out = {}
    for name in names:
        try:
            out[name] = spark.read.parquet(f"{folder}/{name}")
        except AnalysisException:
            continue
    return out
