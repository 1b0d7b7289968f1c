"""The registered queries: each operator over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylib.functions import names, paths
from quarrylib.operators import areas, atlas, endpoints, findings, graph, lookup, packages, types

from . import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[T.Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(T.Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def with_(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


def joined(c: str | Column) -> Column:
    """An array as text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# ---------------------------------------------------------------- graph


@query(with_(T.DAG) + """SELECT p_partkey AS node, coalesce(i.n, 0)::BIGINT AS fan_in, coalesce(o.n, 0)::BIGINT AS fan_out FROM part
  LEFT JOIN (SELECT dst, count(*) n FROM dag GROUP BY dst) i ON i.dst = p_partkey LEFT JOIN (SELECT src, count(*) n FROM dag GROUP BY src) o ON o.src = p_partkey""")
def fan_in_out(t: T.Tables) -> DataFrame:
    return graph.degrees(t.nodes(), t.dag())


@query(with_(T.DAG) + "SELECT (SELECT count(*) FROM part)::BIGINT AS nodes, (SELECT count(*) FROM dag)::BIGINT AS edges")
def edge_count(t: T.Tables) -> DataFrame:
    return graph.edge_count(t.nodes(), t.dag())


@query(with_(T.CYC) + "SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT src FROM cyc) AND p_partkey NOT IN (SELECT dst FROM cyc)")
def orphans(t: T.Tables) -> DataFrame:
    return graph.orphans(t.nodes(), t.cyc())


@query(with_(T.DAG) + "SELECT src, dst FROM dag LEFT JOIN part ON p_partkey = dst AND p_size < 40 WHERE p_partkey IS NULL")
def unresolved_refs(t: T.Tables) -> DataFrame:
    known = t.read("part").filter("p_size < 40").select(F.col("p_partkey").alias("node"))
    return graph.link(known, t.dag().withColumnRenamed("dst", "target")).filter("not resolved").select("src", "dst")


@query(with_(T.DAG) + "SELECT src, dst FROM dag JOIN part ON p_partkey = dst AND p_size < 40")
def resolved_edges(t: T.Tables) -> DataFrame:
    known = t.read("part").filter("p_size < 40").select(F.col("p_partkey").alias("node"))
    return graph.link(known, t.dag().withColumnRenamed("dst", "target")).filter("resolved").select("src", "dst")


@query(with_(T.DAG, T.REACH.format(e="dag"), recursive=True) + "SELECT src, dst FROM reach")
def transitive_closure(t: T.Tables) -> DataFrame:
    return graph.closure(t.dag())


@query(with_(T.CYC, T.REACH.format(e="cyc"), recursive=True) + "SELECT src, dst FROM reach")
def closure_with_cycles(t: T.Tables) -> DataFrame:
    return graph.closure(t.cyc())


@query(with_(T.DAG, T.REACH.format(e="dag"), recursive=True) + "SELECT p_partkey AS node, p_partkey AS rebuild FROM part UNION SELECT dst, src FROM reach")
def rebuild_on_change(t: T.Tables) -> DataFrame:
    return graph.dependents(t.nodes(), t.dag())


@query(with_(T.DAG, T.REACH.format(e="dag"), recursive=True) + "SELECT p_partkey AS node, (1 + count(src))::BIGINT AS n FROM part LEFT JOIN reach ON dst = p_partkey GROUP BY p_partkey")
def dependents_count(t: T.Tables) -> DataFrame:
    return graph.dependents(t.nodes(), t.dag()).groupBy("node").agg(F.count("*").alias("n"))


@query(with_(T.CYC, T.REACH.format(e="cyc"), T.SCC, recursive=True) + """SELECT component, count(*)::BIGINT AS size, string_agg(node::VARCHAR, ',' ORDER BY node) AS members
  FROM scc WHERE cyclic GROUP BY component""")
def scc_cycles(t: T.Tables) -> DataFrame:
    return graph.cycles(t.cyc()).select("component", "size", joined("members").alias("members"))


@query(with_(T.CYC, T.REACH.format(e="cyc"), T.SCC, recursive=True) + "SELECT node, cyclic AS in_cycle FROM scc")
def in_cycle(t: T.Tables) -> DataFrame:
    on = graph.strong_components(t.cyc()).select("node", F.lit(True).alias("hit"))
    return t.nodes().join(on, "node", "left").select("node", F.coalesce("hit", F.lit(False)).alias("in_cycle"))


@query(with_(T.CYC) + "SELECT src AS node FROM cyc WHERE src = dst")
def self_loops(t: T.Tables) -> DataFrame:
    return t.cyc().filter("src = dst").select(F.col("src").alias("node"))


@query(with_(T.DAG, T.DAGLAY, recursive=True) + "SELECT node, layer FROM lay")
def layers_dag(t: T.Tables) -> DataFrame:
    return graph.layers(t.nodes(), t.dag())


@query(with_(T.CYC, T.REACH.format(e="cyc"), T.SCC, T.COND, recursive=True) + "SELECT node, layer FROM lay")
def layers_condensed(t: T.Tables) -> DataFrame:
    return graph.layers(t.nodes(), t.cyc())


@query(with_(T.DAG, T.DAGLAY, recursive=True) + "SELECT layer AS wave, count(*)::BIGINT AS size, string_agg(node::VARCHAR, ',' ORDER BY node) AS members FROM lay GROUP BY layer")
def build_waves(t: T.Tables) -> DataFrame:
    return graph.waves(graph.layers(t.nodes(), t.dag())).select("wave", "size", joined("members").alias("members"))


@query(with_(T.DAG, T.DAGLAY, recursive=True) + "SELECT count(*)::BIGINT AS total, count(DISTINCT layer)::BIGINT AS wave_count FROM lay")
def wave_sizes(t: T.Tables) -> DataFrame:
    return graph.layers(t.nodes(), t.dag()).agg(F.count("*").alias("total"), F.countDistinct("layer").alias("wave_count"))


@query(with_(T.DAG, T.DAGLAY, """tight AS (SELECT src, min(dst) AS dst FROM dag JOIN lay a ON a.node = src JOIN lay b ON b.node = dst WHERE b.layer = a.layer - 1 GROUP BY src)""",
  """walk(node, back) AS (SELECT min(node), 0 FROM lay WHERE layer = (SELECT max(layer) FROM lay) UNION ALL SELECT dst, back + 1 FROM walk JOIN tight ON src = node)""", recursive=True)
  + "SELECT ((SELECT max(back) FROM walk) - back)::BIGINT AS step, node FROM walk")
def critical_path(t: T.Tables) -> DataFrame:
    nodes, dag = t.nodes(), t.dag()
    return graph.critical_path(graph.layers(nodes, dag), dag)


EGO = T.DAG, """top AS (SELECT dst AS node FROM dag GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)""", """down AS (SELECT dag.dst AS node FROM dag JOIN top ON src = node),
up1 AS (SELECT src AS node FROM dag JOIN top ON dst = node), kept0 AS (SELECT node FROM top UNION SELECT node FROM down), fresh AS (SELECT node FROM up1 EXCEPT SELECT node FROM kept0),
up2 AS (SELECT src AS node FROM dag JOIN fresh ON dst = node), kept AS (SELECT node FROM kept0 UNION SELECT node FROM up1 UNION SELECT node FROM up2)"""


def _hub(t: T.Tables) -> DataFrame:
    return t.dag().groupBy(F.col("dst").alias("node")).count().orderBy(F.desc("count"), "node").limit(1).select("node")


@query(with_(*EGO) + "SELECT node FROM kept")
def ego_network(t: T.Tables) -> DataFrame:
    return graph.neighbourhood(t.dag(), _hub(t), up=2, down=1)


@query(with_(*EGO) + "SELECT src, dst FROM dag WHERE src IN (SELECT node FROM kept) AND dst IN (SELECT node FROM kept)")
def focus_edges(t: T.Tables) -> DataFrame:
    return graph.induced(t.dag(), graph.neighbourhood(t.dag(), _hub(t), up=2, down=1))


ATLAS_CTE = (T.PROJ, T.CYC, T.REACH.format(e="cyc"), T.SCC, T.COND, """deg AS (SELECT project AS node, (SELECT count(*) FROM cyc WHERE dst = project)::BIGINT AS fan_in,
  (SELECT count(*) FROM cyc WHERE src = project)::BIGINT AS fan_out FROM proj)""")


@query(with_(*ATLAS_CTE, recursive=True) + f"""SELECT project, name, path, brand AS area, fan_in, fan_out, layer, cyclic AS in_cycle,
  fan_in = 0 AND fan_out >= 3 AND NOT {T.TESTLIKE.format('name')} AS is_root, loc,
  coalesce((SELECT string_agg(dst::VARCHAR, ',' ORDER BY dst) FROM cyc WHERE src = project), '') AS deps
  FROM proj JOIN deg ON deg.node = project JOIN lay ON lay.node = project JOIN scc ON scc.node = project""")
def atlas_projects(t: T.Tables) -> DataFrame:
    out = atlas.atlas(t.projects().select("project", "name", "path"), t.cyc(), t.projects().select("project", "loc"))
    return out.withColumn("deps", joined("deps"))


@query(with_(T.PROJ, T.DAG) + f"""SELECT project, name FROM proj WHERE NOT EXISTS (SELECT 1 FROM dag WHERE dst = project) AND (SELECT count(*) FROM dag WHERE src = project) >= 3
  AND NOT {T.TESTLIKE.format('name')}""")
def composition_roots(t: T.Tables) -> DataFrame:
    p = t.projects()
    degree = graph.degrees(p.select(F.col("project").alias("node")), t.dag()).withColumnRenamed("node", "project").join(p, "project")
    return graph.composition_roots(degree, names.is_test_like(F.col("name"))).select("project", "name")


@query(with_(T.PROJ) + f"SELECT project, {T.TESTLIKE.format('name')} AS test_like FROM proj")
def test_like_names(t: T.Tables) -> DataFrame:
    return t.projects().select("project", names.is_test_like(F.col("name")).alias("test_like"))


@query(with_(T.DAG, T.DAGLAY, T.REACH.format(e="dag"), "again AS (SELECT p_partkey AS node, p_partkey AS rebuild FROM part UNION SELECT dst, src FROM reach)", recursive=True)
  + """SELECT l.node AS project, l.layer AS wave, coalesce((SELECT string_agg(dst::VARCHAR, ',' ORDER BY dst) FROM dag WHERE src = l.node), '') AS deps,
  coalesce((SELECT string_agg(src::VARCHAR, ',' ORDER BY src) FROM dag WHERE dst = l.node), '') AS dependents,
  (SELECT string_agg(rebuild::VARCHAR, ',' ORDER BY r.layer, rebuild) FROM again a JOIN lay r ON r.node = a.rebuild WHERE a.node = l.node) AS rebuild FROM lay l""")
def build_deps(t: T.Tables) -> DataFrame:
    out = atlas.build_deps(t.projects(), t.dag())
    return out.select("project", "wave", *[joined(c).alias(c) for c in ("deps", "dependents", "rebuild")])


# ---------------------------------------------------------------- tips


@query(with_(T.PROJ, T.DAG) + f"""SELECT d.dst AS project, d.src AS "into", 'single consumer' AS reason, 'high' AS confidence, p.loc
  FROM (SELECT dst, min(src) AS src FROM dag GROUP BY dst HAVING count(*) = 1) d JOIN proj p ON p.project = d.dst JOIN proj q ON q.project = d.src
  WHERE NOT {T.TESTLIKE.format('p.name')} AND NOT {T.TESTLIKE.format('q.name')}""")
def merge_candidates(t: T.Tables) -> DataFrame:
    nodes = t.projects().select(F.col("project").alias("node"), "name", "loc")
    return findings.merge_candidates(nodes, t.dag(), graph.strong_components(t.dag()))


@query(with_(T.PROJ, T.DAG) + f"""SELECT consumers, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS members, count(*)::BIGINT AS size, sum(loc)::BIGINT AS loc,
  CASE WHEN count(*) >= 3 THEN 'high' ELSE 'medium' END AS confidence
  FROM (SELECT dst, string_agg(src::VARCHAR, ',' ORDER BY src) AS consumers FROM dag GROUP BY dst) JOIN proj ON project = dst WHERE NOT {T.TESTLIKE.format('name')}
  GROUP BY consumers HAVING count(*) >= 2""")
def cluster_candidates(t: T.Tables) -> DataFrame:
    nodes = t.projects().select(F.col("project").alias("node"), "name", "loc")
    out = findings.cluster_candidates(nodes, t.dag(), graph.strong_components(t.dag()))
    return out.select(joined("consumers").alias("consumers"), joined("members").alias("members"), "size", "loc", "confidence")


# ---------------------------------------------------------------- areas


@query(with_(T.PROJ) + "SELECT brand AS area, count(*)::BIGINT AS size, string_agg(project::VARCHAR, ',' ORDER BY project) AS members, 'src/' || brand AS root FROM proj GROUP BY brand")
def area_rollup(t: T.Tables) -> DataFrame:
    return areas.roll_up(areas.with_areas(t.projects())).withColumn("members", joined("members"))


PATHS = """paths AS (SELECT p_partkey AS project, CASE p_partkey % 5 WHEN 0 THEN 'Source/' || p_brand || '/a/x.csproj' WHEN 1 THEN 'x' || p_partkey || '.csproj'
  WHEN 2 THEN '/else/where/x.csproj' WHEN 3 THEN 'SRC/x.csproj' ELSE 'lib/' || p_brand || '/x.csproj' END AS path, p_brand FROM part)"""


@query(with_(PATHS) + "SELECT project, CASE project % 5 WHEN 0 THEN p_brand WHEN 1 THEN 'root' WHEN 2 THEN 'unmapped' WHEN 3 THEN 'root' ELSE 'lib' END AS area FROM paths")
def area_derivation(t: T.Tables) -> DataFrame:
    m = F.col("p_partkey") % 5
    path = (
        F.when(m == 0, F.concat(F.lit("Source/"), "p_brand", F.lit("/a/x.csproj"))).when(m == 1, F.concat(F.lit("x"), F.col("p_partkey").cast("string"), F.lit(".csproj")))
        .when(m == 2, "/else/where/x.csproj").when(m == 3, "SRC/x.csproj").otherwise(F.concat(F.lit("lib/"), "p_brand", F.lit("/x.csproj")))
    )
    return t.read("part").select(F.col("p_partkey").alias("project"), paths.area(path).alias("area"))


SPEC = {"Core": ["src/Brand#1", "src/Brand#2*"], "Edge": ["src/Brand#2", "src/Brand#{3,4}/1*", "gone/*"], "Rest": ["src/*[05].csproj"]}


@query(with_(T.PROJ) + """SELECT project, CASE WHEN brand = 'Brand#1' THEN 'Core' WHEN brand = 'Brand#2' THEN 'Core' WHEN brand LIKE 'Brand#2%' THEN 'Core'
  WHEN brand IN ('Brand#3', 'Brand#4') AND project::VARCHAR LIKE '1%' THEN 'Edge' WHEN project % 5 = 0 THEN 'Rest' ELSE brand END AS area FROM proj""")
def area_override(t: T.Tables) -> DataFrame:
    return areas.with_areas(t.projects(), SPEC).select("project", "area")


@query(with_(T.PROJ) + "SELECT project, 'Core,Edge' AS areas FROM proj WHERE brand = 'Brand#2'")
def area_ties(t: T.Tables) -> DataFrame:
    return areas.tied(areas.matched_entries(t.projects(), SPEC)[0]).select("project", joined("areas").alias("areas"))


RULES = [("Brand#1", ["Brand#2", "Brand#3"], None, 0), ("Brand#2", [], None, 1), ("Brand#3", None, ["Brand#1", "Brand#4"], 2), ("Brand#4", ["Brand#5"], ["Brand#5"], 3), ("Brand#1", None, ["Brand#2"], 4), ("Ghost", ["Brand#9", "Nowhere"], None, 5)]


@query(with_(T.PROJ, T.DAG, "e AS (SELECT src, a.brand AS x, dst, b.brand AS y FROM dag JOIN proj a ON a.project = src JOIN proj b ON b.project = dst WHERE a.brand <> b.brand)") + """
  SELECT src, x AS src_area, dst, y AS dst_area, reason FROM (SELECT *, CASE WHEN x = 'Brand#1' AND y NOT IN ('Brand#2', 'Brand#3') THEN 'area `Brand#1` may only depend on: Brand#2, Brand#3'
  WHEN x = 'Brand#2' THEN 'area `Brand#2` is isolated (allow: [])' WHEN x = 'Brand#3' AND y IN ('Brand#1', 'Brand#4') THEN 'area `Brand#3` denies `' || y || '`'
  WHEN x = 'Brand#4' THEN CASE WHEN y <> 'Brand#5' THEN 'area `Brand#4` may only depend on: Brand#5' ELSE 'area `Brand#4` denies `Brand#5`' END END AS reason FROM e) WHERE reason IS NOT NULL""")
def forbidden_area_edges(t: T.Tables) -> DataFrame:
    rules = t.spark.createDataFrame(RULES, "area string, allow array<string>, deny array<string>, ord long")
    return areas.forbidden_edges(t.dag(), areas.with_areas(t.projects()), rules)


@query("""SELECT * FROM (VALUES ('Ghost', 'Ghost'), ('Ghost', 'Nowhere'), ('Brand#1', 'Brand#1'), ('Brand#1', 'Brand#2'), ('Brand#1', 'Brand#3'), ('Brand#2', 'Brand#2'), ('Brand#3', 'Brand#3'),
  ('Brand#3', 'Brand#1'), ('Brand#3', 'Brand#4'), ('Brand#4', 'Brand#4'), ('Brand#4', 'Brand#5'), ('Ghost', 'Brand#9')) r(rule_area, named) WHERE named NOT IN (SELECT p_brand FROM part)""")
def unknown_areas(t: T.Tables) -> DataFrame:
    rules = t.spark.createDataFrame(RULES, "area string, allow array<string>, deny array<string>, ord long")
    return areas.unknown_areas(rules, areas.with_areas(t.projects()))


# ---------------------------------------------------------------- names and ids

VOTE = """vote AS (SELECT n, array_to_string(string_split(name, '.')[1:n], '.') || '.' AS prefix FROM proj, (VALUES (3), (2)) s(n) WHERE len(string_split(name, '.')) > n),
best AS (SELECT n, prefix, count(*) AS votes, row_number() OVER (PARTITION BY n ORDER BY count(*) DESC, prefix) AS r FROM vote GROUP BY n, prefix),
good AS (SELECT n, prefix FROM best WHERE r = 1 AND votes * 2 >= (SELECT count(*) FROM proj) AND (SELECT count(*) FROM proj) >= 6),
clear AS (SELECT n, prefix FROM good WHERE NOT EXISTS (SELECT 1 FROM proj a JOIN proj b ON starts_with(a.name, good.prefix) AND length(a.name) > length(good.prefix)
  AND b.name = substr(a.name, length(good.prefix) + 1) AND NOT starts_with(b.name, good.prefix))),
strip AS (SELECT prefix FROM clear ORDER BY n DESC LIMIT 1)"""


@query(with_(T.PROJ, VOTE) + "SELECT prefix FROM strip")
def strip_prefix_vote(t: T.Tables) -> DataFrame:
    return packages.strip_prefix(t.projects())


@query(with_(T.PROJ, VOTE, """short AS (SELECT project, name, CASE WHEN p IS NOT NULL AND starts_with(name, p) AND length(name) > length(p) THEN substr(name, length(p) + 1) ELSE name END AS s
  FROM proj, (SELECT max(prefix) AS p FROM strip)), num AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY project) AS r FROM short)""")
  + "SELECT project, name, CASE WHEN r = 1 THEN s ELSE s || '#' || r END AS id FROM num")
def unique_ids(t: T.Tables) -> DataFrame:
    return packages.derived_ids(t.projects())


# ---------------------------------------------------------------- packages


@query(with_(T.PKG) + """SELECT name, string_agg(DISTINCT version, ',' ORDER BY version) AS versions, string_agg(project || '=' || version, ',' ORDER BY project, version) AS entries
  FROM (SELECT DISTINCT project, name, version FROM pkg) GROUP BY name HAVING count(DISTINCT version) > 1""")
def version_conflicts(t: T.Tables) -> DataFrame:
    refs = t.package_refs().select("project", "name", "version").distinct()
    entry = F.transform("entries", lambda e: F.concat_ws("=", e["project"].cast("string"), e["version"]))
    return packages.version_conflicts(refs).select("name", joined("versions").alias("versions"), joined(entry).alias("entries"))


@query(with_(T.PKG, "raw AS (SELECT DISTINCT project, name, nullif(version, 'N') AS version FROM pkg)")
  + "SELECT project, name, coalesce(version, CASE WHEN p_size % 2 = 0 THEN p_brand END) AS version FROM raw LEFT JOIN part ON p_partkey::VARCHAR = name")
def cpm_versions(t: T.Tables) -> DataFrame:
    refs = t.package_refs().select("project", "name", F.nullif("version", F.lit("N")).alias("version")).distinct()
    part = t.read("part").select(F.concat(F.when(F.col("p_size") % 2 == 0, "").otherwise("no "), F.col("p_partkey").cast("string")).alias("name"), F.col("p_brand").alias("version"))
    central = refs.select("project", "name").distinct().join(part, "name")
    return packages.with_central_versions(refs, central)


NEAREST = """files AS (SELECT * FROM (VALUES ('', 'A', 'root'), ('src', 'A', 'src1'), ('src', 'B', 'src2'), ('src/Brand#1', 'A', 'one'), ('src/Brand#10', 'C', 'ten')) f(dir, name, version))"""


@query(with_(T.PROJ, NEAREST, """near AS (SELECT project, arg_max(dir, length(dir)) AS dir FROM proj JOIN (SELECT DISTINCT dir FROM files) ON dir = '' OR starts_with(path, dir || '/') GROUP BY project)""")
  + "SELECT project, name, version FROM near JOIN files USING (dir)")
def nearest_central_versions(t: T.Tables) -> DataFrame:
    rows = [("", "A", "old", 0), ("", "A", "root", 1), ("src", "A", "src1", 0), ("src", "B", "src2", 1), ("src/Brand#1", "A", "one", 0), ("src/Brand#10", "C", "ten", 0)]
    central = t.spark.createDataFrame(rows, "props_dir string, name string, version string, ord long")
    return packages.nearest_central(t.projects(), central)


@query(with_(T.PKG, "asm AS (SELECT DISTINCT l_suppkey AS project, l_partkey::VARCHAR || ', Version=' || l_returnflag AS raw FROM lineitem)")
  + "SELECT project, name, version FROM pkg UNION SELECT project, string_split(raw, ',')[1], NULL FROM asm")
def external_refs(t: T.Tables) -> DataFrame:
    raw = F.concat(F.col("l_partkey").cast("string"), F.lit(", Version="), "l_returnflag")
    asm = t.read("lineitem").select(F.col("l_suppkey").alias("project"), raw.alias("raw_include"))
    return packages.external_refs(t.package_refs(), asm)


ASM = """asm AS (SELECT DISTINCT l_partkey AS project, (CASE WHEN l_suppkey % 2 = 0 THEN upper('p' || l_suppkey * 37) ELSE 'p' || l_suppkey * 37 END) || ', Version=1.0' AS raw FROM lineitem),
sib AS (SELECT p_partkey AS project, 'P' || p_partkey AS name FROM part)"""


def _assemblies(t: T.Tables) -> tuple[DataFrame, DataFrame]:
    name = F.concat(F.lit("p"), (F.col("l_suppkey") * 37).cast("string"))  # some beyond the parts
    raw = F.concat(F.when(F.col("l_suppkey") % 2 == 0, F.upper(name)).otherwise(name), F.lit(", Version=1.0"))
    asm = t.read("lineitem").select(F.col("l_partkey").alias("project"), raw.alias("raw_include")).distinct()
    sib = t.read("part").select(F.col("p_partkey").alias("project"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("name"))
    return sib, asm


@query(with_(ASM) + "SELECT DISTINCT a.project, s.project AS target FROM asm a JOIN sib s ON lower(string_split(a.raw, ',')[1]) = lower(s.name) WHERE a.project <> s.project")
def assembly_promotion(t: T.Tables) -> DataFrame:
    return packages.promote_assemblies(*_assemblies(t))[0]


@query(with_(ASM) + "SELECT a.project, a.raw AS raw_include FROM asm a LEFT JOIN sib s ON lower(string_split(a.raw, ',')[1]) = lower(s.name) AND a.project <> s.project WHERE s.project IS NULL")
def external_assemblies(t: T.Tables) -> DataFrame:
    return packages.promote_assemblies(*_assemblies(t))[1]


PACKS = """packs AS (SELECT DISTINCT user_id AS project, CASE event_id % 6 WHEN 0 THEN 'click' WHEN 1 THEN 'Serilog.AspNetCore' WHEN 2 THEN 'System.Memory' WHEN 3 THEN 'StyleCop.Analyzers'
  WHEN 4 THEN event_type || '.K1' ELSE 'xunit' END AS name, CASE WHEN event_id % 7 = 0 THEN 'All' END AS private_assets FROM events)"""


def _packs(t: T.Tables) -> DataFrame:
    m = F.col("event_id") % 6
    name = F.when(m == 0, "click").when(m == 1, "Serilog.AspNetCore").when(m == 2, "System.Memory").when(m == 3, "StyleCop.Analyzers").when(m == 4, F.concat("event_type", F.lit(".K1"))).otherwise("xunit")
    return t.read("events").select(F.col("user_id").alias("project"), name.alias("name"), F.when(F.col("event_id") % 7 == 0, "All").alias("private_assets")).distinct()


@query(with_(T.USE, PACKS) + """SELECT DISTINCT project, name FROM packs p WHERE coalesce(lower(private_assets), '') <> 'all' AND name NOT IN ('System.Memory', 'StyleCop.Analyzers')
  AND EXISTS (SELECT 1 FROM use u WHERE u.project = p.project) AND NOT EXISTS (SELECT 1 FROM use u, (SELECT CASE p.name WHEN 'Serilog.AspNetCore' THEN 'Serilog' WHEN 'xunit' THEN 'Xunit' ELSE p.name END AS ns) k
  WHERE u.project = p.project AND (u.ns = k.ns OR starts_with(u.ns, k.ns || '.')))""")
def unused_packages(t: T.Tables) -> DataFrame:
    return packages.unused_packages(_packs(t), t.usings())


@query(with_(T.USE, T.DECL) + """SELECT project, ns FROM use u WHERE NOT EXISTS (SELECT 1 FROM decl d WHERE d.project = u.project AND (u.ns = d.prefix OR starts_with(u.ns, d.prefix || '.')))
  AND NOT (ns = 'System' OR starts_with(ns, 'System.'))""")
def undeclared_usages(t: T.Tables) -> DataFrame:
    return packages.undeclared_usings(t.usings(), t.declared())


@query(with_(PACKS) + "SELECT DISTINCT name, private_assets, coalesce(lower(private_assets), '') = 'all' OR name IN ('System.Memory', 'StyleCop.Analyzers') AS tool FROM packs")
def tool_packages(t: T.Tables) -> DataFrame:
    rows = _packs(t).select("name", "private_assets").distinct()
    return rows.withColumn("tool", names.is_tool_package(F.col("name"), F.col("private_assets")))


@query(with_(PACKS) + "SELECT DISTINCT name, CASE name WHEN 'Serilog.AspNetCore' THEN 'Serilog' WHEN 'xunit' THEN 'Xunit' ELSE name END AS ns FROM packs")
def package_namespaces(t: T.Tables) -> DataFrame:
    return _packs(t).select("name", names.package_namespace(F.col("name")).alias("ns")).distinct()


@query("""SELECT p_partkey AS node, ns, ns IN ('System', 'Windows', 'Microsoft.Win32.Safe', 'System.IO') AS builtin FROM (SELECT p_partkey,
  (['System', 'Systemic.X', 'Windows', 'Microsoft.Win32.Safe', 'Microsoft.Win', 'System.IO'])[p_partkey % 6 + 1] AS ns FROM part)""")
def builtin_namespaces(t: T.Tables) -> DataFrame:
    ns = F.get(F.array(*[F.lit(x) for x in ("System", "Systemic.X", "Windows", "Microsoft.Win32.Safe", "Microsoft.Win", "System.IO")]), (F.col("p_partkey") % 6).cast("int"))
    return t.read("part").select(F.col("p_partkey").alias("node"), ns.alias("ns")).withColumn("builtin", names.is_builtin(F.col("ns")))


# ---------------------------------------------------------------- references and types

CLASSIFY = """seen AS (SELECT r.project, r.simple, c.project AS target FROM refd r LEFT JOIN catalog c USING (simple)),
classed AS (SELECT project, simple, count(DISTINCT target)::BIGINT AS n, CASE WHEN bool_or(coalesce(target = project, false)) THEN 'self' WHEN count(DISTINCT target) = 0 THEN 'external'
  WHEN count(DISTINCT target) = 1 THEN 'resolved' ELSE 'ambiguous' END AS class, coalesce(string_agg(DISTINCT target, ',' ORDER BY target), '') AS targets FROM seen GROUP BY project, simple)"""


@query(with_(T.CATALOG, T.REFD, CLASSIFY) + "SELECT * FROM classed")
def references_classify(t: T.Tables) -> DataFrame:
    return types.classify_references(t.referenced(), t.catalog()).withColumn("targets", joined("targets"))


@query(with_(T.CATALOG, T.REFD, CLASSIFY) + 'SELECT project, class, count(*)::BIGINT AS n FROM classed GROUP BY project, class')
def references_summary(t: T.Tables) -> DataFrame:
    return types.classify_references(t.referenced(), t.catalog()).groupBy("project", "class").agg(F.count("*").alias("n"))


VIS = "vis AS (SELECT DISTINCT project, CASE WHEN length(simple) % 3 = 0 THEN '' ELSE 'N' || length(simple) % 3 || '.M' END AS ns, simple FROM catalog), shown AS (SELECT DISTINCT p_brand AS project, CASE WHEN p_size < 8 THEN 'N' || p_size % 3 || '.M' || (CASE WHEN p_size % 2 = 0 THEN '.X' ELSE '' END) ELSE 'Far' END AS ns FROM part)"


@query(with_(T.CATALOG, T.REFD, VIS, """seen AS (SELECT r.project, r.simple, v.project AS target FROM refd r LEFT JOIN vis v ON v.simple = r.simple AND (v.ns = '' OR v.project = r.project
  OR EXISTS (SELECT 1 FROM shown s WHERE s.project = r.project AND (s.ns = v.ns OR starts_with(s.ns, v.ns || '.')))))""")
  + """SELECT project, simple, count(DISTINCT target)::BIGINT AS n, CASE WHEN bool_or(coalesce(target = project, false)) THEN 'self' WHEN count(DISTINCT target) = 0 THEN 'external'
  WHEN count(DISTINCT target) = 1 THEN 'resolved' ELSE 'ambiguous' END AS class, coalesce(string_agg(DISTINCT target, ',' ORDER BY target), '') AS targets FROM seen GROUP BY project, simple""")
def references_visible(t: T.Tables) -> DataFrame:
    k = F.length("simple") % 3
    owners = t.catalog().withColumn("ns", F.when(k == 0, "").otherwise(F.concat(F.lit("N"), k.cast("string"), F.lit(".M"))))
    ns = F.concat(F.lit("N"), (F.col("p_size") % 3).cast("string"), F.lit(".M"), F.when(F.col("p_size") % 2 == 0, ".X").otherwise(""))
    uses = t.read("part").select(F.col("p_brand").alias("project"), F.when(F.col("p_size") < 8, ns).otherwise("Far").alias("ns")).distinct()
    return types.classify_references(t.referenced(), owners, uses).withColumn("targets", joined("targets"))


TOTALS = "count(*)::BIGINT AS types, sum(l_quantity::BIGINT)::BIGINT AS loc, count(*)::BIGINT AS members, sum(l_linenumber)::BIGINT AS complexity FROM lineitem"


@query(f"SELECT 'S' || l_suppkey AS project, {TOTALS} GROUP BY l_suppkey")
def project_totals(t: T.Tables) -> DataFrame:
    return types.project_totals(t.types())


@query(f"SELECT project, {TOTALS.replace('FROM lineitem', '')} FROM (SELECT *, 'S' || l_suppkey AS project FROM lineitem) GROUP BY ROLLUP (project)")
def metrics_rollup(t: T.Tables) -> DataFrame:
    return types.totals_with_grand(t.types())


METHODS = "(SELECT 'S' || l_suppkey AS project, 'O' || l_orderkey AS fqn, 'M' || l_partkey AS name, l_linenumber::BIGINT AS line_start, l_quantity::BIGINT AS loc, l_linenumber::BIGINT AS complexity FROM lineitem)"


@query(f"SELECT * FROM {METHODS} ORDER BY complexity DESC, loc DESC, project, fqn, name, line_start LIMIT 20")
def top_methods(t: T.Tables) -> DataFrame:
    return types.top_methods(t.methods())


@query(f"SELECT * FROM {METHODS} WHERE contains(project, 'S1') ORDER BY complexity DESC, loc DESC, project, fqn, name, line_start LIMIT 35")
def top_methods_filtered(t: T.Tables) -> DataFrame:
    return types.top_methods(t.methods(), 35, "S1")


@query("""WITH p AS (SELECT l_returnflag AS project, 'O' || l_orderkey AS fqn, l_linenumber AS f, concat_ws('_', l_partkey, l_suppkey) AS pos, l_quantity::BIGINT AS loc, l_linenumber AS complexity,
  'B' || l_partkey % 4 AS base, l_linestatus AS attr, 'R' || l_suppkey % 9 AS ref FROM lineitem),
first_base AS (SELECT project, fqn, string_agg(base, ',' ORDER BY k, base) AS bases FROM (SELECT project, fqn, base, min({f: f, pos: pos}) AS k FROM p GROUP BY project, fqn, base) GROUP BY project, fqn),
first_attr AS (SELECT project, fqn, string_agg(attr, ',' ORDER BY k, attr) AS attributes FROM (SELECT project, fqn, attr, min({f: f, pos: pos}) AS k FROM p GROUP BY project, fqn, attr) GROUP BY project, fqn)
SELECT p.project, p.fqn, count(*)::BIGINT AS parts, sum(loc)::BIGINT AS loc, count(*)::BIGINT AS members, sum(complexity)::BIGINT AS complexity, string_agg(DISTINCT ref, ',' ORDER BY ref) AS referenced_types,
  any_value(bases) AS bases, any_value(attributes) AS attributes FROM p JOIN first_base USING (project, fqn) JOIN first_attr USING (project, fqn) GROUP BY p.project, p.fqn""")
def partial_type_merge(t: T.Tables) -> DataFrame:
    parts = t.partial_types().withColumn("pos", F.substring_index("pos", "_", 2))
    out = types.merge_partial(parts)
    return out.select("project", "fqn", "parts", "loc", "members", "complexity", *[joined(c).alias(c) for c in ("referenced_types", "bases", "attributes")])


KIND = """kinds AS (SELECT p_brand AS project, p_name AS fqn, (['struct', 'class', 'enum', 'record', 'interface'])[p_size % 5 + 1] AS kind FROM part),
ord AS (SELECT * FROM (VALUES ('class', 1), ('interface', 2), ('struct', 3), ('record', 4), ('enum', 6)) o(kind, o))"""


def _kinds(t: T.Tables) -> DataFrame:
    kind = F.get(F.array(*[F.lit(x) for x in ("struct", "class", "enum", "record", "interface")]), F.col("p_size") % 5)
    return t.read("part").select(F.col("p_brand").alias("project"), F.col("p_name").alias("fqn"), kind.alias("kind"))


@query(with_(KIND) + "SELECT project, fqn, arg_min(kind, o) AS kind, arg_max(kind, o) AS last FROM kinds JOIN ord USING (kind) GROUP BY project, fqn")
def kind_buckets(t: T.Tables) -> DataFrame:
    rows = _kinds(t)
    return types.declared_kind(rows).join(types.declared_kind(rows, last=True).withColumnRenamed("kind", "last"), ["project", "fqn"])


NS = """ty AS (SELECT DISTINCT p_brand AS project, 'A.B' || p_size % 4 || '.C' || p_size % 3 || '.T' || p_size AS fqn, p_type AS kind FROM part),
ns AS (SELECT DISTINCT p_brand AS project, CASE WHEN p_size < 20 THEN (['A', 'A.B1', 'A.B2.C1', 'A.B3.C2.T11', 'B'])[p_size % 5 + 1] ELSE 'C.D' || p_size END AS ns FROM part),
loc AS (SELECT ty.project, ty.fqn, ty.kind, arg_max(ns, length(ns)) AS ns FROM ty LEFT JOIN ns ON ns.project = ty.project AND starts_with(ty.fqn, ns.ns || '.') GROUP BY ty.project, ty.fqn, ty.kind),
spl AS (SELECT project, fqn, kind, coalesce(ns, '<global>') AS ns, CASE WHEN ns IS NULL THEN fqn ELSE substr(fqn, length(ns) + 2) END AS "local" FROM loc)"""


def _split(t: T.Tables) -> DataFrame:
    s = F.col("p_size")
    fqn = F.concat(F.lit("A.B"), (s % 4).cast("string"), F.lit(".C"), (s % 3).cast("string"), F.lit(".T"), s.cast("string"))
    ty = t.read("part").select(F.col("p_brand").alias("project"), fqn.alias("fqn"), F.col("p_type").alias("kind")).distinct()
    ns = F.get(F.array(*[F.lit(x) for x in ("A", "A.B1", "A.B2.C1", "A.B3.C2.T11", "B")]), s % 5)
    return types.split_namespaces(ty, t.read("part").select(F.col("p_brand").alias("project"), F.when(s < 20, ns).otherwise(F.concat(F.lit("C.D"), s.cast("string"))).alias("ns")))


@query(with_(NS) + "SELECT * FROM spl")
def namespace_longest_prefix(t: T.Tables) -> DataFrame:
    return _split(t)


@query(with_(NS) + """SELECT project, ns, kind, string_agg(DISTINCT "local", ',' ORDER BY "local") AS locals FROM spl GROUP BY project, ns, kind""")
def classes_grouped(t: T.Tables) -> DataFrame:
    return types.grouped_classes(_split(t)).withColumn("locals", joined("locals"))


# ---------------------------------------------------------------- files

FILES = """prj AS (SELECT p_partkey AS project, 'r/' || p_partkey // 2 || (CASE WHEN p_size % 4 = 0 THEN '/sub' ELSE '' END) || '/p.csproj' AS path FROM part),
fil AS (SELECT DISTINCT 'r/' || l_partkey // 2 || (CASE l_linenumber % 5 WHEN 0 THEN '/sub' WHEN 1 THEN '/sub/deep' WHEN 2 THEN '/Obj' WHEN 3 THEN '/x' ELSE '' END) || '/F' || l_suppkey || '.cs' AS path FROM lineitem),
dirs AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM prj),
deep AS (SELECT f.path, arg_max(dir, length(dir)) AS dir FROM fil f JOIN dirs ON string_split(f.path, '/')[2] = string_split(dir, '/')[2] AND starts_with(f.path, dir || '/')
  WHERE NOT regexp_matches(f.path, '(?i)(^|/)(bin|obj)/') GROUP BY f.path),
own AS (SELECT prj.project, deep.path FROM deep JOIN prj ON regexp_extract(prj.path, '^(.*)/[^/]*$', 1) = deep.dir)"""


def _owned(t: T.Tables) -> DataFrame:
    """Two parts share a folder, one of them perhaps in its subfolder; line items are files of their part's folder."""
    folder = lambda key: F.concat(F.lit("r/"), F.floor(F.col(key) / 2).cast("string"))
    sub = F.when(F.col("p_size") % 4 == 0, "/sub").otherwise("")
    projects = t.read("part").select(F.col("p_partkey").alias("project"), F.concat(folder("p_partkey"), sub, F.lit("/p.csproj")).alias("path"))
    k = F.col("l_linenumber") % 5
    where = F.when(k == 0, "/sub").when(k == 1, "/sub/deep").when(k == 2, "/Obj").when(k == 3, "/x").otherwise("")
    files = t.read("lineitem").select(F.concat(folder("l_partkey"), where, F.lit("/F"), F.col("l_suppkey").cast("string"), F.lit(".cs")).alias("path")).distinct()
    return types.own_files(files, projects)


@query(with_(FILES) + "SELECT project, path FROM own")
def file_ownership(t: T.Tables) -> DataFrame:
    return _owned(t)


@query(with_(FILES) + "SELECT project, path, (row_number() OVER (PARTITION BY project ORDER BY regexp_extract(path, '^(.*)/[^/]*$', 1), regexp_extract(path, '[^/]*$')) - 1)::BIGINT AS file_id FROM own")
def file_ids(t: T.Tables) -> DataFrame:
    return types.file_ids(_owned(t))


@query(with_(FILES) + "SELECT project, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, string_agg(DISTINCT regexp_extract(path, '[^/]*$'), ',' ORDER BY regexp_extract(path, '[^/]*$')) AS files FROM own GROUP BY 1, 2")
def source_files_grouped(t: T.Tables) -> DataFrame:
    return types.grouped_files(_owned(t)).withColumn("files", joined("files"))


@query("SELECT p_partkey AS node, 'a/' || p_brand || '/x' AS folded, 'a/' || p_brand AS parent, 'x' AS stem FROM part")
def path_folding(t: T.Tables) -> DataFrame:
    path = F.concat(F.lit("a/./b/..\\"), "p_brand", F.lit("//c/../x"))
    return t.read("part").select(F.col("p_partkey").alias("node"), paths.fold(path).alias("folded")).withColumns({"parent": paths.parent(F.col("folded")), "stem": paths.stem(F.concat("folded", F.lit(".csproj")))})


# ---------------------------------------------------------------- endpoints


@query(with_(T.ETYPES, T.EMETHODS, T.EKIND) + """SELECT project, fqn, endpoint, CASE WHEN endpoint = 'webapi-controller' AND (attribute LIKE 'Route(%' OR attribute LIKE 'RoutePrefix(%')
  THEN regexp_extract(attribute, '''([^'']*)''', 1) END AS route FROM ekind WHERE endpoint IS NOT NULL""")
def endpoint_classify(t: T.Tables) -> DataFrame:
    return endpoints.classify(t.endpoint_types(), t.endpoint_methods())


@query(with_(T.ETYPES, T.EMETHODS, T.EKIND, T.EOFFER) + """SELECT project, fqn, endpoint, name, line_start, CASE WHEN endpoint = 'webapi-controller' THEN (['GET', 'POST', NULL, 'DELETE', NULL])[m + 1] END AS verb,
  CASE WHEN endpoint = 'webapi-controller' AND m = 0 THEN '{id}/' || line_start WHEN endpoint = 'webapi-controller' AND m = 1 THEN 'add' END AS route,
  'D' || l_suppkey % 7 || ',T' || l_partkey AS dtos, CASE m WHEN 2 THEN 'Log' WHEN 3 THEN 'Authorize' ELSE '' END AS extras FROM eoffer""")
def endpoint_methods(t: T.Tables) -> DataFrame:
    found = endpoints.endpoint_methods(endpoints.classify(t.endpoint_types(), t.endpoint_methods()), t.endpoint_methods())
    return found.withColumns({"dtos": joined("dtos"), "extras": joined("extras")})


@query(with_(T.ETYPES, T.EMETHODS, T.EKIND, T.EOFFER) + "SELECT project, fqn, string_agg(DISTINCT 'D' || l_suppkey % 7, ',' ORDER BY 'D' || l_suppkey % 7) AS dtos FROM eoffer GROUP BY project, fqn")
def endpoint_dtos(t: T.Tables) -> DataFrame:
    found = endpoints.endpoint_methods(endpoints.classify(t.endpoint_types(), t.endpoint_methods()), t.endpoint_methods())
    return endpoints.endpoint_dtos(found).withColumn("dtos", joined("dtos"))


@query(with_(T.ETYPES, T.EMETHODS, T.EKIND, T.DAG) + """SELECT e.project, e.fqn, u.p_brand AS user_project, string_agg(DISTINCT 'T' || src, ',' ORDER BY 'T' || src) AS users
  FROM ekind e JOIN dag ON 'Ns.T' || dst = e.fqn JOIN part u ON u.p_partkey = src WHERE endpoint IS NOT NULL GROUP BY e.project, e.fqn, u.p_brand""")
def endpoint_users(t: T.Tables) -> DataFrame:
    part = t.read("part").select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("project"))
    name = lambda c: F.concat(F.lit("T"), F.col(c).cast("string"))
    mentions = t.dag().join(part, "src").select("project", F.concat(F.lit("Ns."), name("src")).alias("fqn"), name("dst").alias("simple"))
    return endpoints.endpoint_users(endpoints.classify(t.endpoint_types(), t.endpoint_methods()), mentions).withColumn("users", joined("users"))


# ---------------------------------------------------------------- lookup

ASKED = ("red widget", "ing", "RING", "a", "blue gear_7", "nothing here", "big bolt", "tiny")


@query(with_("nm AS (SELECT DISTINCT p_name || (CASE WHEN p_size < 15 THEN '_' || p_size ELSE '' END) AS name FROM part)",
  "q AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in ASKED) + "]) AS query)",
  "h AS (SELECT query, name, CASE WHEN lower(name) = lower(query) THEN 1 WHEN ends_with(lower(name), lower(query)) THEN 2 ELSE 3 END AS tier FROM q JOIN nm ON contains(lower(name), lower(query)))",
  "c AS (SELECT q.query, count(*) FILTER (tier <= 1) AS n1, count(*) FILTER (tier <= 2) AS n2, count(*) FILTER (tier <= 3) AS n3 FROM q LEFT JOIN h USING (query) GROUP BY q.query)",
  "u AS (SELECT *, CASE WHEN n1 > 0 THEN 1 WHEN n2 > 0 AND n2 <= 20 THEN 2 ELSE 3 END AS use FROM c)",
  "o AS (SELECT query, use, n1, (CASE use WHEN 1 THEN n1 WHEN 2 THEN n2 ELSE n3 END)::BIGINT AS n FROM u)",
  "l AS (SELECT query, n, n1, (SELECT string_agg(name, ',' ORDER BY name) FROM h WHERE h.query = o.query AND tier <= use) AS hits FROM o)")
  + """SELECT query, CASE WHEN n = 0 THEN 'not_found' WHEN n = 1 THEN 'found' WHEN n <= 20 OR n1 > 1 THEN 'ambiguous' ELSE 'too_many' END AS outcome, CASE WHEN n = 1 THEN hits END AS name, n,
  CASE WHEN n > 1 AND (n <= 20 OR n1 > 1) THEN hits ELSE '' END AS candidates FROM l""")
def resolve_project(t: T.Tables) -> DataFrame:
    known = t.read("part").select(F.concat("p_name", F.when(F.col("p_size") < 15, F.concat(F.lit("_"), F.col("p_size").cast("string"))).otherwise("")).alias("name")).distinct()
    asked = t.spark.createDataFrame([(x,) for x in ASKED], "query string")
    return lookup.resolve_projects(known, asked).withColumn("candidates", joined("candidates"))


TYPES_ASKED = ("T7", "A.B1.C1.T13", "T11", "C0.T12", "T99")


@query(with_(NS, "q AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in TYPES_ASKED) + "]) AS query)") + """SELECT query, project, fqn, kind, ns, "local" FROM spl JOIN q ON
  regexp_extract("local", '[^.]*$') = regexp_extract(query, '[^.]*$') AND CASE WHEN contains(query, '.') THEN fqn = query OR (ns = regexp_extract(query, '^(.*)\\.[^.]*$', 1) AND ends_with("local", regexp_extract(query, '[^.]*$')))
  ELSE "local" = query OR regexp_extract("local", '[^.]*$') = query END""")
def lookup_type(t: T.Tables) -> DataFrame:
    asked = t.spark.createDataFrame([(x,) for x in TYPES_ASKED], "query string")
    return lookup.lookup_types(_split(t), asked)


@query(with_(T.CATALOG, T.REFD, CLASSIFY, "used AS (SELECT classed.project AS caller, classed.simple, class, seen.target FROM classed JOIN seen ON seen.project = classed.project AND seen.simple = classed.simple WHERE class IN ('resolved', 'ambiguous') AND seen.target IS NOT NULL)")
  + """SELECT c.simple AS query, c.project, c.simple AS fqn, coalesce(string_agg(DISTINCT caller, ',' ORDER BY caller) FILTER (class = 'resolved'), '') AS callers,
  coalesce(string_agg(DISTINCT caller, ',' ORDER BY caller) FILTER (class = 'ambiguous'), '') AS ambiguous_in FROM catalog c LEFT JOIN used u ON u.target = c.project AND u.simple = c.simple GROUP BY c.project, c.simple""")
def lookup_callers(t: T.Tables) -> DataFrame:
    found = t.catalog().select(F.col("simple").alias("query"), "project", F.col("simple").alias("fqn"))
    out = lookup.callers(found, types.classify_references(t.referenced(), t.catalog()))
    return out.withColumns({"callers": joined("callers"), "ambiguous_in": joined("ambiguous_in")})


FILES_ASKED = ("F1.cs", "sub/F5.cs", "7.cs", "none.cs")


@query(with_(FILES, "ids AS (SELECT project, path, regexp_extract(path, 'F([0-9]+)', 1)::BIGINT AS k FROM own)", "q AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in FILES_ASKED) + "]) AS query)",
  "sp AS (SELECT project, path, 'T' || k || ' L' || (k % 9) || '-' || (k % 9 + 5) AS t FROM ids WHERE k % 2 = 1)")
  + "SELECT query, o.project, o.path, coalesce(string_agg(DISTINCT t, ',' ORDER BY t), '') AS types FROM own o JOIN q ON ends_with(o.path, query) LEFT JOIN sp ON sp.project = o.project AND sp.path = o.path GROUP BY query, o.project, o.path")
def lookup_file(t: T.Tables) -> DataFrame:
    files = types.file_ids(_owned(t))
    k = F.regexp_extract("path", "F([0-9]+)", 1).cast("long")
    spans = files.withColumn("k", k).filter("k % 2 = 1").select("project", "file_id", F.concat(F.lit("T"), F.col("k").cast("string")).alias("fqn"), (F.col("k") % 9).alias("line_start"), (F.col("k") % 9 + 5).alias("line_end"))
    asked = t.spark.createDataFrame([(x,) for x in FILES_ASKED], "query string")
    return lookup.lookup_files(files, spans, asked).withColumn("types", joined("types"))


@query("""SELECT query, p_brand AS project, string_agg(DISTINCT 'Ns.T' || p_partkey, ',' ORDER BY 'Ns.T' || p_partkey) AS subclasses FROM part JOIN (VALUES ('Hub', 2), ('X.ClientBase', 1)) q(query, k) ON p_size % 5 = k GROUP BY query, p_brand""")
def subclasses(t: T.Tables) -> DataFrame:
    asked = t.spark.createDataFrame([("Hub",), ("X.ClientBase",), ("Nobody",)], "query string")
    return lookup.subclasses(t.endpoint_types(), asked).withColumn("subclasses", joined("subclasses"))


@query(with_(FILES, "ids AS (SELECT project, path, (row_number() OVER (PARTITION BY project ORDER BY regexp_extract(path, '^(.*)/[^/]*$', 1), regexp_extract(path, '[^/]*$')) - 1)::BIGINT AS file_id FROM own)",
  "sp AS (SELECT DISTINCT project, (file_id * 2) AS file_id FROM ids)") + "SELECT sp.project, sp.file_id, coalesce(path, 'f' || sp.file_id) || ':3-9' AS at FROM sp LEFT JOIN ids USING (project, file_id)")
def span_locations(t: T.Tables) -> DataFrame:
    files = types.file_ids(_owned(t))
    spans = files.select("project", (F.col("file_id") * 2).alias("file_id"), F.lit(3).alias("line_start"), F.lit(9).alias("line_end")).distinct()
    return lookup.located(spans, files).select("project", "file_id", "at")


# ---------------------------------------------------------------- findings

FOUND = (T.PROJ, T.CYC, T.REACH.format(e="cyc"), T.SCC, T.PKG, T.USE, T.DECL, PACKS, """f AS (
  SELECT 'cycle' AS kind, component::VARCHAR AS project, string_agg(node::VARCHAR, ', ' ORDER BY node) AS detail FROM scc WHERE cyclic GROUP BY component
  UNION ALL SELECT 'orphan', p_partkey::VARCHAR, '' FROM part WHERE p_partkey NOT IN (SELECT src FROM cyc) AND p_partkey NOT IN (SELECT dst FROM cyc)
  UNION ALL SELECT 'unresolved', src::VARCHAR, dst::VARCHAR FROM cyc LEFT JOIN part ON p_partkey = dst AND p_size < 40 WHERE p_partkey IS NULL
  UNION ALL SELECT DISTINCT 'unused', project::VARCHAR, name FROM packs p WHERE coalesce(lower(private_assets), '') <> 'all' AND name NOT IN ('System.Memory', 'StyleCop.Analyzers')
    AND EXISTS (SELECT 1 FROM use u WHERE u.project = p.project) AND NOT EXISTS (SELECT 1 FROM use u, (SELECT CASE p.name WHEN 'Serilog.AspNetCore' THEN 'Serilog' WHEN 'xunit' THEN 'Xunit' ELSE p.name END AS ns) k
    WHERE u.project = p.project AND (u.ns = k.ns OR starts_with(u.ns, k.ns || '.')))
  UNION ALL SELECT 'undeclared', project::VARCHAR, ns FROM use u WHERE NOT EXISTS (SELECT 1 FROM decl d WHERE d.project = u.project AND (u.ns = d.prefix OR starts_with(u.ns, d.prefix || '.')))
  UNION ALL SELECT 'version_conflict', name, string_agg(project || '=' || version, ', ' ORDER BY project, version) FROM (SELECT DISTINCT project, name, version FROM pkg) GROUP BY name HAVING count(DISTINCT version) > 1
  UNION ALL SELECT 'forbidden_area_edge', src::VARCHAR, dst::VARCHAR || ': area `Brand#2` is isolated (allow: [])' FROM cyc JOIN proj a ON a.project = src JOIN proj b ON b.project = dst WHERE a.brand = 'Brand#2' AND b.brand <> 'Brand#2')""",
  "s AS (SELECT *, CASE WHEN kind IN ('cycle', 'version_conflict', 'forbidden_area_edge') THEN 'error' WHEN kind = 'orphan' THEN 'info' ELSE 'warning' END AS severity FROM f)")


def _findings(t: T.Tables) -> DataFrame:
    cyc = t.cyc()
    known = t.read("part").filter("p_size < 40").select(F.col("p_partkey").alias("node"))
    rules = t.spark.createDataFrame([("Brand#2", [], None)], "area string, allow array<string>, deny array<string>")
    return findings.collect_findings(
        graph.cycles(cyc), graph.orphans(t.nodes(), cyc), graph.link(known, cyc.withColumnRenamed("dst", "target")).filter("not resolved"),
        packages.unused_packages(_packs(t), t.usings()), packages.undeclared_usings(t.usings(), t.declared()),
        packages.version_conflicts(t.package_refs().select("project", "name", "version").distinct()), areas.forbidden_edges(cyc, areas.with_areas(t.projects()), rules),
    )


@query(with_(*FOUND, recursive=True) + "SELECT kind, project, detail, severity FROM s")
def findings_union(t: T.Tables) -> DataFrame:
    return _findings(t)


@query(with_(*FOUND, recursive=True) + "SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos FROM s")
def findings_by_severity(t: T.Tables) -> DataFrame:
    return findings.by_severity(_findings(t))


@query(with_(*FOUND, recursive=True) + "SELECT kind, count(*)::BIGINT AS n, string_agg(CASE WHEN detail = '' THEN project ELSE project || ' ' || detail END, '; ' ORDER BY CASE WHEN detail = '' THEN project ELSE project || ' ' || detail END) AS entries FROM s GROUP BY kind")
def checks_buckets(t: T.Tables) -> DataFrame:
    return findings.buckets(_findings(t)).withColumn("entries", F.array_join("entries", "; "))


# ---------------------------------------------------------------- parsing of made-up files


def _files(t: T.Tables, path: Column, text: Column, where: str = "true") -> DataFrame:
    return t.read("part").filter(where).select(path.alias("path"), text.alias("text"), "p_partkey", "p_size")


def _n(c: str) -> Column:
    return F.col(c).cast("string")


PROJECT_PATH = "'src/' || p_brand || '/P' || p_partkey || '/P' || p_partkey || '.csproj'"


def _project_files(t: T.Tables) -> DataFrame:
    path = F.concat(F.lit("src/"), "p_brand", F.lit("/P"), _n("p_partkey"), F.lit("/P"), _n("p_partkey"), F.lit(".csproj"))
    head = F.when(F.col("p_size") % 3 == 0, '<Project ToolsVersion="4.0" xmlns="http://schemas.microsoft.com/developer/msbuild/2003">').otherwise('<Project Sdk="Microsoft.NET.Sdk">')
    frame = F.when(F.col("p_size") % 2 == 0, "<TargetFrameworks>net8.0; netstandard2.0;</TargetFrameworks>").otherwise("<TargetFramework>net8.0</TargetFramework>")
    name = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("<AssemblyName>Asm"), _n("p_size"), F.lit("</AssemblyName>"))).otherwise("")
    version = F.when(F.col("p_size") % 4 == 0, F.lit('"/>')).otherwise(F.concat(F.lit('" Version="'), _n("p_size"), F.lit('.0" PrivateAssets="All"></PackageReference>')))
    text = F.concat(
        head, F.lit("<PropertyGroup>"), frame, name, F.lit('</PropertyGroup>\n<!-- <PackageReference Include="No"/> --><ItemGroup><PackageReference Include="'), "p_type", version,
        F.lit('<ProjectReference Include="..\\P'), (F.col("p_partkey") + 1).cast("string"), F.lit("\\P"), (F.col("p_partkey") + 1).cast("string"),
        F.lit('.csproj"/><Reference Include="Lib, Version=1"/></ItemGroup></Project>'),
    )
    return _files(t, path, text)


@query(f"""SELECT {PROJECT_PATH} AS path, CASE WHEN p_size % 5 = 0 THEN 'Asm' || p_size ELSE 'P' || p_partkey END AS name, p_size % 3 <> 0 AS sdk_style,
  CASE WHEN p_size % 2 = 0 THEN 'net8.0,netstandard2.0' ELSE 'net8.0' END AS frameworks, p_type AS package, CASE WHEN p_size % 4 <> 0 THEN p_size || '.0' END AS version,
  CASE WHEN p_size % 4 <> 0 THEN 'All' END AS private_assets, 'src/' || p_brand || '/P' || (p_partkey + 1) || '/P' || (p_partkey + 1) || '.csproj' AS target_path, 'Lib, Version=1' AS assembly FROM part""")
def parse_csproj(t: T.Tables) -> DataFrame:
    from quarrylib.sources import project_files as pf

    got = pf.project_tables(pf.parse_projects(_project_files(t)))
    refs = got["package_refs"].withColumnRenamed("name", "package").drop("ord")
    out = got["projects"].join(refs, "project").join(got["project_refs"].drop("ord"), "project").join(got["assembly_refs"].drop("ord"), "project")
    return out.select("path", "name", "sdk_style", joined("target_frameworks").alias("frameworks"), "package", "version", "private_assets", "target_path", F.col("raw_include").alias("assembly"))


@query("SELECT 'sln/' || p_brand || '/S' || p_partkey || '.sln' AS solution, 'P' || p_size AS name, 'sln/' || (CASE WHEN p_size % 2 = 0 THEN p_brand || '/' ELSE '' END) || 'P' || p_size || '.csproj' AS path FROM part")
def parse_sln(t: T.Tables) -> DataFrame:
    from quarrylib.sources import project_files as pf

    path = F.concat(F.lit("sln/"), "p_brand", F.lit("/S"), _n("p_partkey"), F.lit(".sln"))
    up = F.when(F.col("p_size") % 2 == 0, "").otherwise("..\\")
    line = F.concat(F.lit('Project("{FAE0}") = "P'), _n("p_size"), F.lit('", "'), up, F.lit("P"), _n("p_size"), F.lit('.csproj", "{GUID}"'))
    rows = t.read("part").select(path.alias("path"), F.explode(F.array(F.lit("Microsoft Visual Studio Solution File"), line, F.lit('Project("{2150}") = "docs", "docs", "{GUID}"'), F.lit("EndProject"))).alias("value"))
    return pf.solution_projects(rows)


@query("SELECT 'd' || p_partkey AS props_dir, 'Pkg' || (p_size % 4) AS name, (p_size * 2) || '.1' AS version, 1::BIGINT AS ord FROM part")
def parse_cpm(t: T.Tables) -> DataFrame:
    from quarrylib.sources import project_files as pf

    path = F.concat(F.lit("d"), _n("p_partkey"), F.lit("/Directory.Packages.props"))
    entry = lambda v: F.concat(F.lit('<PackageVersion Include="Pkg'), (F.col("p_size") % 4).cast("string"), F.lit('" Version="'), v, F.lit('"/>'))
    text = F.concat(F.lit("<Project><ItemGroup><PackageVersion Update='x'/>"), entry(_n("p_size")), entry(F.concat((F.col("p_size") * 2).cast("string"), F.lit(".1"))), F.lit("</ItemGroup></Project>"))
    return pf.parse_central_versions(_files(t, path, text)).filter("ord = 1")


def _sources(t: T.Tables) -> DataFrame:
    """A class for each part: its size gives methods, branches and lines."""
    s, k = F.col("p_size"), _n("p_partkey")
    branch = F.when(s % 3 == 0, F.lit("if (a?.b ?? c) { }\n")).when(s % 3 == 1, F.lit("for (;;) { x = y ? 1 : 2; }\n")).otherwise(F.lit("int? n = null; // if\n"))
    method = F.concat(F.lit("  [HttpGet(\"a"), k, F.lit("\")]\n  public Task<Dto"), _n("p_size"), F.lit("> M(Arg a, int b)\n  {\n"), F.repeat(branch, F.col("p_size") % 7), F.lit("    var s = \"} if (\"; var v = new Made(); return x;\n  }\n"))
    text = F.concat(
        F.lit("using System;\nusing J = Lib"), (s % 9).cast("string"), F.lit(".Core;\n/* class No { } */\nnamespace Acme.N"), (s % 4).cast("string"), F.lit(";\n[Serializable]\npublic sealed class T"), k,
        F.lit(" : Base<Gen>, IThing\n{\n  private int a, b;\n  public string P { get; set; }\n"), F.repeat(method, s % 3), F.lit("}\ninternal enum E"), k, F.lit(" { A, B }\n"),
    )
    return _files(t, F.concat(F.lit("f/"), k, F.lit(".cs")), text)


def _parsed(t: T.Tables) -> DataFrame:
    from quarrylib.sources import source_code as sc

    return sc.parse_sources(_sources(t))


CS = """cs AS (SELECT *, 'Acme.N' || p_size % 4 AS ns, p_size % 7 AS reps, p_size % 3 AS meths, (CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END) * (p_size % 7) AS cx,
  5 + p_size % 7 AS mloc FROM part)"""


@query("SELECT 'f/' || p_partkey || '.cs' AS path, 'Lib' || p_size % 9 || '.Core,System' AS usings, 'Acme.N' || p_size % 4 AS namespaces FROM part")
def parse_usings(t: T.Tables) -> DataFrame:
    return _parsed(t).select("path", joined("usings").alias("usings"), joined("namespaces").alias("namespaces"))


@query(with_(CS) + "SELECT 'class' AS kind, ns || '.T' || p_partkey AS fqn FROM cs UNION ALL SELECT 'enum', ns || '.E' || p_partkey FROM cs")
def parse_types(t: T.Tables) -> DataFrame:
    return _parsed(t).select(F.explode("types").alias("t")).select("t.kind", "t.fqn")


@query(with_(CS) + """SELECT ns || '.T' || p_partkey AS fqn, (6 + meths * mloc)::BIGINT AS loc, (2 + meths)::BIGINT AS members, (meths * cx)::BIGINT AS complexity, 'Base,Gen,IThing' AS bases,
  'Serializable' AS attributes, CASE WHEN meths > 0 THEN 'Arg,Base,Dto' || p_size || ',Gen,HttpGet,IThing,Made,Serializable,Task' ELSE 'Base,Gen,IThing,Serializable' END AS referenced FROM cs""")
def parse_metrics(t: T.Tables) -> DataFrame:
    rows = _parsed(t).select(F.explode("types").alias("t")).filter("t.kind = 'class'").select("t.*")
    return rows.select("fqn", "loc", "members", "complexity", *[joined(c).alias(c) for c in ("bases", "attributes", "referenced")])


@query(with_(CS) + """SELECT ns || '.T' || p_partkey AS fqn, 'M' AS name, (10 + i * mloc)::BIGINT AS line_start, (9 + (i + 1) * mloc)::BIGINT AS line_end, mloc::BIGINT AS loc, cx::BIGINT AS complexity,
  'HttpGet(''a' || p_partkey || ''')' AS attributes, 'Arg,Dto' || p_size || ',Task' AS signature_types, 'public Task<Dto' || p_size || '> M(Arg a, int b)' AS signature FROM cs, (VALUES (0), (1)) r(i) WHERE i < meths""")
def parse_methods(t: T.Tables) -> DataFrame:
    rows = _parsed(t).select(F.explode("types").alias("t")).select("t.fqn", F.explode("t.methods").alias("m")).select("fqn", "m.*")
    return rows.select("fqn", "name", "line_start", "line_end", "loc", "complexity", joined("attributes").alias("attributes"), joined("signature_types").alias("signature_types"), "signature")


@query("""SELECT 'f' || p_partkey AS path, CASE WHEN p_partkey % 7 = 0 THEN 'new' WHEN p_partkey % 7 = 1 THEN 'gone' WHEN p_partkey % 7 = 2 THEN 'changed' ELSE 'same' END AS state FROM part""")
def parse_cache_delta(t: T.Tables) -> DataFrame:
    from quarrylib.streaming.parse_cache import delta

    k = F.col("p_partkey") % 7
    rows = t.read("part").select(F.concat(F.lit("f"), _n("p_partkey")).alias("path"), F.col("p_size").alias("mtime"), F.col("p_partkey").alias("length"), k.alias("k"))
    now = rows.filter("k <> 1").select("path", "mtime", "length")
    before = rows.filter("k <> 0").select("path", F.when(F.col("k") == 2, F.col("mtime") - 1).otherwise(F.col("mtime")).alias("mtime"), "length")
    return delta(now, before)


# ---------------------------------------------------------------- renderings


def _drawn(t: T.Tables) -> tuple[DataFrame, DataFrame]:
    key = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    kind = lambda c: F.when(F.col(c) % 10 == 0, "package").otherwise("project")
    nodes = t.read("part").select(key("p_partkey").alias("key"), F.col("p_name").alias("label"), kind("p_partkey").alias("kind"))
    return nodes, t.dag().select(key("src").alias("src"), key("dst").alias("dst"), kind("dst").alias("kind"))


@query(with_(T.DAG) + """SELECT * FROM (VALUES ('digraph projects {'), ('  rankdir=LR;'), ('  node [shape=box, style=rounded];'), ('}')) v(line)
  UNION ALL SELECT '  "p' || p_partkey || '" [label="' || p_name || '"' || (CASE WHEN p_partkey % 10 = 0 THEN ', shape=ellipse, style="filled,rounded", fillcolor="#eeeeee"' ELSE '' END) || '];' FROM part
  UNION ALL SELECT '  "p' || src || '" -> "p' || dst || '"' || (CASE WHEN dst % 10 = 0 THEN ' [style=dashed, color=gray]' ELSE '' END) || ';' FROM dag""")
def dot_render(t: T.Tables) -> DataFrame:
    from quarrylib import sinks

    return sinks.dot(*_drawn(t)).select("line")


@query(with_(T.DAG, "num AS (SELECT p_partkey, p_name, 'n' || (row_number() OVER (ORDER BY 'p' || p_partkey) - 1) AS n FROM part)") + """SELECT 'flowchart LR' AS line UNION ALL SELECT '  ' || n || '["' || p_name || '"]' FROM num
  UNION ALL SELECT '  ' || a.n || (CASE WHEN dst % 10 = 0 THEN ' -.-> ' ELSE ' --> ' END) || b.n FROM dag JOIN num a ON a.p_partkey = src JOIN num b ON b.p_partkey = dst""")
def mermaid_render(t: T.Tables) -> DataFrame:
    from quarrylib import sinks

    return sinks.mermaid(*_drawn(t)).select("line")


@query("""SELECT p_partkey AS node, 'f' || p_size || ':' || p_size || '-' || (p_size + 5) AS span, p_name || ' L' || p_size || '-' || (p_size + 5) || ' loc=6 cx=2' || (CASE WHEN p_size % 2 = 0 THEN ' f=' || p_size ELSE '' END)
  || (CASE WHEN p_size % 3 = 0 THEN ' [A, L9-x]' ELSE '' END) AS method, p_size::BIGINT AS line_start, (p_size + 5)::BIGINT AS line_end, CASE WHEN p_size % 2 = 0 THEN p_size::BIGINT END AS file_id FROM part""")
def span_format(t: T.Tables) -> DataFrame:
    from quarrylib import sinks

    s = F.col("p_size").cast("long")
    file = F.when(s % 2 == 0, s)
    attrs = F.when(s % 3 == 0, F.array(F.lit("A"), F.lit("L9-x"))).otherwise(F.array().cast("array<string>"))
    rows = t.read("part").select(F.col("p_partkey").alias("node"), sinks.span_text(s, s, s + 5).alias("span"), sinks.method_text(F.col("p_name"), s, s + 5, F.lit(6), F.lit(2), file, attrs).alias("method"))
    return rows.withColumn("m", sinks.parse_method(F.col("method"))).select("node", "span", "method", "m.line_start", "m.line_end", "m.file_id")


@query(with_(T.DAG, "known AS (SELECT p_partkey AS node FROM part WHERE p_size < 40)", "e AS (SELECT * FROM dag WHERE src IN (SELECT node FROM known) AND dst IN (SELECT node FROM known))")
  + """SELECT node, coalesce((SELECT string_agg(dst::VARCHAR, ',' ORDER BY dst) FROM e WHERE src = node), '') AS deps,
  coalesce((SELECT string_agg(src::VARCHAR, ',' ORDER BY src) FROM e WHERE dst = node), '') AS dependents FROM known""")
def dependency_map(t: T.Tables) -> DataFrame:
    known = t.read("part").filter("p_size < 40").select(F.col("p_partkey").alias("node"))
    return graph.dependency_map(known, t.dag()).withColumns({"deps": joined("deps"), "dependents": joined("dependents")})


@query(
  """SELECT project, fqn, k.f AS file_id, k.a AS line_start, k.a + 9 AS line_end FROM (SELECT l_returnflag AS project, 'O' || l_orderkey AS fqn, min({f: l_suppkey, p: l_linenumber, a: l_partkey}) AS k FROM lineitem GROUP BY 1, 2)""")
def primary_spans(t: T.Tables) -> DataFrame:
    rows = t.read("lineitem").select(
        F.col("l_returnflag").alias("project"), F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("fqn"), F.col("l_suppkey").alias("file_id"),
        F.struct("l_linenumber", "l_partkey").alias("pos"), F.col("l_partkey").alias("line_start"), (F.col("l_partkey") + 9).alias("line_end"),
    )
    return types.primary_spans(rows)


@query("""SELECT p_partkey AS node, CASE p_size % 4 WHEN 0 THEN 'api/' || p_size WHEN 1 THEN 'a' END AS argument FROM part""")
def first_quoted_arguments(t: T.Tables) -> DataFrame:
    k = F.col("p_size") % 4
    attribute = F.when(k == 0, F.concat(F.lit("Route('api/"), _n("p_size"), F.lit("', Name = 'x')"))).when(k == 1, "A(1, 'a')").when(k == 2, "Plain").otherwise("Open('x'")
    return t.read("part").select(F.col("p_partkey").alias("node"), names.first_quoted(attribute).alias("argument"))


@query(f"""SELECT lpad(complexity::VARCHAR, 12, ' ') || lpad(loc::VARCHAR, 7, ' ') || '  ' || project || '::' || fqn || '.' || name AS line
  FROM (SELECT * FROM {METHODS} ORDER BY complexity DESC, loc DESC, project, fqn, name, line_start LIMIT 20)""")
def top_method_lines(t: T.Tables) -> DataFrame:
    from quarrylib import sinks

    return sinks.top_method_lines(types.top_methods(t.methods())).select("line")
