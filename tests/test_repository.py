"""Whole repositories in a temporary folder, through the readers, operators and commands."""

import os
import time

import pytest
from pyspark.sql import functions as F

from quarrylib import app, sinks
from quarrylib.operators import packages
from quarrylib.sources import project_files as pf
from quarrylib.sources import spec
from quarrylib.sources.repository import load
from quarrylib.streaming import parse_cache


def write(root, files):
    for path, text in files.items():
        p = os.path.join(root, path)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w", encoding="utf-8") as f:
            f.write(text)
    return str(root)


def sdk(*refs, packages=(), tfm="net8.0"):
    items = "".join(f'<ProjectReference Include="{r}" />' for r in refs)
    items += "".join(f'<PackageReference Include="{n}"' + (f' Version="{v}"' if v else "") + " />" for n, v in packages)
    return f'<Project Sdk="Microsoft.NET.Sdk"><PropertyGroup><TargetFramework>{tfm}</TargetFramework></PropertyGroup><ItemGroup>{items}</ItemGroup></Project>'


@pytest.fixture(scope="module")
def company(tmp_path_factory):
    legacy = """<?xml version="1.0"?><Project ToolsVersion="15.0" xmlns="http://schemas.microsoft.com/developer/msbuild/2003"><PropertyGroup><AssemblyName>Widget</AssemblyName>
      <TargetFrameworkVersion>v4.8</TargetFrameworkVersion></PropertyGroup><ItemGroup><Reference Include="Core, Version=1.0.0.0, Culture=neutral" /><Reference Include="System.Xml" /></ItemGroup></Project>"""
    up = "..\\"
    return write(tmp_path_factory.mktemp("company"), {
        "Src/Common/Core/Core.csproj": sdk(),
        "Src/Common/Utils/Utils.csproj": sdk(up + "Core\\Core.csproj"),
        "Src/Billing/Domain/Domain.csproj": sdk("../../Common/Utils/Utils.csproj"),
        "Src/Billing/Api/Api.csproj": sdk("../Domain/Domain.csproj", "../../Common/Utils/Utils.csproj", "../../Common/Core/Core.csproj", packages=[("Serilog", "3.1.1"), ("Dapper", None), ("coverlet.collector", "1.0")]),
        "Src/Billing/Ui/Ui.csproj": sdk("../Domain/Domain.csproj", "../../Common/Utils/Utils.csproj", "../../Common/Core/Core.csproj", packages=[("Serilog", "2.0.0")]),
        "Src/Billing/Domain.Tests/Domain.Tests.csproj": sdk("../Domain/Domain.csproj", "../Ghost/Ghost.csproj"),
        "Legacy/Widget/Widget.csproj": legacy,
        "Legacy/Alone/Alone.csproj": sdk(),
        "Legacy/Broken/Broken.csproj": "<Project><a></b>",
        "Directory.Packages.props": '<Project><ItemGroup><PackageVersion Include="Dapper" Version="2.1.0" /></ItemGroup></Project>',
        "Company.sln": 'Project("{F}") = "Core", "Src\\Common\\Core\\Core.csproj", "{1}"\nProject("{F}") = "Lost", "Lost\\Lost.csproj", "{2}"\nProject("{2150}") = "docs", "docs", "{3}"\n',
        "Src/Billing/Api/Program.cs": 'using System;\nusing Serilog;\nusing Newtonsoft.Json;\nusing Common.Core;\nnamespace Billing.Api\n{\n  [ApiController]\n  [Route("api/[controller]")]\n  public class InvoiceController : ControllerBase\n  {\n    [HttpGet("{id}")]\n    public InvoiceDto Get(int id) { if (id > 0) return new InvoiceDto(new Money()); return null; }\n    [HttpPost, Authorize]\n    public void Put(InvoiceDto dto) { }\n  }\n}\n',
        "Src/Billing/Api/Dto.cs": "namespace Billing.Api;\npublic record InvoiceDto(Money Total);\npublic partial class Half { int a; }\n",
        "Src/Billing/Api/Half2.cs": "namespace Billing.Api;\npublic partial class Half : IThing { void M() { while (true) { } } }\n",
        "Src/Billing/Api/obj/Gen.cs": "namespace Never;\nclass No { }\n",
        "Src/Common/Core/Money.cs": "namespace Common.Core;\npublic class Money { public decimal Amount { get; set; } class Inner { } }\npublic interface IThing { }\n",
        "Src/Common/Utils/Thing.cs": "namespace Common.Utils;\npublic interface IThing { }\nclass Uses { InvoiceController c; }\n",
        ".quarry/spec/areas.yaml": "areas:\n  Platform: ['Src/Common']\n  Commerce: ['Src/Bill*']\n",
        ".quarry/spec/rules.yaml": "rules:\n  - area: Legacy\n    deny: [Platform]\n",
    })


@pytest.fixture(scope="module")
def repo(spark, company):
    return load(spark, company).scan()


def named(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_projects_and_references(repo):
    rows = {r.name: r for r in repo.projects.collect()}
    assert sorted(rows) == ["Alone", "Api", "Core", "Domain", "Domain.Tests", "Ui", "Utils", "Widget"]
    assert not rows["Widget"].sdk_style and rows["Widget"].target_frameworks == [] and rows["Core"].target_frameworks == ["net8.0"]
    assert [r.path for r in repo.errors.collect()] == ["Legacy/Broken/Broken.csproj"]
    assert [r.path for r in repo.missing.collect()] == ["Lost/Lost.csproj"]
    stem = lambda c: F.substring_index(F.substring_index(c, "/", -1), ".csproj", 1)
    edges = named(repo.edges(), stem("src"), stem("dst"))
    assert edges == sorted([("Utils", "Core"), ("Domain", "Utils"), ("Api", "Domain"), ("Api", "Utils"), ("Api", "Core"), ("Ui", "Domain"), ("Ui", "Utils"), ("Ui", "Core"), ("Domain.Tests", "Domain"), ("Widget", "Core")])
    assert named(repo.unresolved(), stem("dst")) == [("Ghost",)]
    assert named(repo.package_refs, "name", "version") == [("Dapper", "2.1.0"), ("Serilog", "2.0.0"), ("Serilog", "3.1.1"), ("coverlet.collector", "1.0")]
    assert named(packages.external_refs(repo.package_refs, repo.assembly_refs).filter("version is null"), "name") == [("System.Xml",)]


def test_one_solution_or_project(spark, company):
    assert named(load(spark, f"{company}/Company.sln").projects, "name") == [("Core",)]
    assert named(load(spark, f"{company}/Src/Common/Core/Core.csproj").projects, "name") == [("Core",)]
    with pytest.raises(ValueError):
        load(spark, f"{company}/Directory.Packages.props")


def test_atlas(repo):
    rows = {r.name: r for r in app.atlas(repo, scanned=True)["atlas"].collect()}
    assert {n: r.layer for n, r in rows.items()} == {"Core": 0, "Alone": 0, "Utils": 1, "Widget": 1, "Domain": 2, "Api": 3, "Ui": 3, "Domain.Tests": 3}
    assert {n: (r.fan_in, r.fan_out) for n, r in rows.items()} == {
        "Core": (4, 0), "Alone": (0, 0), "Utils": (3, 1), "Widget": (0, 1), "Domain": (3, 1), "Api": (0, 3), "Ui": (0, 3), "Domain.Tests": (0, 1),
    }
    assert sorted(n for n, r in rows.items() if r.is_root) == ["Api", "Ui"]
    assert {n: r.area for n, r in rows.items()} == {"Core": "Platform", "Utils": "Platform", "Domain": "Commerce", "Api": "Commerce", "Ui": "Commerce", "Domain.Tests": "Commerce", "Widget": "Legacy", "Alone": "Legacy"}
    assert rows["Api"].loc and rows["Ui"].loc is None and not any(r.in_cycle for r in rows.values())


def test_findings(repo):
    t = app.atlas(repo)
    got = {(r.kind, r.project.split("/")[-1].removesuffix(".csproj"), r.detail) for r in t["checks"].collect()}
    assert ("unused", "Api", "Dapper") in got and ("undeclared", "Api", "Newtonsoft.Json") in got
    assert not any(k in ("unused", "undeclared") and ("Serilog" in d or d.startswith("System")) for k, _, d in got)
    assert ("orphan", "Alone", "") in got and not any(k == "cycle" for k, _, _ in got)
    assert [(p, "3.1.1" in d and "2.0.0" in d) for k, p, d in got if k == "version_conflict"] == [("Serilog", True)]
    forbidden = [d for k, _, d in got if k == "forbidden_area_edge"]
    assert forbidden == ["Src/Common/Core/Core.csproj: area `Legacy` denies `Platform`"]
    assert t["checks"].filter("kind = 'orphan'").first().severity == "info"


def test_types(repo):
    rows = {r.fqn: r for r in repo.source["type_metrics"].collect()}
    assert "Never.No" not in rows and "Common.Core.Money.Inner" in rows
    half = rows["Billing.Api.Half"]
    assert (half.members, half.complexity, half.bases, half.parts) == (2, 1, ["IThing"], 2)
    assert rows["Billing.Api.InvoiceController"].members == 2 and rows["Billing.Api.InvoiceController"].complexity == 1
    refs = {(r.project.split("/")[2], r.simple): r for r in app.references(repo).collect()}
    assert refs["Api", "Money"]["class"] == "resolved" and refs["Api", "InvoiceDto"]["class"] == "self" and refs["Api", "Task" if ("Api", "Task") in refs else "ControllerBase"]["class"] == "external"
    assert refs["Utils", "InvoiceController"]["class"] == "external"  # not visible without a using


def test_endpoints(repo):
    t = app.endpoint_tables(repo)
    assert [(r.fqn, r.endpoint, r.route) for r in t["endpoints"].collect()] == [("Billing.Api.InvoiceController", "webapi-controller", "api/[controller]")]
    got = {r.name: (r.verb, r.route, r.dtos, r.extras) for r in t["endpoint_methods"].collect()}
    assert got == {"Get": ("GET", "{id}", ["InvoiceDto"], []), "Put": ("POST", None, ["InvoiceDto"], ["Authorize"])}
    assert [r.users for r in t["endpoint_users"].collect()] == [["Uses"]]


def test_drawings(repo):
    dot = app.draw_graph(repo, "dot", with_packages=True)
    assert dot.startswith("digraph projects {") and dot.count("style=dashed") == 4 and dot.count("shape=ellipse") == 3
    assert app.draw_graph(repo, "mermaid").count("-->") == 10
    text = app.draw_graph(repo, "text")
    assert "Graph: 8 project(s), 10 edge(s)" in text and "Orphans:\n  - Alone" in text and "Unresolved project refs:" in text and "Cycles:" not in text
    assert '{"orphans":' in app.draw_graph(repo, "json")
    focus = app.focus(repo, "domain")
    assert "focus: Domain\n  area=Commerce  layer=2  fan_in=3  fan_out=1" in focus and "nodes: 5  edges: 6" in focus and "  → Utils [Platform L1]" in focus
    assert ":::focus" in app.focus(repo, "Domain", form="mermaid") and "fillcolor" in app.focus(repo, "Domain", form="dot")
    with pytest.raises(app.NotFound):
        app.focus(repo, "i")
    lines = sinks.text(sinks.scan_lines(repo.projects, repo.package_refs, repo.project_refs))
    assert "■ Widget [legacy]" in lines and "    - Dapper 2.1.0" in lines
    totals, top = app.metrics(repo, 3, "Api")
    assert sinks.text(sinks.metrics_lines(totals)).splitlines()[-1].startswith("TOTAL")
    assert [r.name for r in top.collect()] == ["Get", "M", "Put"]


def test_written_atlas_and_lookup(spark, repo, tmp_path):
    folder = app.write_atlas(repo, str(tmp_path / "gen"))
    got = app.look_up(spark, folder, ["Money", "Billing.Api.Half", "Inner", "IThing"], ["api/program.cs", "Dto.cs"])
    assert named(got["types"], "query", "fqn") == [("Billing.Api.Half", "Billing.Api.Half"), ("IThing", "Common.Core.IThing"), ("IThing", "Common.Utils.IThing"), ("Inner", "Common.Core.Money.Inner"), ("Money", "Common.Core.Money")]
    callers = {r.fqn: r.callers for r in got["callers"].collect()}
    assert [c.split("/")[-1] for c in callers["Common.Core.Money"]] == ["Api.csproj"]
    assert [r.subclasses for r in got["subclasses"].collect()] == [["Billing.Api.Half"]]
    assert {r["at"] for r in got["spans"].filter("fqn = 'Billing.Api.Half'").collect()} == {"Src/Billing/Api/Dto.cs:3-3", "Src/Billing/Api/Half2.cs:2-2"}
    files = {(r.query, r.path): r.types for r in got["files"].collect()}
    assert list(files) == [("Dto.cs", "Src/Billing/Api/Dto.cs")] and len(files["Dto.cs", "Src/Billing/Api/Dto.cs"]) == 2
    assert sinks.read_artifacts(spark, folder, "nothing") == {}
    json = str(tmp_path / "json")
    app.write_atlas(repo, json, "json")
    line = spark.read.text(f"{json}/atlas").filter(F.col("value").contains('"Alone"')).first()[0]
    assert '"deps"' not in line


def test_seeding(tmp_path):
    made = spec.seed(str(tmp_path))
    assert len(made) == 3 and spec.seed(str(tmp_path)) == []
    assert spec.areas(made[0]) == {} and spec.rules(made[1]) == [] and spec.areas(str(tmp_path / "none")) == {}


def test_cycle(spark, tmp_path):
    root = write(tmp_path, {"A/A.csproj": sdk("../B/B.csproj"), "B/B.csproj": sdk("../A/A.csproj"), "C/C.csproj": sdk("../A/A.csproj")})
    repo = load(spark, root)
    t = app.graph_tables(repo)
    assert [(r.size, len(r.members)) for r in t["cycles"].collect()] == [(2, 2)]
    rows = {r.name: (r.layer, r.in_cycle) for r in app.atlas(repo, scanned=False)["atlas"].collect()}
    assert rows == {"A": (0, True), "B": (0, True), "C": (1, False)}
    assert "Cycles:\n  - A → B" in app.draw_graph(repo)


def test_central_files_do_not_merge(spark, tmp_path):
    props = lambda *v: "<Project>" + "".join(f'<PackageVersion Include="{n}" Version="{x}"/>' for n, x in v) + "</Project>"
    root = write(tmp_path, {"Directory.Packages.props": props(("A", "1"), ("B", "1")), "in/Directory.Packages.props": props(("A", "2"), ("A", "3")),
                            "in/deep/P.csproj": sdk(packages=[("A", None), ("B", None), ("C", "9")]), "out/Q.csproj": sdk(packages=[("A", None), ("B", "7")])})
    got = named(load(spark, root).package_refs, F.substring_index("project", "/", -1), "name", F.coalesce("version", F.lit("-")))
    assert got == [("P.csproj", "A", "3"), ("P.csproj", "B", "-"), ("P.csproj", "C", "9"), ("Q.csproj", "A", "1"), ("Q.csproj", "B", "7")]


def test_parse_cache(spark, tmp_path):
    root = write(tmp_path / "r", {"P/P.csproj": sdk(), "P/A.cs": "class A { }", "P/B.cs": "class B { }"})
    cache = str(tmp_path / "cache")
    types = lambda: named(load(spark, root).scan(cache).source["declared_types"], "fqn")
    assert types() == [("A",), ("B",)]
    before = parse_cache.current(spark, cache)
    time.sleep(0.05)
    write(root, {"P/B.cs": "class Bee { }", "P/C.cs": "class C { }"})
    os.remove(f"{root}/P/A.cs")
    assert types() == [("Bee",), ("C",)]
    states = dict(tuple(r) for r in parse_cache.delta(parse_cache.current(spark, cache), before).collect())
    assert states == {"P/A.cs": "gone", "P/B.cs": "changed", "P/C.cs": "new"}


def test_parse_stream(spark, tmp_path):
    root = write(tmp_path / "r", {"A.cs": "class A { }", "B.cs": "class B { }"})
    run = lambda: parse_cache.stream(spark, root, str(tmp_path / "out"), str(tmp_path / "cp")).start().awaitTermination()
    run()
    write(root, {"C.cs": "class C { }"})
    run()
    rows = parse_cache.latest(spark.read.parquet(str(tmp_path / "out")))
    assert sorted(t.fqn for r in rows.collect() for t in r.types) == ["A", "B", "C"]


def test_odd_project_files():
    got = pf.parse_project("a/X.csproj", '<project sdk="no"><itemgroup><PackageReference Include="A"><Version>1</Version></PackageReference><Packagereference Include="b"/></itemgroup>')
    assert got["name"] == "X" and got["package_refs"] == [{"name": "A", "version": None, "private_assets": None}] and not got["sdk_style"] and got["error"] is None
    assert pf.parse_project("X", "")["error"] is None and pf.parse_project("X", "<a></b>")["error"]
    two = pf.parse_project("X", '<Project><PropertyGroup><AssemblyName>One</AssemblyName><AssemblyName>Two</AssemblyName></PropertyGroup><Target><PackageReference Include="No"/></Target></Project>')
    assert two["name"] == "Two" and two["package_refs"] == []
