"""Readers of solution, project and central-version files: text in, tables out."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylib.functions import paths

PROJECT_SCHEMA = (
    "path string, name string, sdk_style boolean, target_frameworks array<string>, "
    "package_refs array<struct<name:string,version:string,private_assets:string>>, project_refs array<string>, assembly_refs array<string>, error string"
)
CENTRAL_SCHEMA = "path string, entries array<struct<name:string,version:string,ord:long>>, error string"


def quoted_fields(line: Column) -> Column:
    """What stands between pairs of quotes; an open last one reaches to the end of the line."""
    return F.regexp_extract_all(line, F.lit(r'"([^"]*)(?:"|$)'), F.lit(1))


def solution_projects(lines: DataFrame) -> DataFrame:
    """``solution, name, path`` of ``lines(path, value)`` of solution files.

    Lines that begin with ``Project(``; after the ``=`` the first quoted field is the name, the second the
    path from the solution's folder. Entries that aren't .csproj files, such as folders, are left out.
    """
    entry = F.trim("value")
    fields = quoted_fields(F.regexp_extract("value", r"^[^=]*=(.*)$", 1))
    return (
        lines.filter(entry.startswith("Project(") & F.contains("value", F.lit("=")))
        .select("path", fields.alias("f"))
        .filter((F.size("f") >= 2) & F.lower(F.get("f", F.lit(1))).endswith(".csproj"))
        .select(
            F.col("path").alias("solution"), F.get("f", F.lit(0)).alias("name"),
            paths.resolve(paths.parent(F.col("path")), F.get("f", F.lit(1))).alias("path"),
        )
    )


def _local(tag: str) -> str:
    return tag.rsplit(":", 1)[-1]


def parse_project(path: str, text: str) -> dict:
    """One project file. A file that ends early gives what was read."""
    out = {"path": path, "name": None, "sdk_style": False, "target_frameworks": [], "package_refs": [], "project_refs": [], "assembly_refs": [], "error": None}
    stack: list[str] = []
    held: list[str] = []

    def start(tag: str, attrs: dict[str, str]) -> None:
        name, parent = _local(tag), stack[-1].lower() if stack else ""
        if not stack and name.lower() == "project":
            out["sdk_style"] = "Sdk" in attrs
        if parent == "itemgroup" and "Include" in attrs:
            if name == "PackageReference":
                out["package_refs"].append({"name": attrs["Include"], "version": attrs.get("Version"), "private_assets": attrs.get("PrivateAssets")})
            elif name == "ProjectReference":
                out["project_refs"].append(attrs["Include"])
            elif name == "Reference":
                out["assembly_refs"].append(attrs["Include"])
        stack.append(name)
        held.clear()

    def end(tag: str) -> None:
        text = "".join(held).strip()
        held.clear()
        name = stack.pop()
        if stack and stack[-1].lower() == "propertygroup" and text:
            if name == "TargetFramework":
                out["target_frameworks"].append(text)
            elif name == "TargetFrameworks":
                out["target_frameworks"] += [x.strip() for x in text.split(";") if x.strip()]
            elif name == "AssemblyName":
                out["name"] = text

    try:
        _read(text, start, end, held)
    except expat.ExpatError as e:
        out["error"] = str(e)
    out["name"] = out["name"] or path.rsplit("/", 1)[-1].rsplit(".", 1)[0] or "unknown"
    return out


def _read(text: str, start, end, held: list[str]) -> None:
    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, held.append
    try:
        parser.Parse(text.removeprefix("﻿").encode("utf-8", "replace"), True)
    except expat.ExpatError as e:
        if e.code not in (expat.errors.codes[expat.errors.XML_ERROR_NO_ELEMENTS], expat.errors.codes[expat.errors.XML_ERROR_UNCLOSED_TOKEN]):
            raise


def parse_central(path: str, text: str) -> dict:
    """A file of central package versions: each ``PackageVersion`` with a name and a version, at any depth."""
    entries: list[dict] = []

    def start(tag: str, attrs: dict[str, str]) -> None:
        if _local(tag) == "PackageVersion" and "Include" in attrs and "Version" in attrs:
            entries.append({"name": attrs["Include"], "version": attrs["Version"], "ord": len(entries)})

    error = None
    try:
        _read(text, start, lambda tag: None, [])
    except expat.ExpatError as e:
        error = str(e)
    return {"path": path, "entries": entries, "error": error}


def _each(parse):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([parse(p, t or "") for p, t in zip(b["path"], b["text"], strict=True)])

    return run


def parse_projects(files: DataFrame) -> DataFrame:
    """Project files ``path, text`` with what they hold; ``error`` says why a file could not be read to its end."""
    return files.select("path", "text").mapInPandas(_each(parse_project), PROJECT_SCHEMA)


def parse_central_versions(files: DataFrame) -> DataFrame:
    """``props_dir, name, version, ord`` of central version files ``path, text``."""
    parsed = files.select("path", "text").mapInPandas(_each(parse_central), CENTRAL_SCHEMA)
    return parsed.select(paths.parent(F.col("path")).alias("props_dir"), F.explode("entries").alias("e")).select("props_dir", "e.*")


def project_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """The canonical tables of parsed project files, keyed by ``project``, the file's path."""
    ok = parsed.filter("error is null").withColumn("project", F.col("path"))
    each = lambda c: ok.select("project", F.posexplode(c).alias("ord", "x"))
    folder = paths.parent(F.col("project"))
    return {
        "projects": ok.select("project", "path", "name", "sdk_style", "target_frameworks", paths.path_id(F.col("path")).alias("project_id")),
        "package_refs": each("package_refs").select("project", "x.name", "x.version", "x.private_assets", "ord"),
        "project_refs": each("project_refs").select("project", paths.resolve(folder, F.col("x")).alias("target_path"), "ord"),
        "assembly_refs": each("assembly_refs").select("project", F.col("x").alias("raw_include"), "ord"),
    }
