"""C# files as tables of facts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import csharp

METHOD = "struct<name:string,line_start:long,line_end:long,loc:long,complexity:long,attributes:array<string>,signature_types:array<string>,signature:string,ord:long>"
TYPE = (
    "struct<kind:string,fqn:string,ord:long,line_start:long,line_end:long,loc:long,members:long,complexity:long,bases:array<string>,"
    f"attributes:array<string>,referenced:array<string>,methods:array<{METHOD}>>"
)
FACTS = f"path string, usings array<string>, namespaces array<string>, types array<{TYPE}>, references array<string>"


def facts(path: str, text: str | None) -> dict:
    f = csharp.parse(text or "")
    types = [
        {
            "kind": t.kind, "fqn": t.fqn, "ord": i, "line_start": t.line_start, "line_end": t.line_end, "loc": t.loc, "members": t.members,
            "complexity": t.complexity, "bases": t.bases, "attributes": t.attributes, "referenced": sorted(set(t.referenced)),
            "methods": [
                {
                    "name": m.name, "line_start": m.line_start, "line_end": m.line_end, "loc": m.loc, "complexity": m.complexity,
                    "attributes": m.attributes, "signature_types": m.signature_types, "signature": m.signature, "ord": k,
                }
                for k, m in enumerate(t.methods)
            ],
        }
        for i, t in enumerate(f.types)
    ]
    return {"path": path, "usings": sorted(set(f.usings)), "namespaces": sorted(set(f.namespaces)), "types": types, "references": sorted(set(f.references))}


def parse_sources(files: DataFrame) -> DataFrame:
    """One row of facts for each file ``path, text``; a file is parsed alone, so this needs no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([facts(p, t) for p, t in zip(b["path"], b["text"], strict=True)], columns=["path", "usings", "namespaces", "types", "references"])

    return files.select("path", "text").mapInPandas(run, FACTS)


def decoded(files: DataFrame) -> DataFrame:
    """``path, text`` of binary files; those that aren't UTF-8 are left out."""
    text = F.col("content").cast("string")
    return files.filter(F.try_validate_utf8(text).isNotNull()).select("path", text.alias("text"))


def source_tables(parsed: DataFrame, owned: DataFrame) -> dict[str, DataFrame]:
    """The canonical tables of parsed files, for the projects that own them (``project, path, file_id``).

    A type's parts add up; its spans and methods keep their files in order; where it has one span, its methods
    name no file.
    """
    from quarrylib.operators.types import merge_partial

    f = owned.join(parsed, "path")
    t = f.select("project", "file_id", "path", F.explode("types").alias("t")).select("project", "file_id", "path", "t.*")
    parts = t.select(
        "project", "fqn", F.col("file_id").alias("file_ord"), F.col("ord").alias("pos"), "loc", "members", "complexity", "bases", "attributes",
        F.col("referenced").alias("referenced_types"),
    )
    spans = t.select("project", "fqn", F.col("ord").alias("pos"), "file_id", "line_start", "line_end")
    single = spans.groupBy("project", "fqn").agg((F.count("*") == 1).alias("single"))
    m = t.select("project", "fqn", "file_id", "path", F.col("ord").alias("pos"), F.explode("methods").alias("m")).select("project", "fqn", "file_id", "path", "pos", "m.*")
    return {
        "usings": f.select("project", F.explode("usings").alias("ns")).distinct(),
        "namespaces": f.select("project", F.explode("namespaces").alias("ns")).distinct(),
        "referenced_types": f.select("project", F.explode("references").alias("simple")).distinct(),
        "declared_types": t.select("project", "kind", "fqn").distinct(),
        "type_metrics": merge_partial(parts),
        "type_spans": spans,
        "methods": m.join(single, ["project", "fqn"]).withColumn("span_file", F.when(~F.col("single"), F.col("file_id"))).drop("single"),
        "mentions": t.select("project", "fqn", F.explode("referenced").alias("simple")).distinct(),
    }
