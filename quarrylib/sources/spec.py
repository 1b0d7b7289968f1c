"""Hand-written specifications: areas and rules between them, as YAML."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

RULES = "area string, allow array<string>, deny array<string>, ord long"
AREAS_STUB = "# area: [path or glob, ...]\n"
RULES_STUB = "# - area: name\n#   allow: [names]   # all others are forbidden\n#   deny: [names]\n"


def _load(text: str):
    import yaml

    return yaml.safe_load(text)


def _text(path: str) -> str:
    if not os.path.exists(path):
        return ""
    with open(path, encoding="utf-8") as f:
        return f.read()


def areas(path: str) -> dict[str, list[str]]:
    """``area: entries``, under a key ``areas`` or not; without a file none."""
    got = _load(_text(path)) or {}
    got = got.get("areas", got) or {}
    return {str(k): [str(x) for x in v or []] for k, v in got.items()}


def rules(path: str) -> list[tuple]:
    got = _load(_text(path)) or []
    got = (got.get("rules") or []) if isinstance(got, dict) else got
    return [(str(r["area"]), r.get("allow"), r.get("deny"), i) for i, r in enumerate(got)]


def rules_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, RULES)


def seed(root: str, folder: str = ".quarry") -> list[str]:
    """Makes the folder for specifications and results, with empty specifications; those there are stay."""
    made = []
    for name, text in (("spec/areas.yaml", AREAS_STUB), ("spec/rules.yaml", RULES_STUB), (".gitignore", "gen/\ncache/\n")):
        path = os.path.join(root, folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        if not os.path.exists(path):
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
            made.append(path)
    os.makedirs(os.path.join(root, folder, "gen"), exist_ok=True)
    return made
