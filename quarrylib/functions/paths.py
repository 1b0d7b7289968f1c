"""Columns over paths, with ``/`` between their parts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def fold(path: Column) -> Column:
    """``.`` and ``..`` and empty parts resolved by text alone; a leading ``/`` stays, ``..`` above it goes."""
    parts = F.filter(F.split(slashed(path), "/"), lambda p: ~p.isin("", "."))
    rooted = slashed(path).startswith("/")

    def step(acc: Column, p: Column) -> Column:
        back = (p == "..") & (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1) != "..")
        drop = (p == "..") & (F.size(acc) == 0) & rooted
        return F.when(back, F.slice(acc, F.lit(1), F.size(acc) - 1)).when(drop, acc).otherwise(F.concat(acc, F.array(p)))

    done = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(done, "/"))


def parent(path: Column) -> Column:
    """Without the last part; empty if there's one part."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]*)$", 1))


def resolve(base_dir: Column, path: Column) -> Column:
    """A path, relative to a folder unless it is absolute, folded."""
    p = slashed(path)
    return fold(F.when(p.startswith("/") | (base_dir == ""), p).otherwise(F.concat(base_dir, F.lit("/"), p)))


def relative(path: Column, root: str) -> Column:
    """Without the root in front; other paths as they are."""
    r = root.rstrip("/") + "/"
    return F.when(path.startswith(r), F.substring(path, F.lit(len(r) + 1), F.length(path))).otherwise(path)


def path_id(path: Column) -> Column:
    """An id that doesn't mind case or the kind of slash."""
    return F.xxhash64(F.lower(slashed(path)))


def ancestors(path: Column) -> Column:
    """All folders above a path, the root as an empty string, deepest last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def is_build_output(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda p: F.lower(p).isin("bin", "obj"))


def area(path: Column) -> Column:
    """The first folder of a path under the scan's root, one named src, source or sources left out; ``root`` if there is none."""
    dirs = F.split(path, "/")
    dirs = F.when(path.endswith(".csproj"), F.slice(dirs, F.lit(1), F.size(dirs) - 1)).otherwise(dirs)
    first = F.coalesce(F.get(dirs, F.lit(0)), F.lit(""))
    skip = F.lower(first).isin("src", "source", "sources")
    got = F.when(skip, F.get(dirs, F.lit(1))).otherwise(F.get(dirs, F.lit(0)))
    return F.when(path.startswith("/"), "unmapped").otherwise(F.coalesce(F.nullif(got, F.lit("")), F.lit("root")))


def area_root(path: Column) -> Column:
    """The folder that ``area`` names."""
    dirs = F.split(parent(path), "/")
    skip = F.lower(F.get(dirs, F.lit(0))).isin("src", "source", "sources")
    return F.array_join(F.slice(dirs, F.lit(1), F.when(skip, 2).otherwise(1)), "/")


GLOB = re.compile(r"[*?\[{]")


def glob_to_regex(glob: str) -> str:
    """A glob as a regular expression for whole paths: ``*`` and ``?`` cross ``/``, with classes and alternatives."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out += "(?:.*/)?"
            i += 2
        elif c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError("unclosed character class")
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = end
        elif c == "{":
            depth += 1
            out += "(?:"
        elif c == "}" and depth:
            depth -= 1
            out += ")"
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise ValueError("unclosed alternatives")
    return f"^{out}$"
