"""Columns over names, namespaces and packages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BUILTIN_NAMESPACES = ("System", "Microsoft.CSharp", "Microsoft.VisualBasic", "Microsoft.Win32", "Windows", "Internal")
TOOL_PACKAGES = (
    "Microsoft.NET.Test.Sdk", "MSTest.TestAdapter", "NUnit3TestAdapter", "xunit.runner.visualstudio", "xunit.runner.console",
    "NunitXml.TestLogger", "JUnitTestLogger", "coverlet.collector", "coverlet.msbuild", "ReportGenerator",
)
TOOL_PREFIXES = ("Microsoft.CodeAnalysis.", "StyleCop.")
RUNTIME_SHIMS = (
    "System.Buffers", "System.Memory", "System.Numerics.Vectors", "System.Reflection.Metadata",
    "System.Runtime.CompilerServices.Unsafe", "System.Threading.Tasks.Extensions", "System.ValueTuple", "System.Collections.Immutable",
)
PACKAGE_NAMESPACES = {
    "Newtonsoft.Json": "Newtonsoft.Json",
    "Serilog": "Serilog",
    "Serilog.AspNetCore": "Serilog",
    "Microsoft.Extensions.DependencyInjection": "Microsoft.Extensions.DependencyInjection",
    "Microsoft.Extensions.Logging": "Microsoft.Extensions.Logging",
    "Microsoft.Extensions.Configuration": "Microsoft.Extensions.Configuration",
    "Microsoft.Extensions.Hosting": "Microsoft.Extensions.Hosting",
    "Microsoft.EntityFrameworkCore": "Microsoft.EntityFrameworkCore",
    "AutoMapper": "AutoMapper",
    "FluentValidation": "FluentValidation",
    "MediatR": "MediatR",
    "Dapper": "Dapper",
    "NUnit": "NUnit.Framework",
    "NUnit3TestAdapter": "NUnit.Framework",
    "xunit": "Xunit",
    "xunit.core": "Xunit",
    "MSTest.TestFramework": "Microsoft.VisualStudio.TestTools.UnitTesting",
    "Moq": "Moq",
}


def within(ns: Column, prefix: Column | str) -> Column:
    """Whether a namespace is ``prefix`` or lies under it."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (ns == p) | ns.startswith(F.concat(p, F.lit(".")))


def is_builtin(ns: Column) -> Column:
    out = within(ns, BUILTIN_NAMESPACES[0])
    for p in BUILTIN_NAMESPACES[1:]:
        out = out | within(ns, p)
    return out


def is_tool_package(name: Column, private_assets: Column | None = None) -> Column:
    """Packages that serve a build and show in no using directive."""
    out = name.isin(*TOOL_PACKAGES, *RUNTIME_SHIMS)
    for p in TOOL_PREFIXES:
        out = out | name.startswith(p)
    if private_assets is not None:
        out = out | F.coalesce(F.lower(private_assets) == "all", F.lit(False))
    return out


def package_namespace(package: Column) -> Column:
    """The namespace a package brings: a known one, else the package's own name."""
    out = F.when(F.lit(False), package)
    for name, ns in PACKAGE_NAMESPACES.items():
        if name != ns:
            out = out.when(package == name, F.lit(ns))
    return out.otherwise(package)


def is_test_like(name: Column) -> Column:
    """Whether a dotted segment ends in test, tests, testing or installer."""
    return name.rlike(r"(?i)(test|tests|testing|installer)(\.|$)")


def dotted_prefixes(name: Column) -> Column:
    """``a.b.c`` gives ``[a, a.b, a.b.c]``."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def simple_name(fqn: Column) -> Column:
    return F.substring_index(fqn, ".", -1)


def namespace_part(fqn: Column) -> Column:
    """All before the last dot, empty without one."""
    return F.when(F.instr(fqn, ".") > 0, F.regexp_extract(fqn, r"^(.*)\.[^.]*$", 1)).otherwise("")


def matches_type(local: Column, query: Column) -> Column:
    return (local == query) | (simple_name(local) == query)


def attribute_name(attribute: Column) -> Column:
    return F.substring_index(attribute, "(", 1)


def has_attribute(attributes: Column, *names: str) -> Column:
    return F.exists(attributes, lambda a: attribute_name(a).isin(*names))


def has_base(bases: Column, *names: str) -> Column:
    return F.exists(bases, lambda b: b.isin(*names))


def first_quoted(attribute: Column) -> Column:
    """The first quoted argument of ``Name(... 'x' ...)``; null without one."""
    got = F.regexp_extract(attribute, r"^[^(]*\([^']*'([^']*)'.*\)$", 1)
    return F.when(attribute.rlike(r"(?s)^[^(]*\([^']*'[^']*'.*\)$"), got)


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))
