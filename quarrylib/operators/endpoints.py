"""Remote endpoints: which types serve or call them, how, and who uses them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylib.functions import names

# Fixed values.
VERBS = {
    "HttpGet": "GET",
    "HttpPost": "POST",
    "HttpPut": "PUT",
    "HttpDelete": "DELETE",
    "HttpPatch": "PATCH",
    "HttpHead": "HEAD",
    "HttpOptions": "OPTIONS",
}
CONSUMED = ("ServiceContract", "OperationContract", "ApiController", "Route", "RoutePrefix", *VERBS)
CONTROLLERS = ("ControllerBase", "Controller", "ApiController")


def endpoint_kind(kind: Column, attributes: Column, bases: Column, any_http: Column) -> Column:
    """What kind of endpoint a type is, the first that fits, or null."""
    return (
        F.when(names.has_attribute(attributes, "ServiceContract") & (kind == "interface"), "wcf-contract")
        .when(names.has_base(bases, "ClientBase"), "wcf-client")
        .when(names.has_attribute(attributes, "ApiController") | (names.has_base(bases, *CONTROLLERS) & any_http), "webapi-controller")
        .when(names.has_base(bases, "Hub"), "signalr-hub")
        .when(names.has_base(bases, "MarshalByRefObject"), "remoting")
    )


def first_argument(attributes: Column, *wanted: str) -> Column:
    """The first quoted argument of the first attribute of some names."""
    return names.first_quoted(F.get(F.filter(attributes, lambda a: names.attribute_name(a).isin(*wanted)), F.lit(0)))


def verb(attributes: Column) -> Column:
    first = names.attribute_name(F.get(F.filter(attributes, lambda a: names.attribute_name(a).isin(*VERBS)), F.lit(0)))
    out = F.when(F.lit(False), F.lit(""))
    for name, v in VERBS.items():
        out = out.when(first == name, v)
    return out


def extras(attributes: Column) -> Column:
    """Attributes that say nothing about the endpoint, sorted, each once."""
    return F.array_sort(F.array_distinct(F.filter(attributes, lambda a: ~names.attribute_name(a).isin(*CONSUMED))))


def classify(types: DataFrame, methods: DataFrame) -> DataFrame:
    """``project, fqn, endpoint, route`` of ``types(project, fqn, kind, attributes, bases)``."""
    http = methods.groupBy("project", "fqn").agg(F.bool_or(names.has_attribute(F.col("attributes"), *VERBS)).alias("http"))
    joined = types.join(http, ["project", "fqn"], "left")
    kind = endpoint_kind(F.col("kind"), F.col("attributes"), F.col("bases"), F.coalesce("http", F.lit(False)))
    route = F.when(F.col("endpoint") == "webapi-controller", first_argument(F.col("attributes"), "Route", "RoutePrefix"))
    return joined.withColumn("endpoint", kind).filter("endpoint is not null").select("project", "fqn", "endpoint", route.alias("route"))


def endpoint_methods(endpoints: DataFrame, methods: DataFrame) -> DataFrame:
    """``project, fqn, endpoint, name, line_start, verb, route, dtos, extras`` of the methods that an endpoint offers.

    Contracts offer their marked operations, hubs all methods, controllers those with a verb; the
    verb's own route goes before the method's route attribute.
    """
    a = F.col("attributes")
    offered = (
        (F.col("endpoint") == "signalr-hub")
        | ((F.col("endpoint") == "wcf-contract") & names.has_attribute(a, "OperationContract"))
        | ((F.col("endpoint") == "webapi-controller") & names.has_attribute(a, *VERBS))
    )
    web = F.col("endpoint") == "webapi-controller"
    return (
        methods.join(endpoints.select("project", "fqn", "endpoint"), ["project", "fqn"])
        .filter(offered)
        .select(
            "project", "fqn", "endpoint", "name", "line_start", F.when(web, verb(a)).alias("verb"),
            F.when(web, F.coalesce(first_argument(a, *VERBS), first_argument(a, "Route"))).alias("route"),
            F.col("signature_types").alias("dtos"), extras(a).alias("extras"),
        )
    )


def endpoint_dtos(offered: DataFrame) -> DataFrame:
    """``project, fqn, dtos``: the types in an endpoint's signatures but its own, sorted."""
    return offered.groupBy("project", "fqn").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("dtos")))).alias("dtos")).withColumn(
        "dtos", F.array_remove("dtos", names.simple_name(F.col("fqn")))
    )


def endpoint_users(endpoints: DataFrame, mentions: DataFrame) -> DataFrame:
    """``project, fqn, user_project, users``: types that mention an endpoint's simple name, by project.

    ``mentions`` has ``project, fqn, simple``. A mention counts for all endpoints of that name but the type itself.
    """
    e = endpoints.select("project", "fqn", names.simple_name(F.col("fqn")).alias("simple"))
    m = mentions.select(F.col("project").alias("user_project"), F.col("fqn").alias("user_fqn"), "simple")
    found = e.join(m, "simple").filter((F.col("fqn") != F.col("user_fqn")) | (F.col("project") != F.col("user_project")))
    return found.groupBy("project", "fqn", "user_project").agg(F.array_sort(F.collect_set(names.simple_name(F.col("user_fqn")))).alias("users"))
