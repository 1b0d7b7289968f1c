"""The canonical tables, made from the star schema of the test data, in Spark and as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables:
    """Each method reads the columns it needs; nothing is cached."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def projects(self) -> DataFrame:
        name = F.concat(
            F.when(F.col("p_size") % 5 != 0, "Acme.Core.").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"),
            F.col("p_size").cast("string"), F.when(F.col("p_size") % 7 == 0, ".Tests").otherwise(""),
        )
        path = F.concat(F.lit("src/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".csproj"))
        return self.read("part").select(F.col("p_partkey").alias("project"), name.alias("name"), path.alias("path"), F.col("p_size").cast("long").alias("loc"))

    def nodes(self) -> DataFrame:
        return self.read("part").select(F.col("p_partkey").alias("node"))

    def _pairs(self, ordered) -> DataFrame:
        line = self.read("lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber")
        a = line.toDF("l_orderkey", "l_suppkey", "src", "n")
        b = line.toDF("l_orderkey", "l_suppkey", "dst", "m")
        return a.join(b, ["l_orderkey", "l_suppkey"]).filter(ordered).select("src", "dst").distinct()

    def dag(self) -> DataFrame:
        return self._pairs(F.col("src") > F.col("dst"))

    def cyc(self) -> DataFrame:
        return self._pairs(F.col("n") < F.col("m"))

    def package_refs(self) -> DataFrame:
        rows = self.read("lineitem").filter(F.col("l_quantity") == 50)
        return rows.select(
            F.col("l_suppkey").alias("project"), F.col("l_partkey").cast("string").alias("name"), F.col("l_returnflag").alias("version"),
            F.when(F.col("l_linestatus") == "F", "all").alias("private_assets"),
        ).distinct()

    def types(self) -> DataFrame:
        return self.read("lineitem").select(
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("project"), F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("fqn"),
            F.col("l_quantity").cast("long").alias("loc"), F.lit(1).cast("long").alias("members"), F.col("l_linenumber").cast("long").alias("complexity"),
        )

    def methods(self) -> DataFrame:
        return self.read("lineitem").select(
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("project"), F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("fqn"),
            F.concat(F.lit("M"), F.col("l_partkey").cast("string")).alias("name"), F.col("l_linenumber").cast("long").alias("line_start"),
            F.col("l_quantity").cast("long").alias("loc"), F.col("l_linenumber").cast("long").alias("complexity"),
        )

    def usings(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int") % 5
        return self.read("events").select(F.col("user_id").alias("project"), F.concat("event_type", F.lit(".K"), k.cast("string")).alias("ns")).distinct()

    def declared(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int") % 5
        rows = self.read("events").filter(F.col("value") > 20)
        prefix = F.when(F.col("value") > 50, F.col("event_type")).otherwise(F.concat("event_type", F.lit(".K"), k.cast("string")))
        return rows.select(F.col("user_id").alias("project"), prefix.alias("prefix")).distinct()

    def catalog(self) -> DataFrame:
        return self.read("part").select(
            F.col("p_brand").alias("project"), F.concat("p_name", F.lit("_"), F.col("p_size").cast("string")).alias("simple")
        ).distinct()

    def referenced(self) -> DataFrame:
        line = self.read("lineitem").filter(F.col("l_quantity") >= 45).select("l_partkey", "l_suppkey", "l_linenumber")
        part = self.read("part").select("p_partkey", "p_name", "p_size")
        return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 25 + 1).cast("string")).alias("project"),
            F.concat("p_name", F.lit("_"), (F.col("p_size") + F.col("l_linenumber") % 2).cast("string")).alias("simple"),
        ).distinct()

    def endpoint_types(self) -> DataFrame:
        """Parts as types: the type of a part gives its attribute, its size its base and kind."""
        p = F.col("p_type")
        attribute = (
            F.when(p == "STANDARD", F.concat(F.lit("Route('api/"), "p_brand", F.lit("')"))).when(p == "LARGE", "ApiController").when(p == "SMALL", "ServiceContract")
            .when(p == "ECONOMY", "Authorize(Roles = 'x')").when(p == "MEDIUM", F.concat(F.lit("RoutePrefix('v"), F.col("p_size").cast("string"), F.lit("')"))).otherwise("Serializable")
        )
        bases = F.array(*[F.lit(b) for b in ("ControllerBase", "ClientBase", "Hub", "MarshalByRefObject", "Thing")])
        return self.read("part").select(
            F.col("p_brand").alias("project"), F.concat(F.lit("Ns.T"), F.col("p_partkey").cast("string")).alias("fqn"),
            F.when(F.col("p_size") % 3 == 0, "interface").otherwise("class").alias("kind"),
            F.array(attribute).alias("attributes"), F.array(F.get(bases, F.col("p_size") % 5)).alias("bases"),
        )

    def endpoint_methods(self) -> DataFrame:
        """Line items as methods of their part's type."""
        n = F.col("l_linenumber") % 5
        attributes = (
            F.when(n == 0, F.array(F.concat(F.lit("HttpGet('{id}/"), F.col("l_linenumber").cast("string"), F.lit("')"))))
            .when(n == 1, F.array(F.lit("HttpPost"), F.lit("Route('add')"))).when(n == 2, F.array(F.lit("OperationContract"), F.lit("Log")))
            .when(n == 3, F.array(F.lit("Authorize"), F.lit("HttpDelete"))).otherwise(F.array().cast("array<string>"))
        )
        line = self.read("lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey").distinct()
        part = self.read("part").select("p_partkey", "p_brand")
        return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("p_brand").alias("project"), F.concat(F.lit("Ns.T"), F.col("l_partkey").cast("string")).alias("fqn"),
            F.concat(F.lit("M"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_suppkey").cast("string")).alias("name"), F.col("l_linenumber").cast("long").alias("line_start"),
            attributes.alias("attributes"),
            F.array(F.concat(F.lit("D"), (F.col("l_suppkey") % 7).cast("string")), F.concat(F.lit("T"), F.col("l_partkey").cast("string"))).alias("signature_types"),
        )

    def partial_types(self) -> DataFrame:
        """Line items of an order and flag as the parts of one type."""
        return self.read("lineitem").select(
            F.col("l_returnflag").alias("project"), F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("fqn"),
            F.col("l_linenumber").alias("file_ord"), F.concat_ws("_", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("pos"),
            F.col("l_quantity").cast("long").alias("loc"), F.lit(1).cast("long").alias("members"), F.col("l_linenumber").cast("long").alias("complexity"),
            F.array(F.concat(F.lit("B"), (F.col("l_partkey") % 4).cast("string"))).alias("bases"), F.array(F.col("l_linestatus")).alias("attributes"),
            F.array(F.concat(F.lit("R"), (F.col("l_suppkey") % 9).cast("string"))).alias("referenced_types"),
        )


# ---------------------------------------------------------------- the same as SQL

PROJ = """proj AS (SELECT p_partkey AS project, (CASE WHEN p_size % 5 <> 0 THEN 'Acme.Core.' ELSE '' END) || replace(p_name, ' ', '_') || '_' || p_size
  || (CASE WHEN p_size % 7 = 0 THEN '.Tests' ELSE '' END) AS name, 'src/' || p_brand || '/' || p_partkey || '.csproj' AS path, p_brand AS brand, p_size::BIGINT AS loc FROM part)"""
DAG = """dag AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey WHERE a.l_partkey > b.l_partkey)"""
CYC = """cyc AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey WHERE a.l_linenumber < b.l_linenumber)"""
PKG = """pkg AS (SELECT DISTINCT l_suppkey AS project, l_partkey::VARCHAR AS name, l_returnflag AS version,
  CASE WHEN l_linestatus = 'F' THEN 'all' END AS private_assets FROM lineitem WHERE l_quantity = 50)"""
USE = """use AS (SELECT DISTINCT user_id AS project, event_type || '.K' || (regexp_extract(props, '"k": *([0-9]+)', 1)::INT % 5) AS ns FROM events)"""
DECL = """decl AS (SELECT DISTINCT user_id AS project, CASE WHEN value > 50 THEN event_type
  ELSE event_type || '.K' || (regexp_extract(props, '"k": *([0-9]+)', 1)::INT % 5) END AS prefix FROM events WHERE value > 20)"""
CATALOG = "catalog AS (SELECT DISTINCT p_brand AS project, p_name || '_' || p_size AS simple FROM part)"
REFD = """refd AS (SELECT DISTINCT 'Brand#' || (l_suppkey % 25 + 1) AS project, p_name || '_' || (p_size + l_linenumber % 2) AS simple
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 45)"""
ETYPES = """etypes AS (SELECT p_brand AS project, 'Ns.T' || p_partkey AS fqn, CASE WHEN p_size % 3 = 0 THEN 'interface' ELSE 'class' END AS kind,
  CASE p_type WHEN 'STANDARD' THEN 'Route(''api/' || p_brand || ''')' WHEN 'LARGE' THEN 'ApiController' WHEN 'SMALL' THEN 'ServiceContract'
    WHEN 'ECONOMY' THEN 'Authorize(Roles = ''x'')' WHEN 'MEDIUM' THEN 'RoutePrefix(''v' || p_size || ''')' ELSE 'Serializable' END AS attribute,
  (['ControllerBase', 'ClientBase', 'Hub', 'MarshalByRefObject', 'Thing'])[p_size % 5 + 1] AS base FROM part)"""
EMETHODS = """emethods AS (SELECT DISTINCT p_brand AS project, 'Ns.T' || l_partkey AS fqn, 'M' || l_orderkey || '_' || l_suppkey AS name, l_linenumber::BIGINT AS line_start,
  l_linenumber % 5 AS m, l_suppkey, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey)"""
EKIND = """ekind AS (SELECT t.*, CASE WHEN attribute = 'ServiceContract' AND kind = 'interface' THEN 'wcf-contract' WHEN base = 'ClientBase' THEN 'wcf-client'
    WHEN attribute = 'ApiController' OR (base = 'ControllerBase' AND h.fqn IS NOT NULL) THEN 'webapi-controller'
    WHEN base = 'Hub' THEN 'signalr-hub' WHEN base = 'MarshalByRefObject' THEN 'remoting' END AS endpoint
  FROM etypes t LEFT JOIN (SELECT DISTINCT project, fqn FROM emethods WHERE m IN (0, 1, 3)) h ON t.project = h.project AND t.fqn = h.fqn)"""
EOFFER = """eoffer AS (SELECT m.*, k.endpoint FROM emethods m JOIN ekind k ON m.project = k.project AND m.fqn = k.fqn
  WHERE k.endpoint = 'signalr-hub' OR (k.endpoint = 'wcf-contract' AND m = 2) OR (k.endpoint = 'webapi-controller' AND m IN (0, 1, 3)))"""
REACH = "reach(src, dst) AS (SELECT src, dst FROM {e} UNION SELECT r.src, e.dst FROM reach r JOIN {e} e ON r.dst = e.src)"
#: Component of each node of ``cyc``: the least node that it reaches and that reaches it, itself without a cycle.
SCC = """scc AS (SELECT p_partkey AS node, least(p_partkey, coalesce(min(a.dst), p_partkey)) AS component, count(a.dst) > 0 AS cyclic
  FROM part LEFT JOIN (SELECT x.src, x.dst FROM reach x JOIN reach y ON x.src = y.dst AND x.dst = y.src) a ON a.src = p_partkey GROUP BY p_partkey)"""
COND = """cond AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM cyc JOIN scc a ON a.node = src JOIN scc b ON b.node = dst WHERE a.component <> b.component),
path(src, n) AS (SELECT DISTINCT component, 0 FROM scc UNION SELECT c.src, p.n + 1 FROM cond c JOIN path p ON c.dst = p.src),
lay AS (SELECT s.node, max(p.n)::BIGINT AS layer FROM scc s JOIN path p ON p.src = s.component GROUP BY s.node)"""
DAGLAY = """path(src, n) AS (SELECT p_partkey, 0 FROM part UNION SELECT d.src, p.n + 1 FROM dag d JOIN path p ON d.dst = p.src),
lay AS (SELECT src AS node, max(n)::BIGINT AS layer FROM path GROUP BY src)"""
TESTLIKE = r"regexp_matches({0}, '(?i)(test|tests|testing|installer)(\.|$)')"
