"""Session settings and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "quarrylib", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` overrides (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that the driver and all executors see.

    It is the one the cluster names in ``spark.checkpoint.dir``. Where that is unset a local session,
    as in tests, makes a folder and names it there; on a cluster executors would not see each other's.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("name a folder that the driver and all executors share in spark.checkpoint.dir")
        where = "file://" + tempfile.mkdtemp(prefix="quarrylib-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def durable(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts the lineage; unlike a cache it survives the loss of executors. The table is deleted when the
    application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def drop_durable(df: DataFrame) -> None:
    """Delete the table behind a result of ``durable`` that nothing will read again."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left.join(right, keys)`` that Spark can split where a key is hot.

    Adaptive execution splits only shuffles that lie directly under a join. A side that was aggregated by
    the same keys would keep that dealing, without a shuffle of its own; a further key, a hash of the
    others, has both sides dealt anew.
    """
    dealt = F.xxhash64(*keys)
    return left.withColumn("_dealt", dealt).join(right.withColumn("_dealt", dealt), [*keys, "_dealt"], how).drop("_dealt")
