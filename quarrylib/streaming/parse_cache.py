"""Parsed files kept between runs: only files that changed are parsed again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylib.sources import source_code

#: A cache of another version is not read.
VERSION = 1
KEY = ["path", "mtime", "length"]


def delta(now: DataFrame, before: DataFrame) -> DataFrame:
    """``path, state`` of two snapshots of ``path, mtime, length``: new, changed, same or gone."""
    a = now.select("path", *[F.col(c).alias(f"n_{c}") for c in KEY[1:]], F.lit(True).alias("now"))
    b = before.select("path", *[F.col(c).alias(f"b_{c}") for c in KEY[1:]], F.lit(True).alias("before"))
    same = (F.col("n_mtime") == F.col("b_mtime")) & (F.col("n_length") == F.col("b_length"))
    state = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "gone").when(same, "same").otherwise("changed")
    return a.join(b, "path", "full").select("path", state.alias("state"))


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """What the last finished run kept."""
    from pyspark.errors import AnalysisException

    try:
        last = spark.read.schema("run string, version int, at timestamp").json(f"{folder}/runs").filter(F.col("version") == VERSION)
        newest = last.orderBy(F.desc("at")).limit(1).collect()
        return spark.read.parquet(f"{folder}/{newest[0]['run']}") if newest else None
    except AnalysisException:
        return None


def refresh(files: DataFrame, folder: str) -> DataFrame:
    """The facts of ``files(path, content, mtime, length)``, from the cache where path, time and length are as before.

    A run writes a new table, then its name; one that fails leaves the last in place. Files that are gone
    are left out. Contents are read for the files that are parsed only: the rest drops out by a join on the
    listing.
    """
    spark = files.sparkSession
    kept = current(spark, folder)
    if kept is None:
        out = files.select(*KEY, "content")
        parsed = _parse(out)
    else:
        listing = files.select(*KEY)
        hits = kept.join(listing, KEY, "left_semi")
        misses = files.select(*KEY, "content").join(kept.select(KEY), KEY, "left_anti")
        parsed = hits.unionByName(_parse(misses))
    run = f"run-{uuid.uuid4().hex}"
    parsed.write.parquet(f"{folder}/{run}")
    spark.range(1).select(F.lit(run).alias("run"), F.lit(VERSION).alias("version"), F.current_timestamp().alias("at")).write.mode("append").json(f"{folder}/runs")
    return spark.read.parquet(f"{folder}/{run}").drop("mtime", "length")


def _parse(files: DataFrame) -> DataFrame:
    facts = source_code.parse_sources(source_code.decoded(files))
    return facts.join(files.select(KEY), "path")


def stream(spark: SparkSession, root: str, folder: str, checkpoint: str):
    """A stream of changed files under ``root`` into the table ``folder``, parsed as they come; started with ``.start()``.

    Each batch is one commit; a file that comes again adds a row, and ``latest`` picks the newest.
    """
    raw = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.cs").load(root)
    )

    def batch(df: DataFrame, number: int) -> None:
        found = df.select("path", F.col("modificationTime").alias("mtime"), "length", "content")
        _parse(found).withColumn("batch", F.lit(number)).write.mode("append").parquet(folder)

    return raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def latest(rows: DataFrame) -> DataFrame:
    """The newest facts of each path, by time, then batch."""
    cols = [c for c in rows.columns if c != "path"]
    return rows.groupBy("path").agg(F.max_by(F.struct(*cols), F.struct("mtime", "batch")).alias("r")).select("path", "r.*")
