"""Line deduplication: lines that several documents hold stay in one of them only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, id_key, lower_az, spread_join, table, text_or_empty


def line_key(line: Column) -> Column:
    return lower_az(F.btrim(line, F.lit(SPACES)))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2
) -> DataFrame:
    """Drop repeated lines; ``docs`` with its text replaced, and ``n_lines`` and ``n_dropped``.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased. A key of at least
    ``min_chars`` code points in at least ``min_docs`` different ids loses all its lines but those
    of the smallest id. The rest is joined again in its order.

    A null or empty text is one empty line and stays empty. Rows of a null id count as one document
    that sorts first. Rows of one id count as one document, and each is returned. An empty table
    gives none. Columns named ``n_lines`` or ``n_dropped`` are replaced; others pass through.

    Keys move as two 64-bit hashes, counted from (key, id) pairs that are distinct, so a line that
    most documents hold is summed before it meets; lines join that table by an equi-join that deals both
    sides anew, so that Spark may split a hot line. Texts move once, to meet the positions of their dropped lines.
    """
    base = docs.withColumns(
        {
            "_ld_id": id_key(F.col(id_col)),
            "_ld_text": text_or_empty(F.col(text_col)),
            "_ld_hash": F.xxhash64(text_or_empty(F.col(text_col))),
        }
    )
    lines = (
        base.select("_ld_id", "_ld_hash", F.posexplode(F.split("_ld_text", "\n", -1)).alias("pos", "line"))
        .select("_ld_id", "_ld_hash", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("_ld_id", "_ld_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))
    )
    repeated = (
        lines.groupBy("h1", "h2", "_ld_id")
        .agg(F.lit(1))
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.min("_ld_id").alias("keeper"))
        .filter(F.col("n") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    drops = (
        spread_join(lines, repeated, ["h1", "h2"])
        .filter(F.col("_ld_id") != F.col("keeper"))
        .groupBy("_ld_id", "_ld_hash")
        .agg(F.collect_set("pos").alias("_ld_drop"))
    )
    parts = F.split("_ld_text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_ld_drop"))
    return (
        base.join(drops, ["_ld_id", "_ld_hash"], "left")
        .withColumns(
            {
                text_col: F.when(
                    F.col("_ld_drop").isNotNull(),
                    F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"),
                ).otherwise(F.col("_ld_text")),
                "n_lines": F.size(parts).cast("long"),
                "n_dropped": F.when(F.col("_ld_drop").isNull(), 0).otherwise(F.size("_ld_drop")).cast("long"),
            }
        )
        .drop("_ld_id", "_ld_hash", "_ld_text", "_ld_drop")
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, r.keeper IS NOT NULL AND r.keeper <> k.doc_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
