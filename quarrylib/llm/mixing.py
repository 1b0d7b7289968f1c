"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table, word_count

#: Hexadecimal digits of the random key that name its range.
RANGE_DIGITS = 3


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``rows`` with running ``sums`` in an order without ties, each row's own value included.

    Rows are dealt by ranges of the order and summed inside them; what the ranges before hold is a sum over a
    row for each range. So no task sees all rows.
    """
    values = {f"_rn_{k}": v for k, v in sums.items()}
    dealt = rows.withColumns(values).repartitionByRange(*order).withColumn("_rn_range", F.spark_partition_id())
    dealt = durable(dealt, name)
    totals = dealt.groupBy("_rn_range").agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.orderBy("_rn_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_rn_range", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"{v}_before") for v in values])
    inside = Window.partitionBy("_rn_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = dealt.withColumns({v: F.sum(v).over(inside) for v in values}).join(before, "_rn_range")
    made = joined.withColumns({k: (F.col(v) + F.col(f"{v}_before")).cast("long") for k, v in zip(sums, values, strict=True)})
    return made.drop("_rn_range", *values, *[f"{v}_before" for v in values])


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], epochs: int) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size``, a row for each source.

    Sources by code point, null last, take ``weights`` in turn and share ``share`` (a fraction) of
    all sizes by them. Targets stop at ``epochs`` times their source's size and the excess is dealt
    again by weight until none is above: with sources sorted by cap over weight, those that stop are
    a prefix, found by running sums. All sums are whole numbers; one division gives a target.
    Sources may be as many as rows, so ranks and sums are made by ranges, see ``running``.
    """
    turn = F.array(*[F.lit(w).cast("long") for w in weights])
    up, down = share
    by_name = [F.col("source").isNull().asc(), F.col("source").asc()]
    ranked = running(sizes, by_name, {"_rank": F.lit(1)}, "mix-sources")
    ranked = ranked.withColumn("weight", F.get(turn, ((F.col("_rank") - 1) % len(weights)).cast("int")))
    ranked = ranked.withColumn("_ratio", F.col("source_size") / F.col("weight"))
    sums = running(ranked, [F.col("_ratio"), F.col("_rank")], {"_size_to": F.col("source_size"), "_weight_to": F.col("weight")}, "mix-ratios")
    in_all, weight_of_all = (F.lit(x or 0).cast("long") for x in ranked.agg(F.sum("source_size"), F.sum("weight")).first())
    # a source stops if at its own ratio all before it stop and the rest could not use up the budget;
    # in units of 1/down: left after the caps before this one, against its own cap
    left = in_all * up - (F.col("_size_to") - F.col("source_size")) * (epochs * down)
    rest = weight_of_all - F.col("_weight_to") + F.col("weight")
    stops = left * F.col("weight") >= F.col("source_size") * (epochs * down) * rest
    marked = sums.withColumn("_stops", stops)
    stopped, freed = (F.lit(x or 0).cast("long") for x in marked.filter("_stops").agg(F.sum("source_size"), F.sum("weight")).first())
    budget = in_all * up - stopped * (epochs * down)
    target = F.when(F.col("_stops"), (F.col("source_size") * epochs).cast("double")).otherwise(
        (budget * F.col("weight")).cast("double") / ((weight_of_all - freed) * down).cast("double")
    )
    return marked.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    size: Column,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: tuple[int, int] = (3, 2),
    epochs: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """How much of each row a mix takes: ``docs`` with ``size, source_size, target, taken``.

    Every row gets a random key, the MD5 of its id and ``seed``, so reruns agree. A source is taken
    whole as often as its target (see ``source_targets``) holds it; in the epoch that is left its rows,
    in the order of their keys, are taken up to the exact budget, the row at the cut in part. A
    source's ``taken`` add up to its target rounded down.

    Null texts have size 0 and are never taken; a null source is a source of its own, sorted last.
    Rows of a null id take that of a hash of their columns instead, so that they spread. Equal keys go by size, and rows that are equal in both
    take turns in an arbitrary order, which changes no value. A source of size 0 has target 0; an
    empty table gives none. Columns named as the new ones are replaced.

    The random keys of a source are cut into 4096 ranges. Their sums, made before the shuffle, give
    each range's prefix; rows are sorted and summed in their range alone, so no source, however
    large, meets in one task.
    """
    names = {"size", "source_size", "target", "taken"}
    clean = docs.drop(*[c for c in docs.columns if c.lower() in names])
    source = F.col(source_col).cast("string")
    row = F.xxhash64(*[F.col(f"`{c}`") for c, t in clean.dtypes if "map<" not in t]).cast("string")
    at = ["_mx_source", "_mx_null", "_mx_range"]  # a null source apart from an empty one, by plain equality
    keyed = clean.withColumns(
        {
            "size": size,
            "_mx_source": F.coalesce(source, F.lit("")),
            "_mx_null": source.isNull(),
            "_mx_key": F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("long").cast("string"), F.concat(F.lit("null"), row)))),
        }
    ).withColumn("_mx_range", F.substring("_mx_key", 1, RANGE_DIGITS))
    ranges = durable(keyed.groupBy(at).agg(F.sum("size").alias("n")), "mix-ranges")
    named = F.when(~F.col("_mx_null"), F.col("_mx_source"))
    by_source = ranges.groupBy(named.alias("source")).agg(F.sum("n").alias("source_size"))
    targets = source_targets(by_source, weights, share, epochs).withColumns(
        {"_mx_source": F.coalesce("source", F.lit("")), "_mx_null": F.col("source").isNull()}
    )
    before = Window.partitionBy("_mx_source", "_mx_null").orderBy("_mx_range").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    plan = (
        ranges.join(targets, ["_mx_source", "_mx_null"])
        .withColumns({"_mx_before": F.coalesce(F.sum("n").over(before), F.lit(0)), "_mx_full": full})
        .withColumn("_mx_left", budget - F.col("_mx_full") * F.col("source_size") - F.col("_mx_before"))
        .select(*at, "source_size", "target", "_mx_full", "_mx_left")
    )
    prefix = Window.partitionBy(*at).orderBy("_mx_key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("_mx_left") - (F.sum("size").over(prefix) - F.col("size"))
    out = keyed.join(plan, at).withColumn(
        "taken",
        (F.col("size") * F.col("_mx_full") + F.greatest(F.lit(0), F.least(F.col("size"), left))).cast("long"),
    )
    return out.drop(*[c for c in out.columns if c.startswith("_mx_")])


def mixed_copies(docs: DataFrame, size: Column, **options) -> DataFrame:
    """The mix as rows: each row of ``docs`` as often as the mix takes it; columns as they are.

    A row taken in part is given whole, so a source exceeds its target by less than one row's size. Nulls,
    ties, repeated rows and empty tables are as in ``mix_sources``; a row of size 0, as of a null text, isn't given.
    """
    columns = docs.columns
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(options.get("id_col", "doc_id")).alias("id"),
                         F.col(options.get("source_col", "source")).alias("from"), size.alias("words"))
    mixed = mix_sources(tagged, F.col("words"), **(options | {"id_col": "id", "source_col": "from"}))
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return (
        mixed.withColumn("times", times)
        .filter("times > 0")
        .select("row", F.explode(F.array_repeat(F.lit(0), F.col("times"))))
        .select("row.*")
    )


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    return mix_sources(docs, F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('mix:' || doc_id::VARCHAR) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM s),
w AS (SELECT *, ([3, 1, 2])[((rank - 1) % 3 + 1)::INT]::BIGINT AS weight FROM k),
p AS (SELECT *, sum(source_size) OVER c - source_size AS size_before, sum(weight) OVER c - weight AS weight_before,
             sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
      FROM w WINDOW c AS (ORDER BY source_size / weight, rank ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, (total * 3 - size_before * 4) * weight >= source_size * 4 * (weights - weight_before) AS stops FROM p),
f AS (SELECT *, coalesce(sum(source_size) FILTER (stops) OVER (), 0) AS stopped, coalesce(sum(weight) FILTER (stops) OVER (), 0) AS freed FROM m),
t AS (SELECT source, source_size, CASE WHEN stops THEN (source_size * 2)::DOUBLE
             ELSE ((total * 3 - stopped * 4) * weight)::DOUBLE / ((weights - freed) * 2)::DOUBLE END AS target FROM f),
b AS (SELECT *, floor(target)::BIGINT AS budget,
             CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS full_epochs FROM t),
r AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.full_epochs, b.budget - b.full_epochs * b.source_size AS remainder,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS UNBOUNDED PRECEDING) - d.size AS prefix
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (size * full_epochs + greatest(0, least(size, remainder - prefix)))::BIGINT AS taken FROM r
"""
