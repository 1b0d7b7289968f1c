"""Benchmark decontamination: words of documents inside n-grams of a benchmark. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_key, lower_az, table, text_or_empty

#: What separates words once A-Z are lower-cased: all of ASCII but digits and a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = 10
#: A benchmark of up to so many windows is broadcast (a window is a hash, a few words and ids); a
#: larger one is joined by a shuffle of the hashes.
BROADCAST_WINDOWS = 200_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_az(text_or_empty(text)), SEPARATORS), lambda w: w != "")


def windows_of(words: Column, n: int) -> Column:
    """All runs of ``n`` words, as structs of 1-based start, hash and n; none if there are fewer."""
    last = F.size(words) - n + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts,
        lambda i: F.struct(i.alias("start"), F.xxhash64(F.slice(words, i, n)).alias("hash"), F.lit(n).alias("len")),
    )


def benchmark_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", n: int = WORDS) -> DataFrame:
    """``hash, window, len, items``: each different window once, with the ids of its items as strings.

    An item of fewer words, but not none, is one window. A null id counts as the text ``null``.
    """
    words = items.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), words_of(F.col(text_col)).alias("words")
    ).filter(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(n))
    return (
        words.select("item", "words", F.explode(F.sequence(F.lit(1), F.size("words") - size + 1)).alias("i"), size.alias("len"))
        .select("item", F.slice("words", F.col("i"), F.col("len")).alias("window"), "len")
        .groupBy("window", "len")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .select(F.xxhash64("window").alias("hash"), "window", "len", "items")
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = WORDS,
) -> DataFrame:
    """``docs`` with ``n_words, n_hit, n_items, items, hits, contaminated``.

    A document word inside any occurrence of a window of the benchmark is hit; ``hits`` are the runs
    of hit words (start from 1, end inclusive, sorted, joined where they meet), ``items`` the sorted
    ids of the items with an occurring window. Null or wordless texts have no words and no hits; so
    has an empty benchmark. Rows of one id are judged each by its own text. Columns named as the new
    ones are replaced.

    Windows of the documents meet the benchmark's by their 64-bit hash, by broadcast while the benchmark
    is of a checked size; words are compared after that, for the few documents with a candidate only.
    """
    names = {"n_words", "n_hit", "n_items", "items", "hits", "contaminated"}
    base = docs.drop(*[c for c in docs.columns if c.lower() in names]).withColumns(
        {"_dc_id": id_key(F.col(id_col)), "_dc_hash": F.xxhash64(text_or_empty(F.col(text_col)))}
    )
    bench = benchmark_windows(items, item_col, item_text_col, n).persist()
    lengths, count = sorted(r[0] for r in bench.select("len").distinct().collect()), bench.count()
    small = count <= BROADCAST_WINDOWS
    hint = F.broadcast if small else (lambda df: df)

    # the scan: words of a text are made once and serve every length of window
    worded = base.select("_dc_id", "_dc_hash", words_of(F.col(text_col)).alias("words"))
    found = None
    if lengths:
        scans = F.concat(*[windows_of(F.col("words"), k) for k in lengths])
        scanned = worded.select("_dc_id", "_dc_hash", F.explode(scans).alias("w")).select(
            "_dc_id", "_dc_hash", "w.start", "w.hash", "w.len"
        )
        candidates = scanned.join(hint(bench.select("hash", "len").distinct()), ["hash", "len"], "left_semi")
        per_doc = candidates.groupBy("_dc_id", "_dc_hash").agg(F.collect_set(F.struct("start", "len", "hash")).alias("at"))
        # verify: the words themselves
        checked = (
            base.select("_dc_id", "_dc_hash", F.col(text_col).alias("text"))
            .join(per_doc, ["_dc_id", "_dc_hash"])
            .select("_dc_id", "_dc_hash", words_of(F.col("text")).alias("words"), "at")
            .select("_dc_id", "_dc_hash", F.explode(F.transform("at", lambda w: F.struct(
                w["start"].alias("start"), w["len"].alias("len"), w["hash"].alias("hash"),
                F.slice(F.col("words"), w["start"], w["len"]).alias("window")))).alias("w"))
            .select("_dc_id", "_dc_hash", "w.*")
            .join(hint(bench), ["hash", "len", "window"])
        )
        spans = checked.groupBy("_dc_id", "_dc_hash").agg(
            F.array_sort(F.collect_set(F.struct(F.col("start"), (F.col("start") + F.col("len") - 1).alias("end")))).alias("at"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
        found = spans.select("_dc_id", "_dc_hash", "items", merged(F.col("at")).alias("hits"))
    counted = base.withColumn("n_words", F.size(words_of(F.col(text_col))).cast("long"))
    if found is None:
        kind = "array<struct<start:int,end:int>>"
        out = counted.withColumns({"items": F.lit(None).cast("array<string>"), "hits": F.lit(None).cast(kind)})
    else:
        out = counted.join(found, ["_dc_id", "_dc_hash"], "left")
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"] + 1)
    return out.withColumns(
        {
            "n_hit": F.coalesce(hit, F.lit(0).cast("long")),
            "items": F.coalesce("items", F.array().cast("array<string>")),
            "contaminated": F.coalesce(hit, F.lit(0)) > 0,
        }
    ).withColumn("n_items", F.size("items").cast("long")).drop("_dc_id", "_dc_hash")


def merged(spans: Column) -> Column:
    """Sorted spans with those joined that overlap or touch, in one pass that keeps the open one apart."""
    kind = "struct<done:array<struct<start:int,end:int>>,start:int,end:int>"
    none = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("done"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))

    def step(a: Column, s: Column) -> Column:
        opened = F.array(F.struct(a["start"].alias("start"), a["end"].alias("end")))
        return (
            F.when(a["start"].isNull(), F.struct(a["done"].alias("done"), s["start"].alias("start"), s["end"].alias("end")))
            .when(s["start"] <= a["end"] + 1, F.struct(a["done"].alias("done"), a["start"].alias("start"), F.greatest(a["end"], s["end"]).alias("end")))
            .otherwise(F.struct(F.concat(a["done"], opened).alias("done"), s["start"].alias("start"), s["end"].alias("end")))
            .cast(kind)
        )

    def finish(a: Column) -> Column:
        return F.when(a["start"].isNull(), a["done"]).otherwise(
            F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end"))))
        )

    return F.aggregate(spans, none.cast(kind), step, finish)


def drop_contaminated(docs: DataFrame, items: DataFrame, min_hit: int = 1, **options) -> DataFrame:
    """``docs`` without the rows that have ``min_hit`` hit words or more; same columns."""
    marked = contamination(_boxed(docs, options), items, **_inner(options))
    return marked.filter(F.col("n_hit") < min_hit).select("row.*")


def remove_hits(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` with the hit words, and the separators after each, cut from the texts; same columns.

    What stands before a text's first word stays. Texts without a hit are unchanged, null included.
    """
    text_col = options.get("text_col", "text")
    marked = contamination(_boxed(docs, options), items, **_inner(options))
    pieces = F.regexp_extract_all(F.col("text"), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    head = F.regexp_extract("text", r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    kept = F.array_except(
        F.sequence(F.lit(1), F.size(pieces)), F.flatten(F.transform("hits", lambda s: F.sequence(s["start"], s["end"])))
    )
    cut = F.concat(head, F.array_join(F.transform(kept, lambda i: F.get(pieces, i - 1)), ""))
    return marked.select(
        F.col("row").withField(f"`{text_col}`", F.when(F.col("contaminated"), cut).otherwise(F.col("text"))).alias("row")
    ).select("row.*")


def _boxed(docs: DataFrame, options: dict) -> DataFrame:
    """Columns of the input apart from the operator's, so that names can't clash."""
    return docs.select(
        F.col(options.get("id_col", "doc_id")).alias("id"), F.col(options.get("text_col", "text")).alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )


def _inner(options: dict) -> dict:
    return options | {"id_col": "id", "text_col": "text"}


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
iw AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
iw2 AS (SELECT item, words, least(len(words), 10) AS n FROM iw WHERE len(words) > 0),
iw3 AS (SELECT item, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM iw2),
win AS (SELECT DISTINCT item, n, array_to_string(words[i : i + n - 1], ' ') AS w FROM iw3),
lens AS (SELECT DISTINCT n FROM win),
ds AS (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM dw, lens WHERE len(words) >= n),
hit AS (SELECT ds.doc_id, ds.i, ds.n, win.item FROM ds JOIN win ON win.n = ds.n AND win.w = array_to_string(ds.words[ds.i : ds.i + ds.n - 1], ' ')),
pos AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
