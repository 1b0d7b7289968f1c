"""Exact top-k search by inner product, with block-at-a-time pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, releasing, table

#: Vectors of a block, and of a shard (the blocks that one task searches), about.
BLOCK, SHARD = 128, 32_768
#: Blocks lie along the nearest of so many centres, from about so many vectors. They steer pruning only.
CENTRES, SAMPLE = 64, 4096


def integers(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, as long; null for vectors that take no part."""
    wide = vector.cast("array<double>")
    whole = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(vector.isNotNull() & whole, F.transform(wide, lambda x: F.floor(x * scale).cast("long")))


def _matrix(rows, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers, as the nearest long: in floating point where all sums are exact there, else as integers."""
    most = np.abs(a.astype(np.float64)).max(initial=0) * np.abs(b.astype(np.float64)).max(initial=0) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -(2**63), 2**63 - 1).astype(np.int64)


def centres(sample: np.ndarray, n: int = CENTRES, rounds: int = 5) -> np.ndarray:
    """Centres of a sample by a few rounds of k-means from evenly picked rows."""
    x = sample.astype(np.float64)
    c = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)]
    for _ in range(rounds):
        own = _nearest(x, c)
        for k in np.unique(own):
            c[k] = x[own == k].mean(0)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)


def _pack(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Runs of ``size`` rows as blocks: ids and components, row by row, as bytes."""
        rest: list[pd.DataFrame] = []
        held, number = 0, 0
        for b in batches:
            rest.append(b)
            held += len(b)
            if held < size:
                continue
            rows = pd.concat(rest, ignore_index=True)
            whole = len(rows) // size * size
            for i in range(0, whole, size):
                yield _block(rows.iloc[i : i + size], number)
                number += 1
            rest, held = [rows.iloc[whole:]], len(rows) - whole
        if held:
            yield _block(pd.concat(rest, ignore_index=True), number)

    return run


def _block(rows: pd.DataFrame, number: int) -> pd.DataFrame:
    dims = max(map(len, rows["x"]))
    return pd.DataFrame(
        {"number": [number], "dims": [dims], "ids": [rows["vec_id"].to_numpy("<i8").tobytes()], "x": [_matrix(rows["x"].tolist(), dims).astype("<i8").tobytes()]}
    )


def search(queries: np.ndarray, own: np.ndarray, floor: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[int, int, int]]:
    """``query row, vec_id, score`` of each query's best ``k`` in some blocks of those that reach its ``floor``.

    A block's bound for a query is the sum over dimensions of what the block's greatest or least
    component there can give. Blocks are scored by falling bound, through their own rows, until
    the next bound is under the query's floor, which its k-th score here raises; equal bounds may hold
    ties and are scored.
    """
    dims = max([queries.shape[1], *(x.shape[1] for _, x in blocks)])
    pad = lambda m: np.pad(m, ((0, 0), (0, dims - m.shape[1])))
    queries, data = pad(queries), [pad(x) for _, x in blocks]
    ends = np.hstack([[x.max(0) for x in data], [x.min(0) for x in data]])
    bounds = products(np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)]), ends)
    out = []
    for q in range(len(queries)):
        order = np.argsort(~bounds[q], kind="stable")  # ~ turns the order of longs round without overflow
        ids, scores, least = np.empty(0, np.int64), np.empty(0, np.int64), floor[q]
        at, step = 0, 1
        while at < len(order) and bounds[q, order[at]] >= least:
            some = order[at : at + step]
            some = some[bounds[q, some] >= least]
            x = data[some[0]] if len(some) == 1 else np.concatenate([data[j] for j in some])
            new_ids = np.concatenate([blocks[j][0] for j in some])
            new = products(queries[q : q + 1], x)[0]
            keep = (new_ids != own[q]) & (new >= least)
            ids, scores = np.concatenate((ids, new_ids[keep])), np.concatenate((scores, new[keep]))
            best = np.lexsort((ids, ~scores))[:k]
            ids, scores = ids[best], scores[best]
            least = max(least, scores[-1]) if len(scores) == k else least
            at, step = at + step, min(step * 2, 64)
        out += [(q, int(i), int(s)) for i, s in zip(ids, scores, strict=True)]
    return out


ANSWER = "query long, query_id long, vec_id long, score long"


def _answer(k: int):
    @releasing
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Shard after shard, first its blocks, which stay, then the queries, a batch at a time."""
        shard, blocks = None, []
        for batch in batches:
            for at, rows in batch.groupby("shard", sort=True):
                if at != shard:
                    shard, blocks = at, []
                held = rows[rows["number"] >= 0]
                for ids, x, dims in zip(held["ids"], held["data"], held["dims"], strict=True):
                    i = np.frombuffer(ids, "<i8")
                    blocks.append((i, np.frombuffer(x, "<i8").reshape(len(i), int(dims))))
                asked = rows[rows["number"] < 0]
                if not len(asked) or not blocks:
                    continue
                own, query = asked["vec_id"].to_numpy(np.int64), asked["query"].to_numpy(np.int64)
                q = _matrix(asked["x"].tolist(), max(map(len, asked["x"])))
                found = pd.DataFrame(search(q, own, asked["floor"].to_numpy(np.int64), blocks, k), columns=["row", "vec_id", "score"], dtype="int64")
                yield pd.DataFrame({"query": query[found["row"]], "query_id": own[found["row"]], "vec_id": found["vec_id"], "score": found["score"]})

    return run


def _floors(ids: np.ndarray, x: np.ndarray, k: int):
    @releasing
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A score that each query's k best surely reach: the k-th among some rows of the table."""
        for b in batches:
            q = _matrix(b["x"].tolist(), max(map(len, b["x"])))
            dims = max(q.shape[1], x.shape[1])
            scores = products(*(np.pad(m, ((0, 0), (0, dims - m.shape[1]))) for m in (q, x)))
            floor = np.full(len(b), -(2**63), np.int64)
            for i, own in enumerate(b["vec_id"].to_numpy(np.int64)):
                others = scores[i, ids != own]
                if len(others) >= k:
                    floor[i] = np.partition(others, len(others) - k)[len(others) - k]
            yield b.assign(floor=floor)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best rows by inner product, all if fewer.

    ``vectors`` has ``vec_id`` and ``x``, an array of longs; rows with a null take no part. Queries are
    the rows that ``is_query`` holds for, candidates all rows of another id. Ties go to the smaller
    id. A shorter vector counts as filled up with zeros. Rows that repeat an id are candidates each;
    a query that repeats id and vector is asked once, one with another vector apart (its ranks then start
    anew). An empty table, or one without queries, gives none. Scores are exact; one beyond 64 bits counts as the
    nearest long.

    The index: rows sorted by the nearest of some centres, which come from a bounded sample and only
    steer pruning, in blocks with their rows, in shards. The blocks of a shard go to one task, once, and stay
    there while the queries stream through it by batches, so a task holds one shard and one batch. A
    query brings the k-th score that it has in the sample, under which no block is looked at; its best of each
    shard are ranked at the end. Shards are ranges of centre and hash, so equal vectors spread.
    """
    rows = durable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "x").dropna(), "vectors")
    count = rows.count()
    share = int(min(1.0, SAMPLE / max(1, count)) * (1 << 30))
    sample = rows.filter(F.pmod(F.xxhash64("vec_id", "x"), F.lit(1 << 30)) < share).limit(2 * SAMPLE).toPandas()
    dims = max(map(len, sample["x"]), default=0)
    drawn = _matrix(sample["x"].tolist(), dims)
    middle = centres(drawn) if len(sample) else np.zeros((1, 0))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _matrix([r[:dims] for r in b["x"].tolist()], dims).astype(np.float64)
            yield b.assign(centre=_nearest(x, middle))

    shards = max(1, round(count / SHARD))
    blocks = (
        rows.mapInPandas(place, "vec_id long, x array<bigint>, centre long")
        .repartitionByRange(shards, "centre", F.xxhash64("vec_id"))
        .sortWithinPartitions("centre", "vec_id")
        .mapInPandas(_pack(BLOCK), "number long, dims long, ids binary, x binary")
        .withColumn("shard", F.spark_partition_id())
    )
    blocks = durable(blocks, "blocks")
    asked = rows.filter(is_query).distinct().mapInPandas(_floors(sample["vec_id"].to_numpy(np.int64), drawn, k), "vec_id long, x array<bigint>, floor long")
    asked = durable(asked.withColumn("query", F.xxhash64("vec_id", "x")), "queries")
    parts = blocks.agg(F.max("shard")).first()[0]
    # a stated set of queries against all rows, block by block
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(parts or 0))))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    index = blocks.select("shard", "number", "dims", "ids", F.col("x").alias("data"), none("long", "vec_id"), none("array<bigint>", "x"), none("long", "floor"), none("long", "query"))
    asked = asked.select("shard", F.lit(-1).cast("long").alias("number"), none("long", "dims"), none("binary", "ids"), none("binary", "data"), "vec_id", "x", "floor", "query")
    tasks = index.union(asked).repartition(shards, "shard").sortWithinPartitions("shard", F.col("number") < 0, "number", "query")
    best = tasks.mapInPandas(_answer(k), ANSWER)
    order = Window.partitionBy("query", "query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.select("vec_id", integers(F.col("embedding")).alias("x")), F.col("vec_id") % 100 == 0)


SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
