"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, releasing, small_batches, table

SIZES = (4, 5, 6)
#: n-grams are hashed to so many bits.
BUCKET_BITS = 20
#: Labelled texts that are learnt from, at most; chosen by a hash of their id.
MAX_TRAINING = 8_000
#: Chi-squared (one degree of freedom) and texts that a feature needs.
MIN_CHI2, MIN_TEXTS = 10.83, 3
#: A toxic text weighs the ratio of the classes to this power in the loss.
BALANCE = 1.0
#: Texts are worked on so many bytes at a time; a byte takes some 150 in a worker.
CHUNK = 1 << 19
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Lower-cases A-Z and turns other ASCII than letters and digits to spaces.
PLAIN = bytes(
    (c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``first, end`` of a run of texts, their bytes with spaces between, and the text each byte is of.

    So many spaces stand between texts that no n-gram has letters of two.
    """
    gap = b" " * max(SIZES)
    start, size, parts = 0, 0, []
    for i, t in enumerate(texts):
        parts.append(gap + b" ".join((t or "").encode("utf-8", "surrogatepass").translate(PLAIN).split()))
        size += len(parts[-1])
        if size >= CHUNK or i == len(texts) - 1:
            parts.append(gap)
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            owner[owner == len(parts) - 1] -= 1
            yield start, i + 1, np.frombuffer(b"".join(parts), np.uint8), owner
            start, size, parts = i + 1, 0, []


def buckets(data: np.ndarray) -> Iterator[np.ndarray]:
    """For each size, the bucket of the n-gram at each place."""
    code = np.zeros(len(data), np.uint64)
    wide = data.astype(np.uint64)
    for n in range(1, max(SIZES) + 1):
        code = code[: len(data) - n + 1] | (wide[n - 1 :] << np.uint64(8 * (n - 1)))
        if n in SIZES:
            yield (code * np.uint64(MULTIPLIERS[SIZES.index(n)])) >> np.uint64(64 - BUCKET_BITS)


def present(data: np.ndarray, owner: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of each different n-gram of the texts, only those that are ``wanted``."""
    keys = []
    for b in buckets(data):
        own = owner[: len(b)]
        if wanted is not None:
            at = np.flatnonzero(wanted[b])
            b, own = b[at], own[at]
        keys.append((own.astype(np.uint64) << np.uint64(BUCKET_BITS)) | b)
    keys = np.unique(np.concatenate(keys))
    return (keys >> np.uint64(BUCKET_BITS)).astype(np.int64), (keys & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray  # of each bucket: log-count ratio times coefficient
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        wanted, out = self.weights != 0, np.zeros(len(texts))
        for first, end, data, owner in chunks(texts):
            if wanted.any():
                text, bucket = present(data, owner, wanted)
                out[first:end] = np.bincount(text, self.weights[bucket], end - first)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -500, 500)))


@releasing
def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many texts of each class each bucket is."""
    total = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for b in batches:
        labels = b["label"].to_numpy(np.int64)
        for first, _, data, owner in chunks(b["text"].tolist()):
            text, bucket = present(data, owner)
            for k in (0, 1):
                total[k] += np.bincount(bucket[labels[first + text] == k], minlength=1 << BUCKET_BITS)
    at = np.flatnonzero(total.any(0))
    yield pd.DataFrame({"bucket": at, "zeros": total[0][at], "ones": total[1][at]})


def _rows(wanted: np.ndarray):
    @releasing
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[np.ndarray] = []
            for first, end, data, owner in chunks(b["text"].tolist()):
                text, bucket = present(data, owner, wanted)
                out += np.split(bucket.astype("<i4"), np.searchsorted(text, np.arange(1, end - first)))
            yield pd.DataFrame({"label": b["label"], "buckets": [x.tobytes() for x in out]})

    return run


def _minimise(f, x: np.ndarray, rounds: int = 200) -> np.ndarray:
    """L-BFGS with ten corrections and a halving line search."""
    fx, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, a = -g, []
        for s, y, r in reversed(past):
            a.append(r * (s @ d))
            d = d - a[-1] * y
        if past:
            s, y, _ = past[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y, r), c in zip(past, reversed(a), strict=True):
            d = d + s * (c - r * (y @ d))
        step, slope = 1.0, g @ d
        if slope > -1e-10:
            break
        while True:
            new = x + step * d
            f_new, g_new = f(new)
            if f_new <= fx + 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        s, y = new - x, g_new - g
        if s @ y > 1e-12:
            past = [*past[-9:], (s, y, 1 / (s @ y))]
        done = abs(fx - f_new) <= 1e-9 * max(1.0, abs(fx))
        x, fx, g = new, f_new, g_new
        if done:
            break
    return x


def fit(labelled: DataFrame, max_training: int = MAX_TRAINING, penalty: float = 1.0) -> Model:
    """Learns from ``id, text, label`` (0 or 1).

    At most about ``max_training`` rows are learnt from, those of the least hashes of their ids. Per
    bucket the texts of each class that hold it are counted; all buckets whose share differs clearly
    between the classes (``MIN_CHI2``) are kept, and give a feature that is their log-count ratio where a text
    has the n-gram and 0 where not. A logistic regression on these, with an L2 penalty, is the model.
    With one class only, or none, every text's score is that class, or a half.
    """
    ids = labelled.select("id", "label").groupBy("label").count().collect()
    number = {int(r[0]): r[1] for r in ids}
    if len(number) < 2:
        only = {(): 0.0, (0,): -20.0, (1,): 20.0}[tuple(number)]
        return Model(np.zeros(1 << BUCKET_BITS), only)
    share = min(1.0, max_training / sum(number.values()))
    sample = labelled.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("text", "label")
    sample = durable(sample.repartition(max(1, min(8, round(max_training / 2500)))), "toxic-sample")
    n0, n1 = (sample.filter(F.col("label") == k).count() for k in (0, 1))
    if not (n0 and n1):
        return Model(np.zeros(1 << BUCKET_BITS), 20.0 if n1 else -20.0)
    a, b = F.col("ones").cast("double"), F.col("zeros").cast("double")
    c, d = n1 - a, n0 - b
    chi2 = (n0 + n1) * (a * d - b * c) ** 2 / ((a + b) * (c + d) * n1 * n0)
    top = (
        sample.mapInPandas(_counts, "bucket long, zeros long, ones long")
        .groupBy("bucket")
        .agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
        .filter((F.col("zeros") + F.col("ones") >= MIN_TEXTS) & (c + d > 0))
        .withColumn("chi2", chi2)
        .filter(F.col("chi2") >= MIN_CHI2)
        .orderBy("bucket")
        .toPandas()  # at most 1 << BUCKET_BITS rows
    )
    ratio = np.zeros(1 << BUCKET_BITS)
    p, q = top["ones"].to_numpy() + 1.0, top["zeros"].to_numpy() + 1.0
    ratio[top["bucket"].to_numpy(np.int64)] = np.log(p / (n1 + 2)) - np.log(q / (n0 + 2))
    wanted = ratio != 0
    column = np.cumsum(wanted) - 1
    with small_batches(sample.sparkSession):
        rows = sample.mapInPandas(_rows(wanted), "label int, buckets binary").toPandas()
    y = rows["label"].to_numpy(np.float64)
    width = rows["buckets"].str.len().to_numpy(np.int64) // 4
    bucket = np.frombuffer(b"".join(rows["buckets"]), "<i4")
    row, col, value = np.repeat(np.arange(len(y)), width), column[bucket], ratio[bucket]

    rise = (n0 / n1) ** BALANCE  # what a toxic text weighs

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(row, w[col] * value, len(y)) + w[-1]
        signed = np.where(y > 0, z, -z)
        miss = (1 / (1 + np.exp(np.clip(signed, -500, 500)))) * np.where(y > 0, -rise, 1)
        g = np.append(np.bincount(col, miss[row] * value, len(w) - 1), miss.sum())
        g[:-1] += penalty * w[:-1]
        return (np.logaddexp(0, -signed) * np.where(y > 0, rise, 1)).sum() + penalty / 2 * (w[:-1] ** 2).sum(), g

    w = _minimise(loss, np.append(np.zeros(int(wanted.sum())), np.log(n1 / n0)))
    weights = np.zeros(1 << BUCKET_BITS)
    weights[np.flatnonzero(wanted)] = w[:-1] * ratio[wanted]
    return Model(weights, float(w[-1]))


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """``id, text, label`` for the texts whose id is labelled and that ``learn`` (of ``id``) allows.

    An id with different labels counts as toxic if half of its labels say so; null labels don't count.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .dropna()
        .filter(learn)
        .groupBy("id")
        .agg((F.avg("toxic") >= 0.5).cast("int").alias("label"))
    )
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(known, "id")


def held_out(doc_id: Column, parts: int = 3, which: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == which, F.lit(False))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Scores depend on the text alone. A null text scores as an empty one, by the bias. Repeated rows
    score the same; an empty table gives none. Columns named as the new ones are replaced.
    """
    kept = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size, 8 MB

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from releasing(lambda x: (pd.Series(broadcast.value.scores(b.tolist())) for b in x))(batches)

    scored = kept.withColumn("score", score(F.col(text_col).cast("string")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that are predicted toxic; columns as they are, whatever their names.

    The model is learnt from the labelled rows among ``docs`` but those held out. Null and empty texts score by
    the bias alone; repeated rows stay or go together; without labels, or without rows to drop, all stay; an
    empty table gives none.
    """
    model = fit(training_rows(docs, labels, ~held_out(F.col("id"))))
    boxed = docs.select(F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return score_toxicity(boxed, model).filter("predicted = 0").select("row.*")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(training_rows(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("id"))))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
