"""SimHash near-duplicates, with candidates from Golay-code fuzzy hashing."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylib.operators.components import connected_components

from .common import AZ, NULL_ID, durable, id_key, releasing, spread_join, table

SEED, BITS = 42, 64
#: A fingerprint's three segments as (first bit, bits); each is a Golay word with zeros above.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator of the binary Golay code (23, 12, 7), x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Keys with more fingerprints than this are linked by their one-bit variants, the rest by comparison.
BUCKET = 48


# ---------------------------------------------------------------- fingerprints


def hashes(text: str | None, words: int = 3) -> np.ndarray:
    """XXH64 of the word shingles of a text, repeats included; none for a text without words."""
    joined = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(AZ).split())
    if not joined:
        return np.empty(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    if len(gaps) + 1 <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    starts = [0, *(gaps[: len(gaps) - words + 1] + 1).tolist()]
    ends = [*gaps[words - 1 :].tolist(), len(joined)]
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)], np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """Bits that over half of the hashes set."""
    if not len(h):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):  # a long text's bits a part at a time
        ones += np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``id, text_hash, fp`` for each row: the id as it is, XXH64 of the text, the fingerprint as a signed long."""

    @releasing
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.array([fingerprint(hashes(t, words)) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"key": b["key"], "text_hash": b["text_hash"], "fp": fps})

    text = F.col(text_col).cast("string")
    return (
        docs.select(id_key(F.col(id_col)).alias("key"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
        .mapInPandas(run, "key long, text_hash long, fp long")
    )


# ---------------------------------------------------------------- Golay keys


@functools.cache
def _errors() -> np.ndarray:
    """The error of at most three bits for each of the 2048 syndromes; the code is perfect."""
    out = np.zeros(2048, np.int64)
    for n in (1, 2, 3):
        words = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), n)])
        out[_syndrome(words)] = words
    return out


def _syndrome(words: np.ndarray) -> np.ndarray:
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    return (words ^ _errors()[_syndrome(words)]) >> 11


def near_indices(words: np.ndarray) -> np.ndarray:
    """(n, 24): the indices that each word and its 23 neighbours by one bit decode to, with repeats.

    A word within two bits of its codeword has one index, any other has six. Two words that differ
    in at most two bits have a word within one bit of both, so they share an index.
    """
    flips = np.concatenate(([0], 1 << np.arange(23)))
    return decode((words[:, None] ^ flips).ravel()).reshape(len(words), 24)


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of fingerprints; two at most two bits apart share a key.

    Of three segments two errors leave one without any. Its bits, exact, with an index of the segment
    after it, where both errors may be, make the key: 33 to 34 bits and the segment's number.
    """
    fp = fps.view(np.uint64)
    parts = [(fp >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    rows, keys = [], []
    for k in range(3):
        near = np.sort(near_indices(parts[(k + 1) % 3]), axis=1)
        fresh = np.concatenate((np.ones((len(near), 1), bool), near[:, 1:] != near[:, :-1]), axis=1)
        at, _ = np.nonzero(fresh)
        rows.append(at)
        keys.append((np.int64(k) << 34) | (parts[k][at] << 12) | near[fresh])
    return np.concatenate(rows), np.concatenate(keys)


# ---------------------------------------------------------------- links


@releasing
def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        fps = b["fp"].to_numpy(np.int64)
        rows, keys = golay_keys(fps)
        yield pd.DataFrame({"key": keys, "fp": fps[rows]})


def _compare(spanning: bool):
    @releasing
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each bucket's links, or of them a spanning set: fewer rows than fingerprints."""
        for b in batches:
            out = []
            for bucket in b["members"]:
                fps = np.array(bucket, np.int64)
                x = fps.view(np.uint64)
                linked = np.triu(np.bitwise_count(x[:, None] ^ x) <= 2, 1)
                root = np.arange(len(fps))
                for i, j in np.argwhere(linked):
                    if not spanning or root[i] != root[j]:
                        out.append((fps[i], fps[j]))
                        root[root == root[j]] = root[i]
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


@releasing
def _variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    flips = np.concatenate((np.zeros(1, np.uint64), np.uint64(1) << np.arange(BITS, dtype=np.uint64)))
    for b in batches:
        v = b["fp"].to_numpy(np.int64).view(np.uint64)[:, None] ^ flips
        yield pd.DataFrame({"v": v.ravel().view(np.int64), "fp": np.repeat(b["fp"].to_numpy(), len(flips))})


def links(fps: DataFrame, spanning: bool = True) -> DataFrame:
    """``a, b``: edges that connect what links of two bits or fewer connect, from ``fp``, each value once.

    With ``spanning`` false all links of small buckets are given, for users who go on to verify them.

    Fingerprints meet by their Golay keys. Keys are counted first, summed before the shuffle; those
    of one fingerprint go no further. Buckets of up to ``BUCKET`` are compared in full and give a
    spanning set of their links. Fingerprints of larger buckets give their 65 variants within one
    bit instead: two of them are linked if and only if they share a variant, and those that share
    one are all linked, so an edge from each to the least is exact, and no variant has over 65. No
    step pairs all of a group.
    """
    keys = durable(fps.select("fp").mapInPandas(_keys, "key long, fp long"), "golay-keys")
    counts = keys.groupBy("key").count().filter("count > 1")
    held = durable(spread_join(keys, counts, ["key"]), "golay-held")
    small = (
        held.filter(F.col("count") <= BUCKET)
        .groupBy("key")
        .agg(F.collect_list("fp").alias("members"))
        .select("members")
        .mapInPandas(_compare(spanning), "a long, b long")
    )
    variants = held.filter(F.col("count") > BUCKET).select("fp").distinct().mapInPandas(_variants, "v long, fp long")
    stars = (
        variants.groupBy("v")
        .agg(F.collect_list("fp").alias("fps"))
        .filter(F.size("fps") > 1)
        .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
        .filter("a <> b")
    )
    return small.union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``.

    Texts are lower-cased (A-Z), cut into words at ASCII white space and shingled, repeats included;
    a text of fewer words is one shingle; one without words, null included, has fingerprint zero and
    links like any other. Rows link if their fingerprints differ in two bits or fewer;
    ``component_id`` is the least id that links reach. Each row is judged by its own text, also where
    rows repeat an id. A null id sorts first and shows as null. An empty table gives none; other
    columns are not looked at.

    Equal fingerprints are one node from the start, so copies cost a row of an aggregate; see
    ``links`` and ``connected_components`` for the rest.
    """
    rows = _resolved(docs, id_col, text_col, words)
    return rows.select(
        F.nullif("key", F.lit(NULL_ID)).alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.nullif("root", F.lit(NULL_ID)).alias("component_id"),
    )


def _resolved(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``key, text_hash, fp, component, root`` for each row; component is one of its fingerprints."""
    rows = durable(fingerprints(docs, id_col, text_col, words), "fingerprints")
    heads = durable(rows.groupBy("fp").agg(F.min("key").alias("least")), "fp-heads")
    parts = spread_join(connected_components(links(heads)).withColumnRenamed("node", "fp"), heads, ["fp"])
    parts = durable(parts, "fp-parts")
    roots = parts.groupBy("component").agg(F.min("least").alias("root"))
    linked = spread_join(parts.select("fp", "component"), roots, ["component"])
    found = heads.join(linked, "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("component"), F.coalesce("root", "least").alias("root")
    )
    return spread_join(rows, found, ["fp"])


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
