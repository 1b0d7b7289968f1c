"""Near-duplicate texts by the similarity of their word shingles: candidates by hashes, each pair verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylib.operators.components import connected_components

from .common import durable, id_key, releasing, small_batches, spread_join
from .simhash import SEED, fingerprint, hashes, links

#: Bands of least hashes, and hashes of a band: at a similarity of 0.8 all bands of a pair differ in 2 of 10,000 cases.
BANDS, ROWS = 12, 3
#: Texts that share a band, or a light shingle of their clump, with no more others than this are compared in pairs.
CROWD = 16
#: Share of a clump's texts from which on a shingle is listed as heavy at once.
HEAVY = 1 / 8
#: Texts, and bytes of their shingles, of a block; what stays apart in a dense crowd is compared block by block.
BLOCK, BLOCK_BYTES = 256, 4 << 20
_rng = np.random.default_rng(2024)
_MULTIPLY = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


# ---------------------------------------------------------------- shingles


def sketch(h: np.ndarray) -> np.ndarray:
    """A key for each band: a hash of the least of its permuted hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 4096):
        x = h[i : i + 4096, None] * _MULTIPLY + _ADD
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(0))
    rows = least.reshape(BANDS, ROWS).astype("<u8")
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64)


def _sketches(words: int):
    @releasing
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["text"]:
                h = hashes(t, words)
                different = np.unique(h)
                sig = xxhash.xxh64_intdigest(different.astype("<u8").tobytes(), SEED)
                out.append((np.uint64(sig).view(np.int64), np.uint64(fingerprint(h)).view(np.int64), sketch(different) if len(h) else []))
            made = pd.DataFrame(out, columns=["sig", "fp", "bands"])
            yield pd.concat([b[["key", "text_hash"]].reset_index(drop=True), made], axis=1)

    return run


def _sets(words: int):
    @releasing
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [np.unique(hashes(t, words)).astype("<u8").tobytes() for t in b["text"]]
            yield pd.DataFrame({"sig": b["sig"], "shingles": made})

    return run


def _alike(similarity: float):
    @releasing
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["of_a"], b["of_b"], strict=True):
                n, m = len(x) // 8, len(y) // 8
                if min(n, m) < similarity * max(n, m):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
                keep.append(both >= similarity * (n + m - both))
            yield b.loc[keep, ["a", "b"]]

    return run


# ---------------------------------------------------------------- clumps


@releasing
def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many texts of a clump have each shingle, summed over a batch."""
    for b in batches:
        for clump, sets in b.groupby("clump")["shingles"]:
            s, n = np.unique(np.concatenate([np.frombuffer(x, "<i8") for x in sets]), return_counts=True)
            yield pd.DataFrame({"clump": clump, "s": s, "n": n})


def _differences(ratio: float):
    @releasing
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Where each text differs from its clump's base: the excess of that, its heavy shingles' number and the others."""
        for b in batches:
            out = []
            for sig, clump, shingles, base, heavy in zip(b["sig"], b["clump"], b["shingles"], b["base"], b["heavy"], strict=True):
                x = np.frombuffer(shingles, "<i8")
                d = np.setxor1d(x, np.array(base, np.int64), assume_unique=True)
                rest = d[~np.isin(d, np.array(heavy, np.int64))]
                out.append((sig, clump, len(d) - ratio * len(x), len(d) - len(rest), rest))
            yield pd.DataFrame(out, columns=["sig", "clump", "excess", "heavy", "rest"])

    return run


def differences(members: DataFrame, sets: DataFrame, ratio: float) -> DataFrame:
    """``sig, clump, excess, heavy, rest`` of ``members(sig, clump)``: each text against its clump's base.

    The base of a clump is the set of shingles that most of its texts have. A text's difference D is
    what it has and the base lacks, or the other way round. Two texts are alike exactly if their own
    symmetric difference is at most ``ratio`` of their sizes' sum, that is, if twice the number of shingles that
    both differences hold reaches the sum of their excesses, size of D less ``ratio`` of a text's size. So
    texts near the base are alike without more, and all others only if their differences meet.
    """
    held = durable(spread_join(sets, members, ["sig"]).select("sig", "clump", "shingles"), "clump-sets")
    sizes = held.groupBy("clump").agg(F.count("*").alias("texts"))
    tally = held.select("clump", "shingles").mapInPandas(_tally, "clump long, s long, n long").groupBy("clump", "s").agg(F.sum("n").alias("n"))
    common = tally.filter(F.col("n") > CROWD).join(sizes, "clump")
    in_base = 2 * F.col("n") > F.col("texts")
    odd = F.when(in_base, F.col("texts") - F.col("n")).otherwise(F.col("n"))  # texts that differ from the base there
    weighty = (odd > CROWD) & (odd > HEAVY * F.col("texts"))
    base = common.filter(in_base | weighty).groupBy("clump").agg(
        F.collect_list(F.when(in_base, F.col("s"))).alias("base"), F.collect_list(F.when(weighty, F.col("s"))).alias("heavy")
    )
    empty = F.array().cast("array<long>")
    base = durable(base, "clump-bases")  # at most 2 texts' shingles for the base, 8 texts' differences for the heavy
    joined = held.join(base, "clump", "left").withColumns({c: F.coalesce(c, empty) for c in ("base", "heavy")})
    return joined.mapInPandas(_differences(ratio), "sig long, clump long, excess double, heavy long, rest array<long>")


def clump_pairs(members: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Candidates ``a, b`` of clumps, and the texts (``sig``) that may have others which these don't connect.

    Two texts of a clump that are alike (see ``differences``) have excesses of which the sum isn't
    positive, or share a part of their differences. Of the former, each is alike the text of the clump with
    the least excess, which is a candidate of theirs. Of the latter, those that share a light
    part, in at most ``CROWD`` differences, are candidates, unless what they share, their heavy parts counted in
    full, can't suffice. What is left shares heavy parts alone; only texts whose number of these could
    suffice are named. In a crowd of texts around one boilerplate that is none.
    """
    ratio, least = (1 - similarity) / (1 + similarity), 1e-6
    made = durable(differences(members, sets, ratio), "clump-differences")
    each = made.select("clump", "sig", F.explode("rest").alias("s"))
    shared = each.groupBy("clump", "s").agg(F.count("*").alias("n")).filter("n > 1")
    shared = durable(spread_join(each, shared, ["clump", "s"]), "clump-shared")
    more = shared.filter(F.col("n") > CROWD).groupBy("sig").agg(F.count("*").alias("more"))
    texts = spread_join(made.drop("rest"), more, ["sig"], "left")
    texts = durable(texts.select("sig", "clump", "excess", (F.col("heavy") + F.coalesce("more", F.lit(0))).alias("heavy")), "clump-texts")

    light = shared.filter(F.col("n") <= CROWD).groupBy("clump", "s").agg(F.array_sort(F.collect_list("sig")).alias("sigs"))
    light = light.groupBy("sigs").agg(F.count("*").alias("n")).select("n", "sigs", F.posexplode("sigs").alias("i", "a"))
    met = light.select("n", "a", F.explode(F.slice("sigs", F.col("i") + 2, F.size("sigs"))).alias("b"))
    met = met.groupBy("a", "b").agg(F.sum("n").alias("n"))
    of = lambda k: texts.select(F.col("sig").alias(k), F.col("excess").alias(f"excess_{k}"), F.col("heavy").alias(f"heavy_{k}"))
    enough = 2 * (F.col("n") + F.least("heavy_a", "heavy_b")) >= F.col("excess_a") + F.col("excess_b") - least
    met = met.join(of("a"), "a").join(of("b"), "b").filter(enough).select("a", "b")

    spare = F.col("heavy") - F.col("excess")
    tops = texts.groupBy("clump").agg(
        F.min_by(F.struct("sig", "excess"), F.struct("excess", "sig")).alias("near"), F.max(spare).alias("spare")
    )
    tops = durable(tops, "clump-tops")  # so that the join to them may split a clump
    texts = texts.join(tops, "clump")
    near = texts.filter((F.col("sig") != F.col("near.sig")) & (F.col("excess") + F.col("near.excess") <= least))
    near = near.select(F.least("sig", "near.sig").alias("a"), F.greatest("sig", "near.sig").alias("b"))
    dense = texts.filter(F.col("heavy") - F.col("excess") + F.col("spare") >= -least).filter("heavy > 0").select("sig")
    return met.union(near), dense


# ---------------------------------------------------------------- dense crowds


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many hashes each set of ``xs`` shares with each of ``ys``."""
    out = np.zeros((len(xs), len(ys)), np.int64)
    shared = np.intersect1d(np.concatenate(xs), np.concatenate(ys))
    if not len(shared):
        return out
    sides = []
    for sets in (xs, ys):
        x = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        code = np.minimum(np.searchsorted(shared, x), len(shared) - 1)
        order = np.flatnonzero(shared[code] == x)
        order = order[np.argsort(code[order], kind="stable")]
        sides.append((row[order], code[order]))
    for i in range(0, len(shared), columns):  # a part of the hashes at a time
        made = []
        for (row, code), n in zip(sides, out.shape, strict=True):
            a, b = np.searchsorted(code, (i, i + columns))
            one = np.zeros((n, columns), np.float32)
            one[row[a:b], code[a:b] - i] = 1
            made.append(one)
        out += (made[0] @ made[1].T).astype(np.int64)
    return out


def _between(similarity: float):
    def run(pair: pd.DataFrame) -> pd.DataFrame:
        """Of the links between two blocks, or within one, a spanning set: components that they join."""
        mine = pair[pair["side"] == 0]
        other = pair[pair["side"] == 1] if (pair["x"] != pair["y"]).any() else mine
        xs, ys = ([np.frombuffer(s, "<u8") for s in part["shingles"]] for part in (mine, other))
        of_x, of_y = mine["component"].to_numpy(np.int64), other["component"].to_numpy(np.int64)
        n, m = np.array([len(s) for s in xs])[:, None], np.array([len(s) for s in ys])
        apart = (of_x[:, None] != of_y) & (np.minimum(n, m) >= similarity * np.maximum(n, m))
        out: list[tuple[int, int]] = []
        if apart.any():
            both = overlaps(xs, ys)
            root = {c: c for c in [*of_x.tolist(), *of_y.tolist()]}

            def top(c: int) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            for i, j in np.argwhere(apart & (both >= similarity * (n + m - both))):
                a, b = top(int(of_x[i])), top(int(of_y[j]))
                if a != b:
                    root[a] = b
                    out.append((int(of_x[i]), int(of_y[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def across(crowd: DataFrame, parts: DataFrame, sets: DataFrame, similarity: float) -> DataFrame | None:
    """``a, b``: edges that connect the components whose texts are alike and share a crowded band; None if no crowd has two.

    ``crowd(band, k, sig)``, ``parts(sig, component)``, ``sets(sig, shingles)``. Exact: each two texts of a crowd
    that are in different components are compared on their whole sets. A crowd is dealt by hashes into blocks
    of a bounded size, a component larger than a block into blocks of its own, which need not meet each other.
    Each two other blocks are a group, so the work grows with the square of what is apart, over all
    machines, while no task holds more than two blocks.
    """
    at, part = ["band", "k"], ["band", "k", "big", "owner"]
    member = spread_join(crowd.select(*at, "sig"), parts, ["sig"], "left").withColumn("component", F.coalesce("component", "sig"))
    member = durable(spread_join(member, sets.select("sig", F.length("shingles").alias("bytes")), ["sig"]), "crowd-members")
    each = member.groupBy(*at, "component").agg(F.count("*").alias("m"), F.sum("bytes").alias("bytes"))
    mixed = each.join(each.groupBy(at).agg(F.count("*").alias("parts")).filter("parts > 1"), at)
    mixed = mixed.withColumn("big", F.col("m") > BLOCK).withColumn("owner", F.when(F.col("big"), F.col("component")).otherwise(F.lit(0)))
    mixed = durable(mixed, "crowd-parts")
    if mixed.isEmpty():
        return None
    blocks = F.greatest(F.ceil(F.sum("m") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int")
    dealt = mixed.groupBy(part).agg(blocks.alias("blocks"))
    block = F.xxhash64(*part, "salt")
    every = durable(dealt.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*part, block.alias("block")), "crowd-blocks")
    x, y = every.withColumnRenamed("block", "x"), every.toDF(*at, "big_y", "owner_y", "y")
    pairs = x.join(y, at).filter("x <= y AND (x = y OR NOT (big AND big_y AND owner = owner_y))").filter("x < y OR NOT big").select("x", "y")
    first = pairs.select(F.col("x").alias("block"), "x", "y", F.lit(0).alias("side"))
    second = pairs.filter("x < y").select(F.col("y").alias("block"), "x", "y", F.lit(1).alias("side"))
    salt = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
    placed = member.join(mixed.select(*part, "component"), [*at, "component"]).join(dealt, part)
    placed = placed.withColumn("salt", salt).select("sig", "component", block.alias("block"))
    tasks = spread_join(placed.join(first.union(second), "block"), sets, ["sig"]).select("x", "y", "side", "component", "shingles")
    return tasks.groupBy("x", "y").applyInPandas(_between(similarity), "a long, b long")


# ---------------------------------------------------------------- the operator


def _in_pairs(members: DataFrame) -> DataFrame:
    """``a, b``: all pairs of each array ``s``, which is sorted and of a bounded size."""
    each = members.select("s", F.posexplode("s").alias("i", "a"))
    return each.select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``key, text_hash, component`` of each row: texts that links of ``similarity`` or more connect share a component.

    Similarity is that of the sets of ``words``-word shingles (Jaccard). Candidates meet by the Golay
    keys of their fingerprints and, since texts of 0.8 differ in too many bits for these, by bands of
    least hashes. Texts of one set are one node. A band that few share gives all its pairs, of a
    bounded number for each text. Bands that many share make clumps, in which texts are compared by what
    tells them from the clump's base, see ``clump_pairs``; in each such band a text also meets one
    member, drawn by a hash. What this leaves in different components of a dense crowd is compared in
    full, see ``across``. So no link of two texts that share a band is lost. Every pair is verified
    on the whole sets, which are made again for texts with a candidate only. Texts without words are one
    node.
    """
    text = F.col(text_col).cast("string")
    named = docs.select(id_key(F.col(id_col)).alias("key"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    with small_batches(docs.sparkSession):
        rows = durable(named.mapInPandas(_sketches(words), "key long, text_hash long, sig long, fp long, bands array<long>"), "sketches")
    nodes = rows.groupBy("sig").agg(F.min("fp").alias("fp"), F.first("bands").alias("bands"), F.min(F.struct("key", "text_hash")).alias("at"))
    nodes = durable(nodes, "sketch-nodes")  # fingerprints count repeats, bands follow from the set
    keyed = nodes.select("sig", F.posexplode("bands").alias("band", "k"))
    shared = keyed.groupBy("band", "k").agg(F.count("*").alias("n")).filter("n > 1")
    held = durable(spread_join(keyed, shared, ["band", "k"]), "sketch-held")
    few = _in_pairs(held.filter(F.col("n") <= CROWD).groupBy("band", "k").agg(F.array_sort(F.collect_list("sig")).alias("s")))
    crowd = held.filter(F.col("n") > CROWD).select("band", "k", "sig")
    hubs = durable(crowd.groupBy("band", "k").agg(F.min("sig").alias("hub"), F.min_by("sig", F.xxhash64("sig", "band")).alias("drawn")), "crowd-hubs")
    crowded = not hubs.isEmpty()
    heads = nodes.groupBy("fp").agg(F.min("sig").alias("head"), F.count("*").alias("n"))
    twins = spread_join(nodes.select("fp", "sig"), heads.filter("n > 1"), ["fp"])
    same = twins.filter((F.col("n") > CROWD) & (F.col("sig") != F.col("head"))).select(F.col("head").alias("a"), F.col("sig").alias("b"))
    same = same.union(_in_pairs(twins.filter(F.col("n") <= CROWD).groupBy("fp").agg(F.array_sort(F.collect_list("sig")).alias("s"))))
    near = links(heads, spanning=False).join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a")
    near = near.join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = few.union(same).union(near)
    if crowded:
        at_hub = durable(spread_join(crowd, hubs, ["band", "k"]), "crowd-at-hubs")
        clumps = durable(connected_components(at_hub.select(F.col("sig").alias("a"), F.col("hub").alias("b"))).toDF("sig", "clump"), "clumps")
        drawn = at_hub.filter("sig <> drawn").select(F.least("sig", "drawn").alias("a"), F.greatest("sig", "drawn").alias("b"))
        pairs = pairs.union(drawn)
    pairs = durable(pairs.distinct(), "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("sig"))
    asked = (asked.union(clumps.select("sig")) if crowded else asked).distinct()
    wanted = nodes.join(asked, "sig").select("sig", "at.*")
    texts = named.join(wanted, ["key", "text_hash"]).dropDuplicates(["sig"]).select("sig", "text")
    with small_batches(docs.sparkSession):
        sets = durable(texts.mapInPandas(_sets(words), "sig long, shingles binary"), "shingle-sets")
    if crowded:
        met, dense = clump_pairs(clumps, sets, similarity)
        pairs = durable(pairs.union(met).distinct(), "clump-pairs")
    both = spread_join(spread_join(pairs, sets.toDF("a", "of_a"), ["a"]), sets.toDF("b", "of_b"), ["b"])
    parts = connected_components(both.mapInPandas(_alike(similarity), "a long, b long"))
    parts = durable(parts.withColumnRenamed("node", "sig"), "similar-parts")
    joins = across(spread_join(crowd, dense, ["sig"]), parts, sets, similarity) if crowded else None
    if joins is not None:
        whole = connected_components(joins).toDF("component", "whole")
        grouped = parts.join(clumps.select("sig"), "sig", "full").withColumn("component", F.coalesce("component", "sig"))
        parts = spread_join(grouped, whole, ["component"], "left").select("sig", F.coalesce("whole", "component").alias("component"))
    joined = spread_join(rows.select("key", "text_hash", "sig"), parts, ["sig"], "left")
    return joined.select("key", "text_hash", F.coalesce("component", "sig").alias("component"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of ``similar`` texts, that of the least id; columns as they are.

    Null texts are as empty ones, and texts without words a group. Of several rows with the least id
    one stays, by a hash of its text, then of all its columns. An empty table gives none.
    """
    least = F.min(F.struct("key", "text_hash")).alias("least")
    kept = similar(docs, id_col, text_col, words, similarity).groupBy("component").agg(least).select("least.*")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    named = docs.select(
        id_key(F.col(id_col)).alias("key"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"),
        F.xxhash64(row).alias("order"), row.alias("row"),
    )
    return named.join(kept, ["key", "text_hash"]).groupBy("key", "text_hash").agg(F.min_by("row", "order").alias("row")).select("row.*")
