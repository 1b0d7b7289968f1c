"""Language-model scoring by a probabilistic suffix tree over words."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import AZ, NULL_ID, durable, id_key, releasing, small_batches, split_words, spread_join, table, text_or_empty, text_runs

#: Symbols: the end of a text, then the classes of rare words, then frequent words. NOTHING stands before a text.
END, CLASSES, NOTHING = 0, 50_000, 0xFFFF
#: Symbols of a context at most; a context with the symbol after it fills 64 bits.
DEPTH = 3
#: Words of at least this share of the training tokens are symbols of their own, 1 / FREQUENT at most: with the classes
#: and the end, symbols fit 16 bits.
FREQUENT = 1e-4
#: Times that training must have a context, at any size.
FLOOR = 2
#: Positions that are packed at a time.
CHUNK = 1 << 21
#: Positions of a bucket, about.
BUCKET = 2_000_000
#: Scores of positions are whole numbers of 1 / UNIT, so that their sum doesn't depend on its order.
UNIT = 1 << 20
#: Words of at least this share of the training tokens are broadcast with their counts: 1 / HEAVY at most.
HEAVY = 1e-5
#: Bytes of text that are cut into words at a time.
BYTES = 2 << 20
#: Positions whose bucket is worked out at a time, and codes that are merged, or grown of whole symbols, at a time.
SLAB, GROWN = 1 << 18, 1 << 19


# ---------------------------------------------------------------- words and symbols


def class_column(word: Column) -> Column:
    """The class of a rare word (binary), by a checksum of all its bytes."""
    return (F.crc32(word) % CLASSES).cast("int")


def classes_of(words: pa.Array) -> np.ndarray:
    """``class_column`` of an array of words."""
    return np.fromiter(map(zlib.crc32, words.to_pylist()), np.int64, len(words)) % CLASSES


class Lexicon:
    """The words that are broadcast: their counts, and the symbols of those that are frequent."""

    def __init__(self, words: list[bytes], counts: list[int], frequent: float):
        order = sorted(range(len(words)), key=words.__getitem__)
        self.words = pa.array([words[i] for i in order], pa.binary())
        self.counts = np.array([counts[i] for i in order], np.float64)
        own = self.counts >= frequent
        self.symbol = np.where(own, CLASSES + np.cumsum(own), 0)
        self.symbols = 1 + CLASSES + int(own.sum())

    def read(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """The texts' words; each one's place here, or -1; its symbol; how many words each text has."""
        words, sizes = split_words([t.translate(AZ) for t in texts])
        coded = words.dictionary_encode()
        different = pc.index_in(coded.dictionary, self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        symbol = 1 + classes_of(coded.dictionary)
        if len(self.words):
            own = np.where(different >= 0, self.symbol[different], 0)
            symbol = np.where(own > 0, own, symbol)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        return words, different[codes], symbol[codes], sizes


def ended(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """END, then each text's symbols and END."""
    return np.insert(symbols, np.concatenate(([0], np.cumsum(sizes))), END)


def chunks(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of a batch's texts of about ``BYTES``."""
    text = batch.column(name)
    for a, b in text_runs(pc.binary_length(text).to_numpy(zero_copy_only=False), BYTES):
        yield a, b, text.slice(a, b - a).to_pylist()


# ---------------------------------------------------------------- positions


def grams(s: np.ndarray) -> np.ndarray:
    """For each symbol but the first, it and the DEPTH before it, the latest highest; NOTHING before a text's start."""
    code = np.zeros(len(s) - 1, np.uint64)
    for k in range(DEPTH + 1):
        shift = np.uint64(16 * (DEPTH - k))
        code[max(k - 1, 0) :] |= s[max(1 - k, 0) : len(s) - k].astype(np.uint64) << shift
    starts = np.flatnonzero(s == END)
    for d in range(1, DEPTH):  # d symbols after a start there are d + 1 to see
        at = starts[starts + d < len(s)] + d - 1
        at = at[_reaches(s, starts[starts + d < len(s)], d)]
        code[at] |= np.uint64((1 << 16 * (DEPTH - d)) - 1)
    return code


def _reaches(s: np.ndarray, starts: np.ndarray, d: int) -> np.ndarray:
    """Whether the text that begins at a start still goes on d symbols after it."""
    ok = np.ones(len(starts), bool)
    for j in range(1, d):
        ok &= s[starts + j] != END
    return ok


# ---------------------------------------------------------------- dealing positions


@dataclass
class Dealing:
    """Where positions go: by the symbol before, and that of a crowded symbol by the second symbol before too."""

    home: np.ndarray
    parts: np.ndarray
    buckets: int

    @classmethod
    def of(cls, number: np.ndarray, most: int) -> Dealing:
        """Buckets of about ``most`` places each, by the number of places of each symbol."""
        parts = np.maximum(1, -(-number // most)).astype(np.int64)
        alone = parts > 1
        home = (np.cumsum(np.where(alone, 0, number)) // most).astype(np.int64)
        shared = int(home.max()) + 1
        home[alone] = shared + np.cumsum(parts[alone]) - parts[alone]
        return cls(home, parts, shared + int(parts[alone].sum()))

    def __call__(self, context: np.ndarray) -> np.ndarray:
        before, second = (context >> np.uint64(48)).astype(np.int64), (context >> np.uint64(32)) & np.uint64(NOTHING)
        mixed = ((second * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)) >> np.uint64(8)
        return self.home[before] + mixed.astype(np.int64) % self.parts[before]


_codec = functools.cache(lambda: pa.Codec("zstd", compression_level=1))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers as compressed byte planes."""
    out = []
    for x in arrays:
        planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
        body = _codec().compress(planes, asbytes=True) if planes else b""
        out.append(np.array([len(x), x.itemsize, len(body)], np.int64).tobytes() + body)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, width, size = np.frombuffer(data, np.int64, 3, at).tolist()
        at += 24
        planes = _codec().decompress(data[at : at + size], n * width, asbytes=True) if size else b""
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).reshape(-1).view(f"u{width}"))
        at += size
    return out


def deal(context: np.ndarray, doc: np.ndarray, learnt: np.ndarray, dealing: Dealing) -> Iterator[tuple[int, bytes]]:
    """Bucket and packed positions of a chunk: the different codes (as differences), how often each occurs and
    occurs in training, the documents it occurs in; and of a crowded symbol the symbols after it in all training
    of the chunk, which every bucket of that symbol gets.
    """
    bucket = np.empty(len(context), np.int32)
    for i in range(0, len(context), SLAB):
        bucket[i : i + SLAB] = dealing(context[i : i + SLAB])
    order = np.argsort(bucket, kind="stable")
    bucket, context, doc = bucket[order], context[order], doc[order].astype(np.uint32, copy=False)
    del order
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))).tolist()
    no_symbols = np.empty(0, np.uint16), np.empty(0, np.uint32)
    crowded, after = -1, no_symbols
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        s = int(context[a] >> np.uint64(48))
        if dealing.parts[s] > 1 and s != crowded:  # its buckets follow each other, and hold no other symbol
            end = int(np.searchsorted(bucket, dealing.home[s] + dealing.parts[s]))
            nexts = context[a:end][learnt[doc[a:end]]] & np.uint64(NOTHING)
            number = np.bincount(nexts.astype(np.int64))
            nexts = np.flatnonzero(number)
            crowded, after = s, (nexts.astype(np.uint16), number[nexts].astype(np.uint32))
        by = np.argsort(context[a:b], kind="stable")
        codes, docs = context[a:b][by], doc[a:b][by]
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        times = np.diff(np.append(first, len(codes))).astype(np.uint32)
        trained = np.add.reduceat(learnt[docs], first, dtype=np.uint32)
        steps = np.diff(codes[first], prepend=np.uint64(0))
        yield int(bucket[a]), pack(steps, times, trained, docs, *(after if dealing.parts[s] > 1 else no_symbols))


DEALT = "bucket long, chunk long, data binary"


def _dealt(model):
    """Of each chunk its positions by bucket, and under a negative number its texts' hashes."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, dealing, _ = model.value
        chunk = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, ...]] = []
        size = docs = 0

        def out() -> Iterator[pa.RecordBatch]:
            context, doc, learnt, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            yield row(-1 - chunk % dealing.buckets, pack(hashes.view(np.uint64)))
            for bucket, data in deal(context, doc, learnt, dealing):
                yield row(bucket, data)

        def row(bucket: int, data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int64()), pa.array([chunk], pa.int64()), pa.array([data], pa.binary())], ["bucket", "chunk", "data"]
            )

        for batch in batches:
            for a, b, texts in chunks(batch):
                _, _, symbols, sizes = lexicon.read(texts)
                hashes, learnt = (batch.column(c).slice(a, b - a).to_numpy(zero_copy_only=False) for c in ("text_hash", "learnt"))
                code = grams(ended(symbols, sizes))
                context = (code << np.uint64(16)) | (code >> np.uint64(48))
                held.append((context, np.repeat(np.arange(docs, docs + b - a, dtype=np.uint32), sizes + 1), learnt, hashes))
                size, docs = size + len(held[-1][0]), docs + b - a
                if size >= CHUNK:
                    yield from out()
                    size, docs, chunk = 0, 0, chunk + 1
        if held:
            yield from out()

    return run


# ---------------------------------------------------------------- the tree


@dataclass
class Level:
    """The kept contexts of a length, packed, with each one's share for what lies below; and the probability of

    each symbol seen after one, by context and symbol packed.
    """

    contexts: np.ndarray
    rest: np.ndarray
    keys: np.ndarray
    p: np.ndarray


def find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


def summed(keys: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of each one's numbers."""
    order = np.argsort(keys, kind="stable")
    keys, number = keys[order], number[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(number, first) if len(keys) else number


def probabilities(levels: list[Level], root: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Of codes (contexts, latest first, then the symbol): the symbol's probability in the longest kept suffix's state."""
    after = code & np.uint64(NOTHING)
    p = root[after.astype(np.int64)]
    for d, level in enumerate(levels, 1):
        context = code >> np.uint64(16 * (DEPTH + 1 - d))
        state, kept = find(level.contexts, context)
        at, seen = find(level.keys, context << np.uint64(16) | after)
        if len(level.contexts):
            p = np.where(kept, np.where(seen, level.p[at], level.rest[state] * p), p)
    return p


def grow(code: np.ndarray, number: np.ndarray, root: np.ndarray, above: tuple[np.ndarray, np.ndarray] | None = None) -> list[Level]:
    """The subtree of contexts whose last symbols are those of ``code``, by length.

    ``code`` are different contexts with the symbol after (latest first, that symbol lowest), ``number`` how
    often training has each; ``above`` gives contexts of one symbol with the symbol after, and numbers, where ``code``
    has only some of their places. A context is kept if training has it FLOOR times, its longest proper suffix is
    kept, and its next symbols diverge from those after that suffix: their divergence, times its number,
    must exceed what its own parameters cost, half the log of its number for each (the usual description-length
    bound). Its distribution is its counts, each less a half, and what that leaves shared as after the suffix
    (absolute discounting).
    """
    after, levels = code & np.uint64(NOTHING), []
    for d in range(1, DEPTH + 1):
        context = code >> np.uint64(16 * (DEPTH + 1 - d))
        whole = (context & np.uint64(NOTHING)) != NOTHING  # not longer than the text so far
        if d == 1 and above is not None:
            keys, counts = above
        else:
            keys, counts = summed((context << np.uint64(16) | after)[whole], number[whole])
        owner = keys >> np.uint64(16)
        # what lies below: the same symbol after the suffix, which is the context without its oldest symbol
        symbol = keys & np.uint64(NOTHING)
        if d == 1:
            below, held = root[symbol.astype(np.int64)], np.ones(len(keys), bool)
        else:
            suffix = owner >> np.uint64(16)
            _, held = find(levels[-1].contexts, suffix)
            at, _ = find(levels[-1].keys, suffix << np.uint64(16) | symbol)
            below = levels[-1].p[at] if len(levels[-1].keys) else np.zeros(len(keys))
        keys, counts, owner, below = keys[held], counts[held].astype(np.float64), owner[held], below[held]
        if not len(keys):
            levels.append(Level(keys, np.empty(0), keys, np.empty(0)))
            continue
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        different = np.diff(np.append(first, len(keys)))
        total = np.add.reduceat(counts, first)
        rest = 0.5 * different / total
        p = (counts - 0.5) / np.repeat(total, different) + np.repeat(rest, different) * below
        unseen = np.maximum(1 - np.add.reduceat(below, first), 0)
        divergence = np.add.reduceat(p * np.log(p / below), first) + rest * unseen * np.log(rest)
        good = (total >= FLOOR) & (total * divergence > 0.5 * different * np.log(total))
        each = np.repeat(good, different)
        levels.append(Level(owner[first[good]], rest[good], keys[each], p[each]))
    return levels


def grow_by_symbol(code: np.ndarray, number: np.ndarray, root: np.ndarray, most: int = GROWN) -> list[Level]:
    """``grow`` of sorted codes by runs of whole symbols of about ``most`` codes: a symbol's subtree needs no other's."""
    before = code >> np.uint64(48)
    edges = np.concatenate((np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1]))), [len(code)])) if len(code) else np.zeros(1, int)
    del before
    parts = [grow(code[edges[i] : edges[j]], number[edges[i] : edges[j]], root) for i, j in text_runs(np.diff(edges), most)]
    if not parts:
        return grow(code, number, root)
    return [Level(*(np.concatenate([getattr(p[d], name) for p in parts]) for name in ("contexts", "rest", "keys", "p"))) for d in range(DEPTH)]


def _grown(model):
    """Of each bucket the subtree is grown from all chunks' training, then all chunks' positions are scored in it:

    per chunk, its documents and the sums of their positions' log10 probabilities in units of 1 / UNIT.
    """

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, dealing, root = model.value
        crowded = np.zeros(dealing.buckets, bool)
        for s in np.flatnonzero(dealing.parts > 1).tolist():
            crowded[dealing.home[s] : dealing.home[s] + dealing.parts[s]] = True
        held: list[tuple[int, bytes]] = []
        bucket = -1

        def row(chunk: int, texts: bytes | None, data: bytes | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.array([texts], pa.binary()), pa.array([data], pa.binary())], ["chunk", "texts", "data"]
            )

        def out() -> Iterator[pa.RecordBatch]:
            code, number = np.empty(0, np.uint64), np.empty(0, np.int64)
            above = np.empty(0, np.uint64), np.empty(0, np.int64)
            some: list[tuple[np.ndarray, ...]] = []

            def merge() -> None:
                nonlocal code, number, above
                if some:
                    code, number = summed(np.concatenate([code, *(x[0] for x in some)]), np.concatenate([number, *(x[1] for x in some)]))
                    above = summed(np.concatenate([above[0], *(x[2] for x in some)]), np.concatenate([above[1], *(x[3] for x in some)]))
                    some.clear()

            fresh = 0
            for _, data in held:
                steps, _, trained, _, nexts, count = unpack(data)
                codes, good = np.cumsum(steps, dtype=np.uint64), trained > 0
                first = codes[0] >> np.uint64(48) << np.uint64(16)
                some.append((codes[good], trained[good], first | nexts.astype(np.uint64), count))
                fresh += int(good.sum())
                if fresh >= GROWN:
                    merge()
                    fresh = 0
            merge()
            levels = grow(code, number, root, above) if crowded[bucket] else grow_by_symbol(code, number, root)
            del code, number
            for chunk, data in held:
                steps, occurs, _, doc, *_ = unpack(data)
                p = probabilities(levels, root, np.cumsum(steps, dtype=np.uint64))
                units = np.rint(-np.log10(p) * UNIT).astype(np.int64)
                docs, total = summed(doc, np.repeat(units, occurs))
                yield row(chunk, None, pack(np.diff(docs, prepend=np.uint32(0)), total.view(np.uint64)))

        for batch in batches:
            for i, chunk, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "data")), strict=True):
                if i < 0:
                    yield row(chunk, data, None)
                    continue
                if i != bucket and held:
                    yield from out()
                    held = []
                bucket = i
                held.append((chunk, data))
        if held:
            yield from out()

    return run


@releasing
def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk the texts' hashes with the sums over all buckets. The hashes come first."""
    texts, total, last = np.empty(0, np.uint64), np.empty(0, np.int64), None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(texts.view(np.int64)), pa.array(total)], ["text_hash", "units"])

    for batch in batches:
        for chunk, hashes, data in zip(*(batch.column(c).to_pylist() for c in ("chunk", "texts", "data")), strict=True):
            if chunk != last:
                if last is not None:
                    yield out()
                last, texts = chunk, unpack(hashes)[0]
                total = np.zeros(len(texts), np.int64)
                continue
            steps, units = unpack(data)
            total[np.cumsum(steps, dtype=np.int64)] += units.view(np.int64)
    if last is not None:
        yield out()


def tree_scores(rows: DataFrame, lexicon: Lexicon, number: np.ndarray, most: int = BUCKET) -> DataFrame:
    """``text_hash, units``: of each different text of ``rows`` (``text, text_hash, learnt``) minus the log10 of the

    tree's probability of its symbols, in units of 1 / UNIT; ``number`` is how often training has each symbol.
    Positions travel once, packed by chunk and bucket, and the tree itself never: a task grows the part of it that its
    positions need and scores them there. Sums are of integers, so they are the same for any partitioning.
    """
    spark = rows.sparkSession
    dealing = Dealing.of(number, most)
    whole, width = float(number.sum()), len(number)
    left = np.maximum(number - 0.5, 0)
    weight = max(whole - left.sum(), 0.5)
    root = (left + weight / width) / (left.sum() + weight)
    model = spark.sparkContext.broadcast((lexicon, dealing, root))
    tasks = max(dealing.buckets, spark.sparkContext.defaultParallelism)
    dealt = rows.select("text", "text_hash", "learnt").mapInArrow(_dealt(model), DEALT)
    pieces = dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(_grown(model), "chunk long, texts binary, data binary")
    chunked = pieces.repartition(tasks, "chunk").sortWithinPartitions("chunk", F.col("texts").isNull())
    added = chunked.mapInArrow(_added, "text_hash long, units long").groupBy("text_hash").agg(F.max("units").alias("units"))
    with small_batches(spark):
        return durable(added, "lm-sums")


# ---------------------------------------------------------------- scoring


@releasing
def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, texts in chunks(batch):
            words, _ = split_words([t.translate(AZ) for t in texts])
            yield pa.RecordBatch.from_arrays(pc.value_counts(words).flatten(), ["word", "c"])


def word_counts(texts: DataFrame) -> DataFrame:
    """``word`` (binary), ``c`` over all of ``text`` (binary), summed by chunks and before the shuffle."""
    return texts.select("text").mapInArrow(_word_counts, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def rare_shares(counts: DataFrame, least: float) -> pd.DataFrame:
    """Of each class of rare words: ``class, c, known, new``, its number and the log10 factors of a known word's count and of a new word.

    A class's new words get the share that those seen once have of it (Good and Turing's estimate).
    """
    got = (
        counts.filter(F.col("c") < least)
        .groupBy(class_column(F.col("word")).alias("class"))
        .agg(F.sum("c").alias("c"), F.count_if(F.col("c") == 1).alias("once"))
        .toPandas()
        .set_index("class")
        .reindex(range(CLASSES), fill_value=0)
    )
    new = (got["once"] + 0.5) / (got["c"] + 1)
    known = (1 - new) / got["c"].clip(lower=1)
    return pd.DataFrame({"class": got.index, "c": got["c"], "known": np.log10(known), "new": np.log10(new)})


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", most: int = BUCKET) -> DataFrame:
    """``key, learnt, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs``.

    ``learn`` (of ``id_col``) tells the rows that both models learn from; null counts as yes. Tokens are
    the words between ASCII white space, A-Z lower-cased, and an end. ``base_score`` is that of add-0.1
    unigrams. ``score`` is the log10 probability of the tokens: a symbol's in the state of the tree that
    the symbols before lead to, where frequent words and the end are symbols and other words
    share the symbol of their class, times a rare word's probability in its class, where all words that training
    lacks are one, as in the base. A null text is empty, which is one token; rows of one id are
    scored each by its own text; without a row to learn from the base scores 0 and symbols are
    uniform; an empty table gives none.

    Counts cover all training texts, and any context that training has FLOOR times may be kept, so the tree
    grows with the input. It is never in one place: positions are dealt by the symbols before them, and a task grows the
    subtree under its own and scores them there (``most`` positions, about; a crowded symbol has several tasks, by the
    symbol before it). Scores don't depend on how rows are partitioned, beyond the order in which doubles are added.
    Word counts have no bound: the most frequent words, at most ``1 / HEAVY``, are broadcast, all others
    meet their counts by an equi-join, where none is frequent.
    """
    text = text_or_empty(F.col(text_col))
    rows = docs.select(
        id_key(F.col(id_col)).alias("key"), F.xxhash64(text).alias("text_hash"), F.coalesce(learn, F.lit(True)).alias("learnt"),
        text.cast("binary").alias("text"),
    )
    training = rows.filter("learnt").select("text")
    with small_batches(docs.sparkSession):
        counts = durable(word_counts(training), "word-counts")
    sums = counts.agg(F.sum("c"), F.count("*")).first()
    ends = training.count()
    n_train, v = (sums[0] or 0) + ends, sums[1] + (ends > 0)
    own, least = max(1.0, FREQUENT * n_train), max(1.0, HEAVY * n_train)
    heavy = counts.filter(F.col("c") >= least).toPandas()
    lexicon = Lexicon([bytes(w) for w in heavy["word"]], heavy["c"].tolist(), own)

    shares = rare_shares(counts, own)
    number = np.zeros(lexicon.symbols)
    number[END], number[1 : 1 + CLASSES] = ends, shares["c"]
    frequent = lexicon.symbol > 0
    number[lexicon.symbol[frequent]] = lexicon.counts[frequent]
    tree = tree_scores(rows, lexicon, number, most)
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((lexicon, shares))
    with small_batches(spark):
        each = durable(rows.mapInArrow(_scored(model), SCORED).withColumn("row", F.monotonically_increasing_id()), "lm-rows")

    # words that aren't broadcast meet their counts
    factors = F.broadcast(spark.createDataFrame(shares[["class", "known", "new"]], "class int, known double, new double"))  # CLASSES rows
    light = counts.filter(F.col("c") < least).select("word", "c")
    seldom = (
        each.select("row", F.explode("rare").alias("word")).join(light, "word", "left")
        .withColumn("class", class_column(F.col("word"))).join(factors, "class")
        .select(
            "row", F.coalesce(F.log10(F.col("c") + 0.1), F.lit(-1.0)).alias("lc"),
            F.when(F.col("c").isNull(), F.col("new")).when(F.col("c") < own, F.log10("c") + F.col("known")).otherwise(0.0).alias("lw"),
            F.when(F.col("c").isNull(), 0).otherwise(1).alias("n"),
        )
        .groupBy("row").agg(F.sum("lc").alias("rare_lc"), F.sum("lw").alias("rare_lw"), F.sum("n").alias("rare_n"))
    )
    scale, end = float(np.log10(n_train + 0.1 * (v + 1))), float(np.log10(ends + 0.1))
    rare = lambda c: F.coalesce(F.col(c), F.lit(0))
    return spread_join(each.drop("rare").join(seldom, "row", "left"), tree, ["text_hash"]).select(
        "key", "learnt", "n_tokens",
        (F.col("n") + rare("rare_n") + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("lc") + rare("rare_lc") + end - F.col("n_tokens") * scale).alias("base_score"),
        (F.col("lw") + rare("rare_lw") - F.col("units") / UNIT).alias("score"),
    )


SCORED = (
    "key long, text_hash long, learnt boolean, n_tokens long, lc double, lw double, n long, rare array<binary>"
)


def _scored(model):
    """Of each text: its tokens, and of its broadcast words the sums of the log10 of their

    base numerators (``lc``) and of their probabilities in their class (``lw``, 0 for symbols), and their
    number; the other words.
    """

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, shares = model.value
        lc = np.log10(lexicon.counts + 0.1)
        known = shares["known"].to_numpy()[classes_of(lexicon.words)] if len(lexicon.words) else np.empty(0)
        lw = np.where(lexicon.symbol > 0, 0.0, np.log10(lexicon.counts) + known)
        for batch in batches:
            for a, b, texts in chunks(batch):
                words, place, _, sizes = lexicon.read(texts)
                ends = np.cumsum(sizes)
                here = place >= 0

                first = ends - sizes + np.arange(len(ends))  # of each text, with a place more for its end

                def total(x: np.ndarray, ends=ends, first=first) -> np.ndarray:
                    return np.add.reduceat(np.insert(x, ends, 0), first)

                if len(lexicon.words):
                    sums = [total(np.where(here, v[place], 0.0)) for v in (lc, lw)]
                else:
                    sums = [np.zeros(b - a)] * 2
                rare = words.filter(pa.array(~here))
                offsets = np.concatenate(([0], np.cumsum(total((~here).astype(np.int64))))).astype(np.int32)
                columns = [
                    *(batch.column(c).slice(a, b - a) for c in ("key", "text_hash", "learnt")),
                    pa.array(sizes + 1), *map(pa.array, sums),
                    pa.array(total(here.astype(np.int64))), pa.ListArray.from_arrays(pa.array(offsets), rare),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "text_hash", "learnt", "n_tokens", "lc", "lw", "n", "rare"])

    return run


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    out = score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held)
    return out.select(
        F.nullif("key", F.lit(NULL_ID)).alias("doc_id"), (~F.col("learnt")).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )
