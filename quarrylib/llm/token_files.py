"""Token-id output: texts encoded with a public tokenizer, ids written as coded blocks in id order."""

from __future__ import annotations

import codecs
import functools
import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import range_coder
from .common import AZ, NULL_ID, durable, id_key, kept, marked, releasing, small_batches, split_words, table, text_or_empty, text_runs

#: Ids of a block before it is closed; a document is never split, so a block may be longer.
BLOCK_IDS = 1 << 21
#: Words whose ids a worker remembers before it forgets those that came up once.
MEMORY = 250_000
#: Words that the library is asked for at a time.
BATCH = 256
#: Bytes of text that are cut into words at a time.
CHUNK = 1 << 20
#: Bytes of text for a partition of the sorted documents, about.
PARTITION_BYTES = 48 << 20
ALNUM = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
#: ASCII punctuation but for the apostrophe, which contractions begin with, and the bar of special tokens.
MARKS = bytes(c in b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{}~" for c in range(256))
#: The letters of Latin-1 beyond ASCII are this byte and one of those; capitals lack the bit of 32.
LEAD, LATIN = 0xC3, np.isin(np.arange(256), [c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)])
SMALL = np.array([c | 32 if 0x80 <= c <= 0x9E and c != 0x97 else c for c in range(256)], np.uint8)
LOWER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz"))
#: What the model puts after a word's last symbol; no letter is part of a "<".
END_OF_WORD = "</w>"


def _byte_letters() -> str:
    """The characters that stand for bytes in a byte-level vocabulary; a space stays one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return "".join(" " if c == 32 and next(others) else chr(c) if c in shown else chr(next(others)) for c in range(256))


BYTE_LETTERS = _byte_letters()


def stops(joined: bytes, x: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Runs of punctuation at the end of words, after an ASCII letter or digit or a letter of Latin-1."""
    mark = marked(joined, MARKS)
    edge = np.flatnonzero(mark[1:] != mark[:-1]) + 1  # x ends with a space, so runs are whole
    first, after = edge[mark[edge]], edge[~mark[edge]]
    after = after[len(after) - len(first) :]  # a run at the very start has no letter before
    return first[(ALNUM[x[first - 1]] | (x[first - 2] == LEAD) & LATIN[x[first - 1]]) & space[after]]


def runs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of runs that begin and are as long as given, one run after the other, and where each ends among them."""
    sizes = sizes.astype(np.int64)
    done = np.cumsum(sizes)
    at = np.repeat(starts - (done - sizes), sizes)
    at += np.arange(len(at))
    return at, done


#: What a tokenizer's file says of texts if cutting them leaves all ids as they are. Fixed values.
SAFE_STEPS = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pre_tokenizer": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def cuts_safely(library) -> bool:
    """Whether a tokenizer lower-cases, drops white space and cuts words just as ``Encoder`` relies on."""
    made = json.loads(library.to_str())
    steps = {
        "normalizer": (made.get("normalizer") or {}).get("normalizers"),
        "pre_tokenizer": (made.get("pre_tokenizer") or {}).get("pretokenizers"),
    }
    added = made.get("added_tokens") or []
    plain = all(t["content"].startswith("<|") and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in added)
    return steps == SAFE_STEPS and plain and made["model"]["type"] == "BPE" and not made.get("post_processor") and not made.get("truncation")


class Encoder:
    """Ids of texts by the tokenizers library, asked once for each different word.

    That is for a tokenizer that drops white space, lower-cases and cuts words before it
    merges, as the ``word_bpe`` vocabulary does: then texts may be cut at ASCII white space and before
    punctuation that ends a word after an ASCII letter or digit or a letter of Latin-1, and A-Z be lower-cased,
    without a change of ids. Texts that may hold a special token, or a mark that might compose with a letter, keep
    their case. Words of such letters alone are one piece that no step but lower-casing changes, so they go to the
    library's model straight. ``cuts_safely`` reads from the tokenizer whether this holds; of any other tokenizer,
    or with ``word_split`` false, every text goes to the library whole.
    """

    def __init__(self, path: str, word_split: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.library = Tokenizer.from_file(path)
        word_split = self.word_split = word_split and cuts_safely(self.library)
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items() if t.special and not t.normalized}
        self.mark = next(((t, i) for t, i in special.items() if word_split and t.startswith("<")), None)
        self.bare = None  # the same model without the steps before it
        if word_split and self.library.model.end_of_word_suffix == END_OF_WORD:
            self.bare = Tokenizer(self.library.model)
            self.bare.pre_tokenizer = CharDelimiterSplit(" ")
            vocabulary = self.library.get_vocab()
            self.ends_word = np.zeros(max(vocabulary.values()) + 1, np.bool_)
            self.ends_word[[i for t, i in vocabulary.items() if t.endswith(END_OF_WORD)]] = True
        self.words: dict[bytes, int] = {b"": 0}  # numbers; the first stands for the end of a text
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 1
        self.starts, self.sizes = np.zeros(1 << 18, np.int64), np.ones(1 << 18, np.int32)
        self.met = np.ones(1 << 18, np.int32)

    def forget(self) -> None:
        """Keeps the words that came up in more than one call, and not over half of ``MEMORY``."""
        met = self.met[: len(self.words)]
        met[0] = np.iinfo(met.dtype).max
        again = np.flatnonzero(met > 1)
        again = np.sort(again[np.argsort(-met[again], kind="stable")[: max(1, MEMORY // 2)]])
        keep = np.zeros(len(met), np.bool_)
        keep[again] = True
        self.words = {w: i for i, w in enumerate(compress(self.words, keep))}
        at, done = runs(self.starts[again], self.sizes[again])
        self.flat[: len(at)], self.used = self.flat[at], len(at)
        self.sizes[: len(again)] = self.sizes[again]
        self.starts[: len(again)] = done - self.sizes[: len(again)]
        self.met[: len(again)] = 1

    def ask(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of some texts, one after the other, and how many each has.

        Texts without special tokens go as one, with a special token between them, which parts them.
        """
        decoded = [t.decode("utf-8", "surrogatepass") for t in texts]
        if self.mark and not any(b"<" in t for t in texts):
            ids = np.array(self.library.encode_batch_fast([self.mark[0].join(decoded)], add_special_tokens=False)[0].ids, np.uint32)
            inside = ids != self.mark[1]
            return ids[inside], np.diff(np.flatnonzero(~inside), prepend=-1, append=len(ids)) - 1
        each = [e.ids for e in self.library.encode_batch_fast(decoded, add_special_tokens=False)]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(chain.from_iterable(each), np.uint32, int(sizes.sum())), sizes

    def merge(self, joined: bytes, words: int) -> tuple[np.ndarray, np.ndarray] | None:
        """As ``ask``, of small letters' words with a space between them; none if the model doesn't end each by its mark."""
        decoded = codecs.charmap_decode(joined, "strict", BYTE_LETTERS)[0]
        ids = np.array(self.bare.encode_batch_fast([decoded], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends_word[ids])
        if len(ends) != words or ends[-1] != len(ids) - 1:
            return None
        return ids, np.diff(ends, prepend=-1)

    def plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word is of letters of ASCII and Latin-1 alone, all words in small letters, each with a space after it, and where those are."""
        x = np.frombuffer(b" ".join([*words, b""]).translate(AZ), np.uint8)
        lead = x[:-1] == LEAD
        ok = LOWER[x]
        ok[1:] |= lead & LATIN[x[1:]]
        ok[:-1] |= lead & LATIN[x[1:]]
        small = x.copy()
        small[1:][lead] = SMALL[x[1:][lead]]
        spaces = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        ok[spaces] = True
        return np.diff(np.cumsum(~ok)[spaces], prepend=0) == 0, small, spaces

    def learn(self, fresh: list[bytes]) -> None:
        """Ids for new words, which are numbered from here on."""
        first, after = len(self.words), len(self.words) + len(fresh)
        while after > len(self.starts):
            self.starts, self.sizes, self.met = (np.resize(a, 2 * len(a)) for a in (self.starts, self.sizes, self.met))
        self.met[first:after] = 0
        numbers = np.arange(len(fresh))
        if self.bare:
            plain, small, spaces = self.plain(fresh)
            begins = np.append(0, spaces + 1)
            chosen = small[np.repeat(plain, np.diff(begins))]
            places, numbers = np.flatnonzero(plain), np.flatnonzero(~plain)
            ends = np.cumsum(np.diff(begins)[plain])
            for i in range(0, len(places), BATCH):
                at = places[i : i + BATCH]
                done = self.merge(chosen[ends[i - 1] if i else 0 : ends[i + len(at) - 1] - 1].tobytes(), len(at))
                if done:
                    self.remember(first + at, *done)
                else:  # the whole way, with the others
                    numbers = np.append(numbers, at)
        for i in range(0, len(numbers), BATCH):
            at = numbers[i : i + BATCH]
            self.remember(first + at, *self.ask([fresh[k] for k in at.tolist()]))
        self.words.update(zip(fresh, range(first, after), strict=True))

    def remember(self, at: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.sizes[at], self.starts[at] = sizes, self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, ``end_id`` after each, and how many each has with it."""
        if not texts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if not self.word_split:
            ids, sizes = self.ask(texts)
            return np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
        if len(self.words) > MEMORY:
            self.forget()
        self.flat[0] = end_id
        parts = [t if b"<|" in t or b"\xcc" in t or b"\xcd" in t else t.translate(AZ) for t in texts]
        words, counts = split_words(parts, stops)
        coded = words.dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False)  # quicker than to_pylist
        numbers = np.fromiter(map(self.words.get, different, repeat(-1)), np.int64, len(different))
        new = np.flatnonzero(numbers < 0)
        numbers[new] = len(self.words) + np.arange(len(new))
        if len(new):
            self.learn(different[new].tolist())
        self.met[numbers] += 1
        last = np.cumsum(counts)
        codes = np.insert(numbers[coded.indices.to_numpy()], last, 0)
        at, done = runs(self.starts[codes], self.sizes[codes])
        return self.flat[at], np.diff(done[last + np.arange(len(last))], prepend=0)


def _encoder(path: str, word_split: bool) -> Encoder:
    """One for a worker, which may serve many tasks."""
    encoders = kept("encoders")
    if (path, word_split) not in encoders:
        encoders[path, word_split] = Encoder(path, word_split)
    return encoders[path, word_split]


BLOCKS = "block long, n_ids long, data binary"


def _write(path: str, end_id: int, word_split: bool):
    def block(number: int, keys: list, sizes: list, ids: list) -> pa.RecordBatch:
        joined = np.concatenate(ids)
        ids.clear()  # the coder works beside one copy
        documents = np.concatenate([np.concatenate(keys), np.concatenate(sizes)]).astype("<i8").tobytes()
        columns = [pa.array([number]), pa.array([len(joined)]), pa.array([range_coder.encode(joined, documents)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "n_ids", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, word_split)
        number, keys, sizes, ids, held = 0, [], [], [], 0
        for b in batches:
            key, text = b.column(0).to_numpy(), b.column(1)
            for i, j in text_runs(pc.binary_length(text).to_numpy(zero_copy_only=False), CHUNK):
                got, each = encoder.encode(text.slice(i, j - i).to_pylist(), end_id)
                done = 0
                while done < len(each):  # whole documents until the block is full
                    ends = np.cumsum(each[done:])
                    take = min(len(ends), int(np.searchsorted(ends, BLOCK_IDS - held)) + 1)
                    n = int(ends[take - 1])
                    keys.append(key[i + done : i + done + take])
                    sizes.append(each[done : done + take])
                    ids.append(got[:n])
                    got, done, held = got[n:], done + take, held + n
                    if held >= BLOCK_IDS:
                        yield block(number, keys, sizes, ids)
                        number, keys, sizes, ids, held = number + 1, [], [], [], 0
        if held:
            yield block(number, keys, sizes, ids)

    return releasing(run, "encoders")


def _documents(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of a block, and its documents' keys and numbers of ids."""
    ids, documents = range_coder.decode(data)
    key, sizes = np.frombuffer(documents, "<i8").reshape(2, -1)
    if int(sizes.sum()) != len(ids):
        raise range_coder.Corrupt("the documents' sizes don't add up to the block")
    return ids, key, sizes


@functools.partial(releasing, name="encoders")
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "block", "key", "first", "n_tokens", "ids_crc32"]
    for b in batches:
        for row in b.to_pylist():
            ids, key, sizes = _documents(row["data"])
            ends = np.cumsum(sizes)
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            same = lambda x, n=len(key): np.full(n, x, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (same(row["part"]), same(row["block"]), key, ends - sizes, sizes, np.array(crc, np.int64))], names)


def write_token_files(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
    word_split: bool = True, partitions: int | None = None,
) -> DataFrame:
    """The blocks of a table of texts, written in the shared folder: ``part, block, n_ids, data``.

    Rows go by ascending id, a null id first, rows of one id by their text's hash, also across partitions,
    so that none holds all rows of an id. ``data`` is a block of ``range_coder``; attached to it, under its
    checksum, are the ids of its documents and their numbers of tokens, each with ``end_id`` after it. A
    null or empty text has the end alone; equal rows are written each; an empty table gives no block;
    columns other than id and text, whatever their names, are left out. Blocks are Parquet rows, so
    that Spark commits each task's files once, on any store, however often executors are lost. ``part``
    numbers the sorted partitions; a part's blocks, then the parts, in order are the corpus.
    """
    rows = docs.select(id_key(F.col(id_col)).alias("key"), text_or_empty(F.col(text_col)).alias("text"))
    n = partitions or _partitions(docs)
    ties = F.xxhash64("text")
    sorted_rows = rows.repartitionByRange(n, F.col("key"), ties).sortWithinPartitions("key", ties).withColumn("text", F.col("text").cast("binary"))
    coded = sorted_rows.mapInArrow(_write(path, end_id, word_split), BLOCKS).withColumn("part", F.spark_partition_id().cast("long"))
    with small_batches(docs.sparkSession):
        return durable(coded, "token-blocks")


def _partitions(docs: DataFrame) -> int:
    """By the optimizer's estimate of the input's size, and at least the session's shuffle partitions."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1 << 17, 2 * size // PARTITION_BYTES))


def read_token_files(blocks: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from blocks: places in the corpus, checked and decoded.

    A row for each document, null ids and repeated rows included; without blocks none. A damaged block raises.
    """
    by_part = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    whole = by_part.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")
    inside = Window.partitionBy("part").orderBy("block")
    places = (
        blocks.select("part", "block", "n_ids")
        .withColumn("inside", F.sum("n_ids").over(inside) - F.col("n_ids"))
        .join(whole, "part")
        .select("part", "block", (F.col("before") + F.col("inside")).alias("at"))
    )
    docs = blocks.select("part", "block", "data").mapInArrow(
        _read, "part long, block long, key long, first long, n_tokens long, ids_crc32 long"
    )
    return docs.join(places, ["part", "block"]).select(
        F.nullif("key", F.lit(NULL_ID)).alias("doc_id"),
        (F.col("at") + F.col("first")).alias("start"), "n_tokens", "ids_crc32",
    )


def token_ids(blocks: DataFrame) -> DataFrame:
    """``doc_id, ids`` of all documents in blocks, a row for each, the end id last. A damaged block raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, key, sizes = _documents(row["data"])
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(key), lists], ["key", "ids"])

    out = blocks.select("data").mapInArrow(run, "key long, ids array<long>")
    return out.select(F.nullif("key", F.lit(NULL_ID)).alias("doc_id"), "ids")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary()))
