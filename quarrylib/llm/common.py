"""Columns and tables that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylib.session import drop_durable, durable, shared_dir, spread_join  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ``[\x20\x09-\x0D]``: what separates words in the contracts.
SPACES = " \t\n\x0b\x0c\r"
#: Stands for a null id in grouping keys; it sorts before all others.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(c: Column) -> Column:
    """A-Z lower-cased, all else kept. Pure ASCII takes the quicker built-in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def id_key(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(NULL_ID))


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


#: What a Python worker keeps between tasks, by the name of the operator that keeps it.
_kept: dict[str, dict] = {}


def kept(name: str) -> dict:
    return _kept.setdefault(name, {})


def releasing(run: Callable, name: str = "") -> Callable:
    """A partition function that gives memory back to the system.

    A Python worker lives on between tasks, beside those of other stages. What operators other than ``name``
    kept in it goes when a task begins, and freed memory is returned when it ends.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        forget_others(name)
        yield from run(batches)
        give_back()

    return wrapped


def forget_others(name: str) -> None:
    for other in [k for k in _kept if k != name]:
        del _kept[other]


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


#: Bytes of rows in a small batch, about; a longer row makes one of its own.
BATCH_BYTES = 4 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans that run inside hand rows to Python workers by bytes rather than by number.

    Both sides hold a whole batch, and 10,000 rows of long texts have no bound.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


AZ = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
IS_SPACE = bytes(chr(c) in SPACES for c in range(256))


def marked(data: bytes, table: bytes) -> np.ndarray:
    """Whether each byte is one that a table of 256 holds a 1 for; bytes.translate needs no wide index."""
    return np.frombuffer(data.translate(table), np.bool_)


def split_words(
    texts: list[bytes], more: Callable[[bytes, np.ndarray, np.ndarray], np.ndarray] | None = None
) -> tuple[pa.Array, np.ndarray]:
    """The words between ASCII white space of some texts, in one array, and how many words each text has.

    ``more``, of all bytes, as such and as an array, and whether each is white space, gives places
    inside words where another begins.
    """
    joined = b"\n".join([*texts, b""])
    x = np.frombuffer(joined, np.uint8)
    space = marked(joined, IS_SPACE)
    start = ~space
    start[1:] &= space[:-1]
    if more is not None:
        start[more(joined, x, space)] = True
    cuts = np.flatnonzero(space | start)
    word = np.flatnonzero(start[cuts])
    starts = cuts[word]
    offsets = np.zeros(len(word) + 1, np.int32)
    np.cumsum(cuts[np.minimum(word + 1, len(cuts) - 1)] - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(word), [None, pa.py_buffer(offsets), pa.py_buffer(x[~space])])
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return words, np.diff(np.searchsorted(starts, ends), prepend=0)


def text_runs(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of texts of so many bytes, each of about ``most`` in all."""
    total, out, i = np.cumsum(sizes), [], 0
    while i < len(total):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        out.append((i, j))
        i = j
    return out
