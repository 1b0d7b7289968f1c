"""Adaptive context-mixing range coder for token ids, in independent, checksummed blocks.

A block's ids lie in lanes, runs of equal length that are coded side by side, each by a range coder of
its own, under one model. The model starts anew in each block and learns from each step's ids
in all lanes, first in the coder, then alike in the decoder. The probability of an id is the weighted sum
of what three predictions give it:

- order 2: all on the id that last followed the two ids before it, by a hashed table;
- order 1: all on the id that last followed the id before it;
- order 0: the frequencies of the ids so far, at least one part of ``1 << bits0`` for each.

Both tables keep a confidence, raised by hits and lowered by misses. For each pair of confidences,
and whether the two agree, the share of hits so far gives the weights of the mixture; order 0 always keeps some.
An id's range begins where the ranges of all smaller ids end, in the sum of the three.

Layout of a block, little-endian: magic ``TKB2``; uint32 ids, lanes, symbols, table bits, bytes of the
alphabet, CRC-32 of the ids as uint32; uint64 bytes of the attachment; the alphabet, by zlib, where the symbols
are numbers in a sorted list of the block's ids rather than ids; the attachment; for each lane the
number of its 32-bit words; the words, lane by lane; the CRC-32 of all before. Nothing outside a
block is needed to read it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC, HEAD = b"TKB2", struct.Struct("<4s6IQ")
#: Lanes of a block, and the steps a lane should have at least.
LANES, STEPS = 16384, 192
#: Steps whose ids are gathered from all lanes at a time.
SLAB = 32
#: Resolution of the whole mixture, and of order 0 at least; weights take what is left.
BITS, BITS0 = 32, 20
#: Ids from here on are coded as numbers in the list of a block's ids.
DIRECT = 1 << 18
#: Least share of the weight that order 0 has.
FLOOR = 96 / 4096
TOP = 7  # highest confidence, three bits
#: Steps after which order 0 and the weights are counted anew: early ones, then every so many.
EARLY, EVERY0, EVERY = (1, 2, 4, 8, 16, 32), 64, 8
WORD, LOW32 = np.uint64(32), np.uint64(0xFFFFFFFF)


class Corrupt(ValueError):
    """A block that isn't whole."""


class Model:
    def __init__(self, symbols: int, bits: int):
        self.bits, self.symbols = bits, symbols
        self.bits0 = max(BITS0, symbols.bit_length() + 2)
        self.whole = 1 << (BITS - self.bits0)  # of the weights
        self.order1, self.order2 = np.zeros(symbols, np.int32), np.zeros(1 << bits, np.int32)  # id << 3 | confidence
        self.counts = np.zeros(symbols, np.int64)
        states = 2 * (TOP + 1) ** 2
        self.seen, self.hits2, self.hits1 = (np.zeros(states, np.int64) for _ in range(3))
        self.ids: list[np.ndarray] = []
        self.states: list[np.ndarray] = []
        self.step = 0
        self.weigh()
        self.count()

    def slots(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Places in the order-2 table for the last id and the one before."""
        mixed = (one.astype(np.uint32) * np.uint32(0x9E3779B1)) ^ (two.astype(np.uint32) * np.uint32(0x85EBCA6B))
        return ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - self.bits)

    def predict(self, one: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, ...]:
        """Both tables' entries, the ids they predict and the state of the mixture."""
        entry2, entry1 = self.order2[slot], self.order1[one]
        two, first = entry2 >> 3, entry1 >> 3
        state = ((entry2 & TOP) << 4) | ((entry1 & TOP) << 1) | (two == first)
        return entry2, entry1, two, first, state

    def learn(self, ids, one, slot, entry2, entry1, state, hit2, hit1) -> None:
        """``hit1``: whether order 1 names the id, also where order 2 does."""
        fresh = ids << 3
        for table, at, entry, hit in ((self.order2, slot, entry2, hit2), (self.order1, one, entry1, hit1)):
            sure = entry & TOP
            table[at] = np.where(hit, entry + (sure < TOP), np.where(sure > 0, entry - 1, fresh))
        self.ids.append(ids)
        self.states.append((state << 2) | (hit2.astype(np.int32) << 1) | hit1)
        self.step += 1
        if self.step in EARLY or self.step % EVERY == 0:
            self.weigh()
        if self.step in EARLY or self.step % EVERY0 == 0:
            self.count()

    def weigh(self) -> None:
        if self.states:
            both = np.bincount(np.concatenate(self.states), minlength=4 * len(self.seen)).reshape(-1, 4)
            self.seen += both.sum(1)
            self.hits2 += both[:, 2] + both[:, 3]
            self.hits1 += both[:, 1]
            self.states.clear()
        whole = self.whole - max(1, int(self.whole * FLOOR))
        w2 = (self.hits2 * 2 + 1) * whole // (self.seen * 2 + 6)
        w1 = np.minimum((self.hits1 * 2 + 1) * whole // (self.seen * 2 + 6), whole - w2)
        w1[1::2] = 0  # both name the same id, which has the weight of both
        self.w0 = (self.whole - w1 - w2).astype(np.uint64)
        self.w1, self.w2 = ((w << self.bits0).astype(np.uint64) for w in (w1, w2))

    def count(self) -> None:
        if self.ids:
            self.counts += np.bincount(np.concatenate(self.ids), minlength=self.symbols)
            self.ids.clear()
        free = (1 << self.bits0) - self.symbols
        freq = 1 + self.counts * free // max(1, int(self.counts.sum()))
        self.table = None
        self.freq, self.cum = freq.astype(np.uint64), np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)

    def symbol(self, at: np.ndarray) -> np.ndarray:
        """The ids whose order-0 parts hold some places."""
        if self.bits0 > BITS0:
            return np.searchsorted(self.cum, at, "right").astype(np.int32) - 1
        if self.table is None:
            self.table = np.repeat(np.arange(self.symbols, dtype=np.int32), self.freq.astype(np.int64))
        return self.table[at.astype(np.intp)]


def _shape(n: int) -> tuple[int, int]:
    """Lanes and steps of a block of n ids."""
    steps = max(1, -(-n // max(1, min(LANES, n // STEPS))))
    return max(1, -(-n // steps)), steps


def _steps(x: np.ndarray) -> Iterator[np.ndarray]:
    """The columns of a matrix, copied some at a time."""
    for k in range(0, x.shape[1], SLAB):
        yield from np.ascontiguousarray(x[:, k : k + SLAB].T)


def encode(ids: np.ndarray, attached: bytes = b"") -> bytes:
    """A block of ids, each a uint32, and of what is attached to them."""
    ids = np.asarray(ids)
    if ids.dtype != np.uint32:
        ids = ids.astype(np.int64)
        if ids.min(initial=0) < 0 or ids.max(initial=0) >> 32:
            raise ValueError("ids must be from 0 below 1 << 32")
    check, alphabet = zlib.crc32(np.ascontiguousarray(ids, "<u4")), b""
    n, symbols = len(ids), int(ids.max(initial=0)) + 1
    if symbols > DIRECT:
        different, ids = np.unique(ids, return_inverse=True)
        symbols, alphabet = len(different), zlib.compress(np.diff(different.astype(np.int64), prepend=0).astype("<u4").tobytes())
    bits = max(8, min(20, n.bit_length() + 1))
    lanes, steps = _shape(n)
    head = HEAD.pack(MAGIC, n, lanes, symbols, bits, len(alphabet), check, len(attached)) + alphabet + attached
    at = np.zeros(lanes * steps, np.int32)
    at[:n] = ids
    model = Model(symbols, bits)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    words: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    one = two_back = np.zeros(lanes, np.int32)
    for now in _steps(at.reshape(lanes, steps)):
        slot = model.slots(one, two_back)
        entry2, entry1, two, first, state = model.predict(one, slot)
        hit2, hit1 = two == now, first == now
        unit, w0, w1, w2 = span >> WORD, model.w0[state], model.w1[state], model.w2[state]
        low += unit * (w0 * model.cum[now] + w1 * (first < now) + w2 * (two < now))
        span = unit * (w0 * model.freq[now] + w1 * hit1 + w2 * hit2)
        short = np.flatnonzero(span <= LOW32)
        if len(short):
            lo, sp = low[short], span[short]
            across = (lo ^ (lo + sp - np.uint64(1))) >> WORD != 0
            words.append((lo >> WORD).astype("<u4"))
            owners.append(short.astype(np.int16))
            low[short], span[short] = lo << WORD, np.where(across, (~lo + np.uint64(1)) & LOW32, sp) << WORD
        model.learn(now, one, slot, entry2, entry1, state, hit2, hit1)
        two_back, one = one, now
    for part in (low >> WORD, low & LOW32):
        words.append(part.astype("<u4"))
        owners.append(np.arange(lanes, dtype=np.int16))
    owner = np.concatenate(owners)
    body = head + np.bincount(owner, minlength=lanes).astype("<u4").tobytes() + np.concatenate(words)[np.argsort(owner, kind="stable")].tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def decode(block: bytes) -> tuple[np.ndarray, bytes]:
    """The ids of a block and what is attached to them; Corrupt if a checksum doesn't hold."""
    if len(block) < HEAD.size + 4 or block[:4] != MAGIC or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise Corrupt("not a whole block")
    _, n, lanes, symbols, bits, listed, check, more = HEAD.unpack_from(block)
    begin = HEAD.size + listed
    alphabet, attached, begin = block[HEAD.size : begin], block[begin : begin + more], begin + more
    per_lane = np.frombuffer(block, "<u4", lanes, begin).astype(np.int64)
    words = np.frombuffer(block, "<u4", int(per_lane.sum()), begin + 4 * lanes).astype(np.uint64)
    steps = -(-n // lanes) if n else 1
    out = np.zeros((steps, lanes), np.int32)
    model = Model(symbols, bits)
    place = np.cumsum(per_lane) - per_lane
    code = (words[place] << WORD) | words[place + 1]
    place += 2
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    one = two_back = np.zeros(lanes, np.int32)
    for k in range(steps):
        slot = model.slots(one, two_back)
        entry2, entry1, two, first, state = model.predict(one, slot)
        unit, w0, w1, w2 = span >> WORD, model.w0[state], model.w1[state], model.w2[state]
        at = (code - low) // unit
        begin2, size2 = w0 * model.cum[two] + w1 * (first < two), w0 * model.freq[two] + w2
        begin1, size1 = w0 * model.cum[first] + w2 * (two < first), w0 * model.freq[first] + w1
        hit2 = at - begin2 < size2  # a smaller place wraps round to a great one
        in1 = ~hit2 & (at - begin1 < size1)
        now = np.where(hit2, two, first)
        begin, size = np.where(hit2, begin2, begin1), np.where(hit2, size2, size1)
        rest = np.flatnonzero(~(hit2 | in1))
        past = (at[rest] >= begin1[rest]) * w1[rest] + (at[rest] >= begin2[rest]) * w2[rest]
        s, own = model.symbol((at[rest] - past) // w0[rest]), w0[rest]
        now[rest] = s
        begin[rest], size[rest] = past + own * model.cum[s], own * model.freq[s]
        low += unit * begin
        span = unit * size
        short = np.flatnonzero(span <= LOW32)
        if len(short):
            lo, sp = low[short], span[short]
            across = (lo ^ (lo + sp - np.uint64(1))) >> WORD != 0
            code[short] = (code[short] << WORD) | words[place[short]]
            place[short] += 1
            low[short], span[short] = lo << WORD, np.where(across, (~lo + np.uint64(1)) & LOW32, sp) << WORD
        out[k] = now
        model.learn(now, one, slot, entry2, entry1, state, hit2, first == now)
        two_back, one = one, now
    ids = out.T.ravel()[:n]
    del out, words
    if listed:
        ids = np.cumsum(np.frombuffer(zlib.decompress(alphabet), "<u4").astype(np.int64))[ids]
    ids = ids.view("<u4") if ids.dtype == np.int32 else ids.astype("<u4")
    if zlib.crc32(ids) != check:
        raise Corrupt("the ids don't match their checksum")
    return ids, attached
