"""Words of texts as flat numpy arrays, shared by the operators that look at words.

A word is ``[^\\x20\\x09-\\x0D]+``. In UTF-8 that is what ``bytes.split()`` yields, as its separators are these six bytes and
no other byte of a character is one of them.
"""

from __future__ import annotations

import ctypes
import functools
import re
from collections.abc import Callable, Hashable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
#: Odd multipliers and the finaliser of splitmix64.
STEP, MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Bytes of text that are taken apart at once, and words whose hash is remembered by a worker.
CHUNK_BYTES, REMEMBERED = 4 << 20, 300_000


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, a bijection of 64 bits."""
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


class WordHashes(dict):
    """word -> 64-bit hash, filled as words come. ``trim`` bounds it."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def trim(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()

    def flat(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of ``docs`` one after another, and the bounds of each document in them (length n + 1)."""
        self.trim()
        bounds = np.zeros(len(docs) + 1, np.int64)
        np.cumsum([len(d) for d in docs], out=bounds[1:])
        return np.fromiter(map(self.__getitem__, chain.from_iterable(docs)), U, int(bounds[-1])), bounds


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that a worker copies few texts at a time; a slice shares its batch's memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def spans(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of about ``most`` in all; whatever is larger is a run of its own."""
    start = total = end = 0
    for end, size in enumerate(sizes, 1):
        if total and total + size > most:
            yield start, end - 1
            start, total = end - 1, 0
        total += size
    if start < end:
        yield start, end


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Slices of ``texts`` of about ``most`` bytes; a longer text is a slice of its own."""
    return spans(map(len, texts), most)


def portions(batches: Iterable[pa.RecordBatch], column: str, most: int | None = None) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches in parts with about ``most`` bytes of text in ``column`` (BLOCK_BYTES, if None), each with a copy of its texts: a worker
    holds a batch and what it makes of one part. A longer text is a part of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        for a, b in spans(sizes.to_pylist(), BLOCK_BYTES if most is None else most):
            part = batch.slice(a, b - a)
            yield part, as_bytes(part.column(column))


#: What a worker keeps for its next task, by whose it is.
_kept: dict[Hashable, object] = {}


def kept(of: Hashable, make: Callable[[], object]) -> object:
    """What ``make`` once made in this worker for ``of``. One thing is kept: what was there for another is dropped first, as a worker
    serves the stages of a pipeline in turn and must not hold the tables of all."""
    if of not in _kept:
        forget()
        _kept[of] = make()
    return _kept[of]


def forget() -> None:
    """Drop what an earlier task of this worker kept; for operators that keep nothing themselves."""
    _kept.clear()


def give_back() -> None:
    """Free memory goes back to the system, where its C library is glibc."""
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def trimmed(task: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A worker's function that gives back free memory after its last batch: workers live on and wait while the JVM beside them needs it."""

    @functools.wraps(task)
    def run(*args, **options) -> Iterator[pa.RecordBatch]:
        yield from task(*args, **options)
        give_back()

    return run


#: A random odd multiplier, its inverse modulo 2^64, and a random number for each byte.
BASE = 0x9FB21C651E98DF25
INVERSE = pow(BASE, -1, 1 << 64)
BYTE = mixed(np.arange(1, 257, dtype=U) * STEP)
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
GAP = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of text whose words are found at once, so that the arrays stay in the processor's caches.
BLOCK_BYTES = 1 << 20


class Powers:
    """Powers of BASE and INVERSE modulo 2^64, as many as were asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.multiply.accumulate(np.r_[U(1), np.full(n - 1, x, U)]) for x in (U(BASE), U(INVERSE)))
        return self.up[:n], self.down[:n]


powers = Powers()


def located(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one, each word's start, end and hash in it, and each text's bounds in the words.

    A word's hash is its part of a running sum of (a number for the byte) * BASE ** place, moved back to place 0.
    """
    raw = b" ".join(texts) + b" "
    data = np.frombuffer(raw, np.uint8)
    gap = SPACE[data]
    edges = np.flatnonzero(np.concatenate([~gap[:1], gap[1:] != gap[:-1]]))
    start, end = edges[0::2], edges[1::2]
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE[data] * up, out=total[1:])
    value = mixed((total[end] - total[start]) * down[start] + (end - start).astype(U) * STEP)
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
    return raw, start, end, value, np.searchsorted(start, begin)


class WordTable:
    """word -> its ids, by ``encode(list of words)`` (ids as the bytes of integers of ``kind``) for words that it doesn't hold.

    A table of SLOTS places by hash, where a later word takes an earlier one's place; ids stand in one array that starts afresh when it
    holds MOST_IDS. Two words that a worker meets share a 63-bit hash with a probability below 1e-6 for millions of words.
    """

    SLOTS, MOST_IDS = 1 << 21, 1 << 23

    def __init__(self, encode, kind: str):
        self.encode, self.kind = encode, np.dtype(kind)
        self.key, self.begin, self.size = (np.zeros(self.SLOTS, t) for t in (U, np.int32, np.int32))
        self.store, self.used = np.zeros(1 << 16, self.kind), 0

    def ids(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        for a, b in chunks(texts, BLOCK_BYTES):
            if b - a == 1 and len(texts[a]) > 2 * BLOCK_BYTES:
                yield np.concatenate([x for part in cut(texts[a]) for x in self._block([part])])
            else:
                yield from self._block(texts[a:b])

    def _block(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        raw, start, end, value, bounds = located(texts)
        value |= U(1)  # 0 is an empty place
        if self.used > self.MOST_IDS:
            self.key[:], self.used = 0, 0
        slot = (value >> U(64 - self.SLOTS.bit_length() + 1)).astype(np.int64)
        begin, size = self.begin[slot], self.size[slot]
        miss = np.flatnonzero(self.key[slot] != value)
        if len(miss):
            _, first, back = np.unique(value[miss], return_index=True, return_inverse=True)
            at = miss[first]
            made = self.encode([raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            n = np.fromiter(map(len, made), np.int64, len(made)) // self.kind.itemsize
            where = self._kept(np.frombuffer(b"".join(made), self.kind)) + np.cumsum(n) - n
            begin[miss], size[miss] = where[back], n[back]
            self.key[slot[at]], self.begin[slot[at]], self.size[slot[at]] = value[at], where, n
        upto = np.zeros(len(value) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        flat = self.store[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])]
        places = upto[bounds].tolist()
        for a, b in zip(places[:-1], places[1:], strict=True):
            yield flat[a:b]

    def _kept(self, ids: np.ndarray) -> int:
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.store):
            self.store = np.concatenate([self.store[:at], np.zeros(2 * self.used - at, self.kind)])
        self.store[at : self.used] = ids
        return at


def cut(text: bytes) -> Iterator[bytes]:
    """A long text in parts of about BLOCK_BYTES that end between words."""
    at = 0
    while at < len(text):
        found = GAP.search(text, at + BLOCK_BYTES)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def windows(flat: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``n`` words inside a document, and each document's bounds in them."""
    counts = np.maximum(np.diff(bounds) - (n - 1), 0)
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    starts = np.repeat(bounds[:-1] - out[:-1], counts) + np.arange(out[-1])
    value = flat[starts]
    for k in range(1, n):
        value = value * STEP + flat[starts + k]
    return mixed(value), out


def shingle_sets(hashes: WordHashes, texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """Each text's sorted set of hashed ``n``-word shingles, A-Z lower-cased. With fewer words: the whole sequence as one."""
    docs = [t.lower().split() for t in texts]
    flat, bounds = hashes.flat(docs)
    value, at = windows(flat, bounds, n)
    sets = []
    for i, words in enumerate(docs):
        if len(words) >= n:
            sets.append(np.unique(value[at[i] : at[i + 1]]))
        elif words:
            sets.append(np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], U))
        else:
            sets.append(np.empty(0, U))
    return sets
