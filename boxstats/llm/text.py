"""Byte-level views of text columns: every text of an Arrow batch as one numpy array.

Texts are whole; a null text is an empty one. Batches are cut into runs of documents of about
``RUN_BYTES``, so the work arrays of a task stay small whatever the batch size; one longer
document makes a run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RUN_BYTES = 1_000_000
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def once(key, make):
    """``make()``, kept for the life of this Python worker."""
    import sys

    store = sys.__dict__.setdefault("_boxstats_worker", {})
    if key not in store:
        store[key] = make()
    return store[key]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(batch: pa.RecordBatch, column: str = "text", limit: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` cut into slices of whole rows with about ``limit`` bytes of text each."""
    _, offsets = utf8(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield batch.slice(start, stop - start)
        start = stop
    give_back()


def give_back() -> None:
    """Returns freed memory to the system; a worker otherwise keeps the most it ever used."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def short_batches(spark, rows: int = 1000) -> None:
    """Arrow batches of whole texts: ten thousand rows, the usual size, are too long for them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, rows)


def space_mask(data: np.ndarray) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(SPACES)] = True
    return table[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs outside ``separator``; runs end with their row."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = ~separator
    first = inside.copy()
    first[1:] &= separator[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= separator[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """62-bit hashes of any byte ranges of one array, equal for equal bytes wherever they lie.

    Two polynomials modulo primes, each with a base of its own. (One modulo 2^64 would give some long regular
    texts, such as Thue-Morse words, the same hash whatever its base.)
    """

    PRIMES = (2**31 - 1, 2**31 - 19)
    BASES = (1_234_567_891, 1_999_999_927)
    #: Bytes whose terms add up without overflow.
    BLOCK = 1 << 20

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums, self.inverses = [], []
        for prime, base in zip(Rolling.PRIMES, Rolling.BASES):
            sums = np.zeros(n + 1, np.int64)
            np.multiply(_VALUES[data], Rolling.powers(base, prime, n), out=sums[1:])
            total = 0
            for start in range(1, n + 1, Rolling.BLOCK):
                part = sums[start : start + Rolling.BLOCK]
                np.cumsum(part, out=part)
                part += total
                total = int(part[-1]) % prime
            self.sums.append(sums)
            self.inverses.append(Rolling.powers(pow(base, -1, prime), prime, n + 1))

    @staticmethod
    def powers(base: int, prime: int, n: int) -> np.ndarray:
        def make(count):
            out = np.ones(1, np.int64)
            while len(out) < count:
                out = np.concatenate([out, out * pow(base, len(out), prime) % prime])
            return out[:count]

        kept = once(("powers", base, prime), lambda: make(RUN_BYTES + 2))
        return kept[:n] if n <= len(kept) else make(n)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """uint64 hashes of the ranges."""
        low, high = (
            ((sums[ends] - sums[starts]) % prime * inverse[starts] % prime).astype(np.uint64)
            for sums, inverse, prime in zip(self.sums, self.inverses, Rolling.PRIMES)
        )
        body = (high << np.uint64(31)) | low
        return mix64(body + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


# Terms of bytes: at most 2^8, so that BLOCK of them times a power stay below 2^59.
_VALUES = np.arange(1, 257, dtype=np.int64)


def window_hashes(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word windows inside rows, and the index of each first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[:n] == rows[width - 1 :])
    out = np.zeros(len(at), np.uint64)
    for j in range(width):
        out = mix64(out * np.uint64(0x2545F4914F6CDD1D) + words[at + j])
    return out, at

