"""Vectorised text helpers that run inside tasks: batches of texts as byte arrays, word bounds, span hashes.

Texts of an Arrow batch are joined into blobs of about half a megabyte (a longer text is a blob of its own), so numpy works
on whole blobs and memory stays bounded by the batch, whatever the number or the length of the texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from acreage.session import plain_reads

BLOB_BYTES = 1 << 19
PIECE_BYTES = 1 << 22

#: The white space that ends a word, \x20 and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(20, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def blobs(texts: list[bytes | None], limit: int = BLOB_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts: (first row, row after the last, bytes, start of each text, end of each text).

    Every text is followed by one line feed, so no word crosses two texts. Nulls are empty.
    """
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last] or b"") < limit):
            size += len(texts[last] or b"") + 1
            last += 1
        part = [t or b"" for t in texts[first:last]]
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        yield first, last, np.frombuffer(b"\n".join(part) + b"\n", np.uint8), starts, starts + lengths
        first = last


def small_batches(df: DataFrame) -> DataFrame:
    """Lets the session hand batches of 4 MB and not 64 MB to Python, unless it was told otherwise, and read plainly; returns ``df``.

    A batch is held by the JVM, twice while its buffer grows, and, with its successor, by Python, for each running task.
    """
    plain_reads(df)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key) == "67108864b":
        df.sparkSession.conf.set(key, "4m")
    return df


def give_back() -> None:
    """Hand memory that is free again to the system, so that idle workers of an executor hold little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes of the given text column, so a task holds few texts as Python objects."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0, 0]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)
        pa.default_memory_pool().release_unused()
    batch = None
    _POWERS.clear()
    give_back()


def encoded(texts: list[str | None], lower: bool = False) -> list[bytes | None]:
    """UTF-8 of every text; ``lower`` lower-cases A-Z only."""
    if lower:
        return [None if t is None else t.encode().lower() for t in texts]
    return [None if t is None else t.encode() for t in texts]


def prefix_sums(blob: np.ndarray) -> np.ndarray:
    """Sums of letter values times rising powers, modulo 2**64; a span's hash is a difference of two."""
    up, _ = _powers(len(blob) + 1)
    out = np.empty(len(blob) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_LETTER[blob] * up[: len(blob)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes give equal hashes wherever they stand."""
    _, down = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true flags."""
    padded = np.zeros(len(flags) + 2, np.int8)
    padded[1:-1] = flags
    step = np.diff(padded)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def words(blob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, maximal runs of bytes that are not white space."""
    return runs(~SPACE[blob])


def distinct(sorted_values: np.ndarray) -> np.ndarray:
    keep = np.ones(len(sorted_values), bool)
    np.not_equal(sorted_values[1:], sorted_values[:-1], out=keep[1:])
    return sorted_values[keep]


_STEPS = mix(np.arange(1001, 1065, dtype=np.uint64)) | np.uint64(1)


def window_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of ``k`` consecutive values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, k, np.uint64)
    for j in range(k):
        total = total + values[j : j + n] * _STEPS[j]
    return mix(total)


def shingle_sets(texts: list[bytes | None], k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its shingles of ``k`` words); fewer words are one shingle, no word none."""
    for first, _, blob, starts, ends in blobs(texts):
        begins, stops = words(blob)
        hashes = span_hashes(prefix_sums(blob), begins, stops)
        grams = window_hashes(hashes, k)
        lo, hi = np.searchsorted(begins, starts), np.searchsorted(begins, ends)
        for i in range(len(starts)):
            n = hi[i] - lo[i]
            if n >= k:
                own = grams[lo[i] : hi[i] - k + 1].copy()
                own.sort()
                yield first + i, distinct(own)
            elif n:
                yield first + i, window_hashes(hashes[lo[i] : hi[i]], int(n))
            else:
                yield first + i, np.empty(0, np.uint64)
