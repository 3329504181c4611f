"""Words and word shingles of whole texts as arrays, many texts at once.

Words are the runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. A word's 64-bit hash
follows from prefix sums of a random value for each byte times powers of an odd base, all modulo 2^64, and a final mixing.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

U = np.uint64
SPACES = b" \t\n\v\f\r"
#: Bytes of text that are worked on at once; a single longer text is a chunk of its own.
CHUNK_BYTES = 2_000_000

_rng = np.random.default_rng(20_240_607)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
STEP = U(0xD6E8FEB86659FD93)
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 to base^(n - 1); tables for texts of an ordinary chunk are kept."""
    found = _powers.get(int(base))
    if found is None or len(found) < n:
        found = np.full(n, base, np.uint64)
        if n:
            found[0] = 1
            np.multiply.accumulate(found, out=found)
        if n <= 2 * CHUNK_BYTES:
            _powers[int(base)] = found
    return found[:n]


class Words:
    """The words of some texts: starts and ends are byte positions in data, first[i]..first[i + 1] are text i's words."""

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        parts = [t or b"" for t in texts]
        data = b" ".join(parts) + b" "
        if lower:
            data = data.translate(LOWER)
        self.data = data
        self.bytes = a = np.frombuffer(data, np.uint8)
        space = IS_SPACE[a]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
        self.starts, self.ends = edge[::2], edge[1::2]
        offsets = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) + 1 for p in parts], out=offsets[1:])
        self.offsets = offsets
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        """One for each word."""
        n = len(self.bytes)
        sums = np.zeros(n + 1, np.uint64)
        values = BYTE_VALUES[self.bytes]
        values *= powers(BASE, n)
        np.cumsum(values, out=sums[1:])
        out = sums[self.ends] - sums[self.starts]
        out *= powers(INVERSE, n)[self.starts]
        out += (self.ends - self.starts).astype(np.uint64)
        return mix64(out)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive words at each place; the last k - 1 places are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= STEP
        out += words[j : j + n]
    return mix64(out)


def places(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all places of k words inside one text: the place and the text."""
    counts = np.diff(first)
    full = np.maximum(counts - k + 1, 0)
    text = np.repeat(np.arange(len(counts)), full)
    start = np.repeat(first[:-1] - (np.cumsum(full) - full), full)
    return start + np.arange(len(text)), text


def give_back() -> None:
    """Returns freed memory to the system: idle workers stay, and would hold what their last task needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run):
    """run, a generator over batches, with give_back() at its end."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of about limit bytes of text; small ones are joined."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = byte_lengths(batch.column(column)) + 1
        total, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            done = total[start - 1] if start else 0
            stop = max(int(np.searchsorted(total, done + limit - size, "right")), start + (not held))
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(total[stop - 1] - done)
            if stop < batch.num_rows:
                yield joined(held)
                held, size = [], 0
            start = stop
    if held:
        yield joined(held)


def byte_lengths(texts: pa.Array) -> np.ndarray:
    """Bytes of each text, or of each list of texts."""
    if pa.types.is_list(texts.type):
        sums = np.concatenate(([0], np.cumsum(byte_lengths(texts.flatten()))))
        ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(texts), 0)))
        return sums[ends] - sums[np.concatenate(([0], ends[:-1]))]
    return np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)).astype(np.int64)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()
