"""What the corpus operators share: vectorised word hashing over Arrow text, checkpoint folders and session facts."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa

from vecinity.plans.lineage import partitions, saved, scratch  # noqa: F401

U = np.uint64


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Helper names that no column has, whatever its case: the wanted ones behind as many underscores as it takes."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def released(fn):
    """fn for mapInArrow; after a task's last batch freed memory goes back to the system, since Spark keeps the worker and what it holds counts beside later stages."""

    @functools.wraps(fn)
    def run(batches):
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # a C library without it
            pass

    return run


#: Base of the polynomial word hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MASK = (1 << 64) - 1


def byte_table(separators) -> np.ndarray:
    """True for the bytes that belong to words."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Words [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z. UTF-8 keeps ASCII apart, so bytes decide.
SPACED = byte_table([0x20, *range(9, 14)])
ALNUM = byte_table([*range(0, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Powers:
    """Powers of BASE and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int):
        if n > len(self.up):
            n = max(n, 1 << 20)
            self.up, self.down = (self._powers(b, n) for b in (BASE, INVERSE))
        return self.up, self.down

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(n, U)
        k, step = 1, base
        while k < n:  # doubling: out[k:2k] = out[:k] * base**k
            m = min(k, n - k)
            np.multiply(out[:m], U(step), out=out[k : k + m])
            step = step * step & MASK
            k *= 2
        return out


POWERS = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = x ^ (x >> U(31))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(32)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column without copying, and each row's offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = 1 << 20):
    """Row ranges of about size bytes; a longer text stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Hash of each word, where it starts and ends in data, and the first word of each row (one more entry than rows)."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    low = LOWER[data]
    inside = table[low]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:n]
    first, last = np.flatnonzero(start), np.flatnonzero(end)
    up, down = POWERS.upto(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum((low.astype(U) + U(1)) * up[:n], out=sums[1:])
    hashes = mix((sums[last + 1] - sums[first]) * down[first] + U(0xD6E8FEB86659FD93) * (last - first).astype(U))
    return hashes, first, last + 1, np.searchsorted(first, offsets)


def odd_constants(n: int, seed: int) -> list[int]:
    """Odd multipliers for the places of an n-gram."""
    rng = np.random.default_rng(seed)
    return [int(x) | 1 for x in rng.integers(1 << 62, 1 << 63, n, dtype=np.int64)]


PLACES = odd_constants(64, 11)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on (shorter by n - 1 than hashes)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = np.zeros(m, U)
    for k in range(n):
        out += hashes[k : k + m] * U(PLACES[k])
    return mix(out + U(n))
