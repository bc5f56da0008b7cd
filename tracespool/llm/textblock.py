"""Vectorised views of Arrow text columns: bytes, words, lines and their rolling hashes, without a loop per word.

A block is a slice of a column of bounded size.  All hashes are polynomial in an odd base modulo 2**64: a prefix
sum over the block gives the hash of any byte range, so equal words have equal hashes wherever they stand.
"""
from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
U64 = np.uint64


def tidy(run: Callable) -> Callable:
    """Gives memory back to the system when a task ends: workers live on, and keep what they have freed, for later stages."""
    @wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # of the GNU library only
            libc.malloc_trim(0)
    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (public splitmix64 finaliser)."""
    x = x.astype(U64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


CODE = mix(np.arange(1, 257, dtype=U64))  # a random-looking number for each byte
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
MARKS = np.zeros(256, bool)  # ASCII characters that are neither letters nor digits
MARKS[[b for b in range(128) if not chr(b).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(1 << bits, base, U64)
        out[0] = 1
        with np.errstate(over="ignore"):
            return np.cumprod(out, dtype=U64)
    return run(BASE), run(pow(BASE, -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n + 1 powers of the base and of its inverse."""
    return _powers(max(16, int(n).bit_length()))


def slices(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose text has at most ``limit`` bytes, or one row."""
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    ends = np.cumsum(size)
    lo = 0
    while lo < len(size):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield lo, hi
        lo = hi


class Block:
    """The texts of a slice of a column (null: empty) as one run of bytes; document d is off[d] to off[d + 1]."""

    def __init__(self, column: pa.Array, lower: bool = False):
        col = pc.fill_null(column.cast(pa.large_string()), "")
        _, offsets, data = col.buffers()
        off = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
        raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.off = off - off[0]
        self.raw = LOWER[raw] if lower else raw
        self.docs = len(col)
        self._prefix = None

    def cut_words(self, between: np.ndarray = SPACE) -> None:
        """Words are maximal runs of other bytes than those between: starts, ends, doc and first word of each doc."""
        inside = ~between[self.raw]
        edge = np.zeros(len(self.raw) + 1, bool)
        edge[self.off] = True
        here = np.flatnonzero(inside)
        if len(here):
            self.starts = here[edge[here] | ~inside[here - 1] | (here == 0)]
            after = np.append(inside[1:], False)
            self.ends = here[edge[here + 1] | ~after[here]] + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.inside = inside
        self.first = np.searchsorted(self.starts, self.off)
        self.word_doc = np.repeat(np.arange(self.docs), np.diff(self.first))

    def range_hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of each byte range."""
        up, down = powers(len(self.raw))
        with np.errstate(over="ignore"):
            if self._prefix is None:
                self._prefix = np.zeros(len(self.raw) + 1, U64)
                np.cumsum(CODE[self.raw] * up[:len(self.raw)], out=self._prefix[1:])
            return mix((self._prefix[hi] - self._prefix[lo]) * down[lo])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, doc) of each line between newline characters, empty ones included."""
        cut = np.flatnonzero(self.raw == 10)
        starts = np.sort(np.concatenate([self.off[:-1], cut + 1]), kind="stable")
        doc_of_cut = np.searchsorted(self.off, cut, side="right") - 1
        doc = np.sort(np.concatenate([np.arange(self.docs), doc_of_cut]), kind="stable")
        ends = np.sort(np.concatenate([self.off[1:], cut]), kind="stable")
        return starts, ends, doc

    def chars(self) -> np.ndarray:
        """1 for each byte that begins a code point."""
        return (self.raw & 0xC0) != 0x80


def per_doc(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values over off[d] to off[d + 1]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def repeated(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items (doc ascending, key): does the item's key stand more than once in its doc; does it stand earlier there."""
    many = np.zeros(len(key), bool)
    later = np.zeros(len(key), bool)
    if len(key):
        with np.errstate(over="ignore"):
            both = mix(key + doc.astype(U64) * U64(0xD1B54A32D192ED03))
        order = np.argsort(both, kind="stable")
        same = both[order][1:] == both[order][:-1]
        later[order[1:][same]] = True
        many[order[1:][same]] = True
        many[order[:-1][same]] = True
    return many, later
