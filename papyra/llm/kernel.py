"""Words of Arrow string columns as NumPy arrays.

Texts are handled as one byte buffer at a time, so that splitting, lower-casing and
hashing are a few array operations instead of a Python loop over words.  A word's hash
is a polynomial over random byte values modulo 2**64, then mixed; all words of a buffer
come from one running sum.  Two given words collide with a chance near 2**-60, and ids are
only ever compared for equality, so counts keyed by them are counts of words.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; one longer text is handled alone.
CHUNK = 1 << 19
U = np.uint64

_rng = np.random.default_rng(20240917)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = int(_rng.integers(1, 2**62)) * 4 + 1
BASE_INVERSE = pow(BASE, -1, 2**64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The white space of the contracts: space and \t \n \v \f \r.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Letters and digits; every byte of a non-ASCII character counts as one.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[48:58] = WORD_BYTE[65:91] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if size == CHUNK + 1:
            _powers[base] = have
    return have[:n]


def release() -> None:
    """Hand freed memory back to the system: workers are reused, and what each keeps adds up over a pipeline's stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function over batches that releases memory after each batch it returns and at its end."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        for out in run(batches):
            yield out
            del out
            release()
        release()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose high and low bits all depend on all of x."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def string_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """The words of rows lo..hi-1 of a batch.

    ``bounds[i]:bounds[i + 1]`` are the words of row ``lo + i``; ``start`` and ``end``
    are byte positions in ``raw``, ``offsets`` the rows' byte positions there.
    """

    lo: int
    hi: int
    raw: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    sums: np.ndarray

    @property
    def hash(self) -> np.ndarray:
        return self.hash_of(self.start, self.end)

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        back = powers(BASE_INVERSE, len(self.raw) + 1)
        return mix((self.sums[end] - self.sums[start]) * back[start])

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.bounds))


def words(column: pa.Array, word_bytes: np.ndarray = NOT_SPACE, chunk: int = CHUNK) -> Iterator[Words]:
    """The words (runs of word_bytes, A-Z lower-cased) of a column, some rows at a time."""
    data, offsets = string_views(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk, side="right")) - 1)
        raw = data[offsets[lo] : offsets[hi]]
        at = offsets[lo : hi + 1] - offsets[lo]
        low = LOWER[raw]
        inside = word_bytes[raw]
        starts, ends = inside.copy(), inside.copy()
        if len(raw):
            follows = inside[:-1].copy()
            starts[1:] &= ~follows
            ends[:-1] &= ~inside[1:]
            first, last = at[:-1][at[:-1] < len(raw)], at[1:][at[1:] > 0] - 1
            starts[first] |= inside[first]
            ends[last] |= inside[last]
        start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[low] * powers(BASE, len(raw)), out=sums[1:])
        yield Words(lo, hi, raw, at, start, end, np.searchsorted(start, at), sums)
        lo = hi


def hash_words(terms: list[str]) -> np.ndarray:
    """The hashes that ``words`` gives these words, each of which holds word bytes only."""
    out = np.zeros(len(terms), np.uint64)
    for k, term in enumerate(terms):
        raw = LOWER[np.frombuffer(term.encode(), np.uint8)]
        total = np.sum(BYTE_VALUE[raw] * powers(BASE, len(raw)), dtype=np.uint64) if len(raw) else U(0)
        out[k] = mix(np.array([total], np.uint64))[0]
    return out


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n neighbouring hashes."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m].copy()
    for k in range(1, n):
        out = mix(out * U(0x9E3779B97F4A7C15) + hashes[k : k + m])
    return out


def shingle_sets(found: Words, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-word shingles); the whole sequence where there are fewer words."""
    every = found.hash
    for row in range(found.hi - found.lo):
        own = every[found.bounds[row] : found.bounds[row + 1]]
        yield found.lo + row, np.unique(chain(own, min(n, len(own)))) if len(own) else own


def long_array(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def word_counts(column: pa.Array, chunk: int = 1 << 23) -> np.ndarray:
    """Words ([^\\x20\\x09-\\x0D]+) of each row; nulls have none."""
    data, offsets = string_views(column)
    out = np.zeros(len(offsets) - 1, np.int64)
    lo = 0
    while lo < len(out):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk, side="right")) - 1)
        at = offsets[lo : hi + 1] - offsets[lo]
        inside = NOT_SPACE[data[offsets[lo] : offsets[hi]]]
        begins = inside.copy()
        if len(begins):
            begins[1:] &= ~inside[:-1]
            first = at[:-1][at[:-1] < len(begins)]
            begins[first] = inside[first]
        out[lo:hi] = np.diff(np.searchsorted(np.flatnonzero(begins), at))
        lo = hi
    return out
