"""Words of many texts at once, as numpy arrays over Arrow string buffers.

Texts stay in their Arrow buffer: word bounds and 64-bit word hashes are
computed for a few megabytes of documents per numpy call.  A hash is a
polynomial over a fixed random table, then mixed; two different words
agree with probability about 2**-64.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000
_MASK = (1 << 64) - 1


def _splitmix(n: int, seed: int) -> np.ndarray:
    out, x = [], seed
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=np.uint64)


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_TABLE = _splitmix(256, 1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Byte tables: 32 and 9 to 13 separate words; or all but letters and bytes over 127 do.
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
NOT_LETTERS = np.ones(256, dtype=bool)
NOT_LETTERS[65:91] = NOT_LETTERS[97:123] = NOT_LETTERS[128:] = False
_powers = np.ones(64, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """Yields (first row, bytes, offsets) for runs of rows of about ``limit`` bytes; nulls are empty."""
    column = column.cast(pa.string()) if not pa.types.is_string(column.type) else column
    column = column.fill_null("")
    if not len(column):
        return
    _, raw, data = column.buffers()
    off = np.frombuffer(raw, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def bounds(buf: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACES):
    """Byte starts and ends of all words, and each text's first word (one more at the end)."""
    n = len(buf)
    inside = ~separators[buf]
    cut = np.zeros(n + 1, dtype=bool)
    cut[off] = True
    before = np.ones(n, dtype=bool)
    after = np.ones(n, dtype=bool)
    if n:
        before[1:] = ~inside[:-1]
        after[:-1] = ~inside[1:]
    starts = np.flatnonzero(inside & (before | cut[:n]))
    ends = np.flatnonzero(inside & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each word, A-Z taken as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    spot = np.arange(int(lens.sum())) - np.repeat(first, lens)
    at = spot + np.repeat(starts, lens)
    global _powers
    if lens.max() > len(_powers):
        _powers = powers(int(lens.max()) + 64)
    values = _TABLE[_FOLD][buf[at]]
    values *= _powers[spot] if len(_powers) > 64 else powers(64)[spot]
    return mix(np.add.reduceat(values, first) + lens.astype(np.uint64))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words (runs that cross texts are the caller's to skip)."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    p = powers(k + 1, np.uint64(0xD6E8FEB86659FD93))
    out = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for j in range(k):
        out += words[j : len(words) - k + 1 + j] * p[j + 1]
    return mix(out)


_libc = ctypes.CDLL(None)


def give_back() -> None:
    """Gives memory that is free again to the system: workers are used again for other operators, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def trimmed(run):
    """``run`` over batches; what it held goes back to the system when it has ended."""

    def out(batches):
        yield from run(batches)
        give_back()

    return out


def rows(batches, columns: list[str]):
    """Batches as they come, kept to ``columns``."""
    for batch in batches:
        yield [batch.column(batch.schema.get_field_index(c)) for c in columns]
    give_back()
