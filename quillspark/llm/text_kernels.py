"""Vectorised numpy kernels over Arrow string batches: word spans, 64-bit word and window hashes.

A word is a maximal run of bytes other than space and U+0009 to U+000D. All kernels work on the UTF-8
bytes of a whole batch at once, so the cost per word is a few numpy operations and no Python objects.
"""

from __future__ import annotations

import ctypes
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SEPARATORS = b" \t\n\v\f\r"
_BASE = 0x9E3779B97F4A7C15 | 1
_SEGMENT = 1 << 20


def _table(fold: bool) -> np.ndarray:
    """One random 64-bit value for each byte; with fold, A-Z take the values of a-z."""
    t = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    if fold:
        t[65:91] = t[97:123]
    return t


TABLES = {False: _table(False), True: _table(True)}
IS_WORD = np.ones(256, bool)
IS_WORD[list(SEPARATORS)] = False


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.full(n, b, U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    column = column.cast(pa.string()) if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)) else column
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the runs of member bytes; first[d]:first[d+1] are the runs of text d."""
    inside = member[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    lo, hi = offsets[:-1], offsets[1:]
    full = hi > lo
    before[lo[full]] = False
    after[hi[full] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hash of the bytes of each span, equal for equal bytes wherever they stand."""
    out = np.empty(len(starts), U64)
    table, i = TABLES[fold], 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _SEGMENT, "right")))
        part = data[base : ends[j - 1]]
        up, down = _powers(max(_SEGMENT, 1 << (len(part) - 1).bit_length()) + 1)
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(table[part] * up[: len(part)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(U64)
        i = j
    return mix(out)


def words(column: pa.Array, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first, hashes) of the words of a string column."""
    data, offsets = text_buffers(column)
    starts, ends, first = spans(data, offsets)
    return data, starts, ends, first, span_hashes(data, starts, ends, fold)


class _Powers(dict):
    def __missing__(self, n: int):
        self[n] = U64(pow(0xD6E8FEB86659FD93, n, 2**64))
        return self[n]


_POWER = _Powers()


def window_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive symbols; entry j covers symbols j to j+k-1."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h, length = symbols, 1
    for bit in bin(k)[3:]:  # doubles the length, and adds one symbol for each further bit
        h = h[: len(h) - length] * _POWER[length] + h[length:]
        length *= 2
        if bit == "1":
            h = h[: len(symbols) - length] * _POWER[1] + symbols[length:]
            length += 1
    return mix(h + U64(k))


def text_keys(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of every whole text, as a signed integer; another seed gives 64 further bits."""
    import xxhash

    whole = memoryview(np.ascontiguousarray(data))
    return np.array([xxhash.xxh3_64_intdigest(whole[a:b], seed) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], U64).view(np.int64)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Smallest of every n consecutive values."""
    span = 1
    while span < n and len(x):
        step = min(span, n - span)
        x = np.minimum(x[: len(x) - step], x[step:])
        span += step
    return x


def trim() -> None:
    """Gives memory that a finished task has freed back to the system: Python workers stay for later tasks and stages."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def batches_by_bytes(batches, column: str, limit: int = 2 << 20):
    """Record batches cut so that the texts of one column hold at most limit bytes, or one text."""
    for batch in batches:
        i = batch.schema.get_field_index(column)
        _, off = text_buffers(batch.column(i))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
    trim()


LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the capital letters of ASCII and Latin-1 made small."""
    out = data.copy()
    capital = (out >= 65) & (out <= 90)
    capital[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[capital] += 0x20
    return out
