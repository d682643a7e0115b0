"""Vectorised work on the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is worked on alone.
SLAB = 1 << 20

_M = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
BASE_2 = 0xC2B2AE3D27D4EB4F
#: White space of the contracts: 0x09-0x0D and 0x20.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        a = np.full(max(n, SLAB + 4096), base, np.uint64)
        a[0] = 1
        _powers[base] = have = np.cumprod(a, dtype=np.uint64)
    return have[:n]


def inverse_powers(base: int, n: int) -> np.ndarray:
    return powers(pow(base, -1, 1 << 64), n)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def prefix_sums(buf: np.ndarray, base: int) -> np.ndarray:
    """H with H[e]-H[s] = sum of (buf[i]+1)*base**i over s <= i < e."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(base, len(buf)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of the bytes in each span that depends only on those bytes."""
    inv = inverse_powers(base, len(sums) + 1)
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def slabs(texts: pa.Array, limit: int = SLAB) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of its rows in them and their end) for groups of rows of about limit bytes; null is empty."""
    texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])  # rebased, so that offsets start at the buffer
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words [^\\x20\\x09-\\x0D]+; words never cross rows."""
    if not len(buf):
        return (np.empty(0, np.int64),) * 3
    solid = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)  # a row begins here
    edge[off] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1
