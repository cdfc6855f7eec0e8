"""Words, word hashes and shingles of Arrow text columns, by numpy over whole blocks of bytes.

A word is a run of bytes other than ASCII white space, or other than ASCII signs too; ASCII capitals count as small letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space and all other ASCII signs but letters and digits.
SIGNS = np.zeros(256, bool)
SIGNS[:128] = True
SIGNS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


LONG = 512  # bytes; longer strings are hashed one by one


def string_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each string of bytes, the same wherever it stands: its length and its eights of
    bytes, mixed after each. Strings of over LONG bytes take a cryptographic digest."""
    size = end - start
    state = mix(size.astype(U) * U(0xD1342543DE82EF95) + U(0x9E3779B97F4A7C15))
    if not len(size):
        return state
    padded = np.r_[data, np.zeros(8, np.uint8)]
    eights = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))
    active = np.flatnonzero((size > 0) & (size <= LONG))
    for at in range(0, int(size[active].max(initial=0)), 8):
        active = active[size[active] > at]
        left = np.minimum(size[active] - at, 8).astype(U)
        piece = eights[start[active] + at] & (U(0xFFFFFFFFFFFFFFFF) >> (U(64) - U(8) * left))
        state[active] = mix(state[active] * U(0xA0761D6478BD642F) + piece)
    for i in np.flatnonzero(size > LONG):
        state[i] = int.from_bytes(blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return state


def column_blocks(col: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, bytes, and offsets into them, of blocks of rows of about ``limit``
    bytes; a longer text is a block of its own. A null text has no bytes."""
    col = col.fill_null("").cast(pa.large_string())
    n = len(col)
    off = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1))
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the index of its first word (one more at
    the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    full = ~between[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = np.flatnonzero(full & ~(np.r_[False, full[:-1]] & ~edge[:n]))
    end = np.flatnonzero(full & ~(np.r_[full[1:], False] & ~edge[1:])) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, the same wherever it stands, ASCII capitals being small letters."""
    return string_hashes(LOWER[data], start, end)


def shingles(wh: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words of each row and their offsets; a row of fewer words,
    but at least one, has one shingle of all of them."""
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    off = np.r_[0, np.cumsum(n)]
    at = np.repeat(first[:-1] - off[:-1], n) + np.arange(off[-1])
    size = np.repeat(np.minimum(count, k), n)
    acc = np.zeros(len(at), U)
    padded = np.r_[wh, np.zeros(k, U)]
    for i in range(k):
        acc = acc * U(0xA0761D6478BD642F) + np.where(i < size, padded[at + i], U(0))
    return mix(acc + size.astype(U)), off
