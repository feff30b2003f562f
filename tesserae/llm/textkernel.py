"""Vectorised byte kernels shared by the corpus operators that run in Arrow batches.

Everything works on the raw UTF-8 buffers of an Arrow string column, in blocks of
bounded size, so that memory follows the block and not the Arrow batch.  A null
text is an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one block holds, unless a single text is longer.
BLOCK_BYTES = 1 << 20

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))

#: Bytes that separate words: space and the controls \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_SHINGLE = np.array(
    [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
    dtype=U64,
)


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand and shared by a worker."""

    up = np.ones(1, U64)
    down = np.ones(1, U64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) >= n:
            return cls.up[:n], cls.down[:n]
        up, down = np.full(n, _BASE, U64), np.full(n, _BASE_INV, U64)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        if n <= 8 * BLOCK_BYTES:  # one very long text must not pin its tables for good
            cls.up, cls.down = up, down
        return up, down


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of at most ``limit`` bytes (or one longer row).

    Yields ``(first row, end row, bytes, offsets)``; offsets are relative to the bytes.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    n = len(texts)
    if n == 0:
        return
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None and raw[2].size else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


class Words:
    """The words of a block: where they start and end, and how many each row has."""

    __slots__ = ("counts", "ends", "first", "rows", "starts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n, rows = len(data), len(offsets) - 1
        if n == 0:
            self.starts = self.ends = np.empty(0, np.int64)
            self.rows = np.empty(0, np.int64)
            self.counts = np.zeros(rows, np.int64)
            self.first = np.zeros(rows + 1, np.int64)
            return
        inside = ~SPACE[data]
        cut = np.zeros(n + 1, bool)  # a row's end is a word's end too
        cut[offsets] = True
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | cut[1:n]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | cut[1:n]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.rows = np.repeat(np.arange(rows), self.counts)


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    n = len(data)
    if n == 0:
        return np.empty(0, U64)
    up, down = _Powers.get(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:n], out=sums[1:])
    h = (sums[words.ends] - sums[words.starts]) * down[words.starts]
    return mix(h ^ ((words.ends - words.starts).astype(U64) * U64(0x2545F4914F6CDD1D)))


def shingle_hashes(hashes: np.ndarray, words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each row, and the word index each starts at."""
    n = len(hashes)
    if n < k:
        return np.empty(0, U64), np.empty(0, np.int64)
    m = n - k + 1
    total = np.zeros(m, U64)
    for j in range(k):
        total += hashes[j : j + m] * (_SHINGLE[j % 5] + U64(2 * (j // 5)))
    at = np.flatnonzero(words.rows[:m] == words.rows[k - 1 :])
    return mix(total[at]), at


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Per row, the sorted distinct hashes of its k-word windows over lower-cased (A-Z) words.

    A row with one to k-1 words has its whole sequence as its single member; a row without words has none.
    """
    lowered = LOWER[data]
    words = Words(lowered, offsets)
    h = word_hashes(lowered, words)
    s, at = shingle_hashes(h, words, k)
    bounds = np.searchsorted(at, words.first)
    out = []
    for r in range(len(offsets) - 1):
        n = words.counts[r]
        if n >= k:
            out.append(np.unique(s[bounds[r] : bounds[r + 1]]))
        elif n:
            own = h[words.first[r] : words.first[r + 1]]
            whole = np.array([len(own)], U64)
            for j in range(len(own)):
                whole = mix(whole * U64(0x9FB21C651E98DF25) + own[j])
            out.append(whole)
        else:
            out.append(np.empty(0, U64))
    return out


def set_digest(members: np.ndarray) -> int:
    """A signed 64-bit fingerprint of a set of hashes, by its members and their number."""
    total = int(mix(members ^ U64(0xC2B2AE3D27D4EB4F)).sum(dtype=U64)) + len(members) * 0x165667B19E3779F9
    return int(mix(np.array([total & (1 << 64) - 1], U64)).view(np.int64)[0])
