"""Words, word hashes and shingles of whole texts, vectorised over the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are scanned in blocks of about so many bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Runs of ASCII digits, ASCII letters and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

#: Everything but space and the control characters from tab to carriage return.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[32] = False
NON_SPACE[9:14] = False

_RANDOM = np.random.RandomState(20240501)
_BYTE = _RANDOM.randint(0, 2**62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(4) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
PLACE = _RANDOM.randint(0, 2**62, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, UTF-8 bytes, offsets from 0) for runs of rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """The words of one block: byte starts and ends, the text each is in, a 64-bit hash, words before each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = True):
        self.n_texts = len(offsets) - 1
        self.data = LOWER[data] if lower else data
        n = len(data)
        inside = kind[self.data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        filled = offsets[1:] > offsets[:-1]
        before[offsets[:-1][filled]] = False
        after[offsets[1:][filled] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.text = np.searchsorted(offsets, self.starts, side="right") - 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hash = self._hashes(kind)

    def _hashes(self, kind: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        base = self.starts[0]
        lengths = np.diff(np.append(self.starts, len(self.data)))
        place = np.arange(base, len(self.data)) - np.repeat(self.starts, lengths)
        spans = self.ends - self.starts
        powers = np.multiply.accumulate(np.full(int(lengths.max()), _STEP, np.uint64))
        table = np.where(kind, _BYTE, np.uint64(0))
        terms = table[self.data[base:]] * powers[place]
        return mix64(np.add.reduceat(terms, self.starts - base) + spans.astype(np.uint64) * PLACE[63])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k consecutive words of one text, and the index of the first word of each."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        whole = np.flatnonzero(self.text[:n] == self.text[k - 1 :])
        total = self.hash[whole] * PLACE[0]
        for j in range(1, k):
            total += self.hash[whole + j] * PLACE[j]
        return mix64(total + np.uint64(k)), whole

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """As windows, but a text of one to k - 1 words has all its words as its one shingle; sorted by text."""
        hashes, at = self.windows(k)
        parts, places = [hashes], [at]
        counts = np.diff(self.first)
        for length in range(1, k):
            f = self.first[:-1][counts == length]
            if len(f):
                total = self.hash[f] * PLACE[0]
                for j in range(1, length):
                    total += self.hash[f + j] * PLACE[j]
                parts.append(mix64(total + np.uint64(length)))
                places.append(f)
        hashes, at = np.concatenate(parts), np.concatenate(places)
        order = np.argsort(at, kind="stable") if len(parts) > 1 else slice(None)
        return hashes[order], at[order]


def distinct_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and the offsets of the texts in them."""
    hashes, at = words.shingles(k)
    bounds = np.searchsorted(at, words.first)
    sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    sizes = np.fromiter((len(s) for s in sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else hashes), np.concatenate([[0], np.cumsum(sizes)])
