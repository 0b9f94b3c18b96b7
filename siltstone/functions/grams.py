"""N-grams of texts as hashes: the different ones of some texts, and those that a single text has."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa

#: Words and texts that are looked at at once, one text at least, and the number that stands for several of those texts.
WORDS, TEXTS, SEVERAL = 1_000_000, 60_000, 65_535


def _mixed(x: np.ndarray) -> np.ndarray:
    """The bits of numbers spread over all of them, one to one (the last steps of MurmurHash3)."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> np.uint64(33)) * np.uint64(factor)
    return x ^ x >> np.uint64(33)


def slices(words: pa.Array) -> Iterator[pa.Array]:
    """A column of words' hashes in runs of at most WORDS words and TEXTS texts, or of one text."""
    ends, start = np.cumsum(words.value_lengths().fill_null(0).to_numpy()), 0
    while start < len(words):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, min(start + TEXTS, int(np.searchsorted(ends, before + WORDS, side="right"))))
        yield words[start:stop]
        start = stop


def hashed(words: pa.Array, sizes: tuple[int, ...]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The number of words of each text, and for each size the 64-bit hashes of all n-grams and the places of their texts. words are hashes of 64 bits."""
    lengths = words.value_lengths().fill_null(0).to_numpy()
    each = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    text_of = np.repeat(np.arange(len(words)), lengths)
    found, longer = {1: (each, text_of)}, each
    for size in range(2, max(sizes) + 1):
        longer = _mixed(longer[:-1] * np.uint64(0x9E3779B97F4A7C15) + each[size - 1 :])
        whole = text_of[: len(longer)] == text_of[size - 1 :]
        found[size] = (longer[whole], text_of[: len(longer)][whole])
    return lengths, [found[size] for size in sizes]


def share(hashes: np.ndarray, shares: int) -> np.ndarray:
    """The share, of so many, that each hash lies in; shares are ranges."""
    return ((hashes >> np.uint64(32)) * np.uint64(shares) >> np.uint64(32)).astype(np.int64)


def different(hashes: np.ndarray, text_of: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many different hashes each text has, all of them once in their order, and the text of each or SEVERAL. text_of grows."""
    order = np.argsort(hashes, kind="stable")
    hashes, text_of = hashes[order], text_of[order]
    first = np.ones(len(hashes), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    own = first.copy()
    own[1:] |= text_of[1:] != text_of[:-1]
    begin = np.flatnonzero(first)
    holders = np.add.reduceat(own, begin, dtype=np.int64) if len(begin) else begin
    return np.bincount(text_of[own], minlength=texts), hashes[begin], np.where(holders > 1, SEVERAL, text_of[begin]).astype(np.uint16)


def alone(hashes: list[np.ndarray], text_of: list[np.ndarray]) -> list[np.ndarray]:
    """Of the different hashes of several runs of texts, how many each text has that no other has, for each run, up to the last text with one."""
    everything = np.concatenate(hashes)
    order = np.argsort(everything)
    in_order = everything[order]
    apart = np.ones(len(order) + 1, bool)
    apart[1:-1] = in_order[1:] != in_order[:-1]
    single = np.zeros(len(order), bool)
    single[order] = apart[1:] & apart[:-1]
    ends = np.cumsum([0, *map(len, hashes)])
    return [np.bincount(t[single[a:b] & (t != SEVERAL)]) for t, (a, b) in zip(text_of, pairwise(ends), strict=True)]
