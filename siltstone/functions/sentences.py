"""Sentences of texts and their terms, split and counted as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of texts split at a time; a longer text is split by itself.
SLICE = 2 << 20


def _words(texts: pa.Array, between: str) -> tuple[np.ndarray, pa.DictionaryArray]:
    """How many words each text has, empty ones among them, and all of them, in lower case."""
    lists = pc.split_pattern_regex(texts, between)
    words = lists.flatten().dictionary_encode()
    lower = pc.utf8_lower(words.dictionary).dictionary_encode()
    codes = pa.DictionaryArray.from_arrays(lower.indices.take(words.indices), lower.dictionary)
    return lists.value_lengths().to_numpy(zero_copy_only=False), codes


def _filled(words: pa.DictionaryArray) -> np.ndarray:
    return (pc.binary_length(words.dictionary).to_numpy() > 0)[words.indices.to_numpy()]


def _slices(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield texts[at:to]
        at = to


def _counts(texts: pa.Array, end: str, between: str) -> np.ndarray:
    """n, size, most and terms of counted, a row for each."""
    split = pc.split_pattern(texts, end)
    n = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths, words = _words(split.flatten(), between)
    filled, many = _filled(words), len(words.dictionary)
    term, sentence = words.indices.to_numpy()[filled].astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)[filled]
    text = np.repeat(np.arange(len(texts)), n)
    held = np.sort(sentence * many + term)
    held = held[np.diff(held, prepend=-1) > 0]
    held = np.sort(text[held // many] * many + held % many)
    first = np.flatnonzero(np.diff(held, prepend=-1))
    most, of = np.zeros(len(texts), np.int64), held[first] // many
    np.maximum.at(most, of, np.diff(first, append=len(held)))
    return np.stack([n, np.bincount(text[sentence], minlength=len(texts)), most, np.bincount(of, minlength=len(texts))])


def counted(text: Column, end: str, between: str, slice_bytes: int = SLICE) -> Column:
    """(n, size, most, terms) of a text: its sentences, their words, sentences with its commonest term and different terms.

    Sentences lie between ends, words between matches of the pattern; terms are words in lower
    case. A null text is an empty one: a sentence without words.
    """

    @F.arrow_udf("struct<n: bigint, size: bigint, most: bigint, terms: bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [_counts(part, end, between) for part in _slices(texts.fill_null(""), slice_bytes)]
            each = np.concatenate([np.zeros((4, 0), np.int64), *found], axis=1)
            yield pa.StructArray.from_arrays([pa.array(c) for c in each], names=["n", "size", "most", "terms"])

    return run(text)


def terms(sentence: Column, between: str) -> Column:
    """The terms of a sentence as in counted, with repeats."""

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            lengths, words = _words(texts.fill_null(""), between)
            filled = _filled(words)
            before = np.concatenate([[0], np.cumsum(filled)])
            ends = before[np.concatenate([[0], np.cumsum(lengths)])]
            yield pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words.filter(pa.array(filled)).cast(pa.string()))

    return run(sentence)
