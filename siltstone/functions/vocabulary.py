"""Counts over the words of texts by what each different word holds, which is found out once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts split at a time, and words of which a task keeps what they hold.
TEXTS, KEPT = 512, 100_000


def counted(text: Column, between: str, describe: Callable[[str], tuple[int, tuple[int, ...]]], places: int) -> Column:
    """(n, hits) of a text: the sum of its words' numbers, and how often they name each of so many places.

    Words lie between matches of the pattern; describe(word) is the word's number and the places
    it names, with repeats: (0, ()) for an empty word. Words are split, coded and summed as
    arrays, and only different ones are looked at. Null texts are empty.
    """

    @F.arrow_udf("struct<n: bigint, hits: array<bigint>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = lru_cache(KEPT)(describe)

        def some(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            lists = pc.split_pattern_regex(texts.fill_null(""), between)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            coded = lists.flatten().dictionary_encode()
            found = [held(w) for w in coded.dictionary.to_pylist()]
            code, named = coded.indices.to_numpy(), [i for i, (_, hits) in enumerate(found) if hits]
            before = np.concatenate([[0], np.cumsum(np.array([n for n, _ in found], np.int64)[code])])
            sums = np.zeros((len(texts), places), np.int64)
            for at in np.flatnonzero(np.isin(code, named)):
                for place in found[code[at]][1]:
                    sums[np.searchsorted(ends, at, side="right"), place] += 1
            return before[ends] - before[np.concatenate([[0], ends[:-1]])], sums

        for texts in batches:
            each = [some(texts[i : i + TEXTS]) for i in range(0, len(texts), TEXTS)] or [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            hits = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * places), pa.array(np.concatenate([h.reshape(-1) for _, h in each])))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate([n for n, _ in each])), hits], names=["n", "hits"])

    return run(text)
