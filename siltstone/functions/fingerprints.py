"""Fingerprints and entropies of texts, from Arrow batches of them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EDGE = re.compile(r"^[^\w]+|[^\w]+$")


@F.arrow_udf(T.LongType())
def simhash(texts: pa.Array) -> pa.Array:
    """64 bits of a text, alike for like texts: each is set if the hashes (first half of MD5) of over half of its lower-case word trigrams have it.

    Words lose punctuation at their ends; texts of under three words are hashed by word. Null and empty texts have 0.
    """
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts.to_pylist()):
        words = [w for w in (_EDGE.sub("", x) for x in (text or "").split()) if w]
        grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or words
        if grams:
            raw = b"".join(hashlib.md5(g.lower().encode()).digest()[:8] for g in grams)
            bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * bits > len(grams), bitorder="little").view(np.uint64)[0]
    return pa.array(out.view(np.int64))


@F.arrow_udf(T.DoubleType())
def character_entropy(texts: pa.Array) -> pa.Array:
    """Shannon entropy of a text's characters in bits; 0 for null ones and those of under two characters."""
    out = np.zeros(len(texts))
    for i, text in enumerate(texts.to_pylist()):
        if text and len(text) > 1:
            _, counts = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_counts=True)
            p = counts / len(text)
            out[i] = -(p * np.log2(p)).sum()
    return pa.array(out)


#: Texts split at a time, and words whose bits are summed at once, each bit as a byte; as a byte holds no more, at most 255 in a first sum.
TEXTS, SUMMED_WORDS, BYTE = 2048, 65_536, 255


def digests(words: pa.Array, domain: str, limbs: int) -> np.ndarray:
    """8 bytes for each limb of each word: the first of the MD5 of the domain, the word and the limb's number in 8 bytes."""
    _, offsets, data = words.cast(pa.string()).buffers()
    ends, raw = np.frombuffer(offsets, np.int32, len(words) + 1).tolist(), data.to_pybytes() if data else b""
    prefix, numbers = domain.encode(), [limb.to_bytes(8, "little") for limb in range(limbs)]
    found = [hashlib.md5(prefix + raw[i:j] + number).digest()[:8] for i, j in pairwise(ends) for number in numbers]
    return np.frombuffer(b"".join(found), np.uint8).reshape(len(words), 8 * limbs)


def _summed(digests: np.ndarray, codes: np.ndarray, text_of: np.ndarray, texts: int) -> np.ndarray:
    """For each text and bit, from each digest's first byte's highest one on, how many of its words have it. text_of grows."""
    sums = np.zeros((texts, digests.shape[1] * 8), np.int64)
    bits = np.unpackbits(digests, axis=1)
    step = max(1, SUMMED_WORDS * 8 // digests.shape[1])
    for low in range(0, len(codes), step):
        own = text_of[low : low + step]
        begin = np.flatnonzero(np.diff(own, prepend=-1))
        size = np.diff(begin, append=len(own))
        shares = -(-size // BYTE)
        place = np.arange(shares.sum()) - np.repeat(np.cumsum(shares) - shares, shares)
        each = np.add.reduceat(bits.view(np.uint64)[codes[low : low + step]], np.repeat(begin, shares) + place * BYTE, axis=0).view(np.uint8)
        sums[own[begin]] += np.add.reduceat(each, np.cumsum(shares) - shares, axis=0, dtype=np.int64)
    return sums


def word_sums(text: Column, domain: str, limbs: int) -> Column:
    """(n, sums) of a text: its words and for each limb 32 sums over them, of bit i and, 32 bits up, of bit 32 + i.

    Words lie between ASCII white space, A-Z in lower case; a limb is a word's 8 bytes as a number,
    the first highest. Each different word of some texts is hashed once. Null texts are empty.
    """

    @F.arrow_udf("struct<n: bigint, sums: array<array<bigint>>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def some(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            low = pc.ascii_lower(texts.fill_null(""))
            for white in "\t\n\f\r":
                low = pc.replace_substring(low, white, " ")
            lists = pc.split_pattern(low, " ")
            coded = lists.flatten().dictionary_encode()
            codes, text_of = coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
            empty = pc.index(coded.dictionary, "").as_py()  # beside white space
            if empty >= 0:
                kept = codes != empty
                codes, text_of = codes[kept], text_of[kept]
            sums = _summed(digests(coded.dictionary, domain, limbs), codes, text_of, len(texts)).reshape(len(texts), limbs, 64)[:, :, ::-1]
            return np.bincount(text_of, minlength=len(texts)).astype(np.int64), sums[:, :, :32] | sums[:, :, 32:] << 32

        for texts in batches:
            found = [some(texts[i : i + TEXTS]) for i in range(0, len(texts), TEXTS)]
            n = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in found)])
            sums = pa.array(np.concatenate([np.zeros((0, limbs, 32), np.int64), *(x for _, x in found)]).reshape(-1))
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(n) * limbs + 1, dtype=np.int32) * 32), sums)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * limbs), each)
            yield pa.StructArray.from_arrays([pa.array(n), lists], names=["n", "sums"])

    return run(text)
