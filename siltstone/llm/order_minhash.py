"""Document fingerprints by Order MinHash (operator 3).

The k-mers are K consecutive words; equal ones of a text are told apart by occurrence
numbers. Each of N_HASHES permutations selects the two least k-mers, puts them back into
text order and hashes the pair, so moving or replacing text changes the fingerprint where a
set sketch would not see the order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.llm._cluster import bounded
from siltstone.llm._textscan import NON_SPACE, Words, blocks, mix64

K = 3
N_HASHES = 64

#: Ranges of document ids number at most this; one row for each goes to the driver.
MAX_RANGES = 8192

#: Rows of a range, where the shuffle partitions alone would give more.
RANGE_ROWS = 50_000

_SEEDS = np.random.RandomState(11).randint(1, 2**32, (N_HASHES, 2), dtype=np.uint64).astype(np.uint32)
_LOW32 = np.uint64(0xFFFFFFFF)


def _occurrences(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How often each k-mer of a text came before in that text."""
    key = mix64(hashes + (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    out = np.zeros(len(key), np.uint64)
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice):
        table = np.zeros(1 << 16, bool)
        table[twice >> np.uint64(48)] = True
        some = np.flatnonzero(table[key >> np.uint64(48)])
        at = np.argsort(key[some], kind="stable")
        own = key[some][at]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        out[some[at]] = (np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))).astype(np.uint64)
    return out


def _block_prints(data: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    words = Words(data, offsets, NON_SPACE, lower=False)
    hashes, at = words.shingles(k)
    out = np.zeros((len(offsets) - 1, len(_SEEDS)), np.uint16)
    if not len(hashes):
        return out
    text = words.text[at]
    value = mix64(hashes + _occurrences(hashes, text) * np.uint64(0xD6E8FEB86659FD93))
    bounds = np.searchsorted(text, np.arange(len(offsets)))
    full = np.flatnonzero(np.diff(bounds))
    starts, single = bounds[:-1][full], np.diff(bounds)[full] == 1
    short, place = (value >> np.uint64(32)).astype(np.uint32), np.arange(len(value), dtype=np.uint64)
    for i, (a, b) in enumerate(_SEEDS):
        y = short ^ a
        y *= b | np.uint32(1)
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        y ^= y >> np.uint32(13)
        ranked = (y.astype(np.uint64) << np.uint64(32)) | place
        one = (np.minimum.reduceat(ranked, starts) & _LOW32).astype(np.int64)
        ranked[one] = np.uint64(2**64 - 1)
        two = (np.minimum.reduceat(ranked, starts) & _LOW32).astype(np.int64)
        two[single] = one[single]
        pair = value[np.minimum(one, two)] * np.uint64(3) + mix64(value[np.maximum(one, two)])
        out[full, i] = (mix64(pair) >> np.uint64(48)).astype(np.uint16)
    return out


def fingerprints(texts: pa.Array, k: int = K) -> np.ndarray:
    """N_HASHES 16-bit values for each text. Texts without words have zeros; one of fewer than k words is one k-mer."""
    parts = [_block_prints(data, offsets, k) for _, _, data, offsets in blocks(texts, 1 << 18)]
    return np.concatenate(parts) if parts else np.zeros((0, N_HASHES), np.uint16)


def _hex(prints: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in prints.astype(">u2")]


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1) if len(a) else np.zeros(0)


def fingerprint_table(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fingerprint of each row. A null text is an empty one; equal texts have equal fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_hex(fingerprints(batch.column(1), k)), pa.string())], names=[id_col, "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([docs.schema[id_col], T.StructField("fingerprint", T.StringType())]))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_range, _ghost, _key, id and text, dealt so that the row after a document in descending id order is the next row of its _range.

    Ranges come from quantiles of the ids; the first row of each is also a ghost at the end of
    the range before it (of the last, for the first range), so texts are shuffled once and no
    task sees all rows. Null ids are the least; rows with one id follow in the order of their texts.
    """
    spark = docs.sparkSession
    n = max(1, min(MAX_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // RANGE_ROWS)))
    keyed = bounded(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_key"), F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    cuts = keyed.select(F.percentile_approx("_key", [i / n for i in range(1, n)] or [0.5], 100 * n).alias("c")).first()["c"] or []
    bounds = -np.unique(np.array(cuts, np.int64)).astype(object)[::-1]
    bounds = np.array([int(-x) for x in bounds], np.int64)  # descending

    def range_of(keys: np.ndarray) -> np.ndarray:
        return len(bounds) - np.searchsorted(bounds[::-1], keys, side="right")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(range_of(batch.column(0).to_numpy()).astype(np.int32)), batch.column(0)], names=["_range", "_key"])

    heads = {r["_range"]: r["k"] for r in keyed.select("_key").mapInArrow(ranges, "_range int, _key long").groupBy("_range").agg(F.max("_key").alias("k")).collect()}
    filled = sorted(heads)
    before = {r: filled[i - 1] for i, r in enumerate(filled)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            own = range_of(keys).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.zeros(len(own), np.int32)), *batch.columns], names=["_range", "_ghost", "_key", "_id", "_text"])
            first = np.flatnonzero(np.array([heads[r] == k for r, k in zip(own.tolist(), keys.tolist())], bool))
            if len(first):
                to = np.array([before[int(own[i])] for i in first], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.ones(len(first), np.int32)), *(c.take(pa.array(first)) for c in batch.columns)], names=["_range", "_ghost", "_key", "_id", "_text"])

    schema = T.StructType([T.StructField("_range", T.IntegerType()), T.StructField("_ghost", T.IntegerType()), *keyed.schema.fields])
    dealt = keyed.mapInArrow(deal, schema)
    return dealt.repartitionById(len(bounds) + 1, F.col("_range")).sortWithinPartitions("_range", "_ghost", F.col("_key").desc(), "_text")


def fingerprint_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edited text (the last floor(n / 2) characters replaced by the next document's first as many), and likenesses.

    Ids are whole numbers of any type. A null text is an empty one, whose fingerprint is zeros;
    two empty texts are alike (1). Null ids are the least; repeated rows follow each other, and
    the only row of a table follows itself. An empty table gives an empty result. Other columns
    aren't looked at, so their names can't clash.
    """
    fields = [docs.schema["doc_id"], T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]
    kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def compute(ids: list, texts: list[str], following: str) -> pa.RecordBatch:
        after = [*texts[1:], following]
        edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for t, x in zip(texts, after)]
        own = fingerprints(pa.array([*texts, following], pa.large_string()), k)
        changed = fingerprints(pa.array(edited, pa.large_string()), k)
        columns = [pa.array(ids, kind), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array(_hex(own[:-1])), pa.array(_hex(changed)), pa.array(_likeness(own[:-1], changed)), pa.array(_likeness(own[:-1], own[1:]))]
        return pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, held = [], [], 0, None
        closed = False
        for batch in batches:
            for r, ghost, i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                if r != held:
                    held, closed = r, False
                if closed:
                    continue
                t = t.as_py()
                if ghost or size > 1 << 20:
                    if ids:
                        yield compute(ids, texts, t)
                    ids, texts, size = [], [], 0
                if ghost:
                    closed = True
                else:
                    ids.append(i)
                    texts.append(t)
                    size += len(t)

    return with_next(docs).mapInArrow(run, T.StructType(fields))
