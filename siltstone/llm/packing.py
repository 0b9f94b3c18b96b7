"""Best-fit packing of token sequences by large-item matching (operator 1)."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siltstone.llm._cluster import bounded, sized, stash
from siltstone.llm._tokens import KEEP_WORDS, WordEncoder, default_vocabulary

CAPACITY = 2048

#: Ranks within one length are counted in shares of about so many pieces, so a length that a third of all pieces have isn't one task's work.
SHARE_PIECES = 4096

#: Words whose ids a worker keeps while ids are carried along: fewer, since pieces and their shuffle need the memory.
PACK_WORDS = 150_000


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 0, by_word: bool = True, id_col: str = "doc_id", text_col: str = "text", keep_words: int = KEEP_WORDS) -> DataFrame:
    """Token ids of each document with end_id after them, cut only where there are more than capacity.

    Returns id_col, piece (from 0), start (ids of the document before the piece), length, ids
    (binary: little-endian unsigned 32-bit). A null text is an empty one and gives one piece
    with end_id alone. Repeated rows give repeated pieces; a null id stays null. Other columns
    aren't looked at, so their names can't clash.
    """
    path = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordEncoder.load(path, by_word, keep_words), int(end_id).to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, piece, start, length, ids = [], [], [], [], []
                for i, text in enumerate(part.column(1)):
                    whole = encoder.encode(text.as_py()) + end
                    for n, b in enumerate(range(0, len(whole), 4 * capacity)):
                        rows.append(i)
                        piece.append(n)
                        start.append(b // 4)
                        ids.append(whole[b : b + 4 * capacity])
                        length.append(len(ids[-1]) // 4)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=[id_col, "piece", "start", "length", "ids"])

    return bounded(docs).select(id_col, text_col).mapInArrow(run, schema)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Bins as (how many alike, ((length, how many in each bin), ...)), from how many items each length has.

    Items over a third of the capacity are matched first, two to a bin at most: from the
    longest down, each with the longest other that still fits. The others follow from the
    longest down, each in the smallest gap that takes it. Work and result grow with the number
    of different lengths, not with the number of items.
    """
    left = {n: c for n, c in counts.items() if c}
    large = sorted(n for n in left if 3 * n > capacity)
    gaps: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}
    order: list[int] = []

    def put(gap: int, many: int, content: tuple[tuple[int, int], ...]) -> None:
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append((many, content))

    while large:
        n = large[-1]
        if not left[n]:
            large.pop()
            continue
        k = bisect_left(large, capacity - n + 1) - 1
        while k >= 0 and not left[large[k]]:
            large.pop(k)
            k -= 1
        partner = large[k] if k >= 0 else None
        if partner is None or (partner == n and left[n] == 1):
            if partner == n and k > 0:
                while k > 0 and not left[large[k - 1]]:
                    large.pop(k - 1)
                    k -= 1
                partner = large[k - 1] if k > 0 else None
            else:
                partner = None
        if partner is None:
            many = left[n] if bisect_left(large, capacity - n + 1) == 0 else 1
            put(capacity - n, many, ((n, 1),))
            left[n] -= many
        elif partner == n:
            many = left[n] // 2
            put(capacity - 2 * n, many, ((n, 2),))
            left[n] -= 2 * many
        else:
            many = min(left[n], left[partner])
            put(capacity - n - partner, many, ((n, 1), (partner, 1)))
            left[n] -= many
            left[partner] -= many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(order, n)
            if at == len(order):
                each = capacity // n
                bins, rest = divmod(left[n], each)
                if bins:
                    put(capacity - each * n, bins, ((n, each),))
                if rest:
                    put(capacity - rest * n, 1, ((n, rest),))
                left[n] = 0
                break
            gap = order[at]
            many, content = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            each = gap // n
            full = min(many, left[n] // each)
            if full:
                put(gap - each * n, full, (*content, (n, each)))
                left[n] -= full * each
            many -= full
            if many and (rest := min(left[n], each)):
                put(gap - rest * n, 1, (*content, (n, rest)))
                left[n] -= rest
                many -= 1
            if many:
                put(gap, many, content)
    return [group for found in gaps.values() for group in found]


def _runs(bins: list[tuple[int, tuple[tuple[int, int], ...]]]) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, first sequence, pieces in each bin, offset of the first), by rank."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for many, content in bins:
        offset = 0
        for n, each in content:
            rank = ranks.get(n, 0)
            runs.setdefault(n, []).append((rank, first, each, offset))
            ranks[n] = rank + many * each
            offset += n * each
        first += many
    return {n: np.array(x, np.int64) for n, x in runs.items()}


def assign_sequences(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add sequence_id and offset to pieces (any table with a column length from 1 to capacity).

    pieces is read three times and must give the same rows each time: pass a written table.
    Only the number of pieces of each length goes to the driver, capacity rows at most. A
    length is dealt out over as many shares as its number of pieces asks for.
    Pieces of one length are alike for the plan; their ranks follow order within shares, and
    repeated rows get places of their own. An empty table gives an empty result.
    """
    schema = T.StructType([*(f for f in pieces.schema), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    spark = pieces.sparkSession
    by_length = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = _runs(plan_bins(by_length, capacity))
    several = spark.createDataFrame([(n, -(-c // SHARE_PIECES)) for n, c in by_length.items() if c > SHARE_PIECES], "_length long, _shares long")
    # at most capacity rows
    dealt = pieces.join(F.broadcast(several), F.col("length") == F.col("_length"), "left").drop("_length")
    shared = dealt.withColumn("_share", F.pmod(F.xxhash64(*order), F.coalesce("_shares", F.lit(1)))).drop("_shares")
    counts = shared.groupBy("length", "_share").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)))
    # one row for each length and share: capacity rows and one for every SHARE_PIECES pieces
    before = stash(before.select("length", "_share", F.coalesce("_before", F.lit(0)).alias("_before")), "shares")
    ranked = shared.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_share").orderBy(*order)) - 1)
    ranked = ranked.join(sized(before), ["length", "_share"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    names = [f.name for f in pieces.schema]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lengths, ranks = frame["length"].to_numpy(), frame["_rank"].to_numpy()
            sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            for n in np.unique(lengths):
                own = np.flatnonzero(lengths == n)
                run = runs[int(n)]
                hit = run[np.searchsorted(run[:, 0], ranks[own], side="right") - 1]
                bins, place_in = np.divmod(ranks[own] - hit[:, 0], hit[:, 2])
                sequence[own] = hit[:, 1] + bins
                offset[own] = hit[:, 3] + place_in * n
            yield frame[names].assign(sequence_id=sequence, offset=offset)

    return ranked.select(*names, "_rank").mapInPandas(place, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """One row for each sequence of pieces that have sequence_id, offset and ids: the ids of all its pieces, in place."""
    grouped = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_parts"), F.sum("length").alias("length"))
    # a sequence has capacity ids at most, so this group is bounded
    return grouped.select("sequence_id", "length", F.aggregate("_parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed pieces of docs with their ids: cut_pieces, then assign_sequences."""
    return assign_sequences(stash(cut_pieces(docs, capacity, vocabulary, id_col=id_col, text_col=text_col, keep_words=PACK_WORDS), "pieces"), capacity, (id_col, "piece"))


def pack_digests(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """As pack, with the CRC-32 of each piece's ids in place of the ids, which then needn't be moved."""
    pieces = cut_pieces(docs, capacity, vocabulary)
    small = stash(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return assign_sequences(small, capacity)
