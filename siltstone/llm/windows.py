"""Windows of token ids by best-fit decreasing (operator 12).

Documents that are longer than a window are cut into full windows first. What is left of them
and all shorter documents are placed from the longest down, each in the open window with the
least room that takes it; a segment tree indexed by room finds that window. Windows that stay
open by CLOSE_GAP or more are closed at the end: the emptiest of them are cut up, in parts whose
lengths are powers of two, to fill the room of the others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siltstone.llm._cluster import bounded, sized, stash
from siltstone.llm._spaced import SpacedEncoder

CAPACITY = 1024

#: Room of so many ids or more in a window is filled with parts of cut documents.
CLOSE_GAP = 16

#: Ranks within one length are counted in shares of about so many pieces.
SHARE_PIECES = 512


def default_vocabulary() -> str:
    """The vocabulary file that the query uses; operators take any path of a byte-level one that keeps white space."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class RoomTree:
    """Groups of like windows by room (0 to capacity); tightest(n) finds the least room of n or more that is taken.

    A node holds how many groups stand below it, so both a change and a search take one path.
    """

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.held = [0] * (2 * self.leaves)
        self.groups: list[list] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.held[at] += by
            at >>= 1

    def push(self, room: int, group) -> None:
        self.groups[room].append(group)
        self._add(room, 1)

    def pop(self, room: int):
        self._add(room, -1)
        return self.groups[room].pop()

    def tightest(self, n: int) -> int | None:
        at = n + self.leaves
        if not self.held[at]:
            # up to the first path that turns right into something held, then down its left side
            while at > 1 and (at & 1 or not self.held[at ^ 1]):
                at >>= 1
            if at <= 1:
                return None
            at ^= 1
            while at < self.leaves:
                at = 2 * at if self.held[2 * at] else 2 * at + 1
        return at - self.leaves


#: Like windows: how many, and what each holds as (length, how many of it).
Group = tuple[int, tuple[tuple[int, int], ...]]


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Group]:
    """Groups of windows for counts of pieces by length (1 to capacity).

    The same windows as piece by piece: a piece goes where the last one of its length went for
    as long as it fits, so pieces of a length are placed in bulk. Work grows with the number of
    different lengths and groups, not with the number of pieces.
    """
    tree = RoomTree(capacity)
    for n in sorted((n for n, c in counts.items() if c), reverse=True):
        left = counts[n]
        while left:
            room = tree.tightest(n)
            many, held = (left, ()) if room is None else tree.pop(room)
            room = capacity if room is None else room
            each = room // n
            full = min(many, left // each)
            if full:
                tree.push(room - each * n, (full, (*held, (n, each))))
                left -= full * each
            if many > full and left and full == left // each and left < each:
                tree.push(room - left * n, (1, (*held, (n, left))))
                full, left = full + 1, 0
            if many > full and held:
                tree.push(room, (many - full, held))
    return [group for groups in tree.groups for group in groups]


def _powers(n: int) -> list[int]:
    """The powers of two that add up to n, from the largest down."""
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


class Plan:
    """Where pieces go, by length and by rank among the pieces of that length.

    whole[n]: rows (first rank, first window, pieces in each window, offset of the first) for the
    ranks below n_whole(n). cut[n]: rows (first rank, ranks, start in the piece, length, first
    window, offset) for the ranks from there on, counted from 0; they have several rows each.
    """

    def __init__(self, counts: dict[int, int], capacity: int, close_gap: int):
        self.whole: dict[int, list] = {}
        self.cut: dict[int, list] = {}
        self.n_whole: dict[int, int] = {}
        self.n_cut: dict[int, int] = {}
        self.windows = 0
        kept, donors, rooms = self._choose(best_fit_decreasing(counts, capacity), capacity, close_gap)
        for many, held in kept:
            offset = 0
            for n, each in held:
                rank = self.n_whole.get(n, 0)
                self.whole.setdefault(n, []).append((rank, self.windows, each, offset))
                self.n_whole[n] = rank + many * each
                offset += n * each
            if (many, held) in rooms:
                rooms[many, held].append((self.windows, offset))
            self.windows += many
        self._close([(first, many, offset, capacity - offset) for (many, _), places in rooms.items() for first, offset in places], donors)

    @staticmethod
    def _choose(groups: list[Group], capacity: int, close_gap: int) -> tuple[list[Group], dict[int, int], dict[Group, list]]:
        """Windows to keep, pieces to cut up (length: how many) and the kept groups with room to fill.

        The emptiest windows are cut up, as few as fill the room of the others.
        """
        filled = lambda g: sum(n * each for n, each in g[1])
        is_open = lambda size: capacity - size >= close_gap and size & (size - 1)  # noqa: E731  a power of two isn't padded
        kept = [g for g in groups if not is_open(filled(g))]
        open_groups = sorted((g for g in groups if is_open(filled(g))), key=filled)
        room = sum(g[0] * (capacity - filled(g)) for g in open_groups)
        supply, donors, rooms = 0, {}, {}
        for many, held in open_groups:
            size = filled((many, held))
            # each window that is cut up adds its ids to the supply and takes its room from the demand: capacity in all
            taken = min(many, max(0, -(-(room - supply) // capacity)))
            supply, room = supply + taken * size, room - taken * (capacity - size)
            for n, each in held:
                donors[n] = donors.get(n, 0) + (taken * each if taken else 0)
            if many > taken:
                kept.append((many - taken, held))
                rooms[many - taken, held] = []
        return kept, {n: c for n, c in donors.items() if c}, rooms

    def _close(self, rooms: list[tuple[int, int, int, int]], donors: dict[int, int]) -> None:
        """Fill rooms (first window, how many windows, offset, room) with parts of the donors' pieces."""
        supply: dict[int, list] = {}  # by size: (length, first rank, how many, start)
        demand: dict[int, list] = {}  # by size: (first window, how many, offset)
        for n, c in donors.items():
            self.n_cut[n], start = c, 0
            for size in _powers(n):
                supply.setdefault(size, []).append((n, 0, c, start))
                start += size
        for first, many, offset, room in rooms:
            for size in _powers(room):
                demand.setdefault(size, []).append((first, many, offset))
                offset += size
        size = max([1, *supply, *demand])
        while size:
            own, asked = supply.setdefault(size, []), demand.pop(size, [])
            while asked:
                if not own and not self._split(supply, size, sum(x[1] for x in asked)):
                    break
                n, rank, c, start = own.pop()
                first, many, offset = asked.pop()
                x = min(c, many)
                self.cut.setdefault(n, []).append((rank, x, start, size, first, offset))
                if c > x:
                    own.append((n, rank + x, c - x, start))
                if many > x:
                    asked.append((first + x, many - x, offset))
            for first, many, offset in asked:  # no part is as large: two smaller ones
                demand.setdefault(size // 2, []).extend([(first, many, offset), (first, many, offset + size // 2)])
            size //= 2
        # what is left is less than a window in all; it fills windows whose sizes are powers of two, largest parts first
        left = [(size, n, rank + i, start) for size in sorted(supply, reverse=True) for n, rank, c, start in supply[size] for i in range(c)]
        room = sorted(_powers(sum(x[0] for x in left)))
        offset = 0
        for size, n, rank, start in left:
            self.cut.setdefault(n, []).append((rank, 1, start, size, self.windows, offset))
            offset += size
            if offset == room[-1]:
                room.pop()
                self.windows, offset = self.windows + 1, 0

    @staticmethod
    def _split(supply: dict[int, list], size: int, asked: int) -> bool:
        """Halve the smallest larger parts until there are some of size, as many as asked for and no more than needed."""
        larger = min((s for s, parts in supply.items() if s > size and parts), default=None)
        if larger is None:
            return False
        while larger > size:
            n, rank, c, start = supply[larger].pop()
            x = min(c, -(-asked // (larger // size)))
            if c > x:
                supply[larger].append((n, rank + x, c - x, start))
            larger //= 2
            supply.setdefault(larger, []).extend([(n, rank, x, start), (n, rank, x, start + larger)])
        return True

    def place(self, n: int, ranks: np.ndarray) -> tuple[np.ndarray, ...]:
        """For ranks of pieces of length n: index into ranks, start, length, window, offset of each part, a whole piece being one."""
        split = self.n_whole.get(n, 0)
        own = np.flatnonzero(ranks < split)
        found = [(own[:0],) * 5]
        if len(own):
            runs = np.array(self.whole[n], np.int64)
            hit = runs[np.searchsorted(runs[:, 0], ranks[own], side="right") - 1]
            windows, place = np.divmod(ranks[own] - hit[:, 0], hit[:, 2])
            found.append((own, np.zeros(len(own), np.int64), np.full(len(own), n), hit[:, 1] + windows, hit[:, 3] + place * n))
        rest = np.flatnonzero(ranks >= split)
        if len(rest):
            at = ranks[rest] - split
            for rank, many, start, size, first, offset in self.cut.get(n, []):
                hit = (at >= rank) & (at < rank + many)
                k = int(hit.sum())
                if k:
                    found.append((rest[hit], np.full(k, start), np.full(k, size), first + at[hit] - rank, np.full(k, offset)))
        return tuple(np.concatenate(x) for x in zip(*found))


def cut_windows(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each document with end_id after them, in full windows and what is left.

    Returns id_col, doc_tokens (with end_id), start, length, ids_crc32, width and ids (binary:
    little-endian, of width bytes each: two where the piece's ids fit, else four). A null
    text is an empty one and gives one piece with end_id alone; repeated rows give repeated
    pieces; a null id stays null. Other columns aren't looked at, so their names can't clash.
    """
    path = vocabulary or default_vocabulary()
    names = [id_col, "doc_tokens", "start", "length", "ids_crc32", "width", "ids"]
    kinds = [docs.schema[id_col].dataType, T.LongType(), T.LongType(), T.LongType(), T.LongType(), T.IntegerType(), T.BinaryType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = SpacedEncoder.load(path), int(end_id).to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, found = [], []
                for i, text in enumerate(part.column(1)):
                    whole = encoder.encode(text.as_py()) + end
                    for b in range(0, len(whole), 4 * capacity):
                        piece = whole[b : b + 4 * capacity]
                        array = np.frombuffer(piece, "<u4")
                        width = 2 if int(array.max()) < 1 << 16 else 4
                        rows.append(i)
                        found.append((len(whole) // 4, b // 4, len(piece) // 4, zlib.crc32(piece), width, array.astype(f"<u{width}").tobytes()))
                columns = zip(*found)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, types))], names=names)

    return bounded(docs).select(id_col, text_col).mapInArrow(run, schema)


def place_windows(pieces: DataFrame, capacity: int = CAPACITY, close_gap: int = CLOSE_GAP) -> DataFrame:
    """(_row, _from, _length, sequence_id, offset) of each part of pieces, a written table with a unique _row and a length.

    Only the number of pieces of each length goes to the driver, capacity rows at most. Ranks
    follow _row within shares of a length. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = Plan(counts, capacity, close_gap)
    several = spark.createDataFrame([(n, -(-c // SHARE_PIECES)) for n, c in counts.items() if c > SHARE_PIECES], "length long, _shares long")
    dealt = pieces.select("_row", "length").join(F.broadcast(several), "length", "left")  # capacity rows at most
    dealt = dealt.select("_row", "length", F.pmod(F.xxhash64("_row"), F.coalesce("_shares", F.lit(1))).alias("_share"))
    shares = dealt.groupBy("length", "_share").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1))
    # a row for each length and for every SHARE_PIECES pieces
    shares = stash(shares.select("length", "_share", F.coalesce(before, F.lit(0)).alias("_before")), "shares")
    rank = F.row_number().over(Window.partitionBy("length", "_share").orderBy("_row")) - 1
    ranked = dealt.withColumn("_in", rank).join(sized(shares), ["length", "_share"]).select("_row", "length", (F.col("_in") + F.col("_before")).alias("_rank"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lengths, ranks, rows = (frame[c].to_numpy() for c in ("length", "_rank", "_row"))
            for n in np.unique(lengths):
                own = np.flatnonzero(lengths == n)
                at, start, size, window, offset = plan.place(int(n), ranks[own])
                yield pd.DataFrame({"_row": rows[own[at]], "_from": start, "_length": size, "sequence_id": window, "offset": offset})

    return ranked.mapInPandas(run, "_row long, _from long, _length long, sequence_id long, offset long")


def _with_ids(rows: DataFrame) -> DataFrame:
    """rows with _from, _length, ids and width: ids and ids_crc32 of that part alone."""
    names = [f.name for f in rows.schema]
    schema = T.StructType([f if f.name != "ids_crc32" else T.StructField("ids_crc32", T.LongType()) for f in rows.schema])
    i_from, i_length, i_ids, i_width, i_crc = (names.index(x) for x in ("_from", "_length", "ids", "width", "ids_crc32"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            parts = []
            for ids, a, n, width in zip(columns[i_ids], *(columns[i].to_pylist() for i in (i_from, i_length, i_width))):
                parts.append(np.frombuffer(ids.as_py(), f"<u{width}")[a : a + n].astype("<u4").tobytes())
            columns[i_ids] = pa.array(parts, pa.binary())
            columns[i_crc] = pa.array([zlib.crc32(p) for p in parts], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)


def _numbered(docs: DataFrame, capacity: int, vocabulary: str | None, id_col: str, text_col: str) -> DataFrame:
    pieces = cut_windows(docs, capacity, vocabulary, id_col=id_col, text_col=text_col)
    return stash(pieces.withColumn("_row", F.monotonically_increasing_id()), "windows")


def pack(docs: DataFrame, capacity: int = CAPACITY, close_gap: int = CLOSE_GAP, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, doc_tokens, start, length, ids_crc32, sequence_id, offset and ids (binary: little-endian unsigned 32-bit) of each part of each document."""
    pieces = _numbered(docs, capacity, vocabulary, id_col, text_col)
    rows = _with_ids(pieces.drop("length").join(place_windows(pieces, capacity, close_gap), "_row"))
    return rows.select(id_col, "doc_tokens", (F.col("start") + F.col("_from")).alias("start"), F.col("_length").alias("length"), "ids_crc32", "sequence_id", "offset", "ids")


def pack_digests(docs: DataFrame, capacity: int = CAPACITY, close_gap: int = CLOSE_GAP, vocabulary: str | None = None) -> DataFrame:
    """As pack, without ids: only the ids of pieces that are cut up are moved."""
    pieces = _numbered(docs, capacity, vocabulary, "doc_id", "text")
    placed = stash(place_windows(pieces, capacity, close_gap), "placed")
    known = pieces.select("_row", "doc_id", "doc_tokens", "start", F.col("length").alias("_whole"), "ids_crc32")
    rows = placed.join(known, "_row")
    whole = rows.filter(F.col("_length") == F.col("_whole"))
    cut = stash(rows.filter(F.col("_length") < F.col("_whole")).drop("_whole"), "cut")
    ids = pieces.select("_row", "width", "ids").join(sized(cut, 96), "_row")
    out = ["doc_id", (F.col("start") + F.col("_from")).alias("start"), F.col("_length").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return whole.select(*out).unionByName(_with_ids(ids).select(*out))
