"""Wide fingerprints and nearest neighbours by Hamming distance."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import fingerprints
from siltstone.operators.lineage import cut

WIDTHS = (64, 256, 1024)

#: Goes before each word that is hashed. Fingerprints of different domains can't be compared.
DOMAIN = "simhash-wide-2:"

# The bits of a 64-bit fingerprint that each of twelve probe tables takes its key from.
TABLES = (
    (0, 19, 20, 21, 40, 41, 42, 61, 62, 63),
    (2, 3, 4, 5, 24, 25, 26, 45, 46, 47),
    (7, 8, 9, 10, 29, 30, 31, 50, 51, 52),
    (12, 13, 14, 15, 34, 35, 36, 55, 56, 57),
    (17, 18, 19, 20, 39, 40, 41, 60, 61, 62),
    (1, 2, 3, 22, 23, 24, 25, 44, 45, 46),
    (6, 7, 8, 27, 28, 29, 30, 49, 50, 51),
    (11, 12, 13, 32, 33, 34, 35, 54, 55, 56),
    (16, 17, 18, 37, 38, 39, 40, 59, 60, 61),
    (0, 1, 2, 21, 22, 23, 42, 43, 44, 45),
    (5, 6, 7, 26, 27, 28, 47, 48, 49, 50),
    (10, 11, 12, 31, 32, 33, 52, 53, 54, 55),
)

#: A bucket of more rows is dealt out over several.
BUCKET_ROWS = 4096

#: So many queries meet so many rows of the index at once, each pair of such parts in a task of its own.
BLOCK_QUERIES, PART_ROWS = 4096, 32768

#: Tasks in which they meet, at most.
MOST_TASKS = 4096

#: Distances up to which two texts are near-identical, renamed and structural clones.
CLONES = (("near_identical", 2), ("renamed", 8), ("structural", 16))


def _signed(bit: int) -> int:
    return 1 << bit if bit < 63 else -(1 << 63)


def wide_fingerprints(docs: DataFrame, key: str, text: str, bits: int = 64, domain: str = DOMAIN) -> DataFrame:
    """(key, words): a fingerprint of 64, 256 or 1024 bits as 64-bit words, for each different key.

    Each word of the text (ASCII white space between, A-Z in lower case) gives 64 bits of each
    limb: the first 8 bytes, little-endian, of the MD5 of the domain, the word and the limb's
    number in 8 bytes. A bit is set if over half of the text's words, with repeats, have it. Null
    and blank texts have no bit. Two counts of 32 bits share one sum, so a limb takes 32 sums; a
    text's own are found in its row, and rows of one key are put together.
    """
    if bits not in WIDTHS:
        raise ValueError(f"bits must be one of {WIDTHS}")
    limbs = bits // 64
    held = docs.select(key, fingerprints.word_sums(F.col(text), domain, limbs).alias("_x"))
    each = held.select(key, "_x.n", F.posexplode("_x.sums").alias("_limb", "_sums"))
    sums = [F.sum(F.get("_sums", F.lit(i))).alias(f"_s{i}") for i in range(32)]
    counted = each.groupBy(key, "_limb").agg(F.sum("n").alias("_n"), *sums)
    word = F.lit(0).cast("long")
    for place in range(64):  # of the digest read from its first byte on
        n = F.col(f"_s{place}").bitwiseAND(F.lit(0xFFFFFFFF)) if place < 32 else F.shiftrightunsigned(f"_s{place - 32}", 32)
        bit = 8 * (7 - place // 8) + place % 8
        word = word.bitwiseOR(F.when(2 * n > F.col("_n"), F.lit(_signed(bit)).cast("long")).otherwise(F.lit(0).cast("long")))
    limb = counted.select(key, "_limb", word.alias("_word"))
    return limb.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_limb", "_word"))), lambda x: x["_word"]).alias("words"))


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ between two fingerprints of one width, arrays of words; null for two of different width."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x))


def cosine(distance: Column, bits: int) -> Column:
    """Cosine that a Hamming distance stands for, 0 at least."""
    return F.greatest(F.lit(0.0), F.cos(F.lit(3.141592653589793) * distance / bits))


def noise_floor(bits: int) -> float:
    """Deviation of the cosine of unrelated texts."""
    return 3.141592653589793 / (2 * bits**0.5)


def sampled_tables(tables: int, key_bits: int, bits: int = 64, seed: int = 1) -> tuple[tuple[int, ...], ...]:
    """Places of key_bits different bits for each of so many tables."""
    r = random.Random(seed)
    return tuple(tuple(sorted(r.sample(range(bits), key_bits))) for _ in range(tables))


def _keyed(rows: DataFrame, words: str, tables: tuple[tuple[int, ...], ...], flips: int) -> DataFrame:
    """rows with b, once for each table: the table's number and the bits it takes; also with each of the first flips of those bits turned."""
    zero = F.lit(0).cast("long")
    all_tables = F.array(*(F.struct(F.lit(t).alias("t"), F.array(*map(F.lit, places)).alias("places")) for t, places in enumerate(tables)))
    bit = lambda p, i: F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.element_at(words, F.shiftright(p, 6) + 1), p % 64).bitwiseAND(F.lit(1).cast("long")), i)
    named = rows.withColumn("_t", F.explode(all_tables))
    named = named.withColumn("_k", F.aggregate(F.transform("_t.places", bit), zero, lambda x, y: x.bitwiseOR(y)))
    turns = F.explode(F.array(zero, *(F.lit(1 << i).cast("long") for i in range(flips))))
    return named.withColumn("_x", turns).withColumn("b", F.struct(F.col("_t.t").alias("t"), F.col("_k").bitwiseXOR(F.col("_x")).alias("k"))).drop("_t", "_k", "_x")


def candidates(index: DataFrame, queries: DataFrame, tables: tuple[tuple[int, ...], ...] = TABLES, flips: int = 3) -> DataFrame:
    """(query, id, distance): rows of index (id, words) that share a bucket with queries (query, words), once each.

    A row lies in one bucket of each table; a query looks in its own and in those of the first
    flips bits turned. Equal fingerprints lie in the index once and get their ids back at the
    end, so a group of copies is one entry. Buckets of more than BUCKET_ROWS are dealt out over
    several, in each of which their queries look. Keys of 10 bits make 1024 buckets: take longer
    ones from sampled_tables for more than some 10 million different fingerprints.
    """
    classes = index.select("words").distinct()
    entries = _keyed(classes, "words", tables, 0)
    sizes = entries.groupBy("b").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > BUCKET_ROWS).select("b", F.ceil(F.col("_n") / BUCKET_ROWS).cast("int").alias("_shares"))
    sizes = cut(sizes)
    dealt = entries.join(sizes, "b", "left").select("b", "words", F.pmod(F.xxhash64("words"), F.coalesce("_shares", F.lit(1))).cast("int").alias("_share"))
    asked = queries.select(F.col("words").alias("_q")).distinct()
    probes = _keyed(asked, "_q", tables, flips).join(sizes, "b", "left")
    probes = probes.select("_q", "b", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1)).alias("_share"))
    found = probes.join(dealt, ["b", "_share"]).select("_q", "words").distinct().withColumn("distance", hamming(F.col("_q"), F.col("words")))
    named = queries.select("query", F.col("words").alias("_q")).join(found, "_q").select("query", "words", "distance")
    return named.join(index.select("id", "words"), "words").select("query", "id", "distance")


def _best(pairs: DataFrame, k: int, most: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy("distance", "id")
    return pairs.filter(F.col("distance") <= most).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(index: DataFrame, queries: DataFrame, k: int = 7, most: int = 24, tables: tuple[tuple[int, ...], ...] = TABLES, flips: int = 3) -> DataFrame:
    """(query, id, distance, rank): the k nearest candidates within most bits of each query. Ties go by id. Approximate: recall depends on the tables."""
    return _best(candidates(index, queries, tables, flips), k, most)


def _dealt(rows: DataFrame, names: list[str], size: int, part: str) -> tuple[DataFrame, int]:
    """(part, limbs, and an array for each name, in their order), parts of about size rows, and how many parts there are."""
    known = rows.filter(F.col("words").isNotNull()).withColumn("_limbs", F.size("words"))
    parts = max(1, -(-known.count() // size))
    dealt = known.withColumn(part, F.pmod(F.xxhash64(names[0], "words"), F.lit(parts)).cast("int"))
    arrays = dealt.groupBy(part, "_limbs").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("_rows"))
    column = lambda c: F.flatten("_rows.words") if c == "words" else F.col(f"_rows.{c}")
    return cut(arrays.select(part, "_limbs", *(column(c).alias(f"{part}_{c}") for c in names))), parts


def _met(index: DataFrame, own: list[str], queries: DataFrame, asked: list[str], visit: Callable, schema: str) -> DataFrame:
    """What visit(part, block) gives, as rows of schema, for each part of the index and each block of queries of the same width.

    Both are given as a dict of Arrow arrays by the names in own and asked, words as a NumPy
    array (row, limb); visit gives a dict of Arrow arrays or lists. Parts and blocks are bounded
    and meet in tasks of their own. A part is copied once for each block, so what is shuffled is
    a few thousandths of the pairs that are looked at, and no pair is kept but what visit gives.
    """
    parts, n_parts = _dealt(index, own, PART_ROWS, "_part")
    blocks, n_blocks = _dealt(queries, asked, BLOCK_QUERIES, "_block")
    on, tasks = ["_part", "_block", "_limbs"], min(n_parts * n_blocks, MOST_TASKS)
    many = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = parts.withColumn("_block", many(n_blocks)).repartition(tasks, *on)
    right = blocks.withColumn("_part", many(n_parts)).repartition(tasks, *on)

    def arrays(batch: pa.RecordBatch, row: int, side: str, names: list[str]) -> dict:
        found = {c: batch.column(f"{side}_{c}")[row].values for c in names}
        found["words"] = found["words"].to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, batch.column("_limbs")[row].as_py())
        return found

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield pa.RecordBatch.from_pydict(visit(arrays(batch, row, "_part", own), arrays(batch, row, "_block", asked)))

    kept = [f"_part_{c}" for c in own] + [f"_block_{c}" for c in asked]
    return left.join(right, on).select("_limbs", *kept).mapInArrow(met, schema)


def _distances(words: np.ndarray, query: np.ndarray) -> np.ndarray:
    if words.shape[1] == 1:
        return np.bitwise_count(words[:, 0] ^ query[0])
    return np.bitwise_count(words ^ query).sum(axis=1, dtype=np.uint16)


def _first(distance: np.ndarray, k: int, most: int) -> np.ndarray:
    """Places of the k least distances of most at most, by distance and place."""
    low, high = 0, most
    while low < high:  # to the least bound that k distances keep
        middle = (low + high) // 2
        low, high = (low, middle) if np.count_nonzero(distance <= middle) >= k else (middle + 1, high)
    places = np.flatnonzero(distance <= low)
    return places[np.argsort(distance[places], kind="stable")[:k]]


def _kind(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()


def _pairs(part: dict, block: dict, firsts: list[tuple[np.ndarray, np.ndarray]]) -> dict:
    """(query, id, distance) of each query's places in the part and their distances."""
    queries = np.repeat(np.arange(len(firsts)), [len(places) for places, _ in firsts])
    places, distances = (np.concatenate([f[i] for f in firsts]) for i in (0, 1))
    return {"query": block["query"].take(pa.array(queries)), "id": part["id"].take(pa.array(places)), "distance": pa.array(distances.astype(np.int32))}


def nearest_exact(index: DataFrame, queries: DataFrame, k: int = 7, most: int = 24) -> DataFrame:
    """As nearest, over all rows: each part of the index gives each query its k best, of which the best are kept."""

    def visit(part: dict, block: dict) -> dict:
        firsts = []
        for query in block["words"]:
            distance = _distances(part["words"], query)
            places = _first(distance, k, most)
            firsts.append((places, distance[places]))
        return _pairs(part, block, firsts)

    pairs = _met(index, ["id", "words"], queries, ["query", "words"], visit, f"query {_kind(queries, 'query')}, id {_kind(index, 'id')}, distance int")
    return _best(pairs, k, most)


#: Sets of rows (a bit each) that a task keeps for keys that may come again.
KEPT_SETS = 8192


def _probes(words: np.ndarray, tables: tuple[tuple[int, ...], ...], flips: int) -> Callable[[np.ndarray], np.ndarray]:
    """A function that gives the packed set of the rows of words that share a bucket with a query, as in candidates."""
    one = np.uint64(1)

    def keys(rows: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
        found = np.zeros(len(rows), np.uint64)
        for i, p in enumerate(places):
            found |= (rows[:, p >> 6] >> np.uint64(p & 63) & one) << np.uint64(i)
        return found

    sorted_keys = []
    for places in tables:
        own = keys(words, places)
        order = np.argsort(own, kind="stable")
        sorted_keys.append((order, own[order]))
    kept: dict[tuple[int, int], np.ndarray] = {}

    def bucket(t: int, key: int) -> np.ndarray:
        if (t, key) not in kept:
            if len(kept) >= KEPT_SETS:
                kept.clear()
            order, own = sorted_keys[t]
            rows = np.zeros(len(words), bool)
            for turned in (key, *(key ^ 1 << i for i in range(flips))):
                low, high = np.searchsorted(own, np.array([turned, turned + 1], np.uint64))
                rows[order[low:high]] = True
            kept[t, key] = np.packbits(rows)
        return kept[t, key]

    return lambda query: np.bitwise_or.reduce([bucket(t, int(keys(query[None], places)[0])) for t, places in enumerate(tables)])


def probed(index: DataFrame, queries: DataFrame, k: int = 7, most: int = 24, tables: tuple[tuple[int, ...], ...] = TABLES, flips: int = 3) -> DataFrame:
    """(query, n_candidates, best): how many candidates each query has, and the k nearest of them within most bits as (distance, id), ties by id.

    The same as candidates and nearest give, but candidates are counted where they are found.
    Queries without a candidate are left out.
    """

    def visit(part: dict, block: dict) -> dict:
        share = _probes(part["words"], tables, flips)
        counts, firsts = [], []
        for query in block["words"]:
            found = share(query)
            counts.append(int(np.bitwise_count(found).sum()))
            distance = np.where(np.unpackbits(found, count=len(part["words"])).view(bool), _distances(part["words"], query), most + 1)
            places = _first(distance, k, most)
            firsts.append((places, distance[places]))
        pairs = _pairs(part, block, firsts)
        best = pa.StructArray.from_arrays([pairs["distance"], pairs["id"]], ["distance", "id"])
        ends = np.cumsum([0, *(len(places) for places, _ in firsts)], dtype=np.int32)
        return {"query": block["query"], "n": pa.array(counts, pa.int64()), "best": pa.ListArray.from_arrays(pa.array(ends), best)}

    schema = f"query {_kind(queries, 'query')}, n bigint, best array<struct<distance: int, id: {_kind(index, 'id')}>>"
    found = _met(index, ["id", "words"], queries, ["query", "words"], visit, schema)
    merged = found.groupBy("query").agg(F.sum("n").alias("n_candidates"), F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return merged.filter("n_candidates > 0")


#: Different fragments of a part of which every two meet, tiles of parts for each core at least, and how many rows of both sides of a tile are compared at once.
TILE_ROWS, CORE_TILES, ROWS_AT_ONCE, COLUMNS_AT_ONCE = 131_072, 4, 16, 16_384


def _clones(x: dict, y: dict, bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each bound and row of x how many fragments of y within it have another source, and the same for y among x.

    Both are as arrays by name, rows of a source side by side; n is how many fragments a row stands for.
    """
    source = pa.concat_arrays([x["source"], y["source"]]).dictionary_encode(null_encoding="encode")
    codes = source.indices.to_numpy()
    own, other = codes[: len(x["n"])], codes[len(x["n"]) :]
    begin, end = (np.zeros(len(source.dictionary), np.int64) for _ in range(2))
    found, first, many = np.unique(other, return_index=True, return_counts=True)
    begin[found], end[found] = first, first + many
    limbs = x["words"].shape[1]
    rows, columns = (np.zeros((len(bounds), len(side["n"])), np.int64) for side in (x, y))
    shape, kind = (ROWS_AT_ONCE, COLUMNS_AT_ONCE), np.uint8 if limbs == 1 else np.uint16
    differ, far, near, one = np.empty(shape, np.uint64), np.empty(shape, kind), np.empty(shape, bool), np.empty(shape, np.uint8)
    for low in range(0, len(y["n"]), COLUMNS_AT_ONCE):
        some = slice(low, min(low + COLUMNS_AT_ONCE, len(y["n"])))
        width = some.stop - low
        copies = np.flatnonzero(y["n"][some] > 1)
        more = (y["n"][some][copies] - 1).astype(float)
        planes = [np.ascontiguousarray(y["words"][some, limb]) for limb in range(limbs)]
        for top in range(0, len(x["n"]), ROWS_AT_ONCE):
            these = slice(top, min(top + ROWS_AT_ONCE, len(x["n"])))
            height = these.stop - top
            z, d, m = differ[:height, :width], far[:height, :width], near[:height, :width]
            for limb, plane in enumerate(planes):
                np.bitwise_xor(x["words"][these, limb, None], plane, out=z)
                if limb == 0:
                    np.bitwise_count(z, out=d, casting="unsafe")
                else:
                    d += np.bitwise_count(z, out=one[:height, :width])
            for i, code in enumerate(own[these]):
                if begin[code] < some.stop and end[code] > low:
                    d[i, max(begin[code] - low, 0) : end[code] - low] = np.iinfo(kind).max
            repeated = np.flatnonzero(x["n"][these] > 1)
            for k, most in enumerate(bounds):
                np.less_equal(d, most, out=m)
                rows[k, these] += [np.count_nonzero(r) for r in m]
                columns[k, some] += np.add.reduce(m.view(np.uint8), axis=0, dtype=np.uint8)
                if len(copies):
                    rows[k, these] += (m[:, copies].astype(float) @ more).astype(np.int64)
                if len(repeated):
                    columns[k, some] += ((x["n"][these][repeated] - 1).astype(float) @ m[repeated].astype(float)).astype(np.int64)
    return rows, columns


def clone_links(fragments: DataFrame) -> DataFrame:
    """(id, class_id, and for each kind of CLONES how many): for each fragment the least id of equal fingerprints and its clones of each kind among fragments of other sources.

    fragments: (id, source, tokens, words); those of under 4 tokens are left out, null sources
    are one. Every two fragments are compared, so no link is lost; the pairs are only counted.
    Fragments of one source and fingerprint are one row. Rows are dealt to parts, and every two
    parts are a tile, which a task looks at once for both. So a part is copied once for each part,
    and a task holds two of them at any size.
    """
    usable = fragments.filter((F.col("tokens") >= 4) & F.col("words").isNotNull()).select("id", "source", "words")
    once = cut(usable.groupBy("words", "source").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("_least"))).withColumn("_row", F.monotonically_increasing_id())
    least = math.isqrt(2 * CORE_TILES * fragments.sparkSession.sparkContext.defaultParallelism)
    parts, many = _dealt(once, ["source", "_row", "n", "words"], max(1, min(TILE_ROWS, once.count() // least)), "_part")
    upper, lower = F.greatest("_part", "_other"), F.least("_part", "_other")
    tiles = parts.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))).withColumn("_tile", (upper * (upper + 1) / 2).cast("int") + lower)
    names, bounds = [name for name, _ in CLONES], [most for _, most in CLONES]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], dict] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                side = {c: batch.column(f"_part_{c}")[row].values for c in ("source", "_row", "n", "words")}
                tile, limbs, part, other = (batch.column(c)[row].as_py() for c in ("_tile", "_limbs", "_part", "_other"))
                side["n"], side["words"] = side["n"].to_numpy(), side["words"].to_numpy().view(np.uint64).reshape(-1, limbs)
                if part != other and (tile, limbs) not in waiting:
                    waiting[tile, limbs] = side
                    continue
                # a part's own tile gives each pair in both orders among its rows
                first = side if part == other else waiting.pop((tile, limbs))
                for rows, counts in zip((first, side)[: 1 + (part != other)], _clones(first, side, bounds), strict=False):
                    within = np.diff(counts, axis=0, prepend=0)
                    yield pa.RecordBatch.from_pydict({"_row": rows["_row"]} | {name: pa.array(n) for name, n in zip(names, within, strict=True)})

    schema = ", ".join(["_row bigint", *(f"{name} bigint" for name in names)])
    found = tiles.repartitionById(many * (many + 1) // 2, F.col("_tile")).mapInArrow(met, schema)
    counts = found.groupBy("_row").agg(*(F.sum(name).alias(name) for name in names))
    classes = once.groupBy("words").agg(F.min("_least").alias("class_id"))
    known = once.join(counts, "_row").join(classes, "words").select(F.col("words").alias("_words"), F.col("source").alias("_source"), "class_id", *names)
    each = usable.join(known, (F.col("words") == F.col("_words")) & F.col("source").eqNullSafe(F.col("_source")))
    return each.groupBy("id").agg(F.min("class_id").alias("class_id"), *(F.sum(name).alias(name) for name in names))


def routed(neighbours: DataFrame, history: DataFrame, current: Column, queries: DataFrame, least: int = 3) -> DataFrame:
    """(query, model, success, n, reason): the model with the highest success rate among the neighbours (query, id) of each query.

    history: (id, model, success). Of equal rates the one of more neighbours wins, then the first
    name. Without neighbours, or without any success among them, the query keeps its current
    model. A history of fewer than least rows advises nothing.
    """
    enough = history.limit(least).count() >= least
    rates = neighbours.join(history, "id").groupBy("query", "model").agg(F.avg(F.col("success").cast("double")).alias("success"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("query").orderBy(F.col("success").desc(), F.col("n").desc(), "model")
    best = rates.filter("success > 0").withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("query", F.col("model").alias("_model"), "success", "n")
    near = rates.groupBy("query").agg(F.sum("n").alias("_near"))
    joined = queries.join(near, "query", "left").join(best, "query", "left")
    reason = F.when(F.lit(not enough), "insufficient history").when(F.col("_near").isNull(), "nearest neighbor too distant").otherwise("neighbors")
    advised = reason == "neighbors"
    return joined.select("query", F.when(advised, F.coalesce("_model", current)).alias("model"), F.when(advised, F.coalesce("success", F.lit(0.0))).alias("success"), F.when(advised, F.coalesce("n", F.lit(0))).alias("n"), reason.alias("reason"))


def clones(fragments: DataFrame, tables: tuple[tuple[int, ...], ...] | None = None, flips: int = 3) -> DataFrame:
    """(a, b, distance, kind, similarity, pairs) of classes of equal fingerprints that are 16 bits apart or less.

    fragments: (id, source, tokens, words of 64 bits). Those of under 4 tokens are left out. A
    class goes by its least id; pairs counts the pairs of fragments, one of each class, whose
    sources differ, and pairs of classes without any are left out. A class of its own copies is a
    pair with itself. Classes meet in buckets of 48 tables of 12 bits unless others are given.
    """
    usable = fragments.filter((F.col("tokens") >= 4) & F.col("words").isNotNull())
    by_source = cut(usable.groupBy("words", "source").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    classes = cut(by_source.groupBy("words").agg(F.min("id").alias("id"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same")))
    own = classes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance"), ((F.col("n") * F.col("n") - F.col("same")) / 2).cast("long").alias("pairs"))
    found = candidates(classes.select("id", "words"), classes.select(F.col("id").alias("query"), "words"), tables or sampled_tables(48, 12), flips)
    apart = found.select(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b"), "distance").filter((F.col("a") < F.col("b")) & (F.col("distance") <= CLONES[-1][1])).distinct()
    counted = apart.join(classes.select(F.col("id").alias("a"), F.col("n").alias("_na"), F.col("words").alias("_wa")), "a").join(classes.select(F.col("id").alias("b"), F.col("n").alias("_nb"), F.col("words").alias("_wb")), "b")
    # fragments of one source in both classes
    sa, sb = by_source.select(F.col("words").alias("_wa"), "source", F.col("n").alias("_sa")), by_source.select(F.col("words").alias("_wb"), "source", F.col("n").alias("_sb"))
    shared = counted.select("a", "b", "_wa", "_wb").join(sa, "_wa").join(sb, ["_wb", "source"]).groupBy("a", "b").agg(F.sum(F.col("_sa") * F.col("_sb")).alias("_shared"))
    other = counted.join(shared, ["a", "b"], "left").select("a", "b", "distance", (F.col("_na") * F.col("_nb") - F.coalesce("_shared", F.lit(0))).alias("pairs"))
    kind = None
    for name, most in CLONES:
        kind = F.when(F.col("distance") <= most, name) if kind is None else kind.when(F.col("distance") <= most, name)
    return own.unionByName(other).filter("pairs > 0").select("a", "b", "distance", kind.alias("kind"), F.round(1 - F.col("distance") / 64, 4).alias("similarity"), "pairs")
