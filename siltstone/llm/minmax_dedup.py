"""Near duplicates by min-max hashing, banding and exact confirmation (operator 10).

Each permutation of the 32-bit shingle values gives a document two signature values, its
least and its greatest, so a signature needs half as many hash evaluations as it has values.
Bands of band_rows(percent) values make N_BANDS buckets: the most values with which a pair
just similar enough shares no bucket with probability MISS at most. For 85 % that is 8 values
(8e-7; 2e-11 for a pair at 90 %, while one at 30 % shares a bucket with 0.3 %), for 80 % it is 6.

Buckets become links without a list of all pairs in them:

1. Documents with equal sets are one class; its smallest document stands for it.
2. Each document is compared with the smallest leader (first member) of its buckets of a few
   bands. A group of n near copies takes n comparisons here and mostly becomes one component.
3. Of all bands' buckets, only those that hold several components go on; members that aren't in
   their leader's component are compared with every leader they have.
4. In a bucket that still holds several components, members of different components are
   compared unless sizes, the triangle inequality of the Jaccard distance (both distances to
   the leader are known by then) or parity sketches rule a link out: each shingle that only
   one of two sets has changes one of PARITY_BITS bits, so sketches never differ in more bits
   than the sets in shingles. Nothing is capped and no link is lost.

Every comparison is exact, on the full sets of 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm._cluster import bounded, discard, fits, join_counted, sized, stash
from siltstone.llm._textscan import NON_SPACE, Words, blocks, distinct_sets, mix64

N_BANDS = 44
MISS = 2e-6

#: Bands that the first comparison uses.
FIRST_BANDS = 4

#: Shingles of one leader's members that one task compares before the members are split over more.
GROUP_SHINGLES = 50_000

#: Members of a bucket of several components that one share of its comparisons has.
BUCKET_MEMBERS = 256


def band_rows(percent: int) -> int:
    return max(r for r in range(1, 33) if r == 1 or (1 - (percent / 100) ** r) ** N_BANDS <= MISS)


def _seeds(rows: int) -> np.ndarray:
    return np.random.RandomState(77).randint(1, 2**32, (N_BANDS // 2, rows, 2), dtype=np.uint64).astype(np.uint32)


def _permuted(x: np.ndarray, a: np.uint32, b: np.uint32) -> np.ndarray:
    """A bijection of 32-bit values for each (a, b)."""
    y = x ^ a
    y *= b | np.uint32(1)
    y ^= y >> np.uint32(15)
    y *= np.uint32(0x2C1B3C6D)
    y ^= y >> np.uint32(13)
    return y


def band_keys(sets: np.ndarray, offsets: np.ndarray, rows: int) -> np.ndarray:
    """Band keys (texts by N_BANDS) of texts that all have shingles. Bands take minima and maxima of rows permutations by turns."""
    seeds = _seeds(rows)
    values = (sets >> np.uint64(32)).astype(np.uint32)
    starts = offsets[:-1]
    keys = np.empty((len(starts), N_BANDS), np.uint64)
    for pair in range(N_BANDS // 2):
        low = np.full(len(starts), 2 * pair, np.uint64)
        high = np.full(len(starts), 2 * pair + 1, np.uint64)
        for a, b in seeds[pair]:
            y = _permuted(values, a, b)
            low = mix64(low * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(y, starts))
            high = mix64(high * np.uint64(0x9E3779B97F4A7C15) + np.maximum.reduceat(y, starts))
        keys[:, 2 * pair], keys[:, 2 * pair + 1] = low, high
    return keys


PARITY_BITS = 512

#: Texts whose bits are counted at once.
PARITY_TEXTS = 256


def parity_sketches(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text, PARITY_BITS bits as 64-bit integers: whether an odd number of its shingles fall on each bit."""
    n = len(offsets) - 1
    out = np.zeros((n, PARITY_BITS // 64), np.int64)
    for a in range(0, n, PARITY_TEXTS):
        b = min(n, a + PARITY_TEXTS)
        owner = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
        place = owner * PARITY_BITS + (sets[offsets[a] : offsets[b]] % np.uint64(PARITY_BITS)).astype(np.int64)
        bits = np.bincount(place, minlength=(b - a) * PARITY_BITS) & 1
        out[a:b] = np.packbits(bits.astype(np.uint8).reshape(b - a, PARITY_BITS), axis=1).view(np.int64)
    return out


_SKETCH = [T.StructField("n_shingles", T.LongType()), T.StructField("fp_a", T.LongType()), T.StructField("fp_b", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("parity", T.ArrayType(T.LongType()))]


def sketch(docs: DataFrame, k: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, two 64-bit set fingerprints, band keys (null without shingles) and parity sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                sets, at = distinct_sets(Words(data, offsets, NON_SPACE), k)
                sizes = np.diff(at)
                full = np.flatnonzero(sizes)
                prints = np.zeros((2, b - a), np.int64)
                bands = [None] * (b - a)
                if len(full):
                    bounds = np.append(at[:-1][full], len(sets))
                    for i, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                        prints[i, full] = np.add.reduceat(mix64(sets ^ np.uint64(salt)), bounds[:-1]).view(np.int64)
                    for t, row in zip(full, band_keys(sets, bounds, rows).view(np.int64)):
                        bands[t] = row
                parity = pa.ListArray.from_arrays(np.arange(0, (b - a + 1) * (PARITY_BITS // 64), PARITY_BITS // 64, dtype=np.int32), pa.array(parity_sketches(sets, at).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(prints[0]), pa.array(prints[1]), pa.array(bands, pa.list_(pa.int64())), parity], names=["doc_id", "n_shingles", "fp_a", "fp_b", "bands", "parity"])

    return bounded(docs).select(F.col(id_col).cast("long"), text_col).mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), *_SKETCH]))


def compare(pairs: DataFrame, docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (a, b, n_a, n_b) with their exact intersection and union sizes.

    A pair's row carries only the text of b; the text of a goes once to each share of a's
    pairs, and shares have about GROUP_SHINGLES shingles, so a leader of very many members is
    spread over many tasks. Tasks hold one leader's set at a time.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    shares = F.greatest(F.lit(1), F.ceil(F.col("_work") / GROUP_SHINGLES)).cast("int")
    leaders = pairs.groupBy("a").agg(F.sum("n_b").alias("_work"), F.count(F.lit(1)).alias("_pairs")).withColumn("_shares", shares)
    members = join_counted(pairs, leaders.select("a", "_shares", "_pairs"), ["a"], "_pairs", pairs.count(), "inner")
    members = members.select("a", F.pmod(F.xxhash64("b"), F.col("_shares")).cast("int").alias("share"), "b")
    right = members.join(texts, F.col("b") == F.col("_id")).select("a", "share", F.lit(1).alias("side"), "b", "_text")
    left = leaders.join(texts, F.col("a") == F.col("_id")).select("a", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("share"), F.lit(0).alias("side"), F.col("a").alias("b"), "_text")
    rows = left.unionByName(right).repartition("a", "share").sortWithinPartitions("a", "share", "side")
    schema = "a long, b long, common long, total long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, leader = None, np.zeros(0, np.uint64)
        for batch in batches:
            ids, side, others = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            share = batch.column(1).to_numpy()
            for x, y, data, offsets in blocks(batch.column(4)):
                sets, at = distinct_sets(Words(data, offsets, NON_SPACE), k)
                found = []
                for i in range(x, y):
                    own = sets[at[i - x] : at[i - x + 1]]
                    if side[i] == 0:
                        held, leader = (ids[i], share[i]), own.copy()
                    elif held == (ids[i], share[i]):
                        common = len(np.intersect1d(leader, own, assume_unique=True))
                        found.append((ids[i], others[i], common, len(leader) + len(own) - common))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*found)], names=["a", "b", "common", "total"])

    return rows.mapInArrow(run, schema)


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (u, v) is linked with.

    Roots spread along edges and then jump to their roots' roots, until nothing changes.
    Only counts reach the driver. Nodes that very many edges share are joined as hot keys.
    """
    both = stash(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{label}-edges")
    n = both.count()
    degree = both.groupBy("u").agg(F.count(F.lit(1)).alias("_degree"))
    roots = stash(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_degree")).select(F.col("u").alias("node"), F.least("u", "m").alias("root"), "_degree"), f"{label}-roots")
    held = roots
    while n:
        seen = join_counted(both.select(F.col("u").alias("node"), "v"), roots, ["node"], "_degree", n, "inner")
        least = seen.groupBy("v").agg(F.min("root").alias("m"))
        step = roots.join(least, F.col("node") == F.col("v"), "left").select("node", F.least("root", F.coalesce("m", "root")).alias("new"), F.col("root").alias("was"), "_degree")
        step = stash(step, f"{label}-step")
        # many nodes share a root: its rows are pre-counted as any hot key's
        sizes = step.groupBy("new").agg(F.count(F.lit(1)).alias("_n"))
        jump = sizes.join(step.select(F.col("node").alias("new"), F.col("new").alias("next")), "new", "left")
        moved = join_counted(step, jump, ["new"], "_n", n)
        moved = stash(moved.select("node", F.coalesce("next", "new").alias("root"), "was", "_degree"), f"{label}-roots")
        discard(step, held)
        held = moved
        changed = moved.filter(F.col("root") != F.col("was")).limit(1).count()
        roots = moved.select("node", "root", "_degree")
        if not changed:
            break
    discard(both)
    return roots.select("node", "root")


def link_components(sketched: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of documents in classes or components of two or more. sketched must be a written table."""
    linked = 100 * F.col("common") >= percent * F.col("total")
    usable = sketched.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = usable.groupBy("fp_a", "fp_b").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_n"))
    total = max(1, usable.count())
    repeated = stash(classes.filter(F.col("_n") > 1), "classes")
    if fits(repeated):
        in_class = usable.select("doc_id", "fp_a", "fp_b").join(F.broadcast(repeated), ["fp_a", "fp_b"])
    else:
        in_class = join_counted(usable.select("doc_id", "fp_a", "fp_b"), repeated, ["fp_a", "fp_b"], "_n", total, "inner")
    in_class = stash(in_class.select("doc_id", "rep"), "members")
    others = stash(in_class.filter(F.col("doc_id") != F.col("rep")).select("doc_id").distinct(), "others")
    reps = usable.join(sized(others), "doc_id", "left_anti").select("doc_id", F.col("n_shingles").alias("n"), "bands")
    like_sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    plain = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))

    def texts_of(pairs: DataFrame) -> DataFrame:
        """Texts of the documents in pairs; texts are shuffled only where there are more of those than a broadcast takes."""
        wanted = stash(pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct(), "wanted")
        found = stash(plain.join(sized(wanted), "_id", "left_semi"), "texts")
        discard(wanted)
        return found

    def compared(pairs: DataFrame) -> DataFrame:
        texts = texts_of(pairs)
        found = stash(compare(pairs, texts, k, "_id", "_text"), "tested")
        discard(texts)
        return found

    def open_buckets(roots: DataFrame | None, n_bands: int) -> DataFrame:
        """(band, doc_id, n, root, lead, n_lead, root_lead): the members of those of the first n_bands kinds of buckets that hold several components."""
        rooted = reps.join(sized(roots.select(F.col("node").alias("doc_id"), "root")), "doc_id", "left") if roots is not None else reps.withColumn("root", F.lit(None).cast("long"))
        entries = rooted.select("doc_id", "n", F.coalesce("root", "doc_id").alias("root"), F.explode(F.slice("bands", 1, n_bands)).alias("band"))
        buckets = entries.groupBy("band").agg(F.min(F.struct("doc_id", "n", "root")).alias("lead"), F.min("root").alias("_low"), F.max("root").alias("_high"), F.count(F.lit(1)).alias("_n"))
        buckets = stash(buckets.filter("_low <> _high").select("band", F.col("lead.doc_id").alias("lead"), F.col("lead.n").alias("n_lead"), F.col("lead.root").alias("root_lead"), "_n"), "buckets")
        if fits(buckets, 80):
            members = entries.join(F.broadcast(buckets), "band")
        else:
            members = join_counted(entries, buckets, ["band"], "_n", total * n_bands, "inner")
        found = stash(members.drop("_n"), "entries")
        discard(buckets)
        return found

    def led(members: DataFrame) -> DataFrame:
        pairs = members.filter("root <> root_lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b"), F.col("n_lead").alias("n_a"), F.col("n").alias("n_b"))
        return pairs.filter(like_sizes)

    # a few bands and one leader for each document find most links of large groups
    members = open_buckets(None, FIRST_BANDS)
    first = led(members).groupBy("b").agg(F.min(F.struct("a", "n_a", "n_b")).alias("x")).select("x.a", "b", "x.n_a", "x.n_b")
    first = stash(first, "first")
    tested = compared(first)
    discard(members, first)
    edges = tested.filter(linked).select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = components(edges, "first")
    # all bands and all leaders, where components are still apart
    members = open_buckets(roots, N_BANDS)
    second = stash(led(members).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"), "second")
    more = compared(second)
    tested = tested.unionByName(more)
    if more.filter(linked).limit(1).count():
        edges = edges.unionByName(more.filter(linked).select(F.col("a").alias("u"), F.col("b").alias("v")))
        roots = components(edges, "second")
    # what is left: members of different components of a bucket, neither of them its leader
    now = members.drop("root", "root_lead").join(sized(roots.select(F.col("node").alias("doc_id"), "root")), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    apart = now.groupBy("band").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.count(F.lit(1)).alias("_members")).filter("_low <> _high").select("band", F.ceil(F.col("_members") / BUCKET_MEMBERS).cast("int").alias("shares"))
    distance = tested.select(F.col("a").alias("lead"), F.col("b").alias("doc_id"), (1 - F.col("common") / F.col("total")).alias("far"))
    still = now.join(apart, "band").filter(F.col("doc_id") != F.col("lead")).join(distance, ["lead", "doc_id"], "left")
    still = stash(still.select("band", "doc_id", "n", "root", "far", "shares"), "open")
    wanted = stash(still.select("doc_id").distinct(), "wanted")
    parity = stash(usable.select("doc_id", "parity").join(sized(wanted), "doc_id", "left_semi"), "parity")
    still = still.join(sized(parity, 128), "doc_id")
    # a large bucket is dealt out: each member is in one share as x and in all shares as y
    x = still.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.col("shares")).cast("int")).alias("x")
    y = still.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).alias("y")
    apart_bits = sum((F.bit_count(F.col("x.parity")[i].bitwiseXOR(F.col("y.parity")[i])) for i in range(PARITY_BITS // 64)), F.lit(0))
    sketches = (100 + percent) * apart_bits <= (100 - percent) * (F.col("x.n") + F.col("y.n"))
    near = F.coalesce(F.abs(F.col("x.far") - F.col("y.far")) <= 1 - percent / 100 + 1e-9, F.lit(True))
    alike = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    together = (F.col("x.band") == F.col("y.band")) & (F.col("x.share") == F.col("y.share"))
    rest = x.join(y, together & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.root") != F.col("y.root")) & near & alike & sketches)
    rest = rest.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b")).distinct()
    rest = stash(rest.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "rest")
    if rest.limit(1).count():
        new = compared(rest).filter(linked).select(F.col("a").alias("u"), F.col("b").alias("v"))
        if new.limit(1).count():
            roots = components(edges.unionByName(new), "rest")
    alone = roots.select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))
    # members of classes take the component of the document that stands for them
    class_root = repeated.groupBy("rep").agg(F.sum("_n").alias("_n")).join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("rep", "_n", F.coalesce("root", "rep").alias("component_id"))
    by_class = join_counted(in_class, class_root, ["rep"], "_n", total, "inner").select("doc_id", "component_id")
    return alone.unionByName(by_class).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs.

    Documents are linked if 100 * intersection >= percent * union of their sets of k-word
    shingles (words: runs of characters but space and U+0009 to U+000D, A-Z in lower case);
    components are those links' connected components, named by their smallest id. Null and
    empty texts have no shingles and are components of their own. Rows that share an id share
    a component; a row with a null id has a null component and is kept. Repeated rows stay.
    """
    sketched = stash(sketch(docs, k, band_rows(percent), id_col, text_col), "sketch")
    found = link_components(sketched, docs, k, percent, id_col, text_col)
    out = sketched.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose document is kept, with the columns of docs; repeated rows of a kept document stay."""
    dropped = stash(near_duplicates(docs, k, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("_dropped")).distinct(), "dropped")
    return docs.join(sized(dropped), docs["doc_id"].cast("long") == F.col("_dropped"), "left_anti")
