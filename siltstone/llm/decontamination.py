"""Benchmark decontamination by a broadcast set of normalised n-grams (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm._cluster import bounded, discard, stash
from siltstone.llm._textscan import ALNUM, Words, blocks

N_WORDS = 13

#: Bytes of one broadcast set of windows. More are looked up in several passes over the documents, each with a set of about this size.
SET_BYTES = 64 << 20

_WINDOW = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("h", T.LongType()), T.StructField("length", T.IntegerType()), T.StructField("words", T.BinaryType())])
_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("byte_start", T.LongType()), T.StructField("byte_end", T.LongType())]))


def benchmark_windows(benchmark: DataFrame, n_words: int = N_WORDS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows (item_id as a string, h, length, words) of each item; an item of fewer words is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                words = Words(data, offsets, ALNUM)
                hashes, at = words.shingles(n_words)
                text = words.text[at] if len(at) else at
                last = np.minimum(at + n_words, words.first[text + 1]) if len(at) else at
                low = words.data.tobytes()
                joined = [b" ".join(low[s:e] for s, e in zip(words.starts[x:y], words.ends[x:y])) for x, y in zip(at, last)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(text, pa.int64())), pa.array(hashes.view(np.int64)), pa.array((last - at).astype(np.int32)), pa.array(joined, pa.binary())], schema=pa.schema([("item_id", pa.string()), ("h", pa.int64()), ("length", pa.int32()), ("words", pa.binary())]))

    return benchmark.select(F.col(id_col).cast("string"), text_col).mapInArrow(run, _WINDOW).distinct()


class WindowSet:
    """Windows as arrays: sorted hashes, words (joined by spaces) one after another, and the items of each."""

    def __init__(self, windows: list):
        rows = sorted(windows, key=lambda r: (r["length"], r["h"] & (2**64 - 1), bytes(r["words"])))
        self.hashes = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
        self.words_at = np.concatenate([[0], np.cumsum([len(r["words"]) for r in rows], dtype=np.int64)]).astype(np.int64)
        self.words = b"".join(bytes(r["words"]) for r in rows)
        self.names = sorted({x for r in rows for x in r["items"]})
        number = {x: i for i, x in enumerate(self.names)}
        self.items_at = np.concatenate([[0], np.cumsum([len(r["items"]) for r in rows], dtype=np.int64)]).astype(np.int64)
        self.items = np.array([number[x] for r in rows for x in r["items"]], np.int32)
        lengths = np.array([r["length"] for r in rows], np.int64)
        self.ranges = {int(n): (int(np.searchsorted(lengths, n)), int(np.searchsorted(lengths, n, side="right"))) for n in np.unique(lengths)}
        self.seen: dict[int, tuple[int, np.ndarray]] = {}

    def where(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are those of windows of n words, and the first such window of each. A bit table of 16 bits or more a window goes first."""
        a, b = self.ranges[n]
        if n not in self.seen:
            bits = min(24, max(10, (b - a).bit_length() + 4))
            table = np.zeros(1 << bits, bool)
            table[self.hashes[a:b] >> np.uint64(64 - bits)] = True
            self.seen[n] = (bits, table)
        bits, table = self.seen[n]
        maybe = np.flatnonzero(table[hashes >> np.uint64(64 - bits)])
        at = np.minimum(a + np.searchsorted(self.hashes[a:b], hashes[maybe]), b - 1)
        same = self.hashes[at] == hashes[maybe]
        return maybe[same], at[same]

    def verified(self, n: int, at: int, joined: bytes) -> np.ndarray:
        """Numbers of the items of the window with these words among those with the hash of the one at at; none if no words are the same."""
        end = self.ranges[n][1]
        h = self.hashes[at]
        while at < end and self.hashes[at] == h:
            if self.words[self.words_at[at] : self.words_at[at + 1]] == joined:
                return self.items[self.items_at[at] : self.items_at[at + 1]]
            at += 1
        return self.items[:0]


_HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_spans", _SPAN), T.StructField("items", T.ArrayType(T.StringType()))])
_HITS_ARROW = pa.struct([("n_words", pa.int64()), ("hit_spans", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "end", "byte_start", "byte_end")]))), ("items", pa.list_(pa.string()))])


def _hits(data: np.ndarray, offsets: np.ndarray, windows: WindowSet) -> list[dict]:
    """n_words, hit_spans and items of each text of a block."""
    words = Words(data, offsets, ALNUM)
    hits: dict[int, tuple[list, set]] = {}
    low = None
    for n in windows.ranges:
        hashes, at = words.windows(n)
        for i, window in zip(*windows.where(n, hashes)):
            f = int(at[i])
            low = low or words.data.tobytes()
            joined = b" ".join(low[s:e] for s, e in zip(words.starts[f : f + n], words.ends[f : f + n]))
            items = windows.verified(n, int(window), joined)
            if len(items):
                spans, found = hits.setdefault(int(words.text[f]), ([], set()))
                spans.append((f, f + n))
                found.update(items.tolist())
    out = []
    for t, n in enumerate(np.diff(words.first).tolist()):
        spans, found = hits.get(t, ((), ()))
        merged: list[list[int]] = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        first = int(words.first[t])
        places = [{"start": s - first, "end": e - first, "byte_start": int(words.starts[s] - offsets[t]), "byte_end": int(words.ends[e - 1] - offsets[t])} for s, e in merged]
        out.append({"n_words": n, "hit_spans": places, "items": sorted(windows.names[i] for i in found)})
    return out


def _lookup(docs: DataFrame, windows: list):
    """A column function from a text to its hits among the windows."""
    shared = docs.sparkSession.sparkContext.broadcast(WindowSet(windows))

    @F.arrow_udf(_HITS)
    def look(texts: pa.Array) -> pa.Array:
        windows = shared.value
        out = []
        for _, _, data, offsets in blocks(texts):
            out += _hits(data, offsets, windows)
        return pa.array(out, _HITS_ARROW)

    return look


def _merged(spans: F.Column) -> F.Column:
    """Overlapping and touching spans made one."""
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    joined = lambda acc, s: F.struct(
        last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end"),
        last(acc)["byte_start"].alias("byte_start"), F.greatest(last(acc)["byte_end"], s["byte_end"]).alias("byte_end"),
    )
    touches = lambda acc, s: F.coalesce(F.try_element_at(acc, F.lit(-1))["end"] >= s["start"], F.lit(False))
    step = lambda acc, s: F.when(touches(acc, s), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined(acc, s)))).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.expr("array()").cast(_SPAN), step)


def scan_documents(docs: DataFrame, benchmark: DataFrame, n_words: int = N_WORDS, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", set_bytes: int = SET_BYTES) -> DataFrame:
    """keep columns of each row of docs, n_words, hit_spans (disjoint; words and bytes, end exclusive) and items.

    Words are runs of ASCII digits, ASCII letters in lower case and characters beyond ASCII. A
    hash hit counts only if the words are those of the window. Null and empty texts have no
    words and no hits, nor have items without words; an empty benchmark gives no hits. The
    windows come to the driver in sets of about set_bytes; only a benchmark of more needs
    further passes, whose hits are joined by a row number. Repeated rows are rows of their own.
    Other columns of docs aren't looked at, so their names can't clash.
    """
    each = benchmark_windows(benchmark, n_words).groupBy("h", "length", "words").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    windows = stash(each, "windows")
    size = F.length("words") + F.aggregate("items", F.lit(0), lambda a, x: a + F.length(x) + 8) + 32
    total = windows.agg(F.sum(size).alias("n")).first()["n"] or 0
    passes = max(1, -(-total // set_bytes))
    look = [_lookup(docs, windows.filter(F.pmod("h", F.lit(passes)) == 0).collect())]
    if passes == 1:
        discard(windows)
        return bounded(docs).select(*keep, look[0](text_col).alias("_hit")).select(*keep, "_hit.*")
    numbered = bounded(docs).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    numbered = stash(numbered, "numbered")
    first = stash(numbered.withColumn("_hit", look.pop()("_text")).drop("_text"), "pass")
    more = None
    for k in range(1, passes):
        found = _lookup(docs, windows.filter(F.pmod("h", F.lit(passes)) == k).collect())
        part = stash(numbered.select("_row", found("_text").alias("_hit")).filter(F.size("_hit.hit_spans") > 0), "pass")
        more = part if more is None else more.unionByName(part)
    discard(windows, numbered)
    # a row has at most one entry for each pass here
    hits = more.groupBy("_row").agg(F.flatten(F.collect_list("_hit.hit_spans")).alias("_spans"), F.flatten(F.collect_list("_hit.items")).alias("_items"))
    joined = first.join(hits, "_row", "left")
    spans = F.when(F.col("_spans").isNull(), F.col("_hit.hit_spans")).otherwise(_merged(F.concat("_hit.hit_spans", "_spans")))
    items = F.when(F.col("_items").isNull(), F.col("_hit.items")).otherwise(F.array_sort(F.array_distinct(F.concat("_hit.items", "_items"))))
    return joined.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "_hit.n_words", spans.alias("hit_spans"), items.alias("items"))


def measures(scanned: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated (hit words are at least a twentieth of all)."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return scanned.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long")).withColumn("items_sha256", F.sha2(F.concat_ws(",", F.array_sort("items")), 256)).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n_words: int = N_WORDS) -> DataFrame:
    """The rows of docs that aren't contaminated, with the columns of docs; others stay as they are."""
    names = docs.columns
    plain = docs.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)))
    scanned = scan_documents(plain, benchmark, n_words, tuple(plain.columns), f"_c{names.index('text')}")
    clean = measures(scanned).filter(~F.col("contaminated"))
    return clean.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(names)))


def remove_spans(docs: DataFrame, benchmark: DataFrame, n_words: int = N_WORDS) -> DataFrame:
    """doc_id and text without the hit spans; what stood around a span stays as it was. Null and empty texts stay so."""
    scanned = scan_documents(docs, benchmark, n_words, ("doc_id", "text"))

    @F.arrow_udf(T.StringType())
    def without(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for text, first, last in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist()):
            if first:
                data, parts, at = text.encode(), [], 0
                for s, e in zip(first, last):
                    parts.append(data[at:s])
                    at = e
                text = (b"".join(parts) + data[at:]).decode()
            out.append(text)
        return pa.array(out, pa.string())

    return scanned.select("doc_id", without("text", F.col("hit_spans.byte_start"), F.col("hit_spans.byte_end")).alias("text"))
