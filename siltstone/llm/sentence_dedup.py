"""Substring dedup by sliding spans of sentences (operator 8).

Words are runs of characters but space and U+0009 to U+000D. A sentence ends after a word that
ends in . ! or ? (closing quotes or brackets may follow), at a line's end and at the text's.

Spans are runs of consecutive sentences: from each sentence on and back, the shortest run of
RUN sentences or more with RUN_WORDS words or more. Each longer run is a union of such runs, so
hashing those finds it too. A sentence of LONG_WORDS words is a run of its own: a passage that
is cut inside its first and its last sentence may hold just one whole sentence between them,
and without this rule it would stay. So if the whole sentences of a passage are that many, each
of them lies in a span inside it, wherever the passage starts and ends. Texts of under
RUN_WORDS words are never touched; lone sentences of under LONG_WORDS words, runs of under
RUN_WORDS words and sentences that are cut differently in both texts stay.

Each word is hashed once; sentences combine the hashes of their words and spans those of their
sentences, to 128 bits. Half of the bits are counted first; only spans that they repeat are
joined over all documents by all bits. The one with the least (document, sentence) is the
first of its kind, and sentences that any other one covers are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm._cluster import bounded, discard, fits, join_counted, stash
from siltstone.llm._textscan import NON_SPACE, Words, blocks, mix64

RUN = 2
RUN_WORDS = 12
LONG_WORDS = 20

_STOP = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
_CLOSER = np.isin(np.arange(256), np.frombuffer(b"\"')]", np.uint8))

#: Odd multipliers and salts of the two hashes.
_SALTS = ((0xA24BAED4963EE407, 0x9FB21C651E98DF25), (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))

#: Rows of one batch of spans.
_SPAN_ROWS = 50_000


def sentence_words(words: Words) -> np.ndarray:
    """The first word of each sentence of a block and, last, the number of words."""
    n = len(words.starts)
    if not n:
        return np.zeros(1, np.int64)
    data = words.data
    open_bytes = np.flatnonzero(~_CLOSER[data])
    at = np.searchsorted(open_bytes, words.ends) - 1
    tail = open_bytes[np.maximum(at, 0)]
    ends = (at >= 0) & (tail >= words.starts) & _STOP[data[tail]]
    lines = np.flatnonzero(data == 10)
    after = np.append(words.starts[1:], len(data))
    ends |= np.searchsorted(lines, after) > np.searchsorted(lines, words.ends)
    ends[:-1] |= words.text[1:] != words.text[:-1]
    ends[-1] = True
    return np.concatenate([[0], np.flatnonzero(ends) + 1])


def spans(first_word: np.ndarray, sentence_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the spans over the sentences of a block, each once.

    first_word is as sentence_words() gives it; sentence_end is the end of the text of each
    sentence, in sentences of the block, and texts have their sentences together.
    """
    n = len(first_word) - 1
    at = np.arange(n)
    end = np.maximum(at + RUN, np.searchsorted(first_word, first_word[:-1] + RUN_WORDS))
    end = np.minimum(end, np.searchsorted(first_word, first_word[:-1] + LONG_WORDS))
    begin = np.minimum(at + 1 - RUN, np.searchsorted(first_word, first_word[1:] - RUN_WORDS, side="right") - 1)
    begin = np.maximum(begin, np.searchsorted(first_word, first_word[1:] - LONG_WORDS, side="right") - 1)
    ahead = end <= sentence_end
    back = begin >= 0
    back[back] = sentence_end[begin[back]] == sentence_end[at[back]]
    both = np.concatenate([at[ahead] * (n + 1) + end[ahead], begin[back] * (n + 1) + at[back] + 1])
    return np.divmod(np.unique(both), n + 1)


def _span_hashes(words: Words, first_word: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of the words of each span."""
    n_sentences = len(first_word) - 1
    place = np.arange(len(words.starts)) - np.repeat(first_word[:-1], np.diff(first_word))
    place = (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    length = first_word[end] - first_word[first]
    found = []
    for salt, step in _SALTS:
        sentence = np.add.reduceat(mix64((words.hash ^ np.uint64(salt)) + place), first_word[:-1])
        sentence = mix64(sentence + np.diff(first_word).astype(np.uint64))
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n_sentences, step, np.uint64)]))
        undo = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n_sentences, pow(step, -1, 1 << 64), np.uint64)]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sentence * power[:-1])])
        found.append(mix64((sums[end] - sums[first]) * undo[first] + length.astype(np.uint64)))
    return found


def span_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t, first, n, h_a, h_b): the spans of each text, in its sentences, and two 64-bit hashes of their words; t is the text's own hash."""
    schema = "doc_id long, t long, first int, n int, h_a long, h_b long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashed = batch.column(0), batch.column(2)
            for a, b, data, offsets in blocks(batch.column(1)):
                words = Words(data, offsets, NON_SPACE)
                first_word = sentence_words(words)
                if len(first_word) == 1:
                    continue
                text = words.text[first_word[:-1]]
                base = np.searchsorted(text, np.arange(b - a + 1))
                first, end = spans(first_word, base[text + 1])
                hashes = _span_hashes(words, first_word, first, end)
                own, own_t = ids.slice(a, b - a), hashed.slice(a, b - a)
                for x in range(0, len(first), _SPAN_ROWS):
                    part = slice(x, x + _SPAN_ROWS)
                    row = text[first[part]]
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(row)), own_t.take(pa.array(row)), pa.array((first[part] - base[row]).astype(np.int32)), pa.array((end[part] - first[part]).astype(np.int32)), *(pa.array(h[part].view(np.int64)) for h in hashes)], names=["doc_id", "t", "first", "n", "h_a", "h_b"])

    return bounded(docs).filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), text_col, F.xxhash64(text_col)).mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t, first, n, first_doc): each span that isn't the first of its kind, and the document of the first; a written table."""
    found = stash(span_table(docs, id_col, text_col), "spans")
    twice = found.groupBy("h_a").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    twice = stash(twice, "twice")
    total = max(1, twice.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"])
    if fits(twice):
        same = found.join(F.broadcast(twice.select("h_a")), "h_a", "left_semi")
    else:
        same = join_counted(found, twice, ["h_a"], "_n", total, "inner").drop("_n")
    same = stash(same, "same")
    kinds = same.groupBy("h_a", "h_b").agg(F.min(F.struct("doc_id", "t", "first")).alias("lead"), F.count(F.lit(1)).alias("_n"))
    kinds = stash(kinds.filter(F.col("_n") > 1).select("h_a", "h_b", "_n", F.col("lead.doc_id").alias("first_doc"), F.col("lead.t").alias("first_t"), F.col("lead.first").alias("first_at")), "kinds")
    discard(found, twice)
    joined = join_counted(same, kinds, ["h_a", "h_b"], "_n", total, "inner")
    lead = (F.col("doc_id") == F.col("first_doc")) & (F.col("t") == F.col("first_t")) & (F.col("first") == F.col("first_at"))
    out = stash(joined.filter(~lead).select("doc_id", "t", "first", "n", "first_doc"), "repeats")
    discard(same, kinds)
    return out


_PLACES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_CUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed_spans", _PLACES)])
_CUT_ARROW = pa.struct([("text", pa.string()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("removed_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _cut(raw: bytes, firsts: list[int], counts: list[int], starts: np.ndarray) -> tuple[str, int, list[dict[str, int]]]:
    """The text without the sentences of the spans, how many those are, and their places in code points. starts: the sentences' first bytes and the text's end."""
    n = len(starts) - 1
    cover = np.zeros(n + 1, np.int64)
    first = np.minimum(firsts, n)
    np.add.at(cover, first, 1)
    np.add.at(cover, np.minimum(first + np.array(counts), n), -1)
    gone = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
    begin, end = (starts[np.flatnonzero(x)] for x in (gone[1:] & ~gone[:-1], gone[:-1] & ~gone[1:]))
    out, done = [], 0
    for a, b in zip(begin.tolist(), end.tolist()):
        out.append(raw[done:a])
        done = b
    # code points before a byte: bytes that don't continue one
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    places = [{"start": a, "end": b} for a, b in zip(points[begin].tolist(), points[end].tolist())]
    return (b"".join(out) + raw[done:]).decode(), int(gone.sum()), places


@F.arrow_udf(_CUT)
def _without(texts: pa.Array, firsts: pa.Array, counts: pa.Array) -> pa.Array:
    out = []
    for a, b, data, offsets in blocks(texts):
        words = Words(data, offsets, NON_SPACE)
        first_word = sentence_words(words)
        begins = words.starts[first_word[:-1]]
        base = np.searchsorted(begins, offsets)
        for i in range(a, b):
            raw = data[offsets[i - a] : offsets[i - a + 1]].tobytes()
            x, y = base[i - a], base[i - a + 1]
            row = {"text": None, "n_sentences": int(y - x), "n_removed": 0, "removed_spans": []}
            if texts[i].is_valid:
                row["text"] = raw.decode() if not firsts[i].is_valid else None
            if firsts[i].is_valid and y > x:
                starts = np.append(begins[x:y], offsets[i - a + 1]) - offsets[i - a]
                row["text"], row["n_removed"], row["removed_spans"] = _cut(raw, firsts[i].as_py(), counts[i].as_py(), starts)
            out.append(row)
    return pa.array(out, _CUT_ARROW)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text as it is without the repeated sentences, and n_sentences, n_removed, removed_spans and first_docs.

    removed_spans are (start, end) code points of the text as it was, neighbours merged;
    first_docs are the documents that hold the first of the spans. Null texts stay null, empty
    ones empty. Rows that share id and text are one document: they are treated alike and
    aren't repeats of each other. Rows with a null id neither lose sentences nor make others
    lose them. Different texts under one id are documents of their own, in the order of their
    hashes. Columns of docs with the names of the four give way to them. An empty table
    gives an empty result.
    """
    repeats = repeated_spans(docs, id_col, text_col)
    by_doc = repeats.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set(F.struct("first", "n"))).alias("_spans"), F.array_sort(F.collect_set("first_doc")).alias("_docs"))
    names = docs.columns
    plain = docs.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)))
    key, text = f"_c{names.index(id_col)}", f"_c{names.index(text_col)}"
    joined = plain.join(by_doc, (F.col(key) == F.col("doc_id")) & (F.xxhash64(text) == F.col("t")), "left").select(*plain.columns, "_spans", "_docs")
    cut = joined.withColumn("_x", _without(text, F.col("_spans.first"), F.col("_spans.n")))
    extra = [F.col("_x.n_sentences"), F.col("_x.n_removed"), F.col("_x.removed_spans"), F.coalesce("_docs", F.array().cast("array<long>")).alias("first_docs")]
    kept = [c for c in names if c not in ("n_sentences", "n_removed", "removed_spans", "first_docs")]
    return cut.select(*(F.col("_x.text" if c == text_col else f"_c{names.index(c)}").alias(c) for c in kept), *extra)
