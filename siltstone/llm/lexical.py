"""Ranked lexical search over a two-level quantised index (operator 11).

A term counts in a document by its impact, 1e9 * tf div (1000 * tf + 20 * m), where m grows with
the document's length. The index is a table of blocks of documents. Its first level holds, for
each term of the block, the documents that have it and their impacts as bytes, rounded up to
steps of STEP. From those alone follow a bound above and a bound below each document's score. Its
second level holds counts and lengths. They are looked at for the documents whose upper bound
reaches the k-th largest lower bound of their block, and only those are scored, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm._cluster import bounded, stash
from siltstone.llm._textscan import ALNUM, Words, blocks

#: An impact is below this.
MOST = 1_000_000

#: A byte of the first level stands for so much: a byte of q is an impact over (q - 1) * STEP and up to q * STEP.
STEP = -(-MOST // 255)

#: A block of the index ends with the batch that brings it to so many documents or bytes of text.
BLOCK_DOCS, BLOCK_BYTES = 16_384, 16 << 20

#: Queries that are looked for in one pass over the index.
QUERIES_AT_ONCE = 512

#: Parts in which the candidates of one query are ranked first.
SHARES = 64

_INDEX = "n_docs int, doc_ids binary, nulls binary, terms binary, starts binary, docs binary, impacts binary, counts binary, lengths binary"


def _lengths(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """How many documents have terms, and how many terms there are with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                inside = ALNUM[data]
                first = inside.copy()
                first[1:] &= ~inside[:-1]
                at = offsets[:-1][offsets[1:] > offsets[:-1]]
                first[at] = inside[at]
                before = np.concatenate([[0], np.cumsum(first)])
                own = before[offsets[1:]] - before[offsets[:-1]]
                n, total = n + int((own > 0).sum()), total + int(own.sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]}, schema=pa.schema([("n", pa.int64()), ("total", pa.int64())]))

    row = docs.select(text_col).mapInArrow(run, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return int(row["n"] or 0), int(row["total"] or 0)


def _scale(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents of n terms."""
    return 50 + (50 * n * n_docs) // max(1, n_terms)


def _impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class _Builder:
    """Gathers one block of documents."""

    def __init__(self, n_docs: int, n_terms: int):
        self.corpus = n_docs, n_terms
        self.clear()

    def clear(self) -> None:
        self.n, self.size = 0, 0
        self.ids, self.nulls, self.terms, self.docs, self.tf, self.lengths = [], [], [], [], [], []

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        for a, _, data, offsets in blocks(texts):
            words = Words(data, offsets, ALNUM)
            order = np.lexsort((words.hash, words.text))
            hashes, text = words.hash[order], words.text[order]
            new = np.ones(len(order), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
            first = np.flatnonzero(new)
            self.terms.append(hashes[first])
            self.docs.append((text[first] + (self.n + a)).astype(np.uint32))
            self.tf.append(np.diff(np.append(first, len(order))).astype(np.uint32))
            self.lengths.append(np.diff(words.first).astype(np.int64))
            self.size += len(data)
        self.n += len(ids)
        self.ids.append(np.array(ids.fill_null(0), np.int64))
        self.nulls.append(np.array(ids.is_null()))

    @property
    def full(self) -> bool:
        return self.size >= BLOCK_BYTES or self.n >= BLOCK_DOCS

    def block(self) -> pa.RecordBatch:
        ids, nulls, terms, docs, tf, lengths = (np.concatenate(x) for x in (self.ids, self.nulls, self.terms, self.docs, self.tf, self.lengths))
        order = np.argsort(terms, kind="stable")
        terms, docs, tf = terms[order], docs[order], tf[order]
        first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
        impact = _impacts(tf.astype(np.int64), _scale(lengths, *self.corpus)[docs])
        byte = (-(-impact // STEP)).astype(np.uint8)
        parts = [ids, np.packbits(nulls), terms[first], np.append(first, len(terms)).astype("<u8"), docs, byte, tf, lengths]
        columns = [pa.array([len(ids)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)]
        self.clear()
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _INDEX.split(", ")])


class Index:
    """A written index: its blocks, and the counts of the corpus that its impacts rest on."""

    def __init__(self, blocks: DataFrame, n_docs: int, n_terms: int):
        self.blocks, self.n_docs, self.n_terms = blocks, n_docs, n_terms


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index every row of docs, whole texts, in blocks.

    Terms are runs of digits, letters and all characters beyond ASCII, with A-Z in lower case;
    they are known by 64-bit hashes. A null or empty text has none and can't be found. Rows that
    share an id are documents of their own. Other columns aren't read.
    """
    n_docs, n_terms = _lengths(bounded(docs), text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = _Builder(n_docs, n_terms)
        for batch in batches:
            if batch.num_rows:
                builder.add(batch.column(0), batch.column(1))
            if builder.full:
                yield builder.block()
        if builder.n:
            yield builder.block()

    found = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, _INDEX)
    return Index(stash(found.withColumn("block", F.monotonically_increasing_id()), "index"), n_docs, n_terms)


def _query_terms(texts: list[list[str | None]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted hashes of all terms, and for each query the places of its own."""
    flat = [t or "" for own in texts for t in own]
    of = np.repeat(np.arange(len(texts)), [len(own) for own in texts])
    hashes, query = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, _, data, offsets in blocks(pa.array(flat, pa.string())):
        words = Words(data, offsets, ALNUM)
        hashes.append(words.hash)
        query.append(of[a + words.text])
    hashes, query = np.concatenate(hashes), np.concatenate(query)
    terms, place = np.unique(hashes, return_inverse=True)
    return terms, [np.unique(place[query == q]) for q in range(len(texts))]


def _document_frequencies(index: Index, terms: np.ndarray) -> np.ndarray:
    """In how many documents of the corpus each of the terms is; one row for each term reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for own, starts in zip(batch.column(0), batch.column(1)):
                known = np.frombuffer(own.as_py(), np.uint64)
                counts = np.diff(np.frombuffer(starts.as_py(), "<u8").astype(np.int64))
                at, hit = _find(known, terms)
                total[hit] += counts[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    found = np.zeros(len(terms), np.int64)
    for r in index.blocks.select("terms", "starts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        found[r["term"]] = r["df"]
    return found


def _find(known: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in known and in terms of what both have; both are sorted."""
    at = np.searchsorted(known, terms)
    hit = np.flatnonzero(at < len(known))
    hit = hit[known[at[hit]] == terms[hit]]
    return at[hit], hit


def _weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def _found_in(block: dict, corpus: tuple[int, int], terms: np.ndarray, weights: np.ndarray, queries: list[np.ndarray], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, documents, scores): of one block, the k best for each query, or all if fewer have a score."""
    known, starts = np.frombuffer(block["terms"], np.uint64), np.frombuffer(block["starts"], "<u8").astype(np.int64)
    docs, byte, tf = np.frombuffer(block["docs"], np.uint32), np.frombuffer(block["impacts"], np.uint8), np.frombuffer(block["counts"], np.uint32)
    ids, lengths, n = np.frombuffer(block["doc_ids"], np.int64), np.frombuffer(block["lengths"], np.int64), block["n_docs"]
    nulls = np.unpackbits(np.frombuffer(block["nulls"], np.uint8), count=n).astype(bool)
    m = _scale(lengths, *corpus)
    at, hit = _find(known, terms)
    place = dict(zip(hit.tolist(), at.tolist()))
    for q, own in enumerate(queries):
        own = [(int(weights[t]), place[t]) for t in own.tolist() if t in place]
        if not own:
            continue
        upper, width = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for w, p in own:
            rows = docs[starts[p] : starts[p + 1]]
            upper[rows] += w * byte[starts[p] : starts[p + 1]].astype(np.int64)
            width[rows] += w
        upper *= STEP
        lower = upper - STEP * width
        some = np.flatnonzero(upper)
        if len(some) > k:
            least = np.partition(lower[some], len(some) - k)[len(some) - k]
            some = some[upper[some] >= least]
        # the second level: exact scores of the documents that are left
        place_of = np.full(n, -1, np.int64)
        place_of[some] = np.arange(len(some))
        scores = np.zeros(len(some), np.int64)
        for w, p in own:
            rows = docs[starts[p] : starts[p + 1]]
            left = np.flatnonzero(place_of[rows] >= 0)
            d = rows[left]
            scores[place_of[d]] += w * _impacts(tf[starts[p] : starts[p + 1]][left].astype(np.int64), m[d])
        some, scores = some[scores > 0], scores[scores > 0]
        best = np.lexsort((ids[some], nulls[some], -scores))[:k]
        yield q, np.where(nulls[some[best]], -1, some[best]), ids[some[best]], scores[best]


def _pass(index: Index, texts: list[list[str | None]], first: int, k: int) -> DataFrame:
    """(query, doc_id, score): the k best of each block for queries numbered from first."""
    terms, queries = _query_terms(texts)
    weights = _weights(_document_frequencies(index, terms), index.n_docs)
    corpus = index.n_docs, index.n_terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for q, at, ids, scores in _found_in(row, corpus, terms, weights, queries, k):
                    known = pa.array(ids, pa.int64(), mask=at < 0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), first + q), pa.int64()), known, pa.array(scores, pa.int64())], names=["query", "doc_id", "score"])

    return index.blocks.mapInArrow(run, "query long, doc_id long, score long")


def search(index: Index, items: DataFrame, k: int = 50, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_col, rank (int, from 1), doc_id and score of the k documents with the highest scores above 0 for each item.

    w of a term is floor(1000 * ln((2 N + 2) / (2 df + 1))), m of a document 50 + (50 n N) div L; the score is the
    sum of w * impact over the item's terms, once each. Equal scores go by doc_id, null last;
    documents that share an id and a score have ranks of their own. Rows that share an item_col
    are one item with the terms of all. Items without terms, with a null text or with terms that
    no document has, have no rows. Items are numbered and looked for QUERIES_AT_ONCE at a time.
    """
    spark = items.sparkSession
    named = stash(_numbered(items.select(item_col).distinct(), item_col), "items")
    total = named.count()
    numbered = stash(items.select(item_col, text_col).join(named.withColumnRenamed(item_col, "_item"), F.col(item_col).eqNullSafe(F.col("_item"))).select("query", F.col(text_col).alias("_text")), "queries")
    found = None
    for first in range(0, total, QUERIES_AT_ONCE):
        texts: list[list[str | None]] = [[] for _ in range(min(QUERIES_AT_ONCE, total - first))]
        for r in numbered.filter(F.col("query").between(first, first + len(texts) - 1)).collect():  # QUERIES_AT_ONCE items
            texts[r["query"] - first].append(r["_text"])
        part = stash(_best(_pass(index, texts, first, k), k), "found")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query long, doc_id long, score long, rank int")
    return found.join(named, "query").select(item_col, "rank", "doc_id", "score")


def _numbered(ids: DataFrame, item_col: str) -> DataFrame:
    """ids with query: numbers from 0 without gaps, by partitions of a range sort."""
    placed = stash(ids.repartitionByRange(F.col(item_col).asc_nulls_first()).sortWithinPartitions(F.col(item_col).asc_nulls_first()).withColumn("_at", F.monotonically_increasing_id()), "placed")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each partition
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").select(item_col, (inside + F.col("_before")).alias("query"))


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, first within shares of its candidates."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    share = F.pmod(F.xxhash64("doc_id", "score"), F.lit(SHARES))
    first = found.withColumn("_share", share).withColumn("_rank", F.row_number().over(Window.partitionBy("query", "_share").orderBy(*order))).filter(F.col("_rank") <= k)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)
    return last.select("query", "doc_id", "score", "rank")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """search over build_index(docs)."""
    return search(build_index(docs), items, k)
