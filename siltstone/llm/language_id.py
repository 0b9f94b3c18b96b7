"""Language identification (operator 7).

Sparse multinomial logistic regression on TF-IDF of hashed character n-grams, trained with
follow-the-regularised-leader (FTRL-proximal) and elastic-net penalties, then calibrated by
a temperature. Document frequencies count all documents that may be learned from; weights
are fitted to at most MAX_TRAIN of them, spread evenly over the languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm._cluster import bounded
from siltstone.llm._textscan import mix64

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15

#: Documents that weights and temperature are fitted to.
MAX_TRAIN = 4000
EPOCHS = 3
SCALE = 50.0
UNKNOWN = "und"

_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_CHARS = 1 << 18


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every n-gram of texts in lower case. Runs of white space are one space; texts have one around them."""
    padded = [f" {' '.join(t.lower().split())} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    number = np.repeat(np.arange(len(texts)), [len(p) for p in padded])
    buckets, owners = [], []
    for order in ORDERS:
        n = len(points) - order + 1
        if n <= 0:
            continue
        total = points[:n] * _PLACE[0]
        for j in range(1, order):
            total = total + points[j : n + j] * _PLACE[j]
        whole = number[:n] == number[order - 1 :]
        hashed = mix64(total + np.uint64(order)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
        buckets.append(hashed[whole].astype(np.int64))
        owners.append(number[:n][whole])
    return np.concatenate(buckets), np.concatenate(owners)


def _portions(column: pa.Array, rows: int = 2000) -> Iterator[tuple[int, list[str]]]:
    """First row and texts (null: empty) of runs of rows with about _CHARS characters."""
    held, first, size = [], 0, 0
    for i, text in enumerate(column):
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= _CHARS or len(held) >= rows:
            yield first, held
            held, first, size = [], i + 1, 0
    if held:
        yield first, held


def _unique_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, bucket and count of the different n-grams of each text."""
    buckets, owners = _grams(texts)
    keys = np.sort(owners * BUCKETS + buckets)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first] // BUCKETS, keys[first] % BUCKETS, np.diff(np.append(first, len(keys)))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows of texts (one column) each bucket occurs, and the number of rows. BUCKETS + 1 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for _, held in _portions(batch.column(0)):
                counts[:BUCKETS] += np.bincount(_unique_counts(held)[1], minlength=BUCKETS)
                counts[BUCKETS] += len(held)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["bucket", "n"])

    out = np.zeros(BUCKETS + 1, np.int64)
    for r in texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out[:BUCKETS], int(out[BUCKETS])


@dataclass
class Model:
    """Labels, weights (buckets by labels, inverse document frequencies and scale included), biases and temperature."""

    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def scores(self, texts: list[str]) -> np.ndarray:
        buckets, owners = _grams(texts)
        sizes = np.bincount(owners, minlength=len(texts))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        logits = np.zeros((len(texts), len(self.labels)))
        order = np.argsort(owners, kind="stable")
        values = self.weights[buckets[order]]
        full = sizes > 0
        if full.any():
            logits[full] = np.add.reduceat(values, starts[full], axis=0) / sizes[full, None]
        return softmax((logits + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(samples: list[tuple[np.ndarray, np.ndarray, int]], n_labels: int, epochs: int = EPOCHS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with elastic-net penalties over (buckets, values, label) samples; the bias is bucket BUCKETS. Returns weights and biases."""
    z, n = np.zeros((BUCKETS + 1, n_labels)), np.zeros((BUCKETS + 1, n_labels))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - l1, 0)
        return -shrunk / ((beta + np.sqrt(ns)) / alpha + l2)

    order = np.random.RandomState(3)
    for _ in range(epochs):
        for i in order.permutation(len(samples)):
            buckets, values, label = samples[i]
            at = np.append(buckets, BUCKETS)
            x = np.append(values, 1.0)
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            p = softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha
            z[at] = zs + g - sigma * w
            n[at] = ns + g * g
    w = weights(z, n)
    return w[:-1], w[-1]


def fit(learn: DataFrame, max_train: int = MAX_TRAIN) -> Model | None:
    """Fit to learn (text, lang and an id h); rows without a text or lang are left out. None without rows.

    Each language gets an equal part of max_train: the rows with the least hashes of id and text,
    so neither one id nor none for all rows keeps a language out.
    """
    rows = learn.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    frequency, total = document_frequencies(rows.select("text"))
    if not total:
        return None
    rows = rows.withColumn("_deal", F.xxhash64("h", "text"))
    sizes = {r["lang"]: r for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("_deal").alias("least")).collect()}
    labels = sorted(sizes)
    each = max(1, max_train // len(labels))
    # twice the share is enough rows but for copies; the first row of a language is in at any rate
    share = F.create_map(*(F.lit(x) for lang in labels for x in (lang, min(1.0, 2 * each / sizes[lang]["n"]))))
    least = F.create_map(*(F.lit(x) for lang in labels for x in (lang, sizes[lang]["least"])))
    some = rows.filter((F.pmod(F.xxhash64("_deal"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)) | (F.col("_deal") == least[F.col("lang")]))
    picked = some.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_deal", "h", "text"))).filter(F.col("_r") <= each)
    idf = np.log((1 + total) / (1 + frequency)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for first, held in _portions(batch.column(0)):
                number, buckets, n = _unique_counts(held)
                bounds = np.searchsorted(number, np.arange(len(held) + 1))
                pairs = list(zip(bounds[:-1], bounds[1:]))
                yield pa.RecordBatch.from_arrays([pa.array(langs[first : first + len(held)], pa.string()), pa.array([buckets[a:b].astype("<u4").tobytes() for a, b in pairs], pa.binary()), pa.array([n[a:b].astype("<f4").tobytes() for a, b in pairs], pa.binary())], names=["lang", "buckets", "counts"])

    # max_train rows at most, the documented bound
    found = picked.orderBy(F.xxhash64("_deal", "lang"), "_deal", "lang", "h").select("text", "lang").mapInArrow(run, "lang string, buckets binary, counts binary").collect()
    samples = []
    for r in found:
        buckets, n = np.frombuffer(r["buckets"], "<u4").astype(np.int64), np.frombuffer(r["counts"], "<f4").astype(float)
        if len(n):
            samples.append((buckets, SCALE * n / n.sum() * idf[buckets], labels.index(r["lang"])))
    if not samples:
        return None
    fifth = max(1, len(samples) // 5)
    held, own = samples[:fifth], samples[fifth:] or samples
    weights, bias = train_ftrl(own, len(labels))
    logits = np.array([x @ weights[b] + bias for b, x, _ in held])
    truth = np.array([y for *_, y in held])
    # smoothed targets, so that a sample without an error doesn't make every score 1
    goal = np.full(logits.shape, 1 / (len(truth) + 2) / max(1, len(labels) - 1))
    goal[np.arange(len(truth)), truth] = 1 - 1 / (len(truth) + 2)
    losses = [(-(goal * np.log(softmax(logits / t) + 1e-300)).sum(axis=1).mean(), t) for t in np.exp(np.linspace(-3, 3, 121))]
    return Model(labels, (SCALE * idf[:, None] * weights).astype(np.float32), bias, float(min(losses)[1]))


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """keep columns, lang_pred and score (the calibrated probability). Null texts and texts without a letter are UNKNOWN with score 0, as all are without a model."""
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of weights
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    n = len(keep)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            known = batch.column(n + 1).to_pylist()
            langs, scores = [], []
            for first, held in _portions(batch.column(n)):
                p = model.scores(held) if model else np.zeros((len(held), 1))
                best = p.argmax(axis=1)
                for i, b in enumerate(best):
                    ok = model is not None and known[first + i]
                    langs.append(model.labels[b] if ok else UNKNOWN)
                    scores.append(float(p[i, b]) if ok else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[f.name for f in schema])

    return docs.select(*keep, F.col(text_col).alias("_text"), letter.alias("_letter")).mapInArrow(run, schema)


def identify(docs: DataFrame, held_out: F.Column, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of docs; only rows that aren't held out are learned from.

    Null texts and texts without a letter are `und` with score 0. With one language learned, all
    others are that one; with none, `und`. Null ids, shared ids, repeated rows and ties are rows like all:
    equal texts have equal results. An empty table gives an empty result. Weights take memory
    for each language of the labels.
    """
    flagged = bounded(docs).select("doc_id", "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    learn = flagged.filter(~F.col("held_out")).select("text", "lang", F.col("doc_id").alias("h"))
    return predict(flagged, fit(learn, max_train), ("doc_id", "held_out"))
