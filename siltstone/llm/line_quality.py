"""Document quality by a linear-chain conditional random field over lines (operator 9).

Each line is good or bad. Its features are shares of characters and of repeated words and the
same of the lines before and after it; the chain adds weights for neighbouring labels. Lines
of a labelled document take its label, as no line has one of its own: every chain that is
learned from is constant, so the transitions learn how strongly lines go together. The probabilities that lines are good (forward-backward
marginals), weighted by length, make the document's value, which a logistic curve fitted to
the same rows turns into its score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm._cluster import bounded
from siltstone.llm._textscan import NON_SPACE, Words, blocks

#: Labelled documents that weights are fitted to.
MAX_TRAIN = 3000
THRESHOLD = 0.3
STEPS = 120
LAGS = 12

#: A labelled document's lines are learned from in chains of so many.
CHAIN = 64

#: Lines that one labelled document gives at most.
TRAIN_LINES = 256

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"#$%&*@^~_=+<>{}[]\\/|`",
    "bar": b"|",
    "mark": b"!?",
    "stop": b".,;:",
    "space": b" \t\r\n",
    "high": bytes(range(128, 256)),
}
_TABLES = {k: np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(v, np.uint8)) for k, v in _KINDS.items()}
_N_OWN = 20
N_FEATURES = 1 + _N_OWN + 2 * 6


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line, its length in bytes, and the number of lines of each text (an empty text has one empty line)."""
    ends = np.flatnonzero(data == 10) + 1
    starts = np.sort(np.concatenate([offsets[:-1], ends]), kind="stable")
    lines = np.append(starts, len(data))
    per_text = 1 + np.diff(np.searchsorted(ends - 1, offsets))
    size = np.diff(lines)
    some = np.maximum(size, 1)
    count = {}
    for kind, table in _TABLES.items():
        total = np.concatenate([[0], np.cumsum(table[data])])
        count[kind] = (total[lines[1:]] - total[lines[:-1]]) / some
    words = Words(data, lines, NON_SPACE, lower=False)
    n_words = np.diff(words.first)
    filled = np.maximum(n_words, 1)
    repeats = []
    for lag in range(1, LAGS + 1):
        same = (words.hash[lag:] == words.hash[:-lag]) & (words.text[lag:] == words.text[:-lag])
        repeats.append(np.bincount(words.text[lag:][same], minlength=len(size)) / filled)
    repeated = np.max(repeats, axis=0)
    letters = np.maximum(1 - count["symbol"] - count["space"] - count["mark"] - count["stop"] - count["digit"], 1e-3)
    upper = np.minimum(count["upper"] / letters, 1)
    own = [
        np.log1p(size) / 5, np.log1p(n_words) / 4, (size - count["space"] * some) / filled / 10, upper, upper > 0.3, upper > 0.7, count["digit"] * 5, count["digit"] > 0.1,
        count["symbol"] * 5, count["symbol"] > 0.02, count["symbol"] > 0.08, count["bar"] * 5, count["bar"] > 0.03, count["mark"] * 5, count["mark"] > 0.05,
        count["stop"] * 5, count["high"], repeated, repeated > 0.2, repeated > 0.5,
    ]
    own = np.stack([np.asarray(x, np.float64) for x in own], axis=1)
    first = np.concatenate([[0], np.cumsum(per_text)])[:-1]
    last = np.cumsum(per_text) - 1
    beside = np.stack([np.ones(len(size)), upper, count["symbol"] * 5, count["bar"] * 5, repeated, count["mark"] * 5], axis=1)
    before, after = np.zeros_like(beside), np.zeros_like(beside)
    before[1:], after[:-1] = beside[:-1], beside[1:]
    before[first], after[last] = 0, 0
    return np.concatenate([np.ones((len(size), 1)), own, before, after], axis=1), size, per_text


def _onward(f: np.ndarray, a: np.ndarray) -> np.ndarray:
    return np.logaddexp(a[0, 1], a[1, 1] + f) - np.logaddexp(a[0, 0], a[1, 0] + f)


def marginals(unary: np.ndarray, lengths: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds of good for padded chains (chains by positions) by forward-backward; the forward and backward messages too."""
    forward, backward = np.zeros_like(unary), np.zeros_like(unary)
    n = unary.shape[1]
    if n:
        forward[:, 0] = unary[:, 0]
    for t in range(1, n):
        forward[:, t] = unary[:, t] + _onward(forward[:, t - 1], a)
    for t in range(n - 2, -1, -1):
        step = _onward(unary[:, t + 1] + backward[:, t + 1], a.T)
        backward[:, t] = np.where(t + 1 < lengths, step, 0)
    return forward + backward, forward, backward


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Model:
    weights: np.ndarray
    transitions: np.ndarray
    slope: float
    intercept: float

    def values(self, features: np.ndarray, size: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """Length-weighted share of good of each text, before calibration."""
        unary = features @ self.weights
        order = np.argsort(-per_text, kind="stable")
        first = np.concatenate([[0], np.cumsum(per_text)])[:-1]
        out = np.zeros(len(per_text))
        at = 0
        while at < len(order):  # chains of like lengths together
            longest = per_text[order[at]]
            end = at + int(np.searchsorted(-per_text[order[at:]], -longest // 2, side="right"))
            own = order[at : max(end, at + 1)]
            places = first[own][:, None] + np.arange(longest)[None, :]
            inside = np.arange(longest)[None, :] < per_text[own][:, None]
            places = np.where(inside, places, first[own][:, None])
            odds, *_ = marginals(np.where(inside, unary[places], 0), per_text[own], self.transitions)
            weight = np.where(inside, size[places] + 1, 0)
            out[own] = (_sigmoid(odds) * weight).sum(axis=1) / weight.sum(axis=1)
            at += len(own)
        return out

    def scores(self, features: np.ndarray, size: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * _logit(self.values(features, size, per_text)) + self.intercept)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], steps: int = STEPS, penalty: float = 1e-3) -> Model:
    """Fit to (features, line sizes, label) of documents by gradient steps (Adam) on the chains' likelihood."""
    chains = [(x[a : a + CHAIN], y) for x, _, y in samples for a in range(0, len(x), CHAIN)]
    longest = max(len(x) for x, _ in chains)
    features = np.zeros((len(chains), longest, N_FEATURES), np.float32)
    lengths = np.array([len(x) for x, _ in chains])
    labels = np.array([y for _, y in chains])
    for i, (x, _) in enumerate(chains):
        features[i, : len(x)] = x
    inside = np.arange(longest)[None, :] < lengths[:, None]
    # chains count alike, whatever their lengths, so a few long documents don't outweigh the others
    share = inside / lengths[:, None] / len(chains)
    theta = np.zeros(N_FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, a = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
        unary = np.where(inside, features @ w.astype(np.float32), 0).astype(np.float64)
        odds, forward, backward = marginals(unary, lengths, a)
        error = (_sigmoid(odds) - labels[:, None]) * share
        gradient = np.append(np.einsum("ct,ctf->f", error.astype(np.float32), features, optimize=True), np.zeros(4))
        if longest > 1:
            onward = unary[:, 1:] + backward[:, 1:]
            joint = np.stack([np.zeros_like(onward) + a[0, 0], onward + a[0, 1], forward[:, :-1] + a[1, 0], forward[:, :-1] + onward + a[1, 1]])
            joint = np.exp(joint - joint.max(axis=0))
            joint /= joint.sum(axis=0)
            pair = share[:, 1:]
            for k, truth in enumerate((1 - labels, 0 * labels, 0 * labels, labels)):
                gradient[N_FEATURES + k] = ((joint[k] - truth[:, None]) * pair).sum()
        gradient += penalty * theta
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = Model(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2), 1.0, 0.0)
    x = _logit(np.concatenate([model.values(f, s, np.array([len(f)])) for f, s, _ in samples]))
    y = np.array([label for *_, label in samples])
    # smoothed targets keep the curve finite where the classes are apart
    goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    slope, intercept = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(slope * x + intercept)
        r = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(r * x * x).sum() + 1e-3, (r * x).sum()], [(r * x).sum(), r.sum() + 1e-3]])
        g = np.array([((p - goal) * x).sum(), (p - goal).sum()])
        d = np.linalg.solve(h, g)
        slope, intercept = slope - np.clip(d[0], -1, 1), intercept - np.clip(d[1], -1, 1)
    model.slope, model.intercept = max(slope, 1e-3), intercept
    return model


def fit(docs: DataFrame, labels: DataFrame, may_learn: F.Column, max_train: int = MAX_TRAIN, train_lines: int = TRAIN_LINES) -> Model | None:
    """Fit to at most max_train documents (the first by a hash of their ids) with a label 0 or 1 that may be learned from. None without both labels.

    may_learn is over doc_id. Labels that contradict each other or are null don't count; of
    rows that share an id the least text is taken. A document of more than train_lines lines
    gives chains of CHAIN lines, evenly over the whole text, of that many lines together; so
    max_train * train_lines rows of features at most reach the driver.
    """
    known = labels.filter(may_learn & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("_least"), F.max("quality").alias("_label")).filter("_least = _label")
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train).select(F.col("doc_id").alias("_id"), "_label")
    joined = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id"))  # max_train rows
    joined = bounded(joined).groupBy("doc_id", "_label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("doc_id", "text", "_label")

    def sampled(n: int) -> np.ndarray:
        """Line numbers of the chains that a document of n lines gives."""
        if n <= train_lines:
            return np.arange(n)
        at = np.linspace(0, n - CHAIN, max(1, train_lines // CHAIN)).astype(np.int64)
        return np.unique((at[:, None] + np.arange(CHAIN)[None, :]).ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                features, size, per_text = line_features(data, offsets)
                first = np.concatenate([[0], np.cumsum(per_text)])
                rows = [first[i] + sampled(n) for i, n in enumerate(per_text)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([features[r].astype("<f4").tobytes() for r in rows], pa.binary()), pa.array([size[r].astype("<i8").tobytes() for r in rows], pa.binary())], names=["doc_id", "label", "features", "size"])

    found = joined.mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("label", some.schema["_label"].dataType), T.StructField("features", T.BinaryType()), T.StructField("size", T.BinaryType())])).collect()
    found.sort(key=lambda r: (r["doc_id"], len(r["features"]), r["features"]))
    samples = [(np.frombuffer(r["features"], "<f4").reshape(-1, N_FEATURES), np.frombuffer(r["size"], "<i8"), int(r["label"])) for r in found]
    if len({y for *_, y in samples}) < 2:
        return None
    return train(samples)


def score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """keep columns, score and predicted of each row.

    A null text is an empty one, which is one empty line; without a model every score is 0.5.
    Repeated rows have equal scores; an empty table gives an empty result. Only texts go to
    Python, and only scores come back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def scores(texts: pa.Array) -> pa.Array:
        model = shared.value
        found = [model.scores(*line_features(data, offsets)) if model else np.full(b - a, 0.5) for a, b, data, offsets in blocks(texts)]
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    scored = bounded(docs).select(*keep, scores(text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def learnable() -> F.Column:
    """Documents whose crc32(doc_id as text) mod 5 is not 0."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0


def keep_good(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of docs that aren't predicted to be bad, with the columns of docs."""
    names = docs.columns
    model = fit(docs, labels, learnable(), max_train)
    plain = docs.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)))
    scored = score(plain, model, tuple(plain.columns), f"_c{names.index('text')}")
    return scored.filter("predicted = 1").select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(names)))
