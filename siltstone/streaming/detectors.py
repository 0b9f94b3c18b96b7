"""Rates and shifts of keyed events: the same steps over a table and over a stream.

A detector is a start state of numbers and a step from one observation to the next. Over a
table, each key's rows are read in order from a sorted partition, with the state carried from
batch to batch, so no key's rows are held at once. Over a stream the state is Spark's, kept by
key in its checkpoint, and a restart goes on where it ended.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Weight of a new rate, the rate expected at first, and the least one.
RATE_WEIGHT, FIRST_RATE, LEAST_RATE = 0.1, 1.0, 0.001

# Weights of the hit rate's average, what a shift's sum allows for and must exceed, and how long it rests.
HIT_KEEP, HIT_NEW, ALLOWANCE, THRESHOLD, REST = 0.97, 0.03, 0.05, 3.0, 200

# So many shifts within so many observations are severe.
SEVERE_SHIFTS, SEVERE_WITHIN = 3, 500


@dataclass(frozen=True)
class Detector:
    """start: the state before the first observation; step(state, at, value) gives the next state and a row of output."""

    start: tuple
    step: Callable[[tuple, float, float], tuple[tuple, tuple]]
    output: str
    state: str


def _rate_step(state: tuple, at: float, value: float) -> tuple[tuple, tuple]:
    expected, last = state
    observed = value / max(at - last, 0.001)
    seen, known = max(observed, LEAST_RATE), max(expected, LEAST_RATE)
    surprise = max(0.0, known - seen + seen * math.log(seen / known))
    after = max(RATE_WEIGHT * observed + (1 - RATE_WEIGHT) * expected, LEAST_RATE)
    return (after, at), (expected, observed, surprise)


#: value: events since the observation before, at seconds. Gives the rate expected until now, the one seen, and its divergence.
RATES = Detector((FIRST_RATE, 0.0), _rate_step, "expected double, observed double, surprise double", "expected double, last double")


def _shift_step(state: tuple, at: float, value: float) -> tuple[tuple, tuple]:
    average, down, shifts, rest, seen, resets = state
    x = 1.0 if value else 0.0
    deviation = average - x - ALLOWANCE
    average, seen, found = HIT_KEEP * average + HIT_NEW * x, seen + 1, None
    if rest > 0:
        rest -= 1
    else:
        down = max(0.0, down + deviation)
        if down > THRESHOLD:
            down, shifts, rest, found = 0.0, shifts + 1, REST, "mild"
            if shifts >= SEVERE_SHIFTS and seen <= SEVERE_WITHIN:
                seen, resets, found = 0, resets + 1, "severe"
            elif seen > SEVERE_WITHIN:
                shifts, seen = 1, 0
    return (average, down, shifts, rest, seen, resets), (average, found)


#: value: whether it was a hit. Gives the hit rate's average and, where it fell for good, "mild" or "severe".
SHIFTS = Detector((0.5, 0.0, 0, 0, 0, 0), _shift_step, "hit_rate double, shift string", "average double, down double, shifts int, rest int, seen int, resets int")


def detect(rows: DataFrame, key: str, order: str, at: str, value: str, detector: Detector) -> DataFrame:
    """(key, order, the detector's output) of each row, its key's rows taken by order, then at, then value. Rows with a null in them are left out."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = [c.split()[0] for c in detector.output.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, detector.start
        for frame in frames:
            found = []
            for k, t, v in zip(frame[key], frame["_at"], frame["_value"]):
                if k != current:
                    current, state = k, detector.start
                state, out = detector.step(state, t, v)
                found.append(out)
            yield pd.concat([frame[[key, order]].reset_index(drop=True), pd.DataFrame(found, columns=names)], axis=1)

    known = rows.select(key, order, F.col(at).cast("double").alias("_at"), F.col(value).cast("double").alias("_value")).dropna()
    return known.repartition(key).sortWithinPartitions(key, order, "_at", "_value").mapInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {detector.output}")


def detect_stream(rows: DataFrame, key: str, order: str, at: str, value: str, detector: Detector, idle: str | None = None) -> DataFrame:
    """As detect, for a stream in append mode. Rows of one micro-batch are put in order; those of a later one come after.

    A key without rows for idle milliseconds of processing time, if given, is forgotten and starts anew.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = [c.split()[0] for c in detector.output.split(", ")]

    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = tuple(held.get) if held.exists else detector.start
        own = pd.concat(list(frames)).sort_values([order, "_at", "_value"], kind="stable")
        found = []
        for t, v in zip(own["_at"], own["_value"]):
            state, out = detector.step(state, float(t), float(v))
            found.append(out)
        held.update(state)
        if idle:
            held.setTimeoutDuration(int(idle))
        yield pd.concat([own[[key, order]].reset_index(drop=True), pd.DataFrame(found, columns=names)], axis=1)

    known = rows.select(key, order, F.col(at).cast("double").alias("_at"), F.col(value).cast("double").alias("_value")).dropna()
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return known.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {detector.output}", detector.state, "append", timeout)
