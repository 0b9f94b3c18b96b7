"""Deliveries that are tried again after failures until they are given up: the same over a table and over a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.streaming.detectors import Detector, detect, detect_stream

# Doublings of the delay at most, its least share and what chance adds to that.
DOUBLINGS, LEAST_SHARE, CHANCE = 20, 0.85, 0.30

_SENT, _REVIVED = -1.0, -2.0


def _machine(max_attempts: int) -> Detector:
    """State and attempts of a delivery. value: -1 sent, -2 revived, else failed and the seconds it was asked to wait."""

    def step(now: tuple, at: float, value: float) -> tuple[tuple, tuple]:
        state, attempts = now
        after = now
        if state == "pending" and value == _SENT:
            after = ("delivered", attempts + 1)
        elif state == "pending" and value >= 0:
            after = ("dead" if attempts + 1 >= max_attempts else "pending", attempts + 1)
        elif state == "dead" and value == _REVIVED:
            after = ("pending", 0)
        return after, (*after, after != now, at, value)

    return Detector(("pending", 0), step, "state string, attempts int, changed boolean, at double, wait double", "state string, attempts int")


def retry_delay(key: Column, attempts: Column, base_delay: float, max_delay: float) -> Column:
    """Seconds until the next try: doubled with each attempt up to max_delay, and spread by 15 % either way by a hash of key and attempt, so retries don't come all at once."""
    base, most = max(0.0, base_delay), max(max_delay, base_delay)
    raw = F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(DOUBLINGS))))
    spread = F.conv(F.substring(F.sha2(F.concat(key.cast("string"), F.lit(":"), attempts.cast("string")), 256), 1, 8), 16, 10).cast("double") / 0xFFFFFFFF
    return F.greatest(F.lit(0.0), raw * (LEAST_SHARE + CHANCE * spread))


def outcomes(tries: DataFrame, key: str, order: str, max_attempts: int = 8, base_delay: float = 1.0, max_delay: float = 300.0, idle: str | None = None) -> DataFrame:
    """(key, order, state, attempts, changed, next_attempt_at) after each row of tries, which is a table or a stream.

    tries: key, order, at (seconds), kind ("sent", "failed" or "revived") and retry_after (seconds or
    null). A pending delivery is delivered once sent, or dead at its max_attempts-th failure; a dead
    one is pending again, without attempts, once revived. All else changes nothing. After a failure the
    next try is due after retry_delay(), or retry_after up to max_delay if that is later; after a revival at once.

    Rows without key, order or at, or of another kind, are left out. A key's rows are taken by order, then
    at, then kind. None of a key's rows are held: its state is two values, which a stream keeps
    in its checkpoint. A stream forgets keys without rows for idle milliseconds, if given;
    its query then needs a trigger of an interval, as availableNow would wait for timeouts without end.
    """
    wait = F.greatest(F.lit(0.0), F.coalesce(F.col("retry_after").cast("double"), F.lit(0.0)))
    value = F.when(F.col("kind") == "sent", _SENT).when(F.col("kind") == "revived", _REVIVED).when(F.col("kind") == "failed", wait)
    known = tries.select(key, order, "at", value.alias("_outcome"))
    machine = _machine(max_attempts)
    found = detect_stream(known, key, order, "at", "_outcome", machine, idle) if tries.isStreaming else detect(known, key, order, "at", "_outcome", machine)
    delay = F.greatest(retry_delay(F.col(key), F.col("attempts"), base_delay, max_delay), F.least(F.lit(float(max_delay)), F.col("wait")))
    due = F.when(F.col("changed") & (F.col("state") == "pending"), F.col("at") + F.when(F.col("attempts") > 0, delay).otherwise(0.0))
    return found.select(key, order, "state", "attempts", "changed", due.alias("next_attempt_at"))
