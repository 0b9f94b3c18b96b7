"""Deliveries over a table, over a stream with a restart and in a plain loop."""

import hashlib
import random
import time

import pytest

from siltstone.streaming import deliveries

SCHEMA = "k string, i int, at double, kind string, retry_after double"


def plain(rows, most, base, longest):
    held, out = {}, []
    for k, i, at, kind, asked in sorted(rows):
        state, n = held.get(k, ("pending", 0))
        old, due = (state, n), None
        if state == "pending" and kind != "revived":
            n += 1
            if kind == "sent":
                state = "delivered"
            elif n == most:
                state = "dead"
            else:
                part = int(hashlib.sha256(f"{k}:{n}".encode()).hexdigest()[:8], 16) / (2**32 - 1)
                delay = min(max(longest, base), base * 2 ** min(n - 1, 20)) * (0.85 + 0.3 * part)
                due = at + max(delay, min(longest, max(0.0, asked or 0.0)))
        elif state == "dead" and kind == "revived":
            state, n, due = "pending", 0, at
        held[k] = (state, n)
        out.append((k, i, state, n, old != (state, n), due))
    return out


def same(got, want):
    got = sorted(map(tuple, got), key=lambda r: r[:2])
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5] == (None if b[5] is None else pytest.approx(b[5], abs=1e-6))


@pytest.fixture(scope="module")
def tries():
    r = random.Random(8)
    kinds = {"a": "failed", "b": "failed failed revived", "c": "failed failed failed sent revived", "d": "sent", "e": "revived failed"}
    return [(k, i, i * 10.0, r.choice(kinds[k].split()), r.choice([None, -3.0, 2.0, 500.0])) for k in kinds for i in range(40)]


@pytest.mark.parametrize("most, base, longest", [(3, 1.0, 300.0), (30, 2.0, 50.0), (5, 9.0, 4.0), (1, 1.0, 1.0)])
def test_table(spark, tries, most, base, longest):
    want = plain(tries, most, base, longest)
    table = spark.createDataFrame(tries, SCHEMA)
    same(deliveries.outcomes(table.repartition(7), "k", "i", most, base, longest).collect(), want)


def test_stream_with_a_restart(spark, tries, tmp_path):
    table = spark.createDataFrame(tries, SCHEMA)
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    for low, high in ((0, 13), (13, 40)):
        table.filter(f"i >= {low} AND i < {high}").coalesce(1).write.mode("append").parquet(source)
        found = deliveries.outcomes(spark.readStream.schema(table.schema).parquet(source), "k", "i", 4, 1.0, 60.0)
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    want = plain(tries, 4, 1.0, 60.0)
    assert {w[2] for w in want} == {"pending", "dead", "delivered"}
    same(spark.read.parquet(out).select("k", "i", "state", "attempts", "changed", "next_attempt_at").collect(), want)


def test_nulls_other_kinds_and_empty(spark):
    rows = [("a", 1, 1.0, None, None), (None, 2, 1.0, "sent", None), ("a", 3, None, "sent", None), ("a", 4, 1.0, "lost", None), ("a", 5, 2.0, "failed", None), ("a", 5, 2.0, "failed", None)]
    got = deliveries.outcomes(spark.createDataFrame(rows, SCHEMA), "k", "i", 2).collect()
    assert sorted((r["i"], r["state"], r["attempts"]) for r in got) == [(5, "dead", 2), (5, "pending", 1)]
    assert deliveries.outcomes(spark.createDataFrame([], SCHEMA), "k", "i").count() == 0


def test_stream_forgets_idle_keys(spark, tmp_path):
    """A delivered key starts anew once it was idle."""
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    put = lambda i: spark.createDataFrame([("a", i, 1.0, "sent", None)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    put(1)
    schema = spark.createDataFrame([], SCHEMA).schema
    found = deliveries.outcomes(spark.readStream.schema(schema).parquet(source), "k", "i", idle="1")
    query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(processingTime="1 second").start()

    def until(condition):
        end = time.time() + 40
        while not condition():
            assert time.time() < end and query.exception() is None
            time.sleep(0.5)

    keys = lambda: query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress and query.lastProgress["stateOperators"] else -1
    try:
        until(lambda: any(p["numInputRows"] for p in query.recentProgress) and keys() == 0)
        put(2)
        until(lambda: sum(p["numInputRows"] for p in query.recentProgress) >= 2 and keys() == 0)
    finally:
        query.stop()
    got = spark.read.parquet(out).select("i", "state", "attempts", "changed").collect()
    assert sorted(map(tuple, got)) == [(1, "delivered", 1, True), (2, "delivered", 1, True)]
