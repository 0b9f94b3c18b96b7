"""Rates and shifts: a table, a stream with a restart, and a plain loop agree."""

import math
import random

import pytest

from siltstone.streaming import detectors


def plain_rates(rows):
    expected, last, out = 1.0, 0.0, []
    for i, at, n in rows:
        rate = n / max(at - last, 0.001)
        seen = max(rate, 0.001)
        out.append((i, expected, rate, max(0.0, expected - seen + seen * math.log(seen / expected))))
        expected, last = max(0.1 * rate + 0.9 * expected, 0.001), at
    return out


def plain_shifts(rows):
    ema, cusum, shifts, cool, since, out = 0.5, 0.0, 0, 0, 0, []
    for i, _, hit in rows:
        old, ema, since, found = ema, 0.97 * ema + 0.03 * hit, since + 1, None
        if cool:
            cool -= 1
        else:
            cusum = max(0.0, cusum + old - hit - 0.05)
            if cusum > 3:
                cusum, shifts, cool = 0.0, shifts + 1, 200
                if shifts >= 3 and since <= 500:
                    found, since = "severe", 0
                else:
                    found = "mild"
                    if since > 500:
                        shifts, since = 1, 0
        out.append((i, ema, found))
    return out


@pytest.fixture(scope="module")
def observations():
    r = random.Random(4)
    rows = []
    for key in ("a", "b", "c"):
        at = 0.0
        for i in range(900 if key == "a" else 150):
            at += r.expovariate(2)
            rows.append((key, i, at, r.choice([0, 1, 1, 5]), int(r.random() < (0.95 if i % 202 < 50 else 0.02))))
    return rows


@pytest.mark.parametrize("name", ["rates", "shifts"])
def test_table_stream_and_loop_agree(spark, observations, tmp_path, name):
    detector, plain, column = (detectors.RATES, plain_rates, 3) if name == "rates" else (detectors.SHIFTS, plain_shifts, 4)
    want = sorted((k, *x) for k in "abc" for x in plain([(i, at, row[column - 1]) for row in [(kk, i, at, n, h) for kk, i, at, n, h in observations if kk == k] for i, at, row in [(row[1], row[2], row[1:])]]))
    table = spark.createDataFrame(observations, "k string, i int, at double, n int, hit int")
    value = "n" if name == "rates" else "hit"
    close = lambda rows: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in sorted(map(tuple, rows), key=lambda r: r[:2])]
    got = detectors.detect(table.repartition(5), "k", "i", "at", value, detector).collect()
    assert close(got) == close(want)
    if name == "shifts":
        assert {x[3] for x in want} == {None, "mild", "severe"}
    # two runs over two halves of the input: the second goes on from the first one's checkpoint
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    for low, high in ((0, 100), (100, 1000)):
        table.filter(f"i >= {low} AND i < {high}").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(table.schema).parquet(source)
        found = detectors.detect_stream(stream, "k", "i", "at", value, detector)
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    assert close(spark.read.parquet(out).collect()) == close(want)


def test_nulls_and_empty(spark):
    table = spark.createDataFrame([("a", 1, 1.0, None), (None, 2, 1.0, 1), ("a", 3, 2.0, 1)], "k string, i int, at double, n int")
    assert [r["i"] for r in detectors.detect(table, "k", "i", "at", "n", detectors.RATES).collect()] == [3]
    assert detectors.detect(table.limit(0), "k", "i", "at", "n", detectors.SHIFTS).count() == 0
