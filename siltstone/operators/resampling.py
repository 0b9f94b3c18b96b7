"""Bootstrap intervals: the same on any partitioning, all replicates in one aggregate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.lineage import cut
from siltstone.operators.statistics import count_below

#: Rows whose weights are drawn at once: few, so that their numbers stay in a core's cache.
BLOCK_ROWS = 32

#: Chances that a row is drawn at most 0, 1, 2, ... times in a large resample of as many rows.
_DRAWN = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))

#: How often a row is drawn by the first 16 bits of its number; _OPEN where the other bits decide.
_OPEN = -1.0
_ENDS = [np.searchsorted(_DRAWN, (np.arange(1 << 16) + more) / (1 << 16), side="right") for more in (0.0, 1 - 2.0**-37)]
_TIMES = np.where(_ENDS[0] == _ENDS[1], _ENDS[0], _OPEN).astype(np.float64)


def _drawn(keys: np.ndarray, replicate: np.ndarray) -> np.ndarray:
    """How often each key is drawn in each replicate: by a uniform number of 53 bits, mixed from both."""
    x = keys[:, None].astype(np.uint64) + (replicate[None, :].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    y = x >> np.uint64(30)
    x ^= y
    x *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(x, np.uint64(27), out=y)
    x ^= y
    x *= np.uint64(0x94D049BB133111EB)
    np.right_shift(x, np.uint64(31), out=y)
    x ^= y
    np.right_shift(x, np.uint64(48), out=y)
    times = _TIMES[y.view(np.int64)]
    odd = times == _OPEN
    if odd.any():
        times[odd] = np.searchsorted(_DRAWN, (x[odd] >> np.uint64(11)).astype(np.float64) / (1 << 53), side="right")
    return times


def replicate_means(rows: DataFrame, group: str, key: str, value: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(group, replicate, mean): means of resamples of each group's values that aren't null.

    A row is drawn as often as a Poisson number of mean 1 that follows from its key, the
    replicate and the seed, which for many rows is drawing with replacement; with few rows a
    replicate that draws none is left out. Each task sums its rows for all replicates first, so
    groups times replicates sums leave it, however many rows it has.
    """
    columns = np.arange(replicates)
    kind = rows.schema[group].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            frame = pd.DataFrame({"g": batch.column(0).to_pandas(), "h": np.asarray(batch.column(1), np.int64), "v": np.asarray(batch.column(2), np.float64)})
            for name, own in frame.groupby("g", dropna=False, sort=False):
                total = sums.setdefault(None if pd.isna(name) else name, np.zeros((2, replicates)))
                hashes, values = own["h"].to_numpy().astype(np.uint64), own["v"].to_numpy()
                for at in range(0, len(own), BLOCK_ROWS):
                    times = _drawn(hashes[at : at + BLOCK_ROWS], columns)
                    total[0] += times.sum(axis=0)
                    total[1] += values[at : at + BLOCK_ROWS] @ times
        for name, (times, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * replicates, batch.schema.field(0).type), pa.array(columns, pa.int32()), pa.array(times), pa.array(total)], names=["g", "r", "n", "s"])

    hashed = rows.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.xxhash64(F.col(key), F.lit(seed)).alias("h"), F.col(value).cast("double").alias("v"))
    found = hashed.mapInArrow(run, f"g {kind.simpleString()}, r int, n double, s double")
    return found.groupBy("g", "r").agg((F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("_n")).filter("_n > 0").select(F.col("g").alias(group), F.col("r").alias("replicate"), "mean")


def _at(estimates: str, q: float, interpolate: bool) -> F.Column:
    """A percentile of an array of replicates, sorted: between two of them, or the one at int(q * n)."""
    n, values = F.size(estimates), F.col(estimates)
    if not interpolate:
        return F.element_at(values, F.least(n, F.floor(F.lit(q) * n).cast("int") + 1))
    at = F.lit(q) * (n - 1)
    low, high = F.element_at(values, F.floor(at).cast("int") + 1), F.element_at(values, F.ceil(at).cast("int") + 1)
    return low * (1 - (at - F.floor(at))) + high * (at - F.floor(at))


def mean_interval(rows: DataFrame, group: str, key: str, value: str, replicates: int = 1000, seed: int = 42, interpolate: bool = True) -> DataFrame:
    """(group, mean, low, high): the mean of each group's values and where 95 % of its resamples' means lie.

    Ends are interpolated between replicates, or those at int(q * n) as paired differences take
    them. Ends differ from a plain bootstrap's by what its own seed makes of them, about 0.1 of a
    standard error at 1000 replicates. replicates numbers of a group are one row.
    """
    means = replicate_means(rows, group, key, value, replicates, seed).groupBy(group).agg(F.sort_array(F.collect_list("mean")).alias("_m"))
    observed = rows.filter(F.col(value).isNotNull()).groupBy(group).agg(F.avg(value).alias("mean"))
    return observed.join(means, group).select(group, "mean", _at("_m", 0.025, interpolate).alias("low"), _at("_m", 0.975, interpolate).alias("high"))


def median_ranks(sizes: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(stratum, replicate, lower, upper): ranks, from 1, of the two middle values of each resample of n values.

    sizes: (stratum, n). A resample's k-th smallest value is the one at ceil(n * u), u the k-th
    smallest of n uniform numbers, which has a beta distribution: so no value needs to be drawn.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for stratum, n, key in zip(frame["stratum"], frame["n"], frame["h"]):
                draw = np.random.default_rng([seed, int(key) & 0xFFFFFFFF, int(key) >> 32 & 0xFFFFFFFF])
                n, k = int(n), (int(n) + 1) // 2
                u = draw.beta(k, n - k + 1, replicates)
                rest = 1 - (1 - draw.random(replicates)) ** (1 / (n - k)) if n % 2 == 0 else np.zeros(replicates)
                rank = lambda x: np.clip(np.ceil(n * x), 1, n).astype(np.int64)
                yield pd.DataFrame({"stratum": stratum, "replicate": np.arange(replicates, dtype=np.int32), "lower": rank(u), "upper": rank(u + (1 - u) * rest)})

    return sizes.select("stratum", "n", F.xxhash64("stratum").alias("h")).mapInPandas(run, f"stratum {sizes.schema['stratum'].dataType.simpleString()}, replicate int, lower long, upper long")


def median_ratio_interval(rows: DataFrame, group: str, scenario: str, system: str, value: str, systems: tuple[str, str], replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(group, ratio, low, high): geometric mean over scenarios of the median of the second system by that of the first, and 95 % of its stratified resamples.

    Each scenario and system is resampled by itself. A median of 0 or less makes the whole mean 0.
    Values are looked up by rank in ranges of about n / 1000 ranks, so a stratum's values are
    dealt out. Scenarios without values of both systems are left out.
    """
    strata = rows.filter(F.col(value).isNotNull() & F.col(system).isin(*systems)).select(F.struct(F.col(group).alias("g"), F.col(scenario).alias("c"), F.col(system).alias("s")).alias("stratum"), F.col(value).cast("double").alias("v"))
    ties = cut(strata.groupBy(F.to_json("stratum").alias("stratum"), "v").agg(F.count(F.lit(1)).alias("_c"), F.first("stratum").alias("_of")))
    sizes = cut(ties.groupBy("stratum").agg(F.sum("_c").alias("n"), F.first("_of").alias("_of")))
    ranked = count_below(ties.select("stratum", "v", "_c"), "v", "_c", "stratum").join(sizes.select("stratum", "n"), "stratum")
    width = F.greatest(F.lit(1), F.floor(F.col("n") / 1000))
    spread = ranked.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_below") / width), F.floor((F.col("_below") + F.col("_c") - 1) / width))))
    middle = sizes.select("stratum", F.lit(-1).alias("replicate"), F.floor((F.col("n") + 1) / 2).alias("lower"), F.floor(F.col("n") / 2 + 1).alias("upper"))
    asked = median_ranks(sizes, replicates, seed).unionByName(middle).join(sizes.select("stratum", "n"), "stratum")
    asked = asked.select("stratum", "replicate", F.explode(F.array("lower", "upper")).alias("rank"), F.floor((F.col("rank") - 1) / width).alias("_bucket"))
    hit = (F.col("_below") < F.col("rank")) & (F.col("rank") <= F.col("_below") + F.col("_c"))
    medians = asked.join(spread.drop("n"), ["stratum", "_bucket"]).filter(hit).groupBy("stratum", "replicate").agg(F.avg("v").alias("m")).join(sizes.select("stratum", "_of"), "stratum")
    of = lambda s: F.max(F.when(F.col("_of.s") == s, F.col("m")))
    pairs = medians.groupBy(F.col("_of.g").alias(group), F.col("_of.c").alias("_scenario"), "replicate").agg(of(systems[0]).alias("_a"), of(systems[1]).alias("_b")).filter("_a IS NOT NULL AND _b IS NOT NULL")
    mean = F.when((F.min("_a") <= 0) | (F.min("_b") <= 0), 0.0).otherwise(F.exp(F.avg(F.log(F.when((F.col("_a") > 0) & (F.col("_b") > 0), F.col("_b") / F.col("_a"))))))
    each = pairs.groupBy(group, "replicate").agg(mean.alias("_r"))
    found = each.groupBy(group).agg(F.max(F.when(F.col("replicate") < 0, F.col("_r"))).alias("ratio"), F.sort_array(F.collect_list(F.when(F.col("replicate") >= 0, F.col("_r")))).alias("_m"))
    return found.select(group, "ratio", _at("_m", 0.025, True).alias("low"), _at("_m", 0.975, True).alias("high"))
