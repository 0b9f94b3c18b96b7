"""Grouped and ranked statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.lineage import cut

MAD_CONSISTENCY = 0.6745


def robust_anomalies(rows: DataFrame, group: str, value: str, least_group: int = 5, z: float = 2.5) -> DataFrame:
    """rows with median, mad and z whose value is z or more robust deviations from their group's median.

    Groups of fewer than least_group rows or with a deviation under 1e-9 have none. Groups are
    aggregated and joined back, so a hot group isn't one task's work.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least_group)
    med = quantiles(rows, group, value, {"med": 0.5}).join(sizes, group)
    with_med = rows.join(med, group)
    away = with_med.select(group, F.abs(F.col(value) - F.col("med")).alias("_away"))
    mad = quantiles(away, group, "_away", {"mad": 0.5}).filter("mad >= 1e-9")
    scored = with_med.join(mad, group).withColumn("z", MAD_CONSISTENCY * (F.col(value) - F.col("med")) / F.col("mad"))
    return scored.filter(F.abs("z") >= z).drop("_n")


def count_below(ties: DataFrame, value: str, n: str, group: str | None = None) -> DataFrame:
    """ties (one row for each group and numeric value, n rows each) with _below: how many rows of the group have a lower value.

    Values are dealt out by ranges, as many as the session has shuffle partitions, and summed
    within them and then over the ranges of each group; so neither a group nor the whole table
    is ordered in one task, and tasks stay as small as the session makes them.
    """
    keys = [group] if group else []
    # the range of a row must be the same for both sums: it is written with it
    dealt = cut(ties.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy(*keys, "_range").agg(F.sum(n).alias("_t"))
    # at most a row for each range of a group
    lower = F.sum("_t").over(Window.partitionBy(*keys or [F.lit(0)]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.withColumn("_lower", F.coalesce(lower, F.lit(0))).drop("_t")
    inner = F.coalesce(F.sum(n).over(Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_inner", inner).join(totals, [*keys, "_range"]).withColumn("_below", F.col("_inner") + F.col("_lower")).drop("_inner", "_lower", "_range")


def auroc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve with midranks for ties. Equal scores are one row before anything is ordered."""
    ties = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    ranked = count_below(ties, score, "n").withColumn("rank", F.col("_below") + (F.col("n") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return sums.select(F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).otherwise(F.lit(0.5)).alias("auroc"))


def _counted(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, _c, _below, _n): each value's rows, the group's rows with a lower one and all its rows. Null values don't count."""
    ties = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_c"))
    total = ties.groupBy(group).agg(F.sum("_c").alias("_n"))
    return count_below(ties, value, "_c", group).join(total, group)


def trimmed_mean(rows: DataFrame, group: str, value: str, share: float = 0.1) -> DataFrame:
    """Mean without max(1, int(n * share)) values at either end; the plain mean of fewer than three."""
    cut = F.when(F.col("_n") < 3, 0).otherwise(F.greatest(F.lit(1), F.floor(F.col("_n") * share)))
    first, last = F.greatest(F.col("_below"), cut), F.least(F.col("_below") + F.col("_c"), F.col("_n") - cut)
    kept = _counted(rows, group, value).withColumn("_k", F.greatest(F.lit(0), last - first))
    return kept.groupBy(group).agg((F.sum(F.col(value) * F.col("_k")) / F.sum("_k")).alias("trimmed_mean"))


def conformal_quantile(rows: DataFrame, group: str, value: str, alpha: float) -> DataFrame:
    """The ceil((n + 1)(1 - alpha))-th smallest value of each group, the largest one where that is beyond n."""
    at = F.greatest(F.lit(1), F.least(F.ceil((F.col("_n") + 1) * (1 - alpha)), F.col("_n")))
    hit = (F.col("_below") < at) & (at <= F.col("_below") + F.col("_c"))
    return _counted(rows, group, value).filter(hit).select(group, F.col(value).alias("quantile"))


def welford(rows: DataFrame, group: str, value: str, success: F.Column) -> DataFrame:
    """Successes, failures, mean and sample variance of each group."""
    return rows.groupBy(group).agg(F.sum(F.when(success, 1).otherwise(0)).cast("long").alias("successes"), F.sum(F.when(success, 0).otherwise(1)).cast("long").alias("failures"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"))


def geometric_mean(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Geometric mean of each group; 0 where a value isn't positive."""
    return rows.groupBy(group).agg(F.when(F.min(value) <= 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.log(F.when(F.col(value) > 0, F.col(value)))))).alias("geometric_mean"))


def quantiles(rows: DataFrame, group: str, value: str, levels: dict[str, float]) -> DataFrame:
    """(group, a column for each of levels): linearly interpolated quantiles of each group's values that aren't null.

    Equal values are one row before anything is ordered, and a group's values stay dealt out.
    """
    known = _counted(rows, group, value)
    found = []
    for name, q in levels.items():
        at = (F.col("_n") - 1) * F.lit(q)
        share = at - F.floor(at)
        holds = lambda k: F.max(F.when((F.col("_below") <= k) & (k < F.col("_below") + F.col("_c")), F.col(value)))
        low, high = holds(F.floor(at)), holds(F.ceil(at))
        found.append((low + (high - low) * F.max(share)).alias(name))
    return known.groupBy(group).agg(*found)


def median_and_mad(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Median and median absolute deviation of each group."""
    med = cut(quantiles(rows, group, value, {"median": 0.5}))
    away = rows.join(med, group).select(group, F.abs(F.col(value) - F.col("median")).alias("_away"))
    return med.join(quantiles(away, group, "_away", {"mad": 0.5}), group, "left").select(group, "median", "mad")


def conformal_p(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n, p): the right-tail conformal p-value of each value against its group. Equal values are one row before they are ordered."""
    p = (F.col("_n") - F.col("_below") - F.col("_c") + 1) / (F.col("_n") + 1)
    return _counted(rows, group, value).select(group, value, F.col("_c").alias("n"), p.alias("p"))


def ucb(rows: DataFrame, group: str, value: str, alpha: float = 1.0) -> DataFrame:
    """Upper confidence score of each group: mean plus annealed exploration. Variances stay within 0.001 and 1 and are 1 for fewer than two rows."""
    seen = rows.groupBy(group).agg(F.count(value).alias("_n"), F.avg(value).alias("_mean"), F.var_samp(value).alias("_var"))
    total = seen.agg(F.sum("_n").alias("_total"))
    var = F.when(F.col("_n") < 2, 1.0).otherwise(F.greatest(F.lit(0.001), F.least(F.lit(1.0), F.col("_var"))))
    rate = alpha / F.log(F.col("_total") + F.lit(2.718281828459045))
    return seen.crossJoin(F.broadcast(total)).select(group, (F.col("_mean") + rate * F.sqrt(var / (F.col("_n") + 1))).alias("ucb"))


def degree_outliers(nodes: DataFrame, edges: DataFrame, node: str, sigmas: float = 2.0, least: int = 3) -> DataFrame:
    """Nodes with least or more edges into them and over sigmas population deviations more than the mean of all nodes."""
    degrees = nodes.select(node).join(edges.groupBy(node).agg(F.count(F.lit(1)).alias("_d")), node, "left").select(node, F.coalesce("_d", F.lit(0)).alias("degree"))
    stats = degrees.agg(F.avg("degree").alias("_m"), F.stddev_pop("degree").alias("_sd"))
    found = degrees.crossJoin(F.broadcast(stats)).filter((F.col("degree") > F.col("_m") + sigmas * F.col("_sd")) & (F.col("degree") >= least))
    return found.select(node, "degree", F.when(F.col("_sd") > 0, (F.col("degree") - F.col("_m")) / F.col("_sd")).otherwise(F.lit(0.0)).alias("z"))


def e_product(rows: DataFrame, group: str, e_value: Column) -> DataFrame:
    """Logarithm of the product of each group's e-values, each 1e-9 at least, and their mean."""
    return rows.groupBy(group).agg(F.sum(F.log(F.greatest(e_value, F.lit(1e-9)))).alias("log_product"), F.avg(e_value).alias("mean"))


def unit_quantiles(rows: DataFrame, group: str, value: str, levels: dict[str, float]) -> DataFrame:
    """(group, a column for each of levels): linearly interpolated quantiles of each group; 0 for levels of 0 or less or no values, 1 for those of 1 or more."""
    within = {name: q for name, q in levels.items() if 0 < q < 1}
    groups = rows.groupBy(group).agg(F.count(value).alias("_some"))
    joined = groups.join(quantiles(rows, group, value, within), group, "left") if within else groups
    at = lambda name, q: F.coalesce(F.col(name), F.lit(0.0)) if name in within else F.when((F.col("_some") > 0) & F.lit(q >= 1), 1.0).otherwise(0.0)
    return joined.select(group, *(at(name, q).alias(name) for name, q in levels.items()))


def nearest_percentile(rows: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """(group, percentile): the value at the rounded place p / 100 * (n - 1), from 0, of each group."""
    at = F.round(p / 100 * (F.col("_n") - 1))
    return _counted(rows, group, value).filter((F.col("_below") <= at) & (at < F.col("_below") + F.col("_c"))).select(group, F.col(value).alias("percentile"))


def captured_mass(rows: DataFrame, group: str) -> DataFrame:
    """(group, mass): the share of each group's positive utility that its selected rows have; 0 without any."""
    worth = F.greatest(F.col("utility"), F.lit(0.0))
    sums = rows.groupBy(group).agg(F.sum(worth).alias("_all"), F.sum(F.when(F.col("selected"), worth).otherwise(0.0)).alias("_kept"))
    return sums.select(group, F.when(F.col("_all") <= 1e-12, 0.0).otherwise(F.col("_kept") / (F.col("_all") + 1e-12)).alias("mass"))


def renyi(value: str, alpha: float) -> Column:
    """Entropy of order alpha in bits of a group's positive values as shares of their sum, as an aggregate; alpha 1 is Shannon's, over 100 that of the greatest share. Null without any."""
    v = F.when(F.col(value) > 0, F.col(value))
    total = F.sum(v)
    if abs(alpha - 1.0) < 1e-10:
        return F.log2(total) - F.sum(v * F.log2(v)) / total
    if alpha > 100.0:
        return -F.log2(F.max(v) / total)
    return F.log2(F.sum(F.pow(v, F.lit(alpha))) / F.pow(total, F.lit(alpha))) / (1 - alpha)
