"""Reports over traces, columns and log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.routing import log_template
from siltstone.operators.statistics import count_below


def _at_rank(ties: DataFrame, group: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """(group, n, ranks): of each group's ordered values those at ranks, columns of _total counted from 0. ties has _n rows for each group and value."""
    totals = ties.groupBy(group).agg(F.sum("_n").alias("_total"))
    ranked = count_below(ties, value, "_n", group).join(totals, group)
    here = lambda k: (F.col("_below") <= k) & (k < F.col("_below") + F.col("_n"))
    return ranked.groupBy(group).agg(F.first("_total").alias("n"), *(F.max(F.when(here(k), F.col(value))).alias(name) for name, k in ranks.items()))


def model_report(traces: DataFrame, model: str, cost: str, latency: str, tokens: str) -> DataFrame:
    """Requests, tokens, measured costs and latencies (median, 95th, mean) by model; null models are unknown.

    A cost or latency that is null, 0 or below isn't measured. Models without latencies have null there.
    """
    rows = traces.withColumn("model", F.coalesce(F.when(F.col(model) != "", F.col(model)), F.lit("unknown"))).withColumn("_c", F.when(F.col(cost) > 0, F.col(cost))).withColumn("_l", F.when(F.col(latency) > 0, F.col(latency).cast("double")))
    sums = rows.groupBy("model").agg(F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("total_tokens"), F.round(F.coalesce(F.sum("_c"), F.lit(0.0)), 6).alias("total_cost_usd"), F.count("_c").alias("measured_cost_requests"), F.round(F.avg("_l"), 2).alias("mean_ms"))
    ties = rows.filter("_l IS NOT NULL").groupBy("model", "_l").agg(F.count(F.lit(1)).alias("_n"))
    at = _at_rank(ties, "model", "_l", {"p50_ms": F.floor(F.col("_total") / 2), "p95_ms": F.floor(F.col("_total") * 0.95)})
    out = sums.join(at.drop("n"), "model", "left").withColumn("avg_cost_usd", F.round(F.col("total_cost_usd") / F.greatest(F.col("measured_cost_requests"), F.lit(1)), 6))
    return out.withColumn("p50_ms", F.round("p50_ms", 2)).withColumn("p95_ms", F.round("p95_ms", 2))


def shadow_cost_delta(recommended: DataFrame, report: DataFrame) -> DataFrame:
    """(policy, comparisons, total_delta_usd, avg_delta_usd): average cost of the recommended model less that of the one used, where they differ and both are measured. recommended: (policy, model, rec_model)."""
    costs = report.filter("measured_cost_requests > 0").select("model", F.col("avg_cost_usd").alias("_cost"))
    # few different pairs stay before costs are joined
    pairs = recommended.filter("rec_model <> '' AND rec_model <> model").groupBy("policy", "model", "rec_model").agg(F.count(F.lit(1)).alias("_n"))
    priced = pairs.join(costs, "model").join(costs.select(F.col("model").alias("rec_model"), F.col("_cost").alias("_rec")), "rec_model")
    sums = priced.groupBy("policy").agg(F.sum("_n").alias("comparisons"), F.round(F.sum((F.col("_rec") - F.col("_cost")) * F.col("_n")), 6).alias("total_delta_usd"))
    return sums.withColumn("avg_delta_usd", F.round(F.col("total_delta_usd") / F.col("comparisons"), 6))


def column_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(name, kind, n_rows, missing, low, p50, high, n_distinct) for each column as text.

    kind: empty, number (thousands commas are dropped; inf and nan don't count), boolean, unique
    or text. low, p50 and high are for numbers alone, n_distinct for text and booleans. Blank and null
    cells are missing. p50 is at the rank 0.5 (n - 1), halves to the even one. Each value of a
    column is counted once before anything is ordered.
    """
    cells = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("cell")) for c in columns))).alias("_x")).select("_x.*")
    ties = cells.groupBy("name", "cell").agg(F.count(F.lit(1)).alias("_n"))
    text = F.trim(F.regexp_replace(F.coalesce("cell", F.lit("")), r"(?U)^\s+|\s+$", ""))
    plain = F.replace(text, F.lit(","), F.lit(""))
    number = F.when(plain.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), plain.cast("double"))
    marked = ties.withColumn("_present", text != "").withColumn("_v", number).withColumn("_bool", F.lower(text).isin("true", "false", "yes", "no", "0", "1"))
    here = F.col("_present")
    counted = marked.groupBy("name").agg(
        F.sum("_n").alias("n_rows"), F.coalesce(F.sum(F.when(~here, F.col("_n"))), F.lit(0)).alias("missing"), F.count_if(here).alias("_d"),
        F.coalesce(F.bool_and(F.when(here, F.col("_v").isNotNull())), F.lit(False)).alias("_numbers"), F.coalesce(F.bool_and(F.when(here, F.col("_bool"))), F.lit(False)).alias("_bools"), F.min("_v").alias("_low"), F.max("_v").alias("_high"),
    )
    values = marked.filter("_v IS NOT NULL").groupBy("name", "_v").agg(F.sum("_n").alias("_n"))
    middle = _at_rank(values, "name", "_v", {"_mid": F.bround((F.col("_total") - 1) * 0.5, 0).cast("long")}).drop("n")
    present = F.col("n_rows") - F.col("missing")
    kind = F.when(present == 0, "empty").when(F.col("_numbers"), "number").when(F.col("_bools"), "boolean").when(F.col("_d") == present, "unique").otherwise("text")
    full = counted.join(middle, "name", "left").withColumn("kind", kind)
    of_number = lambda c: F.when(F.col("kind") == "number", F.col(c))
    return full.select("name", "kind", "n_rows", "missing", of_number("_low").alias("low"), of_number("_mid").alias("p50"), of_number("_high").alias("high"), F.when(F.col("kind").isin("text", "boolean"), F.col("_d")).alias("n_distinct"))


def log_templates(lines: DataFrame, log: str, order: str, line: str) -> DataFrame:
    """(log, first, line, n): each log's first line of each template and how many lines have it. Blank lines don't count."""
    text = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    rows = lines.filter(text != "").withColumn("_t", log_template(text))
    return rows.groupBy(log, "_t").agg(F.min(order).alias("first"), F.min_by(line, order).alias("line"), F.count(F.lit(1)).alias("n")).drop("_t")


def status_counts(rows: DataFrame, keys: list[str], confidence: str) -> DataFrame:
    """(dimension, value, n, mean_confidence) by each of the keys, in one pass over their combinations."""
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(confidence).alias("_s"), F.count(confidence).alias("_c"))
    each = sums.select("_n", "_s", "_c", F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), F.col(k).cast("string").alias("value")) for k in keys))).alias("_k"))
    return each.groupBy("_k.dimension", "_k.value").agg(F.sum("_n").alias("n"), (F.sum("_s") / F.sum("_c")).alias("mean_confidence"))
