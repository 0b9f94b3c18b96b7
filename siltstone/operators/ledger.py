"""Ledgers: savings, usage, snapshots and histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.lineage import cut, in_tasks


def savings_by_tier(events: DataFrame, adjustments: DataFrame, key: str, tier: str, gross: str, cost: str, debit: str) -> DataFrame:
    """Events, gross, base (gross minus the events' own cost), adjusted and net (base minus adjustments) sums by tier.

    Adjustments are summed by event before the join, so no event counts twice.
    """
    debits = adjustments.groupBy(key).agg(F.sum(debit).alias("_debit"))
    joined = events.join(debits, key, "left")
    sums = joined.groupBy(tier).agg(F.count(F.lit(1)).alias("n_events"), F.sum(gross).alias("gross"), F.sum(F.col(gross) - F.col(cost)).alias("base"), F.sum(F.coalesce("_debit", F.lit(0.0))).alias("adjusted"))
    return sums.withColumn("net", F.col("base") - F.col("adjusted"))


#: Sums of a usage summary, and the columns that may filter it.
USAGE_SUMS = ("uncached_input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens", "cost_micro_usd", "cache_savings_micro_usd")
USAGE_FILTERS = ("provider", "model", "team", "tool", "project", "conversation_id")


def usage_totals(events: DataFrame, filters: dict[str, str] | None = None) -> DataFrame:
    """One row: requests, USAGE_SUMS, unpriced_requests and cache_hit_token_ratio of the events that the filters leave. Other filter columns raise."""
    unknown = sorted(set(filters or {}) - set(USAGE_FILTERS))
    if unknown:
        raise ValueError(f"unsupported filters: {unknown}")
    for column, value in (filters or {}).items():
        events = events.filter(F.col(column) == value)
    unpriced = F.sum(F.when(F.col("pricing_source").startswith("unpriced:"), 1).otherwise(0))
    sums = events.agg(F.count(F.lit(1)).alias("requests"), *(F.coalesce(F.sum(c).cast("long"), F.lit(0)).alias(c) for c in USAGE_SUMS), F.coalesce(unpriced, F.lit(0)).alias("unpriced_requests"))
    cached = F.col("cache_read_tokens")
    return sums.withColumn("cache_hit_token_ratio", cached / F.greatest(F.lit(1), cached + F.col("uncached_input_tokens")))


def as_of(versions: DataFrame, entity: str, instant: str, sequence: str, at: F.Column) -> DataFrame:
    """The version of each entity with the largest sequence among those with an instant not after at; versions without an instant don't count."""
    known = versions.filter(F.col(instant) <= at)
    rest = [c for c in versions.columns if c != entity]
    return known.groupBy(entity).agg(F.max_by(F.struct(*rest), sequence).alias("_v")).select(entity, *(F.col(f"_v.{c}").alias(c) for c in rest))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, sequence: str, value: str) -> DataFrame:
    """(key, change, from_sequence, to_sequence, from_value, to_value) for entities added, or changed to another version, between two snapshots."""
    a = before.select(key, F.col(sequence).alias("from_sequence"), F.col(value).alias("from_value"), F.lit(True).alias("_old"))
    b = after.select(key, F.col(sequence).alias("to_sequence"), F.col(value).alias("to_value"))
    joined = b.join(a, key, "left").filter(~F.col("from_sequence").eqNullSafe(F.col("to_sequence")))
    change = F.when(F.col("_old").isNull(), "added").otherwise("changed")
    return joined.select(key, change.alias("change"), "from_sequence", "to_sequence", "from_value", "to_value")


def rollup(events: DataFrame, ts: str, value: str) -> DataFrame:
    """Count and sum by day, ISO week and month (UTC keys), in one pass over daily sums."""
    day = events.groupBy(F.to_date(ts).alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), F.col("d")).cast("string"), F.lit("-W"), F.lpad(F.weekofyear("d").cast("string"), 2, "0"))
    keys = F.array(F.struct(F.lit("day").alias("period"), F.date_format("d", "yyyy-MM-dd").alias("key")), F.struct(F.lit("week").alias("period"), week.alias("key")), F.struct(F.lit("month").alias("period"), F.date_format("d", "yyyy-MM").alias("key")))
    return day.select("n", "total", F.explode(keys).alias("k")).groupBy("k.period", "k.key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def insert_once(stored: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """stored and the rows of incoming with a new key; of repeated new keys the first by order."""
    fresh = incoming.join(stored.select(key), key, "left_anti")
    first = fresh.groupBy(key).agg(F.min_by(F.struct(*(c for c in fresh.columns if c != key)), order).alias("_v"))
    return stored.unionByName(first.select(key, "_v.*").select(*stored.columns))


def spikes(events: DataFrame, group: str, order: str, value: str, sigmas: float = 3.0, least: int = 3) -> DataFrame:
    """Rows that are over sigmas running deviations from the mean of the earlier rows of their group, of which there are least or more."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = events.withColumn("_n", F.count(value).over(w)).withColumn("mean", F.avg(value).over(w)).withColumn("sd", F.stddev_samp(value).over(w))
    return seen.filter((F.col("_n") >= least) & (F.col("sd") > 0) & (F.abs(F.col(value) - F.col("mean")) > sigmas * F.col("sd"))).drop("_n")


def event_net(events: DataFrame, adjustments: DataFrame, key: str) -> DataFrame:
    """(key, reexpanded, adjustment, net_tokens, net_micro_usd) of each event (gross_tokens, gross_micro, cost_micro) less its adjustments (tokens, micro)."""
    sums = adjustments.groupBy(key).agg(F.sum("tokens").alias("_t"), F.sum("micro").alias("_m"))
    joined = events.join(sums, key, "left").withColumn("reexpanded", F.coalesce("_t", F.lit(0)).cast("long")).withColumn("adjustment", F.coalesce("_m", F.lit(0)).cast("long"))
    return joined.select(key, "reexpanded", "adjustment", (F.col("gross_tokens") - F.col("reexpanded")).alias("net_tokens"), (F.col("gross_micro") - F.col("cost_micro") - F.col("adjustment")).alias("net_micro_usd"))


def savings_by_confidence(rows: DataFrame, tiers: tuple[str, ...]) -> DataFrame:
    """records, gross, retrieved (each 0 at least) and net by tier; each of the tiers has a row."""
    sums = rows.groupBy("tier").agg(F.count(F.lit(1)).alias("records"), F.sum("gross").alias("gross"), F.sum(F.greatest(F.col("retrieved"), F.lit(0))).alias("retrieved"))
    listed = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, tiers))).alias("tier"))
    full = listed.join(sums, "tier", "left").select("tier", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("records", "gross", "retrieved")))
    return full.withColumn("net", F.col("gross") - F.col("retrieved"))


def decision_summary(rows: DataFrame) -> DataFrame:
    """units, token sums, lossy units and whether none is lossy, by decision."""
    sums = rows.groupBy("decision").agg(F.count(F.lit(1)).alias("units"), F.sum("before").cast("long").alias("tokens_before"), F.sum("after").cast("long").alias("tokens_after"), F.count_if("lossy").alias("lossy_units"))
    return sums.withColumn("tokens_saved", F.col("tokens_before") - F.col("tokens_after")).withColumn("fully_recoverable", F.col("lossy_units") == 0)


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (provider, model) with the rate of prices (key, rate) for provider:model, else for provider:*; null without one. Providers are trimmed and in lower case. Keys of prices are unique."""
    provider = F.lower(F.trim("provider"))
    exact = prices.select(F.col("key").alias("_exact"), F.col("rate").alias("_rate"))
    rest = prices.select(F.col("key").alias("_any"), F.col("rate").alias("_else"))
    found = usage.withColumn("_k", F.concat_ws(":", provider, "model")).withColumn("_w", F.concat(provider, F.lit(":*")))
    return found.join(exact, F.col("_k") == F.col("_exact"), "left").join(rest, F.col("_w") == F.col("_any"), "left").select(*usage.columns, F.coalesce("_rate", "_else").alias("rate"))


def compressed_risk(findings: DataFrame, group: str) -> DataFrame:
    """(group, risk): 0 to 10, levelling off with the sum of severity times confidence, times 1.3 for findings that tainted data reaches."""
    weight = F.col("severity") * F.col("confidence") * F.when(F.col("taint"), 1.3).otherwise(1.0)
    return findings.groupBy(group).agg(F.least(F.lit(10.0), 10.0 * (1 - F.exp(-F.sum(weight) / 4.0))).alias("risk"))


def temporal_links(traces: DataFrame, order: str, item: str) -> DataFrame:
    """(source, target, n): how often an item of one trace is followed by another item in the next trace.

    Traces are numbered by their rank among the different orders, which are ordered in buckets.
    Links are dealt to as many tasks as there are links for, so a task's table of them stays small.
    """
    from siltstone.operators.selection import TASK_PAIRS
    from siltstone.operators.statistics import count_below

    once = cut(traces.select(order, item).distinct())
    sizes = cut(count_below(once.groupBy(order).agg(F.count(F.lit(1)).alias("_size")).withColumn("_one", F.lit(1)), order, "_one").select(order, F.col("_below").alias("_k"), "_size"))
    rows = once.join(sizes.drop("_size"), order)
    next_sizes = sizes.select((F.col("_k") - 1).alias("_k"), F.col("_size").alias("_next"))
    many = sizes.join(next_sizes, "_k").agg(F.sum(F.col("_size") * F.col("_next"))).first()[0]
    later = rows.select((F.col("_k") - 1).alias("_k"), F.col(item).alias("target"))
    links = rows.select("_k", F.col(item).alias("source")).join(later, "_k").filter("source <> target")
    return in_tasks(links, many, TASK_PAIRS, "source", "target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def contradictions(beliefs: DataFrame, entity: str, gap: float = 0.4) -> DataFrame:
    """(entity, stale_vs_fresh, confidence_divergence): pairs of an entity's beliefs (status, confidence) of which one is verified and one stale, and pairs whose confidences are over gap apart. Entities without either are left out.

    Pairs are counted, not made: statuses by products of their counts, confidences by a range
    over the entity's ordered values.
    """
    rows = beliefs.withColumn("_v", (F.col("status") == "verified").cast("int")).withColumn("_s", (F.col("status") == "stale").cast("int"))
    mixed = rows.groupBy(entity).agg((F.coalesce(F.sum("_v"), F.lit(0)) * F.coalesce(F.sum("_s"), F.lit(0))).alias("stale_vs_fresh"))
    ties = beliefs.filter(F.col("confidence").isNotNull()).groupBy(entity, "confidence").agg(F.count(F.lit(1)).alias("_n"))
    near = F.sum("_n").over(Window.partitionBy(entity).orderBy("confidence").rangeBetween(-gap, 0))
    upto = F.sum("_n").over(Window.partitionBy(entity).orderBy("confidence").rangeBetween(Window.unboundedPreceding, 0))
    apart = ties.withColumn("_far", (upto - near) * F.col("_n")).groupBy(entity).agg(F.sum("_far").alias("confidence_divergence"))
    both = mixed.join(apart, entity, "left").withColumn("confidence_divergence", F.coalesce("confidence_divergence", F.lit(0)))
    return both.filter(F.col("stale_vs_fresh") + F.col("confidence_divergence") > 0)


def forward_share(blocks: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """(group, order, overlap): the share of a block's word pairs that a later block of its group has; 0.5 where no later block has any pair."""
    from siltstone.functions.signals import hashed, ngrams

    pairs = blocks.select(group, order, hashed(ngrams(F.col(text), 2)).alias("_g"))
    last = pairs.filter(F.size("_g") > 0).groupBy(group).agg(F.max(order).alias("_last"))
    each = pairs.select(group, order, F.explode("_g").alias("_x")).groupBy(group, order, "_x").agg(F.count(F.lit(1)).alias("_n"))
    seen = each.withColumn("_later", F.max(order).over(Window.partitionBy(group, "_x")) > F.col(order))
    share = seen.groupBy(group, order).agg((F.sum(F.when(F.col("_later"), F.col("_n")).otherwise(0)) / F.sum("_n")).alias("_share"))
    joined = pairs.join(last, group, "left").join(share, [group, order], "left")
    none_later = F.col("_last").isNull() | (F.col("_last") <= F.col(order))
    return joined.select(group, order, F.when(none_later, 0.5).otherwise(F.coalesce("_share", F.lit(0.0))).alias("overlap"))


def block_dependencies(blocks: DataFrame, group: str, order: str, kind: str) -> DataFrame:
    """blocks with depends_on: the last user block before a tool call or thinking, the last call before a result, the last result and user block before an assistant's."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda k: F.max(F.when(F.col(kind) == k, F.col(order))).over(w)
    user, call, result = last("UserMessage"), last("ToolCall"), last("ToolResult")
    found = F.when(F.col(kind).isin("ToolCall", "ThinkingBlock"), F.array(user)).when(F.col(kind) == "ToolResult", F.array(call)).when(F.col(kind) == "AssistantMessage", F.array(result, user)).otherwise(F.array(F.lit(None)))
    return blocks.withColumn("depends_on", F.array_compact(found))


def verified_chains(records: DataFrame, chain: str, order: str, digest: str, previous: str) -> DataFrame:
    """(chain, records, first_break): the first record of each chain whose previous digest isn't that of the record before it (empty for the first); null for intact chains."""
    want = F.coalesce(F.lag(digest).over(Window.partitionBy(chain).orderBy(order)), F.lit(""))
    checked = records.withColumn("_ok", F.col(previous).eqNullSafe(want))
    return checked.groupBy(chain).agg(F.count(F.lit(1)).alias("records"), F.min(F.when(~F.col("_ok"), F.col(order))).alias("first_break"))


def rolling_values(events: DataFrame, ts: str, value: str, days: tuple[int, ...] = (1, 7, 30, 60, 90)) -> DataFrame:
    """One row: sums of the last days up to the newest one, and of all. Days are summed first."""
    daily = events.groupBy(F.to_date(ts).alias("_d")).agg(F.sum(value).alias("_v"))
    last = daily.agg(F.max("_d").alias("_t"))
    return daily.crossJoin(F.broadcast(last)).agg(*(F.sum(F.when(F.col("_d") > F.date_sub("_t", n), F.col("_v")).otherwise(0.0)).alias(f"d{n}") for n in days), F.sum("_v").alias("lifetime"))
