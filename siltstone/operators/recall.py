"""Recall of an agent's memories under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import budgets
from siltstone.operators.lineage import cut

# What a memory's tier counts, the agent whose memories all may recall, and what being recalled makes of a salience.
TIERS = {"working": 1.0, "episodic": 1.1, "semantic": 1.25}
SHARED = "shared"
REINFORCED, MOST_SALIENCE = 1.3, 10_000.0


def terms(text: Column) -> Column:
    """Different lower-case names of a text: two or more ASCII letters, digits and underscores that begin with no digit."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z_][A-Za-z0-9_]+"), F.lit(0)), F.lower))


def retention(memory_tier: Column, created: Column, salience: Column, now: Column | float) -> Column:
    """Share of a memory that is left: all of a semantic one, else exp(-age / salience), 0 without salience."""
    age = F.greatest(F.lit(0.0), F.lit(now) - created)
    return F.when(memory_tier == "semantic", 1.0).when(salience <= 0, 0.0).otherwise(F.exp(-age / salience))


def recall(requests: DataFrame, memories: DataFrame, now: float, death: float = 0.2) -> DataFrame:
    """(request, id, score, retention, reason, selected) of each memory that a request may see.

    requests: (request, agent, query, budget, tier or null for all); memories: (id, agent, content,
    source, tags, tier, importance, created, salience, recall_count, tokens). A request sees its
    agent's memories and shared ones. Those that faded below death, but for semantic ones, score
    0. Others score retention, how often they were recalled, how many of the query's terms
    they hold (0.2 for none, 1 for all or without a query), their tier and importance. By score
    a token, then score, then id, each is taken that fits the budget. Null tags are none.
    """
    m = F.col
    asked = requests.select("request", "agent", "tier", "budget", terms(m("query")).alias("_q"))
    # a request is joined by its agent and by the name of the shared one
    seen = asked.select("request", m("tier").alias("_tier"), "_q", F.explode(F.array_distinct(F.array("agent", F.lit(SHARED)))).alias("agent"))
    words = F.array_union(F.array_union(terms(m("content")), terms(F.regexp_replace("source", r"[/\\\\]", " "))), F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower))
    kept = retention(m("tier"), m("created"), m("salience"), now)
    known = memories.select("id", "agent", "tier", "importance", "recall_count", F.greatest(m("tokens"), F.lit(1)).cast("long").alias("tokens"), kept.alias("retention"), words.alias("_words"))
    pairs = known.join(seen, "agent").filter(m("_tier").isNull() | (m("_tier") == m("tier")))
    overlap = F.size(F.array_intersect("_q", "_words")) / F.greatest(F.lit(1), F.size("_q"))
    asks = F.size("_q") > 0
    faded = (m("tier") != "semantic") & (m("retention") < death)
    often = 1 + F.least(F.lit(2.0), F.log1p("recall_count"))
    tier = F.element_at(F.create_map(*(F.lit(x) for kv in TIERS.items() for x in kv)), m("tier"))
    score = m("retention") * often * F.when(asks, 0.2 + 0.8 * overlap).otherwise(1.0) * tier * (0.5 + m("importance"))
    reason = F.when(faded, "below_retention_threshold").when(~asks, "no_query_salience_recall").when(overlap > 0, "query_overlap").otherwise("salience_fallback")
    scored = cut(pairs.select("request", "id", "tokens", F.when(faded, 0.0).otherwise(score).alias("score"), "retention", reason.alias("reason")))
    items = scored.filter("score > 0").select(m("request").alias("group"), m("id").alias("key"), "score", "tokens")
    taken = budgets.fill(items, requests.select(m("request").alias("group"), F.greatest(F.lit(1), m("budget")).alias("budget")), m("score") / m("tokens"), m("score"))
    hit = taken.select(m("group").alias("request"), m("key").alias("id"), F.lit(True).alias("selected"))
    joined = scored.join(hit, ["request", "id"], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
    over = (m("score") > 0) & ~m("selected")
    return joined.select("request", "id", "score", "retention", F.when(over, "over_budget").otherwise(m("reason")).alias("reason"), "selected")


def reinforced(memories: DataFrame, recalled: DataFrame, now: float) -> DataFrame:
    """memories after what recall selected: each time recalled adds one to recall_count and 30 % to salience, at now."""
    times = recalled.filter("selected").groupBy("id").agg(F.count(F.lit(1)).alias("_times"))
    n = F.coalesce("_times", F.lit(0))
    joined = memories.join(times, "id", "left")
    salience = F.when(n > 0, F.least(F.lit(MOST_SALIENCE), F.col("salience") * F.pow(F.lit(REINFORCED), n))).otherwise(F.col("salience"))
    return joined.withColumns({"salience": salience, "recall_count": F.col("recall_count") + n, "last_recalled": F.when(n > 0, F.lit(now))}).drop("_times")
