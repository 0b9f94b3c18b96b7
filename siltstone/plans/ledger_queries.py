"""Queries of ledgers, joins and evaluation statistics, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import signals
from siltstone.operators import evaluation, ledger, statistics
from siltstone.plans.registry import register, table


@register("""
WITH d AS (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS q, sum(l_linenumber) AS c FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey, CAST(coalesce(q, 0) AS BIGINT) AS reexpanded, CAST(coalesce(c, 0) AS BIGINT) AS adjustment, CAST(100 - coalesce(q, 0) AS BIGINT) AS net_tokens, CAST(90 - coalesce(c, 0) AS BIGINT) AS net_micro_usd FROM orders LEFT JOIN d ON o_orderkey = l_orderkey
""")
def j9_event_net(spark, sf_dir):
    events = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(100).alias("gross_tokens"), F.lit(95).alias("gross_micro"), F.lit(5).alias("cost_micro"))
    back = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("long").alias("tokens"), F.col("l_linenumber").alias("micro"))
    return ledger.event_net(events, back, "o_orderkey")


_OUTCOME_SQL = """o AS (SELECT user_id, event_id, CASE event_id % 4 WHEN 0 THEN 'strong' WHEN 1 THEN 'medium' ELSE 'weak' END AS strength, CASE WHEN event_id % 6 = 0 THEN 'ci_result' ELSE 'test' END AS kind,
  CASE WHEN event_id % 10 = 0 THEN '' WHEN value > 50 THEN 'success' ELSE 'failure' END AS v FROM events WHERE event_type <> 'click'),
g AS (SELECT user_id, max_by(nullif(v, ''), event_id) FILTER (strength = 'strong' AND v <> '') AS s0, max_by(v, event_id) FILTER (strength = 'strong') AS s, count_if(strength = 'strong') AS ns, max_by(v, event_id) FILTER (strength = 'medium') AS m,
  max_by(v, event_id) FILTER (strength = 'weak') AS w, max_by(v, event_id) FILTER (kind = 'ci_result') AS c FROM o GROUP BY 1)"""


@register(f"""
WITH {_OUTCOME_SQL}, u AS (SELECT DISTINCT user_id FROM events)
SELECT user_id, coalesce(CASE WHEN ns > 0 THEN nullif(s, '') ELSE nullif(m, '') END, 'unknown') AS "default", coalesce(nullif(s, ''), 'unknown') AS strict, coalesce(nullif(s, ''), nullif(m, ''), nullif(w, ''), 'unknown') AS legacy,
  coalesce(nullif(c, ''), 'unknown') AS ci_only, CASE WHEN user_id % 2 = 0 THEN coalesce(nullif(s, ''), 'unknown') ELSE 'unknown' END AS code_change FROM u LEFT JOIN g USING (user_id)
""")
def v12_labels(spark, sf_dir):
    """V12 by all five rules; J10's join of traces and outcomes."""
    e = table(spark, sf_dir, "events")
    traces = e.select("user_id").distinct()
    value = F.when(F.col("event_id") % 10 == 0, "").when(F.col("value") > 50, "success").otherwise("failure")
    outcomes = e.filter("event_type <> 'click'").select("user_id", "event_id", F.when(F.col("event_id") % 4 == 0, "strong").when(F.col("event_id") % 4 == 1, "medium").otherwise("weak").alias("strength"), F.when(F.col("event_id") % 6 == 0, "ci_result").otherwise("test").alias("event_type"), value.alias("value"))
    out = traces
    for rule in ("default", "strict", "legacy", "ci_only", "code_change"):
        found = evaluation.derived_labels(traces, outcomes, "user_id", "event_id", rule, F.col("user_id") % 2 == 0)
        out = out.join(found.withColumnRenamed("label", rule), "user_id")
    return out


@register("""
WITH c AS (SELECT value AS s, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS y FROM events WHERE event_type = 'purchase'), t AS (SELECT event_id, value AS s FROM events WHERE event_type = 'error')
SELECT event_id, round((1 + (SELECT count(*) FROM c WHERE y = 1 AND c.s >= t.s)) / ((SELECT count(*) FROM c WHERE y = 1) + 1), 6) AS p_high,
  round((1 + (SELECT count(*) FROM c WHERE y = 0 AND c.s <= t.s)) / ((SELECT count(*) FROM c WHERE y = 0) + 1), 6) AS p_low FROM t
""")
def a30_two_class_p(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cal = e.filter("event_type = 'purchase'").select("value", F.when(F.col("user_id") % 3 == 0, 1).otherwise(0).alias("y"))
    found = evaluation.two_class_p(cal, e.filter("event_type = 'error'").select("event_id", "value"), "value", "y")
    return found.select("event_id", F.round("p_high", 6).alias("p_high"), F.round("p_low", 6).alias("p_low"))


_JUDGED_SQL = "SELECT event_id, round(value) AS s, CASE WHEN value + event_id % 40 > 70 THEN 1 ELSE 0 END AS y, CASE WHEN value + event_id % 40 + event_id % 7 > 72 THEN 1 ELSE 0 END AS x FROM events"


def _judged(spark, sf_dir):
    v, k = F.col("value"), F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.round("value").alias("s"), F.when(v + k % 40 > 70, 1).otherwise(0).alias("y"), F.when(v + k % 40 + k % 7 > 72, 1).otherwise(0).alias("x"))


@register(f"""
WITH r AS ({_JUDGED_SQL}), t AS (SELECT s, count(*) AS n, sum(y) AS p FROM r GROUP BY s),
c AS (SELECT s, sum(p) OVER (ORDER BY s) / sum(n) OVER (ORDER BY s) AS lo, 1 - sum(p) OVER (ORDER BY s DESC) / sum(n) OVER (ORDER BY s DESC) AS hi FROM t),
e AS (SELECT (SELECT min(s) FROM c WHERE lo > 0.1) AS f, (SELECT max(s) FROM c WHERE hi > 0.1) AS l),
b AS (SELECT coalesce((SELECT max(s) FROM c, e WHERE f IS NULL OR s < f), '-inf'::DOUBLE) AS lo, coalesce((SELECT min(s) FROM c, e WHERE l IS NULL OR s > l), 'inf'::DOUBLE) AS hi, (SELECT max(s) FROM c) AS top, (SELECT min(s) FROM c) AS low)
SELECT CASE WHEN lo >= hi THEN 0.5::DOUBLE * (least(lo, top) + greatest(hi, low)) ELSE lo END AS t_lo, CASE WHEN lo >= hi THEN 0.5::DOUBLE * (least(lo, top) + greatest(hi, low)) ELSE hi END AS t_hi FROM b
""")
def a31_select_band(spark, sf_dir):
    return evaluation.select_band(_judged(spark, sf_dir), "s", "y", 0.1, 1.0, 2.0)


@register(f"""
WITH r AS ({_JUDGED_SQL}), a AS (SELECT CASE WHEN s <= 30 THEN 'a' WHEN s >= 80 THEN 'f' ELSE 'e' END AS a, CASE WHEN s <= 30 THEN y <> 0 WHEN s >= 80 THEN y <> 1 ELSE x <> y END AS w FROM r)
SELECT count(*) AS n, count_if(a = 'a')::BIGINT AS n_accept, count_if(a = 'f')::BIGINT AS n_flag, count_if(a = 'e')::BIGINT AS n_escalate, round(count_if(a = 'e') / count(*), 6) AS escalation_rate,
  round(count_if(a <> 'e' AND w) / count_if(a <> 'e'), 6) AS selective_risk, round(count_if(w) / count(*), 6) AS overall_error, round(0.01 + count_if(a = 'e') / count(*), 6) AS expected_cost FROM a
""")
def a32_cascade_outcome(spark, sf_dir):
    out = evaluation.cascade_outcome(_judged(spark, sf_dir), "s", "y", "x", 30.0, 80.0, 0.01, 1.0)
    return out.select("n", "n_accept", "n_flag", "n_escalate", *(F.round(c, 6).alias(c) for c in ("escalation_rate", "selective_risk", "overall_error", "expected_cost")))


@register("""
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders), g AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT g.o_custkey, count_if(k <= 1) / count(*) AS recall_1, count_if(k <= 5) / count(*) AS recall_5, count_if(k <= 10) / count(*) AS recall_10 FROM g JOIN r USING (o_custkey, o_orderkey) GROUP BY 1
""")
def v4_recall(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return evaluation.recall_at(orders.withColumn("k", rank), orders.filter("o_orderpriority = '1-URGENT'"), "o_custkey", "o_orderkey", "k")


@register("""
SELECT event_type AS policy, round(count_if(event_id % 5 <> 0 AND value > 40) / count(*), 4) AS agree_rate, round(count_if(event_id % 5 = 0) / count(*), 4) AS abstain_rate, count(*) AS n FROM events GROUP BY 1
""")
def v13_shadow_agreement(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "policy")
    return evaluation.shadow_agreement(e, "policy", F.col("event_id") % 5 == 0, F.col("value") > 40)


@register("""
WITH g AS (SELECT user_id, count(*) AS total_requests, avg(CASE WHEN props IS NOT NULL THEN 1.0 ELSE 0 END) AS e, avg(CASE WHEN value > 30 THEN 1.0 ELSE 0 END) AS s FROM events GROUP BY 1),
f AS (SELECT *, list_filter([CASE WHEN total_requests < 50 THEN 'sample_size' END, CASE WHEN e < 0.4 THEN 'decomp_rate' END, CASE WHEN s < 0.7 THEN 'success_rate' END], lambda x: x IS NOT NULL) AS f FROM g)
SELECT user_id, len(f) = 0 AS passed, CASE WHEN len(f) = 0 THEN 'all gates passed' ELSE 'failed: ' || array_to_string(f, ', ') END AS reason FROM f
""")
def v15_release_gate(spark, sf_dir):
    rate = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    report = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total_requests"), rate(F.col("props").isNotNull()).alias("evidence_rate"), rate(F.col("value") > 30).alias("success_rate"))
    return evaluation.release_gate(report).select("user_id", "passed", "reason")


@register("""
WITH g AS (SELECT user_id % 40 AS g, count_if(value > 90)::BIGINT AS a, count_if(value < 10)::BIGINT AS b FROM events GROUP BY 1), t AS (SELECT g, a, b, unnest(range(0, least(a, b) + 1)) AS k FROM g)
SELECT g AS arm, any_value(a)::BIGINT AS left_only, any_value(b)::BIGINT AS right_only, round(CASE WHEN any_value(a + b) = 0 THEN 1 ELSE least(1, 2 * sum(exp(lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) - (a + b) * ln(2)))) END, 6) AS p FROM t GROUP BY g
""")
def v1_mcnemar(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 40).alias("arm")).agg(F.count_if(F.col("value") > 90).alias("left_only"), F.count_if(F.col("value") < 10).alias("right_only"))
    return g.withColumn("p", F.round(signals.mcnemar(F.col("left_only"), F.col("right_only")), 6))


@register("""
WITH w AS (SELECT conv_id, replace(text, chr(10), ' ') AS t FROM conversations WHERE text <> ''), p AS (SELECT concat(chr(2), chr(2), t, chr(3)) AS p FROM w),
g AS (SELECT p, unnest(range(3, length(p) + 1)) AS i FROM p)
SELECT CAST(k AS INTEGER) AS size, substr(p, i - k + 1, k - 1) AS context, substr(p, i, 1) AS char, count(*) AS n FROM g, (SELECT unnest([1, 2, 3]) AS k) GROUP BY ALL
""")
def a49_gram_counts(spark, sf_dir):
    texts = table(spark, sf_dir, "conversations").select(F.replace("text", F.lit("\n"), F.lit(" ")).alias("t"))
    return evaluation.gram_counts(texts, "t", 3)


@register("""
WITH a AS (SELECT l_suppkey, l_orderkey AS t, l_partkey AS i FROM lineitem)
SELECT least(x.i, y.i) AS a, greatest(x.i, y.i) AS b, count(*) AS n FROM a x JOIN a y ON x.l_suppkey = y.l_suppkey AND y.t - x.t BETWEEN 0 AND 10 AND x.i <> y.i AND (x.t < y.t OR x.i < y.i) GROUP BY ALL
""")
def v19_co_access(spark, sf_dir):
    return evaluation.co_access(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_orderkey", "l_partkey", 10)


@register("""
WITH r AS (SELECT event_id, user_id, event_type, CAST(floor(value / 25) AS BIGINT) AS s, event_id % 2 AS o FROM events)
SELECT event_id, coalesce(s = lag(s) OVER w AND o = lag(o) OVER w, false) AS exact_repeat FROM r WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)
""")
def v20_repeated_deliveries(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.floor(F.col("value") / 25).alias("s"), (F.col("event_id") % 2).alias("o"))
    return evaluation.repeated_deliveries(rows, "user_id", ["event_type"], "event_id", ["s", "o"]).select("event_id", "exact_repeat")


@register("""
SELECT k.tier, count(o_orderkey) AS records, CAST(coalesce(sum(o_custkey), 0) AS BIGINT) AS gross, CAST(coalesce(sum(greatest(0, o_orderkey % 50 - 10)), 0) AS BIGINT) AS retrieved, CAST(coalesce(sum(o_custkey), 0) - coalesce(sum(greatest(0, o_orderkey % 50 - 10)), 0) AS BIGINT) AS net
FROM (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '9-NONE']) AS tier) k LEFT JOIN orders ON o_orderpriority = tier GROUP BY 1
""")
def v23_savings_by_confidence(spark, sf_dir):
    """All tiers are listed; negative retrievals count 0."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("tier"), F.col("o_custkey").alias("gross"), (F.col("o_orderkey") % 50 - 10).alias("retrieved"))
    return ledger.savings_by_confidence(rows, ("1-URGENT", "2-HIGH", "3-MEDIUM", "9-NONE"))


@register("""
SELECT o_orderstatus AS decision, count(*) AS units, CAST(sum(o_custkey) AS BIGINT) AS tokens_before, CAST(sum(o_custkey % 100) AS BIGINT) AS tokens_after, CAST(sum(o_custkey - o_custkey % 100) AS BIGINT) AS tokens_saved,
  count_if(o_orderkey % 97 = 0)::BIGINT AS lossy_units, count_if(o_orderkey % 97 = 0) = 0 AS fully_recoverable FROM orders GROUP BY 1
""")
def v24_decisions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("decision"), F.col("o_custkey").alias("before"), (F.col("o_custkey") % 100).alias("after"), (F.col("o_orderkey") % 97 == 0).alias("lossy"))
    return ledger.decision_summary(rows)


@register("""
WITH g AS (SELECT user_id, count(*) AS s, count(DISTINCT event_type) * 5 AS a, count(DISTINCT CAST(value / 10 AS BIGINT)) AS b, count_if(value > 60) AS m0 FROM events GROUP BY 1), n AS (SELECT *, least(m0, a, b) AS m FROM g),
e AS (SELECT *, CASE WHEN m > 0 THEN (a + 1.0) * (b + 1.0) / (m + 1.0) - 1 ELSE a + b END AS t,
  CASE WHEN m > 0 THEN 1 / (1 + sqrt((a + 1.0::DOUBLE) * (b + 1) * (a - m) * (b - m) / ((m + 1.0::DOUBLE) ** 2 * (m + 2)))) ELSE 0.2 END AS c FROM n)
SELECT user_id, round(least(1, s / t), 6) AS coverage, round(greatest(0, t - s), 6)::DOUBLE AS gap, round(c, 6)::DOUBLE AS confidence, CASE WHEN least(1, s / t) * c >= 0.75 THEN 'low' WHEN least(1, s / t) * c >= 0.45 THEN 'medium' ELSE 'high' END AS risk FROM e
""")
def v42_capture_estimate(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("s"), (F.countDistinct("event_type") * 5).alias("a"), F.countDistinct(F.rint(F.col("value") / 10).cast("long")).alias("b"), F.count_if(F.col("value") > 60).alias("m"))
    coverage, gap, confidence, risk = signals.capture_estimate(F.col("s"), F.col("a"), F.col("b"), F.least("m", "a", "b"))
    return g.select("user_id", F.round(coverage, 6).alias("coverage"), F.round(gap, 6).alias("gap"), F.round(confidence, 6).alias("confidence"), risk.alias("risk"))


@register("""
WITH p AS (SELECT * FROM (VALUES ('a:click', 1.5), ('a:*', 0.25), ('b:view', 3.125)) v(k, rate)), u AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN ' B ' ELSE 'A' END AS provider, event_type AS model, event_id % 1000 AS tokens FROM events)
SELECT event_id, CAST(round(tokens * coalesce(x.rate, y.rate)) AS BIGINT) AS cost FROM u LEFT JOIN p x ON x.k = concat(lower(trim(provider)), ':', model) LEFT JOIN p y ON y.k = concat(lower(trim(provider)), ':*')
""")
def j30_priced_usage(spark, sf_dir):
    """J30 and Y4."""
    prices = spark.createDataFrame([("a:click", 1.5), ("a:*", 0.25), ("b:view", 3.125)], "key string, rate double")
    usage = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 3 == 0, " B ").otherwise("A").alias("provider"), F.col("event_type").alias("model"), (F.col("event_id") % 1000).alias("tokens"))
    return ledger.priced(usage, prices).select("event_id", signals.micro_cost(F.col("tokens"), F.col("rate")).alias("cost"))


@register("""
WITH p AS (SELECT event_id, event_id % 25 AS a FROM events)
SELECT event_id, round(least(3600.0, 2.0 * 2 ** least(greatest(a - 1, 0), 20)) * (0.85 + 0.30 * (('0x' || substr(sha256(concat(event_id, ':', a)), 1, 8))::BIGINT / 4294967295)), 6) AS delay FROM p
""")
def y6_retry_delay(spark, sf_dir):
    delay = signals.retry_delay(F.col("event_id"), F.col("event_id") % 25, 2.0, 3600.0)
    return table(spark, sf_dir, "events").select("event_id", F.round(delay, 6).alias("delay"))


@register("""
SELECT o_custkey, round(10.0 * (1 - exp(-sum(CASE o_orderstatus WHEN 'F' THEN 9.5 WHEN 'O' THEN 4.0 ELSE 1.0 END * (o_orderkey % 10) / 10.0 * CASE WHEN o_orderpriority = '1-URGENT' THEN 1.3 ELSE 1.0 END) / 4)), 6) AS risk FROM orders GROUP BY 1
""")
def a14_risk(spark, sf_dir):
    weight = F.when(F.col("o_orderstatus") == "F", 9.5).when(F.col("o_orderstatus") == "O", 4.0).otherwise(1.0)
    found = table(spark, sf_dir, "orders").select("o_custkey", weight.alias("severity"), (F.col("o_orderkey") % 10 / 10).alias("confidence"), (F.col("o_orderpriority") == "1-URGENT").alias("taint"))
    return ledger.compressed_risk(found, "o_custkey").withColumn("risk", F.round("risk", 6))


@register("""
SELECT o_orderpriority AS label, count(*) AS n, round(least(1, greatest(0, 1 - avg(o_totalprice / 600000))), 6) AS summary FROM orders GROUP BY 1
""")
def a24_label_summary(spark, sf_dir):
    """Rows by label and 1 less their mean risk."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.avg(F.col("o_totalprice") / 600000))), 6).alias("summary"))


@register("""
SELECT event_type, round(quantile_cont(value / 100, 0.9), 6) AS q90, 0.0::DOUBLE AS q0, 1.0::DOUBLE AS q1 FROM events GROUP BY 1
""")
def a28_quantiles(spark, sf_dir):
    """0 for levels of 0 or less, 1 for those of 1 or more."""
    scaled = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 100).alias("v"))
    found = statistics.unit_quantiles(scaled, "event_type", "v", {"q90": 0.9, "q0": 0.0, "q1": 1.0})
    return found.select("event_type", *(F.round(name, 6).alias(name) for name in ("q90", "q0", "q1")))


@register("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) AS p95 FROM r WHERE i = round(0.95 * (n - 1)) GROUP BY 1
""")
def a43_tail_percentile(spark, sf_dir):
    return statistics.nearest_percentile(table(spark, sf_dir, "events"), "event_type", "value", 95.0).withColumnRenamed("percentile", "p95")


@register("""
WITH c AS (SELECT p_brand, greatest(p_retailprice - 905, 0) AS u, p_size > 25 AS s FROM part) SELECT p_brand, round(CASE WHEN sum(u) <= 1e-12 THEN 0 ELSE sum(CASE WHEN s THEN u ELSE 0 END) / (sum(u) + 1e-12) END, 6) AS mass FROM c GROUP BY 1
""")
def a54_captured_mass(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", (F.col("p_retailprice") - 905).alias("utility"), (F.col("p_size") > 25).alias("selected"))
    return statistics.captured_mass(rows, "p_brand").withColumn("mass", F.round("mass", 6))


@register("""
WITH t AS (SELECT l_orderkey AS q, l_partkey AS i FROM lineitem GROUP BY ALL), k AS (SELECT q, dense_rank() OVER (ORDER BY q) AS r FROM (SELECT DISTINCT q FROM t))
SELECT x.i AS source, y.i AS target, count(*) AS n FROM t x JOIN k a ON x.q = a.q JOIN k b ON b.r = a.r + 1 JOIN t y ON y.q = b.q WHERE x.i <> y.i GROUP BY ALL
""")
def a41_temporal_links(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return ledger.temporal_links(keys, "l_orderkey", "l_partkey")


@register("""
SELECT x.o_custkey, count_if((x.o_orderstatus = 'O' AND y.o_orderstatus = 'F') OR (x.o_orderstatus = 'F' AND y.o_orderstatus = 'O'))::BIGINT AS stale_vs_fresh, count_if(abs(x.o_totalprice - y.o_totalprice) > 100000)::BIGINT AS confidence_divergence
FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey GROUP BY 1
HAVING count_if((x.o_orderstatus = 'O' AND y.o_orderstatus = 'F') OR (x.o_orderstatus = 'F' AND y.o_orderstatus = 'O')) + count_if(abs(x.o_totalprice - y.o_totalprice) > 100000) > 0
""")
def j15_contradictions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "O", "verified").when(F.col("o_orderstatus") == "F", "stale").alias("status"), F.col("o_totalprice").alias("confidence"))
    return ledger.contradictions(rows, "o_custkey", gap=100000)


@register("""
WITH t AS (SELECT event_id, user_id, event_id - coalesce(max(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), event_id) AS age, value / 100 AS risk FROM events)
SELECT event_id, round(exp(-ln(2) / 20 * age), 6) AS recency, round(CASE WHEN age > 0 THEN least(1, risk * 0.5 ** (age / 7)) ELSE risk END, 6) AS risk FROM t
""")
def w7_decays(spark, sf_dir):
    """W7 and W17."""
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    t = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") - F.coalesce(before, F.col("event_id"))).alias("age"), (F.col("value") / 100).alias("risk"))
    return t.select("event_id", F.round(signals.half_life_decay(F.col("age"), F.lit(20)), 6).alias("recency"), F.round(signals.decayed_risk(F.col("risk"), F.col("age"), 7.0), 6).alias("risk"))


@register("""
WITH b AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM conversations), g AS (SELECT conv_id, turn, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])) AS g FROM b),
e AS (SELECT conv_id, turn, unnest(g) AS x FROM g), l AS (SELECT conv_id, x, max(turn) AS t FROM e GROUP BY ALL), f AS (SELECT conv_id, max(turn) AS t FROM g WHERE len(g) > 0 GROUP BY 1),
s AS (SELECT e.conv_id, turn, count_if(l.t > turn) / count(*) AS share FROM e JOIN l USING (conv_id, x) GROUP BY ALL)
SELECT g.conv_id, g.turn, round(CASE WHEN f.t IS NULL OR f.t <= g.turn THEN 0.5 ELSE coalesce(share, 0) END, 6) AS overlap FROM g LEFT JOIN f USING (conv_id) LEFT JOIN s ON s.conv_id = g.conv_id AND s.turn = g.turn
""")
def w3_forward_overlap(spark, sf_dir):
    return ledger.forward_share(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").withColumn("overlap", F.round("overlap", 6))


@register("""
WITH b AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'UserMessage' WHEN 1 THEN 'ToolCall' WHEN 2 THEN 'ToolResult' WHEN 3 THEN 'ThinkingBlock' ELSE 'AssistantMessage' END AS kind FROM conversations),
l AS (SELECT *, max(CASE WHEN kind = 'UserMessage' THEN turn END) OVER w AS u, max(CASE WHEN kind = 'ToolCall' THEN turn END) OVER w AS c, max(CASE WHEN kind = 'ToolResult' THEN turn END) OVER w AS r FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, turn, array_to_string(list_filter(CASE kind WHEN 'ToolCall' THEN [u] WHEN 'ToolResult' THEN [c] WHEN 'AssistantMessage' THEN [r, u] WHEN 'ThinkingBlock' THEN [u] ELSE [] END, lambda x: x IS NOT NULL), ',') AS depends_on FROM l
""")
def w4_dependencies(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("UserMessage", "ToolCall", "ToolResult", "ThinkingBlock", "AssistantMessage")))
    b = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.element_at(kinds, (F.col("turn") % 5 + 1).cast("int")).alias("kind"))
    return ledger.block_dependencies(b, "conv_id", "turn", "kind").select("conv_id", "turn", F.array_join(F.col("depends_on").cast("array<string>"), ",").alias("depends_on"))
