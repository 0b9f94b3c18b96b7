"""Queries of the engine's operators over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import claims, signals
from siltstone.functions import text as tx
from siltstone.operators import blocks, graph, ledger, ranking, selection, statistics
from siltstone.plans.registry import ORACLE_SQL, QUERIES
from siltstone.plans.registry import register as _register
from siltstone.plans.registry import table as _t
from siltstone.sources import jsonl

#: Terms of the ranking query; frequent words of the tables' invented prose.
QUERY_TERMS = ["the", "thand", "pour", "nicht", "ciónes"]

_WORDS = "list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pN_]+'), lambda w: length(w) >= 2)"


@_register(f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
tf AS (SELECT doc_id, len(w) AS dl, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM d) WHERE term IN ({", ".join(f"'{t}'" for t in QUERY_TERMS)}) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT doc_id AS id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / greatest(avgdl, 1.0)))), 6) AS score
FROM tf JOIN df USING (term), s GROUP BY doc_id ORDER BY score DESC, id LIMIT 10
""")
def k2_bm25_top(spark, sf_dir):
    scored = ranking.bm25(_t(spark, sf_dir, "documents"), QUERY_TERMS).withColumn("score", F.round("score", 6))
    return ranking.top_k(scored, 10)


_STOPS = ", ".join(f"'{w}'" for w in ranking.STOP_WORDS)


def _terms_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[\\pL\\pN_]+'), lambda w: strlen(w) >= 2 AND w NOT IN ({_STOPS}))"


@_register(f"""
WITH q AS (SELECT conv_id, turn, {_terms_sql("text")} AS w FROM conversations WHERE role = 'user'), n AS (SELECT count(*) AS n FROM documents),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_terms_sql("text")}) AS term FROM documents) GROUP BY term),
t AS (SELECT conv_id, turn, term, count(*) / any_value(len(w)) AS tf FROM (SELECT conv_id, turn, w, unnest(w) AS term FROM q) GROUP BY ALL),
s AS (SELECT conv_id, turn, term, round(tf * (ln((n + 1) / (1 + coalesce(df, 0) + 1)) + 1), 6) AS weight FROM t LEFT JOIN df USING (term), n)
SELECT conv_id, turn, term, weight FROM s QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY weight DESC, term) <= 12
""")
def k37_key_terms(spark, sf_dir):
    users = _t(spark, sf_dir, "conversations").filter("role = 'user'").select(F.struct("conv_id", "turn").alias("query_id"), "text")
    found = ranking.key_terms(users, _t(spark, sf_dir, "documents"), "query_id")
    return found.select("query_id.conv_id", "query_id.turn", "term", "weight")


@_register(f"""
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY ALL) GROUP BY term
""")
def a16_document_frequency(spark, sf_dir):
    return ranking.term_counts(_t(spark, sf_dir, "documents"), "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@_register("""
WITH b AS (SELECT doc_id, octet_length(encode(text)) AS n, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents),
c AS (SELECT doc_id, b, count(*) / CAST(any_value(n) AS DOUBLE) AS p FROM b GROUP BY doc_id, b),
e AS (SELECT doc_id, -sum(p * log2(p)) AS h, -log2(sum(p * p)) AS r FROM c GROUP BY doc_id)
SELECT doc_id, round(coalesce(h, 0), 6) AS shannon, round(least(coalesce(h, 0) / 6, 1), 6) AS normalized, round(coalesce(r, 0), 6) AS renyi2,
  round(coalesce(h, 0) - coalesce(r, 0), 6) AS divergence FROM documents LEFT JOIN e USING (doc_id)
""")
def x1_text_entropy(spark, sf_dir):
    e = _t(spark, sf_dir, "documents").select("doc_id", tx.byte_entropies("text").alias("e")).select("doc_id", "e.*")
    return e.select("doc_id", F.round("shannon", 6).alias("shannon"), F.round(F.least(F.col("shannon") / 6, F.lit(1.0)), 6).alias("normalized"), F.round("renyi2", 6).alias("renyi2"), F.round(F.col("shannon") - F.col("renyi2"), 6).alias("divergence"))


@_register("SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
def f2_token_estimate(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@_register("""
WITH p AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS f FROM documents)
SELECT doc_id, CASE WHEN length(f) > 240 THEN substr(f, 1, 237) || '...' ELSE f END AS preview FROM p
""")
def y3_preview(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", tx.preview(F.col("text")).alias("preview"))


@_register("SELECT doc_id, sha256(text) AS fingerprint FROM documents")
def y1_fingerprint(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"))


@_register(r"""
SELECT doc_id, array_to_string(list_filter([
  CASE WHEN contains(text, '@') AND contains(text, '.') THEN 'Email' END,
  CASE WHEN length(regexp_extract(text, '(?s)^.*?(sk-[\\pL\\pN-]*)', 1)) > 20 THEN 'APIKey' END,
  CASE WHEN regexp_matches(regexp_replace(regexp_replace(regexp_replace(text, '[\x{10000}-\x{10FFFF}]', 'xxxx', 'g'), '[\x{0800}-\x{FFFF}]', 'xxx', 'g'), '[\x{0080}-\x{07FF}]', 'xx', 'g'), '(?s)[0-9]..-[0-9].-[0-9]....') THEN 'SSN' END], lambda x: x IS NOT NULL), ',') AS pii,
  regexp_matches(lower(text), 'ignore previous instructions|ignore all previous|system prompt:|you are now|jailbreak|disregard the above|forget your instructions') AS injection
FROM documents
""")
def f13_pii_and_injection(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.concat_ws(",", tx.pii_types(F.col("text"))).alias("pii"), tx.has_injection(F.col("text")).alias("injection"))


def _task_sql() -> str:
    cases = " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(k)}') THEN '{n}'" for n, k, _ in tx.TASK_TYPES)
    factors = " ".join(f"WHEN '{n}' THEN {f}" for n, _, f in tx.TASK_TYPES)
    return f"WITH t AS (SELECT conv_id, turn, CASE {cases} ELSE 'Unknown' END AS task FROM conversations) SELECT conv_id, turn, task, CAST(CASE task {factors} ELSE 1.0 END AS DOUBLE) AS multiplier FROM t"


@_register(_task_sql())
def f7_task_type(spark, sf_dir):
    t = _t(spark, sf_dir, "conversations").select("conv_id", "turn", tx.task_type(F.col("text")).alias("task"))
    return t.withColumn("multiplier", tx.budget_multiplier(F.col("task")))


@_register("""
WITH c AS (SELECT doc_id, len(regexp_extract_all(replace(coalesce(text, ''), '-', ' '), '[A-Za-z0-9][A-Za-z0-9_'']*')) AS n FROM documents)
SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, CAST(i * 328 AS BIGINT) AS token_start, CAST(least(i * 328 + 360, n) AS BIGINT) AS token_end
FROM (SELECT doc_id, n, unnest(range(0, CAST(greatest(0, ceil((n - 360) / 328)) AS BIGINT) + 1)) AS i FROM c WHERE n > 0)
""")
def s7_token_chunks(spark, sf_dir):
    return blocks.token_chunks(_t(spark, sf_dir, "documents"))


@_register("""
WITH l AS (SELECT doc_id, unnest(range(0, len(x))) AS pos, regexp_replace(unnest(x), '^\\s+|\\s+$', '', 'g') AS line
  FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]') AS x FROM documents)),
g AS (SELECT doc_id, line, pos - row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS g FROM l)
SELECT doc_id, line, count(*) AS run FROM g WHERE line <> '' GROUP BY doc_id, line, g.g HAVING count(*) >= 2
""")
def f16_repeated_lines(spark, sf_dir):
    return blocks.repetition_floods(_t(spark, sf_dir, "documents"), 2)


@_register("SELECT sha256(substr(text, 1, 256)) AS prefix_sha256, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def j27_prefix_dedup(spark, sf_dir):
    return blocks.first_by_prefix(_t(spark, sf_dir, "documents"))


@_register(f"""
WITH t AS (SELECT conv_id, turn, list_distinct({_WORDS}) AS t FROM conversations),
n AS (SELECT *, lead(t) OVER (PARTITION BY conv_id ORDER BY turn) AS x FROM t)
SELECT conv_id, turn, round(coalesce(CASE WHEN len(list_distinct(list_concat(t, x))) > 0 THEN len(list_intersect(t, x)) / len(list_distinct(list_concat(t, x))) ELSE 0 END, 0), 6) AS overlap
FROM n
""")
def u2_turn_overlap(spark, sf_dir):
    found = blocks.forward_overlap(_t(spark, sf_dir, "conversations"), "conv_id", "turn", tx.words(F.col("text")))
    return found.withColumn("overlap", F.round("overlap", 6))


@_register("""
WITH d AS (SELECT l_orderkey, sum(l_extendedprice * l_discount) AS d FROM lineitem GROUP BY 1)
SELECT o_orderpriority AS tier, count(*) AS n_events, round(sum(o_totalprice), 2) AS gross, round(sum(coalesce(d, 0)), 2) AS adjusted,
  round(sum(o_totalprice - o_totalprice * 0.01), 2) AS base, round(sum(o_totalprice - o_totalprice * 0.01) - sum(coalesce(d, 0)), 2) AS net FROM orders LEFT JOIN d ON o_orderkey = l_orderkey GROUP BY 1
""")
def a2_savings_by_tier(spark, sf_dir):
    events = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("tier"), "o_totalprice", (F.col("o_totalprice") * 0.01).alias("cost"))
    debits = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_extendedprice") * F.col("l_discount")).alias("debit"))
    out = ledger.savings_by_tier(events, debits, "k", "tier", "o_totalprice", "cost", "debit")
    return out.select("tier", "n_events", *(F.round(c, 2).alias(c) for c in ("gross", "base", "adjusted", "net")))


@_register("""
SELECT count(*) AS requests, coalesce(sum(l_partkey), 0)::BIGINT AS uncached_input_tokens, coalesce(sum(l_suppkey), 0)::BIGINT AS cache_read_tokens,
  coalesce(sum(l_linenumber), 0)::BIGINT AS cache_write_tokens, coalesce(sum(CAST(l_quantity AS BIGINT)), 0)::BIGINT AS output_tokens,
  coalesce(sum(CAST(floor(l_extendedprice) AS BIGINT)), 0)::BIGINT AS cost_micro_usd, coalesce(sum(CAST(floor(l_tax * 100) AS BIGINT)), 0)::BIGINT AS cache_savings_micro_usd,
  coalesce(sum(CASE WHEN concat(CASE WHEN l_returnflag = 'R' THEN 'unpriced:' ELSE 'list:' END, l_linestatus) LIKE 'unpriced:%' THEN 1 ELSE 0 END), 0)::BIGINT AS unpriced_requests,
  round(coalesce(sum(l_suppkey), 0) / greatest(1, coalesce(sum(l_suppkey), 0) + coalesce(sum(l_partkey), 0)), 9) AS cache_hit_token_ratio
FROM lineitem WHERE l_linestatus = 'O'
""")
def a1_usage_totals(spark, sf_dir):
    """Lines as requests, keys as token counts."""
    source = F.concat(F.when(F.col("l_returnflag") == "R", "unpriced:").otherwise("list:"), F.col("l_linestatus"))
    events = _t(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("uncached_input_tokens"), F.col("l_suppkey").alias("cache_read_tokens"), F.col("l_linenumber").alias("cache_write_tokens"), F.col("l_quantity").cast("long").alias("output_tokens"),
        F.floor("l_extendedprice").alias("cost_micro_usd"), F.floor(F.col("l_tax") * 100).alias("cache_savings_micro_usd"), source.alias("pricing_source"), F.col("l_linestatus").alias("model"),
    )
    return ledger.usage_totals(events, {"model": "O"}).withColumn("cache_hit_token_ratio", F.round("cache_hit_token_ratio", 9))


@_register("""
WITH d AS (SELECT CAST(ts AS DATE) AS d, value FROM events),
k AS (SELECT 'day' AS period, strftime(d, '%Y-%m-%d') AS key, value FROM d UNION ALL SELECT 'week', strftime(d, '%G-W%V'), value FROM d UNION ALL SELECT 'month', strftime(d, '%Y-%m'), value FROM d)
SELECT period, key, count(*) AS n, round(sum(value), 4) AS total FROM k GROUP BY ALL
""")
def a7_value_rollups(spark, sf_dir):
    return ledger.rollup(_t(spark, sf_dir, "events"), "ts", "value").withColumn("total", F.round("total", 4))


@_register("""
WITH m AS (SELECT p_brand, median(p_retailprice) AS med, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 5),
d AS (SELECT p_brand, median(abs(p_retailprice - med)) AS mad FROM part JOIN m USING (p_brand) GROUP BY 1 HAVING median(abs(p_retailprice - med)) >= 1e-9)
SELECT p_partkey, p_brand, round(0.6745 * (p_retailprice - med) / mad, 6) AS z FROM part JOIN m USING (p_brand) JOIN d USING (p_brand)
WHERE abs(0.6745 * (p_retailprice - med) / mad) >= 1.2
""")
def a9_robust_anomalies(spark, sf_dir):
    found = statistics.robust_anomalies(_t(spark, sf_dir, "part"), "p_brand", "p_retailprice", z=1.2)
    return found.select("p_partkey", "p_brand", F.round("z", 6).alias("z"))


@_register("""
WITH r AS (SELECT quality, n_chars AS s FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL),
t AS (SELECT s, count(*) AS n, sum(quality) AS p FROM r GROUP BY s),
k AS (SELECT n, p, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rk FROM t)
SELECT round((sum(rk * p) - sum(p) * (sum(p) + 1) / 2) / (sum(p) * sum(n - p)), 6) AS auroc FROM k
""")
def a26_auroc(spark, sf_dir):
    rows = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return statistics.auroc(rows, "n_chars", "quality").select(F.round("auroc", 6).alias("auroc"))


@_register("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(avg(value), 6) AS trimmed_mean FROM r WHERE n < 3 OR (r > greatest(1, floor(n * 0.1)) AND r <= n - greatest(1, floor(n * 0.1))) GROUP BY 1
""")
def a33_trimmed_mean(spark, sf_dir):
    return statistics.trimmed_mean(_t(spark, sf_dir, "events"), "event_type", "value").withColumn("trimmed_mean", F.round("trimmed_mean", 6))


@_register("""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, round(max(CASE WHEN r = greatest(1, least(ceil((n + 1) * (1::DOUBLE - 0.1::DOUBLE)), n)) THEN value END), 6) AS quantile FROM r GROUP BY 1
""")
def v10_conformal_quantile(spark, sf_dir):
    return statistics.conformal_quantile(_t(spark, sf_dir, "events"), "user_id", "value", 0.1).withColumn("quantile", F.round("quantile", 6))


@_register("""
WITH g AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS s, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1),
w AS (SELECT *, s / n AS p FROM g)
SELECT user_id, s AS successes, n - s AS failures, round(m, 6) AS mean, round(v, 4) AS variance,
  round(0.5 + 1.5 * ((p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((p * (1 - p) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n)), 6) AS learned,
  round((p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt((p * (1 - p) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n), 6) AS upper_bound
FROM w
""")
def a36_learned_value(spark, sf_dir):
    g = statistics.welford(_t(spark, sf_dir, "events"), "user_id", "value", F.col("event_type") == "purchase")
    n = F.col("successes") + F.col("failures")
    return g.select("user_id", "successes", "failures", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), F.round(tx.learned_value(F.col("successes"), n), 6).alias("learned"), F.round(tx.wilson_upper(F.col("successes"), n), 6).alias("upper_bound"))


@_register("SELECT l_returnflag, round(CASE WHEN min(l_extendedprice) <= 0 THEN 0 ELSE exp(avg(ln(CASE WHEN l_extendedprice > 0 THEN l_extendedprice END))) END, 4) AS geometric_mean FROM lineitem GROUP BY 1")
def v7_geometric_mean(spark, sf_dir):
    return statistics.geometric_mean(_t(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice").withColumn("geometric_mean", F.round("geometric_mean", 4))


@_register("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def v6_percentiles(spark, sf_dir):
    found = statistics.quantiles(_t(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})
    return found.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@_register("""
SELECT o_custkey, max(o_orderkey) AS o_orderkey, max_by(o_orderstatus, o_orderkey) AS o_orderstatus
FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30' GROUP BY 1
""")
def j11_as_of(spark, sf_dir):
    found = ledger.as_of(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey", F.lit("1996-06-30").cast("timestamp"))
    return found.select("o_custkey", "o_orderkey", "o_orderstatus")


@_register("""
WITH a AS (SELECT o_custkey, max(o_orderkey) AS q, max_by(o_orderstatus, o_orderkey) AS s FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-30' GROUP BY 1),
b AS (SELECT o_custkey, max(o_orderkey) AS q, max_by(o_orderstatus, o_orderkey) AS s FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30' GROUP BY 1)
SELECT o_custkey, CASE WHEN a.q IS NULL THEN 'added' ELSE 'changed' END AS change, a.q AS from_sequence, b.q AS to_sequence, a.s AS from_value, b.s AS to_value
FROM b LEFT JOIN a USING (o_custkey) WHERE a.q IS DISTINCT FROM b.q
""")
def j12_snapshot_diff(spark, sf_dir):
    """J12 and U6."""
    orders = _t(spark, sf_dir, "orders")
    at = lambda d: ledger.as_of(orders, "o_custkey", "o_orderdate", "o_orderkey", F.lit(d).cast("timestamp"))
    return ledger.snapshot_diff(at("1995-06-30"), at("1996-06-30"), "o_custkey", "o_orderkey", "o_orderstatus")


@_register("""
WITH w AS (SELECT event_id, user_id, value, count(value) OVER p AS n, avg(value) OVER p AS m, stddev_samp(value) OVER p AS sd FROM events
  WINDOW p AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, user_id, round(value, 6) AS value FROM w WHERE n >= 3 AND sd > 0 AND abs(value - m) > 3 * sd
""")
def w8_spikes(spark, sf_dir):
    return ledger.spikes(_t(spark, sf_dir, "events"), "user_id", "event_id", "value").select("event_id", "user_id", F.round("value", 6).alias("value"))


@_register("""
SELECT n_name AS node, CAST(CASE WHEN n_nationkey = 0 THEN 0 WHEN n_nationkey IN (SELECT c.n_nationkey FROM nation a JOIN nation c USING (n_regionkey) WHERE a.n_nationkey = 0) THEN 2 END AS BIGINT) AS depth
FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 0)
UNION ALL SELECT r_name, 1 FROM region WHERE r_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 0)
""")
def i1_bounded_cluster(spark, sf_dir):
    nation, region = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    edges = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"))
    found = graph.reachable(edges, nation.filter("n_nationkey = 0").select(F.col("n_name").alias("node")), 2)
    return found.withColumn("depth", F.col("depth").cast("long"))


def i2_pagerank(spark, sf_dir):
    """Nations link to their regions; regions have no links. No SQL: iterative."""
    nation, region = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    edges = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"))
    nodes = nation.select(F.col("n_name").alias("node")).union(region.select("r_name"))
    return graph.pagerank(edges, nodes, 10).withColumn("rank", F.round("rank", 9))


QUERIES["i2_pagerank"] = i2_pagerank


@_register("""
SELECT p_partkey, round(greatest(0.05, least(1, (1 - (row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1) / count(*) OVER ()) * 0.95 + 0.05)), 6) AS rank_score,
  round(CASE WHEN max(p_retailprice) OVER () - min(p_retailprice) OVER () < 1e-10 THEN 0.5
    ELSE greatest(0.05, least(1, (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) * 0.95 + 0.05)) END, 6) AS scaled
FROM part
""")
def w1_rank_and_scale(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    stats = part.agg(F.count(F.lit(1)).alias("n"), F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    # ranks of a global order: counted by price first, and prices are ordered in buckets
    ties = part.groupBy("p_retailprice").agg(F.count(F.lit(1)).alias("c")).withColumn("_low", -F.col("p_retailprice"))
    before = statistics.count_below(ties, "_low", "c").select("p_retailprice", F.col("_below").alias("before"))
    ranked = part.join(before, "p_retailprice").withColumn("r", F.col("before") + F.row_number().over(Window.partitionBy("p_retailprice").orderBy("p_partkey")) - 1).crossJoin(F.broadcast(stats))
    clamp = lambda c: F.greatest(F.lit(0.05), F.least(F.lit(1.0), c))
    scaled = F.when(F.col("hi") - F.col("lo") < 1e-10, F.lit(0.5)).otherwise(clamp((F.col("p_retailprice") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 0.95 + 0.05))
    return ranked.select("p_partkey", F.round(clamp((1 - F.col("r") / F.col("n")) * 0.95 + 0.05), 6).alias("rank_score"), F.round(scaled, 6).alias("scaled"))


def _any_sql(column: str, needles: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{n}')" for n in needles) + ")"


_NOT_CODE_SQL = signals.NOT_CODE.replace("'", "''")


@_register(f"""
WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)
SELECT doc_id, {_any_sql("t", signals.CREDENTIALS)} OR len(list_filter(string_split(t, chr(10)),
  lambda x: NOT regexp_matches(x, '{_NOT_CODE_SQL}') AND contains(x, '=') AND {_any_sql("x", signals.SECRET_NAMES)})) > 0 AS safety,
  CAST(len(list_filter(string_split(t, chr(10)), lambda x: {_any_sql("x", signals.ANCHORS)})) AS BIGINT) AS anchors FROM t
""")
def f6_safety_and_anchors(spark, sf_dir):
    """F6 and F27."""
    return _t(spark, sf_dir, "documents").select("doc_id", signals.has_safety_signal(F.col("text")).alias("safety"), signals.anchor_lines(F.col("text")).alias("anchors"))


@_register("""
WITH b AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'SystemMessage' WHEN 'user' THEN 'UserMessage' WHEN 'tool' THEN 'ToolResult' WHEN 'function' THEN 'ToolResult'
    ELSE CASE WHEN role = 'assistant' AND regexp_matches(text, '^\\s*<(thinking|reasoning)>') THEN 'ThinkingBlock' ELSE 'AssistantMessage' END END AS kind,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn, kind, p >= n - 2 AS protected, round(CASE WHEN n <= 1 THEN 1.0 ELSE 0.4 * exp(-p / greatest(0.15 * n, 1.0)) + 0.4 * exp(-(n - p - 1) / greatest(0.15 * n, 1.0)) + 0.2 END, 6) AS attention FROM b
""")
def w16_blocks_and_attention(spark, sf_dir):
    """F12, W5 and W16."""
    w = Window.partitionBy("conv_id")
    t = _t(spark, sf_dir, "conversations").withColumn("p", F.row_number().over(w.orderBy("turn")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return t.select("conv_id", "turn", signals.block_kind(F.col("role"), F.col("text")).alias("kind"), (F.col("p") >= F.col("n") - 2).alias("protected"), F.round(signals.attention_weight(F.col("p"), F.col("n")), 6).alias("attention"))


@_register("SELECT doc_id, round(0.3 + 0.7 / (1 + exp(-ln(greatest(1, length(text) // 4) / 80))), 6) AS mass FROM documents")
def x31_mass_factor(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.round(signals.mass_factor(tx.token_estimate(F.col("text"))), 6).alias("mass"))


@_register("""
WITH p AS (SELECT p_partkey, p_size * 1000 AS total, p_partkey % 3 AS files, p_retailprice / 2000 AS e FROM part),
a AS (SELECT *, CAST(trunc(least(greatest(total * 0.05, 50), 500)) AS BIGINT) AS l1 FROM p),
b AS (SELECT *, CAST(trunc(CAST(greatest(total - l1, 0) AS DOUBLE) * CAST(CASE WHEN e > 0.7 THEN 0.20 WHEN e < 0.3 THEN 0.35 ELSE 0.25 END AS DOUBLE)) AS BIGINT) AS l2 FROM a)
SELECT p_partkey, CASE WHEN total > 0 AND files > 0 THEN l1 ELSE 0 END AS level1, CASE WHEN total > 0 AND files > 0 THEN l2 ELSE 0 END AS level2,
  CAST(CASE WHEN total > 0 AND files > 0 THEN greatest(total - l1, 0) - l2 ELSE 0 END AS BIGINT) AS level3 FROM b
""")
def k18_budget_split(spark, sf_dir):
    levels = signals.split_budget(F.col("p_size") * 1000, F.col("p_partkey") % 3, F.col("p_retailprice") / 2000)
    return _t(spark, sf_dir, "part").select("p_partkey", *(c.alias(f"level{i}") for i, c in enumerate(levels, 1)))


@_register("SELECT event_id, CAST(bit_count(xor(event_id, user_id)) AS BIGINT) AS distance, round(greatest(cos(bit_count(xor(event_id, user_id)) * pi() / 64), 0), 6) AS cosine FROM events")
def x16_hamming_cosine(spark, sf_dir):
    """X15 and X16 on pairs of integers as fingerprints."""
    d = signals.hamming(F.col("event_id"), F.col("user_id"))
    return _t(spark, sf_dir, "events").select("event_id", d.cast("long").alias("distance"), F.round(signals.simhash_cosine(d), 6).alias("cosine"))


def _grams_sql(n: int) -> str:
    return f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))"


_SPACED = "list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')"


@_register(f"""
WITH t AS (SELECT conv_id, turn, list_distinct({_grams_sql(3)}) AS t FROM (SELECT conv_id, turn, {_SPACED} AS w FROM conversations)),
n AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY conv_id ORDER BY turn), []) AS x FROM t)
SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(t, x))) > 0 THEN len(list_intersect(t, x)) / len(list_distinct(list_concat(t, x))) ELSE 0 END, 6) AS likeness FROM n
""")
def u3_trigram_jaccard(spark, sf_dir):
    t = _t(spark, sf_dir, "conversations").select("conv_id", "turn", signals.hashed(signals.ngrams(F.col("text"), 3)).alias("t"))
    t = t.withColumn("x", F.coalesce(F.lead("t").over(Window.partitionBy("conv_id").orderBy("turn")), F.array().cast("array<long>")))
    return t.select("conv_id", "turn", F.round(tx.term_jaccard(F.col("t"), F.col("x")), 6).alias("likeness"))


@_register(f"""
WITH d AS (SELECT doc_id, list_distinct({_grams_sql(2)}) AS g FROM (SELECT doc_id, {_SPACED} AS w FROM documents)),
o AS (SELECT g, min(doc_id) AS doc_id FROM (SELECT doc_id, unnest(g) AS g FROM d) GROUP BY g HAVING count(*) = 1), a AS (SELECT doc_id, count(*) AS n FROM o GROUP BY 1)
SELECT doc_id, round(CASE WHEN len(g) > 0 THEN 1 - coalesce(n, 0) / len(g) ELSE 0 END, 6) AS redundancy FROM d LEFT JOIN a USING (doc_id)
""")
def u5_ngram_redundancy(spark, sf_dir):
    found = selection.ngram_redundancy(_t(spark, sf_dir, "documents"), "doc_id", claims.tokens(F.col("text")), (2,))
    return found.select("doc_id", F.round("r2", 6).alias("redundancy"))


@_register(f"""
SELECT term, round(ln((SELECT count(*) FROM documents) / (1 + df)) + 1, 6) AS idf FROM (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_WORDS})) AS term FROM documents) GROUP BY term)
""")
def a18_smoothed_idf(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    df = ranking.term_counts(docs, "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(total)).select("term", F.round(F.log(F.col("n") / (1 + F.col("df"))) + 1, 6).alias("idf"))


@_register("""
SELECT event_type, strftime(ts, '%Y-%m') AS month, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY GROUPING SETS ((event_type), (strftime(ts, '%Y-%m')), ())
""")
def a3_usage_summary(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_type", F.date_format("ts", "yyyy-MM").alias("month"), "user_id")
    return e.groupingSets([["event_type"], ["month"], []], "event_type", "month").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@_register("""
SELECT s AS state, count(o_orderkey) AS n, round(coalesce(avg(o_totalprice), 0), 4) AS mean FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS s) LEFT JOIN orders ON o_orderstatus = s GROUP BY s
""")
def a5_state_counts(spark, sf_dir):
    """Listed states without rows count zero."""
    counts = _t(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
    states = spark.range(1).select(F.explode(F.array(*map(F.lit, "FOPX"))).alias("state"))
    return states.join(counts, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", F.lit(0.0)).alias("mean"))


@_register("""
WITH c AS (SELECT c_custkey, count(o_orderkey) AS degree FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1), s AS (SELECT avg(degree) AS m, stddev_pop(degree) AS sd FROM c)
SELECT c_custkey, degree, round((degree - m) / sd, 4) AS z FROM c, s WHERE degree > m + 2 * sd AND degree >= 3
""")
def a10_degree_outliers(spark, sf_dir):
    edges = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return statistics.degree_outliers(_t(spark, sf_dir, "customer"), edges, "c_custkey").withColumn("z", F.round("z", 4))


@_register("""
WITH t AS (SELECT event_type, value, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL)
SELECT event_type, value, n, round((sum(n) OVER (PARTITION BY event_type) - sum(n) OVER (PARTITION BY event_type ORDER BY value) + 1) / (sum(n) OVER (PARTITION BY event_type) + 1), 6) AS p FROM t
""")
def a27_conformal_p(spark, sf_dir):
    return statistics.conformal_p(_t(spark, sf_dir, "events"), "event_type", "value").withColumn("p", F.round("p", 6))


@_register("SELECT user_id, round(sum(ln(greatest(value / 50, 1e-9))), 5) AS log_product, round(avg(value / 50), 6) AS mean FROM events GROUP BY 1")
def a29_e_values(spark, sf_dir):
    found = statistics.e_product(_t(spark, sf_dir, "events"), "user_id", F.col("value") / 50)
    return found.select("user_id", F.round("log_product", 5).alias("log_product"), F.round("mean", 6).alias("mean"))


@_register("""
WITH g AS (SELECT user_id, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1)
SELECT user_id, round(m + 1 / ln((SELECT sum(n) FROM g) + exp(1)) * sqrt(CASE WHEN n < 2 THEN 1 ELSE greatest(0.001, least(1, v)) END / (n + 1)), 5) AS ucb FROM g
""")
def a37_ucb(spark, sf_dir):
    return statistics.ucb(_t(spark, sf_dir, "events"), "user_id", "value").withColumn("ucb", F.round("ucb", 5))


@_register("""
WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1)
SELECT event_type, round(any_value(med), 6) AS median, round(median(abs(value - med)), 6) AS mad FROM events JOIN m USING (event_type) GROUP BY 1
""")
def a53_median_and_mad(spark, sf_dir):
    found = statistics.median_and_mad(_t(spark, sf_dir, "events"), "event_type", "value")
    return found.select("event_type", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


@_register("SELECT source, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1")
def a57_coverage_gaps(spark, sf_dir):
    """Documents without a label, by source."""
    return _t(spark, sf_dir, "documents").select("doc_id", "source").join(_t(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@_register("SELECT count(*) AS users FROM (SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error')")
def u7_users_in_both(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.filter("event_type = 'purchase'").select("user_id").intersect(e.filter("event_type = 'error'").select("user_id")).agg(F.count(F.lit(1)).alias("users"))


@_register("""
WITH p AS (SELECT p_brand, p_partkey, round(p_retailprice - 905, 6) AS v, p_size - 1 AS w FROM part WHERE round(p_retailprice - 905, 6) > 0),
r AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY p_brand ORDER BY CASE WHEN w > 0 THEN v / w END DESC NULLS FIRST, v DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p)
SELECT p_brand, round(sum(CASE WHEN w = 0 THEN v ELSE v * greatest(0, least(1, (100 - b) / w)) END), 4) AS bound FROM r GROUP BY 1
""")
def k17_fractional_bound(spark, sf_dir):
    parts = _t(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_retailprice") - 905).alias("value"), (F.col("p_size") - 1).alias("weight"))
    return selection.fractional_bound(parts, "p_brand", "p_partkey", "value", "weight", 100).withColumn("bound", F.round("bound", 4))


@_register("""
SELECT p_partkey, p_brand FROM part x WHERE NOT EXISTS (SELECT 1 FROM part y WHERE y.p_brand = x.p_brand AND y.p_retailprice <= x.p_retailprice AND y.p_size >= x.p_size
  AND (y.p_retailprice < x.p_retailprice OR y.p_size > x.p_size))
""")
def k33_pareto(spark, sf_dir):
    return selection.pareto(_t(spark, sf_dir, "part"), "p_brand", "p_retailprice", "p_size").select("p_partkey", "p_brand")


@_register("SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 32")
def k34_claim_due(spark, sf_dir):
    return selection.claim_due(_t(spark, sf_dir, "events"), F.col("event_type") == "error", "ts", "event_id").select("event_id", "user_id")


@_register("""
WITH t AS (SELECT l_orderkey, l_partkey, max(l_quantity) AS r FROM lineitem GROUP BY ALL)
SELECT x.l_partkey AS a, y.l_partkey AS b, round(0.1 * sum(x.r), 6) AS strength, count(*) AS n FROM t x JOIN t y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey
GROUP BY ALL ORDER BY strength DESC, a, b LIMIT 20
""")
def k35_top_pairs(spark, sf_dir):
    """Parts of the same orders, with the quantity as reward."""
    pairs = selection.chosen_together(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", "l_quantity")
    return selection.top_pairs(pairs.withColumn("strength", F.round("strength", 6)), 20)


@_register("""
WITH l AS (SELECT event_id, props AS value FROM events UNION ALL SELECT -event_id, CASE event_id % 5 WHEN 0 THEN '[1, 2]' WHEN 1 THEN '{"k": "70"}' WHEN 2 THEN '{broken' WHEN 3 THEN ' ' ELSE '{"b": 1, "a": 2}' END FROM events)
SELECT event_id FROM l WHERE trim(coalesce(value, '')) <> '' AND (NOT json_valid(value) OR coalesce(CASE WHEN json_type(value, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract(value, '$.k') AS DOUBLE) END, 0) >= 50)
""")
def s14_prune_lines(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    odd = F.element_at(F.array(*map(F.lit, ("[1, 2]", '{"k": "70"}', "{broken", " ", '{"b": 1, "a": 2}'))), (F.col("event_id") % 5 + 1).cast("int"))
    lines = events.select("event_id", F.col("props").alias("value")).unionByName(events.select((-F.col("event_id")).alias("event_id"), odd.alias("value")))
    return jsonl.prune(lines, "k", 50.0).select("event_id")


from siltstone.plans import behaviour_queries, delivery_queries, ledger_queries, nearest_queries, retrieval_queries, selection_queries, structure_queries, text_queries  # noqa: E402, F401  (they register their queries)
