"""Queries of selection under budgets, chains, texts' rewriting and streams, and the same in SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import claims, fingerprints, rewriting
from siltstone.functions import text as tx
from siltstone.operators import evaluation, ledger, lineage, recall, selection, statistics
from siltstone.plans.registry import register, table
from siltstone.streaming import rollups


def _greedy_sql(value: str, weight: str, budget: int, where: str = "true") -> str:
    return f"""
WITH RECURSIVE i AS (SELECT p_brand, p_partkey, {value} AS v, {weight} AS w FROM part WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY v / greatest(w, 1) DESC, v DESC, p_partkey) AS n FROM i),
g AS (SELECT p_brand, 0::BIGINT AS n, {budget}::BIGINT AS room, -1::BIGINT AS k FROM (SELECT DISTINCT p_brand FROM r)
  UNION ALL SELECT g.p_brand, r.n, CASE WHEN r.w <= room THEN room - r.w ELSE room END, CASE WHEN r.w <= room THEN r.p_partkey ELSE -1 END FROM g JOIN r ON r.p_brand = g.p_brand AND r.n = g.n + 1)
SELECT p_partkey, p_brand, p_partkey IN (SELECT k FROM g) AS selected FROM part
"""


@register(_greedy_sql("p_retailprice - 900", "p_size", 120))
def k9_greedy_fill(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("v", F.col("p_retailprice") - 900)
    return selection.greedy_fill(parts, "p_brand", "p_partkey", "v", "p_size", 120).select("p_partkey", "p_brand", "selected")


_RECALL_QUERY = "Red bolt or small ECONOMY ring"
_RECALL_SQL = f"""
WITH RECURSIVE m AS (SELECT p_partkey AS id, CASE WHEN p_size % 10 = 0 THEN 'shared' ELSE p_brand END AS agent, ['working', 'episodic', 'semantic'][(p_partkey % 3 + 1)::INT] AS tier, p_size / 50 AS importance, p_partkey % 60 AS created, p_size % 30 + 20 AS salience, p_partkey % 9 AS times, greatest(p_size, 1) AS w,
  list_distinct(list_transform(regexp_extract_all(concat(p_name, ' mem ', p_type, ' ', p_brand), '[A-Za-z_][A-Za-z0-9_]+'), lambda x: lower(x))) AS words FROM part),
q AS (SELECT DISTINCT p_brand AS request, CASE WHEN p_brand LIKE '%1' THEN '' ELSE '{_RECALL_QUERY}' END AS q FROM part),
k AS (SELECT request, id, w, tier, CASE WHEN tier = 'semantic' THEN 1 ELSE exp(-(60 - created) / salience) END AS keep, importance, times, list_distinct(list_transform(regexp_extract_all(q, '[A-Za-z_][A-Za-z0-9_]+'), lambda x: lower(x))) AS qs, words FROM m JOIN q ON agent IN (request, 'shared')),
v AS (SELECT request, id, w, CASE WHEN tier <> 'semantic' AND keep < 0.2 THEN 0 ELSE keep * (1 + least(2, ln(1 + times))) * CASE WHEN len(qs) > 0 THEN 0.2 + 0.8 * len(list_intersect(qs, words)) / len(qs) ELSE 1 END * CASE tier WHEN 'working' THEN 1 WHEN 'episodic' THEN 1.1 ELSE 1.25 END * (0.5 + importance) END AS v FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY v / w DESC, v DESC, id) AS n FROM v WHERE v > 0),
g AS (SELECT request, 0::BIGINT AS n, 100::BIGINT AS room, -1::BIGINT AS k FROM q UNION ALL SELECT g.request, r.n, CASE WHEN r.w <= room THEN room - r.w ELSE room END, CASE WHEN r.w <= room THEN r.id ELSE -1 END FROM g JOIN r ON r.request = g.request AND r.n = g.n + 1)
SELECT request AS agent, count(*) FILTER (v = 0) AS faded, (SELECT string_agg(k, ',' ORDER BY k) FROM g WHERE g.request = v.request AND k >= 0) AS selected FROM v GROUP BY request
"""


@register(_RECALL_SQL)
def k29_recall_under_budget(spark, sf_dir):
    """Parts as memories of their brands, some shared; a request for each brand, some without a query."""
    f, k = F.col, F.col("p_partkey")
    parts = table(spark, sf_dir, "part")
    tier = F.element_at(F.array(*map(F.lit, ("working", "episodic", "semantic"))), (k % 3 + 1).cast("int"))
    memories = parts.select(k.alias("id"), F.when(f("p_size") % 10 == 0, recall.SHARED).otherwise(f("p_brand")).alias("agent"), f("p_name").alias("content"), F.concat(F.lit("mem/"), "p_type").alias("source"), F.array(F.regexp_replace("p_brand", "#.*", "")).alias("tags"), tier.alias("tier"), (f("p_size") / 50).alias("importance"), (k % 60).alias("created"), (f("p_size") % 30 + 20).alias("salience"), (k % 9).alias("recall_count"), f("p_size").alias("tokens"))
    requests = parts.select(f("p_brand").alias("request")).distinct().select("request", f("request").alias("agent"), F.when(f("request").endswith("1"), "").otherwise(_RECALL_QUERY).alias("query"), F.lit(100).cast("long").alias("budget"), F.lit(None).cast("string").alias("tier"))
    found = recall.recall(requests, memories, 60.0).groupBy("request").agg(F.count_if(f("score") == 0).alias("faded"), F.array_join(F.array_sort(F.collect_list(F.when(f("selected"), f("id")))).cast("array<string>"), ",").alias("selected"))
    return found.select(f("request").alias("agent"), "faded", "selected")


@register()
def k8_knapsack(spark, sf_dir):
    """K8; tested against all subsets, as SQL can't express it in bounded time."""
    parts = table(spark, sf_dir, "part").withColumn("v", F.col("p_retailprice") - 900)
    return selection.knapsack(parts, "p_brand", "p_partkey", "v", "p_size", 120)


@register()
def j1_near_copies(spark, sf_dir):
    """J1 over SimHashes of the documents; tested against plain code, as the order of insertion decides."""
    docs = table(spark, sf_dir, "documents").select("doc_id", fingerprints.simhash("text").alias("f"))
    return selection.near_copies(lineage.cut(docs), "doc_id", "f")


@register("""
WITH s AS (SELECT p_brand, p_type, count(*) AS n FROM part WHERE p_size > 40 GROUP BY ALL)
SELECT p_partkey, round(p_retailprice / (1 + coalesce(n, 0)), 6) AS gain FROM part LEFT JOIN s USING (p_brand, p_type) WHERE p_size <= 40
""")
def k20_module_diversity(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    found = selection.module_diversity(part.filter("p_size <= 40"), part.filter("p_size > 40"), "p_brand", "p_type", "p_retailprice")
    return found.select("p_partkey", F.round("gain", 6).alias("gain"))


@register("""
WITH t AS (SELECT l_orderkey, l_partkey, max(l_quantity) AS r FROM lineitem GROUP BY ALL),
p AS (SELECT x.l_partkey AS a, y.l_partkey AS b, 0.1 * sum(x.r) AS s, count(*) AS n FROM t x JOIN t y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY ALL),
u AS (SELECT a, b, s, n FROM p UNION ALL SELECT b, a, s, n FROM p), m AS (SELECT a, sum((1 - 1 / (1 + n)) * s) / sum(1 - 1 / (1 + n)) AS bonus FROM u WHERE b % 10 = 0 GROUP BY a)
SELECT p_partkey, round(coalesce(bonus, 0), 6) AS bonus FROM part LEFT JOIN m ON a = p_partkey
""")
def a39_resonance_bonus(spark, sf_dir):
    pairs = selection.chosen_together(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey")
    return selection.resonance_bonus(pairs, parts, parts.filter("p_partkey % 10 = 0"), "p_partkey").withColumn("bonus", F.round("bonus", 6))


_SPACED = "list_filter(regexp_split_to_array(coalesce({}, ''), '\\s+'), lambda x: x <> '')"


def _redundant_sql(n: int) -> str:
    return f"""g{n} AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS g FROM w),
o{n} AS (SELECT g, min(doc_id) AS doc_id FROM (SELECT doc_id, unnest(g) AS g FROM g{n}) GROUP BY g HAVING count(*) = 1), a{n} AS (SELECT doc_id, count(*) AS k FROM o{n} GROUP BY 1),
r{n} AS (SELECT doc_id, CASE WHEN len(g) > 0 THEN 1 - coalesce(k, 0) / len(g) ELSE 0 END AS r FROM g{n} LEFT JOIN a{n} USING (doc_id))"""


_REDUNDANCY_SQL = f"""w AS (SELECT doc_id, {_SPACED.format("text")} AS w FROM documents), {", ".join(map(_redundant_sql, (2, 3, 4)))},
x9 AS (SELECT w.doc_id, CASE WHEN len(w) < 2 THEN 0 ELSE (CASE WHEN len(w) < 20 THEN 0.55 WHEN len(w) < 100 THEN 0.25 ELSE 0.15 END) * r2.r + (CASE WHEN len(w) < 20 THEN 0.35 WHEN len(w) < 100 THEN 0.5 ELSE 0.35 END) * CASE WHEN len(w) >= 3 THEN r3.r ELSE r2.r END
  + (CASE WHEN len(w) < 20 THEN 0.10 WHEN len(w) < 100 THEN 0.25 ELSE 0.5 END) * CASE WHEN len(w) >= 4 THEN r4.r WHEN len(w) >= 3 THEN r3.r ELSE r2.r END END::DOUBLE AS r FROM w JOIN r2 USING (doc_id) JOIN r3 USING (doc_id) JOIN r4 USING (doc_id))"""


def _redundancy(docs: DataFrame) -> DataFrame:
    """(doc_id, redundancy): shares of 2-, 3- and 4-grams that other texts have, weighted by the text's length."""
    out = selection.ngram_redundancy(docs, "doc_id", claims.tokens(F.col("text")), (2, 3, 4))
    n = F.col("n")
    third = F.when(n >= 3, F.col("r3")).otherwise(F.col("r2"))
    fourth = F.when(n >= 4, F.col("r4")).otherwise(third)
    mix = lambda a, b, c: a * F.col("r2") + b * third + c * fourth
    score = F.when(n < 2, 0.0).when(n < 20, mix(0.55, 0.35, 0.10)).when(n < 100, mix(0.25, 0.50, 0.25)).otherwise(mix(0.15, 0.35, 0.50))
    return out.select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("redundancy"))


@register(f"WITH {_REDUNDANCY_SQL} SELECT doc_id, round(r, 6) AS redundancy FROM x9")
def x9_redundancy(spark, sf_dir):
    return _redundancy(table(spark, sf_dir, "documents")).withColumn("redundancy", F.round("redundancy", 6))


@register("""
WITH g AS (SELECT user_id, sum(value) AS s, sum(value * value) AS q, sum(value * log2(value)) AS l, max(value) AS m FROM events WHERE value > 0 GROUP BY 1)
SELECT user_id, round(-log2(q / (s * s)), 6) AS renyi2, round(log2(s) - l / s, 6) AS shannon, round(-log2(m / s), 6) AS least FROM g
""")
def x4_renyi(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.groupBy("user_id").agg(*(F.round(statistics.renyi("value", a), 6).alias(name) for name, a in (("renyi2", 2.0), ("shannon", 1.0), ("least", math.inf)))).filter("shannon IS NOT NULL")


@register("""
WITH t AS (SELECT doc_id, concat(text, ' [[', source, ' ]] x [[Other page]] [[', source, ']] [[ ]] [[open') AS t, concat('Authorization: Bearer a', doc_id, 'b, key sk-abcdefghijkl', doc_id, chr(13), ' 1234567:abcdefghijklmnopqrstu') AS s, concat('a,b,c', chr(10), replace(text, '.', chr(10))) AS c FROM documents)
SELECT doc_id, array_to_string(list_distinct_ordered, '|') AS links, regexp_replace(regexp_replace(regexp_replace(replace(s, chr(13), ''), '\\b\\d{6,12}:[A-Za-z0-9_-]{20,}\\b', '[REDACTED]', 'g'), '(?i)\\b(?:sk|rk|pk)-[A-Za-z0-9_-]{12,}\\b', '[REDACTED]', 'g'), '(?i)(authorization\\s*[:=]\\s*(?:bearer\\s+)?)[^\\s,;]+', '\\1[REDACTED]', 'g') AS redacted,
  CASE WHEN len(l) <= 6 THEN c ELSE concat(array_to_string(l[1:6], chr(10)), chr(10), '[... ', len(l) - 6, ' more rows, ', len(string_split(l[1], ',')), ' columns]') END AS csv
FROM (SELECT *, string_split(regexp_replace(c, '^\\s+|\\s+$', '', 'g'), chr(10)) AS l, list_filter([source_link, 'Other page'], lambda x: x <> '') AS list_distinct_ordered FROM (SELECT *, trim(regexp_extract(t, '(?s)\\[\\[(src[0-9]+) \\]\\]', 1)) AS source_link FROM t))
""")
def y21_rewriting(spark, sf_dir):
    """Y11, Y21 and Y33."""
    id_, source = F.col("doc_id").cast("string"), F.col("source")
    t = F.concat("text", F.lit(" [["), source, F.lit(" ]] x [[Other page]] [["), source, F.lit("]] [[ ]] [[open"))
    s = F.concat(F.lit("Authorization: Bearer a"), id_, F.lit("b, key sk-abcdefghijkl"), id_, F.lit("\r 1234567:abcdefghijklmnopqrstu"))
    c = F.concat(F.lit("a,b,c\n"), F.replace("text", F.lit("."), F.lit("\n")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(rewriting.wiki_links(t), "|").alias("links"), rewriting.redacted(s).alias("redacted"), rewriting.shortened_csv(c).alias("csv"))


@register("""
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS a, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS n FROM conversations),
b AS (SELECT conv_id, turn, a, concat(substr(a, 1, CAST(turn * 40 AS BIGINT)), n) AS n FROM t),
x AS (SELECT *, list_filter(range(0, greatest(CAST(ceil(least(length(a), length(n)) / 64) AS BIGINT), 0)), lambda i: substr(a, i * 64 + 1, 64) <> substr(n, i * 64 + 1, 64)) AS d FROM b)
SELECT conv_id, turn, CAST(CASE WHEN len(d) > 0 THEN d[1] * 64 ELSE least(length(a), length(n)) END AS BIGINT) AS common, length(CASE WHEN length(n) > length(a) THEN a ELSE n END) AS guarded FROM x
""")
def v21_common_prefix(spark, sf_dir):
    """Blocks of 64 characters; an output longer than its input gives way to it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("a"), F.coalesce(F.lead("text").over(w), F.lit("")).alias("n"))
    t = t.withColumn("n", F.concat(F.substring("a", F.lit(1), (F.col("turn") * 40).cast("int")), F.col("n")))
    return t.select("conv_id", "turn", rewriting.common_prefix(F.col("a"), F.col("n"), 64).alias("common"), F.char_length(rewriting.no_longer(F.col("n"), F.col("a"))).cast("long").alias("guarded"))


@register("""
WITH h AS (SELECT user_id, event_id, sha256(concat(user_id, ':', event_id)) AS record FROM events), p AS (SELECT *, lag(record) OVER (PARTITION BY user_id ORDER BY event_id) AS want FROM h),
c AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'broken' ELSE coalesce(want, '') END AS prev FROM p)
SELECT user_id, count(*) AS records, min(CASE WHEN prev <> coalesce(want, '') THEN event_id END) AS first_break FROM c GROUP BY 1
""")
def w12_chains(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    h = table(spark, sf_dir, "events").select("user_id", "event_id", F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_id").cast("string")), 256).alias("record"))
    h = h.withColumn("prev", F.when(F.col("event_id") % 97 == 0, "broken").otherwise(F.coalesce(F.lag("record").over(w), F.lit(""))))
    return ledger.verified_chains(h, "user_id", "event_id", "record", "prev")


@register("""
SELECT user_id, any_value(n)::BIGINT AS versions, string_agg(event_id, ',' ORDER BY event_id) AS timeline FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE event_id NOT IN (1, 2, 3) GROUP BY 1
""")
def w14_timelines(spark, sf_dir):
    """Rows of each entity in the order of their sequence, without deleted ones."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("n"))
    left = e.filter(~F.col("event_id").isin(1, 2, 3))
    return left.groupBy("user_id").agg(F.first("n").alias("versions"), F.array_join(F.array_sort(F.collect_list("event_id")).cast("array<string>"), ",").alias("timeline"))


@register("""
WITH t AS (SELECT conv_id, turn, list_transform(list_filter(string_split(coalesce(text, ''), '.'), lambda x: trim(x) <> ''), lambda x: list_distinct(list_filter(regexp_split_to_array(lower(x), '\\s+'), lambda w: w <> ''))) AS a FROM conversations),
p AS (SELECT conv_id, turn, a, coalesce(lag(a) OVER (PARTITION BY conv_id ORDER BY turn), []) AS e FROM t)
SELECT conv_id, turn, round(CASE WHEN len(a) = 0 OR len(e) = 0 THEN 0 ELSE list_sum(list_transform(a, lambda x: list_max(list_transform(e, lambda y: CASE WHEN len(list_distinct(list_concat(x, y))) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) ELSE 0 END)))) / len(a) END, 6) AS support FROM p
""")
def j22_best_matches(spark, sf_dir):
    """Sentences of each turn as claims, those of the turn before as evidence."""
    atoms = F.filter(F.split(F.coalesce("text", F.lit("")), r"\."), lambda x: F.trim(x) != "")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(atoms, lambda x: F.array_distinct(claims.tokens(F.lower(x)))).alias("a"))
    t = t.withColumn("e", F.coalesce(F.lag("a").over(Window.partitionBy("conv_id").orderBy("turn")), F.array().cast("array<array<string>>")))
    return t.select("conv_id", "turn", F.round(claims.best_matches(F.col("a"), F.col("e")), 6).alias("support"))


_TASKS_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(q, '{k}')" for k in words) + f" THEN '{name}'" for name, words, _ in tx.TASK_TYPES) + " ELSE 'Unknown' END"


@register(f"""
WITH e AS (SELECT conv_id, turn, coalesce(text, '') AS t, CASE WHEN length(text) % 10 = 0 THEN 0.5 ELSE length(text) % 10 / 10 END AS h FROM conversations),
g AS (SELECT conv_id, max_by(t, turn) AS last, sum(length(t)) AS n, count(*) AS fragments, avg(h) AS mean, max(h) AS top FROM e GROUP BY 1)
SELECT conv_id, greatest(1, length(last) // 4) AS query_tokens, 0.5::DOUBLE AS vagueness, greatest(1, n // 4)::BIGINT AS context_tokens, fragments, round(mean, 6) AS mean_entropy, round(top, 6) AS max_entropy, (SELECT {_TASKS_SQL} FROM (SELECT lower(last) AS q)) AS task_type FROM g
""")
def v36_budget_features(spark, sf_dir):
    found = evaluation.budget_features(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", F.char_length("text") % 10 / 10)
    return found.select("conv_id", "query_tokens", "vagueness", "context_tokens", "fragments", F.round("mean_entropy", 6).alias("mean_entropy"), F.round("max_entropy", 6).alias("max_entropy"), "task_type")


@register("""
WITH d AS (SELECT CAST(ts AS DATE) AS d, value FROM events), m AS (SELECT max(d) AS t FROM d)
SELECT round(sum(CASE WHEN d > t - 1 THEN value ELSE 0 END), 4) AS d1, round(sum(CASE WHEN d > t - 7 THEN value ELSE 0 END), 4) AS d7, round(sum(CASE WHEN d > t - 30 THEN value ELSE 0 END), 4) AS d30,
  round(sum(CASE WHEN d > t - 60 THEN value ELSE 0 END), 4) AS d60, round(sum(CASE WHEN d > t - 90 THEN value ELSE 0 END), 4) AS d90, round(sum(value), 4) AS lifetime FROM d, m
""")
def v41_rolling_values(spark, sf_dir):
    found = ledger.rolling_values(table(spark, sf_dir, "events"), "ts", "value")
    return found.select(*(F.round(c, 4).alias(c) for c in found.columns))


def _streamed(spark, sf_dir: str, build) -> DataFrame:
    """The complete result of a stream over the events, once all of them are read."""
    events = table(spark, sf_dir, "events")
    # a single file has to be named by a pattern, a folder by its path
    single = all(f.endswith("/events.parquet") for f in events.inputFiles())
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/[e]vents.parquet" if single else f"{sf_dir}/events.parquet")
    folder = lineage.new_folder(spark, "stream")
    keep = lambda rows, _: rows.write.mode("overwrite").parquet(f"{folder}/rows")
    run = build(stream).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


@register("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def t7_stream_rollup(spark, sf_dir):
    found = _streamed(spark, sf_dir, lambda s: rollups.tumbling(s, "ts", "value", lateness="100000 days"))
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n", F.round("total", 4).alias("total"))


@register("""
WITH e AS (SELECT user_id, ts, ts - lag(ts) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, s
""")
def t20_stream_sessions(spark, sf_dir):
    found = _streamed(spark, sf_dir, lambda s: rollups.sessions(s, "ts", "user_id", lateness="100000 days"))
    return found.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@register("SELECT event_id, min(value) AS value FROM events GROUP BY 1")
def t8_insert_once(spark, sf_dir):
    """Half of the events are stored; all of them come again."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    return ledger.insert_once(e.filter("event_id % 2 = 0"), e, "event_id", "value")
