"""Queries of sinks, outboxes, reports, routing classes and dependency walks, and the same in SQL."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import routing, signals
from siltstone.operators import blocks, delivery, graph, reports
from siltstone.plans.registry import register, table


def _any_sql(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


# letters and digits beyond ASCII become one that a word boundary of SQL's patterns knows
_PLAIN_SQL = r"regexp_replace(coalesce(text, ''), '[^\x00-\x7F\pZ\pP\pS\pC]', 'x', 'g')"


@register(f"""
SELECT conv_id, turn, CASE {' '.join(f"WHEN {_any_sql('t', w)} THEN '{n}'" for n, w in routing.INTENTS)} ELSE 'General' END AS intent,
  CASE WHEN {_any_sql('t', routing.HIGH_RISK)} THEN 'high' WHEN {_any_sql('t', routing.LOW_RISK)} THEN 'low' ELSE 'standard' END AS risk,
  CASE WHEN t = '' THEN 'unknown' {' '.join(f"WHEN regexp_matches(p, '(?i){p}') THEN '{n}'" for p, n in routing.ARCHETYPES)} ELSE 'general' END AS archetype
FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS t, {_PLAIN_SQL} AS p FROM conversations)
""")
def f10_query_classes(spark, sf_dir):
    """F10, F35 and F36 over all turns."""
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", routing.intent(text).alias("intent"), routing.risk_domain(text).alias("risk"), routing.archetype(text).alias("archetype"))


def _count_sql(c: str) -> str:
    return f"(length(t) - length(replace(t, '{c}', '')))"


_CONTENT_SQL = rf"""CASE WHEN length(t) < 20 THEN 'prose' WHEN regexp_matches(t, '^[\s\pZ]*[\{{\[]') THEN 'json' WHEN regexp_matches(t, '^[\s\pZ]*<') AND contains(left(t, 200), '>') THEN 'xml'
  WHEN regexp_matches(left(t, 500), '(?m)^#{{1,6}}[\s\pZ]') THEN 'markdown' WHEN regexp_matches(left(t, 500), '(?m)^\d{{4}}[-/]\d{{2}}|^\[?\d{{2}}:\d{{2}}|^(DEBUG|INFO|WARN|ERROR)') THEN 'log'
  WHEN {_count_sql(',')} > 10 AND {_count_sql(chr(10))} > 3 AND {_count_sql(',')} / {_count_sql(chr(10))} > 2 THEN 'csv' WHEN {_count_sql('|')} > 6 AND {_count_sql(chr(10))} > 2 THEN 'table'
  WHEN regexp_matches(left(t, 500), '(?m)^(From|To|Subject|Date):[\s\pZ]') THEN 'email' WHEN {_any_sql('lower(left(t, 2000))', routing.LEGAL)} THEN 'legal'
  WHEN regexp_matches(left(t, 1000), '(?m)(Traceback|Exception|at[\s\pZ]+[^\s\pZ]+\.[^\s\pZ]+\(|^[\s\pZ]+at[\s\pZ])') THEN 'stacktrace' ELSE 'prose' END"""


@register(f"""
WITH d AS (SELECT doc_id AS id, 'documents' AS part, coalesce(text, '') AS t FROM documents UNION ALL SELECT page_id, 'pages', coalesce(html, '') FROM pages)
SELECT part, id, {_CONTENT_SQL} AS kind FROM d
""")
def f22_content_types(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("part"), "text")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("pages").alias("part"), F.col("html").alias("text"))
    return docs.unionByName(pages).select("part", "id", routing.content_type(F.col("text")).alias("kind"))


_ENDS = (".py", ".tsx", ".rs", ".md", ".json", ".h", ".txt", "")
_ENDS_SQL = "[" + ", ".join(f"'{e}'" for e in _ENDS) + "]"


def _source():
    """A path made of a part's columns."""
    name = F.when(F.col("p_size") % 3 == 0, F.replace("p_name", F.lit(" "), F.lit("_"))).when(F.col("p_size") % 3 == 1, F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))).otherwise(F.concat(F.lit("x"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))))
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return F.concat(F.lit("src/components/"), name, end)


_SOURCE_SQL = f"""'src/components/' || CASE p_size % 3 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN c ELSE 'x' || c END || ({_ENDS_SQL})[p_partkey % 8 + 1]"""
_PARTS_SQL = f"SELECT *, {_SOURCE_SQL} AS source FROM (SELECT *, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), 'string_agg', '') AS c FROM part)"


@register(f"""
WITH p AS ({_PARTS_SQL}), r AS (SELECT *, CASE regexp_extract(lower(source), '(\\.[a-z]+)$', 1) {' '.join(f"WHEN '{e}' THEN {routing.CHARS_PER_TOKEN[n]}" for e, n in routing.LANGUAGES.items())} ELSE 3.3 END::DOUBLE AS rate FROM p),
s AS (SELECT *, CASE WHEN len(string_split(regexp_extract(source, '[^/]*$'), '.')) > 1 THEN string_split(regexp_extract(source, '[^/]*$'), '.')[-2] ELSE regexp_extract(source, '[^/]*$') END AS stem FROM r)
SELECT p_partkey, greatest(1, floor(length(p_type) / rate))::BIGINT AS tokens, CASE WHEN strlen(stem) < 3 THEN NULL WHEN regexp_matches(source, '\\.(py|rs)$') AND regexp_matches(stem, '[A-Z]') THEN CASE WHEN regexp_matches(stem, '^[A-Z]') THEN 'PascalCase' ELSE 'camelCase' END
  WHEN regexp_matches(source, '\\.(js|ts|jsx|tsx)$') AND NOT regexp_matches(stem, '^[A-Z]') THEN 'non-PascalCase' END AS issue FROM s
""")
def f4_tokens_and_names(spark, sf_dir):
    """F4 and F32 over paths made of parts' names."""
    parts = table(spark, sf_dir, "part").withColumn("source", _source())
    return parts.select("p_partkey", routing.calibrated_tokens(F.col("p_type"), F.col("source")).alias("tokens"), routing.naming_issue(F.col("source")).alias("issue"))


def _share_sql(kept: str) -> str:
    return f"CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '{kept}', '', 'g')) / length(text) ELSE 0.0 END"


@register(rf"""
WITH s AS (SELECT doc_id, {_share_sql(chr(92) + 'P{Lu}')} AS u, {_share_sql(chr(92) + 'P{Ll}')} AS l, {_share_sql(chr(92) + 'P{Nd}')} AS d, {_share_sql('[^' + re.escape(routing.SEPARATORS) + ']')} AS s, {_share_sql('[^' + re.escape(routing.PROGRESS) + ']')} AS p, {_share_sql(r'[^\s\x0b\x85\pZ]')} AS w FROM documents)
SELECT doc_id, round(u, 6) AS upper, round(l, 6) AS lower, round(d, 6) AS digit, round(s, 6) AS sep, round(p, 6) AS prog, round(w, 6) AS ws FROM s
""")
def x41_character_shares(spark, sf_dir):
    shares = table(spark, sf_dir, "documents").select("doc_id", routing.character_shares(F.col("text")).alias("s"))
    return shares.select("doc_id", *(F.round(f"s.{c}", 6).alias(c) for c in ("upper", "lower", "digit", "sep", "prog", "ws")))


@register("SELECT vec_id, array_to_string(list_transform(embedding, lambda v: least(greatest(round((v + 1::FLOAT) * 0.5::FLOAT * 65535::FLOAT), 0), 65535)::INT), ',') AS quantized FROM embeddings")
def x48_quantized(spark, sf_dir):
    q = routing.quantized(F.col("embedding").cast("array<float>"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(q.cast("array<string>"), ",").alias("quantized"))


@register("""
WITH g AS (SELECT p_brand, count(*) AS n, sum(p_size) AS sy, count_if(p_size < 10) AS cl, count_if(p_size > 30) AS de, count_if(p_size = 7) AS go, count_if(p_size = 9) AS ar, count_if(p_size < 3) AS na FROM part GROUP BY 1),
p AS (SELECT p_brand, CASE WHEN n < 2 THEN 0.0 ELSE least(1.0, cl / (n * (n - 1) / 2 * 0.05::DOUBLE)) END AS dup, least(1.0, de / (greatest(sy, 1) * 2.0::DOUBLE)) AS gone, least(1.0, go / greatest(n * 0.05::DOUBLE, 1.0)) AS co, least(1.0, ar / greatest(n * 0.1::DOUBLE, 1.0)) AS ar, least(1.0, na / greatest(n * 0.2::DOUBLE, 1.0)) AS na FROM g),
s AS (SELECT *, 100 * (1 - (0.3::DOUBLE * co + 0.3::DOUBLE * dup + 0.2::DOUBLE * gone + 0.15::DOUBLE * ar + 0.05::DOUBLE * na)) AS s FROM p)
SELECT p_brand, round(s, 1) AS score, CASE WHEN s >= 90 THEN 'A' WHEN s >= 80 THEN 'B' WHEN s >= 70 THEN 'C' WHEN s >= 60 THEN 'D' ELSE 'F' END AS grade, round(dup, 2) AS p_dup, round(gone, 2) AS p_dead, round(co, 2) AS p_coupling, round(ar, 2) AS p_arch, round(na, 2) AS p_naming FROM s
""")
def a11_code_health(spark, sf_dir):
    n = lambda e: F.count_if(F.expr(e))
    counts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("sy"), n("p_size < 10").alias("cl"), n("p_size > 30").alias("de"), n("p_size = 7").alias("go"), n("p_size = 9").alias("ar"), n("p_size < 3").alias("na"))
    return counts.select("p_brand", routing.health_score(*map(F.col, ("n", "sy", "cl", "de", "go", "ar", "na"))).alias("h")).select("p_brand", "h.*")


@register("""
WITH b AS (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 1 AND role <> 'user' THEN 'tool' ELSE role END AS role, text, (conv_id % 10) / 20.0::DOUBLE + 0.5::DOUBLE AS u, row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3 AS o FROM conversations),
k AS (SELECT *, CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'tool' THEN 'r' ELSE CASE WHEN regexp_matches(coalesce(text, ''), '^\\s*<(thinking|reasoning)>') THEN 't' WHEN conv_id % 4 = 2 THEN 'c' ELSE 'a' END END AS k FROM b)
SELECT conv_id, turn, CASE WHEN u < 0.7 OR k IN ('s', 'u') THEN 'Verbatim' WHEN k = 'r' THEN CASE WHEN u >= 0.9 AND o THEN 'Fingerprint' ELSE 'Skeleton' END WHEN k = 't' AND u >= 0.8 THEN 'Digest'
  WHEN k = 'c' THEN CASE WHEN u >= 0.85 AND o THEN 'Digest' WHEN u >= 0.75 THEN 'Skeleton' ELSE 'Verbatim' END WHEN k = 'a' AND u >= 0.95 AND o THEN 'Skeleton' ELSE 'Verbatim' END AS resolution FROM k
""")
def w6_progressive_resolution(spark, sf_dir):
    """W6, and F12's tool kinds: some conversations' turns count as tool results or calls."""
    turns = table(spark, sf_dir, "conversations").withColumn("role", F.when((F.col("conv_id") % 4 == 1) & (F.col("role") != "user"), "tool").otherwise(F.col("role"))).withColumn("tool", F.when(F.col("conv_id") % 4 == 2, "t"))
    kind = signals.block_kind(F.col("role"), F.col("text"), F.col("tool"))
    old = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) <= 3
    use = F.col("conv_id") % 10 / 20.0 + 0.5
    return turns.withColumn("kind", kind).withColumn("old", old).select("conv_id", "turn", routing.resolution(F.col("kind"), use, F.col("old")).alias("resolution"))


@register("""
WITH h AS (SELECT event_id, ts, user_id, ((event_id % 5) * 1234567890123 + user_id % 4)::BIGINT AS h FROM events), p AS (SELECT *, lag(h) OVER w AS b, epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER w) / 1e6 AS e FROM h WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
d AS (SELECT *, bit_count(xor(b, h))::INT AS d FROM p WHERE b IS NOT NULL)
SELECT event_id, CASE WHEN e < 0 THEN 'invalid_time' WHEN e > 864000 THEN 'expired' WHEN 1 - d / 64.0 > 0.9 THEN 'rephrase' WHEN 1 - d / 64.0 < 0.75 THEN 'topic_change' ELSE 'ambiguous' END AS status, CASE WHEN e < 0 OR e > 864000 THEN 0.0 ELSE 1 - d / 64.0 END::DOUBLE AS similarity,
  CASE WHEN e < 0 OR e > 864000 THEN 64 ELSE d END AS hamming FROM d
""")
def f37_transitions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    h = ((F.col("event_id") % 5) * 1234567890123 + F.col("user_id") % 4).cast("long")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = table(spark, sf_dir, "events").withColumn("h", h).withColumn("b", F.lag("h").over(w)).withColumn("e", micros - F.lag(micros).over(w)).filter("b IS NOT NULL")
    return rows.select("event_id", routing.transition(F.col("b"), F.col("h"), F.col("e"), 864000.0, 0.9, 0.75).alias("t")).select("event_id", "t.*")


_LOG_LINE_SQL = "'2024-03-' || lpad((event_id % 28 + 1)::VARCHAR, 2, '0') || ' 10:11:12.5 INFO ' || event_type || ' retry=' || user_id || ' took ' || (event_id % 90) || 'ms from 10.0.0.' || (event_id % 200) || CASE WHEN event_id % 5 = 0 THEN ' status=' || (event_id % 3) ELSE '' END"


@register(f"""
WITH l AS (SELECT user_id % 10 AS log, event_id AS k, {_LOG_LINE_SQL} AS line FROM events), b AS (SELECT *, regexp_replace(line, '{routing.LOG_STAMP}', '') AS bare FROM l),
t AS (SELECT *, CASE WHEN regexp_matches(bare, '{routing.LOG_KEPT}') THEN bare ELSE regexp_replace(bare, '{routing.LOG_VARIABLE}', '*', 'g') END AS t FROM b)
SELECT log, min(k) AS first, min_by(line, k) AS line, count(*) AS n FROM t GROUP BY log, t
""")
def a21_log_templates(spark, sf_dir):
    c = F.col
    line = F.concat(F.lit("2024-03-"), F.lpad((c("event_id") % 28 + 1).cast("string"), 2, "0"), F.lit(" 10:11:12.5 INFO "), c("event_type"), F.lit(" retry="), c("user_id"), F.lit(" took "), c("event_id") % 90, F.lit("ms from 10.0.0."), c("event_id") % 200, F.when(c("event_id") % 5 == 0, F.concat(F.lit(" status="), c("event_id") % 3)).otherwise(""))
    rows = table(spark, sf_dir, "events").select((c("user_id") % 10).alias("log"), c("event_id").alias("k"), line.alias("line"))
    return reports.log_templates(rows, "log", "k", "line")


@register("""
SELECT o_orderkey, x - y AS tokens_withheld, CASE WHEN x > 0 AND e THEN x - y ELSE 0 END AS tokens_saved, CASE WHEN x = 0 THEN 1.0 ELSE round(y / x, 6) END AS selected_to_source_ratio, CASE WHEN x = 0 THEN 1.0 WHEN y > 0 THEN round(x / y, 6) ELSE 0.0 END AS source_to_selected_ratio,
  CASE WHEN x > 0 AND e THEN round((1 - y / x) * 100, 3) ELSE 0.0 END AS reduction_pct, CASE WHEN x = 0 THEN 0.0 ELSE round((1 - y / x) * 100, 3) END AS withheld_pct
FROM (SELECT o_orderkey, (o_orderkey % 8 * 128)::BIGINT AS x, (o_orderkey % 8 * (o_orderkey % 5) * 32)::BIGINT AS y, o_orderkey % 3 > 0 AS e FROM orders)
""")
def a56_compression(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", routing.compression(k % 8 * 128, k % 8 * (k % 5) * 32, k % 3 > 0).alias("c")).select("o_orderkey", "c.*")


@register("SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 7 = 0")
def s18_conflicts(spark, sf_dir):
    """Replays of even orders, of which every seventh has another price."""
    orders = table(spark, sf_dir, "orders")
    again = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return delivery.conflicts(orders.filter("o_orderkey % 2 = 0"), again, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@register("""
SELECT event_id, user_id, value FROM events WHERE event_id % 3 = 0
UNION ALL SELECT event_id, user_id, value FROM events WHERE event_id % 3 <> 0 AND user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 1)
""")
def s20_adjustments(spark, sf_dir):
    """Adjustments whose event (a customer with an odd key) exists, once each."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    known = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 1").select(F.col("c_custkey").alias("user_id"))
    return delivery.adjustments_once(e.filter("event_id % 3 = 0"), e.unionByName(e), known, "event_id", "user_id", "value")


@register("SELECT sha256('delivery.v1' || chr(0) || event_type || chr(0) || user_id || chr(0) || (event_id % 50)) AS id, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1")
def s22_outbox(spark, sf_dir):
    key = delivery.event_id("delivery.v1", F.col("event_type"), F.col("user_id").cast("string"), (F.col("event_id") % 50).cast("string"))
    return table(spark, sf_dir, "events").groupBy(key.alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


@register("""
WITH e AS (SELECT event_id, event_id % 1000 AS created_at, event_type AS channel, (user_id % 2)::VARCHAR AS destination, CASE WHEN event_id % 4 = 0 THEN 'delivered' ELSE 'pending' END AS state, (event_id % 200)::DOUBLE AS not_before, CASE WHEN event_id % 3 = 0 THEN (event_id % 150)::DOUBLE END AS lease_until FROM events),
f AS (SELECT event_id FROM e WHERE channel = 'error' AND destination = '1' AND state = 'pending' AND not_before <= 100 AND (lease_until IS NULL OR lease_until <= 100) ORDER BY created_at, event_id LIMIT 32)
SELECT event_id, event_id IN (SELECT event_id FROM f) AS claimed, CASE WHEN event_id IN (SELECT event_id FROM f) THEN 130.0 ELSE lease_until END AS lease_until FROM e
""")
def k34_claim(spark, sf_dir):
    """K34 with channel, destination, not_before and lease."""
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select(k, (k % 1000).alias("created_at"), F.col("event_type").alias("channel"), (F.col("user_id") % 2).cast("string").alias("destination"), F.when(k % 4 == 0, "delivered").otherwise("pending").alias("state"), (k % 200).cast("double").alias("not_before"), F.when(k % 3 == 0, (k % 150).cast("double")).alias("lease_until"))
    return delivery.claim(e, "error", "1", 100.0).select("event_id", "claimed", "lease_until")


_PAYLOAD_SQL = """CASE o_orderkey % 3 WHEN 0 THEN '{"usage":{"prompt_tokens":' || o_custkey || ',"completion_tokens":' || o_orderkey || ',"prompt_tokens_details":{"cached_tokens":' || o_orderkey % 300 || '}}}'
  WHEN 1 THEN '{"message":{"usage":{"input_tokens":' || o_custkey || ',"cache_read_input_tokens":' || o_orderkey % 300 || ',"cache_creation_input_tokens":-5,"output_tokens":null}}}' ELSE '{"usageMetadata":{"promptTokenCount":' || o_custkey || ',"cachedContentTokenCount":"x","candidatesTokenCount":' || o_orderkey || '}}' END"""


def _payload():
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    first = F.concat(F.lit('{"usage":{"prompt_tokens":'), c, F.lit(',"completion_tokens":'), k, F.lit(',"prompt_tokens_details":{"cached_tokens":'), k % 300, F.lit("}}}"))
    second = F.concat(F.lit('{"message":{"usage":{"input_tokens":'), c, F.lit(',"cache_read_input_tokens":'), k % 300, F.lit(',"cache_creation_input_tokens":-5,"output_tokens":null}}}'))
    third = F.concat(F.lit('{"usageMetadata":{"promptTokenCount":'), c, F.lit(',"cachedContentTokenCount":"x","candidatesTokenCount":'), k, F.lit("}}"))
    return F.when(k % 3 == 0, first).when(k % 3 == 1, second).otherwise(third)


@register("""
SELECT o_custkey, o_orderkey % 3 AS p, max(CASE WHEN o_orderkey % 3 = 0 THEN greatest(0, o_custkey - o_orderkey % 300) ELSE o_custkey END)::BIGINT AS uncached_input_tokens, max(CASE o_orderkey % 3 WHEN 0 THEN least(o_custkey, o_orderkey % 300) WHEN 1 THEN o_orderkey % 300 ELSE 0 END)::BIGINT AS cache_read_tokens,
  0::BIGINT AS cache_write_tokens, max(CASE WHEN o_orderkey % 3 = 1 THEN 0 ELSE o_orderkey END)::BIGINT AS output_tokens FROM orders GROUP BY ALL
""")
def s17_stream_usage(spark, sf_dir):
    """Transcripts of a customer's orders by provider, with lines that aren't usage."""
    rows = table(spark, sf_dir, "orders").withColumn("p", F.col("o_orderkey") % 3).withColumn("line", F.concat(F.lit("event: x\n\n  data: "), _payload(), F.lit("\ndata: {broken\ndata: [DONE]")))
    texts = rows.groupBy("o_custkey", "p").agg(F.concat_ws("\r\n", F.collect_list("line")).alias("text"))
    named = texts.withColumn("provider", F.when(F.col("p") == 0, " OpenAI").when(F.col("p") == 1, "claude").otherwise("vertex")).withColumn("k", F.struct("o_custkey", "p"))
    return delivery.stream_usage(named, "k", "provider", "text").select("k.*", *delivery.CATEGORIES)


@register("""
SELECT sum(CASE WHEN d < '2024-06-01' THEN greatest(v, 0) ELSE 0 END)::BIGINT AS tokens, sum(CASE WHEN d < '2024-06-01' THEN k ELSE 0 END)::BIGINT AS cents, count_if(d < '2024-06-01')::BIGINT AS contribution_events, sum(CASE WHEN d >= '2024-06-01' THEN greatest(v, 0) ELSE 0 END)::BIGINT AS kept_tokens,
  sum(CASE WHEN d >= '2024-06-01' THEN k ELSE 0 END)::BIGINT AS kept_cents FROM (SELECT strftime(ts, '%Y-%m-%d') AS d, (event_id % 100 - 20)::BIGINT AS v, event_id % 9 AS k FROM events WHERE event_type = 'purchase')
""")
def s35_archive(spark, sf_dir):
    """What an archive gains and what stays."""
    e = table(spark, sf_dir, "events").withColumn("d", F.date_format("ts", "yyyy-MM-dd"))
    return delivery.archived(e, "d", F.col("event_type") == "purchase", {"tokens": F.col("event_id") % 100 - 20, "cents": F.col("event_id") % 9}, "2024-06-01")


@register("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'add' WHEN o_orderkey % 7 = 0 THEN 'remove' ELSE 'update' END AS change FROM orders WHERE (o_orderkey % 5 = 0) <> (o_orderkey % 7 = 0) OR (o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0)
""")
def s4_reconciled(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.md5("o_orderpriority").alias("digest"))
    live = orders.filter("o_orderkey % 7 <> 0").withColumn("digest", F.when(F.col("o_orderkey") % 11 == 0, "new").otherwise(F.col("digest")))
    return delivery.reconciled(orders.filter("o_orderkey % 5 <> 0"), live, "o_orderkey", "digest")


@register("""
SELECT p_type AS body, count_if(p_partkey % 4 <> 0 AND p_size % 50 <> 3) = 0 AS deleted FROM part GROUP BY 1 HAVING count_if(p_partkey % 4 = 0) > 0
""")
def u10_redactions(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumnRenamed("p_type", "body")
    return delivery.redactions(parts, F.col("p_partkey") % 4 == 0, F.col("p_size") % 50 == 3, "body")


_REPORT_SQL = """t AS (SELECT event_id, event_type AS model, CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id % 64 / 128.0::DOUBLE END AS c, CASE WHEN event_id % 8 = 0 THEN -1 ELSE event_id % 500 END AS l FROM events),
r AS (SELECT model, count(*) AS requests, sum(event_id)::BIGINT AS total_tokens, round(coalesce(sum(c) FILTER (c > 0), 0), 6) AS total_cost_usd, count_if(c > 0)::BIGINT AS measured_cost_requests, round(avg(l) FILTER (l > 0), 2) AS mean_ms, list_sort(list(l::DOUBLE) FILTER (l > 0)) AS s FROM t GROUP BY 1),
q AS (SELECT * EXCLUDE (s), round(total_cost_usd / greatest(measured_cost_requests, 1), 6) AS avg_cost_usd, s[len(s) // 2 + 1] AS p50_ms, s[floor(len(s) * 0.95)::BIGINT + 1] AS p95_ms FROM r)"""


def _report(spark, sf_dir):
    k = F.col("event_id")
    traces = table(spark, sf_dir, "events").select(k, F.col("event_type").alias("model"), F.when(k % 6 != 0, k % 64 / 128.0).alias("c"), F.when(k % 8 == 0, -1).otherwise(k % 500).alias("l"))
    return reports.model_report(traces, "model", "c", "l", "event_id")


@register(f"WITH {_REPORT_SQL} SELECT * FROM q")
def a6_model_report(spark, sf_dir):
    return _report(spark, sf_dir)


@register(f"""
WITH {_REPORT_SQL}, x AS (SELECT event_type AS model, user_id % 3 AS policy, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS rec FROM events)
SELECT policy, count(*) AS comparisons, round(sum(b.avg_cost_usd - a.avg_cost_usd), 6) AS total_delta_usd, round(round(sum(b.avg_cost_usd - a.avg_cost_usd), 6) / count(*), 6) AS avg_delta_usd FROM x JOIN q a ON a.model = x.model JOIN q b ON b.model = x.rec WHERE x.rec <> x.model GROUP BY 1
""")
def v14_cost_delta(spark, sf_dir):
    rec = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    used = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("policy"), F.col("event_type").alias("model"), rec.alias("rec_model"))
    return reports.shadow_cost_delta(used, _report(spark, sf_dir))


@register("""
WITH c AS (UNPIVOT (SELECT p_partkey::VARCHAR AS a, p_brand AS b, p_name AS c, CASE WHEN p_size % 7 = 0 THEN ' ' ELSE p_size::VARCHAR END AS d, CASE WHEN p_size > 25 THEN 'Yes' ELSE 'no' END AS e, ''::VARCHAR AS f FROM part) ON a, b, c, d, e, f INTO NAME name VALUE v),
g AS (SELECT name, count(*) AS n_rows, count_if(trim(v) = '')::BIGINT AS missing, count(DISTINCT v) FILTER (trim(v) <> '') AS dist, list_sort(list(try_cast(v AS DOUBLE)) FILTER (trim(v) <> '')) AS s FROM c GROUP BY 1)
SELECT name, CASE WHEN missing = n_rows THEN 'empty' WHEN name IN ('a', 'd') THEN 'number' WHEN name = 'e' THEN 'boolean' WHEN dist = n_rows - missing THEN 'unique' ELSE 'text' END AS kind, n_rows, missing, CASE WHEN name IN ('a', 'd') THEN s[1] END AS low,
  CASE WHEN name IN ('a', 'd') THEN s[round_even(0.5 * (len(s) - 1), 0)::BIGINT + 1] END AS p50, CASE WHEN name IN ('a', 'd') THEN s[-1] END AS high, CASE WHEN name = 'e' OR (name IN ('b', 'c') AND dist < n_rows - missing) THEN dist END AS n_distinct FROM g
""")
def a19_column_profile(spark, sf_dir):
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), F.col("p_brand").alias("b"), F.col("p_name").alias("c"), F.when(size % 7 == 0, " ").otherwise(size.cast("string")).alias("d"), F.when(size > 25, "Yes").otherwise("no").alias("e"), F.lit("").alias("f"))
    return reports.column_profile(rows, list("abcdef"))


@register("""
SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, count(*) AS n, round(avg(o_orderkey % 10), 6) AS mean_confidence FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*), round(avg(o_orderkey % 10), 6) FROM orders GROUP BY 2
""")
def a58_status_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("c", F.col("o_orderkey") % 10)
    return reports.status_counts(rows, ["o_orderstatus", "o_orderpriority"], "c").withColumn("mean_confidence", F.round("mean_confidence", 6))


_LINKS_SQL = "e AS (SELECT c_custkey AS src, c_custkey // 20 * 20 + c_custkey * 7 % 23 AS dst, 1.0::DOUBLE / (1 + c_custkey % 4) AS strength FROM customer WHERE c_custkey % 3 > 0)"


def _links(spark, sf_dir):
    """Customers in rows of twenty that lead a little over into the next."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").filter("c_custkey % 3 > 0").select(k.alias("src"), (F.floor(k / 20) * 20 + k * 7 % 23).alias("dst"), (1.0 / (1 + k % 4)).alias("strength"))


@register(f"""
WITH RECURSIVE {_LINKS_SQL}, n AS (SELECT c_custkey AS node FROM customer), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
r AS (SELECT node, node AS c FROM n UNION SELECT b.dst, r.c FROM r JOIN b ON b.src = r.node WHERE b.dst IN (SELECT node FROM n)) SELECT node, min(c) AS component FROM r GROUP BY 1
""")
def i3_components(spark, sf_dir):
    return graph.components(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node")), _links(spark, sf_dir))


@register(f"""
WITH RECURSIVE {_LINKS_SQL}, r AS (SELECT c_custkey AS node, 0 AS depth FROM customer WHERE c_custkey % 50 = 1 UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.node WHERE depth < 8) SELECT node, min(depth)::INT AS depth FROM r GROUP BY 1 HAVING min(depth) > 0
""")
def i4_transitive_dependencies(spark, sf_dir):
    seeds = table(spark, sf_dir, "customer").filter("c_custkey % 50 = 1").select(F.col("c_custkey").alias("node"))
    return graph.reachable(_links(spark, sf_dir), seeds, 8, both_ways=False).filter("depth > 0")


@register(f"""
WITH RECURSIVE {_LINKS_SQL}, c AS (SELECT src + 1000000 AS src, src // 10 * 10 + src * 3 % 11 + 1000000 AS dst FROM e), s AS (SELECT c_custkey + 1000000 AS symbol, c_custkey * 11 % 1009 AS path FROM customer),
r AS (SELECT c_custkey AS node, 0 AS depth FROM customer WHERE c_custkey % 50 = 7 UNION SELECT e.src, depth + 1 FROM r JOIN e ON e.dst = r.node WHERE depth < 3),
q AS (SELECT symbol AS node, 0 AS depth FROM s WHERE path IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 = 7) UNION SELECT c.src, depth + 1 FROM q JOIN c ON c.dst = q.node WHERE depth < 3)
SELECT c_custkey AS path, 'changed' AS reason, NULL::VARCHAR AS of FROM customer WHERE c_custkey % 50 = 7 UNION SELECT src, 'imports', dst::VARCHAR FROM e WHERE dst IN (SELECT node FROM r)
UNION SELECT path, 'calls', dst::VARCHAR FROM c JOIN s ON s.symbol = c.src WHERE dst IN (SELECT node FROM q)
""")
def i10_change_impact(spark, sf_dir):
    """Customers as files, and as symbols of other files; a fiftieth of the files change."""
    edges, k = _links(spark, sf_dir).select("src", "dst"), F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    calls = edges.select((F.col("src") + 1000000).alias("src"), (F.floor(F.col("src") / 10) * 10 + F.col("src") * 3 % 11 + 1000000).alias("dst"))
    names = customers.select((k + 1000000).alias("symbol"), (k * 11 % 1009).alias("path"))
    return graph.impact(edges, customers.filter("c_custkey % 50 = 7").select(k.alias("node")), calls, names, 4)


@register(f"""
WITH {_LINKS_SQL}, s AS (SELECT dst AS node, sum(strength) AS s FROM e WHERE src % 2 = 0 GROUP BY 1) SELECT node, round(s / max(s) OVER (), 6) AS boost FROM s
""")
def i5_boosts(spark, sf_dir):
    links = _links(spark, sf_dir)
    return graph.boosts(links.filter("src % 2 = 0").select(F.col("src").alias("node")), links).withColumn("boost", F.round("boost", 6))


@register(f"WITH {_LINKS_SQL} SELECT src, dst FROM e WHERE dst % 10 = 4")
def j7_dependents(spark, sf_dir):
    links = _links(spark, sf_dir)
    return graph.dependents(links, links.filter("dst % 10 = 4").select(F.col("dst").alias("node")))


_DIFF_SQL = "concat('--- a/', p_brand, chr(10), CASE WHEN p_size % 4 = 0 THEN '+++ /dev/null' ELSE '+++ b/' || p_type END, chr(10), '@@ -1 +1 @@ ', CASE p_size % 3 WHEN 0 THEN 'pub fn ' WHEN 1 THEN 'def ' ELSE 'class ' END, replace(p_name, ' ', '_'), '(x)', chr(10), '+', p_name, chr(10), '+more', chr(10), '-', p_brand, chr(10), ' same')"


@register(rf"""
WITH d AS (SELECT p_partkey, {_DIFF_SQL} AS d, CASE p_partkey % 7 WHEN 0 THEN 'Fix it' WHEN 1 THEN 'Add a CVE' WHEN 2 THEN 'new SPEC' WHEN 3 THEN 'clean up' WHEN 4 THEN 'optimise' WHEN 5 THEN 'README' ELSE 'more' END AS m FROM part),
l AS (SELECT *, string_split(d, chr(10)) AS l, lower(m || ' ' || left(d, 2000)) AS h FROM d)
SELECT p_partkey, array_to_string(list_transform(list_filter(l, lambda x: starts_with(x, '+++ b/')), lambda x: substr(x, 7)), ',') AS files_modified, CASE WHEN contains(d, '+++ /dev/null') THEN array_to_string(list_transform(list_filter(l, lambda x: starts_with(x, '--- a/')), lambda x: substr(x, 7)), ',') ELSE '' END AS files_deleted,
  len(list_filter(l, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++')))::INT AS lines_added, len(list_filter(l, lambda x: starts_with(x, '-') AND NOT starts_with(x, '---')))::INT AS lines_removed,
  regexp_extract(l[3], '(?:fn|def) ([\pL\pN_]*)', 1) AS functions_changed, CASE {' '.join(f"WHEN {_any_sql('h', w)} THEN '{n}'" for n, w in routing.CHANGES)} ELSE 'feature' END AS intent FROM l
""")
def s24_change_sets(spark, sf_dir):
    c, size, k = F.col, F.col("p_size"), F.col("p_partkey") % 7
    new = F.when(size % 4 == 0, "+++ /dev/null").otherwise(F.concat(F.lit("+++ b/"), "p_type"))
    word = F.when(size % 3 == 0, "pub fn ").when(size % 3 == 1, "def ").otherwise("class ")
    diff = F.concat(F.lit("--- a/"), "p_brand", F.lit("\n"), new, F.lit("\n@@ -1 +1 @@ "), word, F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("(x)\n+"), "p_name", F.lit("\n+more\n-"), "p_brand", F.lit("\n same"))
    message = F.when(k == 0, "Fix it").when(k == 1, "Add a CVE").when(k == 2, "new SPEC").when(k == 3, "clean up").when(k == 4, "optimise").when(k == 5, "README").otherwise("more")
    found = table(spark, sf_dir, "part").select("p_partkey", routing.change_set(diff, message).alias("s")).select("p_partkey", "s.*")
    return found.select("p_partkey", *(F.array_join(c(n), ",").alias(n) for n in ("files_modified", "files_deleted", "functions_changed")), "lines_added", "lines_removed", "intent")


@register()
def s3_line_chunks(spark, sf_dir):
    """Documents in runs of lines of 512 bytes at most; tested against the texts, as SQL has no such running sum."""
    return blocks.line_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 512)


@register("""
WITH h AS (SELECT p_partkey FROM part WHERE contains(lower(p_type), 'economy') OR contains(lower(p_type), 'bolt') OR contains(lower(p_name), 'economy') OR contains(lower(p_name), 'bolt'))
SELECT p_partkey, (SELECT count(*) FROM h) AS n_affected, CASE WHEN (SELECT count(*) FROM h) <= 2 THEN 'low' WHEN (SELECT count(*) FROM h) <= 5 THEN 'medium' ELSE 'high' END AS risk FROM h
""")
def j16_blast_radius(spark, sf_dir):
    return blocks.blast_radius(table(spark, sf_dir, "part"), "p_partkey", ["p_type", "p_name"], ["src/Economy.py", "metal/bolt.tar"])
