"""Queries of agents' behaviour, learned policies, fielded search and hidden payloads, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import claims, outcomes, rewriting
from siltstone.operators import behaviour, graph, ranking
from siltstone.plans.registry import register, table

#: Events of one user are days apart: three days here, ten minutes for real calls.
WAIT = 3 * 24 * 3600 * 1_000_000


@register(f"""
WITH c AS (SELECT user_id AS conversation, event_id, epoch_us(ts) AS tt, CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type END AS s, CASE WHEN event_type = 'error' THEN 'e' || (value > 10)::INT ELSE '' END AS e,
    CASE WHEN event_id % 7 = 0 THEN '' ELSE 'm' || (event_id % 3) END AS m, event_id % 100 AS n FROM events),
w AS (SELECT *, list_filter(list(struct_pack(tt := tt, s := s, e := e, m := m, n := n)) OVER (PARTITION BY conversation ORDER BY tt, event_id ROWS BETWEEN 63 PRECEDING AND CURRENT ROW), lambda x: x.tt >= c.tt - {WAIT}) AS o FROM c),
l AS (SELECT *, list_filter(o, lambda x: x.s = w.s) AS os, list_filter(o, lambda x: x.e = w.e) AS oe, list_filter(o, lambda x: x.m <> '') AS om, list_filter(o, lambda x: x.s <> '')[-4:] AS t, list_filter(o[-4:], lambda x: x.s <> '') AS ol FROM w),
g AS (SELECT *, list_transform(om, lambda x: x.m) AS ms FROM l),
f AS (SELECT conversation, event_id, tt, 'identical_tool_retry' AS kind, s AS fingerprint, os AS rows, len(os) AS occurrences FROM g WHERE s <> '' AND len(os) >= 3
  UNION ALL SELECT conversation, event_id, tt, 'repeated_error', e, oe, len(oe) FROM g WHERE e <> '' AND len(oe) >= 3
  UNION ALL SELECT conversation, event_id, tt, 'alternating_tool_loop', sha256(least(t[1].s, t[2].s) || '|' || greatest(t[1].s, t[2].s))[:16], ol, len(ol) FROM g WHERE len(t) = 4 AND t[1].s = t[3].s AND t[2].s = t[4].s AND t[1].s <> t[2].s
  UNION ALL SELECT conversation, event_id, tt, 'model_switch_churn', sha256(array_to_string(list_sort(list_distinct(ms)), '|'))[:16], om, k FROM (SELECT *, len(list_filter(range(1, len(ms)), lambda i: ms[i] <> ms[i + 1])) AS k FROM g) WHERE k >= 3),
r AS (SELECT *, occurrences // 3 AS level, coalesce(list_sum(list_transform(rows[2:], lambda x: x.n)), 0) AS wasted FROM f)
SELECT conversation, kind, fingerprint, level::BIGINT AS level, event_id AS first_seen, occurrences::BIGINT AS occurrences, wasted::BIGINT AS wasted, round(least(0.99, 0.55 + 0.10 * greatest(0, occurrences - 2)), 3)::DOUBLE AS confidence, CASE WHEN occurrences >= 5 THEN 'high' ELSE 'medium' END AS severity
FROM r QUALIFY row_number() OVER (PARTITION BY conversation, kind, fingerprint, level ORDER BY tt, event_id) = 1
""")
def w11_waste(spark, sf_dir):
    """W11 with events as calls of their users."""
    k = F.col("event_id")
    calls = table(spark, sf_dir, "events").select(
        "user_id",
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.when(k % 11 == 0, "").otherwise(F.col("event_type")).alias("call"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("e"), (F.col("value") > 10).cast("int").cast("string"))).alias("error"),
        F.when(k % 7 != 0, F.concat(F.lit("m"), (k % 3).cast("string"))).alias("model"),
        (k % 100).alias("tokens"),
    )
    return behaviour.waste(calls, "user_id", "at", "event_id", "call", "error", "model", "tokens", WAIT)


@register("""
WITH c AS (SELECT o_orderpriority AS archetype, o_orderstatus AS model, count(*) FILTER (o_totalprice > 150000) + 1.0 AS alpha, count(*) FILTER (NOT o_totalprice > 150000) + 1.0 AS beta, count(*) AS n FROM orders GROUP BY ALL)
SELECT archetype, model, alpha::DOUBLE AS alpha, beta::DOUBLE AS beta, n, sum(n) OVER (PARTITION BY archetype) >= 5 AS enough, round(alpha::DOUBLE / (alpha + beta), 4) AS p_success FROM c
""")
def v16_beta_cells(spark, sf_dir):
    return behaviour.beta_cells(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", F.col("o_totalprice") > 150000)


@register("""
WITH r AS (SELECT o_orderpriority AS g, o_orderkey % 2 = 1 AS shadow, (o_totalprice > 50000)::INT AS s, (o_custkey % 3)::BIGINT AS p, CASE WHEN o_orderkey % 2 = 1 THEN o_custkey % 4 ELSE o_custkey % 3 END AS t FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_orderkey % 2 = 1 ORDER BY o_orderdate DESC, o_orderkey DESC) <= 50),
m AS (SELECT g, count(*) FILTER (shadow) AS ns, count(*) FILTER (NOT shadow) AS nl, sum(s) FILTER (NOT shadow) / 50 AS ls, sum(p) FILTER (NOT shadow) / 50 AS lp, sum(t) FILTER (NOT shadow) / 50 AS lt, sum(s) FILTER (shadow) / 50 AS ss, sum(p) FILTER (shadow) / 50 AS sp, sum(t) FILTER (shadow) / 50 AS st FROM r GROUP BY g),
f AS (SELECT *, ns >= 50 AND nl >= 50 AS whole FROM m)
SELECT g AS o_orderpriority, CASE WHEN whole THEN ls END AS live_success, CASE WHEN whole THEN lp END AS live_repairs, CASE WHEN whole THEN lt END AS live_retries, CASE WHEN whole THEN ss END AS shadow_success, CASE WHEN whole THEN sp END AS shadow_repairs, CASE WHEN whole THEN st END AS shadow_retries,
  whole AND ss >= ls - 0.05 AND NOT (sp > lp * 1.2 AND sp > lp + 0.1) AND NOT (st > lt * 1.2 AND st > lt + 0.1) AS promoted FROM f
""")
def v39_promotion(spark, sf_dir):
    """V39 with odd orders as the shadow policy's."""
    odd = F.col("o_orderkey") % 2 == 1
    orders = table(spark, sf_dir, "orders").withColumn("repairs", F.col("o_custkey") % 3).withColumn("retries", F.when(odd, F.col("o_custkey") % 4).otherwise(F.col("o_custkey") % 3))
    return behaviour.promotion(orders, "o_orderpriority", odd, ["o_orderdate", "o_orderkey"], F.col("o_totalprice") > 50000, "repairs", "retries")


@register("""
WITH w AS (SELECT l_shipmode_like AS archetype, unnest(['w_q', 'w_d', 'w_t']) AS key, unnest([l_quantity, CASE WHEN l_linenumber <> 2 THEN l_discount END, l_tax]) AS v FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_like FROM lineitem)),
r AS (SELECT *, row_number() OVER (PARTITION BY archetype, key ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY archetype, key) AS n FROM w WHERE v IS NOT NULL)
SELECT archetype, key, round(avg(v), 6) AS weight FROM r WHERE n < 3 OR (i >= greatest(1, n // 10) AND i < n - greatest(1, n // 10)) GROUP BY ALL
""")
def a34_merged_weights(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("archetype"), F.col("l_quantity").alias("w_q"), F.when(F.col("l_linenumber") != 2, F.col("l_discount")).alias("w_d"), F.col("l_tax").alias("w_t"))
    return behaviour.merged_weights(lines, "archetype", ["w_q", "w_d", "w_t"])


@register("""
WITH words AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS symbol FROM part), d AS (SELECT symbol, min(p_partkey) AS home FROM words GROUP BY symbol HAVING min(p_partkey) % 2 = 0),
s AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), u AS (SELECT DISTINCT l_orderkey, symbol, home FROM s JOIN words ON p_partkey = l_partkey JOIN d USING (symbol)),
c AS (SELECT u.l_orderkey, count(*) AS referenced, count(s.l_partkey) AS satisfied FROM u LEFT JOIN s ON s.l_orderkey = u.l_orderkey AND s.l_partkey = u.home GROUP BY 1)
SELECT o.l_orderkey, coalesce(referenced, 0)::BIGINT AS referenced, coalesce(satisfied, 0)::BIGINT AS satisfied, coalesce(satisfied / referenced, 1.0)::DOUBLE AS sufficiency FROM (SELECT DISTINCT l_orderkey FROM s) o LEFT JOIN c USING (l_orderkey)
""")
def v43_sufficiency(spark, sf_dir):
    """V43 with an order's parts as selection and the words of their names as symbols; a word's home is the first part with it, and words with an odd one are unknown."""
    words = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.explode(F.split("p_name", " ")).alias("symbol"))
    homes = words.groupBy("symbol").agg(F.min("l_partkey").alias("l_partkey")).filter("l_partkey % 2 = 0")
    return behaviour.sufficiency(table(spark, sf_dir, "lineitem"), words, homes, "l_orderkey", "l_partkey", "symbol")


QUERY = "the source of old words in language, old and new: en web"
_SHUNNED = ", ".join(f"'{w}'" for w in ranking.PASSED_OVER)
_TERMS_SQL = lambda c: f"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\pL\\pN]+'), lambda x: strlen(x) > 1 AND x NOT IN ({_SHUNNED}))"


@register(f"""
WITH q AS (SELECT unnest({_TERMS_SQL("'" + QUERY + "'")}) AS t), d AS (SELECT doc_id, {_TERMS_SQL('lang')} AS e, {_TERMS_SQL('source')} AS h, {_TERMS_SQL('text')} AS b FROM documents),
w AS (SELECT doc_id, q.t, q.n, 3.0 * len(list_filter(e, lambda x: x = q.t)) + 2.0 * len(list_filter(h, lambda x: x = q.t)) + len(list_filter(b, lambda x: x = q.t))::DOUBLE / greatest(len(b), 1) AS w FROM d, (SELECT t, count(*) AS n FROM q GROUP BY t) q),
f AS (SELECT t, count(*) AS df FROM w WHERE w > 0 GROUP BY t)
SELECT doc_id, round(sum(n * w * greatest(ln((SELECT count(*) FROM documents) / df), 0.1)), 9) AS score FROM w JOIN f USING (t) WHERE w > 0 GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20
""")
def k3_fielded_search(spark, sf_dir):
    """K3 over all documents: language, source and text as entity, title and body."""
    terms = spark.range(1).select(ranking.search_terms(F.lit(QUERY)).alias("t")).first().t
    return ranking.fielded_search(table(spark, sf_dir, "documents"), "doc_id", "lang", "source", "text", terms, 20)


@register("""
WITH c AS (SELECT conv_id, turn, chr(27) || '[1;31m' || coalesce(text, '') || chr(27) || '[0m' || chr(13) || chr(8203) || chr(160) || 'x' AS t, rtrim(base64(encode(CASE WHEN turn % 2 = 0 THEN 'please Ignore all of it, ' ELSE '' END || coalesce(text, '') || repeat(' ', 40))), '=') AS p FROM conversations),
r AS (SELECT conv_id, turn, t, p || CASE WHEN conv_id % 3 = 0 THEN '' ELSE repeat('=', (4 - len(p) % 4) % 4) END AS p FROM c),
o AS (SELECT *, len(p) % 4 = 0 AND regexp_matches(lower(decode(from_base64(CASE WHEN len(p) % 4 = 0 THEN p ELSE '' END))), 'ignore|instruction|system|forget|disregard|override|you are|new role|bypass') AS hit FROM r)
SELECT conv_id, turn, replace(replace(replace(regexp_replace(t, '\\x1B\\[[0-9;]*[A-Za-z]', '', 'g'), chr(13), ''), chr(160), ' '), chr(8203), '') AS plain, hit::BIGINT AS payloads FROM o
""")
def f17_payloads(spark, sf_dir):
    """turns in colour, and turns as base64, a third of them without padding."""
    escape = F.lit("\x1b")
    text = F.coalesce("text", F.lit(""))
    packed = F.rtrim(F.replace(F.replace(F.base64(F.encode(F.concat(F.when(F.col("turn") % 2 == 0, "please Ignore all of it, ").otherwise(""), text, F.lit(" " * 40)), "UTF-8")), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("")), F.lit("="))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(escape, F.lit("[1;31m"), text, escape, F.lit("[0m\r​ x")).alias("t"), packed.alias("p"))
    whole = F.concat("p", F.when(F.col("conv_id") % 3 == 0, "").otherwise(F.repeat(F.lit("="), (4 - F.length("p") % 4) % 4)))
    return turns.select("conv_id", "turn", rewriting.without_escapes(F.col("t")).alias("plain"), F.size(rewriting.encoded_orders(F.concat(F.lit("see "), whole, F.lit(" end")))).cast("long").alias("payloads"))


@register("""
SELECT o_orderkey, CASE label WHEN 'contradicted' THEN true WHEN 'unsupported' THEN profile NOT IN ('chat', 'dialogue') WHEN 'unknown' THEN profile IN ('code', 'rag', 'qa', 'benchmark_qa') OR risk >= 0.75 ELSE false END AS suppressed
FROM (SELECT o_orderkey, ['grounded', 'contradicted', 'unsupported', 'unknown'][o_orderkey % 4 + 1] AS label, ['chat', 'rag', 'code', 'dialogue', 'auto'][o_custkey % 5 + 1] AS profile, o_totalprice / 300000 AS risk FROM orders)
""")
def f41_suppressed(spark, sf_dir):
    pick = lambda key, *names: F.element_at(F.array(*map(F.lit, names)), (F.col(key) % len(names) + 1).cast("int"))
    label, profile = pick("o_orderkey", "grounded", "contradicted", "unsupported", "unknown"), pick("o_custkey", "chat", "rag", "code", "dialogue", "auto")
    return table(spark, sf_dir, "orders").select("o_orderkey", claims.suppressed(label, F.col("o_totalprice") / 300000, profile).alias("suppressed"))


RUNS = ("python -m pytest -q", "npm run test", "cargo build --release", "npx tsc -p .", "npx tsc --noEmit -p .", "make test", "make all", "golangci-lint run", "npx eslint src", "black --check .", "ls -la", "[proxy:lint/style]", "[proxy:chat]", "mypy src", "g++x main.c", "cargo fmt")
OUTPUTS = ("", "3 passed in 0.1s", "1 failed, 2 passed", "Error: no such file", "Build succeeded", "All tests passed\nOK ")


def _pattern_sql(pattern: str) -> str:
    """SQL's patterns can't look ahead."""
    if "(?!" not in pattern:
        return f"regexp_matches(c, '{pattern}')"
    word, after = pattern.rstrip(")").split("(?!")
    return f"regexp_matches(regexp_replace(c, '{word}{after}', '', 'g'), '{word}')"


_LISTS_SQL = ["[" + ", ".join(f"'{v}'" for v in values) + "]" for values in (RUNS, OUTPUTS)]


@register(f"""
WITH o AS (SELECT o_orderkey, {_LISTS_SQL[0]}[o_orderkey % {len(RUNS)} + 1] AS c, o_custkey % 7 AS x, {_LISTS_SQL[1]}[o_orderkey // 16 % {len(OUTPUTS)} + 1] AS t FROM orders),
k AS (SELECT *, starts_with(c, '[proxy:') AS p, regexp_replace(substr(c, 8), '\\]$', '') AS a, CASE {' '.join(f"WHEN {_pattern_sql(p)} THEN '{kind}:{tool}'" for p, kind, tool in outcomes.COMMANDS)} END AS f,
  regexp_matches(t, '{outcomes.FAILED}') AS bad, regexp_matches(t, '{outcomes.PASSED}') AS good FROM o),
v AS (SELECT *, CASE WHEN p THEN CASE WHEN string_split(a, '/')[1] IN ('test', 'build', 'lint', 'typecheck', 'format') THEN string_split(a, '/')[1] ELSE 'other' END ELSE string_split(f, ':')[1] END AS category, CASE WHEN p THEN a ELSE string_split(f, ':')[2] END AS tool FROM k),
w AS (SELECT *, CASE WHEN category IS NULL THEN NULL WHEN x = 0 THEN 'pass' WHEN x IN (4, 5) AND category = 'test' AND NOT p THEN 'unknown' ELSE 'fail' END AS verdict FROM v)
SELECT o_orderkey, category, tool, verdict, CASE WHEN category IS NULL THEN NULL WHEN p THEN 0.4 WHEN bad AND NOT good THEN CASE WHEN verdict = 'pass' THEN 0.4 ELSE 0.95 END WHEN good AND NOT bad THEN CASE WHEN verdict = 'fail' THEN 0.4 ELSE 0.95 END ELSE 0.85 END::DOUBLE AS confidence FROM w
""")
def f34_command_outcomes(spark, sf_dir):
    key = F.col("o_orderkey")
    command = F.element_at(F.array(*map(F.lit, RUNS)), (key % len(RUNS) + 1).cast("int"))
    output = F.element_at(F.array(*map(F.lit, OUTPUTS)), (F.floor(key / 16) % len(OUTPUTS) + 1).cast("int"))
    judged = table(spark, sf_dir, "orders").select("o_orderkey", command.alias("c"), (F.col("o_custkey") % 7).alias("x"), output.alias("t"))
    return judged.select("o_orderkey", outcomes.outcome(F.col("c"), F.col("x"), F.col("t")).alias("o")).select("o_orderkey", "o.category", "o.tool", "o.verdict", "o.confidence")


@register("""
WITH m AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), s AS (SELECT p_partkey, greatest(1, p_size // 10) AS depth FROM part WHERE p_size % 4 = 0),
c AS (SELECT l_orderkey, count(*) AS n, sum(1.0::DOUBLE / depth) AS overlap FROM m LEFT JOIN s ON p_partkey = l_partkey GROUP BY 1)
SELECT o_orderkey AS entry, o_totalprice * CASE WHEN overlap > 0 THEN pow(2, -overlap / n) * CASE WHEN o_custkey % 5 + 1 > 3 THEN 0.5 ELSE 1 END ELSE 1 END::DOUBLE AS quality, (o_custkey % 5 + CASE WHEN overlap > 0 THEN 1 ELSE 0 END)::BIGINT AS cascades, coalesce(overlap > 0, false) AS affected
FROM orders LEFT JOIN c ON l_orderkey = o_orderkey
""")
def i7_invalidated(spark, sf_dir):
    """I7 with orders as entries and their parts as fragments."""
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry"), F.col("o_totalprice").alias("quality"), (F.col("o_custkey") % 5).alias("cascades"))
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entry"), F.col("l_partkey").alias("fragment"))
    stale = table(spark, sf_dir, "part").filter("p_size % 4 = 0").select(F.col("p_partkey").alias("fragment"), F.floor(F.col("p_size") / 10).alias("depth"))
    return graph.invalidated(entries, members, stale)


@register("""
WITH a AS (SELECT unnest(['FRANCE', 'JAPAN', 'ATLANTIS']) AS n UNION ALL SELECT n_name FROM nation WHERE n_nationkey % 7 = 0), f AS (SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
g AS (SELECT s_suppkey FROM f WHERE n_name IN (SELECT n FROM a))
SELECT 'fragments' AS part, count(*) AS n FROM f WHERE s_suppkey NOT IN (SELECT s_suppkey FROM g) UNION ALL SELECT 'lines', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM g) UNION ALL SELECT 'missing', count(DISTINCT n) FROM a WHERE n NOT IN (SELECT n_name FROM f)
""")
def u9_without_sources(spark, sf_dir):
    """U9 with suppliers as fragments of their nation and lines as derived rows."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    fragments = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name")
    requested = spark.createDataFrame([("FRANCE",), ("JAPAN",), ("ATLANTIS",)], "n_name string").unionByName(nations.filter("n_nationkey % 7 = 0").select("n_name"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"))
    kept, derived, missing = graph.without_sources(fragments, requested, "n_name", "s_suppkey", {"lines": lines})
    count = lambda rows, part: rows.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"))
    return count(kept, "fragments").unionByName(count(derived["lines"], "lines")).unionByName(count(missing, "missing"))
