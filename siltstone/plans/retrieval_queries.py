"""Queries that expand questions and rank files for them, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import retrieval
from siltstone.operators import files
from siltstone.plans.registry import register, table
from siltstone.streaming import deliveries

QUESTION = "How are incoming request records converted and stored by the repository?"

#: Folders and names of files, of which each document gets one.
PATHS = (
    "app/src/services/orderMapper.ts", "app/src/components/OrderView.tsx", "tests/repository_test.py", "web/dist/records.min.js", "pkg/store/repository.go",
    "docs/notes.md", "db/migrations/0001_records.sql", "core\\handlers\\requestHandler.cs", "lib/.env", "README",
)

#: Lines of code, of which each document gets one.
LINES = (
    "x = convertRowToRecord(row)", "return parseRequest(body)", "await saveOrder(order)", "INSERT INTO orders VALUES (1)", "class OrderRecord:", "select *\n from stored_records",
    "HTTPServerError2xx", "let requests = incoming_requests", "print(total)",
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list_sql(words) -> str:
    return "[" + ", ".join(map(_quoted, words)) + "]"


def _stem_sql(w: str) -> str:
    n, less = f"strlen({w})", lambda k: f"left({w}, length({w}) - {k})"
    cases = [
        (f"{n} >= 6 AND suffix({w}, 'ies')", f"{less(3)} || 'y'"), (f"{n} >= 6 AND regexp_matches({w}, '(s|x|z|ch|sh)es\\z')", less(2)), (f"{n} >= 7 AND suffix({w}, 'ing')", less(3)), (f"{n} >= 6 AND suffix({w}, 'ed')", less(2)),
        (f"{n} >= 5 AND suffix({w}, 's') AND NOT suffix({w}, 'ss') AND NOT suffix({w}, 'us')", less(1)), (f"{n} >= 6 AND suffix({w}, 'e') AND NOT suffix({w}, 'ee')", less(1)),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + " END"


def _tokens_sql(text: str) -> str:
    """Terms of a text without characters of unspaced scripts, which no table has."""
    camel = r"regexp_extract_all(regexp_replace(t, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '[0-9]+|[A-Z][a-z]+|[A-Z]+|[a-z]+')"
    pieces = f"list_distinct([lower(t)] || list_filter(string_split(lower(t), '_') || list_transform({camel}, lambda c: lower(c)), lambda c: length(c) > 2))"
    parts = f"list_distinct(flatten(list_transform({pieces}, lambda p: [p, {_stem_sql('p')}])))"
    return f"list_filter(flatten(list_transform(regexp_extract_all({text}, '[A-Za-z_][A-Za-z0-9_]{{2,}}'), lambda t: {parts})), lambda p: p NOT IN {tuple(retrieval.STOP_WORDS)})"


def _root_sql(w: str) -> str:
    return "CASE " + " ".join(f"WHEN suffix({w}, '{e}') AND length({w}) >= {len(e) + 3} THEN left({w}, length({w}) - {len(e)}) || '{i}'" for e, i in retrieval.ENDINGS) + f" ELSE {w} END"


_CLUSTERS_SQL = "clusters AS (" + " UNION ALL ".join(f"SELECT {_quoted(n)} AS name, {_list_sql(w)} AS words, {_list_sql(retrieval.LINKS[n])} AS linked" for n, w in retrieval.CLUSTERS.items()) + ")"


def _expanded_sql(rows: str) -> str:
    """known and wide of rows (key, base): subjects of each, and its terms with theirs."""
    return f"""{_CLUSTERS_SQL}, known AS (SELECT key, name, words, linked FROM {rows}, clusters WHERE list_has_any(list_transform(base, lambda w: {_root_sql("w")}), list_transform(words, lambda w: {_root_sql("w")}))),
wide AS (SELECT key, unnest(base) AS term FROM {rows} UNION SELECT key, unnest(words) FROM known UNION SELECT k.key, unnest(c.words) FROM (SELECT key, unnest(linked) AS name FROM known) k JOIN clusters c USING (name))"""


_TURN_SQL = f"""turns AS (SELECT conv_id, turn, concat(coalesce(text, ''), ' ', {_list_sql(w for words in retrieval.CLUSTERS.values() for w in words)}[((conv_id * 7 + turn) % {sum(map(len, retrieval.CLUSTERS.values())) * 3} + 1)::INT]) AS text FROM conversations),
r AS (SELECT conv_id, turn, struct_pack(c := conv_id, t := turn) AS key, list_distinct(list_filter({_tokens_sql("text")}, lambda w: length(w) > 2)) AS base FROM turns)"""


@register(f"""WITH {_TURN_SQL}, {_expanded_sql("r")} SELECT conv_id, turn, coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM known WHERE known.key = r.key), '') AS about, (SELECT count(*) FROM wide WHERE wide.key = r.key) AS n, md5(coalesce((SELECT string_agg(term, ',' ORDER BY term) FROM wide WHERE wide.key = r.key), '')) AS terms FROM r""")
def x26_expanded_queries(spark, sf_dir):
    """Turns of conversations as queries, a third of them with a word of a subject."""
    words = [w for group in retrieval.CLUSTERS.values() for w in group]
    place = ((F.col("conv_id") * 7 + F.col("turn")) % (len(words) * 3) + 1).cast("int")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.coalesce(F.get(F.array(*map(F.lit, words)), place - 1), F.lit("")))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))
    found = turns.select("conv_id", "turn", F.array_sort(retrieval.subjects(retrieval.query_tokens(F.col("text")))).alias("about"), retrieval.expand_query(F.col("text")).alias("terms"))
    return found.select("conv_id", "turn", F.array_join("about", ",").alias("about"), F.size("terms").cast("long").alias("n"), F.md5(F.array_join("terms", ",")).alias("terms"))


def _files(spark, sf_dir):
    """Documents, each with a line of code and the path of a file."""
    one = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", one(PATHS, F.col("doc_id")).alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), one(LINES, F.col("doc_id"))).alias("text"))


_MARK = lambda name, hit: f"CASE WHEN {hit} THEN {retrieval.WEIGHTS[name]} ELSE 0 END"
_MARKS_SQL = " + ".join([
    _MARK("source_dir", f"regexp_matches(low, {_quoted(retrieval.SOURCE_PATH)})"),
    _MARK("test_penalty", f"NOT tests AND regexp_matches(low, {_quoted(retrieval.TEST_PATH)})"),
    _MARK("generated_penalty", f"NOT tests AND regexp_matches(low, {_quoted(retrieval.GENERATED_PATH)})"),
    _MARK("logic_dir_intent", f"len(about) > 0 AND regexp_matches(low, {_quoted(retrieval.LOGIC_PATH)})"),
    _MARK("ui_penalty_for_logic", f"len(about) > 0 AND regexp_matches(low, {_quoted(retrieval.VIEW_PATH)})"),
    _MARK("basename_hit", "list_has_any(named, terms)"),
    _MARK("defines_mapper", f"list_has_any(about, ['mapping', 'schema']) AND regexp_matches(text, {_quoted(retrieval.MAPPER)})"),
    _MARK("defines_transform", f"list_has_any(about, ['mapping', 'ingest']) AND regexp_matches(text, {_quoted(retrieval.TRANSFORM)})"),
    _MARK("defines_persistence", f"list_has_any(about, ['persistence', 'ingest']) AND (regexp_matches(text, {_quoted(retrieval.PERSIST)}) OR regexp_matches(text, {_quoted(retrieval.SQL_TEXT)}))"),
    _MARK("defines_schema_type", f"list_has_any(about, ['schema', 'mapping', 'persistence']) AND regexp_matches(text, {_quoted(retrieval.SCHEMA_TYPE)})"),
])

_FILES_SQL = f"""files AS (SELECT doc_id, {_list_sql(PATHS)}[(doc_id % {len(PATHS)} + 1)::INT] AS path, concat(coalesce(text, ''), chr(10), {_list_sql(LINES)}[(doc_id % {len(LINES)} + 1)::INT]) AS text FROM documents),
asked AS (SELECT 1 AS key, list_distinct(list_filter({_tokens_sql(_quoted(QUESTION))}, lambda w: length(w) > 2)) AS base), {_expanded_sql("asked")},
q AS (SELECT base, (SELECT list(term) FROM wide) AS terms, (SELECT list(name) FROM known) AS about, list_has_any(base, {_list_sql(retrieval.TEST_WORDS)}) AS tests FROM asked),
parts AS (SELECT doc_id, path, replace(lower(path), chr(92), '/') AS low, text, {_tokens_sql("text")} AS w, {_tokens_sql("replace(path, chr(92), '/')")} AS p FROM files),
named AS (SELECT doc_id, {_tokens_sql("regexp_replace(regexp_extract(low, '[^/]*$'), '[.][^.]*$', '')")} AS named FROM parts),
marked AS (SELECT doc_id, path, w, p, {_MARKS_SQL} AS marks FROM parts JOIN named USING (doc_id), q),
totals AS (SELECT count(*) AS n, greatest(1, avg(len(w))) AS aw, greatest(1, avg(len(p))) AS ap FROM parts),
tf AS (SELECT doc_id, term, sum(f) FILTER (field = 'w') AS wf, sum(f) FILTER (field = 'p') AS pf FROM (SELECT doc_id, 'w' AS field, unnest(w) AS term, 1 AS f FROM parts UNION ALL SELECT doc_id, 'p', unnest(p), 1 FROM parts) WHERE term IN (SELECT term FROM wide) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
worth AS (SELECT doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, coalesce(wf, 0) / (1 - {files.TEXT_B} + {files.TEXT_B} * len(w) / aw) + {files.PATH_WEIGHT} * coalesce(pf, 0) / (1 - {files.PATH_B} + {files.PATH_B} * len(p) / ap) AS f FROM tf JOIN df USING (term) JOIN parts USING (doc_id), totals),
sums AS (SELECT doc_id, coalesce(sum(x) FILTER (own), 0) AS own, coalesce(sum(x) FILTER (NOT own), 0) AS more FROM (SELECT doc_id, list_contains(base, term) AS own, idf * f * {files.K1 + 1} / (f + {files.K1}) AS x FROM worth, q) GROUP BY 1),
raw AS (SELECT doc_id, path, marks, coalesce(own + {retrieval.WEIGHTS["rank_expansion_weight"]} * more / (1 + more), 0) AS raw FROM marked LEFT JOIN sums USING (doc_id))"""


@register(f"WITH {_FILES_SQL} SELECT doc_id, path, round(coalesce(raw / nullif((SELECT max(raw) FROM raw), 0), 0), 6) AS relevance, round(marks, 6) AS marks, round(coalesce(raw / nullif((SELECT max(raw) FROM raw), 0), 0) + marks, 6) AS score FROM raw")
def k4_ranked_files(spark, sf_dir):
    """Documents as files, each with a line of code, for one question."""
    found = files.rank_files(_files(spark, sf_dir), QUESTION, "doc_id", "path", "text")
    return found.select("doc_id", "path", *(F.round(c, 6).alias(c) for c in ("relevance", "marks", "score")))


@register(f"""WITH RECURSIVE t AS (SELECT concat(user_id, '-', month(ts)) AS delivery, event_id, epoch(ts) AS sec, CASE WHEN event_id % 11 = 0 THEN -1.0 WHEN event_id % 3 = 0 THEN -2.0 WHEN event_id % 5 = 0 THEN greatest(0, coalesce(value, 0)) ELSE 0 END AS v FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY delivery ORDER BY event_id) AS n FROM t),
r AS (SELECT DISTINCT delivery, 0::BIGINT AS event_id, 0::BIGINT AS n, 'pending' AS state, 0 AS attempts, false AS changed, 0::DOUBLE AS sec, 0::DOUBLE AS v FROM o
  UNION ALL SELECT o.delivery, o.event_id, o.n, CASE WHEN state = 'pending' AND o.v = -1 THEN 'delivered' WHEN state = 'pending' AND o.v >= 0 AND attempts >= 3 THEN 'dead' WHEN state = 'dead' AND o.v = -2 THEN 'pending' ELSE state END,
  CASE WHEN state = 'pending' AND o.v >= -1 THEN attempts + 1 WHEN state = 'dead' AND o.v = -2 THEN 0 ELSE attempts END, (state = 'pending' AND o.v >= -1) OR (state = 'dead' AND o.v = -2), o.sec, o.v FROM r JOIN o ON o.delivery = r.delivery AND o.n = r.n + 1)
SELECT delivery, event_id, state, attempts, changed, CASE WHEN changed AND state = 'pending' THEN round(sec + CASE WHEN attempts > 0 THEN greatest(least(60, 5 * 2 ** (attempts - 1)) * ({deliveries.LEAST_SHARE} + {deliveries.CHANCE} * ('0x' || left(sha256(concat(delivery, ':', attempts)), 8))::BIGINT / 4294967295), least(60, v)) ELSE 0 END, 3) END AS next_attempt_at FROM r WHERE n > 0""")
def t9_deliveries(spark, sf_dir):
    """Events of each user and month as tries of one delivery, four at most."""
    k = F.col("event_id")
    kind = F.when(k % 11 == 0, "sent").when(k % 3 == 0, "revived").otherwise("failed")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    tries = table(spark, sf_dir, "events").select(F.concat(F.col("user_id").cast("string"), F.lit("-"), F.month("ts").cast("string")).alias("delivery"), "event_id", at.alias("at"), kind.alias("kind"), F.when(k % 5 == 0, F.col("value")).alias("retry_after"))
    found = deliveries.outcomes(tries, "delivery", "event_id", max_attempts=4, base_delay=5.0, max_delay=60.0)
    return found.withColumn("next_attempt_at", F.round("next_attempt_at", 3))
