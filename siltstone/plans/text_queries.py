"""Queries of the text, code and claim functions, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.functions import claims, code, fingerprints, signals
from siltstone.functions import text as tx
from siltstone.operators import ranking
from siltstone.plans.registry import register, table

_CODE_QUERY = "thand pours nichtSource src2 HTMLParser"


def _names(words: tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _stem_sql(w: str) -> str:
    less = lambda k: f"left({w}, length({w}) - {k})"
    return (
        f"CASE WHEN strlen({w}) >= 6 AND suffix({w}, 'ies') THEN {less(3)} || 'y' WHEN strlen({w}) >= 6 AND regexp_matches({w}, '(s|x|z|ch|sh)es$') THEN {less(2)} "
        f"WHEN strlen({w}) >= 7 AND suffix({w}, 'ing') THEN {less(3)} WHEN strlen({w}) >= 6 AND suffix({w}, 'ed') THEN {less(2)} "
        f"WHEN strlen({w}) >= 5 AND suffix({w}, 's') AND NOT suffix({w}, 'ss') AND NOT suffix({w}, 'us') THEN {less(1)} WHEN strlen({w}) >= 6 AND suffix({w}, 'e') AND NOT suffix({w}, 'ee') THEN {less(1)} END"
    )


def _parts_sql(w: str) -> str:
    return f"list_transform(list_filter(string_split(regexp_replace(regexp_replace({w}, '([^\\p{{Lu}}_])(\\p{{Lu}})', '\\1_\\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1_\\2', 'g'), '_'), lambda p: p <> ''), lambda p: lower(p))"


def _both_sql(w: str) -> str:
    return f"list_filter([{_stem_sql(w)}, {w}], lambda y: y IS NOT NULL)"


def _code_tokens_sql(text: str) -> str:
    stops = _names(code.CODE_STOP_WORDS)
    more = f"flatten(list_transform(list_filter({_parts_sql('w')}, lambda p: strlen(p) >= 2 AND p NOT IN ({stops})), lambda q: {_both_sql('q')}))"
    return (
        f"flatten(list_transform(list_filter(regexp_extract_all(coalesce({text}, ''), '[\\pL\\pN_]+'), lambda w: strlen(w) >= 2 AND lower(w) NOT IN ({stops})), "
        f"lambda w: CASE WHEN len({_parts_sql('w')}) > 1 THEN list_concat({_both_sql('lower(w)')}, {more}) ELSE {_both_sql('lower(w)')} END))"
    )


def _path_tokens_sql(path: str) -> str:
    return f"list_filter(list_transform(list_filter(regexp_split_to_array(coalesce({path}, ''), '[/\\\\.\\-_]'), lambda p: strlen(p) >= 2), lambda p: lower(p)), lambda p: p NOT IN ({_names(code.PATH_STOP_WORDS)}))"


def _identifiers_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(coalesce({text}, ''), '[\\pL\\pN_]+'), lambda w: strlen(w) > 1 AND w NOT IN ({_names(code.KEYWORDS)}))"


#: Lines of code made of a part's columns, the same in Spark and in SQL.
_CODE_SQL = "concat('def ', replace(p_name, ' ', '_'), 'HTMLParser(', p_brand, '): return charged_', replace(p_type, ' ', ''), 'Boxes ', p_partkey, 'Queries')"


def _code_text():
    return F.concat(F.lit("def "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("HTMLParser("), F.col("p_brand"), F.lit("): return charged_"), F.replace("p_type", F.lit(" "), F.lit("")), F.lit("Boxes "), F.col("p_partkey").cast("string"), F.lit("Queries"))


@register(f"""
WITH t AS (SELECT p_partkey, {_CODE_SQL} AS t FROM part)
SELECT p_partkey, array_to_string({_code_tokens_sql("t")}, ' ') AS terms, array_to_string({_identifiers_sql("t")}, ' ') AS identifiers,
  array_to_string({_path_tokens_sql("concat('src/', t, '/Main_file.PY')")}, ' ') AS path_terms FROM t
""")
def x21_code_tokens(spark, sf_dir):
    """X11, X21, X22, X23 and X24."""
    t = table(spark, sf_dir, "part").select("p_partkey", _code_text().alias("t"))
    path = F.concat(F.lit("src/"), F.col("t"), F.lit("/Main_file.PY"))
    return t.select("p_partkey", F.array_join(code.code_tokens(F.col("t")), " ").alias("terms"), F.array_join(code.identifiers(F.col("t")), " ").alias("identifiers"), F.array_join(code.path_tokens(path), " ").alias("path_terms"))


@register(f"""
WITH d AS (SELECT doc_id, lower(source) AS path, {_path_tokens_sql("source")} AS pt, lower(regexp_extract(source, '([^/\\\\]*)\\.[^./\\\\]*$', 1)) AS fs, {_code_tokens_sql("text")} AS w,
  list_distinct(flatten(list_transform({_identifiers_sql("text")}, lambda z: {_parts_sql("z")}))) AS ids FROM documents),
q AS (SELECT unnest(range(1, len(t) + 1)) AS i, unnest(t) AS t FROM (SELECT {_code_tokens_sql(f"'{_CODE_QUERY}'")} AS t)),
s AS (SELECT doc_id, i, len(list_filter(w, lambda x: x = t)) AS tf, len(w) AS dl, contains(path, t) OR list_contains(pt, t) AS in_path, list_contains(pt, t) AS ptc, fs = t AS named, list_has_any(ids, {_parts_sql("t")}) AS in_ids FROM d, q),
st AS (SELECT i, count(*) AS n, greatest(avg(dl), 1.0) AS avgdl, count_if(tf > 0 OR ptc) AS df FROM s GROUP BY i),
x AS (SELECT s.*, avgdl, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM s JOIN st USING (i)),
f AS (SELECT doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS base, sum(idf * (8.0 * in_path::INT + 12.0 * named::INT)) AS path, sum(idf * 3.0 * in_ids::INT) AS ids,
  count_if(tf > 0 OR in_path OR in_ids) / count(*) AS cov FROM x GROUP BY doc_id)
SELECT doc_id AS id, round(cov, 6) AS coverage, round(base, 6) AS base, round(path, 6) AS path_boost, round(ids, 6) AS identifier_boost, round(base * (1 + 1.5 * cov ** 3) + path + ids, 6) AS score FROM f
""")
def x20_code_bm25(spark, sf_dir):
    found = ranking.code_bm25(table(spark, sf_dir, "documents"), _CODE_QUERY)
    return found.select("id", *(F.round(c, 6).alias(c) for c in ("coverage", "base", "path_boost", "identifier_boost", "score")))


_BOILER_SQL = f"(x IN ({_names(code.BOILERPLATE_LINES)}) OR " + " OR ".join("starts_with(x, '" + s.replace("'", "''") + "')" for s in code.BOILERPLATE_STARTS) + " OR (starts_with(x, 'def __') AND contains(x, '__(')) OR (starts_with(x, 'package ') AND NOT contains(x, '{')))"


@register(f"""
WITH t AS (SELECT page_id, concat(coalesce(html, ''), chr(10), 'import x', chr(10), CASE page_id % 3 WHEN 0 THEN concat('  }}', chr(10), 'return nil', chr(10)) WHEN 1 THEN 'name: a' ELSE 'package b {{' END) AS t FROM pages),
l AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(t, '\\r?\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM t)
SELECT page_id, round(CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: {_BOILER_SQL})) / len(l) ELSE 1 END, 6) AS ratio FROM l
""")
def x8_boilerplate_ratio(spark, sf_dir):
    """X8 and F28."""
    pages = table(spark, sf_dir, "pages")
    tail = F.when(F.col("page_id") % 3 == 0, "  }\nreturn nil\n").when(F.col("page_id") % 3 == 1, "name: a").otherwise("package b {")
    return pages.select("page_id", F.round(code.boilerplate_ratio(F.concat(F.coalesce("html", F.lit("")), F.lit("\nimport x\n"), tail)), 6).alias("ratio"))


def _weights_sql() -> str:
    cases = []
    for weight, ends in code.SOURCE_WEIGHTS:
        extra = "contains(p, 'dockerfile') OR " if weight == 0.40 else ""
        cases.append(f"WHEN {extra}" + " OR ".join(f"suffix(p, '{e}')" for e in ends) + f" THEN {weight}")
    return "CASE " + " ".join(cases) + " ELSE 0.55 END"


def _layers_sql() -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(p, '{w}')" for w in words) + f" THEN '{name}'" for name, words in code.LAYERS) + " END"


_ENDS = (".py", ".yaml", "/Dockerfile", ".sql", ".html", ".md", "/handler.go", ".bin")


@register(f"""
WITH t AS (SELECT p_partkey, lower(concat(p_name, '/', p_type, [{_names(_ENDS)}][p_partkey % {len(_ENDS)} + 1])) AS p FROM part)
SELECT p_partkey, CAST({_weights_sql()} AS DOUBLE) AS weight, {_layers_sql()} AS layer FROM t
""")
def f29_sources(spark, sf_dir):
    """F29 and F30."""
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("p_partkey") % len(_ENDS) + 1).cast("int"))
    path = F.concat("p_name", F.lit("/"), "p_type", end)
    return table(spark, sf_dir, "part").select("p_partkey", code.source_weight(path).cast("double").alias("weight"), code.layer(path).alias("layer"))


_SPACED = "list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> '')"
_TURNS = "SELECT conv_id, turn, coalesce(text, '') AS c, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS e FROM conversations"


def _entities_sql(t: str) -> str:
    return f"list_distinct(list_filter(list_transform({_SPACED.format(t)}, lambda w: regexp_replace(w, '[^\\pL\\pN_-]', '', 'g')), lambda w: (regexp_matches(w, '^\\p{{Lu}}') AND strlen(w) > 1) OR regexp_matches(w, '^[0-9]')))"


def _turns(spark, sf_dir):
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("c"), before.alias("e"))


@register(f"""
WITH t AS ({_TURNS}), w AS (SELECT conv_id, turn, c, {_SPACED.format("lower(c)")} AS w, list_distinct({_SPACED.format("lower(e)")}) AS k, {_entities_sql("c")} AS ce, list_transform({_entities_sql("e")}, lambda x: lower(x)) AS ee,
  list_distinct(list_transform(list_filter({_SPACED.format("c")}, lambda x: regexp_matches(x, '^\\p{{Lu}}')), lambda x: lower(x))) AS n FROM t),
p AS (SELECT conv_id, turn, list_sum(list_transform(list_distinct(w), lambda x: -len(list_filter(w, lambda y: y = x)) / len(w) * log2(len(list_filter(w, lambda y: y = x)) / len(w)))) AS h FROM w)
SELECT conv_id, turn, round(CASE WHEN len(w) = 0 THEN 1 ELSE greatest(0, least(1, len(list_intersect(list_distinct(w), k)) / len(list_distinct(w)) - 0.1 * len(list_filter(n, lambda x: NOT list_contains(k, x))))) END, 6) AS recognition,
  round(CASE WHEN len(ce) = 0 THEN 1 ELSE len(list_filter(ce, lambda x: list_contains(ee, lower(x)))) / len(ce) END, 6) AS entity_overlap,
  round(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(0, least(1, least(1, h / greatest(log2(len(list_distinct(w))), 1)) * (1 - len(list_filter(w, lambda x: list_contains(k, x))) / len(w)))) END, 6) AS novel_entropy
FROM w JOIN p USING (conv_id, turn)
""")
def x35_claims(spark, sf_dir):
    """Each turn as a claim, the turn before it as evidence."""
    c, e = F.col("c"), F.col("e")
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(claims.recognition(c, e), 6).alias("recognition"), F.round(claims.entity_overlap(c, e), 6).alias("entity_overlap"), F.round(claims.novel_entropy(c, e), 6).alias("novel_entropy"))


def _tri_sql(t: str) -> str:
    w = f"list_filter(list_transform({_SPACED.format(f'lower({t})')}, lambda x: regexp_replace(x, '^[^\\pL\\pN_]+|[^\\pL\\pN_]+$', '', 'g')), lambda x: x <> '')"
    return f"(SELECT list_distinct(list_transform(range(1, len(v) - 1), lambda i: array_to_string(v[i:i + 2], chr(1)))) FROM (SELECT {w} AS v))"


@register(f"""
WITH t AS ({_TURNS}), g AS (SELECT conv_id, turn, {_tri_sql("c")} AS a, {_tri_sql("e")} AS b, list_distinct({_identifiers_sql("c")}) AS i, list_distinct({_identifiers_sql("e")}) AS j FROM t),
s AS (SELECT conv_id, turn, CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END AS g, CASE WHEN len(i) > 0 THEN len(list_intersect(i, j)) / len(i) ELSE 0 END AS n FROM g)
SELECT conv_id, turn, round(g, 3) AS trigrams, round(n, 3) AS identifiers, round(0.4 * g + 0.6 * n, 3) AS combined, 0.4 * g + 0.6 * n > 0.1 AS was_used FROM s
""")
def x34_utilization(spark, sf_dir):
    """How much of each turn the turn before it has."""
    grams, names, both = claims.used_share(F.col("c"), F.col("e"))
    t = _turns(spark, sf_dir).select("conv_id", "turn", grams.alias("g"), names.alias("n"), both.alias("b"))
    return t.select("conv_id", "turn", F.round("g", 3).alias("trigrams"), F.round("n", 3).alias("identifiers"), F.round("b", 3).alias("combined"), (F.col("b") > 0.1).alias("was_used"))


@register("""
WITH u AS (SELECT conv_id, turn, round(combined, 3) AS c, combined > 0.1 AS used FROM (
  SELECT conv_id, turn, (turn % 7) / 20.0 AS combined FROM conversations))
SELECT conv_id, count(*) AS injected, count_if(used) AS used, count(*) - count_if(used) AS ignored, round(sum(c) / count(*), 3) AS utilization FROM u GROUP BY 1
""")
def a25_utilization_totals(spark, sf_dir):
    """A25 on made-up scores."""
    scored = table(spark, sf_dir, "conversations").select("conv_id", ((F.col("turn") % 7) / 20.0).alias("combined"))
    used = F.count_if(F.col("combined") > 0.1)
    return scored.groupBy("conv_id").agg(F.count(F.lit(1)).alias("injected"), used.alias("used"), (F.count(F.lit(1)) - used).alias("ignored"), F.round(F.sum(F.round("combined", 3)) / F.count(F.lit(1)), 3).alias("utilization"))


@register(r"""
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(regexp_replace(coalesce(text, ''), '[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]', '_', 'g'), '\b[A-Z][a-z]{2,}\b|\b\d+(?:[.,]\d+)*\b|[''"]([^''"]{2,40})[''"]'), lambda x: lower(regexp_replace(x, '^[''"]|[''"]$', '', 'g'))))), '|') AS entities FROM conversations
""")
def x29_query_entities(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(claims.query_entities(F.col("text")), "|").alias("entities"))


@register(r"""
WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), '(\n\n|;\n|\}\n)', '\1' || chr(1), 'g'), chr(1) || '+', chr(1), 'g') AS t FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 20) AS s FROM m)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n, sha256(array_to_string(s, chr(1))) AS sentences FROM s
""")
def x28_sentences(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", claims.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.sha2(F.array_join("s", "\x01"), 256).alias("sentences"))


def _any_sql(column: str, needles: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{n}')" for n in needles) + ")"


def _learning_sql() -> str:
    return "CASE " + " ".join(f"WHEN list_has_any(w, [{_names(words)}]) THEN '{name}'" for name, words in signals.LEARNING_CLASSES) + " ELSE 'General' END"


_STOPS = _names(ranking.STOP_WORDS)
_ASK = "concat(text, ' ', ['fix the auth bug', 'add Redis cache', 'deploy', 'unit test of ParseTree', ''][turn % 5 + 1])"


@register(f"""
WITH t AS (SELECT conv_id, turn, [{_ASK}, 'fix it', 'Audit getUserById now'][turn % 3 + 1] AS q FROM conversations),
w AS (SELECT *, lower(q) AS low, list_filter(regexp_split_to_array(lower(q), '[^\\pL\\pN_]+'), lambda x: strlen(x) >= 2 AND x NOT IN ({_STOPS})) AS k FROM t),
v AS (SELECT *, len(list_filter(k, lambda x: {_any_sql("x", signals.GENERIC_VERBS)})) / len(k) * 0.5 + CASE WHEN len(k) < 3 THEN 0.7 WHEN len(k) < 5 THEN 0.4 WHEN len(k) < 7 THEN 0.15 ELSE 0 END * 0.3
  - least(0.4, len(list_filter(k, lambda x: {_any_sql("x", signals.SPECIFIC_WORDS)})) * 0.15 + CASE WHEN len(list_filter(regexp_split_to_array(q, '\\s+'), lambda x: strlen(x) > 4 AND regexp_matches(x, '\\p{{Lu}}') AND regexp_matches(x, '[^\\p{{Lu}}]'))) > 0 THEN 0.2 ELSE 0 END) * 0.7 AS raw FROM w)
SELECT conv_id, turn, CASE WHEN {_any_sql("low", signals.HIGH_RISK)} THEN 'High' WHEN {_any_sql("low", signals.MEDIUM_RISK)} THEN 'Medium' ELSE 'Low' END AS risk,
  {_learning_sql().replace("(w,", "(regexp_split_to_array(low, '[^\\pL\\pN_]+'),")} AS class, round(CASE WHEN len(k) = 0 THEN 1 ELSE greatest(0, least(1, raw)) END, 3)::DOUBLE AS vagueness FROM v
""")
def f11_query_classes(spark, sf_dir):
    """F9, F11 and F38."""
    turn = F.col("turn").cast("int")
    more = F.element_at(F.array(*map(F.lit, ("fix the auth bug", "add Redis cache", "deploy", "unit test of ParseTree", ""))), turn % 5 + 1)
    q = F.element_at(F.array(F.concat_ws(" ", "text", more), F.lit("fix it"), F.lit("Audit getUserById now")), turn % 3 + 1)
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", q.alias("q"))
    return t.select("conv_id", "turn", signals.risk_level(F.col("q")).alias("risk"), signals.learning_class(F.col("q")).alias("class"), signals.vagueness(ranking.query_terms(F.col("q")), F.col("q")).alias("vagueness"))


_BAD = [0x200B, 0x202E, 0x00AD, 0xFEFF]


@register(f"""
WITH t AS (SELECT doc_id, concat(text, [chr(8203), chr(8238), chr(173), chr(65279), ''][doc_id % 5 + 1], [chr(8203), ''][doc_id % 2 + 1]) AS t FROM documents)
SELECT doc_id, array_to_string(list_filter([{", ".join(f"CASE WHEN contains(t, chr({c})) THEN {c} END" for c in sorted(signals.DANGEROUS_CHARACTERS))}], lambda x: x IS NOT NULL), ',') AS found,
  CAST(greatest(CASE WHEN length(regexp_replace(t, '\\pL', '', 'g')) / greatest(strlen(t), 1) > 0.4 THEN trunc(strlen(t) / 5.0) ELSE trunc(strlen(t) / 4.0) END, 1) AS BIGINT) AS dense_tokens,
  CAST(greatest(1, len(regexp_extract_all(replace(t, '-', ' '), '[A-Za-z0-9][A-Za-z0-9_'']*'))) AS BIGINT) AS word_tokens FROM t
""")
def f15_characters_and_tokens(spark, sf_dir):
    """F1, F3 and F15."""
    pick = F.element_at(F.array(*(F.lit(chr(c)) for c in _BAD), F.lit("")), (F.col("doc_id") % 5 + 1).cast("int"))
    more = F.element_at(F.array(F.lit(chr(0x200B)), F.lit("")), (F.col("doc_id") % 2 + 1).cast("int"))
    t = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", pick, more).alias("t"))
    return t.select("doc_id", F.array_join(signals.dangerous_characters(F.col("t")).cast("array<string>"), ",").alias("found"), signals.dense_token_estimate(F.col("t")).alias("dense_tokens"), signals.word_token_estimate(F.col("t")).alias("word_tokens"))


def _simhash_sql() -> str:
    value = "('0x' || substr(m, {}, 8))::BIGINT"
    bits = "array_to_string(list_transform(range(63, -1, -1), lambda i: CASE WHEN 2 * list_sum(list_transform(CASE WHEN i < 32 THEN a ELSE b END, lambda v: (v >> CAST(24 - 8 * ((i % 32) // 8) + i % 8 AS INTEGER)) & 1)) > len(a) THEN '1' ELSE '0' END), '')"
    return f"""
WITH w AS (SELECT doc_id, list_filter(list_transform({_SPACED.format("coalesce(text, '')")}, lambda x: regexp_replace(x, '^[^\\pL\\pN_]+|[^\\pL\\pN_]+$', '', 'g')), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, list_transform(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: lower(array_to_string(w[i:i + 2], ' '))) ELSE list_transform(w, lambda x: lower(x)) END, lambda x: md5(x)) AS g FROM w),
h AS (SELECT doc_id, list_transform(g, lambda m: {value.format(1)}) AS a, list_transform(g, lambda m: {value.format(9)}) AS b FROM g)
SELECT doc_id, CASE WHEN len(a) = 0 THEN repeat('0', 64) ELSE {bits} END AS bits FROM h
"""


@register(_simhash_sql())
def x14_simhash(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", fingerprints.simhash("text").alias("f"))
    return found.select("doc_id", F.lpad(F.bin("f"), 64, "0").alias("bits"))


@register("""
WITH p AS (SELECT event_id, CAST(bit_count(xor(event_id, user_id)) AS BIGINT) AS d, event_id % 50 AS k FROM events), z AS (SELECT *, sqrt(-2 * ln(greatest(1e-12, least(0.5, 0.05 / greatest(k, 1))))) AS t FROM p)
SELECT event_id, round(greatest(0, least(1, cos(pi() * least(1, d / 64 + (t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)) * sqrt(d / 64 * (1 - d / 64) / 64))))), 6) AS bound FROM z
""")
def x17_cosine_bound(spark, sf_dir):
    d = signals.hamming(F.col("event_id"), F.col("user_id"))
    return table(spark, sf_dir, "events").select("event_id", F.round(signals.cosine_lower_bound(d, F.col("event_id") % 50, 0.05), 6).alias("bound"))


@register("""
WITH o AS (SELECT user_id, event_id, event_id * 7919 % 1000003 AS f FROM events), n AS (SELECT *, lag(f, 1) OVER w AS a, lag(f, 2) OVER w AS b, lag(f, 3) OVER w AS c FROM o WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, round(CASE WHEN f = 0 THEN 0.5 WHEN len(s) = 0 THEN 0.7 ELSE 1 - list_max(list_transform(s, lambda x: 1 - bit_count(xor(f, x)) / 64)) END, 6) AS uniqueness FROM (SELECT *, list_filter([a, b, c], lambda x: x IS NOT NULL AND x <> 0) AS s FROM n)
""")
def x33_uniqueness(spark, sf_dir):
    """Made-up fingerprints against the last three of the user."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") * 7919 % 1000003).alias("f"))
    e = e.withColumn("s", F.array_compact(F.array(*(F.lag("f", k).over(w) for k in (1, 2, 3)))))
    return e.select("event_id", F.round(signals.uniqueness(F.col("f"), F.col("s")), 6).alias("uniqueness"))


@register("""
SELECT p_partkey, round(0.85 * ((exp(2 * x) - 1) / (exp(2 * x) + 1)), 6) AS relevance,
  round(p_retailprice / 1000 + CASE WHEN p_partkey % 9 = 0 THEN 100 ELSE 0 END + CASE p_partkey % 4 WHEN 0 THEN 50 WHEN 1 THEN 30 WHEN 2 THEN 10 ELSE 0 END + least(p_size, 20), 6) AS priority
FROM (SELECT *, (0.4 * p_size / 50 + 0.6 * p_retailprice / 1000) / 1.0 * (0.5 + p_partkey % 3) / 0.85 AS x FROM part)
""")
def x30_relevance_and_priority(spark, sf_dir):
    """X30 and K23."""
    level = F.element_at(F.array(*map(F.lit, ("Safety", "Critical", "Important", "Normal"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    relevance = signals.blended_relevance([(F.col("p_size") / 50, 0.4), (F.col("p_retailprice") / 1000, 0.6)], 0.5 + F.col("p_partkey") % 3)
    priority = signals.ordering_priority(F.col("p_retailprice") / 1000, level, F.col("p_partkey") % 9 == 0, F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(relevance, 6).alias("relevance"), F.round(priority, 6).alias("priority"))


@register(f"""
WITH t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), i AS (SELECT conv_id, turn, list_distinct({_identifiers_sql("text")}) AS a, list_distinct({_identifiers_sql("n")}) AS b FROM t)
SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 6) AS likeness FROM i
""")
def u4_identifier_jaccard(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", code.identifiers(F.col("text")).alias("a"))
    t = t.withColumn("b", F.coalesce(F.lead("a").over(Window.partitionBy("conv_id").orderBy("turn")), F.array().cast("array<string>")))
    return t.select("conv_id", "turn", F.round(tx.term_jaccard(F.col("a"), F.col("b")), 6).alias("likeness"))


@register(r"""
SELECT doc_id, count(*) AS lines, round(avg(h), 6) AS mean_entropy FROM (
  SELECT doc_id, pos, CASE WHEN any_value(n) < 2 THEN 0 ELSE -sum(c / CAST(n AS DOUBLE) * log2(c / CAST(n AS DOUBLE))) END AS h FROM (
    SELECT doc_id, pos, length(line) AS n, ch, count(*) AS c FROM (SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents)),
      LATERAL (SELECT unnest(string_split(line, '')) AS ch) GROUP BY ALL) GROUP BY doc_id, pos) GROUP BY doc_id
""")
def x40_line_entropy(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("line"))
    return lines.select("doc_id", fingerprints.character_entropy("line").alias("h")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.round(F.avg("h"), 6).alias("mean_entropy"))
