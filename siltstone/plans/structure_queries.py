"""Queries of code graphs, document structure, budgets and resampling, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import code, symbols
from siltstone.operators import budgets, evaluation, excerpts, resampling, segments
from siltstone.operators import symbols as links
from siltstone.plans.registry import register, spread, table
from siltstone.streaming import detectors

#: Texts of code: @ is a part's own symbol, ~ that of another, # its number.
TEMPLATES = (
    "def @(x: ~):\n    return ~(x)\n", "class @(~):\n    pass", "pub fn @(a: u8) -> ~ {\n  ~(a)\n}", "struct @<T> {", "enum @: u8 {", "trait @{",
    "export async function @(x) {\n  return ~(x)\n}", "async function @$() {}", "const @ = async (x) => ~(x);", "export let @: Handler = (x) => 1;", "let 9@ = (x) => 1", "export interface @<T> extends ~ {",
    "export type @ = ~ | null", "export const enum @ {", "func (s *Server) @(ctx) error {", "func @(a int) {\n\t~(a)\n}", "type @ struct {", "public abstract class @<T> extends ~ {",
    "private static String @ (String s) {", "override fun if (x)", "namespace @{", "typedef struct @ ~;", "module @ < ~", "module.@ = 1", "  def self.@\n\n", "@ = ~ + 1",
    "from pkg.mod import ~, @ as local, *\nfrom a import b import c\nx = ~", "import os.path, ~ as z\n~.run()", "use crate::mod::{~, @ as q};\n~::new()", "use crate::mod::~;\nlet y = ~;", "use {open", "import { ~, other as o } from './x'\n~()",
    "import type ~ from 'm'", "import React, { x from 'react'", "const ~ = require('~')\n~.go()", "var { ~: a, b } = require('b')\n~", "x = require('b')", '"net/~"', '#include <sys/~.h>\n~()', "require_relative '../lib/~'\n~", "using static System.~;", "using var x = y;",
    "#[pyfunction]\nfn @()", "native int @();", "import ctypes\nctypes.x", "#[napi]\nextern \"C\" {", "if isinstance(_, ~): pass", "-> ~", "__@__ __~__", "class __$@:", "def (x)",
)

_TEMPLATES_SQL = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in TEMPLATES) + "]"
_CODE_SQL = f"""code AS (SELECT p_partkey AS id, p_brand AS source, replace(replace({_TEMPLATES_SQL}[(p_partkey % {len(TEMPLATES)} + 1)::INT], '@', concat('sym', p_partkey % 701)), '~', concat('sym', p_partkey * 7 % 701)) AS text FROM part)"""


def _code(spark, sf_dir):
    k = F.col("p_partkey")
    template = F.element_at(F.array(*map(F.lit, TEMPLATES)), (k % len(TEMPLATES) + 1).cast("int"))
    name = lambda n: F.concat(F.lit("sym"), (n % 701).cast("string"))
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")
    return parts.select(k.alias("id"), F.col("p_brand").alias("source"), F.replace(F.replace(template, F.lit("@"), name(k)), F.lit("~"), name(k * 7)).alias("text"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TRIM_SQL = rf"'{symbols._TRIM}'"


def _rule_sql(rule: symbols.Rule) -> str:
    line = f"regexp_replace(x, {_quoted(rule.before)}, '', 'g')" if rule.before else "x"
    taken = f"regexp_extract({line}, {_quoted(rule.take)}, 1)"
    part = "regexp_replace(p, ' as .*$', '')" if rule.many else "p"
    part = f"regexp_replace({part}, {_TRIM_SQL}, '', 'g')"
    first = "'" in rule.strip
    for pattern in [rule.strip if first else "", rule.last, "" if first else rule.strip, symbols._TRIM]:
        if pattern:
            part = f"regexp_replace({part}, {_quoted(pattern)}, '', 'g')"
    drop = "".join(f", {_quoted(d)}" for d in rule.drop)
    return f"list_filter(list_transform({f'string_split({taken}, {_quoted(chr(44))})' if rule.many else f'[{taken}]'}, lambda p: {part}), lambda n: n NOT IN (''{drop}))"


def _rules_sql(rules: tuple[symbols.Rule, ...]) -> str:
    cases = []
    for rule in rules:
        holds = " AND ".join([f"regexp_matches(x, {_quoted(p)})" for p in rule.when] + [f"NOT regexp_matches(x, {_quoted(p)})" for p in rule.unless])
        cases.append(f"WHEN {holds} THEN {_rule_sql(rule)}")
    return f"CASE {' '.join(cases)} ELSE [] END"


_SYMBOLS_SQL = rf"""{_CODE_SQL}, lines AS (SELECT id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, {_TRIM_SQL}, '', 'g')), lambda x: x <> '')) AS x, unnest(range(100)) AS i FROM code),
parsed AS (SELECT id, x, {_rules_sql(symbols.DEFINITIONS)} AS d, {_rules_sql(symbols.IMPORTS)} AS m FROM lines WHERE x IS NOT NULL),
names AS (SELECT id, unnest(d) AS symbol FROM parsed), defs AS (SELECT symbol, max(id) AS target FROM names GROUP BY 1),
imps AS (SELECT DISTINCT id, symbol FROM (SELECT id, unnest(m) AS symbol FROM parsed UNION ALL {' UNION ALL '.join(f"SELECT id, {_quoted(n)} FROM lines WHERE regexp_matches(x, {_quoted(p)})" for p, n in symbols.BRIDGES)}))"""
_KEYWORDS_SQL = ", ".join(map(_quoted, code.KEYWORDS))


@register(rf"WITH {_SYMBOLS_SQL} SELECT id, (SELECT coalesce(string_agg(symbol, ',' ORDER BY symbol), '') FROM names n WHERE n.id = code.id) AS defined, (SELECT coalesce(string_agg(symbol, ',' ORDER BY symbol), '') FROM imps n WHERE n.id = code.id) AS imported FROM code")
def x12_symbols(spark, sf_dir):
    """Lines of code made of parts' numbers."""
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    text = F.col("text")
    return _code(spark, sf_dir).select("id", joined(symbols.definitions(text)).alias("defined"), joined(symbols.imports(text)).alias("imported"))


_LINKS_SQL = rf"""{_SYMBOLS_SQL}, used AS (SELECT DISTINCT id, lower(text) AS low, unnest(list_filter(regexp_extract_all(text, '[\pL\pN_]+'), lambda w: strlen(w) > 1 AND w NOT IN ({_KEYWORDS_SQL}))) AS symbol FROM code),
edges AS (SELECT u.id AS src, target AS dst, symbol, CASE WHEN i.id IS NOT NULL THEN 'import' WHEN contains(low, ': ' || lower(symbol)) OR contains(low, '-> ' || lower(symbol)) OR contains(low, '<' || lower(symbol)) OR contains(low, 'isinstance(_, ' || lower(symbol)) THEN 'type' ELSE 'call' END AS kind
  FROM used u JOIN defs USING (symbol) LEFT JOIN imps i USING (id, symbol) WHERE u.id <> target)"""


@register(f"WITH {_LINKS_SQL} SELECT src, dst, symbol, kind, CASE kind WHEN 'import' THEN 1.0::DOUBLE WHEN 'type' THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS strength FROM edges")
def j5_symbol_links(spark, sf_dir):
    return links.symbol_links(_code(spark, sf_dir), "id", "text")


@register(rf"""
WITH {_SYMBOLS_SQL}, seen AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\pL\pN_]+')) AS w FROM code)
SELECT symbol AS name, target AS fragment, CASE WHEN starts_with(symbol, '_') THEN 0.85::DOUBLE WHEN contains(source, 'api') OR contains(source, 'interface') OR contains(source, 'types') THEN 0.35::DOUBLE ELSE 0.6::DOUBLE END AS confidence
FROM defs JOIN code ON code.id = target WHERE lower(symbol) NOT IN ({', '.join(map(_quoted, symbols.GENERIC))}) AND strlen(symbol) > 1 AND lower(symbol) NOT IN (SELECT w FROM seen WHERE strlen(w) >= 2) ORDER BY confidence DESC, name LIMIT 50
""")
def a12_dead_symbols(spark, sf_dir):
    return links.dead_symbols(_code(spark, sf_dir), "id", "source", "text")


def _lines_to_fill(spark, sf_dir):
    """Lines of orders as candidates of their suppliers: a budget for each supplier."""
    f = F.col
    lines = table(spark, sf_dir, "lineitem").select(f("l_suppkey").alias("group"), (f("l_orderkey") * 10 + f("l_linenumber")).alias("key"), (f("l_discount") + f("l_tax") + f("l_quantity") % 7 / 10).alias("score"), f("l_quantity").cast("int").alias("tokens"), (f("l_orderkey") % 97 == 0).alias("pinned"))
    limits = table(spark, sf_dir, "supplier").select(f("s_suppkey").alias("group"), (300 + f("s_suppkey") % 5 * 100).cast("long").alias("budget"))
    return lines, limits


@register()
def k7_soft_selection(spark, sf_dir):
    """Price, gap and what is taken for each supplier; tested against plain code."""
    lines, limits = _lines_to_fill(spark, sf_dir)
    taken, found = budgets.soft_selection(lines.drop("pinned"), limits, 0.1)
    sums = taken.groupBy("group").agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"))
    return found.join(sums, "group", "left").select(F.col("group").alias("l_suppkey"), F.round("price", 9).alias("price"), F.round("dual_gap", 6).alias("dual_gap"), F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


@register()
def k10_selection(spark, sf_dir):
    """K10 at a low temperature: pinned lines first, then exactly or by score per token; tested against plain code."""
    lines, limits = _lines_to_fill(spark, sf_dir)
    return budgets.select(lines, limits, 0.01)


_CHUNK_SQL = """chunk AS (SELECT p_partkey AS id, concat('docs/', p_type, '/clause-', p_partkey % 31, '.md') AS path, CASE WHEN p_partkey % 5 = 4 THEN concat('Section ', p_partkey % 30) END AS heading, replace(replace(replace([
  '"@ #" means a small part; "W" refers to it.', 'As defined in Section ^, the @ # applies. See  section  ^ and SEE Section ^.', 'Supplier Corp # (the "Vendor #") is subject to Clause ^ and "@" shall mean more.',
  'Pursuant to Exhibit ^ and see Schedule A-^ the vendor-# ships @s.', 'Section ^ holds terms of article IV.', 'Nothing here, but Clause ^.'][(p_partkey % 6 + 1)::INT], '@', p_name), '#', (p_partkey % 40)::VARCHAR), '^', (p_partkey % 37)::VARCHAR) AS text FROM part)"""


def _chunk_texts(spark, sf_dir):
    k = F.col("p_partkey")
    texts = (
        '"@ #" means a small part; "W" refers to it.', "As defined in Section ^, the @ # applies. See  section  ^ and SEE Section ^.", 'Supplier Corp # (the "Vendor #") is subject to Clause ^ and "@" shall mean more.',
        "Pursuant to Exhibit ^ and see Schedule A-^ the vendor-# ships @s.", "Section ^ holds terms of article IV.", "Nothing here, but Clause ^.",
    )
    text = F.element_at(F.array(*map(F.lit, texts)), (k % 6 + 1).cast("int"))
    for mark, value in (("@", F.col("p_name")), ("#", (k % 40).cast("string")), ("^", (k % 37).cast("string"))):
        text = F.replace(text, F.lit(mark), value)
    path = F.concat(F.lit("docs/"), "p_type", F.lit("/clause-"), (k % 31).cast("string"), F.lit(".md"))
    heading = F.when(k % 5 == 4, F.concat(F.lit("Section "), (k % 30).cast("string")))
    return table(spark, sf_dir, "part").select(k.alias("id"), path.alias("path"), heading.alias("heading"), text.alias("text"))


def _norm_sql(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


@register(f"""
WITH {_CHUNK_SQL}, t AS (SELECT DISTINCT id, {_norm_sql('t')} AS term FROM (SELECT id, unnest(list_concat(regexp_extract_all(text, '{segments.MEANS}', 1), regexp_extract_all(text, '{segments.ALIAS}', 1))) AS t FROM chunk)),
f AS (SELECT term, min(id) AS target FROM t WHERE length(term) >= 2 GROUP BY 1)
SELECT id AS source, target, 'defined_term' AS relation, term AS evidence FROM chunk JOIN f ON contains({_norm_sql('text')}, term) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.id = chunk.id AND t.term = f.term)
""")
def j13_term_links(spark, sf_dir):
    return segments.term_links(_chunk_texts(spark, sf_dir))


_REF_SQL = " UNION ALL ".join(f"SELECT id, heading, '{r}' AS relation, unnest(regexp_extract_all(text, '{p}', 1)) AS e, unnest(range(1000)) AS pos FROM chunk" for r, p in segments.REFERENCES)


@register(rf"""
WITH {_CHUNK_SQL}, r AS (SELECT id, heading, relation, pos, CASE WHEN relation = 'structural_reference' THEN regexp_replace(e, '^(\S+)\s+', '\1 ') ELSE e END AS e FROM ({_REF_SQL}) WHERE e IS NOT NULL),
o AS (SELECT id, relation, arg_min(e, pos) AS e FROM r WHERE NOT (relation = 'structural_reference' AND contains({_norm_sql('heading')}, {_norm_sql('e')})) GROUP BY id, relation, lower(e)),
h AS (SELECT id, {_norm_sql('heading')} AS a, {_norm_sql('path')} AS b, {_norm_sql('left(text, 300)')} AS c FROM chunk)
SELECT o.id AS source, (SELECT min(h.id) FROM h WHERE h.id <> o.id AND (contains(a, {_norm_sql('o.e')}) OR contains(b, {_norm_sql('o.e')}) OR contains(c, {_norm_sql('o.e')}))) AS target, relation, e AS evidence FROM o
""")
def j14_reference_links(spark, sf_dir):
    return segments.reference_links(_chunk_texts(spark, sf_dir))


@register()
def s8_paragraphs(spark, sf_dir):
    """Paragraphs of all documents, of which two in three have headings; tested against the texts and plain code."""
    path = F.when(F.col("doc_id") % 3 == 0, "a.py").otherwise("a.md")
    return segments.paragraph_blocks(table(spark, sf_dir, "documents"), "doc_id", path, "text")


@register()
def s9_document_chunks(spark, sf_dir):
    """Chunks of all documents of 120 tokens at most; tested against the texts and plain code."""
    path = F.when(F.col("doc_id") % 3 == 0, "a.py").otherwise("a.md")
    return segments.document_chunks(table(spark, sf_dir, "documents"), "doc_id", path, "text", 120, 15)


@register(r"""
WITH t AS (SELECT conv_id * 1000 + turn AS id, role, replace(coalesce(text, ''), chr(10), ' ') AS t FROM conversations),
p AS (SELECT concat(chr(2), chr(2), t, chr(3)) AS p FROM t WHERE role = 'assistant' AND t <> ''), g AS (SELECT p, unnest(range(3, length(p) + 1)) AS i FROM p),
c AS (SELECT k, substr(p, i - k + 1, k - 1) AS ctx, substr(p, i, 1) AS ch, count(*) AS n FROM g, (SELECT unnest([1, 2, 3]) AS k) GROUP BY ALL), l AS (SELECT k, ctx || ch AS s, ln(n / sum(n) OVER (PARTITION BY k, ctx)) + (3 - k) * ln(0.4::DOUBLE) AS lp FROM c),
q AS (SELECT id, concat(chr(2), chr(2), t) AS p FROM t WHERE role = 'user' AND t <> ''), w AS (SELECT id, substr(p, i - 2, 3) AS s FROM (SELECT id, p, unnest(range(3, length(p) + 1)) AS i FROM q)),
r AS (SELECT w.id, coalesce(a.lp, b.lp, d.lp, -10.0::DOUBLE) AS lp FROM w LEFT JOIN l a ON a.k = 3 AND a.s = w.s LEFT JOIN l b ON b.k = 2 AND b.s = right(w.s, 2) LEFT JOIN l d ON d.k = 1 AND d.s = right(w.s, 1))
SELECT t.id, round(coalesce(s, 0), 6) AS surprisal FROM t LEFT JOIN (SELECT id, -avg(lp) AS s FROM r GROUP BY 1) USING (id) WHERE role = 'user'
""")
def x43_surprisal(spark, sf_dir):
    """users' turns by the grams of the assistants'."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")).alias("t"))
    counts = evaluation.gram_counts(turns.filter("role = 'assistant'"), "t", 3)
    return evaluation.surprisal(turns.filter("role = 'user'"), "id", "t", counts, 3).withColumn("surprisal", F.round("surprisal", 6))


@register()
def v5_paired_bootstrap(spark, sf_dir):
    """V5 by event type: values less 50 as differences; V9 is the same with interpolated ends. Tested against a plain bootstrap."""
    deltas = table(spark, sf_dir, "events").select("event_type", "event_id", (F.col("value") - 50).alias("delta"))
    found = resampling.mean_interval(deltas, "event_type", "event_id", "delta", interpolate=False)
    return found.select("event_type", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


@register()
def v9_mean_interval(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), "l_extendedprice")
    found = resampling.mean_interval(lines, "l_returnflag", "key", "l_extendedprice")
    return found.select("l_returnflag", *(F.round(c, 4).alias(c) for c in ("mean", "low", "high")))


@register()
def v8_speedup_interval(spark, sf_dir):
    """V8: ship years as scenarios, open and filled lines as systems, prices as times. Tested against a plain bootstrap."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", F.year("l_shipdate").alias("year"), (F.col("l_linenumber") % 2).cast("string").alias("system"), "l_extendedprice")
    found = resampling.median_ratio_interval(lines, "l_returnflag", "year", "system", "l_extendedprice", ("0", "1"))
    return found.select("l_returnflag", *(F.round(c, 6).alias(c) for c in ("ratio", "low", "high")))


@register()
def w9_rate_surprise(spark, sf_dir):
    """Events of each user, their values as counts, each a fortieth of a second after the last number; tested against a plain loop and a stream."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") / 40).alias("at"), F.floor(F.col("value") / 10).alias("n"))
    found = detectors.detect(rows, "user_id", "event_id", "at", "n", detectors.RATES)
    return found.select("user_id", "event_id", *(F.round(c, 6).alias(c) for c in ("expected", "observed", "surprise")))


@register()
def w10_shifts(spark, sf_dir):
    """Lines of orders as requests of their suppliers, hits until late years; tested against a plain loop and a stream."""
    hit = (F.year("l_shipdate") < 1996) | (F.col("l_linenumber") == 1)
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.unix_timestamp("l_shipdate") * 100000 + F.col("l_orderkey")).alias("at"), hit.cast("int").alias("hit"))
    found = detectors.detect(rows, "l_suppkey", "at", "at", "hit", detectors.SHIFTS)
    return found.filter("shift IS NOT NULL").select("l_suppkey", "at", F.round("hit_rate", 6).alias("hit_rate"), "shift")


def _words(text):
    return F.transform(F.regexp_extract_all(text, F.lit(r"[\pL\pN_]+"), F.lit(0)), F.lower)


def _split():
    return F.split(F.coalesce("text", F.lit("")), r"\. ")


_SENTENCES_SQL = r"""s AS (SELECT doc_id, i, list_transform(regexp_extract_all(t, '[\pL\pN_]+'), lambda w: lower(w)) AS w FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), '. ')) AS t, unnest(range(len(string_split(coalesce(text, ''), '. ')))) AS i FROM documents))"""


@register(f"WITH {_SENTENCES_SQL}, d AS (SELECT doc_id, term, count(*) AS df FROM (SELECT DISTINCT doc_id, i, unnest(w) AS term FROM s) GROUP BY ALL) SELECT doc_id, count(*) AS n, round(greatest(1, avg(len(w))), 6) AS average, (SELECT coalesce(max(df), 0)::BIGINT FROM d WHERE d.doc_id = s.doc_id) AS most, (SELECT count(*) FROM d WHERE d.doc_id = s.doc_id) AS terms FROM s GROUP BY 1")
def a17_sentence_statistics(spark, sf_dir):
    """Sentences of each document, their length, how many terms there are and how many sentences the commonest is in."""
    found = excerpts.document_statistics(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", ". ", r"[^\pL\pN_]+")
    return found.select("doc_id", "n", F.round("average", 6).alias("average"), "most", "terms")


@register()
def k6_excerpts(spark, sf_dir):
    """K6: sentences of each document for a query of its own, the first words of a benchmark item, under 60 tokens; tested against plain code."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.slice(_words(F.col("text")), 1, 8).alias("terms"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 40).alias("item_id"), F.lit(60).alias("budget")).join(items, "item_id", "left")
    taken = excerpts.document_excerpts(docs, "doc_id", _split(), _words, "terms", "budget")
    return taken.select("doc_id", "index", F.round("relevance", 6).alias("relevance"), "text")
