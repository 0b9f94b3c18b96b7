"""Neighbours, symbols, segments, references and resampling against plain code."""

import bisect
import hashlib
import math
import random
import re
import statistics as st

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.functions import fingerprints
from siltstone.functions import symbols as sy
from siltstone.operators import evaluation, graph, nearest, resampling, segments, symbols
from siltstone.operators import statistics as stats


def plain_fingerprint(text, bits, domain=nearest.DOMAIN):
    counts = [0] * bits
    for w in re.split("[ \t\n\f\r]+", "".join(c.lower() if c.isascii() else c for c in text or "")):
        for limb in range(bits // 64) if w else ():
            word = int.from_bytes(hashlib.md5(domain.encode() + w.encode() + limb.to_bytes(8, "little")).digest()[:8], "little")
            for b in range(64):
                counts[64 * limb + b] += 1 if word >> b & 1 else -1
    words = [sum(1 << b for b in range(64) if counts[64 * limb + b] > 0) for limb in range(bits // 64)]
    return [w - (1 << 64) if w >> 63 else w for w in words]


@pytest.mark.parametrize("bits", [64, 256, 1024])
def test_wide_fingerprints(spark, bits):
    rows = [(1, "def retry_request(req):"), (2, "The quick  Brown\tfox\njumps Über the the the lazy dog"), (3, None), (4, " "), (5, "x")]
    got = {r["k"]: r["words"] for r in nearest.wide_fingerprints(spark.createDataFrame(rows, "k int, t string"), "k", "t", bits).collect()}
    assert got == {k: plain_fingerprint(t, bits) for k, t in rows}


def texts_with_copies(n, seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for i in range(n):
        if i and r.random() < 0.5:
            words = rows[r.randrange(len(rows))][1].split()
            for _ in range(r.randint(0, 6)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
        else:
            words = r.choices(vocabulary, k=60)
        rows.append((i, " ".join(words), f"s{i % 7}", len(words)))
    return rows


def test_probed_neighbours_and_clones_find_nine_in_ten(spark):
    rows = texts_with_copies(300)
    prints = {i: plain_fingerprint(t, 64)[0] & (1 << 64) - 1 for i, t, *_ in rows}
    far = lambda a, b: (prints[a] ^ prints[b]).bit_count()
    docs = spark.createDataFrame(rows, "id int, text string, source string, tokens int")
    index = nearest.wide_fingerprints(docs, "id", "text").cache()
    queries = index.filter("id % 3 = 0").withColumnRenamed("id", "query")
    want = {(q, i) for q in prints if q % 3 == 0 for i in prints if far(q, i) <= 8}
    found = nearest.candidates(index, queries).collect()
    assert all(r["distance"] == far(r["query"], r["id"]) for r in found)
    got = {(r["query"], r["id"]) for r in found if r["distance"] <= 8}
    assert got <= want and len(got) >= 0.9 * len(want)
    exact = {(r["query"], r["rank"]): (r["id"], r["distance"]) for r in nearest.nearest_exact(index, queries, 3, 24).collect()}
    for q in (q for q in prints if q % 3 == 0):
        best = sorted((far(q, i), i) for i in prints if far(q, i) <= 24)[:3]
        assert [exact[q, k + 1][::-1] for k in range(len(best))] == best
    pairs = {(r["a"], r["b"]): r for r in nearest.clones(docs.select("id", "source", "tokens").join(index, "id")).collect()}
    classes = {}
    for i, p in prints.items():
        classes.setdefault(p, []).append(i)
    leads = sorted(min(x) for x in classes.values())
    true = {}
    for x, a in enumerate(leads):
        for b in leads[x:]:
            n = sum(i % 7 != j % 7 for i in classes[prints[a]] for j in classes[prints[b]] if a != b or i < j)
            if n and far(a, b) <= 16:
                true[a, b] = n
    assert set(pairs) <= set(true) and len(pairs) >= 0.9 * len(true)
    assert all(r["pairs"] == true[k] and r["distance"] == far(*k) for k, r in pairs.items())


def test_a_hot_bucket_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BUCKET_ROWS", 5)
    index = spark.createDataFrame([(i, [i << 50]) for i in range(60)], "id int, words array<long>")
    queries = spark.createDataFrame([(0, [0])], "query int, words array<long>")
    assert {r["id"] for r in nearest.candidates(index, queries, ((0, 1, 2, 3),), 0).collect()} == set(range(60))


@pytest.mark.parametrize("bits", [64, 256])
def test_parts_and_blocks_give_the_same_neighbours(spark, monkeypatch, bits):
    monkeypatch.setattr(nearest, "PART_ROWS", 50)
    monkeypatch.setattr(nearest, "BLOCK_QUERIES", 20)
    monkeypatch.setattr(nearest, "KEPT_SETS", 10)
    docs = spark.createDataFrame([(str(i), t) for i, t, *_ in texts_with_copies(200)], "id string, text string")
    index = nearest.wide_fingerprints(docs, "id", "text", bits).cache()
    prints = {r["id"]: [w & (1 << 64) - 1 for w in r["words"]] for r in index.collect()}
    queries = index.filter("id % 3 = 0").withColumnRenamed("id", "query")
    asked = [q for q in prints if int(q) % 3 == 0]
    tables = nearest.sampled_tables(6, 5, bits)
    pairs = nearest.candidates(index, queries, tables, 2).collect()
    got = {r["query"]: (r["n_candidates"], [tuple(x) for x in r["best"]]) for r in nearest.probed(index, queries, 4, 24, tables, 2).collect()}
    for q in asked:
        own = sorted((r["distance"], r["id"]) for r in pairs if r["query"] == q)
        assert got[q] == (len(own), [x for x in own if x[0] <= 24][:4])
    exact = {(r["query"], r["rank"]): (r["distance"], r["id"]) for r in nearest.nearest_exact(index, queries, 4, 24).collect()}
    far = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(prints[a], prints[b], strict=True))
    assert exact == {(q, k + 1): x for q in asked for k, x in enumerate(sorted((far(q, i), i) for i in prints if far(q, i) <= 24)[:4])}


def test_every_clone_is_counted(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PART_ROWS", 50)
    monkeypatch.setattr(nearest, "BLOCK_QUERIES", 20)
    rows = [(i, t, None if s == "s3" else s, n if i != 9 else 3) for i, t, s, n in texts_with_copies(200)]
    prints = {i: plain_fingerprint(t, 64)[0] & (1 << 64) - 1 for i, t, *_ in rows}
    docs = spark.createDataFrame(rows, "id int, text string, source string, tokens int")
    index = nearest.wide_fingerprints(docs, "id", "text")
    got = {r["id"]: tuple(r)[1:] for r in nearest.clone_links(docs.select("id", "source", "tokens").join(index, "id")).collect()}
    used = [(i, s) for i, _, s, n in rows if n >= 4]
    assert set(got) == {i for i, _ in used}
    for i, s in used:
        apart = [(prints[i] ^ prints[j]).bit_count() for j, other in used if other != s]
        first = min(j for j, _ in used if prints[j] == prints[i])
        assert got[i] == (first, sum(d <= 2 for d in apart), sum(2 < d <= 8 for d in apart), sum(8 < d <= 16 for d in apart))


def test_word_sums_of_long_and_odd_texts(spark, monkeypatch):
    """A text's words are summed a few at a time and rows of one key together; white space is as in the regular expression."""
    r = random.Random(4)
    long = " ".join(r.choices(["a", "B", "Ä", "ß", "x_1"], k=1500))
    rows = [(1, "a\tb"), (1, "c\r\n\fD  a"), (1, None), (2, long), (3, "\x0ba \x0b\u00a0 b\u2028c"), (4, "\n"), (None, "x y"), (None, "z")]
    texts = {}
    for k, t in rows:
        texts[k] = f"{texts.get(k, '')} {t or ''}"
    monkeypatch.setattr(fingerprints, "SUMMED_WORDS", 700)
    for bits in (64, 256):
        got = {x["k"]: x["words"] for x in nearest.wide_fingerprints(spark.createDataFrame(rows, "k int, t string"), "k", "t", bits).collect()}
        assert got == {k: plain_fingerprint(t, bits) for k, t in texts.items()}
    digests = fingerprints.digests(pa.array(["a", "b"]), "x", 1)
    codes = np.array([0, 1, 1] * 400)
    for summed in (100, 65_536):
        monkeypatch.setattr(fingerprints, "SUMMED_WORDS", summed)
        got = fingerprints._summed(digests, codes, np.array([0] * 600 + [2] * 600), 3)
        both = np.unpackbits(digests, axis=1).astype(int).T @ [200, 400]
        assert (got == [both, np.zeros(64), both]).all()


def test_clones_are_counted_tile_by_tile(spark, monkeypatch):
    """Copies of a source, null sources, repeated ids and two widths give the counts of plain code, over many small tiles."""
    r = random.Random(9)
    monkeypatch.setattr(nearest, "TILE_ROWS", 20)
    monkeypatch.setattr(nearest, "COLUMNS_AT_ONCE", 7)
    monkeypatch.setattr(nearest, "ROWS_AT_ONCE", 4)
    for wide in (1, 2):
        base = [tuple(r.getrandbits(63) for _ in range(wide)) for _ in range(6)]
        rows = []
        for i in range(150):
            words = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 3, 9])):
                words[r.randrange(wide)] ^= 1 << r.randrange(63)
            rows.append((i if i != 7 else 8, r.choice([None, "s", "t", f"u{i}"]), r.choice([3, 4]) if i % 20 == 0 else 9, words))
        got = {x["id"]: tuple(x)[1:] for x in nearest.clone_links(spark.createDataFrame(rows, "id int, source string, tokens int, words array<long>")).collect()}
        used = [row for row in rows if row[2] >= 4]
        want = {}
        for i, s, _, words in used:
            far = [(sum((a ^ b).bit_count() for a, b in zip(words, other, strict=True)), s != o) for _, o, _, other in used]
            own = min(j for j, _, _, other in used if other == words), *(sum(apart and low < d <= most for d, apart in far) for low, most in ((-1, 2), (2, 8), (8, 16)))
            before = want.get(i)
            want[i] = (min(before[0], own[0]), *(a + b for a, b in zip(before[1:], own[1:], strict=True))) if before else own
        assert got == want
    side = {"source": pa.array(["s"] * 30), "n": np.ones(30, np.int64), "words": np.zeros((30, 1), np.uint64)}
    assert not any(x.any() for x in nearest._clones(side, side, [16]))
    assert nearest.clone_links(spark.createDataFrame([], "id int, source string, tokens int, words array<long>")).count() == 0


def test_routing_by_neighbours(spark):
    near = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 4)], "query int, id int")
    history = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "b", True), (4, "a", False)], "id int, model string, success boolean")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query int")
    got = {r["query"]: (r["model"], r["success"], r["n"], r["reason"]) for r in nearest.routed(near, history, F.lit("now"), queries).collect()}
    assert got == {1: ("b", 1.0, 1, "neighbors"), 2: ("now", 0.0, 0, "neighbors"), 3: (None, None, None, "nearest neighbor too distant")}
    few = nearest.routed(near, history.limit(2), F.lit("now"), queries).collect()
    assert {r["reason"] for r in few} == {"insufficient history"}


DEFINED = [
    ("def foo(x):\n    class Bar(Base):", ["foo", "Bar"]), ("class Baz:", ["Baz"]), ("pub fn run(a: u8)", ["run"]), ("struct Point<T> {", ["Point<T>"]), ("enum Kind{", ["Kind"]), ("pub struct Cfg {", ["Cfg"]),
    ("export default function App() {", ["App"]), ("async function load$(x)", ["load"]), ("const handler = async () => {", ["handler"]), ("export const make: F = (x) => 1", ["make"]), ("const n = 3;", []), ("let 1x = (a)", []),
    ("export interface Props<T> {", ["Props"]), ("type Id = string", ["Id"]), ("export const enum Color {", ["Color"]), ("func (s *Server) Start(ctx) error {", ["Start"]), ("func Handle(w", ["Handle"]), ("type Config struct {", ["Config"]),
    ("public abstract class Shape<T> {", ["Shape"]), ("sealed interface Node", ["Node"]), ("public static String render(int a)", ["render"]), ("override fun if (x)", []), ("namespace app{", ["app"]), ("module Admin", ["Admin"]), ("module.exports = x", []), ("x = 1", []),
]
IMPORTED = [
    ("from a.b import c, d as e, *", {"c", "d"}), ("import os.path, sys as s", {"path", "sys"}), ("use crate::m::{A, B as C};", {"A", "B"}), ("use std::io::Read;", {"Read"}), ("import { x, y as z } from 'm'", {"x", "y"}), ("import React from 'react'", {"React"}),
    ("const fs = require('fs')", {"fs"}), ("const { a: q, b } = require('m')", {"a"}), ('"net/http"', {"http"}), ("#include <sys/stat.h>", {"stat"}), ("require_relative '../lib/tool'", {"tool"}), ("using System.Text;", {"Text"}), ("using var x = y;", set()), ("#[pyfunction]", {"__pyo3_bridge__"}), ("x = 1", set()),
]


def test_symbols_of_lines(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(DEFINED + IMPORTED)] + [(99, None)], "i int, t string")
    got = {r["i"]: (r["d"], set(r["m"])) for r in rows.select("i", sy.definitions(F.col("t")).alias("d"), sy.imports(F.col("t")).alias("m")).collect()}
    assert [got[i][0] for i in range(len(DEFINED))] == [d for _, d in DEFINED]
    assert [got[len(DEFINED) + i][1] for i in range(len(IMPORTED))] == [m for _, m in IMPORTED]
    assert got[99] == ([], set())


def test_links_bind_to_the_last_definition(spark):
    rows = [(1, "def helper(x):", "a"), (2, "class Helper2:\n  def helper(x):", "a"), (3, "from m import helper\nhelper(1)", "a"), (4, "x: Helper2 = make()", "a"), (5, "helper(2)", "a"), (6, "def _gone$y():", "a"), (7, None, "a")]
    code = spark.createDataFrame(rows, "id int, text string, source string")
    got = sorted(tuple(r) for r in symbols.symbol_links(code, "id", "text").collect())
    assert got == [(1, 2, "helper", "call", 0.7), (3, 2, "helper", "import", 1.0), (4, 2, "Helper2", "type", 0.9), (5, 2, "helper", "call", 0.7)]
    assert [tuple(r) for r in symbols.dead_symbols(code, "id", "source", "text").collect()] == [("_gone$y", 6, 0.85)]


def test_impact_of_changes(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    found = graph.impact(pairs([("b", "a"), ("c", "b"), ("d", "c"), ("e", "x")]), spark.createDataFrame([("a",)], "node string"), pairs([("f2", "f1")]), spark.createDataFrame([("f1", "a"), ("f2", "z")], "symbol string, path string"), 2)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([("a", "changed", None), ("b", "imports", "a"), ("c", "imports", "b"), ("z", "calls", "f1")], key=repr)


def test_plans_of_reached_nodes_do_not_grow(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "src int, dst int")
    seeds = spark.createDataFrame([(0,)], "node int")
    sizes = []
    for depth in (2, 8):
        found = graph.reachable(edges, seeds, depth, both_ways=False)
        assert sorted(map(tuple, found.collect())) == [(i, i) for i in range(depth + 1)]
        sizes.append(found._jdf.queryExecution().analyzed().toString().count("\n"))
    assert sizes[0] == sizes[1]


TEXT = "# One\nfirst line\n  more\n\nSection 2 Terms\nbody – é Page 7 of it\n\n\n1.2 Numbers\n\n   \nlast paragraph\f\nend" + "\n\nlong " + "tok-en " * 40


def test_paragraphs_and_chunks_are_bytes_of_the_text(spark):
    docs = spark.createDataFrame([(1, "a.md", TEXT), (2, "a.py", TEXT), (3, "a.md", None), (4, "a.md", " \n\n"), (5, None, TEXT)], "id int, path string, text string")
    raw = TEXT.encode()
    blocks = segments.paragraph_blocks(docs, "id", F.col("path"), "text").collect()
    assert {r["id"] for r in blocks} == {1, 2, 5}
    own = sorted((r for r in blocks if r["id"] == 1), key=lambda r: r["index"])
    assert all(raw[r["byte_start"] : r["byte_end"]].decode() == r["text"] == r["text"].strip() for r in blocks)
    assert [(r["heading"], r["page"], r["text"].split("\n")[0][:9]) for r in own] == [("One", None, "# One"), ("Section 2 Terms", 7, "Section 2"), ("1.2 Numbers", 7, "1.2 Numbe"), ("1.2 Numbers", 8, "last para"), ("1.2 Numbers", 8, "long tok-")]
    assert all(r["heading"] is None for r in blocks if r["id"] != 1)
    chunks = sorted((r for r in segments.document_chunks(docs, "id", F.col("path"), "text", 20, 5).collect() if r["id"] == 1), key=lambda r: r["index"])
    assert all(raw[r["byte_start"] : r["byte_end"]].decode() == r["text"] for r in chunks)
    assert all(r["token_end"] - r["token_start"] == len(segments.TOKEN.findall(r["text"])) <= 20 for r in chunks)
    assert chunks[0]["text"].startswith("# One") and "Numbers" in chunks[0]["text"] and chunks[0]["heading"] == "One"
    long = [r for r in chunks if "tok" in r["text"]]
    assert len(long) == -(-(81 - 20) // 15) + 1 and all(b["byte_start"] < a["byte_end"] for a, b in zip(long, long[1:]))


def test_strings_in_texts_in_one_and_in_several_passes(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "the party art"), (2, "heart"), (3, ""), (4, None)], "id int, text string")
    strings = spark.createDataFrame([("art",), ("party",), ("",), ("x",), ("he",), ("art",)], "string string")
    want = {(1, "art"), (1, "party"), (1, "he"), (2, "art"), (2, "he")}
    assert {tuple(r) for r in segments.containing(texts, strings).collect()} == want
    monkeypatch.setattr(segments, "STRINGS_AT_ONCE", 1)
    assert {tuple(r) for r in segments.containing(texts, strings).collect()} == want
    assert segments.containing(texts, strings.limit(0)).count() == 0


def test_intervals_like_a_plain_bootstrap(spark):
    r = random.Random(8)
    rows = [("a", i, r.gauss(10, 3)) for i in range(400)] + [("b", i, r.expovariate(1)) for i in range(150)] + [("b", 999, None)]
    table = spark.createDataFrame(rows, "g string, k int, v double")
    first = {x["g"]: tuple(x)[1:] for x in resampling.mean_interval(table.repartition(7), "g", "k", "v", 2000).collect()}
    again = {x["g"]: tuple(x)[1:] for x in resampling.mean_interval(table.coalesce(1), "g", "k", "v", 2000).collect()}
    for g in "ab":
        values = [v for x, _, v in rows if x == g and v is not None]
        means = sorted(sum(r.choices(values, k=len(values))) / len(values) for _ in range(3000))
        error = st.stdev(values) / math.sqrt(len(values))
        assert first[g] == pytest.approx(again[g], abs=1e-9)
        assert first[g][0] == pytest.approx(st.mean(values))
        assert abs(first[g][1] - means[75]) < 0.25 * error and abs(first[g][2] - means[2925]) < 0.25 * error


def test_median_ratios_like_a_plain_bootstrap(spark):
    r = random.Random(2)
    rows = [("g", c, s, r.lognormvariate(m, 0.4)) for c, n in (("x", 40), ("y", 51)) for s, m in (("old", 1.0), ("new", 0.5)) for _ in range(n)] + [("g", "z", "old", 1.0), ("h", "x", "old", -1.0), ("h", "x", "new", 1.0)]
    table = spark.createDataFrame(rows, "g string, c string, s string, v double")
    got = {x["g"]: x for x in resampling.median_ratio_interval(table, "g", "c", "s", "v", ("new", "old"), 1500).collect()}
    own = {(c, s): [v for g, x, y, v in rows if (g, x, y) == ("g", c, s)] for c in "xy" for s in ("old", "new")}
    ratio = lambda d: math.exp(st.mean(math.log(st.median(d[c, "old"]) / st.median(d[c, "new"])) for c in "xy"))
    again = sorted(ratio({k: r.choices(v, k=len(v)) for k, v in own.items()}) for _ in range(3000))
    assert got["g"]["ratio"] == pytest.approx(ratio(own))
    spread = again[2925] - again[75]
    assert abs(got["g"]["low"] - again[75]) < 0.12 * spread and abs(got["g"]["high"] - again[2925]) < 0.12 * spread
    assert got["h"]["ratio"] == got["h"]["low"] == 0.0


def test_quantiles_and_ranks(spark):
    r = random.Random(1)
    rows = [(g, float(r.choice([r.randint(0, 30), r.random()]))) for g in "abc" for _ in range(r.choice([1, 2, 57]))] + [("a", None)]
    table = spark.createDataFrame(rows, "g string, v double")
    got = {x["g"]: x for x in stats.quantiles(table, "g", "v", {"q10": 0.1, "q50": 0.5, "q99": 0.99}).collect()}
    for g in "abc":
        values = sorted(v for x, v in rows if x == g and v is not None)
        for name, q in (("q10", 0.1), ("q50", 0.5), ("q99", 0.99)):
            at = q * (len(values) - 1)
            low, high = values[math.floor(at)], values[math.ceil(at)]
            assert got[g][name] == pytest.approx(low + (high - low) * (at - math.floor(at)))
    ties = table.filter("v IS NOT NULL").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    for x in stats.count_below(ties, "v", "n", "g").collect():
        assert x["_below"] == bisect.bisect_left(sorted(v for g, v in rows if g == x["g"] and v is not None), x["v"])


def test_surprisal_backs_off(spark):
    train = ["hello world", "help", "held"]
    texts = [(1, "hel"), (2, "zzz"), (3, ""), (4, None), (5, "held world")]
    counts = evaluation.gram_counts(spark.createDataFrame([(t,) for t in train], "t string"), "t", 3)
    table = {}
    for t in train:
        p = "\x02\x02" + t + "\x03"
        for i in range(2, len(p)):
            for k in (1, 2, 3):
                own = table.setdefault((k, p[i - k + 1 : i]), {})
                own[p[i]] = own.get(p[i], 0) + 1

    def chance(gram):
        for k in (3, 2, 1):
            own = table.get((k, gram[3 - k : 2]), {})
            if gram[2] in own:
                return math.log(own[gram[2]] / sum(own.values())) + (3 - k) * math.log(0.4)
        return -10.0

    want = {i: -sum(chance(("\x02\x02" + t)[a : a + 3]) for a in range(len(t))) / len(t) if t else 0.0 for i, t in texts}
    got = {r["k"]: r["surprisal"] for r in evaluation.surprisal(spark.createDataFrame(texts, "k int, t string"), "k", "t", counts, 3).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_imports_are_found_once_for_all_symbols_of_a_text(spark):
    from pyspark.sql import functions as F

    from siltstone.operators import symbols

    texts = spark.range(4).select("id", F.concat(F.lit("def f"), "id", F.lit("(x)\nimport f"), F.col("id") + 1, F.lit("\nf0()")).alias("t"))
    found = symbols.symbol_links(texts, "id", "t")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("neon::prelude") == 1
    assert {(r.src, r.dst, r.symbol, r.kind) for r in found.collect()} == {(i, i + 1, f"f{i + 1}", "import") for i in range(3)} | {(i, 0, "f0", "call") for i in range(1, 4)}


def test_parts_are_dealt_over_all_cores(spark):
    from siltstone.plans import structure_queries

    assert structure_queries._code(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


def test_draws_by_table_are_those_by_number():
    import numpy as np

    from siltstone.operators import resampling

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
        return x ^ x >> 31

    keys = np.random.default_rng(1).integers(0, 1 << 63, 300).astype(np.uint64)
    got = resampling._drawn(keys, np.arange(200))
    numbers = [[(mixed((int(k) + (r + 1) * 0x9E3779B97F4A7C15) & (1 << 64) - 1) >> 11) / (1 << 53) for r in range(200)] for k in keys]
    assert (got == np.searchsorted(resampling._DRAWN, numbers, side="right")).all()
    assert (resampling._TIMES == resampling._OPEN).sum() <= len(resampling._DRAWN)


def test_grams_of_a_text_are_cut_in_one_pass(spark):
    import time
    from collections import Counter

    from siltstone.operators import evaluation

    texts = ["a😀b\né", "x", "", None, "aa\x03a"]
    want = Counter()
    for t in filter(None, texts):
        p = "\x02\x02" + t + "\x03"
        want.update((k, p[i - k + 1 : i], p[i]) for i in range(2, len(p)) for k in (1, 2, 3))
    got = evaluation.gram_counts(spark.createDataFrame([(t,) for t in texts], "t string"), "t", 3)
    assert {(r["size"], r.context, r.char): r.n for r in got.collect()} == want
    long = spark.range(1).selectExpr("repeat('ab c', 150000) AS t")
    started = time.monotonic()
    assert evaluation.gram_counts(long, "t", 3).agg({"n": "sum"}).first()[0] == 3 * 600001
    assert time.monotonic() - started < 20


def test_pairs_and_links_are_dealt_by_their_number(spark, monkeypatch):
    from pyspark.sql import functions as F

    from siltstone.operators import ledger, selection

    monkeypatch.setattr(selection, "TASK_PAIRS", 10)
    rows = spark.range(200).select((F.col("id") % 20).alias("t"), F.floor(F.col("id") / 20).alias("i"), F.lit(1.0).alias("r"))
    pairs, links = selection.chosen_together(rows, "t", "i", "r"), ledger.temporal_links(rows, "t", "i")
    assert (pairs.rdd.getNumPartitions(), links.rdd.getNumPartitions()) == (90, 190)
    assert {(r.a, r.b, r.n) for r in pairs.collect()} == {(a, b, 20) for a in range(10) for b in range(a + 1, 10)}
    assert {(r.source, r.target, r.n) for r in links.collect()} == {(a, b, 19) for a in range(10) for b in range(10) if a != b}
    assert selection.chosen_together(rows.limit(0), "t", "i", "r").count() == ledger.temporal_links(rows.limit(0), "t", "i").count() == 0
