"""The engine's queries against SQL on the small tables, and operators on small fixtures."""

import hashlib
import math
import os
import random
import time
import unicodedata

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from siltstone.functions import claims, code, fingerprints, grams, routing, signals
from siltstone.functions import text as tx
from siltstone.operators import blocks, graph, ledger, selection, statistics
from siltstone.plans import queries
from siltstone.sources import jsonl
from siltstone.streaming import rollups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return c


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, con, name):
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = [tuple(dict(zip(names, r))[c] for c in sorted(names)) for r in cursor.fetchall()]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    got = [tuple(r) for r in got.select(*sorted(names)).collect()]
    key = lambda r: tuple(str(x) if not isinstance(x, float) else f"{x:.3f}" for x in r)
    assert len(got) == len(want) and got
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and math.isclose(x, y, abs_tol=2e-6)), (a, b)


def test_pagerank_sums_to_one_and_matches_plain_code(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("a", "e")]
    nodes = "abcde"
    rank = {n: 0.2 for n in nodes}
    for _ in range(10):
        new = {n: 0.03 for n in nodes}
        for n in nodes:
            out = [d for s, d in links if s == n]
            for d in out or nodes:
                new[d] += 0.85 * rank[n] / (len(out) or 5)
        rank = new
    got = graph.pagerank(spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame([(n,) for n in nodes], "node string")).collect()
    assert {r.node: round(r["rank"], 9) for r in got} == {n: round(v, 9) for n, v in rank.items()}


def test_insert_once_keeps_stored_rows(spark):
    stored = spark.createDataFrame([(1, "a")], "k long, v string")
    new = spark.createDataFrame([(1, "z"), (2, "c"), (2, "b")], "k long, v string")
    assert sorted(map(tuple, ledger.insert_once(stored, new, "k", "v").collect())) == [(1, "a"), (2, "b")]


def test_nulls_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "doc_id long, text string")
    assert blocks.token_chunks(df).count() == 1
    assert blocks.repetition_floods(df).count() == 0
    assert [tuple(r.e) for r in df.select(tx.byte_entropies("text").alias("e")).collect()] == [(0.0, 0.0)] * 3


def test_prune_keeps_late_and_unparseable_lines(spark):
    lines = ['{"ts": 5, "a": 1}', '{"ts": 1}', '{"a": 1}', "junk", " "]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert sorted(r.value for r in jsonl.prune(df, "ts", 3).collect()) == sorted(['{"a":1,"ts":5}', "junk"])
    odd = spark.createDataFrame([("[1, 2]",), ('{"ts": "9"}',), ("7",), ('{"ts": 9.5}',)], "value string")
    assert [r.value for r in jsonl.prune(odd, "ts", 3).collect()] == ['{"ts":9.5}']


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")
def test_streaming_rollup_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = rollups.tumbling(stream, "ts", "value", lateness="100000 days").writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((str(r.start)[:10], r.n) for r in spark.table("daily").collect())
    want = sorted((r.key, r.n) for r in ledger.rollup(events, "ts", "value").filter("period = 'day'").collect())
    assert got == want


def test_values_of_small_cases(spark):
    """Cases at the edges of the formulas, with their values worked out by hand."""
    one = lambda df: [tuple(r) for r in df.collect()]
    texts = spark.createDataFrame([("x" * 241,), ("x" * 240,), ("a \n\t b",)], "t string")
    assert one(texts.select(tx.preview(F.col("t")))) == [("x" * 237 + "...",), ("x" * 240,), ("a b",)]
    # a number at the very end has too few bytes behind it; accented letters have two each
    ends = spark.createDataFrame([("123-45-6789",), ("123-45-6789.",), ("123-45-é6789",), ("123-45-67é",)], "t string")
    assert one(ends.select(F.array_contains(tx.pii_types(F.col("t")), "SSN"))) == [(False,), (True,), (False,), (False,)]
    turns = spark.createDataFrame([(0, 3), (1, 3), (2, 3), (0, 1)], "p int, n int")
    got = [round(r[0], 6) for r in turns.select(signals.attention_weight(F.col("p"), F.col("n"))).collect()]
    assert got == [round(0.4 + 0.4 * math.exp(-2) + 0.2, 6), round(0.8 * math.exp(-1) + 0.2, 6), round(0.4 + 0.4 * math.exp(-2) + 0.2, 6), 1.0]
    lines = spark.createDataFrame([(1, "\tab \r\n ab\r\nab\u2028\nx")], "doc_id long, text string")
    assert [(r.line, r.run) for r in blocks.repetition_floods(lines, 2).collect()] == [("ab", 3)]
    five = spark.createDataFrame([("g", float(v)) for v in (3, 1, 2, 5, 4)], "g string, v double")
    assert one(statistics.conformal_quantile(five, "g", "v", 0.1)) == [("g", 5.0)]
    assert one(statistics.trimmed_mean(five, "g", "v")) == [("g", 3.0)]
    words = spark.createDataFrame([(1, "well-known it's _x - --")], "doc_id long, text string")
    assert one(blocks.token_chunks(words, 2, 0).select("token_start", "token_end")) == [(0, 2), (2, 4)]
    # the version of the larger sequence wins, though its instant is earlier; one without an instant doesn't count
    versions = spark.createDataFrame([("e", 1, 5), ("e", 2, 3), ("e", 3, None), ("f", 4, 2)], "entity string, seq int, at int")
    assert sorted(one(ledger.as_of(versions, "entity", "at", "seq", F.lit(6)).select("entity", "seq"))) == [("e", 2), ("f", 4)]
    free = spark.createDataFrame([("g", 1, 2.0, 0), ("g", 2, -1.0, 1), ("g", 3, 4.0, 4)], "g string, k int, v double, w int")
    assert one(selection.fractional_bound(free, "g", "k", "v", "w", 2)) == [("g", 4.0)]
    with pytest.raises(ValueError):
        ledger.usage_totals(versions, {"entity": "e"})


def test_knapsack_against_all_subsets(spark):
    r = random.Random(1)
    rows = [(g, k, round(r.random(), 4), r.randint(0, 30)) for g in range(6) for k in range(10)]
    items = spark.createDataFrame(rows, "g int, k int, v double, w int")
    got = {}
    for x in selection.knapsack(items, "g", "k", "v", "w", 60).collect():
        got.setdefault(x.g, set()).add(x.k)
    for g in range(6):
        own = [x for x in rows if x[0] == g]
        best = max(sum(int(x[2] * 10_000) for x in own if m >> x[1] & 1) for m in range(1 << 10) if sum(x[3] for x in own if m >> x[1] & 1) <= 60)
        mine = [x for x in own if x[1] in got[g]]
        assert sum(x[3] for x in mine) <= 60 and sum(int(x[2] * 10_000) for x in mine) == best
    # over 2000 the budget is cut into units, and still held
    large = spark.createDataFrame([("g", k, float(v), w) for k, (v, w) in enumerate([(9, 4999), (5, 3000), (4, 1999), (1, 2), (3, 5003)])], "g string, k int, v double, w int")
    assert {x.k for x in selection.knapsack(large, "g", "k", "v", "w", 5003).collect()} == {0, 3}
    assert selection.knapsack(items.limit(0), "g", "k", "v", "w", 60).count() == 0


def test_near_copies_against_one_by_one_insertion(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(30)]
    prints = [b ^ sum(1 << i for i in r.sample(range(64), r.choice([0, 1, 2, 3, 4, 5]))) for b in base for _ in range(8)]
    r.shuffle(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {x.k: x.duplicate_of for x in selection.near_copies(spark.createDataFrame(list(enumerate(signed)), "k long, f long"), "k", "f").collect()}
    kept = []
    for k, p in enumerate(prints):
        near = [j for j in kept if (prints[j] ^ p).bit_count() <= 3]
        assert got[k] == (near[0] if near else None)
        if not near:
            kept.append(k)
    assert selection.near_copies(spark.createDataFrame([], "k long, f long"), "k", "f").count() == 0


def test_simhash_and_code_terms_of_known_texts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    text = "The quick (brown) fox, jumps."
    sums = [0] * 64
    for gram in ("the quick brown", "quick brown fox", "brown fox jumps"):
        h = int.from_bytes(hashlib.md5(gram.encode()).digest()[:8], "little")
        sums = [s + (1 if h >> i & 1 else -1) for i, s in enumerate(sums)]
    want = sum(1 << i for i, s in enumerate(sums) if s > 0)
    assert one(fingerprints.simhash(F.lit(text))) % 2**64 == want
    assert one(fingerprints.simhash(F.lit(" .. "))) == 0
    assert one(code.split_identifier(F.lit("HTMLParser_add_XYZ2Edges"))) == ["html", "parser", "add", "xyz2", "edges"]
    assert one(code.code_tokens(F.lit("def chargedCards(queries): return matches"))) == ["chargedcard", "chargedcards", "charg", "charged", "card", "cards", "query", "queries", "match", "matches"]
    assert one(code.path_tokens(F.lit("src/lang-graph/State_v2.py"))) == ["lang", "graph", "state", "v2"]
    assert [one(code.stem(F.lit(w))) for w in ("class", "status", "boxes", "charge", "bee")] == [None, None, "boxe", "charg", None]
    assert one(claims.sentences(F.lit("A sentence of some length. Short one. x = 1;\nanother line that is long"))) == ["A sentence of some length.", "another line that is long"]
    assert one(signals.retry_delay(F.lit("e"), F.lit(3), 1.0, 60.0)) == pytest.approx(4 * (0.85 + 0.3 * int(hashlib.sha256(b"e:3").hexdigest()[:8], 16) / 0xFFFFFFFF))
    assert one(signals.micro_cost(F.lit(5), F.lit("0.5").cast("decimal(4,1)"))) == 3


def test_capture_estimate_rounds_halves_as_its_sql(spark, tmp_path):
    values = [(1, 0, 0, "view", 25.0), (2, 0, 0, "view", 20.0), (3, 0, 0, "click", 5.0), (4, 1, 1, "view", 25.0), (5, 1, 1, "click", 30.0)]
    rows = spark.createDataFrame(values, "event_id long, ts long, user_id long, event_type string, value double")
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = db.execute(f"SELECT user_id, coverage, gap, confidence, risk FROM ({queries.ORACLE_SQL['v42_capture_estimate']}) ORDER BY 1").fetchall()
    got = queries.QUERIES["v42_capture_estimate"](spark, str(tmp_path)).orderBy("user_id").collect()
    assert [tuple(r) for r in got] == want


def test_shares_of_ngrams_of_several_sizes(spark, monkeypatch):
    monkeypatch.setattr(selection, "TASK_GRAMS", 50)
    r = random.Random(5)
    texts = [*(" ".join(r.choices("abcde", k=r.randint(0, 9))) for _ in range(60)), None, "x y z x y z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {x["k"]: tuple(x)[1:] for x in selection.ngram_redundancy(docs, "k", claims.tokens(F.col("t")), (2, 3, 4)).collect()}
    words = [(t or "").split() for t in texts]
    grams = {n: [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in words] for n in (2, 3, 4)}
    for k, w in enumerate(words):
        own = [g[k] for g in grams.values()]
        rest = [set().union(*(x for j, x in enumerate(g) if j != k)) for g in grams.values()]
        assert got[k] == (len(w), *(pytest.approx(len(a & b) / len(a)) if a else 0.0 for a, b in zip(own, rest, strict=True)))


def test_ngrams_are_shuffled_a_share_at_a_time(spark, monkeypatch):
    """Several passes give the counts of one and of plain code; an n-gram that many texts of a run have is sent once."""
    r = random.Random(6)
    texts = [*(" ".join(r.choices("abcdefgh", k=r.randint(0, 30))) for _ in range(90)), None, "", "a", *["one long text of copies"] * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, t string").coalesce(2)
    found = lambda: {x["k"]: tuple(x)[1:] for x in selection.ngram_redundancy(docs, "k", claims.tokens(F.col("t")), (1, 3, 4)).collect()}
    one = found()
    monkeypatch.setattr(selection, "TASK_GRAMS", 40)
    monkeypatch.setattr(selection, "PASS_GRAMS", 100)
    setting = spark.conf.get(selection._REMOVE)
    assert found() == one and spark.conf.get(selection._REMOVE) == setting
    words = [(t or "").split() for t in texts]
    sets = {n: [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in words] for n in (1, 3, 4)}
    for k, w in enumerate(words):
        rest = {n: set().union(*(x for j, x in enumerate(own) if j != k)) for n, own in sets.items()}
        assert one[k] == (len(w), *(pytest.approx(len(own[k] & rest[n]) / len(own[k])) if own[k] else 0.0 for n, own in sets.items()))
    hashes = pa.array([[1, 2, 3], [1, 2], None, [], [4] * 9], pa.list_(pa.int64()))
    monkeypatch.setattr(grams, "WORDS", 4)
    assert [len(x) for x in grams.slices(hashes)] == [1, 3, 1]
    lengths, (pairs,) = grams.hashed(hashes, (2,))
    counts, different, places = grams.different(*pairs, 5)
    assert lengths.tolist() == [3, 2, 0, 0, 9] and counts.tolist() == [2, 1, 0, 0, 1]
    assert len(different) == 3 and sorted(places.tolist()) == [0, 4, grams.SEVERAL]
    last = different[places == 4]
    assert [x.tolist() for x in grams.alone([different, last], [places, np.zeros(1, np.uint16)])] == [[1], []]


def test_ngrams_leave_little_on_disk(spark, monkeypatch):
    r = random.Random(8)
    texts = [" ".join(str(r.getrandbits(40)) for _ in range(200)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    size = lambda: sum(os.lstat(f"{d}/{x}").st_size for top in folders for d, _, names in os.walk(top) for x in names if x.startswith("shuffle_") and os.path.exists(f"{d}/{x}"))
    before = size()
    assert all(x["r2"] == 0 for x in selection.ngram_redundancy(docs, "k", claims.tokens(F.col("t")), (2, 3, 4)).collect())
    until = time.time() + 20  # Spark removes them meanwhile
    while size() - before > 500_000 and time.time() < until:
        time.sleep(0.5)
    assert size() - before < 500_000  # of 178,800 n-grams of 8 bytes


def test_character_shares_of_marks_among_letters(spark):
    r = random.Random(8)
    alphabet = "aZéǅ中9٣ \n\t  ·•" + routing.SEPARATORS + routing.PROGRESS + "_!\U0001f600"
    texts = ["".join(r.choices(alphabet, k=r.randint(1, 80))) for _ in range(60)]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", routing.character_shares(F.col("t")).alias("s")).collect()
    kinds = {"upper": lambda c: unicodedata.category(c) == "Lu", "lower": lambda c: unicodedata.category(c) == "Ll", "digit": lambda c: unicodedata.category(c) == "Nd"}
    kinds |= {"sep": lambda c: c in routing.SEPARATORS, "prog": lambda c: c in routing.PROGRESS, "ws": str.isspace}
    for x in got:
        for name, has in kinds.items():
            assert x.s[name] == pytest.approx(sum(map(has, texts[x.k])) / len(texts[x.k])), (name, texts[x.k])
    assert spark.range(1).select(routing.character_shares(F.lit(None).cast("string"))["sep"]).first()[0] == 0.0


def test_entropies_hold_no_text_twice():
    """Bytes are counted in the batch itself: a batch of 64 MB needs little beside it."""
    import tracemalloc

    import pyarrow as pa

    texts = pa.array(["aé" * 10_000, None, ""] + ["ab" * 32_768] * 1000)
    tracemalloc.start()
    found = tx.byte_entropies.func(texts).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[1] == found[2] == {"shannon": 0.0, "renyi2": 0.0} and found[3] == {"shannon": 1.0, "renyi2": 1.0}
    assert found[0]["shannon"] == pytest.approx(1.584963, abs=1e-6) and peak < 8 << 20
