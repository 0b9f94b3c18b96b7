"""Terms, expansion of queries and ranking of files against plain code."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from siltstone.functions import retrieval
from siltstone.operators import files

WORDS = ["parseRequest", "charged", "matches", "classes", "status", "queries", "the", "HTTPServer2Error", "save_order_items", "_x", "A1b", "über", "mapping", "mapper", "stored", "東京都庁", "日", "한국어", "ab", "OrderRecord", "convertRowToRecord", "INSERT INTO", "x"]
PATHS = ["a/src/services/x_mapper.py", "tests/a_test.go", "b\\dist\\charged.min.js", "web/components/OrderView.tsx", "status.txt", "", None, "db/.env", "a/b.c/queries"]


def plain_stem(w):
    n = len(w.encode())
    if n >= 6 and w.endswith("ies"):
        return w[:-3] + "y"
    if n >= 6 and re.search("(s|x|z|ch|sh)es$", w):
        return w[:-2]
    for least, end in ((7, "ing"), (6, "ed")):
        if n >= least and w.endswith(end):
            return w[: -len(end)]
    if n >= 5 and re.search("[^su]s$", w):
        return w[:-1]
    return w[:-1] if n >= 6 and re.search("[^e]e$", w) else None


def plain_tokens(text):
    out = []
    for name in re.findall(r"[A-Za-z_][A-Za-z0-9_]{2,}", text or ""):
        camel = re.findall(r"[0-9]+|[A-Z][a-z]+|[A-Z]+(?![a-z])|[a-z]+", name)
        pieces = {name.lower()} | {p for p in name.lower().split("_") + [c.lower() for c in camel] if len(p) > 2}
        out += sorted((pieces | {plain_stem(p) for p in pieces}) - {None} - set(retrieval.STOP_WORDS))
    for run in re.findall("[぀-ヿ㐀-䶿一-鿿가-힯]+", text or ""):
        out += [run[i : i + 2] for i in range(max(1, len(run) - 1))]
    return out


def plain_root(w):
    for end, instead in (("ings", ""), ("ing", ""), ("ied", "y"), ("ies", ""), ("ed", ""), ("es", ""), ("s", "")):
        if w.endswith(end) and len(w) - len(end) >= 3:
            return w[: -len(end)] + instead
    return w


def plain_query(query):
    base = {t for t in plain_tokens(query) if len(t) > 2 or not t.isascii()}
    roots = {plain_root(t) for t in base}
    known = {name for name, words in retrieval.CLUSTERS.items() if roots & {plain_root(w) for w in words}}
    wide = known | {n for k in known for n in retrieval.LINKS[k]}
    return base, known, base | {w for n in wide for w in retrieval.CLUSTERS[n]}


def plain_rank(rows, query):
    base, known, terms = plain_query(query)
    split = [(plain_tokens(text), plain_tokens((path or "").replace("\\", "/"))) for _, path, text in rows]
    n = len(rows)
    average = [max(1.0, sum(len(s[i]) for s in split) / n) for i in (0, 1)]
    df = {t: sum(t in w or t in p for w, p in split) for t in terms}
    raw = []
    for w, p in split:
        worth = {}
        for t in terms:
            f = w.count(t) / (0.25 + 0.75 * len(w) / average[0]) + 2.5 * p.count(t) / (0.5 + 0.5 * len(p) / average[1])
            worth[t] = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.5 / (f + 1.5)
        more = math.fsum(v for t, v in worth.items() if t not in base)
        raw.append(math.fsum(v for t, v in worth.items() if t in base) + 0.35 * more / (1 + more))
    return [r / (max(raw) or 1) for r in raw], known


def some_rows(seed, n):
    pick = random.Random(seed)
    return [(i, pick.choice(PATHS), None if i % 11 == 0 else " ".join(pick.choices(WORDS, k=pick.randint(0, 30)))) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    return some_rows(5, 60)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, path string, text string")


def test_tokens_and_queries(spark, rows):
    q = retrieval.query_tokens(F.col("text"))
    got = {r["id"]: r for r in frame(spark, rows).select("id", retrieval.tokens(F.col("text")).alias("t"), q.alias("q"), retrieval.subjects(q).alias("s"), retrieval.expand_query(F.col("text")).alias("e")).collect()}
    for i, _, text in rows:
        base, known, terms = plain_query(text)
        assert sorted(got[i]["t"]) == sorted(plain_tokens(text))
        assert set(got[i]["q"]) == base and len(got[i]["q"]) == len(base)
        assert set(got[i]["s"]) == known
        assert got[i]["e"] == sorted(terms, key=lambda t: t.encode())


@pytest.mark.parametrize("query", ["how are charged orders stored", "status of 東京都庁", "mapping tests of records", "", "the"])
def test_rank(spark, rows, query):
    want, _ = plain_rank(rows, query)
    got = {r["id"]: r for r in files.rank_files(frame(spark, rows), query, "id", "path", "text").collect()}
    assert len(got) == len(rows)
    for (i, path, _), r in zip(rows, want):
        assert got[i]["relevance"] == pytest.approx(r, abs=1e-9)
        assert got[i]["score"] == pytest.approx(got[i]["relevance"] + got[i]["marks"], abs=1e-12)
        assert got[i]["path"] == (path or "")


def test_marks(spark):
    """Each mark by itself; the sums are of the fixed weights."""
    rows = [
        (0, "a/src/services/x.py", "none", 0.08 + 0.22), (1, "web/components/y.py", "none", -0.30), (2, "tests/z.py", "none", -0.45), (3, "a\\DIST\\z.py", "none", -0.55),
        (4, "u.py", "convertRowTo2(x)", 0.0), (11, "u.py", "convertRowToX1(x)", 0.40), (5, "u.py", "select a\nfrom b", 0.30), (6, "u.py", "an OrderRecord", 0.22), (7, "u.py", "Parse_all()", 0.16), (8, "a/stored.tar.gz", "", 0.30), (9, "a/stored.gz", "", 0.30), (10, None, None, 0.0),
    ]
    asked = "mapping stored requests"
    base, known, terms = plain_query(asked)
    assert known == {"mapping", "persistence", "ingest"}
    df = spark.createDataFrame([r[:3] for r in rows], "id int, path string, text string")
    got = {r["id"]: r["m"] for r in df.select("id", retrieval.marks(F.col("path"), F.col("text"), sorted(known), sorted(base), sorted(terms)).alias("m")).collect()}
    for i, _, _, m in rows:
        assert got[i] == pytest.approx(m), i
    plain = {r["id"]: r["m"] for r in df.select("id", retrieval.marks(F.col("path"), F.col("text"), [], ["test"], []).alias("m")).collect()}
    assert plain == pytest.approx({i: 0.08 if i == 0 else 0.0 for i, *_ in rows})


def test_rank_edges(spark):
    """An empty table has no rows; equal keys stay apart; weights count and unknown ones don't."""
    assert files.rank_files(frame(spark, []), "stored orders", "id", "path", "text").count() == 0
    twice = frame(spark, [(1, "a.py", "charged order"), (1, "a.py", "charged order"), (1, "a.py", "nothing here")])
    found = files.rank_files(twice, "charged", "id", "path", "text", {"bm25f": 2.0, "no such": 9.0}).collect()
    assert sorted(r["score"] for r in found) == pytest.approx([0.0, 2.0, 2.0])
    for weight, more in ((0.0, 0.0), (9.0, 1.0)):
        rows = frame(spark, [(1, "a", "mapper"), (2, "b", "upsert dao"), (3, "c", "nothing")])
        got = {r["id"]: r["relevance"] for r in files.rank_files(rows, "stored mapper", "id", "path", "text", {"rank_expansion_weight": weight}).collect()}
        assert got[1] == 1.0 and (got[2] > 0) == (more > 0) and got[3] == 0
    long = frame(spark, [(1, "a.py", "charged " * 200_000), (2, "b.py", "charged")])
    assert files.rank_files(long, "charged", "id", "path", "text").count() == 2


def test_words_are_described_as_columns_do(spark):
    """What is found out of a word by itself is what the columns find in texts; each different word is looked at once."""
    from siltstone.functions import code, vocabulary

    pick = random.Random(3)
    pieces = ["HTML", "Parser", "get", "_", "__", "2", "ies", "boxes", "ing", "used", "glass", "tree", "Ärger", "ß", "É", "ciónes", "Σας", "東", "東京都", "ｶﾅ", "def", "the", "x", "9", "İ", " ", "-", "\n"]
    rows = [(i, "".join(pick.choices(pieces, k=pick.randint(0, 12)))) for i in range(400)] + [(400, None), (401, ""), (402, "used " * 5000)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    found = df.select("id", "text", code.code_tokens(F.col("text")).alias("c"), retrieval.tokens(F.col("text")).alias("r")).collect()
    by_code = lambda text: [t for run in re.split(r"[^\w]+", text or "") for t in code.tokens_of(run, code.parts_of(run))]
    by_files = lambda text: [t for run in re.split(retrieval.BETWEEN, text or "") for t in retrieval.tokens_of(run)]
    for row in found:
        assert row["c"] == by_code(row["text"]), row
        assert sorted(row["r"]) == sorted(by_files(row["text"])), row
    hits = lambda w: (len(w), (0, 0) if w == "used" else (1,) if w == "get" else ())
    for row in df.select("id", "text", vocabulary.counted(F.col("text"), " ", hits, 2).alias("c")).collect():
        words = (row["text"] or "").split(" ")
        assert row["c"]["n"] == sum(map(len, words)) and row["c"]["hits"] == [2 * words.count("used"), words.count("get")]
    assert df.limit(0).select(vocabulary.counted(F.col("text"), " ", hits, 2)).count() == 0


def test_ranking_looks_at_a_repeated_word_once(spark, monkeypatch):
    """The plans of both rankings hold no array of a text's terms."""
    from siltstone.operators import ranking

    plans = []
    for module in (ranking, files):
        monkeypatch.setattr(module, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    docs = spark.createDataFrame([(1, "a.py", "charged orders")], "id int, path string, text string")
    ranking.code_bm25(docs, "charged", "id", "text", "path")
    files.rank_files(docs, "charged", "id", "path", "text")
    assert len(plans) == 2 and not any("regexp_extract_all(text" in p or "regexp_extract_all(coalesce(text" in p for p in plans)
