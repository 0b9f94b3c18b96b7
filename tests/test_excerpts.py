"""Sentence relevance and selection against plain code."""

import math
import random
import re

import pytest

from siltstone.operators import excerpts


def plain_relevance(groups, queries):
    out = {}
    for g, rows in groups.items():
        n, average = len(rows), max(1.0, sum(len(t) for _, t in rows) / len(rows))
        for i, (_, terms) in enumerate(rows):
            out[g, i] = 0.0
            for q in set(queries.get(g, ())):
                f, df = terms.count(q), sum(q in t for _, t in rows)
                if f:
                    out[g, i] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(terms) / average))
    return out


def plain_choice(rows, relevance, budget):
    cost = [max(1, len(text) // 4) for text, _ in rows]
    taken, used, left = [], 0, [i for i in range(len(rows)) if relevance[i] > 0]
    if not left:
        for i in sorted(range(len(rows)), key=lambda i: (-len(rows[i][0]), i)):
            if taken and used + cost[i] > budget:
                break
            taken, used = [*taken, i], used + cost[i]
            if used >= budget:
                break
        return set(taken)
    alike = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0
    while left and used < budget:
        value = lambda i: 0.7 * relevance[i] - 0.3 * max(alike(rows[i][1], rows[j][1]) for j in taken) if taken else relevance[i]
        best = min(left, key=lambda i: (-value(i), i))
        left.remove(best)
        if used + cost[best] <= budget:
            taken, used = [*taken, best], used + cost[best]
    return set(taken)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    words = [f"w{i}" for i in range(25)]
    groups = {}
    for g in range(15):
        rows = []
        for _ in range(r.choice([1, 4, 30])):
            terms = r.choices(words, k=r.randint(0, 9))
            rows.append((" ".join(terms) + "x" * r.randint(0, 30), terms))
        groups[g] = rows
    return groups, {g: r.sample(words, 4) for g in groups if g % 5} | {5: ["none"]}, {g: r.choice([3, 20, 60]) for g in groups}


def test_relevance_and_selection(spark, texts):
    groups, queries, budgets = texts
    sentences = spark.createDataFrame([(g, i, text, terms) for g, rows in groups.items() for i, (text, terms) in enumerate(rows)], "group int, index int, text string, terms array<string>")
    asked = spark.createDataFrame(list(queries.items()), "group int, terms array<string>")
    limits = spark.createDataFrame(list(budgets.items()), "group int, budget int")
    scored = excerpts.sentence_relevance(sentences, asked).cache()
    want = plain_relevance(groups, queries)
    assert {(r["group"], r["index"]): r["relevance"] for r in scored.collect()} == pytest.approx(want, abs=1e-9)
    got = {}
    for r in excerpts.excerpts(scored, limits).collect():
        got.setdefault(r["group"], set()).add(r["index"])
    for g, rows in groups.items():
        assert got.get(g, set()) == plain_choice(rows, [want[g, i] for i in range(len(rows))], budgets[g]), g
    few = excerpts.excerpts(scored, limits, candidates=2).groupBy("group").count().collect()
    assert max(r["count"] for r in few) <= 2
    assert excerpts.excerpts(scored.limit(0), limits).count() == 0


@pytest.mark.parametrize("candidates", [512, 3])
def test_documents_are_cut_within_their_rows(spark, texts, candidates):
    from pyspark.sql import functions as F

    groups, queries, budgets = texts
    rows = [(g, [t for t, _ in own], queries.get(g), budgets[g]) for g, own in groups.items()]
    docs = spark.createDataFrame(rows, "k int, s array<string>, q array<string>, b int")
    words = lambda s: F.regexp_extract_all(s, F.lit(r"\w+"), F.lit(0))
    got = excerpts.document_excerpts(docs, "k", F.col("s"), words, "q", "b", candidates)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    seen = [(g, i, t, re.findall(r"\w+", t)) for g, own in groups.items() for i, (t, _) in enumerate(own)]
    sentences = spark.createDataFrame(seen, "group int, index int, text string, terms array<string>")
    asked = spark.createDataFrame([(g, queries.get(g, [])) for g in groups], "group int, terms array<string>")
    scored = excerpts.sentence_relevance(sentences, asked)
    limits = spark.createDataFrame(list(budgets.items()), "group int, budget int")
    taken = excerpts.excerpts(scored, limits, candidates).join(scored, ["group", "index"]).select("group", "index", "relevance", "text")
    rounded = lambda found: sorted((r[0], r[1], round(r[2], 9), r[3]) for r in found.collect())
    assert rounded(got) == rounded(taken)


def test_sentences_are_counted_within_a_row_and_shared_ids_together(spark, tmp_path):
    """No word leaves its row unless ids are shared or null or texts long; then all is still as in SQL."""
    import duckdb

    from siltstone.plans import queries

    r = random.Random(7)
    words = ["Ä", "the", "The", "x_1", "9", "-", "naïve", "", "a.b"]
    texts = [None, "", ". ", "...  . . a", *(". ".join(" ".join(r.choices(words, k=r.randint(0, 9))) for _ in range(r.choice([1, 3, 40]))) for _ in range(60))]
    docs = [(i, t) for i, t in enumerate(texts)]

    def found(rows, name):
        folder = tmp_path / name
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(folder / "documents.parquet"))
        got = queries.QUERIES["a17_sentence_statistics"](spark, str(folder))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        want = con.execute(queries.ORACLE_SQL["a17_sentence_statistics"]).fetchall()
        in_order = lambda rows: sorted(map(tuple, rows), key=str)
        assert in_order(got.collect()) == in_order(want)
        return got

    assert "Exchange" not in found(docs, "own")._jdf.queryExecution().executedPlan().toString()
    found([*docs, (5, "the x. the y"), (5, "the x. z. the"), (6, None), (None, "a b"), (None, "c. a")], "shared")
    found([*docs, (1000, ". ".join(["so long a text"] * 400_000))], "long")


def test_slices_of_texts_are_counted_alike(spark):
    from pyspark.sql import functions as F

    from siltstone.functions import sentences

    texts = [(0, "The end. the END. x"), (1, None), (2, "İI Σσς. ß ß"), (3, "é" * 5), (4, " ")]
    docs = spark.createDataFrame(texts, "k int, t string").coalesce(1)
    each = [{r["k"]: tuple(r["x"]) for r in docs.select("k", sentences.counted(F.col("t"), ". ", r"[^\pL\pN_]+", n).alias("x")).collect()} for n in (1, 20, 1 << 20)]
    assert each[0] == each[1] == each[2]
    assert each[0][0] == (3, 5, 2, 3) and each[0][1] == (1, 0, 0, 0) and each[0][3] == (1, 1, 1, 1) and each[0][4] == (1, 0, 0, 0)
    assert docs.filter("k > 9").select(sentences.counted(F.col("t"), ". ", "x")).count() == 0


def test_no_sentence_of_a_long_text_is_left_out(spark):
    """Of more than 512 sentences, the best differs from those before or is longer, although others are more relevant or of more terms."""
    from pyspark.sql import functions as F

    texts = {0: (["q a b"] * 520 + ["q c d e"] + ["x"] * 600, ["q"], 2), 1: (["a b c"] * 520 + ["z" * 40], ["q"], 10), 2: (["a b c"] * 3, None, 1)}
    want = {(0, 0), (0, 520), (1, 520), (2, 0)}
    docs = spark.createDataFrame([(k, *v) for k, v in texts.items()], "k int, s array<string>, q array<string>, b int")
    words = lambda s: F.regexp_extract_all(s, F.lit(r"\w+"), F.lit(0))
    assert {(r["k"], r["index"]) for r in excerpts.document_excerpts(docs, "k", F.col("s"), words, "q", "b").collect()} == want
    sentences = docs.select(F.col("k").alias("group"), F.posexplode("s").alias("index", "text")).withColumn("terms", words(F.col("text")))
    scored = excerpts.sentence_relevance(sentences, docs.filter("q IS NOT NULL").select(F.col("k").alias("group"), F.col("q").alias("terms")))
    assert {tuple(r) for r in excerpts.excerpts(scored, docs.select(F.col("k").alias("group"), F.col("b").alias("budget"))).collect()} == want


def test_sentences_are_chosen_as_if_each_were_looked_at_each_time():
    r = random.Random(11)
    for n in (0, 1, 7, 900):
        for budget in (0, 5, 60):
            rows = [(" ".join(t) + "x" * r.randint(0, 30), t) for t in (r.choices("abcdefgh", k=r.randint(0, 5)) for _ in range(n))]
            relevance = [r.choice([0.0, 0.1, 0.25, r.random()]) for _ in rows]
            got = excerpts._chosen([len(t) for t, _ in rows], relevance, [t for _, t in rows], budget)
            assert set(got) == plain_choice(rows, relevance, budget)
