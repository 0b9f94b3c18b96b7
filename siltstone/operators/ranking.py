"""Ranking of documents for a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import code
from siltstone.functions.text import words
from siltstone.functions.vocabulary import counted
from siltstone.operators.lineage import cut

K1, B = 1.2, 0.75


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, dl): how often each term occurs in a document, and the document's terms."""
    split = docs.select(F.col(id_col).alias("id"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("w")).withColumn("dl", F.size("w"))
    return split.select("id", "dl", F.explode("w").alias("term")).groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of documents with a term of the query: sum of ln((N - df + .5) / (df + .5) + 1) times the saturated term frequency.

    Texts are split once: what is kept of each is its length and the query terms' frequencies.
    """
    wanted = sorted(set(terms))
    split = docs.select(F.col(id_col).alias("id"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    tf = F.transform(F.array(*map(F.lit, wanted)), lambda t: F.size(F.filter("w", lambda x: x == t)))
    slim = cut(split.select("id", F.size("w").alias("dl"), tf.alias("tf")))
    stats = slim.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.coalesce(F.avg("dl"), F.lit(1.0)), F.lit(1.0)).alias("avgdl"), F.array(*(F.count_if(F.col("tf")[i] > 0) for i in range(len(wanted)))).alias("df"))
    idf = F.transform("df", lambda d: F.log((F.col("n") - d + 0.5) / (d + 0.5) + 1))
    part = lambda tf, idf: idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = slim.filter(F.exists("tf", lambda x: x > 0)).crossJoin(F.broadcast(stats))
    return scored.select("id", F.aggregate(F.zip_with("tf", idf, part), F.lit(0.0), lambda a, x: a + x).alias("score"))


def top_k(scored: DataFrame, k: int, score: str = "score", key: str = "id") -> DataFrame:
    return scored.orderBy(F.col(score).desc(), F.col(key)).limit(k)


# Words that no query is about.
STOP_WORDS = (
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "before",
    "but", "by", "can", "could", "did", "do", "does", "for", "from", "had", "has", "have", "he",
    "her", "him", "how", "i", "if", "in", "into", "is", "it", "its", "just", "may", "me", "might",
    "more", "my", "no", "not", "of", "on", "or", "our", "out", "she", "should", "so", "some",
    "that", "the", "them", "then", "there", "they", "this", "to", "up", "us", "was", "we", "were",
    "what", "when", "where", "which", "who", "why", "will", "with", "would", "you", "your",
)


def query_terms(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores with two bytes or more that aren't stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(found, lambda w: (F.octet_length(w) >= 2) & ~w.isin(*STOP_WORDS))


def key_terms(queries: DataFrame, docs: DataFrame, query_id: str, k: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, term, weight): the k terms of each query with the most tf * (ln(N / (1 + df)) + 1).

    tf is a term's share of the query's terms; N and df are over the documents and the query
    itself. Only document frequencies of terms that a query has are joined.
    """
    split = queries.select(query_id, query_terms(F.col(text_col)).alias("w"))
    tf = split.select(query_id, F.size("w").alias("_n"), F.explode("w").alias("term")).groupBy(query_id, "_n", "term").agg(F.count(F.lit(1)).alias("_tf"))
    asked = tf.select("term").distinct()
    each = docs.select(F.explode(F.array_distinct(query_terms(F.col(text_col)))).alias("term"))
    df = each.groupBy("term").agg(F.count(F.lit(1)).alias("_df")).join(asked, "term", "left_semi")
    total = docs.agg(F.count(F.lit(1)).alias("_docs"))
    idf = F.log((F.col("_docs") + 1) / (2 + F.coalesce("_df", F.lit(0)))) + 1
    scored = tf.join(df, "term", "left").crossJoin(F.broadcast(total)).select(query_id, "term", F.round(F.col("_tf") / F.col("_n") * idf, 6).alias("weight"))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("weight"), "term"))
    return scored.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")


#: Weights, times a term's idf, of paths that hold it, of files named by it and of identifiers that have a part of it.
PATH_BOOST, NAME_BOOST, IDENTIFIER_BOOST = 8.0, 12.0, 3.0


def code_bm25(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(id, coverage, base, path_boost, identifier_boost, score) of every row for a query over code.

    Terms are those of code_tokens(); base is BM25 of them, times 1 + 1.5 * coverage^3 in the
    score, where coverage is the share of terms found in text, path or identifiers. Texts are
    split once, and each different word is looked at once: what is kept of a text is its length
    and a few numbers for each term of the query.
    """
    spark = docs.sparkSession
    asked = spark.range(1).select(code.code_tokens(F.lit(query)).alias("t")).select("t", F.transform("t", code.split_identifier).alias("p")).first()
    if not asked["t"]:
        zero = (F.lit(0.0).alias(c) for c in ("coverage", "base", "path_boost", "identifier_boost", "score"))
        return docs.select(F.col(id_col).alias("id"), *zero)
    path = F.coalesce(F.lower(F.col(path_col)), F.lit(""))
    terms = asked["t"]
    # a term's places: of itself, and after these of the terms that have it as a part
    own_places = {t: tuple(i for i, x in enumerate(terms) if x == t) for t in terms}
    part_places = {p: [len(terms) + i for i, ps in enumerate(asked["p"]) if p in ps] for ps in asked["p"] for p in ps}

    def describe(run: str) -> tuple[int, tuple[int, ...]]:
        """How many terms a run of a text has, and the places of the query's terms that it has or, as an identifier, has a part of."""
        parts = code.parts_of(run)
        own = code.tokens_of(run, parts)
        hits = [i for t in own if t in own_places for i in own_places[t]]
        if any(p in part_places for p in parts) and code.is_identifier(run):
            hits += {i for p in parts for i in part_places.get(p, ())}
        return len(own), tuple(hits)

    found = docs.select(F.col(id_col).alias("id"), path.alias("path"), code.path_tokens(F.col(path_col)).alias("in_path"), code.file_stem(F.col(path_col)).alias("name"), counted(F.col(text_col), code.BETWEEN, describe, 2 * len(terms)).alias("c"))
    hits = [
        F.struct(
            F.col("c.hits")[i].alias("tf"), (F.contains("path", F.lit(t)) | F.array_contains("in_path", t)).alias("path"), F.array_contains("in_path", t).alias("token"),
            (F.col("name") == t).alias("name"), (F.col("c.hits")[len(terms) + i] > 0).alias("part"),
        )
        for i, t in enumerate(terms)
    ]
    slim = cut(found.select("id", F.col("c.n").alias("dl"), F.array(*hits).alias("hits")))
    df = F.array(*(F.count_if((F.col("hits")[i]["tf"] > 0) | F.col("hits")[i]["token"]) for i in range(len(hits))))
    stats = slim.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.coalesce(F.avg("dl"), F.lit(1.0)), F.lit(1.0)).alias("avgdl"), df.alias("df"))
    both = slim.crossJoin(F.broadcast(stats)).withColumn("x", F.zip_with("hits", "df", lambda h, d: F.struct(h.alias("h"), F.log((F.col("n") - d + 0.5) / (d + 0.5) + 1).alias("idf"))))
    total = lambda f: F.aggregate(F.transform("x", f), F.lit(0.0), lambda a, v: a + v)
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    base = total(lambda x: x["idf"] * x["h"]["tf"] * (K1 + 1) / (x["h"]["tf"] + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))
    paths = total(lambda x: x["idf"] * (PATH_BOOST * one(x["h"]["path"]) + NAME_BOOST * one(x["h"]["name"])))
    names = total(lambda x: x["idf"] * IDENTIFIER_BOOST * one(x["h"]["part"]))
    found = total(lambda x: one((x["h"]["tf"] > 0) | x["h"]["path"] | x["h"]["part"])) / len(hits)
    scored = both.select("id", found.alias("coverage"), base.alias("base"), paths.alias("path_boost"), names.alias("identifier_boost"))
    return scored.withColumn("score", F.col("base") * (1 + 1.5 * F.pow("coverage", F.lit(3))) + F.col("path_boost") + F.col("identifier_boost"))


# Words that a search passes over.
PASSED_OVER = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can", "to",
    "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "and", "but",
    "or", "not", "no", "if", "then", "than", "that", "this", "it", "its", "we", "you", "he", "she",
    "they", "my", "your", "how", "what", "which", "where", "when", "who", "about",
)


def search_terms(text: Column) -> Column:
    """Lower-case runs of letters and digits of two or more bytes without those passed over, in order, repeats too; none for null."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{IsAlphabetic}\p{N}]+")
    return F.filter(parts, lambda t: (F.octet_length(t) > 1) & ~t.isin(*PASSED_OVER))


def fielded_search(docs: DataFrame, key: str, entity: str, title: str, body: str, terms: list[str], k: int) -> DataFrame:
    """(key, score): the k best rows for terms, which come from search_terms; ties go to the lower key.

    A term weighs 3 for each time it is in the entity, 2 in the title and its share of the body's terms, times
    ln(rows / rows with it), 0.1 at least. Repeated terms count again. Only weights of the terms leave a row, so
    nothing but one row of counts and the k best is shuffled.
    """
    different = list(dict.fromkeys(terms))
    if not different:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    split = docs.select(key, *(search_terms(F.col(c)).alias(f"_{n}") for n, c in (("e", entity), ("t", title), ("b", body))))
    hits = split.select(key, *(F.filter(c, lambda x: x.isin(*different)).alias(c) for c in ("_e", "_t", "_b")), F.greatest(F.size("_b"), F.lit(1)).alias("_len"))
    times = lambda field, t: F.size(F.filter(F.col(field), lambda x: x == t))
    weight = lambda t: 3.0 * times("_e", t) + 2.0 * times("_t", t) + times("_b", t) / F.col("_len")
    weights = hits.select(key, *(weight(F.lit(t)).alias(f"_w{i}") for i, t in enumerate(different)))
    counts = weights.agg(F.count(F.lit(1)).alias("_n"), *(F.count(F.when(F.col(f"_w{i}") > 0, 1)).alias(f"_d{i}") for i in range(len(different))))
    idf = lambda i: F.greatest(F.log(F.col("_n") / F.greatest(F.col(f"_d{i}"), F.lit(1))), F.lit(0.1))
    score = sum((terms.count(t) * F.col(f"_w{i}") * idf(i) for i, t in enumerate(different)), F.lit(0.0))
    # the counts are one row
    scored = weights.crossJoin(F.broadcast(counts)).select(key, F.round(score, 9).alias("score"))
    return scored.filter("score > 0").orderBy(F.desc("score"), key).limit(k)
