"""Ranking of files for a query by terms of texts and paths and by marks of the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import retrieval
from siltstone.functions.vocabulary import counted
from siltstone.operators.lineage import cut

# How counts saturate, how lengths of texts and of paths count, weight of a path.
K1, TEXT_B, PATH_B, PATH_WEIGHT = 1.5, 0.75, 0.5, 2.5


def rank_files(files: DataFrame, query: str, key: str, path: str, text: str, weights: dict[str, float] | None = None) -> DataFrame:
    """(key, path, relevance, marks, score) of every row: relevance of its terms, divided by the largest, and its marks.

    Terms in paths weigh 2.5. Those that only the expansion of the query has add e / (1 + e) of
    their sum e, times rank_expansion_weight (0 to 1), so no number of them outweighs the query.
    weights replace those of retrieval.WEIGHTS; other names are passed over. Null paths and texts are
    empty; rows with equal keys are rows like all. Without a term relevance is 0 throughout.

    Texts are split once, and each different word is looked at once: what is kept of each is two lengths, two counts for each term of the
    query (its own and four subjects' words at most) and the marks. Two rows of totals are broadcast.
    """
    held = retrieval.WEIGHTS | {k: v for k, v in (weights or {}).items() if k in retrieval.WEIGHTS}
    spread = min(1.0, max(0.0, held["rank_expansion_weight"]))
    asked = files.sparkSession.range(1).select(F.lit(query).alias("q")).select(retrieval.query_tokens(F.col("q")).alias("base"), retrieval.expand_query(F.col("q")).alias("terms")).withColumn("known", retrieval.subjects(F.col("base"))).first()
    base, terms, known = asked["base"], asked["terms"], asked["known"]
    place = {t: i for i, t in enumerate(terms)}

    def describe(run: str) -> tuple[int, tuple[int, ...]]:
        """How many terms a run of a text has, and the places of the query's terms among them."""
        own = retrieval.tokens_of(run)
        return len(own), tuple(place[t] for t in own if t in place)

    few = lambda c: F.filter(c, lambda x: x.isin(*terms)) if terms else F.slice(c, 1, 0)
    counts = lambda c: retrieval.once(few(c), lambda own: F.transform(wanted, lambda t: F.size(F.filter(own, lambda x: x == t))))
    wanted = F.array(*map(F.lit, terms)).cast("array<string>")
    split = files.select(F.col(key).alias("key"), F.coalesce(F.col(path), F.lit("")).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    split = split.select("key", "path", retrieval.marks(F.col("path"), F.col("text"), known, base, terms, held).alias("marks"), counted(F.col("text"), retrieval.BETWEEN, describe, len(terms)).alias("w"), retrieval.tokens(F.replace("path", F.lit("\\"), F.lit("/"))).alias("p"))
    slim = cut(split.select("key", "path", "marks", F.col("w.n").alias("wl"), F.size("p").alias("pl"), F.col("w.hits").alias("wf"), counts("p").alias("pf")))

    df = F.array(*(F.count_if((F.col("wf")[i] > 0) | (F.col("pf")[i] > 0)) for i in range(len(terms)))).cast("array<bigint>")
    average = lambda c: F.greatest(F.lit(1.0), F.coalesce(F.avg(c), F.lit(1.0)))
    totals = slim.agg(F.count(F.lit(1)).alias("n"), average("wl").alias("awl"), average("pl").alias("apl"), df.alias("df"))
    both = slim.crossJoin(F.broadcast(totals))
    in_text = F.lit(1.0) / (1 - TEXT_B + TEXT_B * F.col("wl") / F.col("awl"))
    in_path = F.lit(PATH_WEIGHT) / (1 - PATH_B + PATH_B * F.col("pl") / F.col("apl"))
    worth = F.zip_with(F.zip_with("wf", "pf", lambda w, p: w * in_text + p * in_path), "df", lambda f, d: F.log(1 + (F.col("n") - d + 0.5) / (d + 0.5)) * f * (K1 + 1) / (f + K1))

    def total(own: bool) -> Column:
        places = [i for i, t in enumerate(terms) if (t in base) == own]
        return F.aggregate(F.array(*map(F.lit, places)).cast("array<int>"), F.lit(0.0), lambda a, i: a + F.get("worth", i))

    scored = both.select("key", "path", "marks", worth.alias("worth")).select("key", "path", "marks", total(True).alias("own"), total(False).alias("more"))
    scored = scored.select("key", "path", "marks", (F.col("own") + spread * F.col("more") / (1 + F.col("more"))).alias("raw"))
    top = scored.agg(F.max("raw").alias("top"))
    relevance = F.when(F.col("top") > 0, F.col("raw") / F.col("top")).otherwise(F.lit(0.0))
    return scored.crossJoin(F.broadcast(top)).select(F.col("key").alias(key), "path", relevance.alias("relevance"), "marks", (held["bm25f"] * relevance + F.col("marks")).alias("score"))
