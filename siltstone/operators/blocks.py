"""Lines, chunks and turns of texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What ends a line of a text.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def token_chunks(docs: DataFrame, chunk: int = 360, overlap: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, token_start, token_end) of overlapping windows over the tokens of each document; none for those without tokens.

    A token starts with an ASCII letter or digit; such characters, _ and ' go on. Hyphens part tokens.
    """
    step = max(chunk - overlap, 1)
    n = F.regexp_count(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("-"), F.lit(" ")), F.lit(r"[A-Za-z0-9][A-Za-z0-9_']*"))
    counted = docs.select(F.col(id_col), n.alias("_n")).filter("_n > 0")
    last = F.greatest(F.lit(0), F.ceil((F.col("_n") - chunk) / step)).cast("int")
    chunks = counted.select(id_col, "_n", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    start = (F.col("chunk_index") * step).cast("long")
    return chunks.select(id_col, F.col("chunk_index").cast("long").alias("chunk_index"), start.alias("token_start"), F.least(start + chunk, F.col("_n").cast("long")).alias("token_end"))


def repetition_floods(docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, run): runs of least or more consecutive equal non-empty lines, trimmed. Lines of one document stay together."""
    lines = docs.select(F.col(id_col), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), LINE_END)).alias("pos", "line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))
    w = Window.partitionBy(id_col)
    island = lines.withColumn("_g", F.col("pos") - F.row_number().over(w.partitionBy(id_col, "line").orderBy("pos")))
    return island.filter("line <> ''").groupBy(id_col, "line", "_g").agg(F.count(F.lit(1)).alias("run")).filter(F.col("run") >= least).drop("_g")


def first_by_prefix(docs: DataFrame, width: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(prefix_sha256, id, n): the smallest id of the documents whose first width characters are equal, and their number."""
    return docs.groupBy(F.sha2(F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, width), 256).alias("prefix_sha256")).agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("n"))


def forward_overlap(turns: DataFrame, group: str, order: str, tokens: F.Column) -> DataFrame:
    """(group, order, overlap): Jaccard index of a turn's terms with the next turn's; 0 for the last."""
    from siltstone.functions.text import term_jaccard

    w = Window.partitionBy(group).orderBy(order)
    seen = turns.withColumn("_t", F.array_distinct(tokens)).withColumn("_next", F.lead("_t").over(w))
    return seen.select(group, order, F.coalesce(term_jaccard(F.col("_t"), F.col("_next")), F.lit(0.0)).alias("overlap"))


def line_chunks(docs: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """(key, chunk, text): each text in runs of whole lines of at most so many UTF-8 bytes; a longer line stands alone and whole.

    Null and empty texts give no rows; most of 0 or less gives the whole text. One text is held
    at a time, in Python, as each chunk's start depends on the one before.
    """

    def runs(text: str | None) -> list[str]:
        found, size = [], 0
        for line in (text or "").splitlines(keepends=True):
            n = len(line.encode("utf-8", "surrogatepass"))
            if not found or (most > 0 and size + n > most):
                found.append([])
                size = 0
            found[-1].append(line)
            size += n
        return ["".join(lines) for lines in found]

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(runs, na_action=None)

    return docs.select(key, F.posexplode(cut(F.col(text))).alias("chunk", "text"))


def blast_radius(beliefs: DataFrame, key: str, texts: list[str], changed: list[str]) -> DataFrame:
    """(key, n_affected, risk): beliefs of which one of the texts holds the stem of a changed file in any case; risk low up to 2 of them, medium up to 5, else high.

    changed is a list from the caller, so it is part of the plan; files without a stem match all.
    """
    stems = {re.sub(r"(?<=.)\.[^.]*$", "", f.rsplit("/", 1)[-1]).lower() for f in changed}
    hit = F.lit(False)
    for stem in sorted(stems):
        for text in texts:
            hit = hit | F.coalesce(F.lower(text).contains(stem), F.lit(False))
    found = beliefs.filter(hit).select(key)
    n = found.agg(F.count(F.lit(1)).alias("n_affected"))
    risk = F.when(F.col("n_affected") <= 2, "low").when(F.col("n_affected") <= 5, "medium").otherwise("high")
    return found.crossJoin(F.broadcast(n)).withColumn("risk", risk)  # one row
