"""Links between texts of source code by the symbols they define and use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import symbols
from siltstone.functions.code import identifiers


def symbol_table(fragments: DataFrame, key: str, text: str) -> DataFrame:
    """(symbol, target): the fragment that defines a symbol, of several the one with the greatest key."""
    found = fragments.select(key, F.explode(F.array_distinct(symbols.definitions(F.col(text)))).alias("symbol"))
    return found.groupBy("symbol").agg(F.max(key).alias("target"))


def symbol_links(fragments: DataFrame, key: str, text: str) -> DataFrame:
    """(src, dst, symbol, kind, strength): fragments and those that define a symbol they use, other than themselves.

    Imported symbols bind with strength 1, types with 0.9 and other uses with 0.7. What kind a
    use is shows in its own text, so texts aren't shuffled, only their symbols; a symbol has one
    row on the defining side, so a common one is a skewed join that Spark splits. What a text
    imports is found once for all its symbols.
    """
    known = fragments.select(F.col(key).alias("src"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"), symbols.imports(F.col(text)).alias("_imports"), F.array_distinct(identifiers(F.col(text))).alias("_names"))
    named = known.select("src", "_low", "_imports", F.explode("_names").alias("symbol"))
    used = named.select("src", "symbol", symbols.reference_kind(F.col("_low"), F.col("_imports"), F.col("symbol")).alias("kind"))
    found = used.join(symbol_table(fragments, key, text), "symbol").filter(F.col("src") != F.col("target"))
    return found.select("src", F.col("target").alias("dst"), "symbol", "kind", symbols.strength(F.col("kind")).alias("strength"))


def dead_symbols(fragments: DataFrame, key: str, source: str, text: str, most: int = 50) -> DataFrame:
    """(name, fragment, confidence): defined symbols that no text has as a word in any case, the surest most of them.

    Private names count 0.85, those of api, interface and types files 0.35 and others 0.6; ties go
    by name. Names of everyday meaning are left out. most is a limit of the report.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\pL\pN_]+"), F.lit(0))
    used = fragments.select(F.explode(F.array_distinct(F.filter(words, lambda w: F.octet_length(w) >= 2))).alias("_low")).distinct()
    defined = symbol_table(fragments, key, text).withColumn("_low", F.lower("symbol")).filter(~F.col("_low").isin(*symbols.GENERIC) & (F.octet_length("_low") > 1))
    dead = defined.join(used, "_low", "left_anti").join(fragments.select(F.col(key).alias("target"), F.col(source).alias("_source")), "target")
    public = F.col("_source").contains("api") | F.col("_source").contains("interface") | F.col("_source").contains("types")
    sure = F.when(F.col("symbol").startswith("_"), 0.85).when(public, 0.35).otherwise(0.6)
    return dead.select(F.col("symbol").alias("name"), F.col("target").alias("fragment"), sure.alias("confidence")).orderBy(F.col("confidence").desc(), "name").limit(most)
