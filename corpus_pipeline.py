"""A pipeline over documents: each stage works on all rows the one before kept.

All stages take null and empty texts, null and repeated ids, repeated rows, empty tables and
further columns of any name, and all but the last keep the columns of their input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import decontamination, line_quality, minmax_dedup, packing, secret_scan
from siltstone.llm._cluster import clear, mark, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the line classifier rejects.

    Null and empty texts are judged as one empty line; repeated rows are judged alike. Without
    labels of both kinds nothing is dropped.
    """
    return line_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five-word shingles, Jaccard index 0.8 or more).

    Null and empty texts and rows with a null id stay; of a kept document all repeated rows stay.
    """
    return minmax_dedup.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more are benchmark passages.

    Null and empty texts have no passages and stay; repeated rows are judged alike.
    """
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts and count their characters anew. All rows stay; null and empty texts stay as they are."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token sequences: one row for each piece of a document, with its ids. Null and empty texts are one piece of the end id; repeated rows are packed each."""
    return packing.pack(docs)


#: Near duplicates here are five-word shingles at 0.8; no SQL for the classifier's and the tokenizer's stages.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mask_secrets", mask_secrets),
    ("pack", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again.

    What a stage has written on the way, and its input, are deleted once its result is there.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = mark()
    for name, stage in STAGES:
        found = stage(spark, docs, sf_dir)
        path = shared_dir(spark, f"stage-{name}")
        found.write.parquet(path)
        clear(spark, since, keep=(path,))
        docs = spark.read.parquet(path)
    return docs
