"""Shared storage, lineage cuts and joins on hot keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 1000

#: Bytes of one Arrow batch to or from Python. Texts fill a batch long before its rows do, and both sides hold several.
BATCH_BYTES = "8m"

_OWN_BASE: list[str] = []
_TABLES: list[str] = []


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir).

    Where that is unset, a local session takes a temporary folder; on a cluster executors
    couldn't see one, so this raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN_BASE:
            _OWN_BASE.append(tempfile.mkdtemp(prefix="siltstone-"))
            atexit.register(shutil.rmtree, _OWN_BASE[0], True)
        base = _OWN_BASE[0]
    path = f"{base.rstrip('/')}/siltstone-{label}-{uuid.uuid4().hex}"
    _TABLES.append(path)
    return path


def mark() -> int:
    """A place in the list of written tables; clear() removes those written after it."""
    return len(_TABLES)


def clear(spark: SparkSession, since: int, keep: tuple[str, ...] = ()) -> None:
    """Delete the tables written since mark(), but for those to keep. Nothing may read them any more."""
    for path in _TABLES[since:]:
        if path not in keep:
            _remove(spark, path)
    _TABLES[since:] = [p for p in _TABLES[since:] if p in keep]


def discard(*tables: DataFrame | None) -> None:
    """Delete stashed tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_stashed_at", None)
        if path in _TABLES:
            _remove(table.sparkSession, path)
            _TABLES.remove(path)


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lost executors cost no recomputation and lineage ends here."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stashed_at = path
    return found


def bounded(docs: DataFrame) -> DataFrame:
    """docs, after Arrow batches of its session are set to BATCH_BYTES at most, unless the user set a size."""
    conf = docs.sparkSession.conf
    if conf.get(_BATCHES, None) in (None, "67108864b", "64MB"):
        conf.set(_BATCHES, BATCH_BYTES)
    return docs


_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def join_counted(rows: DataFrame, counted: DataFrame, key: list[str], n: str, total: int, how: str = "left") -> DataFrame:
    """Join rows with a table that has one row for each key and, in column n, how many of the rows have that key.

    Keys that hold HOT_SHARE of all rows or more number 1 / HOT_SHARE at most, because their
    counts add up to no more than total; they are broadcast. The other keys are shuffled and no
    task can get more than HOT_SHARE of the rows for one of them. rows is read once.
    """
    least = max(2, int(total * HOT_SHARE))
    out = [c for c in counted.columns if c not in key]
    hot = counted.filter(F.col(n) >= least).select(*key, *(F.col(c).alias(f"_hot_{c}") for c in out), F.lit(True).alias("_hot"))
    cold = counted.filter(F.col(n) < least).select(*key, F.lit(0).alias("_salt"), *out, F.lit(True).alias("_cold"))
    first = rows.join(F.broadcast(hot), key, "left")
    # rows of hot keys have their match by now; a salt that the other side lacks deals them out evenly
    # (by the row's content: a task that is run again must deal a row out as before)
    salt = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(997)).cast("int"))
    both = first.withColumn("_salt", salt).join(cold, [*key, "_salt"], "left")
    if how == "inner":
        both = both.filter(F.col("_hot") | F.col("_cold"))
    return both.select(*rows.columns, *(F.coalesce(F.col(f"_hot_{c}"), F.col(c)).alias(c) for c in out))


#: A written table of up to so many bytes is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 8 << 20


def fits(df: DataFrame, row_bytes: int = 48) -> bool:
    """Whether a table of rows of about row_bytes may be broadcast. df must be a written table."""
    most = BROADCAST_BYTES // row_bytes
    return df.limit(most + 1).count() <= most


def sized(df: DataFrame, row_bytes: int = 48) -> DataFrame:
    """df with a broadcast hint if it fits."""
    return F.broadcast(df) if fits(df, row_bytes) else df
