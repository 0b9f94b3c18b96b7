"""Append-only JSON-lines logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prune(lines: DataFrame, ts_key: str, cutoff: float, column: str = "value") -> DataFrame:
    """Lines to keep: those whose ts_key is cutoff or later, and those that aren't JSON.

    A ts_key that is missing or no number (a quoted one too) counts as 0, as does that of JSON
    without keys; blank and null lines go. JSON that stays is written anew, with sorted keys.
    """
    value = F.try_parse_json(F.col(column))
    stamp = F.try_variant_get(value, f"$.{ts_key}", "variant")
    number = F.coalesce(F.schema_of_variant(stamp).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))
    ts = F.when(number, F.try_variant_get(value, f"$.{ts_key}", "double")).otherwise(F.lit(0.0))
    kept = lines.filter((F.trim(column) != "") & (value.isNull() | (ts >= cutoff)))
    return kept.withColumn(column, F.coalesce(F.to_json(value), F.trim(column)))


def write(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    rows.write.mode("append").json(path)


def read(spark, path: str, schema: str) -> DataFrame:
    """Rows of a log with a fixed schema; lines that don't parse are in _corrupt."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
