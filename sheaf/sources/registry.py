"""The registry of processed files: an append-only log whose latest row of a file is its state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str = "filename", at: str = "processed_at") -> DataFrame:
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("s")).select(key, *(F.col(f"s.{c}").alias(c) for c in rest))


def done(log: DataFrame, **names: str) -> DataFrame:
    """Files that need no more work; failed ones are tried again."""
    return latest(log, **names).where(F.col("status") == "done")


def summary(log: DataFrame, **names: str) -> DataFrame:
    return latest(log, **names).groupBy("status").agg(F.count("*").alias("n"))


def reset(log: DataFrame, files: DataFrame, key: str = "filename") -> DataFrame:
    """The log without the listed files, so that they are extracted anew."""
    return log.join(files.select(key), key, "left_anti")


def next_id(chunk_log: DataFrame) -> int:
    """The number after the highest of ``chunk_000123`` ids; 1 for an empty store."""
    top = chunk_log.agg(F.max(F.regexp_extract("chunk_id", r"(\d+)$", 1).cast("long"))).first()[0]
    return 1 if top is None else top + 1
