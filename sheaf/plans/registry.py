"""Names of the registered queries and their SQL twins."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.session import shared_folder, spread

from .casts import typed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query ``(spark, sf_dir) -> DataFrame`` and, where SQL can say the same, its twin."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = typed(name, sql)
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose texts are worked on: dealt to all cores if it is small."""
    return spread(table(spark, sf_dir, name))


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share."""
    return f"{shared_folder(spark)}/sheaf-{uuid.uuid4().hex}"


def stored_index(spark: SparkSession, sf_dir: str):
    """The index of the documents of a folder: built by the first query that asks, read by all others that share the folder for it.

    The table's size, file count and time of change name the index, so other documents in the same place get one of their own.
    """
    from sheaf.sources import segments

    path = f"{sf_dir}/documents.parquet"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = fs.getContentSummary(p)
    version = f"{path}|{held.getLength()}|{held.getFileCount()}|{fs.getFileStatus(p).getModificationTime()}"
    at = f"{shared_folder(spark)}/index-{hashlib.sha256(version.encode()).hexdigest()[:32]}"
    if segments.manifest(spark, at) is None:
        segments.rebuild(texts(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text"), at)
    return segments.open_index(spark, at)
