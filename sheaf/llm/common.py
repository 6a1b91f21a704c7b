"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.session import scratch, shared_folder, ship, written  # noqa: F401  for the operators

#: One word: a run of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
WORD_GROUP = r"([^\x20\x09-\x0D]+)"


materialize = written


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, also inside lambdas (an inlined expression would run once an element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(name: str = "text") -> Column:
    """The text column, null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def is_held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id's decimal text leaves 2 when divided by 4; a null id is held out as well, nothing is learned from it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Ready a session for Python workers: they can import this package, and keep Arrow batches to Python workers at 8 MB, however long the texts are, unless the session already asks for less."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key, "64m")).lower()
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    digits = now.rstrip("b")
    size = int(digits[:-1]) * scale[digits[-1]] if digits[-1:] in scale else int(digits)
    if size > 8 << 20:
        spark.conf.set(key, str(8 << 20))
