"""Incremental ingest: a file stream, once over what is new, exactly-once ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators import chunking
from sheaf.operators.providers import Providers
from sheaf.sources.documents import append_chunks, clean_pages, pages_of


def stable_ids(chunked: DataFrame) -> DataFrame:
    """Ids from (source, number): a batch that runs again after a failure makes the same ones."""
    return chunked.withColumn("chunk_id", F.concat(F.lit("chunk_"), F.lower(F.hex(F.xxhash64("source_file"))), F.lit("_"), F.lpad(F.col("chunk_no").cast("string"), 6, "0")))


def chunks_of(docs: DataFrame, metadata: DataFrame, next_score=chunking.always_next) -> DataFrame:
    """Extracted documents to finished chunks."""
    text = chunking.full_text(clean_pages(pages_of(docs))).withColumnRenamed("filename", "source_file")
    return stable_ids(chunking.with_metadata(chunking.chunks(text, "source_file", next_score=next_score), metadata))


def ingest_stream(spark: SparkSession, source: str, store: str, checkpoint: str, metadata: DataFrame, schema: str, to_documents: Callable[[DataFrame], DataFrame] = lambda df: df, registry: str | None = None, file_format: str = "json", providers: Providers = Providers()):
    """Start an available-now stream over ``source``: new files become chunks in ``store``, then a row each in ``registry``.

    The checkpoint remembers files; ids are stable and the append is an anti join, so a repeated batch adds nothing twice.
    The registry is written last: a file is done only after its chunks are.
    """

    def batch(df: DataFrame, _: int) -> None:
        docs = to_documents(df)
        made = chunks_of(docs, metadata, providers.next_sentence).persist()  # for the store and the registry
        append_chunks(made, store, by="source_file")  # an id is made from its source
        if registry:
            counts = made.groupBy(F.col("source_file").alias("filename")).agg(F.count("*").cast("int").alias("chunks_created"), F.sort_array(F.collect_list("chunk_id")).alias("chunk_ids"))
            rows = docs.select("filename").distinct().join(counts, "filename", "left")
            rows.select(
                "filename", F.lit("done").alias("status"), F.coalesce("chunks_created", F.lit(0)).alias("chunks_created"), F.current_timestamp().alias("processed_at"), "chunk_ids", F.lit(None).cast("string").alias("error"),
            ).write.mode("append").parquet(registry)
        made.unpersist()

    stream = spark.readStream.schema(schema).format(file_format).load(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
