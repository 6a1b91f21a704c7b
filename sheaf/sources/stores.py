"""Stored indexes, graphs, logs and the search settings."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators import graph, retrieval
from sheaf.operators.numbering import numbered
from sheaf.operators.providers import Providers
from sheaf.session import written

from . import files, segments
from .documents import table_exists


@dataclass(frozen=True)
class SearchConfig:
    dense_weight: float = retrieval.DENSE_WEIGHT
    sparse_weight: float = retrieval.SPARSE_WEIGHT
    rrf_k: int = retrieval.RRF_K
    top_k: int = 5

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def loads(cls, text: str) -> SearchConfig:
        return cls(**json.loads(text))


def write_settings(rows: DataFrame, path: str) -> None:
    """Search settings by ``name`` as JSON lines; fields of ``SearchConfig`` that the rows lack are its defaults."""
    base = asdict(SearchConfig())
    kinds = {"dense_weight": "double", "sparse_weight": "double", "rrf_k": "int", "top_k": "int"}
    rows.select("name", *(F.coalesce(F.col(c).cast(kinds[c]), F.lit(v).cast(kinds[c])).alias(c) if c in rows.columns else F.lit(v).cast(kinds[c]).alias(c) for c, v in base.items())).write.mode("overwrite").json(path)


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """``name`` and the fields of ``SearchConfig``."""
    return spark.read.schema("name string, dense_weight double, sparse_weight double, rrf_k int, top_k int").json(path)


def write_index(corpus: DataFrame, path: str) -> None:
    """A new version of the stored index, of a corpus ``(chunk_id, text)`` and of nothing else; the version before stays readable until it is committed (``segments``)."""
    segments.rebuild(corpus, path)


def read_index(spark: SparkSession, path: str) -> retrieval.Index | None:
    """The stored index as it was last committed; nothing if there is none."""
    return segments.open_index(spark, path)


def current_index(corpus: DataFrame, path: str) -> retrieval.Index:
    """The stored index, brought to the corpus if it is missing or any id or text differs; only what differs is tokenised."""
    segments.sync(corpus, path)
    return segments.open_index(corpus.sparkSession, path)


def write_graph(triplets: DataFrame, path: str) -> None:
    triplets.write.mode("overwrite").parquet(f"{path}/triplets")
    stored = triplets.sparkSession.read.parquet(f"{path}/triplets")
    graph.nodes(stored).write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges(stored).write.mode("overwrite").parquet(f"{path}/edges")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or an empty one where there is none."""
    return spark.read.schema(schema).parquet(path) if table_exists(spark, path) else spark.createDataFrame([], schema)


def append_log(rows: DataFrame, path: str) -> None:
    rows.withColumn("ts", F.coalesce("ts", F.current_timestamp()) if "ts" in rows.columns else F.current_timestamp()).write.mode("append").parquet(path)


#: Buckets of a stored graph's nodes and edges.
GRAPH_BUCKETS = 64
_FACT = "subject string, relationship string, object string, confidence double, source_file string, chunk_text string, chunk_id string, seq long"
_SEQ_BITS = 40


def build_graph(chunks: DataFrame, path: str, extract=None, per_source: int = 150, order: str = "chunk_id", most: int | None = None, buckets: int = GRAPH_BUCKETS) -> None:
    """Facts of an even sample of each source's chunks that have none yet, added to the stored ones; nodes and edges follow.

    A run is a batch. Its facts are written once, together with a row without a fact for each chunk that gave none, so an answered chunk is never asked
    again, whatever fails after it. Nodes and edges are merged by bucket: those that the batch's facts touch are read, merged and written
    over, the others stay. Each bucket says up to which batch it has been merged, and the state after all of them is committed last; a run
    that died in between is caught up by the next one, and no fact counts twice.
    """
    spark = chunks.sparkSession
    extract = extract or Providers().triplets
    old = read_table(spark, f"{path}/triplets", f"{_FACT}, batch int")
    processed = read_table(spark, f"{path}/processed", "chunk_id string")
    wanted = written(graph.unprocessed(graph.even_sample(chunks, "source_file", order, per_source, most), old, processed), "wanted")
    batch = max([int(n.removeprefix("batch=")) for n in files.names(spark, f"{path}/triplets") if n.startswith("batch=")], default=0) + 1
    names = [x.split()[0] for x in _FACT.split(", ")]
    found = written(extract(wanted).select(*names[:-1]), "facts")  # asked once
    silent = wanted.select("source_file", "chunk_id").join(found.select("chunk_id").distinct(), "chunk_id", "left_anti")
    rows = numbered(found.unionByName(silent, allowMissingColumns=True), ["source_file", "chunk_id"]).withColumn("seq", F.lit(batch << _SEQ_BITS) + F.col("_k")).withColumn("batch", F.lit(batch))
    rows.select(*names, "batch").write.mode("append").partitionBy("batch").parquet(f"{path}/triplets")
    wanted.select("chunk_id").write.mode("append").parquet(f"{path}/processed")
    _catch_up(spark, path, batch, buckets)


def _catch_up(spark: SparkSession, path: str, batch: int, buckets: int) -> None:
    """Merge the facts of the batches that are not in nodes and edges yet."""
    done = files.last_version(spark, f"{path}/state")
    first = (done["version"] if done else 0) + 1
    fresh = spark.read.schema(f"{_FACT}, batch int").parquet(f"{path}/triplets").where(F.col("batch").between(first, batch))
    buckets = done["buckets"] if done else buckets
    _merge_buckets(graph.node_parts(fresh, "batch"), f"{path}/nodes", ["node"], graph.merged_nodes, batch, buckets)
    _merge_buckets(graph.usable(fresh, "batch"), f"{path}/edges", ["subject", "object"], graph.merged_edges, batch, buckets)
    files.commit_version(spark, f"{path}/state", {"version": batch, "buckets": buckets})


def _merge_buckets(parts: DataFrame, path: str, key: list[str], combine, batch: int, buckets: int) -> None:
    """Put parts (with their ``batch``) into the buckets of their keys. A bucket is replaced as a whole, and skips what it has seen."""
    spark = parts.sparkSession
    held = written(parts.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")), "parts")
    touched = [r[0] for r in held.select("_bucket").distinct().collect()]  # a number a bucket at most
    if not touched and table_exists(spark, path):
        return
    columns = [c for c in held.columns if c not in ("_bucket", "batch")]
    if table_exists(spark, path):
        old = spark.read.parquet(path).where(F.col("_bucket").isin(touched))
        seen = old.groupBy(F.col("_bucket").alias("_b")).agg(F.max("_upto").alias("_seen"))
        held = held.join(seen, F.col("_bucket") == F.col("_b"), "left").where(F.col("batch") > F.coalesce("_seen", F.lit(0))).select(*columns)
        held = held.unionByName(old.select(*columns))
    merged = combine(held.select(*columns)).withColumn("_upto", F.lit(batch)).withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    # made before the buckets it was read from are replaced
    written(merged, "merged").hint("rebalance", "_bucket").sortWithinPartitions("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
