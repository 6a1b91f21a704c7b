"""A written vector store: records by chunk id, and an index of lists that follows it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators import lists

from . import files, keyed

RECORD = ("chunk_id", "text", "embedding", "crop_tags", "source_file", "trust_weight", "char_count", "authority_score", "bias_penalty", "year")


def upsert(chunks: DataFrame, path: str, encode: Callable[[Column], Column], *, buckets: int = keyed.BUCKETS) -> DataFrame:
    """Write the vector records of the chunks that the store lacks, and return them; tags are flattened to one string. Only chunks of unknown ids are encoded.

    ``encode`` is a column function (a pandas UDF that loads its model once).
    """
    spark = chunks.sparkSession
    t = keyed.opened(spark, f"{path}/records")
    if t:
        known = keyed.read(spark, f"{path}/records").select("chunk_id")
        chunks = chunks.join(known, "chunk_id", "left_anti")
    made = chunks.select("chunk_id", "text", encode(F.col("text")).alias("embedding"), F.array_join("crop_tags", ", ").alias("crop_tags"), *RECORD[4:])
    return keyed.append(made, f"{path}/records", ["chunk_id"], buckets=buckets)


def records(spark: SparkSession, path: str) -> DataFrame:
    return keyed.read(spark, f"{path}/records")


def index(spark: SparkSession, path: str) -> lists.Lists:
    """The index of the store's vectors, brought to its last version: new records are filed under the centroids at hand; when the store has doubled since they were fitted, all of it is filed anew."""
    t = keyed.opened(spark, f"{path}/records")
    if t is None:
        raise FileNotFoundError(f"no vectors in {path}")
    at = f"{path}/lists"
    found = files.last_version(spark, at)
    folders = sorted({f for own in t.folders.values() for f in own})
    if found is None or found["records"] != t.version:
        stored = records(spark, path)
        n = stored.count()
        known = set(found["folders"]) if found else set()
        if found is None or n >= 2 * found["fitted_on"] or not known <= set(folders):
            centroids = lists.fit(stored)
            made = {"version": (found or {"version": 0})["version"] + 1, "records": t.version, "folders": folders, "fitted_on": n, "centroids": f"centroids-{uuid.uuid4().hex}", "blocks": []}
            spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>").coalesce(1).write.parquet(f"{at}/{made['centroids']}")
            made["probes"] = lists.calibrated(stored, centroids) if len(centroids) else 0
            more = stored
        else:
            made = found | {"version": found["version"] + 1, "records": t.version, "folders": folders}
            centroids = _centroids(spark, at, found)
            new = [f"{path}/records/{f}/_bucket={b}" for b, own in t.folders.items() for f in own if f not in known]
            more = spark.read.schema(t.schema).parquet(*new) if new else None
        if more is not None and len(centroids):
            name = f"blocks-{uuid.uuid4().hex}"
            lists.file(more, centroids).write.parquet(f"{at}/{name}")
            made = made | {"blocks": [*made["blocks"], name]}
        files.commit_version(spark, at, made)
        found = made
    kind = dict(records(spark, path).dtypes)["chunk_id"]
    schema = f"list int, ids array<{kind}>, matrix binary"
    blocks = spark.read.schema(schema).parquet(*(f"{at}/{b}" for b in found["blocks"])) if found["blocks"] else spark.createDataFrame([], schema)
    return lists.Lists(_centroids(spark, at, found), blocks, found["probes"])


def _centroids(spark: SparkSession, at: str, made: dict) -> np.ndarray:
    rows = spark.read.parquet(f"{at}/{made['centroids']}").orderBy("list").collect()  # a row a list
    return np.array([r.centroid for r in rows], np.float64).reshape(len(rows), -1)
