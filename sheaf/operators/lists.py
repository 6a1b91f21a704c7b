"""Approximate search of vectors by lists: every vector is filed under its nearest centroid, a query reads the lists of the centroids nearest to it.

Centroids are means of a sample of at most ``SAMPLE`` vectors (fewer, so that no more than ``SAMPLE_BYTES`` reach the driver), the only
thing that is sampled; the lists hold every vector. A list is stored as blocks of ids and unit vectors. A search joins the
queries' probes with the blocks on the list's number: a (query, vector) pair that shares no probed list never meets, and a long list is many rows, which a skew
join may split. How many lists a query must read depends on the vectors (few where they lie in clusters, a large part of them where they lie anyhow), so it is
measured: ``calibrated`` asks a bounded sample of the vectors exactly and takes the number that finds ``TARGET`` of their neighbours. Search of
all lists is exact; ``recall`` measures what a search has found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.session import ship, written

from .retrieval import CELLS, best_pairs, dense_topk, ranked

SAMPLE, SAMPLE_BYTES = 65_536, 64 << 20
MOST_LISTS, ROUNDS = 16_384, 12
#: Vectors of a stored block, queries of a probe block.
BLOCK, QUERY_BLOCK = 8192, 1024
#: Queries that are asked exactly to choose the number of lists, and the share of their neighbours to be found.
ASKED, TARGET = 256, 0.96


def unit(flat: np.ndarray, width: int) -> np.ndarray:
    m = flat.astype(np.float64).reshape(-1, width)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


@dataclass(frozen=True)
class Lists:
    """``centroids``: unit vectors, one a list; ``blocks (list, ids, matrix)``: doubles row by row; ``probes``: lists that a query reads."""

    centroids: np.ndarray
    blocks: DataFrame
    probes: int


def fit(vectors: DataFrame, vec_col: str = "embedding", lists: int | None = None) -> np.ndarray:
    """Centroids by spherical k-means of a sample by hash; without a number of lists, the square root of the number of vectors."""
    held = vectors.where(F.col(vec_col).isNotNull())
    n = held.count()
    if n == 0:
        return np.zeros((0, 0))
    width = len(held.select(vec_col).first()[0])
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(width, 1))))
    rows = held.select(vec_col).orderBy(F.xxhash64(vec_col)).limit(most).collect()
    x = unit(np.array([r[0] for r in rows], np.float64).ravel(), width)
    k = max(1, min(lists or round(n**0.5), MOST_LISTS, len(x)))
    at = np.random.default_rng(7).permutation(len(x))[:k]
    c = x[np.sort(at)]
    for _ in range(ROUNDS):
        own = _nearest(x, c, 1)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        used = np.bincount(own, minlength=k) > 0
        c = np.where(used[:, None], sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300), c)
    return c


def _nearest(x: np.ndarray, centroids: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the ``k`` nearest centroids of each row, nearest first."""
    out = np.empty((len(x), k), np.int64)
    step = max(1, CELLS // max(len(centroids), 1))
    for i in range(0, len(x), step):
        near = np.round(x[i : i + step] @ centroids.T, 12)
        out[i : i + step] = np.argsort(-near, axis=1, kind="stable")[:, :k]
    return out


def file(vectors: DataFrame, centroids: np.ndarray, id_col: str = "chunk_id", vec_col: str = "embedding") -> DataFrame:
    """``list, ids, matrix`` of every vector that is not null, in blocks of one list; the vectors of a list that come together in a task make its blocks."""
    kind = dict(vectors.dtypes)[id_col]
    ship(vectors.sparkSession)
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def name(batches):
        for b in batches:
            if b.num_rows:
                x = unit(b.column(1).flatten().to_numpy(zero_copy_only=False), shared.value.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(_nearest(x, shared.value, 1)[:, 0].astype(np.int32)), b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["list", "id", "vector"])

    def put(batches):
        for b in batches:
            at = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            cuts = [(i, min(i + BLOCK, j)) for start, j in zip(edges[:-1], edges[1:], strict=True) for i in range(start, j, BLOCK)]
            if len(at):
                yield pa.RecordBatch.from_arrays([
                    pa.array([at[i] for i, _ in cuts], pa.int32()), pa.array([b.column(1).slice(i, j - i).to_pylist() for i, j in cuts], pa.list_(b.column(1).type)),
                    pa.array([b"".join(b.column(2).slice(i, j - i).to_pylist()) for i, j in cuts], pa.binary())], ["list", "ids", "matrix"])

    named = vectors.where(F.col(vec_col).isNotNull()).select(id_col, vec_col).mapInArrow(name, f"list int, id {kind}, vector binary")
    return named.repartitionByRange("list", F.xxhash64("id")).sortWithinPartitions("list").mapInArrow(put, f"list int, ids array<{kind}>, matrix binary")


def calibrated(vectors: DataFrame, centroids: np.ndarray, k: int = 10, target: float = TARGET, id_col: str = "chunk_id", vec_col: str = "embedding") -> int:
    """The least number of lists in which ``target`` of the ``k`` nearest other vectors of ``ASKED`` sampled ones lie."""
    held = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("chunk_id"), F.col(vec_col).alias("embedding"))
    asked = written(held.orderBy(F.xxhash64("chunk_id", F.lit("asked"))).limit(ASKED).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vec")), "asked")
    near = dense_topk(held, asked, k + 1).where("chunk_id != query_id").join(asked, "query_id").join(held, "chunk_id").select("query_vec", "embedding")
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def place(batches):
        for b in batches:
            if b.num_rows:
                q, x = (unit(b.column(i).flatten().to_numpy(zero_copy_only=False), shared.value.shape[1]) for i in (0, 1))
                order = _nearest(q, shared.value, len(shared.value))
                at = np.argmax(order == _nearest(x, shared.value, 1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32))], ["place"])

    places = sorted(r.place for r in near.mapInArrow(place, "place int").collect())  # ASKED x k numbers and ties
    return places[min(len(places) - 1, int(np.ceil(target * len(places))) - 1)] + 1 if places else 1


def search(index: Lists, queries: DataFrame, k: int = 10, n_probes: int | None = None) -> DataFrame:
    """``query_id, chunk_id, dense_score, dense_rank``: of queries ``(query_id, query_vec)``, the best ``k`` of the probed lists, cosine to four places. A block keeps its best ``k`` a query before anything is shuffled."""
    kinds = {"query_id": dict(queries.dtypes)["query_id"], "chunk_id": index.blocks.schema["ids"].dataType.elementType.simpleString()}
    schema = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, dense_score double"
    spark = queries.sparkSession
    if not len(index.centroids):
        return ranked(spark.createDataFrame([], schema), "dense_score", k, "dense_rank")
    ship(spark)
    shared, n = spark.sparkContext.broadcast(index.centroids), min(n_probes or index.probes, len(index.centroids))

    def probe(batches):
        for b in batches:
            for at in range(0, b.num_rows, QUERY_BLOCK):
                part = b.slice(at, QUERY_BLOCK)
                x = unit(part.column(1).flatten().to_numpy(zero_copy_only=False), shared.value.shape[1])
                near = _nearest(x, shared.value, n)
                own = np.argsort(near.ravel(), kind="stable")
                lists, query = near.ravel()[own], own // n
                edges = np.append(np.flatnonzero(np.diff(lists, prepend=-1)), len(lists))
                # a list's queries at a time: all of them together would hold each vector once a probe
                for i, j in zip(edges[:-1], edges[1:], strict=True):
                    own = query[i:j]
                    yield pa.RecordBatch.from_arrays([pa.array(lists[i : i + 1].astype(np.int32)), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), part.column(0).take(pa.array(own))), pa.array([x[own].tobytes()], pa.binary())], ["list", "query_ids", "query_matrix"])

    def score(batches):
        width = shared.value.shape[1]
        for b in batches:
            for ids, data, names, other in zip(b.column(0), b.column(1), b.column(2), b.column(3), strict=True):
                ids, names = ids.values, names.values
                for q, at, shown in best_pairs(np.frombuffer(other.as_py(), np.float64).reshape(-1, width), np.frombuffer(data.as_py(), np.float64).reshape(-1, width), k):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), ids.take(pa.array(at)), pa.array(shown)], ["query_id", "chunk_id", "dense_score"])

    asked = queries.where(F.col("query_vec").isNotNull()).select("query_id", "query_vec").mapInArrow(probe, f"list int, query_ids array<{kinds['query_id']}>, query_matrix binary")
    return ranked(index.blocks.join(asked, "list").select("ids", "matrix", "query_ids", "query_matrix").mapInArrow(score, schema), "dense_score", k, "dense_rank")


def pairs_met(index: Lists, queries: DataFrame, n_probes: int | None = None) -> int:
    """(Query, vector) pairs that share a probed list: what a search compares."""
    held = index.blocks.select("list", F.size("ids").alias("n")).groupBy("list").agg(F.sum("n").alias("n"))
    spark = queries.sparkSession
    shared, n = spark.sparkContext.broadcast(index.centroids), min(n_probes or index.probes, len(index.centroids))

    def probe(batches):
        for b in batches:
            if b.num_rows:
                x = unit(b.column(0).flatten().to_numpy(zero_copy_only=False), shared.value.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(_nearest(x, shared.value, n).ravel().astype(np.int32))], ["list"])

    asked = queries.where(F.col("query_vec").isNotNull()).select("query_vec").mapInArrow(probe, "list int").groupBy("list").agg(F.count("*").alias("m"))
    return held.join(asked, "list").agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row ``n_queries, recall``: the share of the exact results ``(query_id, chunk_id)`` that were found, a query as much as any other."""
    hits = exact.join(found.select("query_id", "chunk_id").distinct().withColumn("hit", F.lit(1.0)), ["query_id", "chunk_id"], "left")
    return hits.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("r")).agg(F.count("*").alias("n_queries"), F.avg("r").alias("recall"))


def build(vectors: DataFrame, lists: int | None = None) -> Lists:
    """An index that is written for this session."""
    centroids = fit(vectors, lists=lists)
    return Lists(centroids, written(file(vectors, centroids), "lists"), calibrated(vectors, centroids) if len(centroids) else 0)
