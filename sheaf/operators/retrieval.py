"""Ranked retrieval: BM25 index and search, dense search, fusion, comparison of methods.

Queries come as a frame ``(query_id, ...)``; every operator answers all of them. Ties are broken by the chunk id after the
rounded score, so results are total orders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.functions.numbers import rounded
from sheaf.functions.text import tokens
from sheaf.session import written

from .inverted import Index, best_chunks, index_of

DENSE_WEIGHT, SPARSE_WEIGHT, RRF_K = 0.6, 0.4, 60


def ranked(df: DataFrame, score: str, k: int | None = None, name: str = "rank", by: tuple[str, ...] = ("query_id",), tie: str = "chunk_id") -> DataFrame:
    """Rows with their rank by a descending score in each query; the limit is pushed below the shuffle."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie)))
    return out.where(F.col(name) <= k) if k else out


# --- sparse ---------------------------------------------------------------------------------------------------------

def postings(corpus: DataFrame) -> DataFrame:
    """``term, chunk_id, tf, doc_len`` of a corpus ``(chunk_id, text)``; a chunk without a token has none.

    Tokens are sorted and counted inside their row, so nothing is shuffled.
    """
    toks = corpus.select("chunk_id", F.sort_array(tokens(F.col("text"))).alias("s"))
    first = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: ~F.get("s", i).eqNullSafe(F.get("s", i - 1)))
    starts = F.when(F.size("s") > 0, first).otherwise(F.array().cast("array<int>"))  # a filter would tokenise once more
    runs = F.transform("at", lambda i, k: F.struct(F.get("s", i).alias("term"), (F.coalesce(F.get("at", k + 1), F.size("s")) - i).cast("long").alias("tf")))
    return toks.select("chunk_id", "s", starts.alias("at")).select("chunk_id", F.size("s").alias("doc_len"), F.explode(runs).alias("r")).select("r.term", "chunk_id", "r.tf", "doc_len")


def query_terms(queries: DataFrame, stop_words=None) -> DataFrame:
    """``query_id, term, qf`` of ``(query_id, query)``: terms with their multiplicity."""
    toks = tokens(F.col("query"), stop_words) if stop_words is not None else tokens(F.col("query"))
    return queries.select("query_id", F.explode(toks).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))


def sparse_topk(corpus: DataFrame | Index, queries: DataFrame, k: int = 10, stop_words=None) -> DataFrame:
    """``query_id, chunk_id, sparse_score, sparse_rank``: positive scores over the query's best, four places. Of a stored index, or of a corpus that is indexed on the way; blocks that cannot reach the top k are skipped."""
    index = corpus if isinstance(corpus, Index) else index_of(corpus)
    found = best_chunks(index, query_terms(queries, stop_words), k)
    share = found.select("query_id", "chunk_id", rounded(F.col("raw") / F.col("best"), 4).alias("sparse_score"))
    return ranked(share, "sparse_score", k, "sparse_rank")


# --- dense ----------------------------------------------------------------------------------------------------------

QUERY_BLOCK = 4096
VECTOR_BLOCK = 16_384
#: Scores that a task holds at once (some copies of 8 bytes each).
CELLS = 1 << 20


def vector_blocks(vectors: DataFrame, id_col: str, vec_col: str, size: int) -> DataFrame:
    """``ids, matrix``: unit vectors in blocks of at most ``size``, doubles row by row; blocks are cut where the rows are, nothing is shuffled."""
    kind = dict(vectors.dtypes)[id_col]

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, size):
                part = b.slice(i, size)
                flat = part.column(1).flatten()
                m = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)), pa.array([m.tobytes()], pa.binary())], ["ids", "matrix"])

    return vectors.where(F.col(vec_col).isNotNull()).select(id_col, vec_col).mapInArrow(run, f"ids array<{kind}>, matrix binary")


def best_pairs(asked: np.ndarray, held: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``asked``, places in ``held`` and cosines to four places of each query's best ``k``; some queries at a time, so that no more than ``CELLS`` scores are held at once."""
    step = max(1, CELLS // max(len(held), 1))
    for i in range(0, len(asked), step):
        scores = np.round(asked[i : i + step] @ held.T, 9)
        shown = np.floor(np.abs(scores) * 1e4 + 0.5) / 1e4 * np.sign(scores)
        edge = -np.partition(-shown, k - 1, axis=1)[:, k - 1 : k] if shown.shape[1] > k else np.full((len(shown), 1), -9.0)
        q, at = np.nonzero(shown >= edge)  # ties at the edge come along, the rank settles them
        yield q + i, at, shown[q, at]


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, chunk_id, dense_score, dense_rank``: exact cosine, four places.

    Blocks of ``vectors (chunk_id, embedding)`` meet blocks of queries ``(query_id, query_vec)``: every query is asked of every vector, as exact search must; the
    planner broadcasts the queries' blocks while they are small and deals pairs of partitions otherwise. A pair of blocks keeps its
    best ``k`` a query before anything is shuffled. Vectors must have the same number of dimensions.
    """
    kind = {"chunk_id": dict(vectors.dtypes)["chunk_id"], "query_id": dict(queries.dtypes)["query_id"]}
    schema = f"query_id {kind['query_id']}, chunk_id {kind['chunk_id']}, dense_score double"
    asked = vector_blocks(queries, "query_id", "query_vec", QUERY_BLOCK).select(F.col("ids").alias("query_ids"), F.col("matrix").alias("query_matrix"))

    def run(batches):
        for b in batches:
            for ids, data, names, other in zip(b.column(0), b.column(1), b.column(2), b.column(3), strict=True):
                ids, names = ids.values, names.values
                m = np.frombuffer(data.as_py(), np.float64).reshape(len(ids), -1)
                for q, at, shown in best_pairs(np.frombuffer(other.as_py(), np.float64).reshape(len(names), -1), m, k):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), ids.take(pa.array(at)), pa.array(shown)], ["query_id", "chunk_id", "dense_score"])

    pairs = vector_blocks(vectors, "chunk_id", "embedding", VECTOR_BLOCK).crossJoin(asked)
    return ranked(pairs.mapInArrow(run, schema), "dense_score", k, "dense_rank")


# --- fusion ---------------------------------------------------------------------------------------------------------

def merged(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Full outer merge of both result lists; a missing score is 0, a missing rank null."""
    both = dense.join(sparse, ["query_id", "chunk_id"], "full")
    return both.select("query_id", "chunk_id", F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"), F.coalesce("sparse_score", F.lit(0.0)).alias("sparse_score"), "dense_rank", "sparse_rank")


def found_by() -> Column:
    tags = F.array(F.when(F.col("dense_rank").isNotNull(), "dense"), F.when(F.col("sparse_rank").isNotNull(), "sparse"))
    return F.array_join(F.filter(tags, lambda x: x.isNotNull()), "+")


def hybrid(dense: DataFrame, sparse: DataFrame, trust: DataFrame, k: int = 5, *, nonpositive_trust_as_one: bool = True) -> DataFrame:
    """Weighted fusion of candidates (2k each): ``(0.6 dense + 0.4 sparse) trust``, four places. ``trust (chunk_id, trust_weight)``."""
    w = F.coalesce("trust_weight", F.lit(1.0))
    if nonpositive_trust_as_one:
        w = F.when(w <= 0, 1.0).otherwise(w)
    out = merged(dense, sparse).join(trust, "chunk_id", "left").withColumn("trust_weight", w)
    score = rounded((DENSE_WEIGHT * F.col("dense_score") + SPARSE_WEIGHT * F.col("sparse_score")) * F.col("trust_weight"), 4)
    return ranked(out.withColumn("final_score", score).withColumn("found_by", found_by()), "final_score", k)


def rrf(dense: DataFrame, sparse: DataFrame, k: int = 5) -> DataFrame:
    """Reciprocal rank fusion of candidates (3k each); a missing rank counts as 3k + 1."""
    missing = 3 * k + 1
    score = sum(1.0 / (RRF_K + F.coalesce(c, F.lit(missing))) for c in ("dense_rank", "sparse_rank"))
    out = merged(dense, sparse).withColumn("rrf_score", rounded(score, 6)).withColumn("found_by", found_by())
    return ranked(out, "rrf_score", k)


def compare(dense: DataFrame, sparse: DataFrame, trust: DataFrame, k: int = 3) -> DataFrame:
    """The top k of all four methods over the same queries: ``method, query_id, rank, chunk_id, score``. Inputs hold 3k candidates; they are written once, four methods read them."""
    dense, sparse = written(dense, "dense"), written(sparse, "sparse")
    pick = lambda df, method, score, rank="rank": df.select(F.lit(method).alias("method"), "query_id", F.col(rank).alias("rank"), "chunk_id", F.col(score).alias("score"))
    d, s = dense.where(F.col("dense_rank") <= 2 * k), sparse.where(F.col("sparse_rank") <= 2 * k)
    return (
        pick(dense.where(F.col("dense_rank") <= k), "dense", "dense_score", "dense_rank")
        .unionByName(pick(sparse.where(F.col("sparse_rank") <= k), "sparse", "sparse_score", "sparse_rank"))
        .unionByName(pick(hybrid(d, s, trust, k), "hybrid", "final_score"))
        .unionByName(pick(rrf(dense, sparse, k), "rrf", "rrf_score"))
    )
