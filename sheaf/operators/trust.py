"""Authority, freshness and consistency scores, the trust filter and its report."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.functions.numbers import rounded
from sheaf.functions.rules import DECAY, EVALUATION_YEAR, FRESHNESS, LEAST_FRESHNESS, OTHER_DECAY
from sheaf.session import ship

LEAST_RA, MIN_MSCP, LEAST_TRUST = 0.35, 0.55, 0.22


def rerank_by_authority(results: DataFrame, by: str = "query_id") -> DataFrame:
    """``ra_score = round(final * authority (1 - bias), 4)`` and its rank; authority falls back to the trust weight, then 1."""
    authority = F.coalesce("authority_score", "trust_weight", F.lit(1.0))
    trust = authority * (1 - F.coalesce("bias_penalty", F.lit(0.0)))
    out = results.withColumn("authority_score", authority).withColumn("ra_score", rounded(F.col("final_score") * trust, 4))
    return out.withColumn("ra_rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("ra_score"), "chunk_id")))


def matched_source(filename: Column, keys=FRESHNESS) -> Column:
    """The first registry key that is a substring of the lower-cased file name."""
    low = F.lower(filename)
    return F.coalesce(*(F.when(F.contains(low, F.lit(k.lower())), F.lit(k)) for k, _, _ in keys))


def temporal_decay(results: DataFrame, source: str, query_type: Column, *, registry=FRESHNESS, year: int = EVALUATION_YEAR, by: str = "query_id") -> DataFrame:
    """Freshness by exponential decay, its label (on the unrounded score) and rank; unknown sources score 0.5 and are outdated."""
    key = matched_source(F.col(source), registry)
    rate = F.coalesce(*(F.when(query_type == t, F.lit(r)) for t, r in DECAY.items()), F.lit(OTHER_DECAY))
    base = F.coalesce(*(F.when(F.col("temporal_source_match") == k, F.lit(b)) for k, b, _ in registry))
    published = F.coalesce(*(F.when(F.col("temporal_source_match") == k, F.lit(y)) for k, _, y in registry))
    age = F.greatest(F.lit(0), F.lit(year) - published)
    raw = F.col("_raw")
    label = F.when(raw.isNull(), "OUTDATED").when(raw >= 0.85, "FRESH").when(raw >= 0.70, "ACCEPTABLE").when(raw >= 0.55, "AGING").otherwise("OUTDATED")
    return (
        results.withColumn("temporal_source_match", key)
        .withColumn("age_years", age).withColumn("_raw", base * F.exp(-rate * F.col("age_years")))
        .withColumn("temporal_score", F.coalesce(rounded("_raw", 4), F.lit(0.5))).withColumn("freshness_label", label).drop("_raw")
        .withColumn("temporal_rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("temporal_score"), "retrieval_rank")))
    )


def filter_stale(results: DataFrame, least: float = LEAST_FRESHNESS) -> DataFrame:
    scores = [F.col(c) for c in ("temporal_score", "final_score") if c in results.columns]
    return results.where(F.coalesce(*scores, F.lit(0.0)) >= least)


def final_trust(results: DataFrame, by: str = "query_id") -> DataFrame:
    """``final_trust``, whether a result is included, and why; if none of a query is, its best is the fallback."""
    out = results.withColumn("final_trust", rounded(F.col("ra_score") * F.col("mscp_score") * F.col("authority_score"), 4))
    out = out.withColumn("passes", F.col("trusted") & (F.col("final_trust") >= LEAST_TRUST))
    group = Window.partitionBy(by)
    best = F.row_number().over(group.orderBy(F.desc("final_trust"), "chunk_id"))
    out = out.withColumn("_any", F.max(F.col("passes").cast("int")).over(group)).withColumn("_best", best)
    fallback = (F.col("_any") == 0) & (F.col("_best") == 1)
    # How consistency went; the fallback has a reason of its own.
    reason = F.when(fallback, "fallback_best_available").otherwise(F.col("lcr_reason"))
    return out.withColumn("included", F.col("passes") | fallback).withColumn("reason", reason).drop("_any", "_best")


def with_consistency(results: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """``mscp_score, trusted, skipped, lcr_reason``: 1 and skipped below ``LEAST_RA`` or without sampled answers to compare (fast path); else from ``scores (query_id, chunk_id, mscp_score)``, 0.5 and trusted where sampling failed."""
    if scores is None:
        return results.withColumns({"mscp_score": F.lit(1.0), "trusted": F.lit(True), "skipped": F.lit(True), "lcr_reason": F.lit("lcr_skipped_fast_path")})
    joined = results.join(scores, ["query_id", "chunk_id"], "left")
    skipped, none = F.col("ra_score") < LEAST_RA, F.col("mscp_score").isNull()
    score = F.when(skipped, 1.0).otherwise(F.coalesce("mscp_score", F.lit(0.5)))
    trusted = skipped | none | (F.col("mscp_score") >= MIN_MSCP)
    why = F.when(skipped, "below_min_score_skipped").when(none, "no_samples_returned").when(trusted, "consistent").otherwise("inconsistent_answers")
    return joined.withColumns({"skipped": skipped, "trusted": trusted, "lcr_reason": why, "mscp_score": score})


def trust_report(scored: DataFrame, by: str = "query_id") -> DataFrame:
    return scored.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if("included").alias("trusted_count"), F.count_if(~F.col("included")).alias("excluded_count"), F.bool_or(~F.col("skipped")).alias("lcr_ran"))


def trust_pipeline(results: DataFrame, consistency: DataFrame | None = None) -> DataFrame:
    """Authority rank, consistency where scores are given (slow path), final trust and inclusion."""
    return final_trust(with_consistency(rerank_by_authority(results), consistency))


def largest_share(labels: Column) -> Column:
    """Largest cluster's share of an array of labels, four places; fewer than two labels count as agreement."""
    most = F.array_max(F.transform(F.array_distinct(labels), lambda x: F.size(F.filter(labels, lambda y: y == x))))
    return F.when(F.coalesce(F.size(labels), F.lit(0)) < 2, 1.0).otherwise(rounded(most / F.size(labels), 4))


@lru_cache(maxsize=16)
def _labelings(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All labelings of ``n`` points by at most ``k`` clusters in order of first use, those of fewer clusters first, and for each the weight of every pair in its inertia.

    A cluster's inertia is the sum of its pairs' squared distances over its size, so a labeling's is one product with the distances.
    """
    rows = [()]
    for _ in range(n):
        rows = [r + (c,) for r in rows for c in range(min(k, max(r, default=-1) + 2))]
    rows.sort(key=lambda r: (len(set(r)), r))
    labels = np.array(rows, np.int8).reshape(len(rows), n)
    i, j = np.triu_indices(n, 1)
    sizes = (labels[:, :, None] == labels[:, None, :]).sum(axis=2)
    return labels, np.where(labels[:, i] == labels[:, j], 1.0 / sizes[:, i], 0.0)


def best_partitions(x: np.ndarray, k: int) -> np.ndarray:
    """Labels of the partition into at most ``k`` clusters with the least inertia, of each of many groups ``(group, point, dimension)``, by enumeration (a handful of points a group).

    Ties go to the partition with fewer clusters, then the first in label order, so coincident points share a cluster.
    """
    labels, weights = _labelings(x.shape[1], k)
    i, j = np.triu_indices(x.shape[1], 1)
    inertia = np.round(((x[:, i] - x[:, j]) ** 2).sum(axis=2) @ weights.T, 9)
    return labels[inertia.argmin(axis=1)]


#: Up to this many points are split by enumeration, which grows as 3^n.
MOST_ENUMERATED = 12


def lloyd(x: np.ndarray, k: int) -> list[int]:
    """Labels by k-means from the farthest points on, for more points than can be enumerated; repeatable, and coincident points share a cluster."""
    centres = [x.mean(axis=0)]
    centres[0] = x[((x - centres[0]) ** 2).sum(axis=1).argmax()]
    while len(centres) < k:
        centres.append(x[np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0).argmax()])
    c, labels = np.stack(centres), None
    for _ in range(100):
        now = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        if labels is not None and (now == labels).all():
            break
        labels = now
        c = np.stack([x[labels == i].mean(axis=0) if (labels == i).any() else c[i] for i in range(k)])
    return labels.tolist()


def clusters(x: np.ndarray) -> list[int]:
    """Labels of at most three clusters of all points."""
    k = min(3, len(x))
    return best_partitions(x[None], k)[0].tolist() if len(x) <= MOST_ENUMERATED else lloyd(x, k)


#: Groups that are split together.
_GROUPS = 256


def mscp(answers: DataFrame) -> DataFrame:
    """``query_id, chunk_id, mscp_score`` of sampled answers ``(query_id, chunk_id, sample, embedding)``: the largest of min(3, n) clusters over n.

    A group holds the samples of one chunk, five by design; groups of the same size are split together, exactly, those of more than twelve by k-means.
    """
    kinds = dict(answers.dtypes)
    ship(answers.sparkSession)
    samples = F.transform(F.sort_array(F.collect_list(F.struct("sample", F.col("embedding").cast("array<double>").alias("embedding")))), lambda s: s["embedding"])
    groups = answers.where(F.col("embedding").isNotNull()).groupBy("query_id", "chunk_id").agg(samples.alias("e"))

    def run(batches):
        for b in batches:
            points = b.column(2)
            sizes = points.value_lengths().to_numpy()
            share = np.ones(len(sizes))
            for n in np.unique(sizes[sizes > 1]):
                own = np.flatnonzero(sizes == n)
                for at in range(0, len(own), _GROUPS):
                    part = own[at : at + _GROUPS]
                    x = points.take(pa.array(part)).flatten().flatten().to_numpy().reshape(len(part), n, -1)
                    labels = best_partitions(x, min(3, n)) if n <= MOST_ENUMERATED else np.array([lloyd(g, 3) for g in x])
                    share[part] = np.round(np.stack([(labels == c).sum(axis=1) for c in range(3)]).max(axis=0) / n, 4)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(share)], ["query_id", "chunk_id", "mscp_score"])

    return groups.mapInArrow(run, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, mscp_score double")


def sampled_consistency(results: DataFrame, sample, embed, n: int = 5) -> DataFrame:
    """``query_id, chunk_id, mscp_score`` of results worth the samples (``ra_score`` of at least ``LEAST_RA``).

    ``sample(rows, n) -> (query_id, chunk_id, sample, answer)`` asks a model; ``embed`` is a column function. Chunks whose sampling yields nothing have no row.
    """
    answers = sample(results.where(F.col("ra_score") >= LEAST_RA).select("query_id", "chunk_id", "query", "text"), n)
    return mscp(answers.where(F.col("answer").isNotNull()).select("query_id", "chunk_id", "sample", embed(F.col("answer")).alias("embedding")))
