"""A batch of questions from classification to traced answers.

What several of its frames start from (retrieved, scored, shown rows) is written once; inside a ``session.scratch`` scope those tables go when it ends.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.rules import EVALUATION_YEAR, FRESHNESS, STAGES
from sheaf.functions.text import GATE_STOP_WORDS
from sheaf.session import written

from . import feedback, gates, provenance, retrieval, trust
from .providers import REFUSAL, Providers, answer_by_path, context, prepend_weather, renumber
from .weather import enrich


@dataclass(frozen=True)
class Config:
    """``threshold`` may be a column of the queries' frame; ``trust`` puts the trust pipeline between retrieval and freshness."""

    top_k: int = 5
    threshold: float | Column = gates.ENTROPY_THRESHOLD
    year: int = EVALUATION_YEAR
    registry: tuple = FRESHNESS
    stages: dict = field(default_factory=lambda: STAGES)
    provenance_before_filter: bool = True
    trust: bool = False
    providers: Providers = field(default_factory=Providers)


def answer_queries(
    queries: DataFrame, corpus: DataFrame, vectors: DataFrame | None = None, cfg: Config = Config(), weather: DataFrame | None = None, *, index: retrieval.Index | None = None, feedback_log: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Frames ``routed, retrieved, scored, kept, shown, answers, provenance, summary``.

    ``queries (query_id, query, query_vec, response, stage)``: ``response`` is the uncertainty probe's reply, ``stage`` the crop stage or null; without
    ``query_vec`` the embedding provider makes it. ``corpus (chunk_id, text, source_file, trust_weight)`` with ``authority_score`` and ``bias_penalty``
    where trust is to know them; ``vectors (chunk_id, embedding)``, from the provider if not given; ``index``: the stored index of the corpus; ``feedback_log
    (seq, path, was_accurate)`` moves the routing threshold; ``weather (query_id, report, seasonal)``: reports by ``weather.weather_report`` and seasonal
    blocks, for the questions it applies to. Nothing is collected.
    """
    p, k = cfg.providers, cfg.top_k
    if "query_vec" not in queries.columns:
        queries = queries.withColumn("query_vec", p.embed(F.col("query")))
    if vectors is None:
        vectors = corpus.select("chunk_id", p.embed(F.col("text")).alias("embedding"))
    threshold = cfg.threshold if feedback_log is None else feedback.current_threshold(feedback_log).scalar()
    # a column of nulls alone has no type of its own, and none that is written
    queries = queries.select(*(F.col(c).cast("string").alias(c) if kind == "void" else c for c, kind in queries.dtypes))
    routed = queries.select("*", p.classify(F.col("query")).alias("_c"), p.entropy(F.col("response")).alias("entropy")).select(*queries.columns, "_c.*", "entropy")
    # written once: the threshold, which is a pass over the log, is not found again by each step, and the planner knows how few the questions are
    routed = written(gates.route(routed, threshold), "routed")
    question = routed.select("query_id", "query", "query_type", "path", "stage")
    dense = retrieval.dense_topk(vectors, routed.select("query_id", "query_vec"), 2 * k)
    sparse = retrieval.sparse_topk(index or corpus.select("chunk_id", "text"), routed.select("query_id", "query"), 2 * k, GATE_STOP_WORDS)
    fused = retrieval.hybrid(dense, sparse, corpus.select("chunk_id", "trust_weight"), k, nonpositive_trust_as_one=False).withColumnRenamed("rank", "retrieval_rank")
    # written before texts are joined: against a table that is known to be small the corpus stays where it is
    fused = written(fused, "fused")
    extra = [c for c in ("authority_score", "bias_penalty") if c in corpus.columns]
    # written once: trust, freshness, context and provenance all start from these few rows a question
    found = written(fused.join(corpus.select("chunk_id", "text", "source_file", *extra), "chunk_id").join(question, "query_id"), "found")
    scored = found
    if cfg.trust:
        rows = found.select("*", *(F.lit(None).cast("double").alias(c) for c in ("authority_score", "bias_penalty") if c not in extra))
        slow = rows.where("path = 'slow'")
        sampled = p.consistency(trust.rerank_by_authority(slow))
        scored = trust.trust_pipeline(rows.where("path = 'fast'")).unionByName(trust.trust_pipeline(slow, sampled))
    retrieved = trust.temporal_decay(scored.where("included") if cfg.trust else scored, "source_file", F.col("query_type"), registry=cfg.registry, year=cfg.year)
    retrieved = written(retrieved, "retrieved")
    fresh = trust.filter_stale(retrieved)
    gated = gates.stage_gate(fresh.withColumn("stage", F.when(gates.phenology_applies(F.col("query_type")), F.col("stage"))), stages=cfg.stages)
    kept = renumber(gates.apply_gate(gated), ["temporal_rank"])
    shown = kept.select("query_id", F.col("chunk_id").cast("string").alias("chunk_id"), "text", "source_file", "final_score", "chunk_rank")
    if weather is not None:
        shown = prepend_weather(kept, weather_chunks(kept, weather, question))
    shown = shown.join(question.select("query_id", "query", "query_type", "path"), "query_id")
    # the weather's chunk takes one of the places
    shown = written(renumber(shown, ["chunk_rank"]), "shown")
    contexts = context(shown.where("path = 'fast'"), 3, False).unionByName(context(shown.where("path = 'slow'"), 5, True))
    answers = answer_by_path(shown, p.answer).join(contexts, "query_id")
    basis = retrieved if cfg.provenance_before_filter else kept
    asked = answers.where(~F.contains("answer", F.lit(REFUSAL)))
    traced = provenance.overlap_match(provenance.split_answers(asked), basis.select("query_id", F.col("temporal_rank").alias("chunk_rank"), "source_file", "text", "temporal_score", "freshness_label"))
    return {"routed": routed, "retrieved": retrieved, "scored": scored, "kept": kept, "shown": shown, "answers": answers, "provenance": traced, "summary": provenance.summary(traced)}


def weather_chunks(kept: DataFrame, weather: DataFrame, question: DataFrame) -> DataFrame:
    """``query_id, text``: the enriched context of weather questions with a report: weather, the best five chunks, the seasonal block, the chunks again."""
    base = kept.where("chunk_rank <= 5").groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_rank", "text"))), lambda x: x["text"]), "\n\n").alias("base"))
    rows = question.where(gates.weather_applies(F.col("query_type"), F.col("query"))).join(weather.where(F.col("report").isNotNull()), "query_id").join(base, "query_id", "left").withColumn("base", F.coalesce("base", F.lit("")))
    enriched = enrich(F.col("query"), F.col("base"), F.col("report"))
    return rows.select("query_id", F.concat_ws("\n\n", enriched, F.col("seasonal"), F.col("base")).alias("text"))
