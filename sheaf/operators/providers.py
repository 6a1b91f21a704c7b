"""Model and service stand-ins. Each provider is a column function or a frame function; these defaults need no model and no network.

Results of the defaults are substitutes: deterministic, not a model's.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.functions.text import answer_sentences, tokens

from . import chunking, gates

DIM = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``value`` made once, whatever ``body`` does with it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hashed_embedding(text: Column, dim: int = DIM) -> Column:
    """A unit vector of signed hashed tokens (built-in functions only).

    A token is hashed once, to twice its bucket plus its sign; sorted, those are counted by runs, and the runs (two a bucket at most) are summed up.
    """
    codes = F.sort_array(F.transform(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int") * 2 + (F.xxhash64(t, F.lit(1)) > 0).cast("int")))

    def counted(s: Column) -> Column:
        first = F.filter(F.transform(s, lambda x, i: F.when(~x.eqNullSafe(F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        return _let(first, lambda at: F.transform(at, lambda a, k: F.struct(F.get(s, a).alias("c"), (F.coalesce(F.get(at, k + 1), F.size(s)) - a).alias("n"))))

    def summed(runs: Column) -> Column:
        value = lambda j: F.aggregate(F.filter(runs, lambda r: F.shiftright(r["c"], 1) == j), F.lit(0.0), lambda v, r: v + r["n"] * (2 * (r["c"] % 2) - 1))
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value)

    def scaled(v: Column) -> Column:
        return _let(F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y)), F.lit(1e-9)), lambda n: F.transform(v, lambda x: (x / n).cast("float")))

    return _let(_let(_let(codes, counted), summed), scaled)


def extractive_answer(chunks: DataFrame, most: int = 3, by: str = "query_id") -> DataFrame:
    """``query_id, answer``: the first two sentences of the best ``most`` chunks."""
    top = chunks.where(F.col("chunk_rank") <= most)
    s = F.slice(F.filter(answer_sentences(F.col("text")), lambda x: F.length(x) > 0), 1, 2)
    return top.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_rank", F.array_join(s, " ").alias("t")))), lambda x: x["t"]), " ").alias("answer"))


def pattern_triplets(chunks: DataFrame) -> DataFrame:
    """Facts of the form "X is Y" in the first 1500 chars of a chunk (the provider's input window), confidence 0.8."""
    found = F.regexp_extract_all(F.substring("text", 1, 1500), F.lit(r"([\p{L}\p{N}_]+) is ([\p{L}\p{N}_]+)"), F.lit(0))
    rows = chunks.select("chunk_id", "source_file", F.substring("text", 1, 200).alias("chunk_text"), F.explode(found).alias("m"))
    part = F.split("m", " is ")
    return rows.select(F.get(part, 0).alias("subject"), F.lit("is").alias("relationship"), F.get(part, 1).alias("object"), F.lit(0.8).alias("confidence"), "source_file", "chunk_text", "chunk_id")


def no_samples(chunks: DataFrame) -> None:
    """No sampled answers: consistency is not scored."""
    return None


@dataclass(frozen=True)
class Providers:
    embed: Callable[[Column], Column] = hashed_embedding
    next_sentence: Callable[[Column, Column], Column] = chunking.always_next
    classify: Callable[[Column], Column] = gates.classify
    entropy: Callable[[Column], Column] = gates.entropy_proxy
    answer: Callable[[DataFrame, int], DataFrame] = extractive_answer
    triplets: Callable[[DataFrame], DataFrame] = pattern_triplets
    consistency: Callable[[DataFrame], DataFrame | None] = no_samples


def context(chunks: DataFrame, most: int, with_sources: bool, by: str = "query_id") -> DataFrame:
    """``query_id, context, sources``: the best chunks' texts joined, and their distinct sources in order."""
    top = chunks.where(F.col("chunk_rank") <= most)
    piece = F.concat(F.lit("[Source: "), F.col("source_file"), F.lit("]\n"), F.col("text")) if with_sources else F.col("text")
    ordered = F.sort_array(F.collect_list(F.struct("chunk_rank", piece.alias("t"), F.col("source_file").alias("s"))))
    grouped = top.groupBy(by).agg(ordered.alias("c"))
    return grouped.select(by, F.array_join(F.transform("c", lambda x: x["t"]), "\n\n---\n\n" if with_sources else "\n\n").alias("context"), F.array_join(F.array_distinct(F.transform("c", lambda x: x["s"])), ", ").alias("sources"))


# How long an answer may be, in tokens, on each path; what an answer says that has found nothing.
FAST_TOKENS, SLOW_TOKENS = 250, 700
REFUSAL = "knowledge base doesn't have"


def prompts(chunks: DataFrame, most: int, by: str = "query_id") -> DataFrame:
    """``query_id, prompt, max_tokens``: what a model is asked for each question of ``chunks`` (with their question's ``query``, ``query_type`` and ``path``).

    The best chunks are numbered passages with their sources; the question stands last, with its kind, so that a model that is cut off at the
    front still has it.
    """
    top = chunks.where(F.col("chunk_rank") <= most)
    passage = F.concat(F.lit("("), F.col("chunk_rank").cast("string"), F.lit(") "), F.coalesce("source_file", F.lit("unknown")), F.lit(": "), F.coalesce("text", F.lit("")))
    passages = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_rank", passage.alias("p")))), lambda x: x["p"]), "\n")
    limit = F.when(F.col("path") == "fast", FAST_TOKENS).otherwise(SLOW_TOKENS)
    text = F.concat(F.lit("PASSAGES\n"), F.col("passages"), F.lit("\nKIND "), F.coalesce("query_type", F.lit("OTHER")), F.lit("\nLIMIT "), limit.cast("string"), F.lit(" tokens\nQUESTION "), F.col("query"))
    return top.groupBy(by, "query", "query_type", "path").agg(passages.alias("passages")).select(by, text.alias("prompt"), limit.alias("max_tokens"))


def model_answer(ask: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], DataFrame]:
    """An answering provider of a model: ``ask (query_id, prompt, max_tokens) -> (query_id, answer)``, by way of ``sources.ledger`` where calls are paid for."""
    return lambda chunks, most: ask(prompts(chunks, most))


def answer_by_path(chunks: DataFrame, answer: Callable[[DataFrame, int], DataFrame], fallback: Callable[[DataFrame, int], DataFrame] | None = None, by: str = "query_id") -> DataFrame:
    """``query_id, answer, answered_by`` of chunks with their question's ``path``: three chunks on the fast path, five on the slow one; where the slow path has no answer, the fast way stands in.

    A provider that fails on a question leaves it out or answers null.
    """
    fast, slow = chunks.where("path = 'fast'"), chunks.where("path = 'slow'")
    quick = fallback or answer
    deep = answer(slow, 5).where(F.col("answer").isNotNull())
    missing = slow.join(deep.select(by), by, "left_anti")
    said = lambda df, how: df.select(by, "answer", F.lit(how).alias("answered_by"))
    return said(quick(fast, 3), "fast").unionByName(said(deep, "slow")).unionByName(said(quick(missing, 3), "fast_fallback"))


def prepend_weather(chunks: DataFrame, weather: DataFrame) -> DataFrame:
    """Weather text ``(query_id, text)`` as a chunk of rank 0 and score 1 in front of the query's chunks."""
    # Fixed value: the name of the source.
    extra = weather.select("query_id", F.lit("weather").alias("chunk_id"), "text", F.lit("REAL-TIME WEATHER DATA").alias("source_file"), F.lit(1.0).alias("final_score"), F.lit(0).alias("chunk_rank"))
    return chunks.select("query_id", F.col("chunk_id").cast("string").alias("chunk_id"), "text", "source_file", "final_score", "chunk_rank").unionByName(extra)


def renumber(chunks: DataFrame, order: list, by: str = "query_id") -> DataFrame:
    return chunks.withColumn("chunk_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
