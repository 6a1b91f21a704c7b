"""Answers traced back to their chunks, sentence by sentence."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.functions.numbers import rounded
from sheaf.functions.text import answer_sentences
from sheaf.session import ship

LEAST_OVERLAP = 0.1


def split_answers(answers: DataFrame, by: str = "query_id", text: str = "answer") -> DataFrame:
    """``query_id, idx, sentence``."""
    return answers.select(by, F.posexplode(answer_sentences(F.col(text))).alias("idx", "sentence"))


def overlap_match(sentences: DataFrame, chunks: DataFrame, by: str = "query_id") -> DataFrame:
    """The chunk of the same query with the largest share of the sentence's words (as substrings of its text; the first by ``chunk_rank`` on ties).

    ``chunks``: ``query_id, chunk_rank, source_file, text, temporal_score, freshness_label``; a query has only its few retrieved chunks. A query's sentences
    meet a chunk as one row, so each of their words is looked for once in it.
    """
    words = F.regexp_extract_all(F.lower("sentence"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    asked = sentences.select(by, F.struct("idx", "sentence").alias("_a"), words.alias("_w")).groupBy(by).agg(F.collect_list(F.struct("_a", "_w")).alias("_l"))
    asked = asked.select(by, F.col("_l._a").alias("_a"), F.col("_l._w").alias("_w"))
    held = chunks.select(by, "chunk_rank", "source_file", "temporal_score", "freshness_label", F.lower(F.coalesce("text", F.lit(""))).alias("_low"))
    pairs = _contained(asked.join(held, by, "left")).select(by, "chunk_rank", "source_file", "temporal_score", "freshness_label", F.explode(F.arrays_zip("_a", "_n")).alias("_p"))
    n = F.col("_p._n")
    pairs = pairs.select(by, "chunk_rank", "source_file", "temporal_score", "freshness_label", "_p._a.*", F.when(n["words"] > 0, n["hits"] / n["words"]).otherwise(0.0).alias("_s"))
    best = F.row_number().over(Window.partitionBy(by, "idx").orderBy(F.desc("_s"), "chunk_rank"))
    top = pairs.withColumn("_k", best).where("_k = 1")
    hit = F.col("_s") > LEAST_OVERLAP
    temporal = F.coalesce("temporal_score", F.lit(0.0))
    confidence = rounded(F.least(F.lit(1.0), F.col("_s") + 0.3), 3)
    return top.select(
        by, "idx", "sentence",
        F.when(hit, F.coalesce("source_file", F.lit("unknown"))).otherwise("UNKNOWN").alias("matched_source"),
        F.when(hit, confidence).otherwise(0.0).alias("confidence"),
        F.when(hit, rounded(temporal, 4)).otherwise(0.0).alias("temporal_score"),
        F.when(hit, F.coalesce("freshness_label", F.lit("UNKNOWN"))).otherwise("UNKNOWN").alias("freshness_label"),
        F.when(hit, rounded((confidence + temporal) / 2, 4)).otherwise(0.0).alias("combined_score"),
        F.when(hit, "heuristic overlap").otherwise("matching failed").alias("reason"),
    )


def _contained(pairs: DataFrame) -> DataFrame:
    """Rows ``_w, _low`` with ``_n``: of each list of words how many it has and how many of them the text contains. A word is looked for once a row."""
    ship(pairs.sparkSession)
    kept = [c for c in pairs.columns if c not in ("_w", "_low")]
    at, low = pairs.columns.index("_w"), pairs.columns.index("_low")
    kind = "array<struct<words:int,hits:int>>"

    def count(lists: list[list[str]], text: str | None) -> list[dict]:
        text = text or ""
        known = {w: w in text for w in {w for words in lists for w in words}}
        return [{"words": len(words), "hits": sum(known[w] for w in words)} for words in lists]

    def run(batches):
        for b in batches:
            counts = [count(*x) for x in zip(b.column(at).to_pylist(), b.column(low).to_pylist(), strict=True)]
            made = pa.array(counts, pa.list_(pa.struct([("words", pa.int32()), ("hits", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), made], [*kept, "_n"])

    return pairs.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in pairs.select(*kept).dtypes) + f", _n {kind}")


def _totals() -> list[Column]:
    """What ``summary`` tells of a group of matches."""
    unknown = F.col("matched_source").isin("INFERRED", "UNKNOWN")
    return [
        F.count("*").alias("total_sentences"),
        rounded(F.coalesce(F.avg("confidence"), F.lit(0.0)), 3).alias("avg_confidence"),
        rounded(F.coalesce(F.avg("temporal_score"), F.lit(0.0)), 4).alias("avg_temporal_score"),
        rounded(F.coalesce(F.avg("combined_score"), F.lit(0.0)), 4).alias("avg_combined_score"),
        F.count_if(F.col("confidence") > 0.7).alias("high_confidence_count"),
        F.count_if(unknown).alias("inferred_count"),
        F.array_join(F.sort_array(F.collect_set(F.when(~unknown & F.col("matched_source").isNotNull(), F.col("matched_source")))), ",").alias("sources_used"),
    ]


def summary(matches: DataFrame, by: str | None = "query_id") -> DataFrame:
    """Averages, counts and the sources used, of each query or (``by=None``) over all rows (then one row, zeros if there are none)."""
    return (matches.groupBy(by) if by else matches.groupBy()).agg(*_totals())


def report(matches: DataFrame, by: str = "query_id") -> DataFrame:
    """``query_id, report``: a block a sentence (the first 80 characters of it), then the summary."""
    four = lambda c: F.format_string("%.4f", F.col(c))
    two = lambda c: F.format_string("%.2f", F.col(c))
    shown = F.concat(F.substring("sentence", 1, 80), F.when(F.length("sentence") > 80, "...").otherwise(""))
    # The lines of the report.
    block = F.concat_ws(
        "\n", F.concat(F.lit('📝 "'), shown, F.lit('"')), F.concat(F.lit("   └─ Source     : "), F.col("matched_source")), F.concat(F.lit("   └─ Confidence : "), two("confidence")),
        F.concat(F.lit("   └─ Freshness  : "), F.col("freshness_label"), F.lit(" (temporal score: "), four("temporal_score"), F.lit(")")),
        F.concat(F.lit("   └─ Combined   : "), four("combined_score")), F.concat(F.lit("   └─ Reason     : "), F.col("reason")))
    blocks = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", block.alias("b")))), lambda x: x["b"]), "\n\n")
    count = lambda c: F.col(c).cast("string")
    tail = F.concat_ws(
        "\n", F.lit("📊 PROVENANCE SUMMARY"), F.concat(F.lit("   Total sentences analysed : "), count("total_sentences")), F.concat(F.lit("   Avg confidence           : "), two("avg_confidence")),
        F.concat(F.lit("   Avg temporal score       : "), four("avg_temporal_score")), F.concat(F.lit("   Avg combined score       : "), four("avg_combined_score")),
        F.concat(F.lit("   High confidence (>0.7)   : "), count("high_confidence_count"), F.lit(" sentences")), F.concat(F.lit("   Inferred (no source)     : "), count("inferred_count"), F.lit(" sentences")))
    # one grouping for both: a join of two would match everything twice
    told = matches.where(F.col(by).isNotNull()).groupBy(by).agg(blocks.alias("_blocks"), *_totals())
    return told.select(by, F.concat(F.col("_blocks"), F.lit("\n\n"), tail).alias("report"))


def model_match(replies: DataFrame, chunks: DataFrame, by: str = "query_id") -> DataFrame:
    """A model's replies ``(query_id, idx, sentence, reply)`` as matches: JSON with matched_source (INFERRED if missing), confidence (0.3) and reason; freshness of the first chunk of that source.

    A sentence whose reply is no JSON is matched by ``overlap_match``.
    """
    read = F.from_json("reply", "matched_source string, confidence double, reason string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    r = replies.withColumn("_r", read).withColumn("_ok", F.col("reply").isNotNull() & F.col("_r._bad").isNull())
    good = r.where("_ok").withColumn("_s", F.coalesce("_r.matched_source", F.lit("INFERRED")))
    first = chunks.groupBy(by, F.col("source_file").alias("_s")).agg(F.min_by(F.struct("temporal_score", "freshness_label"), "chunk_rank").alias("_c"))
    out = good.join(first, [by, "_s"], "left")
    confidence, temporal = F.coalesce("_r.confidence", F.lit(0.3)), F.coalesce("_c.temporal_score", F.lit(0.0))
    label = F.when(F.col("_c").isNotNull(), F.coalesce("_c.freshness_label", F.lit("UNKNOWN"))).when(F.col("_s") == "INFERRED", "INFERRED").otherwise("UNKNOWN")
    said = out.select(
        by, "idx", "sentence", F.col("_s").alias("matched_source"), confidence.alias("confidence"), rounded(temporal, 4).alias("temporal_score"),
        label.alias("freshness_label"), rounded((confidence + temporal) / 2, 4).alias("combined_score"), F.coalesce("_r.reason", F.lit("")).alias("reason"))
    return said.unionByName(overlap_match(r.where("NOT _ok").select(by, "idx", "sentence"), chunks, by))
