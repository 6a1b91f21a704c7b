"""Sentences to chunks: hard boundaries, next-sentence scores, the size fold, ids and metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sheaf.functions.numbers import rounded
from sheaf.functions.text import crop_tags, is_hard_boundary, sentences

from .numbering import numbered
from .pairs import scored, scorer_of

MAX_CHUNK, MIN_CHUNK, NSP_THRESHOLD = 500, 50, 0.85
DEFAULTS = {"source_org": "", "region": "India", "domain": "agriculture", "year": 2023, "authority_score": 0.8, "bias_penalty": 0.0}


def full_text(pages: DataFrame) -> DataFrame:
    """``filename, text`` of ``(filename, page_number, text, tables_text)``: page texts and their tables, a line feed after each, in page order."""
    block = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.array_join(F.transform(F.coalesce("tables_text", F.array().cast("array<string>")), lambda t: F.concat(t, F.lit("\n"))), ""))
    ordered = F.sort_array(F.collect_list(F.struct("page_number", block.alias("block"))))
    return pages.groupBy("filename").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "").alias("text"))


def sentence_rows(docs: DataFrame, id_col: str, text_col: str = "text", split: Callable[[Column], Column] = sentences) -> DataFrame:
    """``id, idx, sentence``; the splitter is a column function (a provider may put a pandas UDF there)."""
    return docs.select(id_col, F.posexplode(split(F.col(text_col))).alias("idx", "sentence"))


def always_next(previous: Column, sentence: Column) -> Column:
    """Default next-sentence provider: every sentence follows (what a failing model yields)."""
    return F.lit(1.0)


def lexical_next(previous: Column, sentence: Column) -> Column:
    """A deterministic stand-in for a next-sentence model: 1 if both are of ordinary length, else 0."""
    return F.when((F.length(previous) >= 20) & (F.length(sentence) >= 20), 1.0).otherwise(0.0)


def chunks(docs: DataFrame, id_col: str, text_col: str = "text", *, split=sentences, next_score=always_next) -> DataFrame:
    """``id, chunk_no, text``: sentences in order, split at hard boundaries, low next-sentence scores and above ``MAX_CHUNK`` chars.

    Hard and low-score splits do not depend on the fold, so they are marked beside each sentence; the fold itself
    keeps (length, where chunks start) and runs inside the row, without a shuffle; chunks are slices of the sentences. Chunks below ``MIN_CHUNK`` go.
    ``next_score``: a column function of (sentence before, sentence) made of built-in functions, or a model: a ``PairScorer``, a pandas or an Arrow UDF.
    """
    # a text without sentences gives no chunk below; a filter on their number would split every text twice
    held = docs.select(id_col, split(F.col(text_col)).alias("s"))
    scorer = scorer_of(next_score)
    if scorer is None:
        low = lambda x, i: next_score(F.get("s", i - 1), x) < NSP_THRESHOLD
    else:
        held = scored(held, scorer)
        low = lambda x, i: F.get("next_scores", i) < NSP_THRESHOLD
    static = F.transform("s", lambda x, i: F.struct(F.length(x).alias("n"), (is_hard_boundary(x) | ((i > 0) & low(x, i))).alias("cut")))

    def step(acc: Column, x: Column) -> Column:
        fresh = (acc["i"] == 0) | x["cut"] | (acc["len"] + x["n"] > MAX_CHUNK)
        return F.struct((acc["i"] + 1).alias("i"), F.when(fresh, x["n"]).otherwise(acc["len"] + x["n"]).alias("len"), F.when(fresh, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"))

    first = F.struct(F.lit(0).alias("i"), F.lit(0).alias("len"), F.array().cast("array<int>").alias("starts"))
    cut = held.select(id_col, "s", static.alias("m")).select(id_col, "s", F.aggregate("m", first, step)["starts"].alias("at"))
    texts = F.transform("at", lambda a, k: F.trim(F.array_join(F.slice("s", a + 1, F.coalesce(F.get("at", k + 1), F.size("s")) - a), " ")))
    return cut.select(id_col, F.posexplode(F.filter(texts, lambda t: F.length(t) >= MIN_CHUNK)).alias("chunk_no", "text"))


def with_metadata(chunked: DataFrame, metadata: DataFrame, source: str = "source_file") -> DataFrame:
    """Chunks with their source's metadata (defaults where unknown), trust weight, length and crop tags. Metadata joins on the source; Spark broadcasts it while it is small."""
    out = chunked.join(metadata, source, "left")
    for name, value in DEFAULTS.items():
        out = out.withColumn(name, F.coalesce(name, F.lit(value)))
    return (
        out.withColumn("title", F.coalesce("title", source))
        .withColumn("trust_weight", rounded(F.col("authority_score") * (1 - F.col("bias_penalty")), 4))
        .withColumn("char_count", F.length("text"))
        .withColumn("crop_tags", crop_tags(F.col("text")))
    )


def with_ids(chunked: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """``chunk_id`` as ``chunk_000123``, contiguous from ``start`` in the given order; no single task sees all rows, and chunks are shuffled and written once."""
    number = F.col("_k") + start
    shown = F.when(number < 1_000_000, F.lpad(number.cast("string"), 6, "0")).otherwise(number.cast("string"))
    return numbered(chunked, order).withColumn("chunk_id", F.concat(F.lit("chunk_"), shown)).drop("_k")


def table_to_text(rows: Column) -> Column:
    """``array<array<string>>`` with a header row as ``Head: cell | Head: cell`` lines; fewer than two rows give the empty text."""
    clean = lambda x: F.coalesce(F.regexp_replace(x, r"^\s+|\s+$", ""), F.lit(""))

    def line(heads: Column, row: Column) -> Column:
        width = F.least(F.size(heads), F.size(row))
        parts = F.zip_with(F.slice(heads, F.lit(1), width), F.slice(row, F.lit(1), width), lambda h, c: F.when((clean(h) != "") & (clean(c) != ""), F.concat(clean(h), F.lit(": "), clean(c))))
        return F.array_join(F.filter(parts, lambda p: p.isNotNull()), " | ")

    lines = F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: line(F.get(rows, 0), r))
    return F.when(F.coalesce(F.size(rows), F.lit(0)) < 2, "").otherwise(F.array_join(F.filter(lines, lambda x: x != ""), "\n"))
