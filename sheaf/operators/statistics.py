"""Reports over stores: counts, distinct values, lengths. One partial aggregation each, nothing is sorted but what is asked for in an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import STOP_WORDS, tokens


def value_counts(df: DataFrame, by: str) -> DataFrame:
    """``by, n`` of each value, null included."""
    return df.groupBy(by).agg(F.count("*").alias("n"))


def ends(df: DataFrame, value: str, order: str, name: str | None = None) -> DataFrame:
    """One row: distinct values, rows, and the first and last value by ``order`` (``names, n, first_name, last_name``)."""
    name = name or value
    return df.agg(F.count_distinct(value).alias(f"{name}s"), F.count("*").alias("n"), F.min_by(value, order).alias(f"first_{name}"), F.max_by(value, order).alias(f"last_{name}"))


def distinct_values(df: DataFrame, **columns: str) -> DataFrame:
    """One row: distinct values of each column, nulls apart (``name=column``)."""
    return df.agg(*(F.count_distinct(c).alias(n) for n, c in columns.items()))


def spread_of(df: DataFrame, value: str, name: str, places: int = 4) -> DataFrame:
    """One row ``mean_name, max_name, min_name``."""
    return df.agg(F.round(F.avg(value), places).alias(f"mean_{name}"), F.max(value).alias(f"max_{name}"), F.min(value).alias(f"min_{name}"))


def document_stats(pages: DataFrame, by: str, text: str = "text", cells: Column | None = None) -> DataFrame:
    """``by, pages, chars, chars_a_page, cells`` of each document: ``cells`` counts a page's table cells, bars in its text if not given."""
    bars = F.size(F.split(text, r"\|", -1)) - 1 if cells is None else cells
    length = F.length(text)
    return pages.groupBy(by).agg(F.count("*").alias("pages"), F.sum(length).alias("chars"), F.round(F.avg(length), 2).alias("chars_a_page"), F.sum(bars).alias("cells"))


def average_tokens(chunks: DataFrame, text: str = "text", stop_words=STOP_WORDS, places: int = 4) -> DataFrame:
    """One row ``n_docs, avg_tokens``."""
    return chunks.agg(F.count("*").alias("n_docs"), F.round(F.avg(F.size(tokens(F.col(text), stop_words))), places).alias("avg_tokens"))


def counts_of(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """One row with the number of rows of each value, 0 for one that does not occur."""
    return df.agg(*(F.count_if(F.col(column) == v).alias(v) for v in values))
