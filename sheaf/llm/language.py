"""Language identification by rank-order profiles.

A text's letters are lower-cased and everything else is a word break; its n-grams of one to three (breaks only at
their ends) are ranked by frequency. A language's profile is the same ranking over its training texts. The
out-of-place distance adds up how far the text's ``PROFILE`` most frequent n-grams lie from their ranks in a
profile, with the profile's length for a missing one; the language with the least distance wins.

Profiles are fitted on about ``SAMPLE`` texts of each language, chosen by hash; that bound is a parameter. Every label is
learned, however rare; profiles of more than ``PROFILE_BYTES`` in all raise an error, none is dropped. Every text is scored
whole, against all languages at once through one index from n-grams to their places in the profiles. Defined results: a null text or one without a letter is ``und`` with score 0, as is everything when
nothing can be learned; ties go to the language first by name; repeated rows score alike; a null language teaches
nothing; columns whose names clash with the results are not read by ``identify`` and are kept by ``filter_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import L, char_classes
from .common import bounded_batches, documents, is_held_out

PROFILE = 300
SAMPLE = 1500
PROFILE_BYTES = 256 << 20
UND = "und"
BLOCK = 1 << 20
#: Below this likeness to the best profile a text is in none of the learned languages.
LEAST_SCORE = 0.2


def _blocks(text: str) -> Iterator[np.ndarray]:
    """Code points with breaks as 0; each block begins with the two last of the one before."""
    low = text.lower() + " "
    for i in range(0, len(low), BLOCK):
        yield np.frombuffer(low[max(0, i - 2) : i + BLOCK].encode("utf-32-le", "surrogatepass"), "<u4")


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a text's n-grams, codes ascending; empty if it has no letter."""
    codes, counts = [], []
    table = char_classes()
    tail = 0
    pad = np.zeros(1, np.uint64)
    for points in _blocks(text):
        x = np.where(table[points] == L, points, 0).astype(np.uint64)
        if not codes:
            x = np.concatenate((pad, x))
        one, two = x[tail:], x[:-1] << np.uint64(21) | x[1:]
        three = two[:-1] << np.uint64(21) | x[2:]
        three = three[x[1:-1] != 0]
        two = two[max(0, tail - 1) :]
        two = two[(two & np.uint64(0x1FFFFF) != 0) | (two >> np.uint64(21) != 0)]
        # 21 bits a char; a leading break keeps n-grams of different length apart by these marks
        found = np.concatenate((one[one != 0], two | np.uint64(1 << 62), three | np.uint64(1 << 63)))
        found.sort()
        first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(found) else np.zeros(0, np.int64)
        codes.append(found[first])
        counts.append(np.diff(np.append(first, len(found))))
        tail = 2
    if not codes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(codes) == 1:
        return codes[0], counts[0]
    all_codes, where = np.unique(np.concatenate(codes), return_inverse=True)
    return all_codes, np.bincount(where, np.concatenate(counts)).astype(np.int64)


def top(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ``PROFILE`` most frequent codes, ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:PROFILE]]


class Profiles:
    """Profiles as one index: n-grams ascending, and of each the languages that rank it and where."""

    def __init__(self, ranked: dict[str, list[int]]):
        self.names = sorted(ranked)
        codes = [np.array(ranked[n], np.uint64) for n in self.names]
        flat = np.concatenate([np.zeros(0, np.uint64), *codes])
        order = np.argsort(flat, kind="stable")
        self.codes, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat)).astype(np.int64)
        self.language = np.repeat(np.arange(len(codes)), [len(c) for c in codes])[order]
        self.rank = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(c)) for c in codes)])[order]

    def distances(self, mine: np.ndarray) -> np.ndarray:
        """Out-of-place distances of n-grams in order of frequency to every language."""
        at = np.minimum(np.searchsorted(self.codes, mine), len(self.codes) - 1)
        hit = np.flatnonzero(self.codes[at] == mine)
        begin = self.first[at[hit]]
        n = self.first[at[hit] + 1] - begin
        ends = np.cumsum(n)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + n, n)
        saved = PROFILE - np.abs(self.rank[place] - np.repeat(hit, n))
        return PROFILE * len(mine) - np.bincount(self.language[place], saved, len(self.names))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = grams(text or "")
        if not len(codes) or not len(self.codes):
            return UND, 0.0
        mine = top(codes, counts)
        out = self.distances(mine)
        best = int(out.argmin())
        return self.names[best], float(1 - out[best] / (PROFILE * len(mine)))


def fit(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Profiles:
    """Profiles of the languages of ``df``, each from about ``sample`` texts taken by hash."""
    spark = df.sparkSession
    bounded_batches(spark)
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = rows.groupBy(F.col(lang_col).alias("lang")).count().limit(PROFILE_BYTES // (8 * PROFILE) + 1).collect()
    if not counts:
        return Profiles({})
    if len(counts) * 8 * PROFILE > PROFILE_BYTES:
        raise ValueError(f"profiles of more than {PROFILE_BYTES // (8 * PROFILE)} languages")
    scale = 1 << 30
    # One row a language, fewer than PROFILE_BYTES allows.
    limits = F.broadcast(spark.createDataFrame([(r["lang"], min(scale, scale * sample // r["count"])) for r in counts], "lang string, _limit long"))
    chosen = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col, F.lit("profile")), F.lit(scale)).alias("h"))
    chosen = chosen.join(limits, "lang").where(F.col("h") < F.col("_limit")).select("lang", "text")

    def count(batches):
        for b in batches:
            by: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(grams(text))
            for lang, found in by.items():
                codes, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                n = np.bincount(where, np.concatenate([k for _, k in found]), minlength=len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], ["lang", "code", "n"])

    counted = chosen.mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.col("code") < 0, "code"))  # codes are unsigned
    ranked: dict[str, list[int]] = {}
    for r in counted.withColumn("r", place).where(F.col("r") <= PROFILE).orderBy("lang", "r").collect():  # within PROFILE_BYTES
        ranked.setdefault(r["lang"], []).append(r["code"] % (1 << 64))
    return Profiles(ranked)


def identify(df: DataFrame, profiles: Profiles, *, text_col: str = "text") -> DataFrame:
    """``df``'s columns but the text and those of the results' names, with ``lang_pred`` and ``score``."""
    bounded_batches(df.sparkSession)
    rest = [c for c in df.columns if c not in (text_col, "lang_pred", "score")]
    rows = df.select(text_col, *rest)
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in rest) + ", lang_pred string, score double"

    def run(batches):
        for b in batches:
            found = [profiles.predict(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*rest, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def training_rows(df: DataFrame) -> DataFrame:
    return df.where(~is_held_out(F.col("doc_id")))


def filter_documents(df: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Documents in one of the learned languages, with the input's columns; profiles come from the rows that are not held out."""
    profiles = fit(training_rows(df))
    wrapped = df.select(F.struct("*").alias("row"), F.col("text").alias("_text"))
    judged = identify(wrapped, profiles, text_col="_text")
    return judged.where((F.col("lang_pred") != UND) & (F.col("score") >= least)).select("row.*")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir)
    found = identify(df.select("doc_id", "text"), fit(training_rows(df)))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
