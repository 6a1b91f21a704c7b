"""Line dedup by content-defined windows of lines.

A window runs from one line with a word to the next such line, blank lines between them included; every window of a text
is a chunk, so chunks move with the content and not with line numbers, and a repeated passage is found from its first line
to its last, wherever it begins. A line of at least ``LONG_LINE`` words is a chunk of its own (a passage by itself); two
such lines need no window. Chunks are looked up by a 128-bit hash; those found more than once anywhere are fetched and
compared byte by byte, and the lines of all but the first (least document id, then place) go. Of each line that goes an equal line stays.
Where documents come in groups (near copies, of which one will stay), a group counts as one document: each of its documents keeps the
chunks whose first place is in the group.

Defined results: a null text stays null and an empty one empty; a line that repeats without a neighbour stays unless it is
long; rows that repeat id and text count as one document and share its result; a null id comes first; a text whose every
line with a word goes becomes the empty text, rows are never dropped; repeats inside one document go too; columns with clashing
names are carried untouched in a struct. If hashes of unequal chunks ever met, the comparison would leave all of them in place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, bounded_batches, documents, let, materialize
from .hashing import range_hashes

LONG_LINE = 50
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def chunks(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First line, number of lines and two 64-bit hashes of the chunks of a text, by first line and length. Chunks overlap."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.append(np.flatnonzero(raw == 10), len(raw))
    starts = np.concatenate(([0], ends[:-1] + 1))
    space = _SPACE[raw]
    begins = np.cumsum(np.concatenate(([0], ~space & np.concatenate(([True], space[:-1])) if len(raw) else [])))
    words = begins[ends] - begins[starts]
    long = words >= LONG_LINE
    worded = np.flatnonzero(words > 0)
    pair = ~(long[worded[:-1]] & long[worded[1:]])
    alone = np.flatnonzero(long)
    first = np.concatenate((alone, worded[:-1][pair]))
    last = np.concatenate((alone, worded[1:][pair]))
    order = np.lexsort((last, first))
    first, last = first[order], last[order]
    a, b = starts[first], ends[last]
    return first, last - first + 1, range_hashes(raw, a, b), range_hashes(raw, a, b, 1)


def dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", groups: DataFrame | None = None) -> DataFrame:
    """``row`` (the input's row), ``text`` (without repeated chunks), ``n_lines``, ``n_removed`` (lines), ``removed`` (repeated chunks: first line, lines; they may overlap).

    ``groups (id, h, group)``: groups of documents by id and text hash, each document at most once.
    """
    bounded_batches(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = df.select(F.xxhash64(id_col, text).alias("k1"), F.xxhash64(text, F.lit("line"), id_col).alias("k2"), F.xxhash64(text).alias("h"), F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.struct("*").alias("row"))

    def run(batches):
        for b in batches:
            source, parts = [], []
            for i, t in enumerate(b.column(4).to_pylist()):
                if t:
                    found = chunks(t)
                    parts.append(found)
                    source.append(np.full(len(found[0]), i, np.int64))
            if not parts:
                continue
            at = pa.array(np.concatenate(source))
            first, n, h1, h2 = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(j).take(at) for j in range(4)), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))],
                ["k1", "k2", "h", "id", "first", "n", "h1", "h2"])

    kind = dict(df.dtypes)[id_col]
    found = materialize(keyed.select("k1", "k2", "h", "id", "t").mapInArrow(run, f"k1 bigint, k2 bigint, h bigint, id {kind}, first int, n int, h1 bigint, h2 bigint"), "chunks")
    twice = found.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.min("k1").alias("ka"), F.max("k1").alias("kb"), F.min("first").alias("fa"), F.max("first").alias("fb"))
    twice = twice.where((F.col("c") > 1) & ((F.col("ka") != F.col("kb")) | (F.col("fa") != F.col("fb")))).select("h1", "h2")
    places = found.join(twice, ["h1", "h2"]).dropDuplicates(["k1", "k2", "first", "n"])
    own = F.struct("k1", "k2")
    if groups is not None:
        named = groups.select(F.col("id").alias("_id"), F.col("h").alias("_h"), "group")
        places = places.join(named, (F.col("h") == F.col("_h")) & F.col("id").eqNullSafe(F.col("_id")), "left")
        # names of groups and of documents without one are kept apart by the second field
        own = F.when(F.col("group").isNotNull(), F.struct(F.col("group").alias("k1"), F.lit(None).cast("long").alias("k2"))).otherwise(own)
    places = materialize(places.select("k1", "k2", "id", "first", "n", "h1", "h2", own.alias("g")), "places")
    rows = keyed.select("k1", "k2", "row").repartition("k1", "k2")
    lines = F.split(F.coalesce(F.col(f"row.{text_col}"), F.lit("")), "\n", -1)

    wanted = places.groupBy("k1", "k2").agg(F.collect_list(F.struct("id", "first", "n", "h1", "h2", "g")).alias("wanted"))
    fetched = (
        rows.join(wanted, ["k1", "k2"])
        # The condition always holds; as it reads the whole row, the exchange of the texts below is the result's own, not a second one.
        .select("k1", "k2", F.when(F.shiftrightunsigned(F.xxhash64("row"), 1) >= 0, lines).alias("lines"), F.explode("wanted").alias("c"))
        .select("c.h1", "c.h2", F.struct("c.id", "k1", "k2", "c.first", "c.g").alias("place"), F.array_join(F.slice("lines", F.col("c.first") + 1, F.col("c.n")), "\n").alias("bytes"))
    )
    same = fetched.groupBy("h1", "h2").agg(F.min("bytes").alias("a"), F.max("bytes").alias("b"), F.min("place").alias("keeper")).where(F.col("a") == F.col("b")).select("h1", "h2", F.col("keeper.g").alias("keeper"))
    # A document of the keeper's group keeps its own first place, every other place goes. Which is first is seen in the document's own
    # array, so that the join on the chunk is followed by a shuffle and may be split where a chunk is very common.
    place = F.struct("h1", "h2", "first", "n", F.col("g").eqNullSafe(F.col("keeper")).alias("kept"))
    at = places.join(same, ["h1", "h2"]).groupBy("k1", "k2").agg(F.sort_array(F.collect_list(place)).alias("at"))
    same_chunk = lambda x, y: x["h1"].eqNullSafe(y["h1"]) & x["h2"].eqNullSafe(y["h2"])
    left_out = F.filter("at", lambda x, i: ~x["kept"] | same_chunk(x, F.get("at", i - 1)))
    gone = at.select("k1", "k2", F.sort_array(F.transform(left_out, lambda x: F.struct(x["first"].alias("first"), x["n"].alias("n")))).alias("removed")).where(F.size("removed") > 0)
    ranges = F.coalesce(F.col("removed"), F.array().cast("array<struct<first:int,n:int>>"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), covered("removed")), lambda i: F.get("lines", i))
    kept = F.when(F.size("removed") == 0, F.col("lines")).otherwise(let(left, lambda x: F.when(F.exists(x, lambda line: line.rlike(WORD)), x).otherwise(F.array().cast("array<string>"))))
    return (
        rows.join(gone, ["k1", "k2"], "left")
        .select("row", ranges.alias("removed"), lines.alias("lines"))
        .select("row", "removed", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
        .select(
            "row",
            F.when(F.size("removed") == 0, F.col(f"row.{text_col}")).otherwise(F.array_join("kept", "\n")).alias("text"),
            "n_lines",
            (F.col("n_lines") - F.size("kept")).alias("n_removed"),
            "removed",
        )
    )


def covered(ranges: str) -> Column:
    """Numbers of the lines in ``ranges``, ascending."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.sequence(r["first"], r["first"] + r["n"] - 1)))))


def merged(ranges: str) -> Column:
    """Disjoint ranges (first line, lines) of the same lines."""

    def joined(x: Column) -> Column:
        starts = F.array_except(x, F.transform(x, lambda i: i + 1))
        ends = F.array_except(F.transform(x, lambda i: i + 1), x)
        return F.zip_with(starts, ends, lambda a, b: F.array(a, b - a))

    return let(covered(ranges), joined)


def dedup_documents(df: DataFrame, groups: DataFrame | None = None, drop_emptied: bool = False) -> DataFrame:
    """Documents with their texts shortened and ``n_chars`` to match, the input's columns and rows otherwise; ``drop_emptied``: without those of which no word is left."""
    out = dedup(df, groups=groups)
    changed = F.size("removed") > 0
    if drop_emptied:
        out = out.where(~changed | (F.col("text") != ""))
    return out.select(*(
        F.col("text") if c == "text"
        else F.when(changed, F.length("text").cast(t)).otherwise(F.col("row.n_chars")).alias(c) if c == "n_chars"
        else F.col(f"row.`{c}`").alias(c)
        for c, t in df.dtypes
    ))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).select("row.doc_id", "text", "n_lines", "n_removed", merged("removed").alias("removed"))
