"""Best-fit packing planned on a length histogram.

Documents are tokenised and, where longer than a sequence, cut from the end, so that only a first piece is shorter.
Best fit decreasing then runs over the histogram of piece lengths (at most ``limit`` counts, whatever the input):
bins with equal room are held as ranges, so a step places a whole range of equal pieces. The plan gives
each length intervals of ranks; pieces take their slots by their rank within their length.

Defined results: a null or empty text is one piece that holds the end token; repeated rows are packed each on their
own; ties within a length are dealt in any order; an empty table gives an empty result; other columns are not read.
Ranks come from counted, salted cells: the commonest length (mostly full pieces) is never in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import codec, read_vocabulary
from .common import bounded_batches, documents, materialize

ROWS_A_CELL = 20_000


def best_fit(counts: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int, int]]:
    """Intervals ``(length, first rank, end rank, first sequence, pieces a sequence, offset)`` of best fit decreasing.

    ``rooms`` maps the room left in a bin to ranges of bins. Equal pieces go to the least room that holds one,
    and as many into one bin as fit: after the first, that bin has the least room.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    plan, bins = [], 0

    def give(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in rooms:
                rooms[room] = []
                insort(order, room)
            rooms[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect_left(order, length)
            if i < len(order):
                room = order[i]
                first, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], order[i]
            else:
                room = limit
                first, n = bins, -(-left // (limit // length))
                bins += n
            each = room // length
            full = min(n, left // each)
            if full:
                plan.append((length, rank, rank + full * each, first, each, limit - room))
                give(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:  # fewer than fill one more bin
                plan.append((length, rank, rank + left, first + full, left, limit - room))
                give(room - left * length, first + full, 1)
                give(room, first + full + 1, n - full - 1)
                rank, left = rank + left, 0
            elif full < n:
                give(room, first + full, n - full)
    return plan


def pieces(df: DataFrame, vocabulary: str, *, limit: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, added: bool = True) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` (and ``ids``) of every piece of every text; ``added``: the vocabulary's added tokens are one id each."""
    bounded_batches(df.sparkSession)
    data = read_vocabulary(vocabulary)
    rows = df.select(id_col, text_col)
    schema = f"{id_col} {dict(rows.dtypes)[id_col]}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    end = end_id.to_bytes(4, "little")

    def run(batches):
        c = codec(data, vocabulary, added)
        for b in batches:
            source, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, x in enumerate(c.encode([t or "" for t in b.column(1).to_pylist()])):
                x += end
                n = len(x) // 4
                begin, k = 0, 0
                stop = n % limit or min(n, limit)
                while begin < n:
                    part = x[4 * begin : 4 * stop]
                    source.append(i)
                    piece.append(k)
                    start.append(begin)
                    length.append(stop - begin)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                    begin, stop, k = stop, stop + limit, k + 1
            made = [b.column(0).take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc))]
            if with_ids:
                made.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(made, names=[id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return rows.mapInArrow(run, schema)


def pack(cut: DataFrame, *, limit: int = 1024) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (a frame with ``length``, 1 to ``limit``)."""
    spark = cut.sparkSession
    kept = materialize(cut.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in kept.groupBy("length").count().collect()}  # at most ``limit`` rows
    cells = max(1, -(-sum(counts.values()) // ROWS_A_CELL))
    by_length: dict[int, list] = {}
    for length, *interval in best_fit(counts, limit):
        by_length.setdefault(length, []).append(tuple(interval))
    # At most ``limit`` rows; a length has at most as many intervals as there were ranges of rooms.
    plan = F.broadcast(spark.createDataFrame(list(by_length.items()), "length bigint, _plan array<struct<a:bigint,b:bigint,seq:bigint,k:bigint,off:bigint>>"))
    dealt = kept.withColumn("_cell", F.pmod(F.xxhash64("_row"), F.lit(cells)))
    before = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "_cell").agg(F.count("*").alias("_n")).select("length", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_cell").orderBy("_row"))
    ranked = dealt.withColumn("_k", inside).join(offsets, ["length", "_cell"]).withColumn("_rank", F.col("_before") + F.col("_k") - 1)
    slot = F.get(F.filter("_plan", lambda p: (p["a"] <= F.col("_rank")) & (F.col("_rank") < p["b"])), 0)
    placed = ranked.join(plan, "length").withColumn("_slot", slot)
    nth = F.col("_rank") - F.col("_slot.a")
    return placed.select(
        *cut.columns,
        (F.col("_slot.seq") + F.floor(nth / F.col("_slot.k"))).cast("long").alias("sequence_id"),
        (F.col("_slot.off") + nth % F.col("_slot.k") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(df: DataFrame, vocabulary: str | None = None, limit: int = 1024, added: bool = True) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return pack(pieces(df, vocabulary, limit=limit, added=added), limit=limit)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
