"""Minimax contiguous partition into shards (native: DataFrame expressions only).

Atomic groups (equal texts, known by a 64-bit hash; a collision only keeps two texts together) stand in the
order of their hash. The smallest feasible shard capacity is found by binary search, each candidate checked
greedily, and the order is cut there. The search sees at most ``2 * blocks`` ordered sizes whatever the
input: a group above ``total / blocks`` bytes stands for itself (there are fewer than ``blocks`` of them), the
rest of a hash block stands together. A group above the even share of what is left would leave shards empty
under one capacity; such groups (fewer than the shards) come first, each in a shard of its own.

Defined results: a null text has no bytes and groups with the empty text; repeated rows are kept, in one shard
with gapless slots; null ids are ordinary rows; an empty table gives an empty result; other columns of
the input are not read. Slots are dealt by salted cells with counted offsets, so a shard or a group
that holds a third of all rows is never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, let, materialize, text_of

BLOCK_BITS = 14
ROWS_A_CELL = 20_000


def minimax(sizes: Column, shards: int) -> Column:
    """Of an array of sizes: ``struct(capacity, starts)``, the least capacity and the first index of each shard."""

    def feasible(xs: Column, cap: Column) -> Column:
        fold = F.aggregate(
            xs,
            F.struct(F.lit(1).alias("n"), F.lit(0).cast("long").alias("cur")),
            lambda a, x: F.when(a["cur"] + x > cap, F.struct((a["n"] + 1).alias("n"), x.alias("cur"))).otherwise(
                F.struct(a["n"].alias("n"), (a["cur"] + x).alias("cur"))),
        )
        return fold["n"] <= shards

    def halve(xs: Column):
        def step(b: Column, _: Column) -> Column:
            mid = F.floor((b["lo"] + b["hi"]) / 2).cast("long")
            return F.when(b["lo"] >= b["hi"], b).otherwise(let(mid, lambda m: F.when(
                feasible(xs, m), F.struct(b["lo"].alias("lo"), m.alias("hi"))).otherwise(F.struct((m + 1).alias("lo"), b["hi"].alias("hi")))))
        return step

    def cut(xs: Column, cap: Column) -> Column:
        first = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("cur"), F.array(F.lit(0)).alias("starts"))
        return F.aggregate(xs, first, lambda a, x: F.when(
            a["cur"] + x > cap,
            F.struct((a["i"] + 1).alias("i"), x.alias("cur"), F.concat(a["starts"], F.array(a["i"])).alias("starts")),
        ).otherwise(F.struct((a["i"] + 1).alias("i"), (a["cur"] + x).alias("cur"), a["starts"].alias("starts"))))["starts"]

    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    most = F.array_max(sizes)
    lo = F.greatest(F.ceil(total / shards).cast("long"), most)
    bounds = F.struct(lo.alias("lo"), (lo + most).alias("hi"))
    return let(
        F.aggregate(F.sequence(F.lit(1), F.lit(64)), bounds, halve(sizes))["hi"],
        lambda cap: F.struct(cap.alias("capacity"), cut(sizes, cap).alias("starts")),
    )


def shard_by_bytes(df: DataFrame, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, size, text_crc32, shard, slot`` of every row, and ``group_hash``."""
    t = F.col("t")
    slim = materialize(
        df.select(F.col(id_col), text_of(text_col).alias("t")).select(
            id_col,
            (F.octet_length(t) + 8).cast("long").alias("size"),
            F.crc32(t.cast("binary")).alias("text_crc32"),
            F.xxhash64(t).alias("group_hash"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "shard-rows",
    )
    place = F.shiftrightunsigned("group_hash", 1)
    groups = slim.groupBy("group_hash").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    total, rows = slim.agg(F.sum("size"), F.count("*")).first()
    if not rows:
        return slim.select(id_col, "size", "text_crc32", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot"), "group_hash")
    large = groups.where(F.col("bytes") > total / (1 << BLOCK_BITS))
    alone, left = [], total
    for g in large.orderBy(F.desc("bytes"), "group_hash").limit(shards).collect():
        if len(alone) >= shards - 1 or g["bytes"] * (shards - len(alone)) <= left:
            break
        alone.append(g["group_hash"])
        left -= g["bytes"]
    rest = groups.where(~F.col("group_hash").isin(alone)) if alone else groups
    base = F.shiftleft(F.shiftright(place, 63 - BLOCK_BITS), 63 - BLOCK_BITS)
    order = F.when(F.col("bytes") > total / (1 << BLOCK_BITS), place).otherwise(base)
    atoms = rest.groupBy(order.alias("ord")).agg(F.sum("bytes").alias("bytes"))
    row = atoms.agg(F.sort_array(F.collect_list(F.struct("ord", "bytes"))).alias("atoms"))
    row = row.select("atoms", F.transform("atoms", lambda a: a["bytes"]).alias("sizes"))
    found = row.select("atoms", minimax(F.col("sizes"), shards - len(alone)).alias("m"))
    found = found.select(F.transform("m.starts", lambda i: F.get("atoms", i)["ord"]).alias("starts"))
    starts = (found.first() or [None])[0] or []

    # Fewer than 2^BLOCK_BITS rows of two longs: each holds over that share of all bytes.
    marks = F.broadcast(large.select("group_hash", F.lit(True).alias("_large")))
    at = F.when(F.col("_large"), place).otherwise(base)
    # The few cuts are looked up in arrays: written out as conditions they make a method that takes the compiler over a GB.
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs)).cast("array<bigint>")
    own = F.array_position(longs(alone), F.col("group_hash")).cast("int")
    shard = F.when(own > 0, own - 1).otherwise(let(at, lambda a: F.size(F.filter(longs(starts), lambda s: s <= a))) + (len(alone) - 1))
    cells = max(1, -(-rows // ROWS_A_CELL))
    dealt = slim.join(marks, "group_hash", "left").select(
        id_col, "size", "text_crc32", "group_hash", "_row", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("_row"), F.lit(cells)).alias("_cell"))
    counts = dealt.groupBy("shard", "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy("_row"))
    return (
        dealt.withColumn("_k", inside)
        .join(offsets, ["shard", "_cell"])
        .select(id_col, "size", "text_crc32", "shard", (F.col("_before") + F.col("_k") - 1).cast("long").alias("slot"), "group_hash")
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(documents(spark, sf_dir), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
