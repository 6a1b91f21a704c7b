"""Feedback on routing and the threshold that adapts to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .numbering import range_of_place, ranged

INITIAL, LOWEST, HIGHEST, RATE, LEAST_FEEDBACKS = 1.5, 0.8, 2.5, 0.05, 3


def accuracy(log: DataFrame, by: str = "path") -> DataFrame:
    return log.groupBy(by).agg(F.count("*").alias("n"), F.count_if("was_accurate").alias("n_accurate"), F.round(F.avg(F.col("was_accurate").cast("double")), 3).alias("accuracy"))


_COUNTS = ("n", "fast_n", "fast_ok", "slow_n", "slow_ok")


def _counted(log: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """``log`` in sorted ranges with ``_key``, ``_r`` (the range), ``_place`` and the counts up to each feedback.

    Counts of a key's ranges are summed up first (a row for each key and range), so a range counts on alone from what came before it: a log without keys, or a key with most of the
    feedback, is as many tasks as it has ranges.
    """
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    held = ranged(log.withColumn("_key", key), ["_key", order]).withColumn("_r", range_of_place())
    fast, slow = F.col("path") == "fast", F.col("path") == "slow"
    ok = F.coalesce("was_accurate", F.lit(False))
    one = dict(zip(_COUNTS, (F.lit(1), *(F.coalesce(x, F.lit(False)).cast("int") for x in (fast, fast & ok, slow, slow & ok))), strict=True))
    held = held.select("*", *(x.alias(f"_{n}") for n, x in one.items()))
    totals = held.groupBy("_key", "_r").agg(*(F.sum(f"_{n}").alias(n) for n in _COUNTS))
    earlier = Window.partitionBy("_key").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("_key").alias("_k"), F.col("_r").alias("_at"), *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in _COUNTS))
    inside = Window.partitionBy("_key", "_r").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    joined = held.join(before, (F.col("_key") == F.col("_k")) & (F.col("_r") == F.col("_at")))
    return joined.select(*log.columns, "_key", "_r", "_place", *((F.col(f"_before_{n}") + F.sum(f"_{n}").over(inside)).alias(f"_{n}") for n in _COUNTS))


def _stepped(log: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    share = lambda p: F.coalesce(F.col(f"_{p}_ok") / F.nullif(F.col(f"_{p}_n"), F.lit(0)), F.lit(0.0))
    out = _counted(log, keys, order).withColumn("n", F.col("_n")).withColumn("fast_acc", share("fast")).withColumn("slow_acc", share("slow")).drop(*(f"_{n}" for n in _COUNTS))
    low, high = F.col("fast_acc") < 0.6, (F.col("fast_acc") > 0.85) & (F.col("slow_acc") > 0.85)
    step = F.when(F.col("n") < LEAST_FEEDBACKS, 0.0).when(low, -RATE).when(high, RATE / 2).otherwise(0.0)
    why = F.when(F.col("n") < LEAST_FEEDBACKS, "too_few").when(low, "fast_low_accuracy").when(high, "both_high_accuracy").otherwise("no_change")
    return out.withColumn("delta", step).withColumn("reason", why)


def deltas(log: DataFrame, keys: tuple[str, ...] = (), order: str = "seq") -> DataFrame:
    """Each feedback with the accuracies so far and the step it asks for. A path without feedback counts as accuracy 0.

    ``keys`` (tenant, user, ...) make independent thresholds; without them the log is one ordered sequence, of many tasks all the same.
    """
    return _stepped(log, keys, order).drop("_key", "_r", "_place")


#: Steps folded together; a range's steps are cut into blocks of this many.
BLOCK = 512


def _milli(x: float) -> int:
    return round(1000 * x)


def _held(x: Column, a: Column, b: Column) -> Column:
    return F.greatest(a, F.least(b, x))


def _triple(d: Column, a: Column, b: Column) -> Column:
    return F.struct(d.alias("d"), a.alias("a"), b.alias("b"))


def _after(t: Column, x: Column) -> Column:
    """The threshold ``t`` after a run of steps."""
    return _held(t + x["d"], x["a"], x["b"])


def _run(parts: str, one: Callable[[Column], Column]) -> Column:
    """The runs ``one(part)`` of an array as one run; of no array one that changes nothing."""
    same = _triple(F.lit(0), F.lit(-(1 << 30)), F.lit(1 << 30))
    then = lambda s, x: _triple(s["d"] + x["d"], _held(s["a"] + x["d"], x["a"], x["b"]), _held(s["b"] + x["d"], x["a"], x["b"]))
    return F.coalesce(F.aggregate(parts, same, lambda s, x: then(s, one(x))), same)


_LOW, _HIGH = _milli(LOWEST), _milli(HIGHEST)


def _folded(stepped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks ``_key, _r, _b`` with their steps ``m`` and the run ``w`` that they are, and ranges ``_key, _r`` with those of their blocks, ``bs``."""
    here = Window.partitionBy("_key", "_r").orderBy("_place")
    moves = stepped.where("delta != 0").select("_key", "_r", "_place", F.round(F.col("delta") * 1000).cast("int").alias("_d"))
    moves = moves.withColumn("_b", F.floor((F.row_number().over(here) - 1) / BLOCK))
    blocks = moves.groupBy("_key", "_r", "_b").agg(F.array_sort(F.collect_list(F.struct("_place", "_d"))).alias("m"))
    blocks = blocks.withColumn("w", _run("m", lambda x: _triple(x["_d"], F.lit(_LOW), F.lit(_HIGH))))
    return blocks, blocks.groupBy("_key", "_r").agg(F.array_sort(F.collect_list(F.struct("_b", "w"))).alias("bs"))


def _by_key(ranges: DataFrame) -> DataFrame:
    """A row a key: its ranges, in order, as runs."""
    return ranges.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_r", _run("bs", lambda x: x["w"]).alias("w")))).alias("rs"))


def thresholds(log: DataFrame, keys: tuple[str, ...] = (), order: str = "seq") -> DataFrame:
    """``keys, seq, threshold`` after each feedback.

    The steps depend on the log only. What a run of steps does to a threshold is again one step between two bounds, so steps are folded to such triples up a tree: rows of a block, blocks of a
    range, ranges of a key. Down the tree each range gets the threshold that it begins with, each block its own, and a block unrolls its
    steps alone. All in thousandths: whole numbers, rounded as the threshold is.
    """
    stepped = _stepped(log, keys, order)
    here = Window.partitionBy("_key", "_r").orderBy("_place")

    def starts(parts: str, name: str, first: Column) -> Column:
        """``array<struct(name, t)>``: the threshold that each part of an array ``(name, w)`` begins with."""
        state = F.struct(first.alias("t"), F.array().cast(f"array<struct<{name}:bigint,t:int>>").alias("all"))
        step = lambda s, x: F.struct(_after(s["t"], x["w"]).alias("t"), F.concat(s["all"], F.array(F.struct(x[name].cast("bigint").alias(name), s["t"].alias("t")))).alias("all"))
        return F.aggregate(parts, state, step)["all"]

    blocks, ranges = _folded(stepped)
    by_key = _by_key(stepped.select("_key", "_r").distinct().join(ranges, ["_key", "_r"], "left"))
    begun = by_key.select("_key", F.explode(starts("rs", "_r", F.lit(_milli(INITIAL)))).alias("x")).select("_key", "x._r", F.col("x.t").alias("_start"))
    inside = ranges.join(begun, ["_key", "_r"]).select("_key", "_r", F.explode(starts("bs", "_b", F.col("_start"))).alias("x")).select("_key", "_r", "x._b", F.col("x.t").alias("_t"))
    unrolled = F.aggregate("m", F.struct(F.col("_t").alias("t"), F.array().cast("array<int>").alias("all")), lambda s, m: F.element_at(F.transform(
        F.array(_held(s["t"] + m["_d"], F.lit(_LOW), F.lit(_HIGH))), lambda t: F.struct(t.alias("t"), F.concat(s["all"], F.array(t)).alias("all"))), 1))["all"]
    moved = blocks.join(inside, ["_key", "_r", "_b"]).select("_key", "_r", F.explode(F.arrays_zip(F.col("m"), unrolled.alias("t"))).alias("x")).select("_key", "_r", F.col("x.m._place").alias("_place"), F.col("x.t").alias("_t"))
    joined = stepped.join(begun, ["_key", "_r"]).join(moved, ["_key", "_r", "_place"], "left")
    now = F.coalesce(F.last("_t", ignorenulls=True).over(here), F.col("_start")) / 1000
    return joined.withColumn("threshold", now).drop("_key", "_r", "_place", "_start", "_t")


def current_threshold(log: DataFrame, order: str = "seq") -> DataFrame:
    """One row ``threshold``: that after the whole log, the initial one for an empty log. The run that the log is tells it, no feedback's own threshold is made."""
    _, ranges = _folded(_stepped(log, (), order))
    last = _after(F.lit(_milli(INITIAL)), _run("rs", lambda x: x["w"]))
    return _by_key(ranges).agg(F.coalesce(F.max(last) / 1000, F.lit(INITIAL)).alias("threshold"))


def report(log: DataFrame, order: str = "seq") -> DataFrame:
    """One row: the threshold, counts, accuracies in percent (0 for a path without feedback), steps taken so far (each feedback from the third on), and the report's text."""
    fast, slow = F.col("path") == "fast", F.col("path") == "slow"
    share = lambda p: F.coalesce(100.0 * F.count_if(p & F.col("was_accurate")) / F.nullif(F.count_if(p), F.lit(0)), F.lit(0.0))
    counts = log.agg(F.count("*").alias("total_feedbacks"), F.count_if(fast).alias("fast_n"), F.count_if(slow).alias("slow_n"), share(fast).alias("_f"), share(slow).alias("_s"))
    counts = counts.withColumn("threshold_history", F.greatest(F.lit(0).cast("long"), F.col("total_feedbacks") - (LEAST_FEEDBACKS - 1)))
    row = counts.crossJoin(current_threshold(log, order)).withColumnRenamed("threshold", "current_threshold")  # one row each
    two = lambda c: F.format_string("%.2f", F.col(c))
    # The lines of the report.
    text = F.concat_ws(
        "\n", F.concat(F.lit("Current Threshold : "), F.col("current_threshold").cast("string")), F.concat(F.lit("Total Feedbacks   : "), F.col("total_feedbacks").cast("string")),
        F.concat(F.lit("Fast Path Entries : "), F.col("fast_n").cast("string")), F.concat(F.lit("Slow Path Entries : "), F.col("slow_n").cast("string")),
        F.concat(F.lit("Fast Accuracy     : "), two("_f"), F.lit("%")), F.concat(F.lit("Slow Accuracy     : "), two("_s"), F.lit("%")),
        F.concat(F.lit("Threshold History : "), F.col("threshold_history").cast("string"), F.lit(" changes")))
    return row.select("current_threshold", "total_feedbacks", "fast_n", "slow_n", F.round("_f", 2).alias("fast_pct"), F.round("_s", 2).alias("slow_pct"), "threshold_history", text.alias("report"))
