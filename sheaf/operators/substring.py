"""Which names contain which texts, by an equi join on q-grams.

A text of three characters or more is looked for by the rarest of its q-grams: every name that contains the text has that gram, so names with it are the candidates,
and ``contains`` decides. A shorter text is a gram itself. Names are cut into those grams only that some text asks for, once to count them and once to join; no
pair of text and name meets without a gram in common, and a common gram's join may be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Q = 3


def grams(text: Column, size: Column | int) -> Column:
    """The distinct runs of ``size`` characters of a text."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.length(text) - size
    return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(text, i + 1, size)))).otherwise(F.array().cast("array<string>"))


def containing(names: DataFrame, asked: DataFrame, name: str = "node", text: str = "text") -> DataFrame:
    """``text, name`` of all names ``(name)`` that contain a text ``(text)``, each pair once; an empty text is in no name here, nulls are left out."""
    wanted = asked.select(F.col(text).alias("_t")).where(F.length("_t") > 0).distinct()
    held = names.select(F.col(name).alias("_n")).where(F.col("_n").isNotNull()).distinct()
    parts = wanted.select("_t", F.explode(grams(F.col("_t"), F.least(F.length("_t"), F.lit(Q)))).alias("_g"))
    sizes = parts.select(F.length("_g").alias("_size"), F.col("_g").alias("_w")).distinct()
    # grams of the sizes that are asked for (three at most)
    cut = held.select("_n", F.explode(F.array(*map(F.lit, range(1, Q + 1)))).alias("_s")).join(F.broadcast(sizes.select(F.col("_size").alias("_s")).distinct()), "_s", "left_semi")
    posted = cut.select("_n", F.explode(grams(F.col("_n"), F.col("_s"))).alias("_g")).join(parts.select("_g").distinct(), "_g", "left_semi")
    counts = posted.groupBy("_g").agg(F.count("*").alias("_c"))
    # a text with a gram that no name has is in no name
    rarest = parts.join(counts, "_g", "left").groupBy("_t").agg(F.min(F.struct(F.coalesce("_c", F.lit(0)).alias("c"), F.col("_g").alias("g"))).alias("_r")).where("_r.c > 0")
    pairs = posted.join(rarest.select("_t", F.col("_r.g").alias("_g")), "_g").where(F.contains("_n", "_t"))
    return pairs.select(F.col("_t").alias(text), F.col("_n").alias(name))
