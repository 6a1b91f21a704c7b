"""Triplets to a property graph and questions to it; nodes and edges are plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.session import written

from .numbering import numbered
from .substring import containing

LEAST_CONFIDENCE = 0.7


def _norm(c: str) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"^\s+|\s+$", ""))


def usable(triplets: DataFrame, *more: str) -> DataFrame:
    """Lower-cased, stripped triplets with subject, object and confidence of at least 0.7 (0.8 where missing). ``seq`` orders them."""
    t = triplets.select(_norm("subject").alias("subject"), _norm("relationship").alias("relationship"), _norm("object").alias("object"), F.coalesce("confidence", F.lit(0.8)).alias("confidence"), F.coalesce("source_file", F.lit("")).alias("source_file"), "seq", *more)
    return t.where((F.col("subject") != "") & (F.col("object") != "") & (F.col("confidence") >= LEAST_CONFIDENCE))


def nodes(triplets: DataFrame) -> DataFrame:
    """``node, mentions, node_type``: the type is the role of the first mention (a subject is an entity and counts before its object)."""
    return merged_nodes(node_parts(triplets)).drop("first_at")


def node_parts(triplets: DataFrame, *more: str) -> DataFrame:
    """``node, mentions, node_type, first_at`` of each mention, to be merged; ``more`` columns are carried along."""
    t = usable(triplets, *more)
    roles = F.array(
        F.struct(F.col("subject").alias("node"), F.lit("entity").alias("node_type"), (F.col("seq") * 2).alias("first_at")),
        F.struct(F.col("object").alias("node"), F.lit("value").alias("node_type"), (F.col("seq") * 2 + 1).alias("first_at")))
    return t.select(F.explode(roles).alias("r"), *more).select("r.node", F.lit(1).cast("long").alias("mentions"), "r.node_type", "r.first_at", *more)


def merged_nodes(parts: DataFrame) -> DataFrame:
    """Parts of nodes as one row a node; merging them in any order and grouping gives the same."""
    return parts.groupBy("node").agg(F.sum("mentions").alias("mentions"), F.min_by("node_type", "first_at").alias("node_type"), F.min("first_at").alias("first_at"))


def edges(triplets: DataFrame) -> DataFrame:
    """At most one edge from a node to another: the last triplet wins."""
    return merged_edges(usable(triplets)).drop("seq")


def merged_edges(parts: DataFrame) -> DataFrame:
    """``subject, object, relationship, confidence, source_file, seq``: the last of each pair."""
    last = F.max_by(F.struct("relationship", "confidence", "source_file"), "seq")
    return parts.groupBy("subject", "object").agg(last.alias("e"), F.max("seq").alias("seq")).select("subject", "object", "e.*", "seq")


def degrees(edge_rows: DataFrame) -> DataFrame:
    """In and out degree; a loop counts twice."""
    return edge_rows.select(F.explode(F.array("subject", "object")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def relationship_histogram(edge_rows: DataFrame) -> DataFrame:
    return edge_rows.groupBy("relationship").agg(F.count("*").alias("n"))


def resolve(node_rows: DataFrame, entities: DataFrame) -> DataFrame:
    """``entity, node``: the exact node, else the first (by ``node``) that contains the entity, any node for an empty one. Entities without an exact node are looked for by q-grams (``substring``)."""
    e = entities.select("entity", F.lower(F.regexp_replace("entity", r"^\s+|\s+$", "")).alias("_q")).distinct()
    names = node_rows.select("node").distinct()
    exact = e.join(names, F.col("node") == F.col("_q")).select("entity", "node")
    rest = e.join(exact.select("entity"), "entity", "left_anti")
    near = containing(names, rest.select(F.col("_q").alias("text"))).groupBy("text").agg(F.min("node").alias("node"))
    found = rest.join(near, F.col("_q") == F.col("text")).select("entity", "node")
    least = rest.where(F.col("_q") == "").select("entity", names.agg(F.min("node")).scalar().alias("node")).where(F.col("node").isNotNull())
    return exact.unionByName(found).unionByName(least)


def khop(edge_rows: DataFrame, starts: DataFrame, hops: int = 2) -> DataFrame:
    """``entity, subject, relationship, object``: edges that touch the nodes within ``hops`` of an entity's node (so one hop more of edges)."""
    both = edge_rows.select(F.col("subject").alias("a"), F.col("object").alias("b")).unionByName(edge_rows.select(F.col("object").alias("a"), F.col("subject").alias("b")))
    reach, level = starts, starts
    for _ in range(hops):
        level = level.join(both, F.col("node") == F.col("a")).select("entity", F.col("b").alias("node")).distinct()
        reach = reach.unionByName(level).distinct()
    touched = edge_rows.join(reach, F.col("subject") == F.col("node")).select("entity", "subject", "relationship", "object", "source_file")
    touching = edge_rows.join(reach, F.col("object") == F.col("node")).select("entity", "subject", "relationship", "object", "source_file")
    return touched.unionByName(touching).distinct()


def triplet_line(subject: Column, relationship: Column, obj: Column, source: Column) -> Column:
    return F.concat(subject, F.lit(" → "), relationship, F.lit(" → "), obj, F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.lit("  [Source: "), source, F.lit("]"))).otherwise(""))


def even_sample(chunks: DataFrame, by: str, order: str, per: int = 150, most: int | None = None) -> DataFrame:
    """Evenly spaced rows of each source: every ``max(1, n div per)``-th, at most ``per``, and ``most`` over all, sources in order of their first row (the sample is the operator's point)."""
    # rows are numbered by their keys and a hash, which settles ties of the order; only rows of the sample are taken whole
    row = [by, F.col(order).alias("_order"), F.xxhash64(*chunks.columns).alias("_h")]
    slim = chunks.select(*row)
    counts = slim.groupBy(by).agg(F.greatest(F.lit(1), F.floor(F.count("*") / per)).alias("_s"), F.min("_order").alias("_first")).withColumnRenamed(by, "_by")
    ranked = numbered(slim, ["_order", "_h"], (by,)).join(counts, F.col(by).eqNullSafe(F.col("_by")))
    out = ranked.where((F.col("_k") % F.col("_s") == 0) & (F.col("_k") / F.col("_s") < per))
    out = out.orderBy("_first", "_k").limit(most) if most is not None else out
    # repeated rows are as good as each other: as many of them as were picked
    picked = written(out.groupBy(F.col(by).alias("_by"), F.col("_order").alias("_at"), F.col("_h").alias("_hash")).agg(F.count("*").alias("_n")), "picked")
    found = chunks.withColumn("_h", F.xxhash64(*chunks.columns)).join(picked, F.col(by).eqNullSafe(F.col("_by")) & F.col(order).eqNullSafe(F.col("_at")) & (F.col("_h") == F.col("_hash")))
    again = F.row_number().over(Window.partitionBy("_by", "_at", "_hash").orderBy("_hash"))
    return found.withColumn("_again", again).where("_again <= _n").select(*chunks.columns)


def hashed_sample(df: DataFrame, id_col: str, k: int, seed: int = 0) -> DataFrame:
    """``k`` rows as good as random: those of the least md5 of seed and id (then id). The same rows in every layout, run and engine; of a union, the least of the parts' samples."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col).limit(k)


def unprocessed(chunks: DataFrame, triplets: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """Chunks without a triplet, and, where a log of processed chunks is kept, not in it (else chunks without facts come again)."""
    left = chunks.join(triplets.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return left.join(processed.select("chunk_id").distinct(), "chunk_id", "left_anti") if processed is not None else left
