"""Merkle manifest of a table, proofs of its rows, and their verification.

A leaf is the hash of a row's fields, made by Spark. The leaves of a group are numbered by id; every 4096 (8 to the power of ``LEVELS``) consecutive
ones are an aligned block, as runs of eight and their parents never cross its border. Executors take a block as an Arrow table and
climb its levels in DuckDB, one query a block: ordered ``string_agg`` of a run's hashes, ``sha256`` of it. Spark gathers the
roots of the blocks, which are numbered already and climb in the same way, a block of blocks at a time, until one hash of each group is left;
those, by group, climb to the root. A node's way up is two lists, what stands to the left and to the right of it in its run at each
level; they are kept for blocks (one in 4096 leaves), joined to the leaves of the block, and hashed there with the ways inside the block.

Defined results: null fields are written ``-``; a null group is a group, the first; leaves of one group are ordered by id, null ids first, equal ids
by their leaf, so repeated rows stand side by side and each has its own proof (which of them has which is the same to every reader, as they
are equal); a lone leaf is its group's root, with an empty proof; a single group's root is the root; an empty table gives an empty result. Fields are
named, other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators.numbering import numbered

from .common import bounded_batches, documents, materialize
from .urls import LOWER, UPPER

ARITY_BITS, LEVELS = 3, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_RUN = (1 << ARITY_BITS) - 1
#: A node's group (null or not, its value) and its number in it.
_NODE = "known boolean, name string, k bigint"


def encoded(field: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon, the value (integers in decimal)."""
    text = field.cast("string")
    return F.when(field.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(fields: list[Column]) -> Column:
    """The leaf's 32 bytes."""
    return F.unhex(F.sha2(F.concat(*(encoded(f) for f in fields)).cast("binary"), 256))


_engine = None


def _duckdb():
    """A Python worker's in-memory engine: one thread, as each task has one core; nothing is written outside."""
    global _engine
    if _engine is None:
        import duckdb

        _engine = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
    return _engine


def _climb(depth: int, first: str) -> str:
    """CTEs of a block: ``n0`` (the relation ``first``: i, h), then runs ``r1`` (r, s) and their nodes ``n1`` (i, h) to ``depth``."""
    levels = [f"n0 AS MATERIALIZED ({first})"]
    for j in range(1, depth + 1):
        levels.append(f"r{j} AS MATERIALIZED (SELECT i >> {ARITY_BITS} AS r, string_agg(h, '' ORDER BY i) AS s FROM n{j - 1} GROUP BY 1)")
        levels.append(f"n{j} AS MATERIALIZED (SELECT r AS i, sha256(s) AS h FROM r{j})")
    return "WITH " + ", ".join(levels)


def _sides(depth: int) -> tuple[str, str]:
    """Columns ``b1, a1, ...``: what stands before and after a node of ``n0 AS x`` in its run at each level; and the joins they need."""
    place = lambda j: f"64 * ((x.i >> {ARITY_BITS * (j - 1)}) & {_RUN})"
    columns = "".join(f", substr(r{j}.s, 1, {place(j)}) AS b{j}, substr(r{j}.s, {place(j)} + 65) AS a{j}" for j in range(1, depth + 1))
    return columns, "".join(f" JOIN r{j} ON r{j}.r = x.i >> {ARITY_BITS * j}" for j in range(1, depth + 1))


def _inside(n: int) -> int:
    """Levels that a lone block of ``n`` nodes has."""
    depth = 0
    while n > 1:
        n, depth = (n + _RUN) >> ARITY_BITS, depth + 1
    return depth


def _first(levels: int, more: str = "") -> str:
    """The nodes of a block by their place in it."""
    return f"SELECT CAST(k & {(1 << ARITY_BITS * levels) - 1} AS INTEGER) AS i, lower(hex(h)) AS h{more} FROM nodes"


def _block_roots(nodes: DataFrame, levels: int) -> DataFrame:
    """``known, name, k (the block's number), n, h, lone``: each block's hash after all its levels, and the one it has where it is its group's only block."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        con = _duckdb()
        con.register("nodes", table)
        depth = _inside(table.num_rows)
        h, lone = con.execute(f"{_climb(levels, _first(levels))} SELECT (SELECT h FROM n{levels}), (SELECT h FROM n{depth})").fetchall()[0]
        con.unregister("nodes")
        known, name, block = (x.as_py() for x in key)
        return pa.table({"known": [known], "name": [name], "k": pa.array([block], pa.int64()), "n": pa.array([table.num_rows], pa.int64()), "h": pa.array([bytes.fromhex(h)], pa.binary()), "lone": pa.array([bytes.fromhex(lone)], pa.binary())})

    return materialize(_blocked(nodes, levels).applyInArrow(run, f"{_NODE}, n bigint, h binary, lone binary"), "blocks")


def _blocked(nodes: DataFrame, levels: int):
    return nodes.withColumn("block", F.shiftright("k", ARITY_BITS * levels)).groupBy("known", "name", "block")


def _ways(nodes: DataFrame, levels: int) -> DataFrame:
    """``known, name, k, before, after, top`` of nodes ``(known, name, k, h)``: both sides at each level up to the group's last hash."""
    above = _frames(nodes, levels)

    def run(key: tuple, table: pa.Table, frame: pa.Table) -> pa.Table:
        at = frame.to_pylist()[0]
        con = _duckdb()
        con.register("nodes", table)
        sides, joins = _sides(at["depth"])
        before, after = (f"[{', '.join(f'{side}{j}' for j in range(1, at['depth'] + 1))}]::VARCHAR[]" for side in "ba")
        sql = f"""{_climb(at["depth"], _first(levels, ", k"))}
            SELECT k, {before} || $1 AS before, {after} || $2 AS after FROM (SELECT x.k{sides} FROM n0 x{joins})"""
        out = con.sql(sql, params=[at["before"], at["after"]]).to_arrow_table()
        con.unregister("nodes")
        n = out.num_rows
        return pa.table({"known": pa.array([at["known"]] * n, pa.bool_()), "name": pa.array([at["name"]] * n, pa.string()), **{c: out[c] for c in ("k", "before", "after")}, "top": pa.array([at["top"]] * n, pa.binary())})

    return materialize(_blocked(nodes, levels).cogroup(above.groupBy("known", "name", "k")).applyInArrow(run, f"{_NODE}, before array<string>, after array<string>, top binary"), "ways")


def _frames(nodes: DataFrame, levels: int) -> DataFrame:
    """``known, name, k (a block's number), depth (levels inside), before, after, top``: every block's way from its root to the group's last hash."""
    blocks = _block_roots(nodes, levels)
    several = blocks.where("k > 0").select("known", "name").distinct()
    lone = blocks.join(several, ["known", "name"], "left_anti")
    # levels of a lone block: the least d with 8 to the d not under n
    depth = sum(F.when(F.col("n") > 1 << ARITY_BITS * d, 1).otherwise(0) for d in range(levels))
    none = F.array().cast("array<string>")
    out = lone.select("known", "name", "k", depth.cast("int").alias("depth"), none.alias("before"), none.alias("after"), F.col("lone").alias("top"))
    if several.isEmpty():
        return out
    ways = _ways(blocks.join(several, ["known", "name"]).select("known", "name", "k", "h"), levels)
    return out.unionByName(ways.select("known", "name", "k", F.lit(levels).alias("depth"), "before", "after", "top"))


@dataclass(frozen=True)
class Manifest:
    """``leaves (known, name, k, id, h, other)``: numbered in their groups, ``other`` the leaf of the row at hand where it is not the manifest's;
    ``blocks (known, name, k, depth, before, after, subroot, root)``: the way from each block to the root; ``levels`` are climbed in a block."""

    leaves: DataFrame
    blocks: DataFrame
    levels: int


def manifest(df: DataFrame, *, group: str = "lang", id_col: str = "doc_id", fields: tuple[str, ...] = FIELDS, tampered: Callable[[Column, Column], Column] | None = None, levels: int = LEVELS) -> Manifest:
    """The manifest of a table; ``tampered(id, text)`` changes ``text`` in the rows that are verified against it; ``levels`` are climbed in a block."""
    bounded_batches(df.sparkSession)
    columns = [F.col(f) for f in fields]
    other = F.lit(None).cast("binary")
    if tampered is not None:
        changed = [tampered(F.col(id_col), c) if f == "text" else c for f, c in zip(fields, columns, strict=True)]
        text = changed[fields.index("text")]
        other = F.when(~text.eqNullSafe(F.col("text")), leaf_of(changed))
    slim = df.select(F.col(group).isNotNull().alias("known"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("name"), F.col(id_col).alias("id"), leaf_of(columns).alias("h"), other.alias("other"))
    # written before it is sorted: the borders of a sort's ranges are found by another look at the rows, and texts are to be hashed once
    leaves = numbered(materialize(slim, "leaves"), ["id", "h"], ("known", "name"), "k")
    frames = materialize(_frames(leaves.select("known", "name", "k", "h"), levels), "frames")
    tops = numbered(frames.select("known", "name", F.col("top").alias("h")).distinct(), ["known", "name"], name="k")
    named = tops.select(F.col("known").alias("_known"), F.col("name").alias("_name"), "k")
    outer = _ways(tops.select(F.lit(True).alias("known"), F.lit("").alias("name"), "k", "h"), levels)
    outer = named.join(outer.select("k", F.col("before").alias("_before"), F.col("after").alias("_after"), F.col("top").alias("root")), "k").drop("k")
    at = frames.join(outer, (F.col("known") == F.col("_known")) & (F.col("name") == F.col("_name")))
    return Manifest(leaves, at.select("known", "name", "k", "depth", F.concat("before", "_before").alias("before"), F.concat("after", "_after").alias("after"), F.col("top").alias("subroot"), "root"), levels)


def proved(made: Manifest, id_col: str = "doc_id") -> DataFrame:
    """``id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every leaf, all hashes in lower-case hex: each block meets its way and is folded at once."""
    kind, levels = dict(made.leaves.dtypes)["id"], made.levels

    def run(key: tuple, table: pa.Table, frame: pa.Table) -> pa.Table:
        at = frame.to_pylist()[0]
        depth, outer = at["depth"], list(zip(at["before"], at["after"], strict=True))
        con = _duckdb()
        con.register("nodes", table)
        sides, joins = _sides(depth)
        inside = " || ".join(f"b{j} || a{j}" for j in range(1, depth + 1)) or "''"
        node = "other"
        for j in range(1, depth + 1):
            node = f"sha256(b{j} || {node} || a{j})"
        for j in range(len(outer)):  # hashes only, so they are parameters in pairs
            node = f"sha256(${2 * j + 2} || {node} || ${2 * j + 3})"
        sql = f"""{_climb(depth, _first(levels, ', id, lower(hex(coalesce(other, h))) AS other'))}
            SELECT id, h AS leaf, sha256({inside} || $1) AS proof_sha256, {node} AS folded_root FROM (SELECT x.id, x.h, x.other{sides} FROM n0 x{joins})"""
        out = con.sql(sql, params=["".join(b + a for b, a in outer), *(x for pair in outer for x in pair)]).to_arrow_table()
        con.unregister("nodes")
        n, root = out.num_rows, at["root"].hex()
        folded = out["folded_root"].combine_chunks() if n else pa.array([], pa.string())
        return pa.table({id_col: out["id"].cast(table.schema.field("id").type), "leaf": out["leaf"], "subroot": pa.array([at["subroot"].hex()] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
                         "proof_sha256": out["proof_sha256"], "folded_root": folded, "verified": pa.array([x == root for x in folded.to_pylist()], pa.bool_())})

    schema = f"`{id_col}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _blocked(made.leaves, levels).cogroup(made.blocks.groupBy("known", "name", "k")).applyInArrow(run, schema)


def lower_every_third(doc_id: Column, text: Column) -> Column:
    """The text with A to Z in lower case where 3 divides the crc32 of the id's decimal text; a null id's stays."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.translate(text, UPPER, LOWER)).otherwise(text)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proved(manifest(documents(spark, sf_dir), tampered=lower_every_third))
