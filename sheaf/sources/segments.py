"""A stored search index: immutable segments, deletions beside them, versions that are committed by one rename.

A segment is the inverted blocks of the chunks that one change brought. A change writes new folders only (a segment, the places that are gone
by then, the terms with their weights), then a manifest that names what belongs to the new version; the manifest gets its name by one rename, so a
reader sees the old version or the new one, and a job that dies anywhere before leaves the old one as it was. What it left
behind is not read and goes with ``vacuum``.

Texts are compared by id and hash. Only those that are new or changed are tokenised; of the rest nothing is read but ids and
hashes. Counts of terms are those of the version before, plus the new segment's, less those of chunks that went. One writer at a
time: a second one finds its version taken and raises ``files.Conflict``.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.operators import inverted
from sheaf.operators.inverted import Index
from sheaf.session import scratch, ship, spread, written

from . import files

#: Segments of an index before ``compact`` merges the small ones.
MOST_SEGMENTS = 8


@dataclass(frozen=True)
class Manifest:
    """What a version consists of: folders of segments by number, of the dead places, of the terms, and the corpus' counts."""

    version: int
    segments: dict[str, int]
    dead: str | None
    terms: str
    n_docs: int
    n_tokens: int
    n_blocks: int
    kind: str


def manifest(spark: SparkSession, path: str) -> Manifest | None:
    found = files.last_version(spark, path)
    return Manifest(**found) if found else None


def _commit(spark: SparkSession, path: str, made: Manifest) -> None:
    files.commit_version(spark, path, asdict(made))


def open_index(spark: SparkSession, path: str) -> Index | None:
    """The last committed version; nothing if there is none."""
    m = manifest(spark, path)
    return _opened(spark, path, m) if m else None


def _opened(spark: SparkSession, path: str, m: Manifest) -> Index:
    blocks = spark.read.schema(inverted.blocks_schema(m.kind)).parquet(*(f"{path}/{s}" for s in m.segments))
    dead = spark.read.schema("block bigint, gone array<int>").parquet(f"{path}/{m.dead}") if m.dead else None
    stats = spark.range(1).select(F.lit(m.n_docs).cast("long").alias("n_docs"), F.lit(m.n_tokens / m.n_docs if m.n_docs else None).cast("double").alias("avgdl"))
    return Index(blocks, spark.read.schema("term string, df bigint, idf double").parquet(f"{path}/{m.terms}"), stats, dead, m.n_blocks)


def _write_segment(rows: DataFrame, path: str, number: int) -> str:
    """Rows are written where they are made: a search reads terms from every file, so an order of all rows by term would cost a shuffle (and, for its borders, the making of all rows once more) and help nobody."""
    name = f"segment-{number:06d}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{name}")
    return name


def _totals(spark: SparkSession, segment: str) -> tuple[int, int, int]:
    """Chunks, tokens and blocks of a segment."""
    tokens = F.aggregate("lens", F.lit(0).cast("bigint"), lambda s, x: s + x)
    row = spark.read.parquet(segment).where(F.col("term").isNull()).agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.sum(tokens), F.lit(0)), F.count("*")).first()
    return row[0], row[1], row[2]


def rebuild(corpus: DataFrame, path: str) -> Manifest:
    """A version of one new segment, of a corpus ``(chunk_id, text)``, whatever was there."""
    spark = corpus.sparkSession
    with scratch(spark):
        return _rebuilt(corpus, path, manifest(spark, path))


def _rebuilt(corpus: DataFrame, path: str, old: Manifest | None) -> Manifest:
    spark = corpus.sparkSession
    number = max(old.segments.values(), default=0) + 1 if old else 1
    segment = _write_segment(inverted.blocks_of(corpus, number), path, number)
    n, tokens, blocks = _totals(spark, f"{path}/{segment}")
    made = Manifest(old.version + 1 if old else 1, {segment: number}, None, f"terms-{uuid.uuid4().hex}", n, tokens, blocks, dict(corpus.dtypes)["chunk_id"])
    counts = inverted.term_counts(spark.read.parquet(f"{path}/{segment}"))
    return _finish(spark, path, made, counts)


def _finish(spark: SparkSession, path: str, made: Manifest, counts: DataFrame) -> Manifest:
    stats = spark.range(1).select(F.lit(made.n_docs).cast("long").alias("n_docs"))
    inverted.term_weights(written(counts, "counts"), stats).write.parquet(f"{path}/{made.terms}")
    _commit(spark, path, made)
    return made


def sync(corpus: DataFrame, path: str) -> Manifest:
    """Bring the index to a corpus ``(chunk_id, text)``: what is new or changed is added, what is not in it any more goes."""
    spark = corpus.sparkSession
    old = manifest(spark, path)
    if old is None:
        return rebuild(corpus, path)
    given = corpus.select("chunk_id", inverted.digest_of(F.coalesce("text", F.lit(""))).alias("digest"))
    stored = _opened(spark, path, old).chunks
    gone = stored.join(given, _same(stored, given, "chunk_id", "digest"), "left_anti")
    with scratch(spark):
        return _change(corpus, path, old, given, gone)


def upsert(delta: DataFrame, path: str) -> Manifest:
    """Add chunks ``(chunk_id, text)``; those whose id is there with another text take its place, those with the same text cost nothing more than the comparison."""
    spark = delta.sparkSession
    old = manifest(spark, path)
    if old is None:
        return rebuild(delta, path)
    given = delta.select("chunk_id", inverted.digest_of(F.coalesce("text", F.lit(""))).alias("digest"))
    stored = _opened(spark, path, old).chunks
    touched = stored.join(given.select("chunk_id").distinct(), "chunk_id", "left_semi")
    with scratch(spark):
        return _change(delta, path, old, given, touched.join(given, _same(touched, given, "chunk_id", "digest"), "left_anti"))


def delete(ids: DataFrame, path: str) -> Manifest:
    """Take chunks ``(chunk_id)`` out."""
    spark = ids.sparkSession
    old = manifest(spark, path)
    if old is None:
        raise FileNotFoundError(f"no index in {path}")
    gone = _opened(spark, path, old).chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    nothing = ids.select("chunk_id", F.lit("").alias("text")).where("false")
    with scratch(spark):
        return _change(nothing, path, old, nothing.select("chunk_id", F.lit(0).cast("long").alias("digest")), gone)


def _same(a: DataFrame, b: DataFrame, *names: str):
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


def _change(corpus: DataFrame, path: str, old: Manifest, given: DataFrame, gone: DataFrame) -> Manifest:
    """The version after ``old`` with the rows of ``corpus`` whose (id, digest) is not stored, without the places ``gone``."""
    spark = corpus.sparkSession
    index = _opened(spark, path, old)
    stored = index.chunks
    gone = written(gone.select("block", "place", "doc_len"), "gone")
    missing = written(given.join(stored, _same(given, stored, "chunk_id", "digest"), "left_anti").distinct(), "missing")
    n_new = missing.count()
    n_gone, tokens_gone = gone.agg(F.count("*"), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
    if n_new == 0 and n_gone == 0:
        return old
    made = replace(old, version=old.version + 1, terms=f"terms-{uuid.uuid4().hex}", n_docs=old.n_docs - n_gone, n_tokens=old.n_tokens - tokens_gone)
    counts = index.terms.select("term", "df")
    if n_new:
        number = max(old.segments.values(), default=0) + 1
        keyed = corpus.select("chunk_id", "text", inverted.digest_of(F.coalesce("text", F.lit(""))).alias("digest"))
        fresh = keyed.join(missing, _same(keyed, missing, "chunk_id", "digest"), "left_semi")
        segment = _write_segment(inverted.blocks_of(spread(fresh), number), path, number)
        n, tokens, blocks = _totals(spark, f"{path}/{segment}")
        made = replace(made, segments={**old.segments, segment: number}, n_docs=made.n_docs + n, n_tokens=made.n_tokens + tokens, n_blocks=made.n_blocks + blocks)
        counts = counts.unionByName(inverted.term_counts(spark.read.parquet(f"{path}/{segment}")))
    if n_gone:
        places = gone.groupBy("block").agg(F.collect_set("place").alias("_new"))
        # terms of the chunks that go: rows of their blocks; a flag a place, so that a row looks its own places up and no more
        flags = places.select("block", F.transform(F.sequence(F.lit(0), F.array_max("_new")), lambda i: F.array_contains("_new", i)).alias("_flags"))
        held = index.blocks.where(F.col("term").isNotNull()).select("term", "block", "places").join(flags, "block")
        less = held.select("term", (-F.size(F.filter("places", lambda p: F.coalesce(F.get("_flags", p), F.lit(False))))).cast("long").alias("df"))
        counts = counts.unionByName(less.where("df < 0"))
        before = index.dead if index.dead is not None else spark.createDataFrame([], "block bigint, gone array<int>")
        all_dead = before.unionByName(places.select("block", F.col("_new").alias("gone"))).groupBy("block").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))
        made = replace(made, dead=f"dead-{uuid.uuid4().hex}")
        all_dead.write.parquet(f"{path}/{made.dead}")
    return _finish(spark, path, made, counts.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0"))


def compact(spark: SparkSession, path: str, most: int = MOST_SEGMENTS, size: int = inverted.BLOCK) -> Manifest:
    """With more than ``most`` segments, all but the largest (by chunks) become one: blocks are put together up to ``size`` chunks, deleted chunks are left out. No text is read."""
    old = manifest(spark, path)
    if old is None:
        raise FileNotFoundError(f"no index in {path}")
    if len(old.segments) <= most:
        return old
    with scratch(spark):
        return _compacted(spark, path, old, size)


def _compacted(spark: SparkSession, path: str, old: Manifest, size: int) -> Manifest:
    sizes = {s: _totals(spark, f"{path}/{s}") for s in old.segments}
    kept = max(sizes, key=lambda s: sizes[s][0])
    number = max(old.segments.values()) + 1
    index = _opened(spark, path, replace(old, segments={s: n for s, n in old.segments.items() if s != kept}))
    segment = _write_segment(_merged(index, number, size), path, number)
    made = replace(old, version=old.version + 1, segments={kept: old.segments[kept], segment: number}, dead=None, n_blocks=sizes[kept][2] + _totals(spark, f"{path}/{segment}")[2])
    if index.dead is not None:
        left = written(index.dead.join(spark.read.parquet(f"{path}/{kept}").where(F.col("term").isNull()).select("block"), "block", "left_semi"), "dead")
        if not left.isEmpty():
            made = replace(made, dead=f"dead-{uuid.uuid4().hex}")
            left.write.parquet(f"{path}/{made.dead}")
    _commit(spark, path, made)
    return made


def _merged(index: Index, number: int, size: int) -> DataFrame:
    """Rows of the blocks that take the place of ``index.blocks``. A new block's rows meet in one task, so postings are shuffled once."""
    lists, terms = index.blocks.where(F.col("term").isNull()), index.blocks.where(F.col("term").isNotNull())
    none = F.lit(None).cast("array<int>").alias("gone")
    lists = lists.join(index.dead, "block", "left") if index.dead is not None else lists.select("*", none)
    # a row a block
    alive = F.size("ids") - F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spots = written(lists.select("block", alive.alias("n")).select("block", F.floor(before / size).cast("long").alias("to")), "spots")
    # empty arrays in place of nulls: Spark's writer of Arrow batches goes over a run of null arrays again at each row
    full = lambda c: F.coalesce(c, F.array().cast(both.schema[c].dataType)).alias(c)
    both = lists.unionByName(terms.select("*", none))
    rows = both.select("term", "block", *(full(c) for c in ("places", "tfs", "lens", "ids", "digests", "gone"))).join(spots, "block")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return _one_block(table, number << inverted.SEGMENT_BITS | key[0].as_py())

    ship(index.blocks.sparkSession)
    return rows.groupBy("to").applyInArrow(run, index.blocks.schema)


def _one_block(table: pa.Table, number: int) -> pa.Table:
    """One block of several: their chunks in the blocks' order without the dead ones, and postings with the places there."""
    listed = table.filter(pc.is_null(table["term"])).sort_by("block")
    at, made, start, fields = 0, [], {}, {"ids": [], "digests": [], "lens": []}
    for b, n, gone in zip(listed["block"].to_pylist(), pc.list_value_length(listed["ids"]).to_pylist(), listed["gone"].to_pylist(), strict=True):
        keep = np.ones(n, bool)
        keep[gone] = False
        start[b] = sum(map(len, made))
        made.append(np.where(keep, np.cumsum(keep) - 1 + at, -1))
        at += int(keep.sum())
    moved = np.concatenate(made) if made else np.zeros(0, np.int64)
    kept = pa.array(moved >= 0)
    for name in fields:
        fields[name] = pc.list_flatten(listed[name]).combine_chunks().filter(kept)
    chunk_lens = fields["lens"].to_numpy(zero_copy_only=False).astype(np.int32)
    rows = table.filter(pc.is_valid(table["term"]))
    words = rows["term"].combine_chunks().dictionary_encode()
    count = pc.list_value_length(rows["places"]).to_numpy().astype(np.int64)
    flat = lambda name: pc.list_flatten(rows[name]).to_numpy()
    first = np.array([start[b] for b in rows["block"].to_pylist()], np.int64)
    place = moved[np.repeat(first, count) + flat("places")]
    left = place >= 0
    code, place, tf = np.repeat(words.indices.to_numpy().astype(np.int64), count)[left], place[left], flat("tfs")[left]
    order = np.lexsort((place, code))
    code, place, tf = code[order], place[order].astype(np.int32), tf[order].astype(np.int32)
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    none, lens = len(starts), chunk_lens[place]
    offsets, whole = pa.array(np.append(starts, len(code)).astype(np.int32)), pa.array([0, at], pa.int32())
    one = pa.ListArray.from_arrays
    most, least = (np.maximum.reduceat(tf, starts), np.minimum.reduceat(lens, starts)) if none else (tf, lens)
    lists = lambda x: pa.concat_arrays([one(offsets, pa.array(x)), pa.nulls(1, pa.list_(pa.int32()))])
    ids, digests = (pa.concat_arrays([pa.nulls(none, pa.list_(fields[n].type)), one(whole, fields[n])]) for n in ("ids", "digests"))
    last = pa.nulls(1, pa.int32())
    return pa.table({
        "term": pa.concat_arrays([words.dictionary.take(pa.array(code[starts])), pa.nulls(1, words.dictionary.type)]), "block": pa.array(np.full(none + 1, number)), "places": lists(place), "tfs": lists(tf),
        "lens": pa.concat_arrays([one(offsets, pa.array(lens)), one(whole, pa.array(chunk_lens))]), "most_tf": pa.concat_arrays([pa.array(most), last]), "least_len": pa.concat_arrays([pa.array(least), last]), "ids": ids, "digests": digests})


def vacuum(spark: SparkSession, path: str) -> None:
    """Remove what the last version does not name."""
    last = manifest(spark, path)
    if last:
        files.vacuum(spark, path, {*last.segments, last.terms, last.dead or ""})
