"""An inverted index in blocks of chunks, and BM25 search that skips what cannot enter the top k.

A block is a run of chunks as they come (no more than ``BLOCK``), so nothing is shuffled to make it. The index is one table of rows by
term and block: the places of the chunks that hold the term, ascending, with term counts and chunk lengths, and two numbers, the greatest
count and the least length, which bound the term's gain in the block whatever the corpus' mean length has become. A row without a term lists the
block's chunks.

A search of many blocks has two passes. Bounds of (query, block) are sums over the query's terms of rows' two numbers, no array is read. The first pass scores each query in
its ``FIRST`` blocks of greatest bound; the k-th best score found there is the query's threshold. The second takes the blocks whose bound
reaches it. Where there are no more than ``ONE_PASS`` blocks, or an index is not stored, one pass takes them all. Inside a block the same is done over again for groups of ``GROUP`` chunks, whose greatest gains come from the
arrays: groups are scored by falling bound until none reaches the k-th best score so far. A block returns the chunks that may be
in the query's top k of all.

Scores are divided by the query's best and rounded to four places before they are ranked, ties go by the chunk id. So all thresholds are lowered by
a ten-thousandth of what any chunk can score: what is skipped ranks behind the k-th whatever rounding does.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.functions.text import STOP_WORDS, searched
from sheaf.session import ship, written

K1, B, EPSILON = 1.5, 0.75, 0.25
BLOCK, GROUP, FIRST = 2048, 2, 1
#: Blocks that are searched in one pass.
ONE_PASS = 64
#: Queries that one task scores at once.
QUERIES = 4096
#: Bits of a block's number below the segment's, and below the partition's.
SEGMENT_BITS, PART_BITS = 40, 16
#: A rounding step of scores over the query's best, and a little for sums in another order.
_STEP = 1.01e-4


@dataclass(frozen=True)
class Index:
    """``blocks`` (see ``blocks_of``), ``terms (term, df, idf)``, ``stats (n_docs, avgdl)`` and, where chunks were deleted, ``dead (block, gone)``: their places; ``n_blocks`` where it is known."""

    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame
    dead: DataFrame | None = None
    n_blocks: int | None = None

    def live(self) -> DataFrame:
        """Rows of ``blocks`` with ``gone``, null where nothing was deleted."""
        if self.dead is None:
            return self.blocks.withColumn("gone", F.lit(None).cast("array<int>"))
        return self.blocks.join(self.dead, "block", "left")

    @property
    def chunks(self) -> DataFrame:
        """``chunk_id, digest, doc_len, block, place`` of the chunks at hand."""
        return chunk_rows(self.live().where(F.col("term").isNull()))

    @property
    def postings(self) -> DataFrame:
        """``term, block, place, tf, doc_len`` of the chunks at hand."""
        rows = self.live().where(F.col("term").isNotNull()).select("term", "block", "gone", F.explode(F.arrays_zip("places", "tfs", "lens")).alias("p"))
        return rows.where(~F.coalesce(F.array_contains("gone", F.col("p.places")), F.lit(False))).select("term", "block", F.col("p.places").alias("place"), F.col("p.tfs").alias("tf"), F.col("p.lens").alias("doc_len"))


def chunk_rows(lists: DataFrame) -> DataFrame:
    """The chunks of rows without a term."""
    rows = lists.select("block", "gone", F.posexplode(F.arrays_zip("ids", "digests", "lens")).alias("place", "c"))
    return rows.where(~F.coalesce(F.array_contains("gone", F.col("place")), F.lit(False))).select(F.col("c.ids").alias("chunk_id"), F.col("c.digests").alias("digest"), F.col("c.lens").alias("doc_len"), "block", "place")


def blocks_schema(kind: str) -> str:
    return f"term string, block bigint, places array<int>, tfs array<int>, lens array<int>, most_tf int, least_len int, ids array<{kind}>, digests array<bigint>"


def digest_of(text: Column) -> Column:
    return F.xxhash64(text)


#: Bytes of tokens; those of characters beyond ASCII are none of them.
_TOKEN = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789_"))


def token_runs(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The tokens of searched texts (``text.searched``) in order and the place of the text that each is from, as ``text.tokens`` reads them but for stop words: from the bytes of all texts at once."""
    texts = texts.cast(pa.large_string())
    _, edges, data = texts.buffers()
    edges = np.frombuffer(edges, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    letters = np.frombuffer(data or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    inside = _TOKEN[letters]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # a text's own ends, if it is not empty
    full = np.flatnonzero(np.diff(edges))
    first[edges[full]], last[edges[full + 1] - 1] = inside[edges[full]], inside[edges[full + 1] - 1]
    starts, sizes = np.flatnonzero(first), np.flatnonzero(last) + 1 - np.flatnonzero(first)
    kept = sizes > 1
    inside[starts[~kept]] = False
    starts, ends = starts[kept], np.append(0, np.cumsum(sizes[kept]))
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters[inside])])
    return words.dictionary_encode(), np.searchsorted(edges, starts, side="right") - 1


def blocks_of(corpus: DataFrame, segment: int = 0, size: int = BLOCK) -> DataFrame:
    """Rows ``term, block, places, tfs, lens, most_tf, least_len`` of a corpus ``(chunk_id, text)``, and a row a block ``block, ids, lens, digests`` without a term.

    A batch of texts is tokenised and inverted as a whole: tokens become numbers, a sort of (token, place) brings a term's places together.
    """
    ship(corpus.sparkSession)
    kind = dict(corpus.dtypes)["chunk_id"]

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                b = whole.slice(at, size)
                n = b.num_rows
                words, of = token_runs(b.column(2))
                terms, code = words.dictionary.cast(pa.string()), words.indices.to_numpy().astype(np.int64)
                counted = ~pc.is_in(terms, pa.array(STOP_WORDS)).to_numpy(zero_copy_only=False)[code]
                code, of = code[counted], of[counted]
                lens = np.bincount(of, minlength=n).astype(np.int32)
                key, tf = np.unique(code * n + of, return_counts=True)
                code, place = key // n, (key % n).astype(np.int32)
                starts = np.flatnonzero(np.diff(code, prepend=-1))
                offsets = pa.array(np.append(starts, len(key)).astype(np.int32))
                listed = lambda x, offsets=offsets: pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32)))
                least = np.minimum.reduceat(lens[place], starts) if len(starts) else lens[:0]
                most = np.maximum.reduceat(tf, starts) if len(starts) else tf[:0]
                none = len(starts)
                number = segment << SEGMENT_BITS | part << PART_BITS | made
                made += 1
                one = pa.ListArray.from_arrays
                ends = pa.array([0, n], pa.int32())
                rows = pa.RecordBatch.from_arrays([
                    terms.take(pa.array(code[starts])), pa.array(np.full(none, number)), listed(place), listed(tf), listed(lens[place]),
                    pa.array(most.astype(np.int32)), pa.array(least.astype(np.int32)), pa.nulls(none, pa.list_(b.column(0).type)), pa.nulls(none, pa.list_(pa.int64()))], names)
                chunks = pa.RecordBatch.from_arrays([
                    pa.nulls(1, pa.string()), pa.array([number]), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32())), one(ends, pa.array(lens)),
                    pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), one(ends, b.column(0)), one(ends, b.column(1))], names)
                yield chunks
                if none:
                    yield rows

    schema = blocks_schema(kind)
    names = [x.split()[0] for x in schema.split(", ")]
    return corpus.select("chunk_id", digest_of(F.coalesce("text", F.lit(""))).alias("digest"), searched(F.col("text")).alias("t")).mapInArrow(run, schema)


def corpus_stats(blocks: DataFrame) -> DataFrame:
    """One row: number of chunks and their average length in tokens (null for no chunks)."""
    lists = blocks.where(F.col("term").isNull())
    total = F.aggregate("lens", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return lists.select(F.size("lens").alias("n"), total.alias("t")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"), (F.sum("t") / F.nullif(F.sum("n"), F.lit(0))).alias("avgdl"))


def term_counts(blocks: DataFrame) -> DataFrame:
    """``term, df``."""
    return blocks.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum(F.size("places")).alias("df"))


def term_weights(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """``term, df, idf``; a negative idf becomes a quarter of the mean idf over the vocabulary."""
    n = stats.select("n_docs").scalar()
    raw = counts.select("term", "df", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw")).scalar()
    return raw.select("term", "df", F.when(F.col("raw") < 0, EPSILON * mean).otherwise(F.col("raw")).alias("idf"))


def index_of(corpus: DataFrame) -> Index:
    """An index that is not stored: whatever uses it reads the texts again."""
    blocks = blocks_of(corpus)
    stats = corpus_stats(blocks)
    return Index(blocks, term_weights(term_counts(blocks), stats), stats)


def _gain(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def best_chunks(index: Index, wanted: DataFrame, k: int) -> DataFrame:
    """``query_id, chunk_id, raw, best``: chunks that may be among the first ``k`` of a query ``(query_id, term, qf)``, in any case those that are, with BM25 and the query's best."""
    hits = _search(index, wanted, k).where(F.col("place").isNotNull())
    lists = index.blocks.where(F.col("term").isNull()).select("block", "ids")
    best = F.max("raw").over(Window.partitionBy("query_id"))
    return hits.withColumn("best", best).join(lists, "block").select("query_id", F.get("ids", F.col("place")).alias("chunk_id"), "raw", "best")


def search_work(index: Index, wanted: DataFrame, k: int) -> DataFrame:
    """``query_id, scored, sharing``: (query, chunk) pairs that the second pass scores, and those that share a term."""
    done = _search(index, wanted, k).where(F.col("place").isNull()).groupBy("query_id").agg(F.sum("scored").alias("scored"))
    shared = index.postings.join(wanted, "term").select("query_id", "block", "place").distinct().groupBy("query_id").agg(F.count("*").alias("sharing"))
    return shared.join(done, "query_id", "left").select("query_id", F.coalesce("scored", F.lit(0)).alias("scored"), "sharing")


def _search(index: Index, wanted: DataFrame, k: int) -> DataFrame:
    """``query_id, block, place, raw, scored``: hits, and a row without a place for each (query, block) with the number of chunks scored.

    What several steps read is small and written once: the queries' terms, the bounds, the thresholds.
    """
    weighted = wanted.join(index.terms, "term").select("query_id", "term", (F.col("qf") * F.col("idf")).alias("w"))
    # no gain is above k1 + 1
    most = F.sum(F.greatest("w", F.lit(0.0))).over(Window.partitionBy("query_id")) * ((K1 + 1) * _STEP)
    weighted = written(weighted.withColumn("margin", most), "asked")
    ask = F.collect_list(F.struct("query_id", "w", "cut", "margin"))
    part = _part(weighted)
    if index.n_blocks is None or index.n_blocks <= ONE_PASS:
        asked = weighted.withColumn("cut", F.lit(0.0)).groupBy("term", part.alias("part")).agg(ask.alias("asks"))
        return _scored(index, index.live().where(F.col("term").isNotNull()), written(asked, "asks"), ["term"], k)
    # rows of terms that nobody asks for stay where they are; the others are written once, three steps read them
    own = index.live().where(F.col("term").isNotNull()).join(weighted.select("term").distinct(), "term", "left_semi")
    held = written(own.select("term", "block", "places", "tfs", "lens", "most_tf", "least_len", "gone"), "held")
    # two numbers of a row, never its arrays
    mean = index.stats.select("avgdl").scalar()
    slim = held.select("term", "block", "most_tf", "least_len")
    gain = F.greatest(F.col("w"), F.lit(0.0)) * _gain(F.col("most_tf"), F.col("least_len"), mean)
    bounds = written(slim.join(weighted, "term").groupBy("query_id", "block").agg(F.sum(gain).alias("bound"), F.first("margin").alias("margin")).where(F.col("bound") > 0), "bounds")

    tasks = int(index.blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def of(pairs: DataFrame) -> DataFrame:
        asked = pairs.join(weighted.select("query_id", "term", "w", "margin"), "query_id").groupBy("term", "block", part.alias("part")).agg(ask.alias("asks"))
        return _scored(index, held, asked, ["term", "block"], k)

    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    first = bounds.withColumn("_k", F.row_number().over(by_bound)).where(F.col("_k") <= FIRST)
    found = of(first.select("query_id", "block", F.lit(0.0).alias("cut"))).where(F.col("place").isNotNull())
    # a query has k rows and ties here for each of its first blocks
    kth = F.get(F.sort_array(F.collect_list("raw"), asc=False), k - 1)
    cut = F.greatest(F.coalesce("kth", F.lit(0.0)) - F.col("margin"), F.lit(0.0))
    limits = bounds.join(found.groupBy("query_id").agg(kth.alias("kth")), "query_id", "left").withColumn("cut", cut)
    # few bytes, but a row becomes one for each term of its query: in many files, so that no single task makes them all
    return of(written(limits.where(F.col("bound") >= F.col("cut")).select("query_id", "block", "cut").repartition(tasks, "block"), "limits"))


def _part(weighted: DataFrame) -> Column:
    """Queries of one task: about ``QUERIES``."""
    n = weighted.agg(F.ceil(F.count_distinct("query_id") / QUERIES)).scalar()
    return F.pmod(F.xxhash64("query_id"), F.greatest(n, F.lit(1)))


def _scored(index: Index, rows: DataFrame, asked: DataFrame, on: list[str], k: int) -> DataFrame:
    """The search of index rows with ``gone`` for ``asked (on..., part, asks)``: a task gets the rows of a block and what is asked of them."""
    # an empty array in place of a null: Spark's writer of Arrow batches goes over a run of null arrays again at each row
    rows = rows.select("term", "block", "places", "tfs", "lens", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    kind = asked.schema["asks"].dataType.elementType["query_id"].dataType.simpleString()
    work = rows.join(asked, on).withColumn("mean", index.stats.select("avgdl").scalar())
    work = work.select("block", "part", "places", "tfs", "lens", "gone", "mean", F.col("asks.query_id").alias("queries"), F.col("asks.w").alias("ws"), F.col("asks.cut").alias("cuts"), F.col("asks.margin").alias("margins"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return _score_block(table, key[0].as_py(), k)

    spark = index.blocks.sparkSession
    ship(spark)
    # a block is more work than its bytes tell, so partitions are not put together
    dealt = work.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block", "part")
    return dealt.groupBy("block", "part").applyInArrow(run, f"query_id {kind}, block bigint, place int, raw double, scored bigint")


def _score_block(table: pa.Table, block: int, k: int) -> pa.Table:
    column = lambda name: table[name].combine_chunks()
    values = lambda name: column(name).flatten().to_numpy()
    counts = column("places").value_lengths().to_numpy()
    at = np.append(0, np.cumsum(counts))
    places, f = values("places"), values("tfs").astype(np.float64)
    # of all rows at once: gains of chunks without the term's weight, and the greatest of each group of chunks
    gains = f * (K1 + 1) / (f + K1 * (1 - B + B * values("lens") / table["mean"][0].as_py()))
    n = int(places.max()) + 1
    n_groups = -(-n // GROUP)
    starts = np.flatnonzero(np.diff(np.repeat(np.arange(len(counts)) * n_groups, counts) + places // GROUP, prepend=-1))
    held, most = places[starts] // GROUP, np.maximum.reduceat(gains, starts)
    groups_at = np.searchsorted(starts, at)
    gone = table["gone"][0].as_py()  # the block's, in each of its rows
    dead = np.array([g for g in gone if g < n], np.int64)
    asks = column("queries")
    names = asks.flatten().dictionary_encode()
    code, w, cut, margin = names.indices.to_numpy(), values("ws"), values("cuts"), values("margins")
    term = np.repeat(np.arange(len(counts)), asks.value_lengths().to_numpy())
    order = np.argsort(code, kind="stable")
    edges = np.append(np.flatnonzero(np.diff(code[order], prepend=-1)), len(order))
    out: list[tuple[int, np.ndarray, np.ndarray, int]] = []
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        own = order[i:j]
        own_terms, weights = term[own], w[own]
        # the rows of the query's terms one after the other, so that a step is a few operations however many terms there are
        rows = [slice(at[t], at[t + 1]) for t in own_terms]
        own_groups = [slice(groups_at[t], groups_at[t + 1]) for t in own_terms]
        most_of = np.concatenate([most[x] for x in own_groups]) * np.repeat(np.maximum(weights, 0), groups_at[own_terms + 1] - groups_at[own_terms])
        bound = np.bincount(np.concatenate([held[x] for x in own_groups]), most_of, n_groups)
        place, gain = np.concatenate([places[x] for x in rows]), np.concatenate([gains[x] for x in rows]) * np.repeat(weights, counts[own_terms])
        group = place // GROUP
        scores, touched = np.zeros(n), np.zeros(n, bool)
        least, room = float(cut[own[0]]), float(margin[own[0]])
        by_bound, begin, step = np.argsort(-bound, kind="stable"), 0, k
        # groups by falling bound, a few at first, as many again each time, until no bound reaches the k-th best score
        while begin < n_groups and bound[by_bound[begin]] >= least and bound[by_bound[begin]] > 0:
            groups = np.zeros(n_groups, bool)
            some = by_bound[begin : begin + step]
            groups[some[bound[some] >= least]] = True
            here = groups[group]
            scores += np.bincount(place[here], gain[here], n)
            touched[place[here]] = True
            scores[dead] = 0
            if n > k:
                least = max(least, float(np.partition(scores, -k)[-k]) - room)
            begin, step = begin + step, 2 * step
        hits = np.flatnonzero((scores > 0) & (scores >= least))
        out.append((int(code[own[0]]), hits, scores[hits], int(touched.sum())))
    sizes = [len(h) for _, h, _, _ in out]
    who = pa.array(np.concatenate([np.repeat([c for c, *_ in out], sizes), [c for c, *_ in out]]).astype(np.int64))
    m, q = sum(sizes), len(out)
    return pa.table({
        "query_id": names.dictionary.take(who), "block": pa.array(np.full(m + q, block)), "place": pa.concat_arrays([pa.array(np.concatenate([h for _, h, _, _ in out]).astype(np.int32)), pa.nulls(q, pa.int32())]),
        "raw": pa.concat_arrays([pa.array(np.concatenate([s for _, _, s, _ in out])), pa.nulls(q, pa.float64())]), "scored": pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array([s for *_, s in out], pa.int64())])})
