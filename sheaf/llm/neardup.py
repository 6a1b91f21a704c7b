"""Prefix-tree join of n-gram sets by Jaccard similarity, and the groups it links.

A text's set holds hashes of its distinct five-word shingles (fewer words: the sequence as one). Sets are kept once each
and stand in one global order: shingles from crowded buckets of a count sketch over all documents last. By the prefix
principle two sets of similarity ``t`` share one of their first ``n - ceil(t n) + 1`` shingles. Shingles from ordinary
buckets bring their sets together in bounded groups, whose pairs must pass a length bound and the bound that parity
bitmaps put on their difference. Shingles from crowded buckets are never expanded into pairs: a forest that spans the pairs within
those bounds stands for them. What hangs together is a block; nothing links across blocks. Blocks are cut into cells of bounded size (pairs of
sub-blocks of neighbouring length classes), and in each cell a trie of the sets, commonest shingle first, is walked
once for all sets of the other side: overlaps of a shared path are added once, and a subtree is left when
the remaining lengths cannot reach the similarity for any of them. Exact on shingle hashes of 64 bits; sets are told apart by 128 bits:
candidates are named by 64 of them, and where unequal sets share a name each is compared as a set of its own.

Defined results: a null, empty or wordless text has the empty set and is linked with nothing; equal sets are linked with
each other; a component is named by its least non-null document id, or has none if all are null; rows that repeat id
and text share their result; of a group, ``deduplicate`` keeps one row (its least id, nulls last, then the least text hash); texts of any length are taken whole; other columns are not read by ``join`` and are
carried untouched by ``deduplicate``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, documents, materialize, scratch
from .components import connected_components
from .hashing import mix, range_hashes

NGRAM = 5
SIMILARITY = 80
SKETCH_BITS = 20
SKETCH_BLOCK = 1 << 14
BITMAP_BITS = 1024
GROUP = 4
CROWD = 2048
CELL_SHINGLES = 1 << 16


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams of words; ASCII capitals are lowered."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(b" ".join(words), np.uint8)
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.append(gaps, len(raw))
    k = min(NGRAM, len(starts))
    found = range_hashes(raw, starts[: len(starts) - k + 1], ends[k - 1 :])
    found.sort()
    return found[np.concatenate(([True], found[1:] != found[:-1]))]


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two longs; the first is 0 for the empty set only."""
    if not len(s):
        return 0, 0
    with np.errstate(over="ignore"):
        x = mix((s * np.uint64(0x9E3779B97F4A7C15)).sum(keepdims=True) + mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum() + np.uint64(len(s)))
        y = mix(mix(s * np.uint64(0xD1342543DE82EF95) + np.uint64(0x2545F4914F6CDD1D)).sum(keepdims=True) ^ np.uint64(len(s)))
    return int(x.view(np.int64)[0]) or 1, int(y.view(np.int64)[0])


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parities of the set's hashes over a power of two of bits, at least its size, by their low bits (so halves fold onto each other)."""
    bits = max(BITMAP_BITS, 1 << (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(np.int64)


def differing_bits(a: Column, b: Column) -> Column:
    """Parities in which two bitmaps differ; of sizes one step apart (similar sets are at most that), the larger is folded first."""
    xor = lambda x, y: x.bitwiseXOR(y)

    def fold(x: Column, n: Column) -> Column:
        return F.when(F.size(x) > n, F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), xor)).otherwise(x)

    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(fold(a, n), fold(b, n), xor), F.lit(0), lambda s, x: s + F.bit_count(x))


def bucket_of(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def needed(n, similarity: int):
    """The least overlap of a set of ``n`` with a similar one."""
    return -(-similarity * n // 100)


class Order:
    """The global order: class of the bucket (0: not above ~1.3 times the median), then hash."""

    def __init__(self, counts: np.ndarray):
        filled = counts[counts > 0]
        usual = 1.3 * max(float(np.median(filled)) if len(filled) else 1.0, 8.0)
        self.classes = np.where(counts > usual, np.floor(2 * np.log2(np.maximum(counts, 1) / usual)) + 1, 0).astype(np.uint8)

    def __call__(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The set in order, with classes."""
        c = self.classes[bucket_of(s)]
        at = np.argsort(c, kind="stable")
        return s[at], c[at]


def _read_sets(df: DataFrame) -> DataFrame:
    """``kind, id, h, n, key, key2, bits`` of rows (kind 0); a task's count sketch in blocks (kind 1: ``key`` block, ``counts`` 32-bit counts)."""
    names = ["kind", "id", "h", "n", "key", "key2", "bits", "counts"]

    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.int32)
        for b in batches:
            sets = [shingles(t) for t in b.column(2).to_pylist()]
            if sets:
                at, n = np.unique(bucket_of(np.concatenate(sets)), return_counts=True)
                sketch[at] += n.astype(np.int32)
            keys = [set_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(sets), np.int8)), b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64()),
                 pa.array([bitmap(s) if len(s) else None for s in sets], pa.list_(pa.int64())), pa.nulls(len(sets), pa.binary())],
                names)
        blocks = sketch.reshape(-1, SKETCH_BLOCK)
        at = np.flatnonzero(blocks.any(axis=1))
        nothing = lambda t: pa.nulls(len(at), t)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(at), np.int8)), nothing(pa.int64()), nothing(pa.int64()), nothing(pa.int64()), pa.array(at), nothing(pa.int64()), nothing(pa.list_(pa.int64())), pa.array([blocks[i].astype("<i4").tobytes() for i in at], pa.binary())],
            names)

    return df.mapInArrow(run, "kind tinyint, id bigint, h bigint, n bigint, key bigint, key2 bigint, bits array<bigint>, counts binary")


def _sketch(read: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches: ``2^SKETCH_BITS`` numbers, whatever the input. A block's sketches are added up a bounded share at a time."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH_BLOCK, np.int64)
        for x in table["counts"]:
            total += np.frombuffer(x.as_py(), "<i4")
        return pa.table({"key": table["key"][:1], "counts": pa.array([np.minimum(total, 2**31 - 1).astype("<i4").tobytes()], pa.binary())})

    blobs = read.where("kind = 1").select("key", "counts")
    part = blobs.groupBy("key", F.pmod(F.xxhash64("counts"), F.lit(64)).alias("share")).applyInArrow(add, "key bigint, counts binary")
    found = part.groupBy("key").applyInArrow(add, "key bigint, counts binary").toArrow()
    counts = np.zeros((1 << SKETCH_BITS) // SKETCH_BLOCK * SKETCH_BLOCK, np.int64)
    for key, blob in zip(found["key"].to_pylist(), found["counts"].to_pylist(), strict=True):
        counts[key * SKETCH_BLOCK : (key + 1) * SKETCH_BLOCK] = np.frombuffer(blob, "<i4")
    return counts


def _prefixes(texts: DataFrame, order: Order, similarity: int) -> DataFrame:
    """``shingle, key, n, crowded`` of every set's prefix; a task names an equal set once a batch."""

    def run(batches):
        for b in batches:
            tokens, keys, sizes, hot, seen = [], [], [], [], set()
            for t in b.column(0).to_pylist():
                s = shingles(t)
                if not len(s) or (both := set_key(s)) in seen:
                    continue
                seen.add(both)
                key, n = both[0], len(s)
                p = n - needed(n, similarity) + 1
                s, c = order(s)
                tokens.append(s[:p])
                hot.append(c[:p] > 0)
                keys.append(np.full(p, key, np.int64))
                sizes.append(np.full(p, n, np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(hot))],
                    ["shingle", "key", "n", "crowded"])

    return texts.mapInArrow(run, "shingle bigint, key bigint, n int, crowded boolean")


def group_pairs(token: np.ndarray, key: np.ndarray, n: np.ndarray, similarity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of sets that share a token and whose lengths fit; name and sets of groups above ``GROUP``, which are not expanded here.

    A larger group is named by its members, so that tokens with the same sets make one group.
    """
    at = np.lexsort((key, token))
    token, key, n = token[at], key[at], n[at]
    fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (key[1:] != key[:-1])))
    token, key, n = token[fresh], key[fresh], n[fresh]
    first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    count = np.diff(np.append(first, len(token)))
    large = np.repeat(count > GROUP, count)
    names = np.repeat(np.add.reduceat(mix(key.view(np.uint64)), first), count)[large].view(np.int64) if len(key) else np.zeros(0, np.int64)
    members = key[large]
    at = np.lexsort((members, names))
    names, members = names[at], members[at]
    fresh = np.concatenate(([True], (names[1:] != names[:-1]) | (members[1:] != members[:-1]))) if len(at) else np.zeros(0, bool)
    names, members = names[fresh], members[fresh]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for c in np.unique(count[(count > 1) & (count <= GROUP)]):
        begin = first[count == c]
        i, j = np.triu_indices(c, 1)
        step = max(1, (1 << 20) // len(i))
        for k in range(0, len(begin), step):
            a, b = (begin[k : k + step, None] + i).ravel(), (begin[k : k + step, None] + j).ravel()
            fits = 100 * np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b])
            left.append(key[a[fits]])
            right.append(key[b[fits]])
    left, right = np.concatenate(left), np.concatenate(right)
    at = np.lexsort((right, left))
    left, right = left[at], right[at]
    fresh = np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1]))) if len(left) else np.zeros(0, bool)
    return left[fresh], right[fresh], names, members


PAIR, CROWDED = range(2)


def _candidates(prefixes: DataFrame, similarity: int) -> DataFrame:
    """``kind, a, b``: pairs of sets with an ordinary shingle in common, and crowded shingles with their sets, dealt evenly.

    A bucket's count bounds an ordinary group; one above ``GROUP`` joins the crowded ones.
    """

    def rows(kind, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b)], ["kind", "a", "b"])

    def run(batches):
        held = []
        for x in batches:
            hot = x["crowded"].to_numpy(zero_copy_only=False)
            if hot.any():
                yield rows(CROWDED, x["shingle"].to_numpy()[hot], x["key"].to_numpy()[hot])
            held.append(x.filter(pa.array(~hot)).select(["shingle", "key", "n"]))
        if held:
            t = pa.Table.from_batches(held)
            a, b, name, key = group_pairs(t["shingle"].to_numpy(), t["key"].to_numpy(), t["n"].to_numpy(), similarity)
            yield rows(PAIR, a, b)
            yield rows(CROWDED, name, key)

    at = F.when(F.col("crowded"), F.xxhash64("shingle", "key")).otherwise(F.col("shingle"))
    return prefixes.repartition(at).mapInArrow(run, "kind tinyint, a bigint, b bigint")


def spanning_links(keys: np.ndarray, n: np.ndarray, bits: list[np.ndarray], similarity: int) -> tuple[list[int], list[int]]:
    """A forest that spans the graph of pairs within the length and bitmap bounds: each set is compared with those not reached yet."""
    size = np.array([len(x) for x in bits])
    shelves = {}
    for s in np.unique(size):
        at = np.flatnonzero(size == s)
        m = np.stack([bits[i] for i in at])
        shelves[int(s)] = [at, m, m[:, : s // 2] ^ m[:, s // 2 :] if s > 1 else None]
    waiting = np.ones(len(keys), bool)
    a, b = [], []
    for root in range(len(keys)):
        if not waiting[root]:
            continue
        waiting[root] = False
        queue = [root]
        while queue:
            v = queue.pop()
            s, mine = int(size[v]), bits[v]
            halves = mine[: s // 2] ^ mine[s // 2 :]
            for other, me, folded in ((s, mine, False), (2 * s, mine, True), (s // 2, halves, False)):
                shelf = shelves.get(other)
                if shelf is None:
                    continue
                open_ = waiting[shelf[0]]
                at = shelf[0][open_]
                if not len(at):
                    continue
                differ = np.bitwise_count(((shelf[2] if folded else shelf[1])[open_] ^ me).view(np.uint64)).sum(axis=1, dtype=np.int64)
                ok = (100 * np.minimum(n[at], n[v]) >= similarity * np.maximum(n[at], n[v])) & ((100 + similarity) * differ <= (100 - similarity) * (n[at] + n[v]))
                found = at[ok]
                waiting[found] = False
                a += [int(keys[v])] * len(found)
                b += keys[found].tolist()
                queue += found.tolist()
    return a, b


def _crowded_links(rows: DataFrame, reps: DataFrame, similarity: int) -> DataFrame:
    """Links that hold together what may be similar among the sets of each crowded shingle; never a shingle's pairs. Groups above ``CROWD`` sets are dealt into cells of two sub-groups."""
    rows = rows.select(F.col("a").alias("shingle"), F.col("b").alias("key")).distinct()
    sizes = rows.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1").select("shingle", F.ceil(F.col("c") / CROWD).cast("int").alias("s"))
    dealt = rows.join(sizes, "shingle").join(reps.select("key", "n", "bits"), "key").withColumn("sub", F.pmod(F.xxhash64("key", F.lit("crowd")), F.col("s")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda i: F.struct(F.least(i, "sub").alias("x"), F.greatest(i, "sub").alias("y")))

    dealt = dealt.select("shingle", "key", "n", "bits", F.explode(cells).alias("at")).select("shingle", "at.x", "at.y", "key", "n", "bits").repartition("shingle", "x", "y").sortWithinPartitions("shingle", "x", "y")

    def links(t: pa.Table, cuts: list[int]) -> pa.RecordBatch:
        keys, n = t["key"].to_numpy(), t["n"].to_numpy()
        held = t["bits"].combine_chunks()
        values, at = held.values.to_numpy(), held.offsets.to_numpy()
        a, b = [], []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if j - i > 1:
                x, y = spanning_links(keys[i:j], n[i:j], [values[at[k] : at[k + 1]] for k in range(i, j)], similarity)
                a += x
                b += y
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches):
        held = None
        for x in batches:
            t = pa.Table.from_batches([x])
            t = pa.concat_tables([held, t]) if held is not None else t
            ids = np.stack([t["shingle"].to_numpy(), t["x"].to_numpy().astype(np.int64), t["y"].to_numpy().astype(np.int64)])
            cuts = (np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist()
            if cuts:  # the last group may go on in the next batch
                yield links(t.slice(0, cuts[-1]), [0, *cuts])
                t = t.slice(cuts[-1])
            held = t
        if held is not None and held.num_rows:
            yield links(held, [0, held.num_rows])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def trie_join(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: int) -> list[tuple[int, int]]:
    """Linked pairs of two lists of sets (given commonest first), or inside one list.

    The left sets in lexicographic order, with the lengths they share with their forerunner, are the trie. Its walk carries
    the overlaps of every path with all right sets at once.
    """
    own = right is None
    queries = left if own else right
    values, flat = np.unique(np.concatenate([*left, *queries]), return_inverse=True)
    sizes = [len(s) for s in left] + ([len(s) for s in queries])
    cuts = np.cumsum([0, *sizes])
    ids = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    tree, probes = ids[: len(left)], ids[len(left) :]
    holds = np.zeros((len(values), len(probes)), np.uint8)
    for j, p in enumerate(probes):
        holds[p, j] = 1
    nq = np.array([len(p) for p in probes], np.int64)
    order = sorted(range(len(tree)), key=lambda i: tree[i].tolist())
    shared = [0] * len(order)
    for k in range(1, len(order)):
        a, b = tree[order[k - 1]], tree[order[k]]
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        shared[k] = int(differ[0]) if len(differ) else m
    # what a path can still gain over what it must reach grows with a set's length, so the longest set bounds every subtree
    longest = max((len(t) for t in tree), default=0)
    factor = similarity / (100 + similarity)
    out = []
    stack = [(0, np.zeros(len(probes), np.int64))]  # (depth, overlaps there), ascending
    dead = None  # depth at which the path at hand was left
    for k, i in enumerate(order):
        path, depth = tree[i], shared[k]
        if dead is not None and depth >= dead:
            continue
        dead = None
        while stack[-1][0] > depth:
            stack.pop()
        at, overlap = stack[-1]
        # branch points of the sets that follow are where their overlaps are picked up again
        stops, low = [], len(path)
        for d in shared[k + 1 :]:
            low = min(low, d)
            if low <= at:
                break
            stops.append(low)
        for stop in [*sorted(set(stops)), len(path)]:
            while at < stop:
                end = min(stop, at + 512)
                overlap = overlap + holds[path[at:end]].sum(axis=0, dtype=np.int64)
                at = end
                if (overlap + (longest - at) < factor * (nq + longest) - 1e-9).all():
                    dead = at
                    break
            if dead is not None:
                break
            if at in stops and stack[-1][0] < at:
                stack.append((at, overlap))
        if dead is not None:
            continue
        hit = np.flatnonzero(100 * overlap >= similarity * (nq + len(path) - overlap))
        out += [(i, j) for j in hit.tolist() if not own or j > i]
    return out


def _cells(blocks: DataFrame, reps: DataFrame) -> DataFrame:
    """Every set of a block with the cells it goes to: ``key, n, m, cell`` fields. Cells join a sub-block with itself, with one of its length class, or of the next."""
    rows = blocks.join(reps.select("key", "name", "n", "m", "h", "id"), "key").drop("key").withColumnRenamed("name", "key").withColumn("c", F.floor(F.log2("n")).cast("int"))
    per = rows.groupBy("block", "c").agg(F.count("*").alias("k"), F.sum("n").alias("total"))
    per = per.withColumn("s", F.greatest(F.ceil(F.col("total") / CELL_SHINGLES), F.ceil(F.col("k") / 256)).cast("int"))
    shift = lambda by, name: per.select("block", (F.col("c") + by).alias("c"), F.col("s").alias(name))
    return (
        rows.join(per.select("block", "c", "s"), ["block", "c"])
        .join(shift(-1, "above"), ["block", "c"], "left").join(shift(1, "below"), ["block", "c"], "left")
        .withColumn("sub", F.pmod(F.xxhash64("key", F.lit("sub")), F.col("s")).cast("int"))
        .select("block", "key", "n", "m", "h", "id", "c", "sub", "s", F.coalesce("above", F.lit(0)).alias("above"), F.coalesce("below", F.lit(0)).alias("below"))
    )


def _fetch_sets(df: DataFrame, wanted: DataFrame, order: Order) -> DataFrame:
    """Sets of the wanted documents, commonest shingle first, as bytes."""
    kinds = {f.name: f.dataType.simpleString() for f in wanted.schema if f.name not in ("h", "id")}
    names = list(kinds)
    # The id is compared null-safely, the text's hash carries the join; wanted rows are slim, so texts need no sort.
    texts = df.select(F.col("id").alias("_id"), F.col("h").alias("_h"), "text")
    joined = texts.join(wanted.hint("shuffle_hash"), (F.col("_h") == F.col("h")) & F.col("_id").eqNullSafe(F.col("id"))).select("text", *names)

    def run(batches):
        for b in batches:
            sets = []
            for t in b.column(0).to_pylist():
                s, _ = order(shingles(t))
                sets.append(s[::-1].tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(sets, pa.binary())], [*names, "set"])

    return joined.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", set binary")


def _join_cells(sets: DataFrame, similarity: int) -> DataFrame:
    """``a, b, n``: links that span a cell's groups, and (``b`` null) how many documents each set links to in the cell."""
    c, sub = F.col("c"), F.col("sub")
    cell = lambda c1, s1, c2, s2, side: F.struct(c1.alias("c1"), s1.alias("s1"), c2.alias("c2"), s2.alias("s2"), F.lit(side).alias("side"))
    span = lambda n: F.filter(F.sequence(F.lit(-1), n - 1), lambda i: i >= 0)
    cells = F.concat(
        F.transform(F.filter(span(F.col("s")), lambda i: i >= sub), lambda i: cell(c, sub, c, i, 0)),
        F.transform(F.filter(span(F.col("s")), lambda i: i < sub), lambda i: cell(c, i, c, sub, 1)),
        F.transform(span(F.col("above")), lambda i: cell(c, sub, c + 1, i, 0)),
        F.transform(span(F.col("below")), lambda i: cell(c - 1, i, c, sub, 1)),
    )
    dealt = sets.select("block", "key", "m", "set", F.explode(cells).alias("x")).select("block", "key", "m", "set", "x.*")

    def run(table: pa.Table) -> pa.Table:
        # rows that repeat id and text come with the same set
        table = table.take(pa.array(np.unique(np.stack([table["side"].to_numpy(), table["key"].to_numpy()]), axis=1, return_index=True)[1]))
        side = table["side"].to_numpy()
        keys, weights = table["key"].to_numpy(), table["m"].to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table["set"]]
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        own = table["c1"][0].as_py() == table["c2"][0].as_py() and table["s1"][0].as_py() == table["s2"][0].as_py()
        if len(first) < 1 + own or not own and not len(second):
            found = []
        elif own:
            found = [(first[i], first[j]) for i, j in trie_join([sets[i] for i in first], None, similarity)]
        else:
            found = [(first[i], second[j]) for i, j in trie_join([sets[i] for i in first], [sets[j] for j in second], similarity)]
        root = list(range(len(keys)))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        degree = np.zeros(len(keys), np.int64)
        a, b = [], []
        for i, j in found:
            degree[i] += weights[j]
            degree[j] += weights[i]
            if (p := find(i)) != (q := find(j)):
                root[p] = q
                a.append(int(keys[i]))
                b.append(int(keys[j]))
        some = np.flatnonzero(degree)
        return pa.table({
            "a": pa.array([*a, *keys[some].tolist()], pa.int64()),
            "b": pa.array([*b, *[None] * len(some)], pa.int64()),
            "n": pa.array([*[0] * len(a), *degree[some].tolist()], pa.int64()),
        })

    return dealt.groupBy("block", "c1", "s1", "c2", "s2").applyInArrow(run, "a bigint, b bigint, n bigint")


def representatives(rows: DataFrame) -> DataFrame:
    """One document for each set: the least id (a null one only alone), then the least text hash. ``name`` is the set's key, or, where unequal sets share it, a name of its own for all but one."""
    reps = materialize(
        rows.where("n > 0").groupBy("key", "key2").agg(
            F.min(F.struct(F.col("id").isNull().alias("null"), "id", "h")).alias("r"), F.count("*").alias("m"), F.first("n").alias("n"), F.first("bits").alias("bits"))
        .select("key", "key2", "m", "n", "bits", F.col("r.id").alias("id"), F.col("r.h").alias("h")),
        "representatives")
    shared = materialize(reps.groupBy("key").agg(F.count("*").alias("c"), F.min("key2").alias("_first")).where("c > 1").select("key", "_first"), "shared-names")
    if shared.isEmpty():
        return reps.withColumn("name", F.col("key"))
    other = F.col("_first").isNotNull() & (F.col("key2") != F.col("_first"))
    return reps.join(shared, "key", "left").withColumn("name", F.when(other, F.xxhash64("key", "key2")).otherwise(F.col("key"))).drop("_first")


def join(df: DataFrame, similarity: int = SIMILARITY, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, h, n_shingles, component_id, n_links, group, first`` of every row.

    ``h`` is the text's hash, links count other documents, ``group`` names the component (null for an empty set, which is alone) and
    ``first`` marks the rows of the one document that stands for it.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    read = materialize(_read_sets(texts), "sets")
    rows = read.where("kind = 0").drop("kind", "counts")
    order = Order(_sketch(read))
    reps = representatives(rows)
    prefixes = _prefixes(texts.select("text"), order, similarity)
    candidates = materialize(_candidates(prefixes, similarity), "candidates")
    pairs = candidates.where(F.col("kind") == PAIR).select("a", "b").distinct()
    side = lambda x: reps.select(F.col("key").alias(x), F.col("bits").alias(f"{x}_bits"), F.col("n").alias(f"{x}_n"))
    # |x - y| + |y - x| <= (|x| + |y|) (1 - t) / (1 + t), and differing parities are fewer still
    may = (100 + similarity) * differing_bits(F.col("a_bits"), F.col("b_bits")) <= (100 - similarity) * (F.col("a_n") + F.col("b_n"))
    likely = pairs.join(side("a"), "a").join(side("b"), "b").where(may).select("a", "b")
    crowded = _crowded_links(candidates.where(F.col("kind") == CROWDED), reps, similarity)
    # unequal sets of one name are candidates for each other, too
    shared = reps.where("name != key").select(F.col("key").alias("a"), F.col("name").alias("b"))
    blocks = connected_components(likely.unionByName(crowded).unionByName(shared)).select(F.col("node").alias("key"), F.col("component").alias("block"))
    wanted = materialize(_cells(blocks, reps), "cells")
    links = materialize(_join_cells(_fetch_sets(texts, wanted, order), similarity), "similar")
    groups = connected_components(links.where("b is not null").select("a", "b")).select(F.col("node").alias("name"), "component")
    degree = links.where("b is null").groupBy(F.col("a").alias("name")).agg(F.sum("n").alias("linked"))
    named = reps.join(groups, "name", "left").withColumn("component", F.coalesce("component", "name"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"), F.min(F.struct(F.col("id").isNull().alias("null"), "id", "h")).alias("keeper"))
    of_set = named.join(least, "component").join(degree, "name", "left").select(
        "key", "key2", "component_id", "component", F.col("keeper.id").alias("keeper_id"), F.col("keeper.h").alias("keeper_h"), (F.col("m") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    first = F.col("id").eqNullSafe(F.col("keeper_id")) & (F.col("h") == F.col("keeper_h"))
    full = rows.where("n > 0").select("id", "h", "n", "key", "key2").join(of_set, ["key", "key2"]).select("id", "h", "n", "component_id", "n_links", F.col("component").alias("group"), first.alias("first"))
    lone = rows.where("n = 0").select("id", "h", "n", F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("group"), F.lit(True).alias("first"))
    return full.unionByName(lone).select(F.col("id").alias(id_col), "h", F.col("n").alias("n_shingles"), "component_id", "n_links", "group", "first")


def groups(df: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """``id, h, group`` of every document that has a set, once each; what it took to find them is removed."""
    with scratch(df.sparkSession):
        found = join(df, similarity).where(F.col("group").isNotNull())
        return materialize(found.select(F.col("doc_id").alias("id"), "h", "group").distinct(), "groups", keep=True)


def deduplicate(df: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Documents, one row of each group, with the input's columns. Documents without a word all stay."""
    with scratch(df.sparkSession):
        found = join(df, similarity).where("n_shingles > 0").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "first")
        counted = materialize(found.groupBy("_id", "_h", "first").agg(F.count("*").alias("_n")).where("NOT first OR _n > 1"), "removed", keep=True)
    same = (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("_h")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
    left = df.join(counted.select("_id", "_h"), same, "left_anti")
    again = counted.where("first").select("_id", "_h")
    if again.isEmpty():
        return left
    one = df.select(F.struct("*").alias("row"), "doc_id", "text").join(again, same).groupBy("_id", "_h").agg(F.first("row").alias("row"))
    return left.unionByName(one.select("row.*"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "n_links")
