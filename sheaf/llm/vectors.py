"""Vector code compression: codebooks for the parts of vectors, found by k-means over integers, searched by a VA-file.

Components become integers; a vector is cut into parts, and each part is coded by the number of the nearest entry of its position's
codebook. The search quantises every coordinate of the entries to a cell of ``CELL_BITS`` bits, so an entry is a short row of cell
numbers. For each query and dimension a table holds the least and the greatest squared distance to each cell; summed up by an
entry's cells they bound its distance from below and above. Entries whose lower bound is above the least upper bound of all are left out, the
others are compared by their integer distances. Nothing is rounded: bounds and distances are integers.

A round is one pass over the vectors that returns counts and sums of each entry's parts, added up before the shuffle: what
reaches the driver is a row an entry, whatever the number of vectors. Codebooks that do not change any more end the rounds, as
further ones would repeat them.

Defined results: vectors that are null, or hold a null, a NaN or an infinity, are dropped; a null label is a label of its own; null ids are coded, and
are entries to begin with only where fewer ids than entries are known; repeated ids are rows of their own (equal ids begin in the
order of their vectors); with fewer vectors than entries there are as many entries as vectors; an empty table gives an empty result. Vectors must have one length that the
parts divide, else an error is raised. Integers of any size are exact (large ones go through Python's integers, more slowly); an error that
no long holds is null. Only the named columns are read.
"""

from __future__ import annotations

import decimal
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
CELL_BITS = 3
#: Squared differences of integers below this, summed over up to 64 dimensions, fit into 64 bits.
_PLAIN = 1 << 27
#: Rows of a search at once.
_SLICE = 8192
#: Label sums that may be sent to all executors (about 100 bytes each).
_BROADCAST_LABELS = 100_000


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & finite


def quantised(flat: np.ndarray, width: int, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)``, a vector a row: 64-bit integers, or Python's where those would not do for squared distances."""
    with np.errstate(over="ignore"):
        floors = np.floor(flat.astype(np.float64) * scale).reshape(-1, width)
    if not floors.size or np.abs(floors).max() < _PLAIN:
        return floors.astype(np.int64)
    exact = [int(x) if np.isfinite(x) else int(decimal.Decimal(float(y)) * scale // 1) for x, y in zip(floors.ravel(), flat.astype(np.float64), strict=True)]
    return np.array(exact, object).reshape(floors.shape)


class VaFile:
    """Cells of a codebook's coordinates: ``cells`` (entry x dimension), ``least`` and ``most`` (dimension x cell): the coordinates that a cell holds lie between them."""

    def __init__(self, book: np.ndarray, bits: int = CELL_BITS):
        n, dims = book.shape
        self.book = book
        size = -(-n // (1 << bits))  # coordinates of a cell, by rank in their dimension
        ranks = np.argsort(np.argsort(book, axis=0, kind="stable"), axis=0, kind="stable")
        self.cells = ranks // size
        self.count = -(-n // size)
        order = np.sort(book, axis=0)
        self.least = np.array([order[c * size] for c in range(self.count)]).reshape(self.count, dims).T
        self.most = np.array([order[min((c + 1) * size, n) - 1] for c in range(self.count)]).reshape(self.count, dims).T

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number (the lower one of equals) and squared distance of the nearest entry of each query, and how many entries were compared."""
        n, dims = queries.shape
        low = np.zeros((n, len(self.book)), queries.dtype)
        high = np.zeros_like(low)
        for d in range(dims):
            x = queries[:, d, None]
            under, over = self.least[d] - x, x - self.most[d]
            gap = np.maximum(np.maximum(under, over), 0)
            reach = np.maximum(np.abs(under), np.abs(over))
            at = self.cells[:, d]
            low += (gap * gap)[:, at]
            high += (reach * reach)[:, at]
        row, entry = np.nonzero(low <= high.min(axis=1)[:, None])
        step = queries[row] - self.book[entry]
        distance = (step * step).sum(axis=1)
        # candidates stand row by row, entries ascending
        starts = np.searchsorted(row, np.arange(n))
        best = np.minimum.reduceat(distance, starts) if n else distance
        hit = np.flatnonzero(distance == best[row])
        first = hit[np.searchsorted(row[hit], np.arange(n))] if n else hit
        return entry[first], best, len(row)


@dataclass(frozen=True)
class Codebooks:
    """``books``: an array of entries x width for each part."""

    books: tuple[np.ndarray, ...]

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for book in self.books for x in book.ravel()).encode()).hexdigest()

    def search(self) -> list[VaFile]:
        """One for each part, numbers of Python where 64 bits would not do."""
        plain = all(int(np.abs(b).max(initial=0)) < _PLAIN for b in self.books)
        return [VaFile(b.astype(np.int64 if plain else object)) for b in self.books]


def _assign(files: list[VaFile], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries and squared distances, vector x part."""
    width = vectors.shape[1] // len(files)
    numbers, distances = [], []
    for p, file in enumerate(files):
        part = vectors[:, p * width : (p + 1) * width]
        if file.book.dtype == object:
            part = part.astype(object)
        elif part.dtype == object:
            file = VaFile(file.book.astype(object))  # noqa: PLW2901
        done = [file.nearest(part[i : i + _SLICE]) for i in range(0, len(part), _SLICE)] or [file.nearest(part)]
        numbers.append(np.concatenate([n for n, _, _ in done]))
        distances.append(np.concatenate([d for _, d, _ in done]))
    return np.stack(numbers, axis=1), np.stack(distances, axis=1)


def _rows(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != width * len(column) or (len(column) and set(np.diff(column.offsets.to_numpy())) != {width}):
        raise ValueError(f"vectors must have {width} components")
    return quantised(flat, width)


def fit(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of usable vectors: the first ones by id, then ``rounds`` means. Nothing if there is no vector."""
    bounded_batches(vectors.sparkSession)
    seeds = vectors.orderBy(F.asc_nulls_last(id_col), vec_col).select(vec_col).limit(entries).collect()
    if not seeds:
        return None
    width = len(seeds[0][0])
    if width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} parts")
    if any(len(s[0]) != width for s in seeds):
        raise ValueError(f"vectors must have {width} components")
    first = quantised(np.array([x for s in seeds for x in s[0]], np.float64), width)
    step = width // parts
    books = Codebooks(tuple(first[:, p * step : (p + 1) * step] for p in range(parts)))
    for _ in range(rounds):
        files = books.search()

        def sums(batches, files=files):
            total: dict[tuple[int, int], list] = {}
            for b in batches:
                x = _rows(b.column(0), width)
                numbers, _ = _assign(files, x)
                for p in range(parts):
                    part = x[:, p * step : (p + 1) * step]
                    for e in np.unique(numbers[:, p]):
                        own = part[numbers[:, p] == e]
                        held = total.setdefault((p, int(e)), [0] * (step + 1))
                        for i, v in enumerate((len(own), *own.sum(axis=0))):
                            held[i] += int(v)
            if total:
                keys = list(total)
                yield pa.RecordBatch.from_arrays([
                    pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k][0] for k in keys], pa.int64()),
                    pa.array([[decimal.Decimal(v) for v in total[k][1:]] for k in keys], pa.list_(pa.decimal128(38))),
                ], ["part", "entry", "n", "sums"])

        found = vectors.select(vec_col).mapInArrow(sums, "part int, entry int, n bigint, sums array<decimal(38,0)>").groupBy("part", "entry").agg(
            F.sum("n").alias("n"), *(F.sum(F.get("sums", i)).cast("decimal(38,0)").alias(f"s{i}") for i in range(step)))
        fresh = [b.astype(object) for b in books.books]
        for r in found.collect():  # a row an entry
            fresh[r.part][r.entry] = [int(r[f"s{i}"]) // r.n for i in range(step)]
        after = Codebooks(tuple(fresh))
        if after.sha256 == books.sha256:
            break
        books = after
    return books


def coded(vectors: DataFrame, books: Codebooks, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id, label, code, error``: two hex digits a part, and the squared distances summed up."""
    bounded_batches(vectors.sparkSession)
    kinds = dict(vectors.dtypes)
    files = books.search()
    width = sum(b.shape[1] for b in books.books)

    def run(batches):
        for b in batches:
            numbers, distances = _assign(files, _rows(b.column(2), width))
            errors = distances.sum(axis=1)
            if errors.dtype == object:
                errors = [int(e) if e < 1 << 63 else None for e in errors]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(["".join(f"{e:02x}" for e in row) for row in numbers.tolist()], pa.string()), pa.array(errors, pa.int64())], ["id", "label", "code", "error"])

    return vectors.select(id_col, label_col, vec_col).mapInArrow(run, f"id {kinds[id_col]}, label {kinds[label_col]}, code string, error bigint")


def decoded(codes: Column, books: Codebooks, scale: int = SCALE) -> Column:
    """The vector that a code stands for: its entries' components, divided by the scale again."""
    step = len(books.books[0][0]) if len(books.books[0]) else 0
    table = F.array(*(F.array(*(F.array(*(F.lit(float(x) / scale) for x in entry)) for entry in book)) for book in books.books))
    parts = F.sequence(F.lit(0), F.lit(len(books.books) - 1))
    number = lambda p: F.conv(F.substring(codes, p * 2 + 1, 2), 16, 10).cast("int")
    return F.flatten(F.transform(parts, lambda p: F.get(F.get(table, p), number(p)))) if step else F.array().cast("array<double>")


def with_label_errors(rows: DataFrame) -> DataFrame:
    """``label_error``: errors summed over equal labels, nulls together (null beyond a long). Sums are made before the shuffle; they go to all executors while they are few, by a join otherwise."""
    rows = materialize(rows, "codes")
    total = rows.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error"))
    total = materialize(total, "label-errors")
    if total.count() <= _BROADCAST_LABELS:
        total = F.broadcast(total)
    return rows.join(total, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").where(usable(F.col("embedding")))
    books = fit(held)
    if books is None:
        return held.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    return with_label_errors(coded(held, books)).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
