"""Codebooks and codes against plain k-means over Python's integers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from sheaf.llm import vectors
from sheaf.llm.vectors import VaFile

SCHEMA = "vec_id long, embedding array<double>, label int"


def naive(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(Fraction(x) * 4096) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((dist(x, e), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(c[p], books[p])[1] for c in cut]
            for j in range(len(books[p])):
                mine = [c[p] for c, k in zip(cut, own, strict=True) if k == j]
                if mine:
                    books[p][j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    label = {}
    for (_, _, y), e in zip(kept, errors, strict=True):
        label[y] = label.get(y, 0) + e
    return sorted(((i, "".join(f"{j:02x}" for _, j in f), e, label[y], sha) for (i, _, y), f, e in zip(kept, found, errors, strict=True)), key=repr)


def coded(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).where(vectors.usable(vectors.F.col("embedding")))
    books = vectors.fit(df)
    if books is None:
        return []
    out = vectors.with_label_errors(vectors.coded(df, books))
    return sorted(((r.id, r.code, r.error, r.label_error, books.sha256) for r in out.collect()), key=repr)


def sample(n, width, seed, scale=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, scale) for _ in range(width)], rng.choice((None, 1, 2))) for i in range(n)]


def test_equal_to_plain_k_means(spark):
    rows = sample(260, 16, 1)
    rows += [(1000 + i, rows[3][1], 1) for i in range(120)]  # a vector that many share
    odd = [(2000, None, 1), (2001, [None] + [0.0] * 15, 1), (2002, [math.nan] * 16, 2), (2003, [math.inf] + [0.0] * 15, 2), (-5, [-0.00001] * 16, 7), (7, rows[7][1], None)]
    assert coded(spark, rows + odd) == naive(rows + odd)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_entries(spark, n):
    rows = sample(n, 8, 2)
    assert coded(spark, rows) == naive(rows) and len(naive(rows)) == n


def test_large_components_are_exact(spark):
    rows = sample(40, 8, 3, 3e4) + [(100, [1e5 * i for i in range(8)], 1)]
    assert coded(spark, rows) == naive(rows)
    huge = [*rows, (101, [3e30, -1e12, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0], 2), (102, [3e30, 1e12, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0], 3)]
    want = [(i, c, e if e < 1 << 63 else None, s) for i, c, e, _, s in naive(huge)]
    assert [(i, c, e, s) for i, c, e, _, s in coded(spark, huge)] == want


def test_lengths_that_do_not_fit(spark):
    for rows in ([(1, [1.0] * 9, 1)], [(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)]):
        with pytest.raises(ValueError, match="components"):
            coded(spark, rows)


def test_only_named_columns_are_read(spark):
    rows = sample(50, 8, 5)
    df = spark.createDataFrame([(i, v, y, "x", 3, None) for i, v, y in rows], "vec_id long, embedding array<double>, label int, code string, id int, error string")
    books = vectors.fit(df)
    out = vectors.with_label_errors(vectors.coded(df, books))
    assert out.columns == ["id", "label", "code", "error", "label_error"]
    assert sorted(((r.id, r.code, r.error, r.label_error, books.sha256) for r in out.collect()), key=repr) == naive(rows)
    back = out.select("id", vectors.decoded(vectors.F.col("code"), books).alias("v"), "error").collect()
    whole = {i: v for i, v, _ in rows}
    for r in back:
        assert sum((math.floor(x * 4096) - y * 4096) ** 2 for x, y in zip(whole[r.id], r.v, strict=True)) == r.error


@pytest.mark.parametrize("entries", [1, 3, 16, 200])
def test_bounds_leave_out_no_nearest_entry(entries):
    rng = np.random.default_rng(entries)
    for spread in (3, 4000):
        book, queries = rng.integers(-spread, spread + 1, (entries, 5)), rng.integers(-spread, spread + 1, (300, 5))
        all_of = ((queries[:, None] - book) ** 2).sum(2)
        numbers, best, compared = VaFile(book).nearest(queries)
        assert (numbers == all_of.argmin(1)).all() and (best == all_of.min(1)).all()
        assert compared >= 300 and (entries < 200 or spread < 4000 or compared < 0.3 * all_of.size)
