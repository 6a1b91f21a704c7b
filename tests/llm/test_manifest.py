"""Manifest and proofs against a plain tree."""

import hashlib
import random
import zlib

import pytest

from sheaf.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """The last hash, and the sides of every node level by level."""
    sides, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(place):
            run = nodes[p // 8 * 8 : p // 8 * 8 + 8]
            sides[k].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        nodes = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        place = [p // 8 for p in place]
    return nodes[0], sides


def naive(rows):
    def leaf(r, text):
        return H(*(encoded(v) for v in (r[0], r[3], r[2], r[4], text)))

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for x in langs]
    inner = [climb([leaf(r, r[1]) for r in g]) for g in groups]
    root, outer = climb([top for top, _ in inner]) if groups else ("", [])
    out = []
    for g, (top, sides), way in zip(groups, inner, outer, strict=True):
        for r, own in zip(g, sides, strict=True):
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = text.translate(str.maketrans(merkle.UPPER, merkle.LOWER))
            node = leaf(r, text)
            for before, after in own + way:
                node = H(before, node, after)
            out.append((r[0], leaf(r, r[1]), top, root, H(*(b + a for b, a in own + way)), node, node == root))
    return sorted(out, key=repr)


def proved(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = merkle.proved(merkle.manifest(df, tampered=merkle.lower_every_third, **more))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def sample(sizes):
    rng = random.Random(5)
    rows = [(i, rng.choice((None, "", "Text ü 中", "low", "UP\nPER " * rng.randint(1, 4))), lang, rng.choice((None, "s")), rng.choice((None, 5))) for lang, n in sizes for i in range(n)]
    return [(1000 * k + r[0], *r[1:]) for k, r in enumerate(rows)]


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_equal_to_a_plain_tree(spark, levels):
    rows = sample([("en", 83), (None, 9), ("", 8), ("de", 1), ("Z", 64), ("é", 65)])
    assert proved(spark, rows, levels=levels) == naive(rows)


def test_blocks_over_their_borders(spark):
    rows = sample([("en", 4097), ("fr", 4096), ("de", 3)])
    assert proved(spark, rows) == naive(rows)


def test_many_groups(spark):
    rows = sample([(f"l{i}", 1 + i % 3) for i in range(70)])
    assert proved(spark, rows, levels=1) == naive(rows)


def test_odd_rows(spark):
    rows = sample([("en", 20)])
    odd = [(None, "A", "en", "s", 1), (None, None, None, None, None), rows[3], rows[3], (rows[4][0], "other", "en", None, 2), (7, "A" * 300_000, "en", "s", 1)]
    assert proved(spark, rows + odd) == naive(rows + odd)
    assert proved(spark, []) == []
    assert proved(spark, [rows[0]]) == naive([rows[0]])


def test_other_columns_are_not_read(spark):
    rows = sample([("en", 30), ("fr", 5)])
    df = spark.createDataFrame([(*r, "x", 1, None, "y") for r in rows], SCHEMA + ", name string, k int, leaf string, root string")
    assert sorted((tuple(r) for r in merkle.proved(merkle.manifest(df, tampered=merkle.lower_every_third)).collect()), key=repr) == naive(rows)
    assert all(r.verified for r in merkle.proved(merkle.manifest(df)).collect())
