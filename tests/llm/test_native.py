"""Quality rules, fingerprints, sharding against plain loops."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from llm_plain import measured
from sheaf.llm import fingerprints, quality, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "one", "a b", "a b c a b c a b c", "x\n\nx\nx y\n", "Ünïcode ß 中文 字 " * 30, "w " * 5000, "same line here\n" * 60, "#$ %% | <a> &b " * 20, "z" * 5000]


def rows(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def test_measurements_equal_a_loop(spark, data):
    texts = ODD + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    book = quality.apply_policy(quality.ledger(rows(spark, texts))).orderBy("doc_id").collect()
    for r, t in zip(book, texts, strict=True):
        want = measured(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_upper, r.n_letters, r.n_lines) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_policies_and_ablation(spark, data):
    book = quality.ledger(spark.read.parquet(f"{data}/documents.parquet"))
    bits = [r.fail_bits for r in book.collect()]
    for policy in quality.POLICIES:
        mask = quality.mask_of(policy)
        assert quality.apply_policy(book, policy).where("kept").count() == sum(not b & mask for b in bits)
        got = {r.rule: (r.n_failed, r.n_only) for r in quality.ablation(book, policy).collect()}
        for name in quality.POLICIES[policy]:
            bit = 1 << quality.RULE_NAMES.index(name)
            assert got.get(name, (0, 0)) == (sum(bool(b & bit) for b in bits), sum(b & mask == bit for b in bits))
    assert tuple(n for n, _ in quality.rules()) == quality.RULE_NAMES


def test_filter_keeps_columns_and_clean_documents(spark):
    good = " ".join(f"word{i} and some{i % 17} more{i % 13}" for i in range(60))
    df = rows(spark, [good, "short", None, good]).withColumn("kept", F.lit("clash")).withColumn("fail_bits", F.lit(7))
    out = quality.filter_documents(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [0, 3]
    assert quality.filter_documents(df.where("false")).count() == 0


def naive_edit(texts_by_id):
    ids = sorted(texts_by_id, reverse=True)
    out = {}
    for k, i in enumerate(ids):
        t, n = texts_by_id[i] or "", texts_by_id[ids[(k + 1) % len(ids)]] or ""
        cut = len(t) // 3
        out[i] = t[: len(t) - cut] + n[:cut]
    return out


def test_fingerprints(spark, data):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("abc déf\n") for _ in range(rng.randint(1, 400))) for _ in range(40)] + ["twin text of some words"] * 3
    ids = rng.sample(range(1000), len(texts))
    df = rows(spark, texts, ids)
    out = fingerprints.fingerprint_edits(df).collect()
    edits = naive_edit(dict(zip(ids, texts, strict=True)))
    assert len(out) == len(texts)
    by_text = collections.defaultdict(set)
    for r in out:
        t = dict(zip(ids, texts, strict=True))[r.doc_id] or ""
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edits[r.doc_id].encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text[t].add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert by_text[""] == {""}
    assert fingerprints.fingerprint_edits(df.where("false")).count() == 0
    one = fingerprints.fingerprint_edits(df.limit(1)).collect()
    assert len(one) == 1


def test_null_and_repeated_ids(spark):
    df = rows(spark, ["a b c d", "e f g h", "a b c d", "a b c d"], [1, None, 2, 2])
    assert fingerprints.fingerprint_edits(df).count() == 4


def test_likeness_falls_with_edits(spark):
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(600)]
    texts = [" ".join(base)]
    for share in (0.02, 0.1, 0.3, 1.0):
        w = list(base)
        for i in rng.sample(range(600), int(600 * share)):
            w[i] = f"v{rng.randint(0, 10**6)}"
        texts.append(" ".join(w))
    moved = base[300:] + base[:300]
    swapped = [base[i ^ 1] for i in range(600)]
    texts += [" ".join(moved), " ".join(swapped)]
    df = rows(spark, texts).select(F.col("doc_id"), fingerprints.fingerprint(F.col("text")).alias("f"))
    f = {r.doc_id: set(r.f) for r in df.collect()}
    near = [len(f[0] & f[i]) / 64 for i in range(7)]
    assert near[0] == 1 and near[1] > near[2] > near[3] > near[4] == 0 and near[6] < 0.2


def greedy(sizes, cap):
    n, cur = 1, 0
    for s in sizes:
        if cur + s > cap:
            n, cur = n + 1, s
        else:
            cur += s
    return n


@pytest.mark.parametrize("seed", range(4))
def test_minimax_is_the_least_capacity(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 50) for _ in range(rng.randint(1, 80))]
    k = rng.randint(1, 9)
    r = spark.createDataFrame([(sizes,)], "s array<long>").select(sharding.minimax(F.col("s"), k).alias("m")).first().m
    want = next(c for c in range(max(sizes), sum(sizes) + 1) if greedy(sizes, c) <= k)
    assert r.capacity == want and len(r.starts) == greedy(sizes, want)
    cuts = [*r.starts, len(sizes)]
    assert all(sum(sizes[a:b]) <= want for a, b in zip(cuts, cuts[1:]))  # noqa: B905


@pytest.mark.parametrize("hot", [0, 2000])
def test_shards(spark, hot):
    rng = random.Random(9)
    texts = [None, "", "é" * 50] + ["copy of a text " * 4] * hot + ["x" * rng.randint(0, 400) + str(rng.random()) for _ in range(1500)]
    out = sharding.shard_by_bytes(rows(spark, texts), 24).collect()
    assert len(out) == len(texts)
    shards, groups, slots = collections.Counter(), collections.defaultdict(set), collections.defaultdict(list)
    for r in out:
        t = texts[r.doc_id] or ""
        assert (r.size, r.text_crc32) == (len(t.encode()) + 8, zlib.crc32(t.encode()))
        shards[r.shard] += r.size
        groups[t].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(x) == 1 for x in groups.values()) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    if hot:
        rest = [v for s, v in shards.items() if s not in groups["copy of a text " * 4]]
        assert len(shards) == 24 and max(rest) < 1.2 * sum(rest) / 23
    else:
        assert set(shards) == set(range(24)) and max(shards.values()) < 1.1 * sum(shards.values()) / 24


def test_no_documents(spark):
    assert sharding.shard_by_bytes(rows(spark, [])).count() == 0
    assert sharding.shard_by_bytes(rows(spark, [None, "a"])).count() == 2
