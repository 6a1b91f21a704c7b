"""Search by lists, the written vector store and its index, tables by key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.operators import lists, providers, retrieval
from sheaf.sources import files, keyed, vectors


def clusters(n, dims=16, groups=12, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dims))
    return centers[rng.integers(0, groups, n)] + 0.15 * rng.normal(size=(n, dims))


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<double>").repartition(3)


def asked(spark, x):
    return spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(x)] + [("none", None)], "query_id string, query_vec array<double>")


def ids(df):
    return sorted((r.query_id, r.dense_rank, r.chunk_id, r.dense_score) for r in df.collect())


def test_lists_find_neighbours_and_compare_few(spark):
    x = clusters(3040)
    held, queries = frame(spark, x[:3000]).unionByName(spark.createDataFrame([(9999, None)], "chunk_id long, embedding array<double>")), asked(spark, x[3000:])
    index = lists.build(held)
    assert index.blocks.select(F.sum(F.size("ids"))).first()[0] == 3000
    exact = retrieval.dense_topk(held, queries, 10)
    got = lists.recall(lists.search(index, queries, 10), exact).first()
    assert got.n_queries == 40 and got.recall >= 0.9
    assert lists.pairs_met(index, queries) < 0.4 * 3000 * 40
    assert ids(lists.search(index, queries, 10, len(index.centroids))) == ids(exact)
    plan = lists.search(index, queries, 10)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_few_and_no_vectors(spark):
    nothing = spark.createDataFrame([], "chunk_id long, embedding array<double>")
    assert lists.search(lists.build(nothing), asked(spark, clusters(2, 4)), 3).count() == 0
    two = frame(spark, np.array([[1.0, 0, 0], [1.0, 0, 0]]))
    assert [(r.chunk_id, r.dense_score) for r in lists.search(lists.build(two), asked(spark, np.array([[2.0, 0, 0]])), 3).orderBy("dense_rank").collect()] == [(0, 1.0), (1, 1.0)]


def chunks(spark, ids):
    return spark.createDataFrame([(i, f"text number {i} of the store", ["a", "b"], "f.pdf", 1.0, 9, 0.8, 0.0, 2023) for i in ids],
                                 "chunk_id long, text string, crop_tags array<string>, source_file string, trust_weight double, char_count int, authority_score double, bias_penalty double, year int")


def test_the_store_is_written_and_its_index_follows(spark, tmp_path):
    path = str(tmp_path / "v")
    assert vectors.upsert(chunks(spark, range(30)), path, providers.hashed_embedding, buckets=8).count() == 30
    first = vectors.index(spark, path)
    assert vectors.upsert(chunks(spark, range(20, 40)), path, providers.hashed_embedding).count() == 10
    assert vectors.upsert(chunks(spark, range(20, 40)), path, providers.hashed_embedding).count() == 0
    held = vectors.records(spark, path)
    assert held.count() == 40 == held.select("chunk_id").distinct().count() and held.first().crop_tags == "a, b"
    index = vectors.index(spark, path)
    assert (index.centroids == first.centroids).all() and index.blocks.select(F.sum(F.size("ids"))).first()[0] == 40
    queries = held.where("chunk_id < 5").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    assert ids(lists.search(index, queries, 3, len(index.centroids))) == ids(retrieval.dense_topk(held, queries, 3))
    vectors.upsert(chunks(spark, range(40, 90)), path, providers.hashed_embedding)  # the store has doubled
    assert vectors.index(spark, path).blocks.select(F.sum(F.size("ids"))).first()[0] == 90


def test_embedding_equals_a_loop(spark):
    texts = ["red fox red", "", None, "a/b c" * 40, "one two three four five six seven eight"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    from sheaf.functions.text import tokens

    rows = df.select(F.transform(tokens(F.col("text")), lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(8)), F.xxhash64(t, F.lit(1)))).alias("h"), providers.hashed_embedding(F.col("text"), 8).alias("e")).collect()
    for r in rows:
        want = np.zeros(8)
        for j, sign in r.h:
            want[j] += 1 if sign > 0 else -1
        assert r.e == pytest.approx(list(want / max(np.linalg.norm(want), 1e-9)), abs=1e-6)


def test_an_append_touches_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    row = lambda ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "k long, v string")
    assert keyed.append(row(range(100)), path, ["k"], buckets=16).count() == 100
    before = keyed.opened(spark, path)
    assert {r.k for r in keyed.append(row([5, 100]), path, ["k"]).collect()} == {100}
    after = keyed.opened(spark, path)
    grown = [b for b in after.folders if after.folders[b] != before.folders.get(b)]
    assert len(grown) == 1 and {r.k for r in keyed.read(spark, path).collect()} == set(range(101))
    assert keyed.read(spark, path, buckets={int(grown[0])}).count() < 30
    assert len(files.names(spark, f"{path}/{after.folders[grown[0]][-1]}")) <= 3  # one bucket and a mark


def test_a_merge_rewrites_its_buckets_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    row = lambda pairs: spark.createDataFrame(pairs, "k string, n long")
    add = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    keyed.merge(row([(f"k{i}", 1) for i in range(50)]), path, ["k"], add, buckets=16)
    before = keyed.opened(spark, path)
    with monkeypatch.context() as m:
        m.setattr(files, "rename", lambda *_: False)
        with pytest.raises(files.Conflict):
            keyed.merge(row([("k3", 5)]), path, ["k"], add)
    assert keyed.opened(spark, path) == before
    keyed.merge(row([("k3", 5), ("new", 2)]), path, ["k"], add)
    after = keyed.opened(spark, path)
    assert sum(after.folders[b] != before.folders.get(b) for b in after.folders) <= 2
    assert {r.k: r.n for r in keyed.read(spark, path).collect()} == {f"k{i}": 1 for i in range(50)} | {"k3": 6, "new": 2}
    keyed.vacuum(spark, path)
    assert keyed.read(spark, path).count() == 51
