"""A stored graph that grows by batches: equal to one made at once, its own buckets only, nothing lost or counted twice after a crash."""

import os

import pytest

from sheaf.operators import graph
from sheaf.operators.providers import pattern_triplets
from sheaf.sources import files, stores


def chunks(spark, ids):
    return spark.createDataFrame([(f"c{i:03d}", f"s{i % 3}.pdf", f"rice{i % 7} is crop. water is wet{i % 5}" if i % 4 else "nothing here") for i in ids], "chunk_id string, source_file string, text string")


def state(spark, path):
    kept = lambda name, *cols: sorted(tuple(r) for r in spark.read.parquet(f"{path}/{name}").select(*cols).collect())
    return kept("nodes", "node", "mentions", "node_type"), kept("edges", "subject", "object", "relationship", "source_file")


def at_once(spark, path):
    t = spark.read.parquet(f"{path}/triplets")
    return sorted(tuple(r) for r in graph.nodes(t).select("node", "mentions", "node_type").collect()), sorted(tuple(r) for r in graph.edges(t).select("subject", "object", "relationship", "source_file").collect())


def test_batches_equal_one_build(spark, tmp_path):
    path = str(tmp_path / "g")
    for ids in (range(20), range(10, 40), range(40)):
        stores.build_graph(chunks(spark, ids), path, pattern_triplets, buckets=8)
    assert state(spark, path) == at_once(spark, path) and dict((n, m) for n, m, _ in state(spark, path)[0])["crop"] == 30
    assert spark.read.parquet(f"{path}/processed").count() == 40


def test_only_touched_buckets_change(spark, tmp_path):
    path = str(tmp_path / "g")
    stores.build_graph(chunks(spark, range(40)), path, pattern_triplets, buckets=16)
    listed = lambda: {b: sorted(os.listdir(f"{path}/nodes/{b}")) for b in os.listdir(f"{path}/nodes") if b.startswith("_bucket=")}
    before = listed()
    stores.build_graph(spark.createDataFrame([("new", "z.pdf", "rice1 is crop")], "chunk_id string, source_file string, text string"), path, pattern_triplets)
    after = listed()
    assert 1 <= sum(after[b] != before.get(b) for b in after) <= 2 and state(spark, path) == at_once(spark, path)


@pytest.mark.parametrize("step", [1, 2, 3])
def test_a_crash_is_caught_up(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "g")
    asked = []

    def extract(c):
        asked.extend(r.chunk_id for r in c.collect())
        return pattern_triplets(c)

    stores.build_graph(chunks(spark, range(12)), path, extract, buckets=4)
    calls = []

    class Crash(Exception):
        pass

    def crashing(real):
        def f(*a, **b):
            calls.append(1)
            if len(calls) == step:
                raise Crash
            return real(*a, **b)
        return f

    with monkeypatch.context() as m:
        m.setattr(stores, "_merge_buckets", crashing(stores._merge_buckets))
        m.setattr(files, "commit_version", crashing(files.commit_version))
        with pytest.raises(Crash):
            stores.build_graph(chunks(spark, range(30)), path, extract, buckets=4)
    stores.build_graph(chunks(spark, range(30)), path, extract, buckets=4)
    assert state(spark, path) == at_once(spark, path) and len(asked) == len(set(asked)) == 30
