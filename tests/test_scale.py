"""Work that grows with the length of a text, numbering without one task, bounds that must not be caps."""

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.functions import text as T
from sheaf.functions.numbers import rounded
from sheaf.operators import chunking, feedback, graph, numbering, retrieval, trust
from sheaf.sources import documents as S


def seconds(df):
    best = None
    for _ in range(3):
        began = time.time()
        df.write.format("noop").mode("overwrite").save()
        took = time.time() - began
        best = took if best is None or took < best else best
    return best


@pytest.mark.parametrize(("name", "unit", "n"), [("tokens", "a", 400_000), ("clean", "a", 400_000), ("clean", " ", 400_000), ("sentences", "some words here. ", 30_000), ("kinds", "# x\n```\n", 20_000), ("chunks", "a sentence of some words here.\n", 15_000)])
def test_time_grows_with_the_length(spark, name, unit, n):
    def run(k):
        df = spark.createDataFrame([(1, "start " + unit * k + " end")], "i long, text string")
        if name == "chunks":
            return seconds(chunking.chunks(df, "i"))
        c = {"tokens": T.tokens, "clean": T.clean_text, "sentences": T.sentences, "kinds": S.line_kinds}[name](F.col("text"))
        return seconds(df.select(c.alias("x")))

    once, twice = run(n), run(2 * n)
    assert twice < 2.3 * once + 0.5 and twice < 20


def test_numbers_equal_a_sort(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), rng.choice((None, *range(50))), i) for i in range(800)]
    df = spark.createDataFrame(rows, "g string, v int, i long").repartition(5)
    got = {r.i: r._k for r in numbering.numbered(df, ["v", "i"]).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    assert got == {r[2]: k for k, r in enumerate(order)}
    each = {r.i: r._k for r in numbering.numbered(df, ["v", "i"], ("g",)).collect()}
    assert each == {r[2]: k for g in "ab" for k, r in enumerate(x for x in order if x[0] == g)}
    assert numbering.numbered(df.where("false"), ["v"]).count() == 0


def test_sample_of_all_sources_is_capped_in_their_order(spark):
    rows = spark.createDataFrame([("b", i) for i in range(40)] + [("a", 100 + i) for i in range(40)], "s string, i long")
    assert [r.i for r in graph.even_sample(rows, "s", "i", 10, 13).orderBy("i").collect()] == [*range(0, 40, 4), 100, 104, 108]


def test_thresholds_over_several_blocks(spark, monkeypatch):
    from sheaf.streaming.feedback import advance

    monkeypatch.setattr(feedback, "BLOCK", 7)
    rng = random.Random(2)
    rows = [(k, i, rng.choice(("fast", "slow")), rng.random() < p) for k, p in (("a", 0.97), ("b", 0.4), ("c", 0.8)) for i in range(90)]
    got = {(r.k, r.seq): r.threshold for r in feedback.thresholds(spark.createDataFrame(rows, "k string, seq long, path string, was_accurate boolean"), ("k",)).collect()}
    state = {}
    for k, i, path, ok in rows:
        state[k] = advance(state.get(k, (feedback.INITIAL, 0, 0, 0, 0, 0)), path, ok)
        assert got[k, i] == pytest.approx(state[k][0])
    empty = feedback.report(spark.createDataFrame([], "seq long, path string, was_accurate boolean")).first()
    assert (empty.current_threshold, empty.fast_pct, empty.threshold_history) == (1.5, 0.0, 0)


def test_rounding_differs_from_binary_halves_only(spark):
    """Halves go up: of the exact binary value as in Python's round, but for values within 1e-7 of a last place of a half and exact halves above an even digit."""
    rng = random.Random(1)
    values = [rng.random() for _ in range(3000)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(rounded("v", 4)).collect()]
    assert got == [round(v, 4) for v in values]
    odd = spark.createDataFrame([(0.125,), (0.00005,), (-0.125,)], "v double").select(rounded("v", 2)).collect()
    assert [r[0] for r in odd] == [0.13, 0.0, -0.12]


def test_all_samples_count(spark):
    x = np.array([[0.0, 0.0]] * 8 + [[9.0, 9.0]] * 5 + [[0.0, 9.0]] * 2)
    rows = spark.createDataFrame([(1, 1, i, v.tolist()) for i, v in enumerate(x)], "query_id long, chunk_id long, sample long, embedding array<double>")
    assert trust.mscp(rows).first().mscp_score == round(8 / 15, 4)
    found = trust.clusters(x)
    assert sorted(map(found.count, set(found))) == [2, 5, 8] and trust.clusters(x[:4]) == [0] * 4


def test_blocks_of_vectors_meet_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 7)
    rng = np.random.default_rng(0)
    v, q = rng.normal(size=(60, 8)), rng.normal(size=(10, 8))
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(f"q{i}", x.tolist()) for i, x in enumerate(q)] + [("none", None)], "query_id string, query_vec array<double>").repartition(2)
    got = {(r.query_id, r.dense_rank): (r.chunk_id, r.dense_score) for r in retrieval.dense_topk(vectors, asked, 4).collect()}
    cos = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
    want = {(f"q{i}", k + 1): (int(j), pytest.approx(row[j], abs=6e-5)) for i, row in enumerate(cos) for k, j in enumerate(sorted(range(60), key=lambda j: (-round(row[j], 4), j))[:4])}
    assert got == want


def test_addresses_are_resolved(spark):
    rows = [("http://h/a/b/c.html", "../x.pdf", "http://h/a/x.pdf"), ("http://h/a/b/", "./y.pdf?q=../1", "http://h/a/b/y.pdf?q=../1"), ("http://h/a", "../../z.pdf", "http://h/z.pdf"), ("http://h/a/b", "/k/../l.pdf", "http://h/k/../l.pdf")]
    html = "<a class='k' href='{0}'>some title</a>"
    df = spark.createDataFrame([(i, u, html.format(h)) for i, (u, h, _) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.link for r in S.links(df).collect()}
    assert [got[i] for i in range(3)] == [w for _, _, w in rows[:3]] and got[3].endswith("l.pdf")


def test_small_pdfs_are_read():
    content = rb"BT /F1 12 Tf (Rice \(paddy\)) Tj T* [(needs ) -20 (water)] TJ ET"
    flat = b"%PDF-1.4\n1 0 obj <<>> stream\n" + content + b"\nendstream endobj\n"
    packed = b"%PDF-1.4\n1 0 obj <</Filter/FlateDecode>> stream\n" + zlib.compress(content) + b"\nendstream endobj\n"
    for data in (flat, packed):
        assert S.simple_pdf(data) == [{"page_number": 1, "text": "Rice (paddy)\nneeds water", "tables_text": []}]
    for bad in (b"plain", b"%PDF-1.4 nothing"):
        with pytest.raises(ValueError, match="no"):
            S.simple_pdf(bad)


def test_no_local_folder_on_a_cluster():
    from sheaf.session import shared_folder

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = type("C", (), {"get": staticmethod(lambda k, d: d)})

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_folder(Session)


def test_a_log_without_keys_is_many_tasks(spark):
    """The plan deals rows by range, and its thresholds are the stream's."""
    from sheaf.streaming.feedback import advance

    rng = random.Random(5)
    rows = [(i, rng.choice(("fast", "slow")), rng.random() < (0.97 if i // 300 % 2 else 0.4)) for i in range(1500)] + [(1500, None, None), (1501, "other", True)]
    log = spark.createDataFrame(rows, "seq long, path string, was_accurate boolean").repartition(7)
    out = feedback.thresholds(log)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    got = {r.seq: r.threshold for r in out.collect()}
    state = (feedback.INITIAL, 0, 0, 0, 0, 0)
    for i, path, ok in rows:
        state = advance(state, path, ok)
        assert got[i] == pytest.approx(state[0])
    assert feedback.current_threshold(log).first().threshold == pytest.approx(state[0])
    keyed = feedback.deltas(log.withColumn("k", F.when(F.col("seq") % 2 == 0, "a")), ("k",))
    assert {(r.k, r.n) for r in keyed.groupBy("k").agg(F.max("n").alias("n")).collect()} == {("a", 751), (None, 751)}


def test_lookback_counts_days_and_not_rows(spark):
    from sheaf.operators import weather

    rows = [("p", f"2024-01-{d:02d} {h:02d}:00:00", float(d)) for d in (1, 2, 9, 31) for h in (1, 5)] + [("p", "2024-01-03 00:00:00", None), ("p", None, 5.0), (None, "2024-01-01 00:00:00", 1.0)]
    df = spark.createDataFrame(rows, "place string, t string, value double").withColumn("ts", F.to_timestamp("t"))
    got = {(r.place, str(r.day)): (r.month_mean, r.week_mean, r.week_sum) for r in weather.lookback(df, "value", ["place"]).collect()}
    assert got == {("p", "2024-01-01"): (1.0, 1.0, 2.0), ("p", "2024-01-02"): (1.5, 1.5, 6.0), ("p", "2024-01-03"): (1.5, 1.5, 6.0), ("p", "2024-01-09"): (4.0, 9.0, 18.0), ("p", "2024-01-31"): (14.0, 31.0, 62.0), (None, "2024-01-01"): (1.0, 1.0, 1.0)}


def test_hashed_samples_are_those_of_every_layout(spark):
    df = spark.range(500).withColumnRenamed("id", "i")
    want = [r.i for r in graph.hashed_sample(df.repartition(7), "i", 5, 3).collect()]
    parts = graph.hashed_sample(df.where("i < 200"), "i", 5, 3).unionByName(graph.hashed_sample(df.where("i >= 200"), "i", 5, 3))
    assert [r.i for r in graph.hashed_sample(parts, "i", 5, 3).collect()] == want and want != [r.i for r in graph.hashed_sample(df, "i", 5, 4).collect()]
