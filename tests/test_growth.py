"""Steps that were done twice, moved or held more than they need, and so grew faster than their input."""

import glob

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sheaf.functions.text import crop_tags, tokens
from sheaf.operators import chunking, graph, inverted, lists, numbering, provenance, retrieval
from sheaf.session import shared_folder
from sheaf.sources import keyed, segments


def counted(spark, df):
    """The frame, and a counter of the times that its rows are made."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), made


def docs(spark, n):
    return spark.range(n).select(F.col("id").alias("chunk_id"), F.concat_ws(" ", *(F.concat(F.lit(x), (F.col("id") * p % 17).cast("string")) for x, p in (("aa", 3), ("bb", 5), ("cc", 7)))).alias("text"))


def test_a_segment_is_made_once(spark, tmp_path):
    corpus, made = counted(spark, docs(spark, 200))
    segments.rebuild(corpus, str(tmp_path / "ix"))
    assert made.value == 200


def test_changes_leave_no_tables(spark, tmp_path):
    path, d = str(tmp_path / "ix"), docs(spark, 200)
    before = set(glob.glob(shared_folder(spark).removeprefix("file:") + "/*"))
    segments.rebuild(d.where("chunk_id % 2 = 0"), path)
    segments.upsert(d.where("chunk_id % 2 = 1"), path)
    segments.upsert(d.where("chunk_id % 7 = 0").withColumn("text", F.concat("text", F.lit(" dd1"))), path)
    segments.delete(d.where("chunk_id % 5 = 0"), path)
    segments.compact(spark, path, most=1)
    assert set(glob.glob(shared_folder(spark).removeprefix("file:") + "/*")) == before
    left = {r.chunk_id for r in segments.open_index(spark, path).chunks.collect()}
    assert left == {i for i in range(200) if i % 5}


def test_merged_blocks_are_shuffled_once(spark, tmp_path):
    path, d = str(tmp_path / "ix"), docs(spark, 200)
    segments.rebuild(d.where("chunk_id % 2 = 0"), path)
    segments.upsert(d.where("chunk_id % 2 = 1"), path)
    m = segments.manifest(spark, path)
    plan = segments._merged(segments._opened(spark, path, m), 9, 64)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1 and "rangepartitioning" not in plan


def test_rows_of_terms_that_nobody_asks_for_stay(spark, tmp_path, monkeypatch):
    path, kept = str(tmp_path / "ix"), []
    segments.rebuild(docs(spark, 200), path)
    index = segments.open_index(spark, path)
    asked = spark.createDataFrame([(1, "aa1 bb2"), (2, "cc3")], "query_id int, query string")
    want = sorted(map(tuple, retrieval.sparse_topk(index, asked, 5).collect()))

    def watched(df, name, keep=False, own=inverted.written):
        out = own(df, name, keep)
        kept.extend([out] if name == "held" else [])
        return out

    monkeypatch.setattr(inverted, "ONE_PASS", 0)
    monkeypatch.setattr(inverted, "written", watched)
    assert sorted(map(tuple, retrieval.sparse_topk(index, asked, 5).collect())) == want
    assert {r.term for x in kept for r in x.collect()} == {"aa1", "bb2", "cc3"}


def test_rows_to_number_are_made_once(spark):
    rows, made = counted(spark, spark.range(100).select((F.col("id") * 37 % 101).alias("x")))
    got = numbering.numbered(rows, ["x"]).orderBy("x").collect()
    assert [r._k for r in got] == list(range(100)) and made.value == 100


def test_scores_held_at_once_are_bounded(monkeypatch):
    rng = np.random.default_rng(3)
    asked, held = (rng.normal(size=(n, 8)) for n in (50, 40))
    asked, held = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (asked, held))
    whole = list(retrieval.best_pairs(asked, held, 5))
    monkeypatch.setattr(retrieval, "CELLS", 200)
    monkeypatch.setattr(lists, "CELLS", 200)
    parts = list(retrieval.best_pairs(asked, held, 5))
    assert len(whole) == 1 and len(parts) == 10 and all(q.max() - q.min() < 5 for q, _, _ in parts)
    for i in range(3):
        assert np.allclose(np.concatenate([p[i] for p in parts]), whole[0][i])
    assert (lists._nearest(asked, held, 3) == np.argsort(-np.round(asked @ held.T, 12), axis=1, kind="stable")[:, :3]).all()


def test_an_even_sample_numbers_keys_only(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(graph, "numbered", lambda df, *a, own=graph.numbered: seen.append(df.columns) or own(df, *a))
    # each order twice, once with the same text
    rows = spark.range(80).select((F.col("id") % 2).cast("string").alias("s"), F.floor(F.col("id") / 4).alias("o"), F.when(F.col("id") % 8 < 4, "x").otherwise(F.col("id").cast("string")).alias("text"))
    got = graph.even_sample(rows, "s", "o", 10).collect()
    assert "text" not in seen[0] and set(got[0].asDict()) == {"s", "o", "text"}
    assert sorted((r.s, r.o) for r in got) == sorted((s, o) for s in "01" for o in range(0, 20, 2))


def test_a_batch_of_new_rows_is_written_once(spark, tmp_path, monkeypatch):
    names, path = [], str(tmp_path / "t")
    monkeypatch.setattr(keyed, "written", lambda df, name, keep=False, own=keyed.written: names.append(name) or own(df, name, keep))
    keyed.append(spark.range(50).withColumn("v", F.lit("a")), path, ["id"], buckets=2)
    assert keyed.append(spark.range(50, 90).withColumn("v", F.lit("b")), path, ["id"], buckets=2).count() == 40 and names == ["batch", "batch"]
    assert keyed.append(spark.range(80, 100).withColumn("v", F.lit("c")), path, ["id"], buckets=2).count() == 10
    assert keyed.read(spark, path).count() == 100


def test_a_report_matches_each_sentence_once(spark):
    said, made = counted(spark, spark.createDataFrame([(q, i, f"Water word{i} here") for q in range(3) for i in range(4)], "query_id int, idx int, sentence string"))
    chunks = spark.createDataFrame([(q, k, f"src{k}", "water word1 word1 word3" if k else None, 0.8, "FRESH") for q in range(2) for k in range(3)],
                                   "query_id int, chunk_rank int, source_file string, text string, temporal_score double, freshness_label string")
    matches = provenance.overlap_match(said, chunks)
    told = {r.query_id: r.report for r in provenance.report(matches).collect()}
    assert made.value == 12 and set(told) == {0, 1, 2}
    assert told[0].count("Source     : src1") == 4 and told[0].count("Confidence : 0.97") == 2 and told[0].count("Confidence : 0.63") == 2
    assert told[2].count("Source     : UNKNOWN") == 4 and "Inferred (no source)     : 4 sentences" in told[2]


def test_a_query_meets_its_chunks_whole(spark):
    """One row a chunk of a query, however many sentences its answer has."""
    said = spark.createDataFrame([(1, i, f"Some word{i}, 12_a Straße word{i}") for i in range(50)] + [(2, 0, "...")], "query_id int, idx int, sentence string")
    held, made = counted(spark, spark.createDataFrame([(1, k, "s", f"some word{k} strasse straße 12_ab", 0.5, "AGING") for k in range(5)] + [(2, 0, "s", "x", 0.5, "AGING")],
                                                      "query_id int, chunk_rank int, source_file string, text string, temporal_score double, freshness_label string"))
    plan = provenance.overlap_match(said, held)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan.split("Join")[0]
    got = {(r.query_id, r.idx): (r.matched_source, r.confidence) for r in provenance.overlap_match(said, held).collect()}
    want = lambda i: ("s", 1.0) if i < 5 or i < 50 and any(f"word{i}" in f"some word{k} " for k in range(5)) else ("s", 0.9)
    assert got == {(1, i): want(i) for i in range(50)} | {(2, 0): ("UNKNOWN", 0.0)} and made.value == 6


def test_an_index_reads_tokens_from_bytes(spark):
    """As the column function does, without a row's list of tokens between Spark and Python."""
    odd = ["", "a", "ab", "the ab the", "Straße km/h a/b x1_y é9 İstanbul", "kg/ha\n\nkg/ha", "ab", "cd", "", "é", "_ __ 0 00", "\U0001f600aa\U0001f600b\u00a0cc", None, "zz"] + ["ends" * i for i in range(5)]
    corpus = spark.createDataFrame(list(enumerate(odd)), "chunk_id int, text string").coalesce(1)
    blocks = inverted.blocks_of(corpus, size=3)
    assert "regexp_extract_all" not in blocks._jdf.queryExecution().optimizedPlan().toString()
    index = inverted.Index(blocks, None, None)
    ids = index.chunks.select("chunk_id", "block", "place")
    got = sorted((r.term, r.chunk_id, r.tf, r.doc_len) for r in index.postings.join(ids, ["block", "place"]).collect())
    assert got == sorted((r.term, r.chunk_id, r.tf, r.doc_len) for r in retrieval.postings(corpus).collect()) and len(got) > 10
    assert {r.chunk_id: r.doc_len for r in index.chunks.collect()} == {r.chunk_id: r.n for r in corpus.select("chunk_id", F.size(tokens(F.col("text"))).alias("n")).collect()}


def test_a_reply_is_parsed_once_and_by_all_cores(spark, data):
    from sheaf.plans import registry
    from sheaf.plans.gate_queries import service_replies

    out = service_replies(spark, data)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 4 and "Repartition" in plan
    assert registry.QUERIES["service_replies"] is service_replies and out.count() == spark.read.parquet(f"{data}/events.parquet").count()


def test_replies_that_are_none(spark):
    from sheaf.sources import services as V

    replies = [None, "", "oops", "[]", "{}", '[{"lat": "1.23456"}]', '[{"lat": "1.23456", "lon": "2"}]', '{"current": null, "daily": {"time": ["x"]}}', '{"hourly": {"soil_moisture_0_to_1cm": []}}',
               '{"properties": {"parameter": {"T2M": {"a": null}, "PRECTOTCORR": {}}}}', '{"properties": {"parameter": {"T2M": {"a": 1.0, "b": null, "c": 3.0}}}}']
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string")
    got = [r.asDict(True) for r in rows.select("i", V.place_of(F.col("reply")).alias("g"), V.weather_of(F.col("reply")).alias("w"), V.soil_of(F.col("reply")).alias("s"), V.satellite_of(F.col("reply")).alias("n")).orderBy("i").collect()]
    assert [r["g"]["found"] for r in got] == [False] * 6 + [True] + [False] * 4 and got[6]["g"] == {"latitude": 1.2346, "longitude": 2.0, "place": None, "found": True}
    assert [i for i, r in enumerate(got) if r["w"]] == [7] and got[7]["w"]["daily"]["date"] == ["x"] and got[7]["w"]["current"]["code"] is None
    assert all(r["s"]["soil_moisture"] is None and r["s"]["label"] == "UNAVAILABLE" for r in got)
    assert [r["n"]["avg_temp"] for r in got] == [None] * 10 + [2.0] and all(r["n"]["total_rain"] is None for r in got)


def test_a_text_is_split_once_and_lower_cased_once(spark):
    texts = spark.createDataFrame([(0, None), (1, ""), (2, "short."), (3, "A sentence about Rice and Tea, of more than fifty characters in all. Another one.")], "i int, text string")
    made = chunking.chunks(texts, "i")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
    tagged = made.select("i", "chunk_no", crop_tags(F.col("text")).alias("tags"))
    filters = tagged.select("tags")._jdf.queryExecution().optimizedPlan().toString().split("lambdafunction(")
    assert not any("lower(" in f and "Contains(lower" in f for f in filters)
    assert [tuple(r) for r in tagged.collect()] == [(3, 0, ["rice", "tea"])]
    assert texts.where("i < 2").select(crop_tags(F.col("text")).alias("t")).distinct().collect() == [([],)]


def test_a_scorer_gets_texts_without_sentences(spark):
    from sheaf.operators.pairs import PairScorer

    long = "A first sentence of about thirty five chars. A second sentence of about as many chars."
    texts = spark.createDataFrame([(0, ""), (1, long), (2, None), (3, long), (4, "x")], "i int, text string").coalesce(1)
    scorer = PairScorer(lambda: None, lambda model, a, b: [0.0 if x.startswith("A first") else 1.0 for x in a])
    got = [tuple(r) for r in chunking.chunks(texts, "i", next_score=scorer).orderBy("i", "chunk_no").collect()]
    assert got == [tuple(r) for r in chunking.chunks(texts.where("i in (1, 3)"), "i", next_score=scorer).orderBy("i", "chunk_no").collect()]


def test_a_threshold_is_found_once_and_texts_stay(spark, data, monkeypatch):
    """The answers start from written questions, and against the few rows that are found the corpus is not shuffled, by its source or by its id."""
    from sheaf.operators import pipeline
    from sheaf.plans.pipeline_queries import answer_pipeline

    plans = {}
    monkeypatch.setattr(pipeline, "written", lambda df, name, own=pipeline.written: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and own(df, name))
    out = answer_pipeline(spark, data)
    assert [name for name, plan in plans.items() if "_before_n" in plan] == ["routed"] and "_before_n" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() > 0 and "Exchange hashpartitioning" not in plans["found"] and plans["found"].count("documents.parquet") == 1 and "text:string" not in plans["fused"]
    assert "CartesianProduct" not in plans["fused"]


def test_the_last_threshold_is_told_without_the_others(spark):
    from sheaf.operators import feedback

    log = spark.range(3000).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "slow").otherwise("fast").alias("path"), ((F.col("id") % 700 > 180) | (F.col("id") % 2 == 0)).alias("was_accurate"))
    for some in (log, log.where("seq < 2"), log.where("false"), log.where("seq < 1750"), log.withColumn("was_accurate", F.lit(True)), log.withColumn("was_accurate", F.lit(False))):
        last = feedback.current_threshold(some)
        want = max(((r.seq, r.threshold) for r in feedback.thresholds(some).collect()), default=(0, feedback.INITIAL))[1]
        assert [r.threshold for r in last.collect()] == [want] and "arrays_zip" not in last._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_queries_and_blocks_meet_terms_in_many_tasks(spark, tmp_path, monkeypatch):
    path, kept = str(tmp_path / "ix"), []
    segments.rebuild(docs(spark, 200), path)
    index = segments.open_index(spark, path)
    asked = spark.createDataFrame([(i, f"aa{i} bb2") for i in range(9)], "query_id int, query string")
    monkeypatch.setattr(inverted, "ONE_PASS", 0)
    monkeypatch.setattr(inverted, "written", lambda df, name, own=inverted.written: (kept.append(df.rdd.getNumPartitions()) if name == "limits" else None) or own(df, name))
    assert retrieval.sparse_topk(index, asked, 5).count() > 0 and kept == [int(spark.conf.get("spark.sql.shuffle.partitions"))]


def test_a_block_is_scored_as_chunk_by_chunk():
    rng, n = np.random.default_rng(7), 61
    terms = [np.sort(rng.choice(n, rng.integers(1, 40), replace=False)) for _ in range(30)]
    tfs, lens = [rng.integers(1, 6, len(p)) for p in terms], rng.integers(1, 90, n)
    asks = [[(q, float(rng.uniform(-0.2, 3))) for q in rng.choice(8, rng.integers(1, 6), replace=False).tolist()] for _ in terms]
    gone, mean = [0, 7, 60, 99], 40.0
    lists = lambda rows, kind: pa.array([list(map(kind, r)) for r in rows], pa.list_(pa.int32()))
    table = pa.table({"places": lists(terms, int), "tfs": lists(tfs, int), "lens": lists([lens[p] for p in terms], int), "gone": lists([gone] * 30, int), "mean": [mean] * 30,
                      "queries": [[q for q, _ in a] for a in asks], "ws": [[w for _, w in a] for a in asks], "cuts": [[0.0] * len(a) for a in asks], "margins": [[0.0] * len(a) for a in asks]})
    got = {}
    for r in inverted._score_block(table, 5, 4).to_pylist():
        if r["place"] is not None:
            got.setdefault(r["query_id"], {})[r["place"]] = r["raw"]
    for q in range(8):
        full = np.zeros(n)
        for p, tf, a in zip(terms, tfs, asks, strict=True):
            full[p] += dict(a).get(q, 0.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * lens[p] / mean))
        full[[g for g in gone if g < n]] = 0
        best = sorted((-x, i) for i, x in enumerate(full) if x > 0)[:4]
        assert all(abs(got[q][i] + x) < 1e-9 for x, i in best) and len(got[q]) == len(best)
