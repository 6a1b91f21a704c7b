import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.functions import rules
from sheaf.operators import feedback, gates, graph, pipeline, provenance, providers, retrieval, trust, weather


def test_bm25_against_a_loop(spark):
    docs = ["red fox jumps", "red red dog", "lazy dog sleeps red", "green field", "", None]
    corpus = spark.createDataFrame(list(enumerate(docs)), "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "red fox"), (2, "dog dog"), (3, "missing"), (4, None)], "query_id long, query string")
    got = {(r.query_id, r.chunk_id): r.sparse_score for r in retrieval.sparse_topk(corpus, queries, 10).collect()}
    toks = [(d or "").split() for d in docs]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    vocab = {w for t in toks for w in t}
    raw = {w: math.log(n - df + 0.5) - math.log(df + 0.5) for w in vocab for df in [sum(w in t for t in toks)]}
    idf = {w: 0.25 * sum(raw.values()) / len(raw) if v < 0 else v for w, v in raw.items()}
    for q, text in ((1, "red fox"), (2, "dog dog")):
        score = {i: sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in text.split() if w in t) for i, t in enumerate(toks)}
        best = max(score.values())
        assert {i: s for (k, i), s in got.items() if k == q} == pytest.approx({i: round(s / best, 4) for i, s in score.items() if s > 0}, abs=1.1e-4)
    assert not [k for k in got if k[0] > 2]


def test_dense_is_exact_cosine_with_ties(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(200, 8))
    m[150] = m[3]
    vec = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "chunk_id long, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(7, [float(x) for x in m[3]]), (8, None)], "query_id long, query_vec array<float>")
    got = [(r.chunk_id, r.dense_score) for r in retrieval.dense_topk(vec, q, 5).orderBy("dense_rank").collect()]
    f = m.astype(np.float32).astype(float)
    cos = f @ f[3] / np.linalg.norm(f, axis=1) / np.linalg.norm(f[3])
    want = sorted(((-round(float(c), 4), i) for i, c in enumerate(cos)))[:5]
    assert got == [(i, pytest.approx(-s, abs=1e-4)) for s, i in want] and got[0][0] == 3 and got[1][0] == 150


def ranks(spark, rows, score, rank):
    return spark.createDataFrame([(1, c, s, r) for c, s, r in rows], f"query_id long, chunk_id long, {score} double, {rank} int")


def test_fusion(spark):
    dense = ranks(spark, [(1, 0.9, 1), (2, 0.5, 2)], "dense_score", "dense_rank")
    sparse = ranks(spark, [(2, 1.0, 1), (3, 0.4, 2)], "sparse_score", "sparse_rank")
    weight = spark.createDataFrame([(1, 0.5), (2, 0.0), (3, 1.0)], "chunk_id long, trust_weight double")
    one = {r.chunk_id: (r.final_score, r.found_by) for r in retrieval.hybrid(dense, sparse, weight, 3).collect()}
    assert one == {1: (0.27, "dense"), 2: (0.7, "dense+sparse"), 3: (0.16, "sparse")}
    raw = {r.chunk_id: r.final_score for r in retrieval.hybrid(dense, sparse, weight, 3, nonpositive_trust_as_one=False).collect()}
    assert raw[2] == 0.0
    fused = {r.chunk_id: r.rrf_score for r in retrieval.rrf(dense, sparse, 2).collect()}
    assert fused == {2: round(1 / 62 + 1 / 61, 6), 1: round(1 / 61 + 1 / 67, 6)}
    swap = lambda d, a, b: d.withColumnRenamed(f"{a}_score", f"{b}_score").withColumnRenamed(f"{a}_rank", f"{b}_rank")
    other = {r.chunk_id: r.rrf_score for r in retrieval.rrf(swap(sparse, "sparse", "dense"), swap(dense, "dense", "sparse"), 2).collect()}
    assert other == fused


@pytest.mark.parametrize(
    ("kind", "scores"),
    [("RECOMMENDATION", (0.7038, 0.4939, 0.4221)), ("FACTUAL", (0.8682, 0.7517, 0.6890)), ("DIAGNOSTIC", (0.7701, 0.5913, 0.5207)), ("OTHER", (0.8177, 0.6667, 0.5990))],
)
def test_temporal_goldens(spark, kind, scores):
    rows = spark.createDataFrame([(1, i, f) for i, f in enumerate(("tnau_guide.pdf", "KAU pops.pdf", "crop protection.pdf", "unknown.pdf"))], "query_id long, retrieval_rank long, f string")
    out = trust.temporal_decay(rows, "f", F.lit(kind)).orderBy("retrieval_rank").collect()
    assert [r.temporal_score for r in out] == [*scores, 0.5] and out[3].freshness_label == "OUTDATED"


def test_trust_fallback_and_filter(spark):
    rows = spark.createDataFrame([(1, 1, 0.9, 0.9), (1, 2, 0.3, 0.9), (2, 3, 0.1, 0.9), (2, 4, 0.2, 0.9)], "query_id long, chunk_id long, final_score double, trust_weight double").withColumn("authority_score", F.lit(None).cast("double")).withColumn("bias_penalty", F.lit(0.0))
    out = {r.chunk_id: (r.included, r.reason) for r in trust.trust_pipeline(rows).collect()}
    assert out == {1: (True, "lcr_skipped_fast_path"), 2: (True, "lcr_skipped_fast_path"), 3: (False, "lcr_skipped_fast_path"), 4: (True, "fallback_best_available")}


def test_mscp(spark):
    x = [[0.0], [0.01], [0.02], [0.0], [5.0]]
    rows = spark.createDataFrame([(1, 1, i, v) for i, v in enumerate(x)] + [(1, 2, 0, [1.0])] + [(1, 3, 0, [1.0]), (1, 3, 1, [9.0])] + [(1, 4, i, [3.0]) for i in range(4)], "query_id long, chunk_id long, sample int, embedding array<double>")
    out = {r.chunk_id: r.mscp_score for r in trust.mscp(rows).collect()}
    assert out[2] == 1.0 and out[3] == 0.5 and out[4] == 1.0 and out[1] <= 0.8
    labels = spark.createDataFrame([([0, 0, 0, 0, 1],), ([0, 0, 1, 1, 2],), ([],)], "l array<int>")
    assert [r[0] for r in labels.select(trust.largest_share(F.col("l"))).collect()] == [0.8, 0.4, 1.0]


def test_routing_cases(spark):
    rows = [(0.8, 0.95, "FACTUAL", "simple"), (1.5, 0.95, "FACTUAL", "simple"), (0.8, 0.6, "STATISTICAL", "simple"), (0.8, 0.5, "DIAGNOSTIC", "complex")]
    out = gates.route(spark.createDataFrame(rows, "entropy double, confidence double, query_type string, complexity string")).collect()
    assert [r.path for r in out] == ["fast", "slow", "fast", "slow"]
    assert out[1].reason == "high entropy (1.5 >= 1.5)" and out[3].reason.count(" + ") == 2


def test_query_predicates(spark):
    q = spark.createDataFrame([("Should I spray pesticide on my tomato crop in Coimbatore tomorrow?",), ("what about grain",), (None,)], "q string")
    out = q.select(gates.is_weather_query(F.col("q")), gates.location(F.col("q")), gates.crop_of(F.col("q"))).collect()
    assert [tuple(r) for r in out] == [(True, "Coimbatore", "tomato"), (True, rules.DEFAULT_LOCATION, "default"), (False, rules.DEFAULT_LOCATION, "default")]


@pytest.mark.parametrize(("stage", "key"), [("sowing", "nursery sowing"), ("flowering or fruiting", "flowering"), ("winter dormancy or harvesting", "harvesting"), ("fallow", "default"), ("Maturity ", "maturity"), ("", "default"), (None, "default")])
def test_stage_lookup(spark, stage, key):
    assert spark.createDataFrame([(stage,)], "s string").select(gates.stage_key(F.col("s"))).first()[0] == key


def test_stage_gate(spark):
    rows = spark.createDataFrame([(1, "about Harvesting and tillage", "land preparation"), (1, "TILLAGE first", "land preparation"), (1, "nothing", "land preparation"), (2, "storage", "maturity"), (3, "transplanting", "maturity")], "query_id long, text string, stage string")
    out = gates.stage_gate(rows).collect()
    assert [(r.compatible, r.matched_blocked, r.matched_allowed) for r in out] == [(False, "harvesting", None), (True, None, "tillage"), (True, None, None), (True, None, None), (False, "transplanting", None)]
    assert {(r.query_id, r.fell_back) for r in gates.apply_gate(gates.stage_gate(rows)).collect()} == {(1, False), (2, False), (3, True)}


def test_entropy(spark):
    rows = spark.createDataFrame([([math.log(0.5)] * 2,), ([],), (None,)], "lp array<double>")
    assert [r[0] for r in rows.select(gates.shannon_entropy(F.col("lp"))).collect()] == [0.5, 0.0, 0.0]
    text = spark.createDataFrame([("w " * 14,), ("w " * 15,), ("w " * 25,), (None,), ("",)], "t string")
    assert [r[0] for r in text.select(gates.entropy_proxy(F.col("t"))).collect()] == [0.8, 1.2, 2.0, 2.0, 0.8]


def test_weather(spark):
    rows = spark.createDataFrame([(30.0, 150.0), (36.0, 10.0), (10.0, 50.0), (20.0, 50.0)], "t double, r double")
    out = rows.select(weather.satellite_stage(F.col("t"), F.col("r")).alias("s")).select("s.*").collect()
    assert [(r.stage, r.confidence) for r in out] == [("active growth / monsoon stage", 0.7), ("dry season management", 0.6), ("dormancy or winter stage", 0.6), (None, 0.0)]
    soil = spark.createDataFrame([(0.31,), (0.30,), (0.15,), (None,)], "m double")
    assert [r[0] for r in soil.select(weather.soil_label(F.col("m"))).collect()] == ["WET — delay fertilizer application", "OPTIMAL — good time for fertilizer", "DRY — irrigate before fertilizing", "UNAVAILABLE"]


def test_threshold_goldens(spark):
    log = spark.createDataFrame([(i, p, a) for i, (p, a) in enumerate([("fast", True), ("fast", False), ("fast", False), ("slow", True), ("slow", True)])], "seq long, path string, was_accurate boolean")
    assert [r.threshold for r in feedback.thresholds(log).orderBy("seq").collect()] == [1.5, 1.5, 1.45, 1.40, 1.35]


def test_threshold_stays_in_bounds_and_stream_state_agrees(spark):
    from sheaf.streaming.feedback import advance

    rng = np.random.default_rng(5)
    rows = [(k, i, "fast" if rng.random() < 0.6 else "slow", bool(rng.random() < p)) for k, p in (("a", 0.97), ("b", 0.3)) for i in range(150)]
    out = feedback.thresholds(spark.createDataFrame(rows, "k string, seq long, path string, was_accurate boolean"), ("k",)).collect()
    assert all(0.8 <= r.threshold <= 2.5 for r in out) and {max(r.threshold for r in out), min(r.threshold for r in out)} == {2.5, 0.8}
    state = {k: (feedback.INITIAL, 0, 0, 0, 0, 0) for k in "ab"}
    want = {}
    for k, i, path, ok in rows:
        state[k] = advance(state[k], path, ok)
        want[k, i] = state[k][0]
    assert {(r.k, r.seq): r.threshold for r in out} == pytest.approx(want)


def test_graph(spark):
    rows = [(" Rice", "Needs", "Water", 0.9, "a", 1), ("rice", "likes", "water ", 0.8, "b", 2), ("water", "from", "rain", None, "c", 3), ("x", "y", "z", 0.5, "d", 4), ("", "y", "z", 0.9, "d", 5), ("rain", "in", "june", 0.9, "", 6)]
    t = spark.createDataFrame(rows, "subject string, relationship string, object string, confidence double, source_file string, seq long")
    nodes = {r.node: (r.mentions, r.node_type) for r in graph.nodes(t).collect()}
    assert nodes == {"rice": (2, "entity"), "water": (3, "value"), "rain": (2, "value"), "june": (1, "value")}
    edges = graph.edges(t)
    assert {(r.subject, r.object): r.relationship for r in edges.collect()} == {("rice", "water"): "likes", ("water", "rain"): "from", ("rain", "june"): "in"}
    starts = graph.resolve(graph.nodes(t), spark.createDataFrame([("RICE",), ("jun",), ("none",)], "entity string"))
    assert {(r.entity, r.node) for r in starts.collect()} == {("RICE", "rice"), ("jun", "june")}
    one = graph.khop(edges, starts.where("entity = 'RICE'"), 1)
    assert {(r.subject, r.object) for r in one.collect()} == {("rice", "water"), ("water", "rain")}


def test_even_sample_covers_each_source(spark):
    rows = spark.createDataFrame([("a", i) for i in range(1000)] + [("b", i) for i in range(5)], "s string, i long")
    out = graph.even_sample(rows, "s", "i", 150).collect()
    assert sorted(r.i for r in out if r.s == "a") == list(range(0, 1000, 6))[:150] and sum(r.s == "b" for r in out) == 5


def test_provenance(spark):
    answers = spark.createDataFrame([(1, "The quick brown fox jumps over. Completely zzz qqq vvv!")], "query_id long, answer string")
    chunks = spark.createDataFrame([(1, 1, "s1", "a quick fox", 0.8, "FRESH"), (1, 2, "s2", "the quick brown fox jumps over it", 0.6, "AGING")], "query_id long, chunk_rank int, source_file string, text string, temporal_score double, freshness_label string")
    found = provenance.overlap_match(provenance.split_answers(answers), chunks)
    out = found.orderBy("idx").collect()
    assert (out[0].matched_source, out[0].confidence, out[0].combined_score) == ("s2", 1.0, 0.8) and out[1].matched_source == "UNKNOWN"
    s = provenance.summary(found, None).first()
    assert (s.total_sentences, s.inferred_count, s.sources_used) == (2, 1, "s2")
    assert provenance.summary(found.where("false"), None).first().total_sentences == 0


def test_whole_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    corpus = docs.select(F.col("doc_id").alias("chunk_id"), "text", F.concat(F.lit("TNAU "), "source").alias("source_file"), F.lit(0.9).alias("trust_weight"))
    vectors = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    queries = spark.read.parquet(f"{data}/benchmark.parquet").limit(4).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit("short reply").alias("response"), F.lit("maturity").alias("stage"))
    queries = queries.join(vectors.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vec")), "query_id")
    out = pipeline.answer_queries(queries, corpus, vectors)
    assert out["routed"].count() == 4 and 0 < out["kept"].count() <= 20
    assert out["answers"].count() == 4 and out["summary"].count() == 4


def test_hashed_embedding_is_unit(spark):
    v = spark.createDataFrame([("red fox jumps high",), ("",)], "t string").select(providers.hashed_embedding(F.col("t"), 16).alias("v")).collect()
    assert np.linalg.norm(v[0].v) == pytest.approx(1.0, abs=1e-6) and not any(v[1].v)
