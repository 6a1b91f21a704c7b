"""Index, search, fusion, trust and freshness."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions.numbers import rounded
from sheaf.operators import lists, retrieval, trust
from sheaf.session import spread

from . import sql as Q
from .fixtures import REGISTRY
from .registry import query, scratch_folder, stored_index, table, texts
from .text_queries import META, metadata

K = 5


def corpus(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("source_file"))


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def questions(spark, d):
    """Benchmark items as queries; an item's vector is the one with its number."""
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).join(vec, "query_id", "left")


def source_trust(spark):
    """The known sources with their trust weight."""
    known = metadata(spark).withColumn("trust_weight", rounded(F.col("authority_score") * (1 - F.col("bias_penalty")), 4))
    return known.withColumn("trust_weight", F.when(F.col("source_file") == "src3", 0.0).otherwise(F.col("trust_weight")))


def trust_dim(spark, d):
    return corpus(spark, d).select("chunk_id", "source_file").join(source_trust(spark).select("source_file", "trust_weight"), "source_file", "left").select("chunk_id", "trust_weight")


TRUST = f"""{META},
tw AS (SELECT doc_id AS chunk_id, CASE WHEN source = 'src3' THEN 0.0 ELSE {Q.rnd('authority_score * (1 - bias_penalty)', 4)} END AS trust_weight FROM documents LEFT JOIN meta ON source_file = source)"""


def dense(spark, d, k):
    return retrieval.dense_topk(vectors(spark, d), questions(spark, d), k)


def sparse(spark, d, k, stop_words=None):
    return retrieval.sparse_topk(stored_index(spark, d), questions(spark, d).select("query_id", "query"), k, stop_words)


@query("term_stats", f"WITH {Q.BM25} SELECT term, df, round(idf, 6) AS idf FROM idf")
def term_stats(spark, d):
    return stored_index(spark, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query("postings", f"WITH {Q.BM25} SELECT term, chunk_id, tf, dl AS doc_len FROM po")
def postings(spark, d):
    return retrieval.postings(texts(spark, d).select(F.col("doc_id").alias("chunk_id"), "text")).select("term", "chunk_id", "tf", "doc_len")


@query("sparse_topk", f"WITH {Q.sparse(10)} SELECT query_id, chunk_id, sparse_score, sparse_rank FROM sparse")
def sparse_topk(spark, d):
    return sparse(spark, d, 10)


@query("sparse_after_changes", f"""WITH {Q.sparse(10).replace('FROM documents)', "FROM changed)").replace('WITH', '').replace('c AS (', "changed AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || ' ' || text ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0), c AS (", 1)}
SELECT query_id, chunk_id, sparse_score, sparse_rank FROM sparse""")
def sparse_after_changes(spark, d):
    """Search of an index that came to its state by changes: half the documents, then the others, edited texts in place of some, others deleted, small segments merged."""
    from sheaf.sources import segments

    path = scratch_folder(spark)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    even = F.col("chunk_id") % 2 == 0
    segments.rebuild(spread(docs.where(even)), path)
    segments.upsert(docs.where(~even), path)
    segments.upsert(docs.where("chunk_id % 7 = 0").withColumn("text", F.concat("text", F.lit(" "), "text")), path)
    segments.delete(docs.where("chunk_id % 5 = 0").select("chunk_id"), path)
    segments.compact(spark, path, most=2)
    segments.vacuum(spark, path)
    return retrieval.sparse_topk(segments.open_index(spark, path), questions(spark, d).select("query_id", "query"), 10)


@query("dense_topk", f"WITH {Q.dense(10)} SELECT query_id, chunk_id, dense_score, dense_rank FROM dense")
def dense_topk(spark, d):
    return dense(spark, d, 10)


#: Every hundredth vector asks for its neighbours among all.
NEAR = """dn AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS dense_score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, chunk_id) AS dense_rank FROM dn) WHERE dense_rank <= 10)"""


def hundredths(spark, d):
    return vectors(spark, d).where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vec"))


@query("vector_lists_all", f"WITH {NEAR} SELECT query_id, chunk_id, dense_score, dense_rank FROM near")
def vector_lists_all(spark, d):
    """The index by lists, all of them read: as exact as search without it."""
    index = lists.build(vectors(spark, d))
    return lists.search(index, hundredths(spark, d), 10, len(index.centroids))


@query("vector_lists_recall", "SELECT count(*) AS n_queries, true AS at_least_090 FROM embeddings WHERE vec_id % 100 = 0")
def vector_lists_recall(spark, d):
    """What the lists that a query reads by default find of the ten nearest."""
    asked = hundredths(spark, d)
    found = lists.search(lists.build(vectors(spark, d)), asked, 10)
    return lists.recall(found, retrieval.dense_topk(vectors(spark, d), asked, 10)).select("n_queries", (F.col("recall") >= 0.9).alias("at_least_090"))


@query("dense_label_agreement", f"WITH {Q.dense(10)} SELECT round(avg(CASE WHEN e.label = q.label THEN 1.0 ELSE 0.0 END), 6) AS agreement, count(*) AS n FROM dense JOIN embeddings e ON e.vec_id = chunk_id JOIN embeddings q ON q.vec_id = query_id")
def dense_label_agreement(spark, d):
    e = table(spark, d, "embeddings")
    found = dense(spark, d, 10).join(e.select(F.col("vec_id").alias("chunk_id"), "label"), "chunk_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return found.agg(F.round(F.avg(F.when(F.col("label") == F.col("own"), 1.0).otherwise(0.0)), 6).alias("agreement"), F.count("*").alias("n"))


def _hybrid_sql(weight: str, k: int = K) -> str:
    return f"""{Q.sparse(2 * k)}, {Q.dense(2 * k)}, {Q.MERGED}, {TRUST},
hy AS (SELECT me.*, {weight} AS trust_weight FROM me LEFT JOIN tw USING (chunk_id)),
hs AS (SELECT *, {Q.rnd('(0.6 * dense_score + 0.4 * sparse_score) * trust_weight', 4)} AS final_score FROM hy),
hybrid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id) AS rank FROM hs) WHERE rank <= {k})"""


_AS_ONE = "CASE WHEN coalesce(trust_weight, 1.0) <= 0 THEN 1.0 ELSE coalesce(trust_weight, 1.0) END"


@query("hybrid_topk", f"WITH {_hybrid_sql(_AS_ONE)} SELECT query_id, chunk_id, dense_score, sparse_score, trust_weight, final_score, {Q.FOUND_BY} AS found_by, rank FROM hybrid")
def hybrid_topk(spark, d):
    return retrieval.hybrid(dense(spark, d, 2 * K), sparse(spark, d, 2 * K), trust_dim(spark, d), K).select("query_id", "chunk_id", "dense_score", "sparse_score", "trust_weight", "final_score", "found_by", "rank")


@query("gate_hybrid_topk", f"WITH {_hybrid_sql('coalesce(trust_weight, 1.0)')} SELECT query_id, chunk_id, final_score, rank FROM hybrid")
def gate_hybrid_topk(spark, d):
    """Raw trust, so an untrusted source scores 0; the gate's shorter stop list gives the same scores up to words of both lists' difference."""
    return retrieval.hybrid(dense(spark, d, 2 * K), sparse(spark, d, 2 * K), trust_dim(spark, d), K, nonpositive_trust_as_one=False).select("query_id", "chunk_id", "final_score", "rank")


def _rrf_sql(k: int) -> str:
    return f"""rf AS (SELECT *, {Q.rnd(f'1.0 / (60 + coalesce(dense_rank, {3 * k + 1})) + 1.0 / (60 + coalesce(sparse_rank, {3 * k + 1}))', 6)} AS rrf_score FROM me),
rrf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS rank FROM rf) WHERE rank <= {k})"""


@query("rrf_topk", f"WITH {Q.sparse(3 * K)}, {Q.dense(3 * K)}, {Q.MERGED}, {_rrf_sql(K)} SELECT query_id, chunk_id, rrf_score, dense_rank, sparse_rank, {Q.FOUND_BY} AS found_by, rank FROM rrf")
def rrf_topk(spark, d):
    return retrieval.rrf(dense(spark, d, 3 * K), sparse(spark, d, 3 * K), K).select("query_id", "chunk_id", "rrf_score", "dense_rank", "sparse_rank", "found_by", "rank")


@query("method_compare", f"""WITH {Q.sparse(9).replace('sparse AS', 'sparse9 AS')}, {Q.dense(9).replace('dense AS', 'dense9 AS')},
sparse AS (SELECT * FROM sparse9), dense AS (SELECT * FROM dense9), {Q.MERGED}, {_rrf_sql(3)}, {TRUST},
m6 AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.chunk_id, s.chunk_id) AS chunk_id, coalesce(dense_score, 0.0) AS dense_score, coalesce(sparse_score, 0.0) AS sparse_score
  FROM (SELECT * FROM dense9 WHERE dense_rank <= 6) d FULL JOIN (SELECT * FROM sparse9 WHERE sparse_rank <= 6) s ON d.query_id = s.query_id AND d.chunk_id = s.chunk_id),
hs AS (SELECT query_id, chunk_id, {Q.rnd('(0.6 * dense_score + 0.4 * sparse_score) * ' + _AS_ONE, 4)} AS score FROM m6 LEFT JOIN tw USING (chunk_id)),
hy AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM hs)
SELECT 'dense' AS method, query_id, dense_rank AS rank, chunk_id, dense_score AS score FROM dense WHERE dense_rank <= 3
UNION ALL SELECT 'sparse', query_id, sparse_rank, chunk_id, sparse_score FROM sparse WHERE sparse_rank <= 3
UNION ALL SELECT 'hybrid', query_id, rank, chunk_id, score FROM hy WHERE rank <= 3
UNION ALL SELECT 'rrf', query_id, rank, chunk_id, rrf_score FROM rrf""")
def method_compare(spark, d):
    return retrieval.compare(dense(spark, d, 9), sparse(spark, d, 9), trust_dim(spark, d), 3)


# --- trust ----------------------------------------------------------------------------------------------------------

def results(spark, d):
    """Every document as a result of the query its language names, with scores from its numbers."""
    docs = corpus(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("query_id"), "n_chars"), "chunk_id")
    meta = metadata(spark).select("source_file", "authority_score", "bias_penalty")
    final = rounded((F.col("chunk_id") * 37 % 1009) / 1009, 4)
    return docs.join(meta, "source_file", "left").select("query_id", "chunk_id", "source_file", final.alias("final_score"), "authority_score", "bias_penalty", F.lit(0.9).alias("trust_weight"))


RESULTS = f"""{META},
re AS (SELECT lang AS query_id, doc_id AS chunk_id, source AS source_file, {Q.rnd('(doc_id * 37 % 1009) / 1009', 4)} AS final_score, authority_score AS a0, bias_penalty FROM documents LEFT JOIN meta ON source_file = source),
ra AS (SELECT *, coalesce(a0, 0.9, 1.0) AS authority_score, {Q.rnd('final_score * (coalesce(a0, 0.9, 1.0) * (1 - coalesce(bias_penalty, 0.0)))', 4)} AS ra_score FROM re),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ra_score DESC, chunk_id) AS ra_rank FROM ra),
ms AS (SELECT *, CASE WHEN ra_score < 0.35 THEN 1.0 ELSE 0.2 * (1 + chunk_id % 5) END AS mscp_score, ra_score < 0.35 AS skipped FROM rr WHERE chunk_id % 7 <> 3 OR ra_score < 0.35
  UNION ALL SELECT *, 0.5, false FROM rr WHERE chunk_id % 7 = 3 AND NOT ra_score < 0.35),
mt AS (SELECT *, skipped OR chunk_id % 7 = 3 OR mscp_score >= 0.55 AS trusted FROM ms),
ft AS (SELECT *, {Q.rnd('ra_score * mscp_score * authority_score', 4)} AS final_trust FROM mt),
fp AS (SELECT *, trusted AND final_trust >= 0.22 AS passes FROM ft),
fb AS (SELECT *, NOT bool_or(passes) OVER (PARTITION BY query_id) AND row_number() OVER (PARTITION BY query_id ORDER BY final_trust DESC, chunk_id) = 1 AS fallback FROM fp)"""


def consistency(spark, d):
    r = results(spark, d).where(F.col("chunk_id") % 7 != 3)
    return r.select("query_id", "chunk_id", (0.2 * (1 + F.col("chunk_id") % 5)).alias("mscp_score"))


@query("authority_rerank", f"WITH {RESULTS} SELECT query_id, chunk_id, final_score, ra_score, ra_rank FROM rr")
def authority_rerank(spark, d):
    return trust.rerank_by_authority(results(spark, d)).select("query_id", "chunk_id", "final_score", "ra_score", "ra_rank")


@query("final_trust", f"WITH {RESULTS} SELECT query_id, chunk_id, ra_score, mscp_score, final_trust, passes OR fallback AS included, CASE WHEN fallback THEN 'fallback_best_available' WHEN skipped THEN 'below_min_score_skipped' WHEN chunk_id % 7 = 3 THEN 'no_samples_returned' WHEN mscp_score >= 0.55 THEN 'consistent' ELSE 'inconsistent_answers' END AS reason FROM fb")
def final_trust(spark, d):
    return trust.trust_pipeline(results(spark, d), consistency(spark, d)).select("query_id", "chunk_id", "ra_score", "mscp_score", "final_trust", "included", "reason")


@query("trust_report", f"WITH {RESULTS} SELECT query_id, count(*) AS total, count(*) FILTER (WHERE passes OR fallback) AS trusted_count, count(*) FILTER (WHERE NOT (passes OR fallback)) AS excluded_count, bool_or(NOT skipped) AS lcr_ran FROM fb GROUP BY query_id")
def trust_report(spark, d):
    return trust.trust_report(trust.trust_pipeline(results(spark, d), consistency(spark, d)))


@query("trust_fallback", f"""WITH f AS (SELECT source AS query_id, doc_id AS chunk_id, {Q.rnd(Q.rnd("(doc_id * 37 % 1009) / 5045", 4) + " * 0.9", 4)} AS final_trust FROM documents),
p AS (SELECT *, final_trust >= 0.22 AS passes FROM f), b AS (SELECT *, NOT bool_or(passes) OVER (PARTITION BY query_id) AND row_number() OVER (PARTITION BY query_id ORDER BY final_trust DESC, chunk_id) = 1 AS fallback FROM p)
SELECT query_id, chunk_id, final_trust, CASE WHEN fallback THEN 'fallback_best_available' ELSE 'lcr_skipped_fast_path' END AS reason FROM b WHERE passes OR fallback""")
def trust_fallback(spark, d):
    """Scores so low that most queries fall back to their best result."""
    r = corpus(spark, d).select(F.col("source_file").alias("query_id"), "chunk_id", rounded((F.col("chunk_id") * 37 % 1009) / 5045, 4).alias("ra_score"), F.lit(0.9).alias("authority_score"))
    return trust.final_trust(trust.with_consistency(r)).where("included").select("query_id", "chunk_id", "final_trust", "reason")


# --- freshness ------------------------------------------------------------------------------------------------------

TYPES = {"en": "RECOMMENDATION", "fr": "FACTUAL", "de": "DIAGNOSTIC", "es": "OTHER"}
_low = "lower(source)"
FRESH = f"""
kt AS (SELECT doc_id, lang, source, {Q.first_contained(_low, [k for k, _, _ in REGISTRY])} AS key, CASE lang WHEN 'en' THEN 0.10 WHEN 'fr' THEN 0.03 WHEN 'de' THEN 0.07 ELSE 0.05 END AS rate FROM documents),
rg(key, base, pub) AS (VALUES {Q.rows(REGISTRY)}),
rw AS (SELECT kt.*, greatest(0, 2025 - pub) AS age_years, base * exp(-rate * greatest(0, 2025 - pub)) AS raw FROM kt LEFT JOIN rg USING (key)),
fr AS (SELECT doc_id, key AS temporal_source_match, age_years, coalesce({Q.rnd('raw', 4)}, 0.5) AS temporal_score,
  CASE WHEN raw IS NULL THEN 'OUTDATED' WHEN raw >= 0.85 THEN 'FRESH' WHEN raw >= 0.70 THEN 'ACCEPTABLE' WHEN raw >= 0.55 THEN 'AGING' ELSE 'OUTDATED' END AS freshness_label, lang FROM rw)"""


def fresh(spark, d):
    r = table(spark, d, "documents").select("doc_id", F.col("lang").alias("query_id"), "source", F.col("doc_id").alias("retrieval_rank"))
    kind = F.coalesce(*(F.when(F.col("query_id") == k, F.lit(v)) for k, v in TYPES.items()))
    return trust.temporal_decay(r, "source", kind, registry=REGISTRY)


@query("temporal_decay", f"WITH {FRESH} SELECT doc_id, temporal_source_match, age_years, temporal_score, freshness_label, row_number() OVER (PARTITION BY lang ORDER BY temporal_score DESC, doc_id) AS temporal_rank FROM fr")
def temporal_decay(spark, d):
    return fresh(spark, d).select("doc_id", "temporal_source_match", "age_years", "temporal_score", "freshness_label", "temporal_rank")


@query("stale_filter", f"WITH {FRESH} SELECT doc_id, temporal_score FROM fr WHERE temporal_score >= 0.55")
def stale_filter(spark, d):
    return trust.filter_stale(fresh(spark, d)).select("doc_id", "temporal_score")


@query("mscp", """WITH g AS (SELECT label AS query_id, CAST(floor(vec_id / 5) AS BIGINT) AS chunk_id, embedding::DOUBLE[] AS e, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY label, floor(vec_id / 5)) AS n FROM embeddings WINDOW w AS (PARTITION BY label, floor(vec_id / 5) ORDER BY vec_id)),
ps AS (SELECT a.query_id, a.chunk_id, list({'i': a.i, 'j': b.i, 'd': list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))}) AS p FROM g a JOIN g b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id AND a.i < b.i GROUP BY ALL),
gr AS (SELECT DISTINCT query_id, chunk_id, n FROM g),
lb AS (SELECT gr.*, l, list_transform(range(n), lambda i: (l // CAST(pow(3, n - 1 - i) AS BIGINT)) % 3) AS c FROM gr, range(243) t(l) WHERE l < pow(3, n)),
ok AS (SELECT *, list_transform([0, 1, 2], lambda k: len(list_filter(c, lambda y: y = k))) AS s FROM lb WHERE list_max(c) < least(3, n)),
sc AS (SELECT ok.*, round(list_sum(list_transform(p, lambda x: CASE WHEN c[x.i + 1] = c[x.j + 1] THEN x.d / s[c[x.i + 1] + 1] ELSE 0.0 END)), 9) AS inertia FROM ok JOIN ps USING (query_id, chunk_id)),
be AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY inertia, len(list_filter(s, lambda y: y > 0)), l) AS k FROM sc)
SELECT query_id, chunk_id, CAST(round(list_max(s) / n, 4) AS DOUBLE) AS mscp_score FROM be WHERE k = 1 UNION ALL SELECT query_id, chunk_id, 1.0 FROM gr WHERE n = 1""")
def mscp(spark, d):
    """Each label's vectors in fives as sampled answers of a chunk."""
    e = table(spark, d, "embeddings").select(F.col("label").alias("query_id"), F.floor(F.col("vec_id") / 5).alias("chunk_id"), F.col("vec_id").alias("sample"), "embedding")
    return trust.mscp(e)


@query("mscp_share", f"WITH l AS (SELECT doc_id % 50 AS g, lang FROM documents), c AS (SELECT g, lang, count(*) AS n FROM l GROUP BY g, lang) SELECT g, CASE WHEN sum(n) < 2 THEN 1.0 ELSE {Q.rnd('max(n) / sum(n)', 4)} END AS share FROM c GROUP BY g")
def mscp_share(spark, d):
    g = table(spark, d, "documents").groupBy((F.col("doc_id") % 50).alias("g")).agg(F.collect_list("lang").alias("labels"))
    return g.select("g", trust.largest_share(F.col("labels")).alias("share"))
