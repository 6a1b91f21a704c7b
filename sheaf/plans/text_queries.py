"""Cleaning, tokenising, chunking, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import text as T
from sheaf.operators import chunking, providers, statistics
from sheaf.sources import documents as S

from . import sql as Q
from .fixtures import SOURCES, WORDS
from .registry import query, table, texts


def metadata(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "source_file string, title string, source_org string, year int, authority_score double, bias_penalty double")


META = f"meta(source_file, title, source_org, year, authority_score, bias_penalty) AS (VALUES {Q.rows(SOURCES)})"


@query("clean_text", f"SELECT doc_id, {Q.clean('text')} AS text FROM documents")
def clean_text(spark, d):
    return texts(spark, d).select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query("clean_stats", f"""SELECT source AS filename, sum(b) AS chars_before, sum(a) AS chars_after, sum(b) - sum(a) AS chars_removed,
  round((sum(b) - sum(a)) / greatest(sum(b), 1) * 100, 1) AS reduction_pct FROM (SELECT source, length(text) AS b, length({Q.clean('text')}) AS a FROM documents) GROUP BY source""")
def clean_stats(spark, d):
    pages = texts(spark, d).select(F.col("source").alias("filename"), "text", F.array().cast("array<string>").alias("tables_text"))
    return S.cleaning_stats(S.clean_pages(pages))


@query("bm25_tokens", f"SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {Q.tokens('text')} AS t FROM documents)")
def bm25_tokens(spark, d):
    t = texts(spark, d).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query("gate_tokens", f"SELECT item_id, array_to_string({Q.tokens('text', T.GATE_STOP_WORDS)}, ' ') AS tokens FROM benchmark")
def gate_tokens(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.tokens(F.col("text"), T.GATE_STOP_WORDS), " ").alias("tokens"))


@query("avg_tokens", f"SELECT count(*) AS n_docs, round(avg(len({Q.tokens('text')})), 4) AS avg_tokens FROM documents")
def avg_tokens(spark, d):
    return statistics.average_tokens(texts(spark, d))


@query("sentence_split", f"SELECT doc_id, unnest(range(len(s))) AS idx, unnest(s) AS sentence FROM (SELECT doc_id, {Q.sentences('text')} AS s FROM documents)")
def sentence_split(spark, d):
    return chunking.sentence_rows(texts(spark, d), "doc_id")


VARIED = "CASE idx % 4 WHEN 0 THEN 'Season ' || sentence WHEN 1 THEN '12) A' || sentence WHEN 2 THEN 'ABCDEFG (' || upper(substr(sentence, 1, 0)) || 'H)' ELSE sentence END"


@query("hard_boundary", f"""WITH s AS (SELECT doc_id, idx, {VARIED} AS sentence FROM (SELECT doc_id, unnest(range(len(s))) AS idx, unnest(s) AS sentence FROM (SELECT doc_id, {Q.sentences('text')} AS s FROM documents)))
SELECT doc_id, idx, {Q.hard('sentence')} AS hard FROM s""")
def hard_boundary(spark, d):
    """Sentences made into headers, numbered lines and capitals by turns: the texts have none of their own."""
    i = F.col("idx") % 4
    varied = F.when(i == 0, F.concat(F.lit("Season "), "sentence")).when(i == 1, F.concat(F.lit("12) A"), "sentence")).when(i == 2, "ABCDEFG (H)").otherwise(F.col("sentence"))
    return chunking.sentence_rows(texts(spark, d), "doc_id").select("doc_id", "idx", T.is_hard_boundary(varied).alias("hard"))


CHUNKS = f"""
se AS (SELECT doc_id, unnest(range(len(s))) AS idx, unnest(s) AS sentence FROM (SELECT doc_id, {Q.sentences('text')} AS s FROM documents)),
fl AS (SELECT *, length(sentence) AS n, {Q.hard('sentence')} OR coalesce(NOT (length(lag(sentence) OVER w) >= 20 AND length(sentence) >= 20), false) AS cut FROM se WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
fo AS (SELECT doc_id, idx, 0 AS no, n AS len FROM fl WHERE idx = 0
       UNION ALL SELECT f.doc_id, f.idx, fo.no + CASE WHEN cut OR fo.len + n > 500 THEN 1 ELSE 0 END, CASE WHEN cut OR fo.len + n > 500 THEN n ELSE fo.len + n END
       FROM fo JOIN fl f ON f.doc_id = fo.doc_id AND f.idx = fo.idx + 1),
ch AS (SELECT doc_id, no, trim(string_agg(sentence, ' ' ORDER BY idx)) AS text FROM fo JOIN fl USING (doc_id, idx) GROUP BY doc_id, no),
chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS INTEGER) AS chunk_no, text FROM ch WHERE length(text) >= 50)"""


def chunk_rows(spark, d):
    return chunking.chunks(texts(spark, d), "doc_id", next_score=chunking.lexical_next)


@query("hdr_chunk", f"WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk_no, text FROM chunks")
def hdr_chunk(spark, d):
    return chunk_rows(spark, d)


@query("hdr_chunk_scored", f"WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk_no, text FROM chunks")
def hdr_chunk_scored(spark, d):
    """The same chunks with the pairs scored in batches outside the plan, as a model would score them."""
    from sheaf.operators.pairs import PairScorer

    by_length = PairScorer(lambda: 20, lambda least, a, b: [float(len(x) >= least and len(y) >= least) for x, y in zip(a, b, strict=True)])
    return chunking.chunks(texts(spark, d), "doc_id", next_score=by_length)


TAGS = ("tea", "rice", "rose", *WORDS)


@query("chunk_ids", f"""WITH RECURSIVE {CHUNKS}, {META}
SELECT 'chunk_' || CASE WHEN k < 1000000 THEN lpad(CAST(k AS VARCHAR), 6, '0') ELSE CAST(k AS VARCHAR) END AS chunk_id, source_file, char_count, title, source_org, year, trust_weight
FROM (SELECT row_number() OVER (ORDER BY c.doc_id, chunk_no) AS k, d.source AS source_file, length(c.text) AS char_count, coalesce(m.title, d.source) AS title, coalesce(m.source_org, '') AS source_org,
  coalesce(m.year, 2023) AS year, {Q.rnd('coalesce(m.authority_score, 0.8) * (1 - coalesce(m.bias_penalty, 0.0))', 4)} AS trust_weight
  FROM chunks c JOIN documents d USING (doc_id) LEFT JOIN meta m ON m.source_file = d.source)""")
def chunk_ids(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("source_file"))
    meta = metadata(spark).withColumn("region", F.lit(None).cast("string")).withColumn("domain", F.lit(None).cast("string"))
    full = chunking.with_metadata(chunk_rows(spark, d).join(docs, "doc_id"), meta)
    shown = ["source_file", "char_count", "title", "source_org", "year", "trust_weight"]
    # the texts are not shown, so they are neither sorted nor written
    return chunking.with_ids(full.select("doc_id", "chunk_no", *shown), ["doc_id", "chunk_no"], 1).select("chunk_id", *shown)


@query("crop_tags", f"SELECT doc_id, array_to_string(list_filter({Q.array(TAGS)}, lambda c: contains(lower(text), c)), ',') AS tags FROM documents")
def crop_tags(spark, d):
    return texts(spark, d).select("doc_id", F.array_join(T.crop_tags(F.col("text"), TAGS), ",").alias("tags"))


@query("full_text_build", """SELECT source AS filename, length(t) AS n, md5(t) AS digest FROM (SELECT source, string_agg(text || chr(10) || substr(text, 1, 20) || chr(10), '' ORDER BY doc_id) AS t FROM documents GROUP BY source)""")
def full_text_build(spark, d):
    pages = table(spark, d, "documents").select(F.col("source").alias("filename"), F.col("doc_id").alias("page_number"), "text", F.array(F.substring("text", 1, 20)).alias("tables_text"))
    return chunking.full_text(pages).select("filename", F.length("text").alias("n"), F.md5("text").alias("digest"))


@query("table_to_text", """SELECT event_id, concat_ws(chr(10), CASE WHEN event_type <> '' THEN 'Type: ' || event_type || ' | User: ' || CAST(user_id AS VARCHAR) END,
  CASE WHEN event_id % 3 > 0 THEN 'Type: again' END) AS text FROM events""")
def table_to_text(spark, d):
    rows = F.array(
        F.array(F.lit("Type "), F.lit("User"), F.lit("")),
        F.array(F.col("event_type"), F.col("user_id").cast("string"), F.lit("no header")),
        F.array(F.when(F.col("event_id") % 3 > 0, F.lit(" again ")), F.lit(None).cast("string")),
    )
    return table(spark, d, "events").select("event_id", chunking.table_to_text(rows).alias("text"))


@query("previews", "SELECT doc_id, replace(substr(text, 1, 200), chr(10), ' ') AS long_preview, replace(substr(text, 1, 150), chr(10), ' ') AS preview FROM documents")
def previews(spark, d):
    return table(spark, d, "documents").select("doc_id", T.preview(F.col("text")).alias("long_preview"), T.preview(F.col("text"), 150).alias("preview"))


CONTEXT = """r AS (SELECT source AS query_id, doc_id AS chunk_id, lang AS source_file, text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS chunk_rank FROM documents)"""


def _context_chunks(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("chunk_id"), F.col("lang").alias("source_file"), "text", "n_chars")
    return providers.renumber(docs, [F.desc("n_chars"), "chunk_id"])


@query("context_pack", f"""WITH {CONTEXT}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_file ORDER BY chunk_rank) AS f FROM r WHERE chunk_rank <= 5)
SELECT query_id, string_agg('[Source: ' || source_file || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_rank) AS context,
  string_agg(source_file, ', ' ORDER BY chunk_rank) FILTER (WHERE f = 1) AS sources FROM o GROUP BY query_id""")
def context_pack(spark, d):
    return providers.context(_context_chunks(spark, d), 5, True)


@query("context_pack_fast", f"WITH {CONTEXT} SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_rank) AS context FROM r WHERE chunk_rank <= 3 GROUP BY query_id")
def context_pack_fast(spark, d):
    return providers.context(_context_chunks(spark, d), 3, False).select("query_id", "context")


@query("answer_extractive", f"""WITH {CONTEXT}, a AS (SELECT query_id, chunk_rank, list_slice({Q.answer_sentences('text')}, 1, 2) AS s FROM (SELECT * FROM r WHERE chunk_rank <= 3))
SELECT query_id, string_agg(array_to_string(s, ' '), ' ' ORDER BY chunk_rank) AS answer FROM a GROUP BY query_id""")
def answer_extractive(spark, d):
    return providers.extractive_answer(_context_chunks(spark, d), 3)


@query("pattern_triplets", r"""SELECT string_split(m, ' is ')[1] AS subject, 'is' AS relationship, string_split(m, ' is ')[2] AS object, CAST(0.8 AS DOUBLE) AS confidence, source_file, chunk_text, chunk_id
FROM (SELECT doc_id AS chunk_id, source AS source_file, substr(text, 1, 200) AS chunk_text, unnest(regexp_extract_all(substr(text, 1, 1500), '[\p{L}\p{N}_]+ is [\p{L}\p{N}_]+')) AS m FROM documents)""")
def pattern_triplets(spark, d):
    """The model's window of 1500 characters is the provider's own."""
    docs = texts(spark, d).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_file"), "text")
    return providers.pattern_triplets(docs)
