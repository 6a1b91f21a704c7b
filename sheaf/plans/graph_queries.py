"""Knowledge graph, provenance, feedback, stores, statistics, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.operators import feedback, graph, provenance, statistics
from sheaf.sources import documents as S
from sheaf.sources import registry as reg

from . import sql as Q
from .registry import query, scratch_folder, table, texts
from .retrieval_queries import FRESH, fresh
from .text_queries import CHUNKS


def triplets(spark, d):
    """Line items as facts: a supplier supplies a part."""
    t = table(spark, d, "lineitem")
    return t.select(
        F.concat(F.lit(" Supplier#"), "l_suppkey").alias("subject"), F.concat(F.lit("supplies "), "l_returnflag").alias("relationship"), F.concat(F.lit("Part#"), "l_partkey", F.lit(" ")).alias("object"),
        F.when(F.col("l_linenumber") != 2, F.col("l_discount") * 5 + 0.5).alias("confidence"), F.col("l_linestatus").alias("source_file"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"))


USABLE = """us AS (SELECT 'supplier#' || l_suppkey AS subject, 'supplies ' || lower(l_returnflag) AS relationship, 'part#' || l_partkey AS object,
  coalesce(CASE WHEN l_linenumber <> 2 THEN l_discount * 5 + 0.5 END, 0.8) AS confidence, l_linestatus AS source_file, l_orderkey * 8 + l_linenumber AS seq FROM lineitem),
ok AS (SELECT * FROM us WHERE confidence >= 0.7),
ed AS (SELECT subject, object, arg_max(relationship, seq) AS relationship, arg_max(source_file, seq) AS source_file FROM ok GROUP BY subject, object)"""


@query("triplet_edges", f"WITH {USABLE} SELECT subject, relationship, object, source_file FROM ed")
def triplet_edges(spark, d):
    return graph.edges(triplets(spark, d)).select("subject", "relationship", "object", "source_file")


@query("node_mentions", f"WITH {USABLE} SELECT node, count(*) AS mentions, min_by(role, place) AS node_type FROM (SELECT subject AS node, 'entity' AS role, seq * 2 AS place FROM ok UNION ALL SELECT object, 'value', seq * 2 + 1 FROM ok) GROUP BY node")
def node_mentions(spark, d):
    return graph.nodes(triplets(spark, d))


@query("degree_top10", f"WITH {USABLE} SELECT node, count(*) AS degree FROM (SELECT subject AS node FROM ed UNION ALL SELECT object FROM ed) GROUP BY node ORDER BY degree DESC, node LIMIT 10")
def degree_top10(spark, d):
    return graph.degrees(graph.edges(triplets(spark, d))).orderBy(F.desc("degree"), "node").limit(10)


@query("rel_hist", f"WITH {USABLE} SELECT relationship, count(*) AS n FROM ed GROUP BY relationship ORDER BY n DESC, relationship LIMIT 10")
def rel_hist(spark, d):
    return graph.relationship_histogram(graph.edges(triplets(spark, d))).orderBy(F.desc("n"), "relationship").limit(10)


@query("distinct_facts", f"WITH {USABLE} SELECT count(DISTINCT subject) AS subjects, count(DISTINCT relationship) AS relationships, count(DISTINCT object) AS objects FROM ok")
def distinct_facts(spark, d):
    return statistics.distinct_values(graph.usable(triplets(spark, d)), subjects="subject", relationships="relationship", objects="object")


def place_edges(spark, d):
    """Suppliers in nations in regions."""
    n, r, s = (table(spark, d, t) for t in ("nation", "region", "supplier"))
    inside = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.lower("s_name").alias("subject"), F.lit("in").alias("relationship"), F.lower("n_name").alias("object"))
    part = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("n_name").alias("subject"), F.lit("part of").alias("relationship"), F.lower("r_name").alias("object"))
    return inside.unionByName(part).withColumn("source_file", F.lit("places"))


PLACES = """pe AS (SELECT lower(s_name) AS subject, 'in' AS relationship, lower(n_name) AS object FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT lower(n_name), 'part of', lower(r_name) FROM nation JOIN region ON n_regionkey = r_regionkey),
bo AS (SELECT subject AS a, object AS b FROM pe UNION ALL SELECT object, subject FROM pe), st AS (SELECT n_name AS entity, lower(n_name) AS node FROM nation)"""
TOUCH = "SELECT DISTINCT entity, subject, relationship, object FROM pe JOIN re ON subject = node OR object = node"


@query("khop_edges", f"WITH {PLACES}, re AS (SELECT * FROM st UNION SELECT entity, b FROM st JOIN bo ON a = node) {TOUCH}")
def khop_edges(spark, d):
    e = place_edges(spark, d)
    names = e.select(F.explode(F.array("subject", "object")).alias("node")).distinct()
    starts = graph.resolve(names, table(spark, d, "nation").select(F.col("n_name").alias("entity")))
    return graph.khop(e, starts, 1).drop("source_file")


@query("khop2_count", f"WITH {PLACES}, r1 AS (SELECT * FROM st UNION SELECT entity, b FROM st JOIN bo ON a = node), re AS (SELECT * FROM r1 UNION SELECT entity, b FROM r1 JOIN bo ON a = node) SELECT entity, count(*) AS n FROM ({TOUCH}) GROUP BY entity")
def khop2_count(spark, d):
    starts = table(spark, d, "nation").select(F.col("n_name").alias("entity"), F.lower("n_name").alias("node"))
    return graph.khop(place_edges(spark, d), starts, 2).groupBy("entity").agg(F.count("*").alias("n"))


@query("partial_node_match", f"WITH {PLACES}, nd AS (SELECT subject AS node FROM pe UNION SELECT object FROM pe) SELECT entity, min(node) AS node FROM (SELECT r_name AS entity, lower(substr(r_name, 2, 3)) AS q FROM region) JOIN nd ON contains(node, q) GROUP BY entity")
def partial_node_match(spark, d):
    e = place_edges(spark, d)
    names = e.select(F.explode(F.array("subject", "object")).alias("node")).distinct()
    parts = table(spark, d, "region").select("r_name", F.substring("r_name", 2, 3).alias("entity"))
    return graph.resolve(names, parts.select("entity")).join(parts, "entity").select(F.col("r_name").alias("entity"), "node")


@query("triplet_context", f"WITH {PLACES} SELECT object, string_agg(subject || ' → ' || relationship || ' → ' || object || '  [Source: places]', chr(10) ORDER BY subject) AS context FROM pe GROUP BY object")
def triplet_context(spark, d):
    e = place_edges(spark, d).withColumn("l", graph.triplet_line(F.col("subject"), F.col("relationship"), F.col("object"), F.col("source_file")))
    return e.groupBy("object").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("subject", "l"))), lambda x: x["l"]), "\n").alias("context"))


@query("even_sample", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, greatest(1, count(*) OVER (PARTITION BY source) // 150) AS s FROM documents) WHERE k % s = 0 AND k // s < 150")
def even_sample(spark, d):
    return graph.even_sample(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 150).select("doc_id")


@query("unprocessed_chunks", "SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 3)")
def unprocessed_chunks(spark, d):
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"))
    facts = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("chunk_id"))
    seen = table(spark, d, "embeddings").where("label = 3").select(F.col("vec_id").alias("chunk_id"))
    return graph.unprocessed(chunks, facts, seen)


# --- provenance -----------------------------------------------------------------------------------------------------

ANSWERS = f"""an AS (SELECT conv_id, turn, unnest(range(len(s))) AS idx, unnest(s) AS sentence FROM (SELECT conv_id, turn, {Q.answer_sentences('text')} AS s FROM conversations WHERE role = 'assistant'))"""
#: Chunks that an answer can stem from: the documents whose number is the conversation's, and the next four.
MATCHED = rf"""{ANSWERS}, {FRESH}, cand AS (SELECT c.conv_id, d.doc_id, d.source, lower(d.text) AS low, temporal_score, freshness_label, d.doc_id - c.conv_id AS chunk_rank
  FROM (SELECT DISTINCT conv_id FROM conversations) c JOIN documents d ON d.doc_id BETWEEN c.conv_id AND c.conv_id + 4 JOIN fr ON fr.doc_id = d.doc_id),
wd AS (SELECT *, regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]+') AS w FROM an),
sc AS (SELECT wd.*, source, temporal_score, freshness_label, chunk_rank, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: contains(low, x))) / len(w) ELSE 0.0 END AS s FROM wd JOIN cand USING (conv_id)),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, idx ORDER BY s DESC, chunk_rank) AS k FROM sc) WHERE k = 1),
pm AS (SELECT conv_id, turn, idx, CASE WHEN s > 0.1 THEN source ELSE 'UNKNOWN' END AS matched_source, CASE WHEN s > 0.1 THEN {Q.rnd('least(1.0, s + 0.3)', 3)} ELSE 0.0 END AS confidence,
  CASE WHEN s > 0.1 THEN {Q.rnd('temporal_score', 4)} ELSE 0.0 END AS temporal_score, CASE WHEN s > 0.1 THEN {Q.rnd('(' + Q.rnd('least(1.0, s + 0.3)', 3) + ' + temporal_score) / 2', 4)} ELSE 0.0 END AS combined_score FROM be)"""


def answers(spark, d):
    c = texts(spark, d, "conversations").where("role = 'assistant'").select(F.struct("conv_id", "turn").alias("query_id"), F.col("text").alias("answer"))
    return provenance.split_answers(c)


@query("provenance_split", f"WITH {ANSWERS} SELECT conv_id, turn, idx, sentence FROM an")
def provenance_split(spark, d):
    return answers(spark, d).select("query_id.*", "idx", "sentence")


def matched(spark, d):
    """Candidates come from an equi join on the five document numbers of a conversation."""
    c = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", F.struct("conv_id", "turn").alias("query_id")).distinct()
    near = c.select("query_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.col("conv_id") + k)).alias("chunk_rank", "doc_id"))
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("source_file"), "text").join(fresh(spark, d).select("doc_id", "temporal_score", "freshness_label"), "doc_id")
    return provenance.overlap_match(answers(spark, d), near.join(docs, "doc_id").drop("doc_id"))


@query("provenance_overlap", f"WITH {MATCHED} SELECT conv_id, turn, idx, matched_source, confidence, combined_score FROM pm")
def provenance_overlap(spark, d):
    return matched(spark, d).select("query_id.*", "idx", "matched_source", "confidence", "combined_score")


@query("provenance_summary", f"""WITH {MATCHED} SELECT conv_id, turn, count(*) AS total_sentences, {Q.rnd('avg(confidence)', 3)} AS avg_confidence, {Q.rnd('avg(combined_score)', 4)} AS avg_combined_score,
  count(*) FILTER (WHERE confidence > 0.7) AS high_confidence_count, count(*) FILTER (WHERE matched_source = 'UNKNOWN') AS inferred_count,
  coalesce(string_agg(DISTINCT matched_source, ',' ORDER BY matched_source) FILTER (WHERE matched_source <> 'UNKNOWN'), '') AS sources_used FROM pm GROUP BY conv_id, turn""")
def provenance_summary(spark, d):
    s = provenance.summary(matched(spark, d))
    return s.select("query_id.*", "total_sentences", "avg_confidence", "avg_combined_score", "high_confidence_count", "inferred_count", "sources_used")


# --- feedback -------------------------------------------------------------------------------------------------------

TENANTS = 10
LOG = f"""lg AS (SELECT CAST(user_id % {TENANTS} AS VARCHAR) AS tenant, event_id AS seq, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'fast' ELSE 'slow' END AS path, quality = 1 AS ok FROM events JOIN labels ON labels.doc_id = event_id)"""


def feedback_log(spark, d):
    path = F.when(F.col("event_type").isin("view", "click", "signup"), "fast").otherwise("slow")
    e = table(spark, d, "events").join(table(spark, d, "labels").select(F.col("doc_id").alias("event_id"), "quality"), "event_id")
    return e.select((F.col("user_id") % TENANTS).cast("string").alias("tenant"), F.col("event_id").alias("seq"), path.alias("path"), (F.col("quality") == 1).alias("was_accurate"), "ts")


@query("feedback_accuracy", f"WITH {LOG} SELECT path, count(*) AS n, count(*) FILTER (WHERE ok) AS n_accurate, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 3) AS accuracy FROM lg GROUP BY path")
def feedback_accuracy(spark, d):
    return feedback.accuracy(feedback_log(spark, d))


ADAPTED = f"""{LOG},
cu AS (SELECT tenant, seq, row_number() OVER w AS k, coalesce(sum(CASE WHEN path = 'fast' AND ok THEN 1 ELSE 0 END) OVER w / nullif(sum(CASE WHEN path = 'fast' THEN 1 ELSE 0 END) OVER w, 0), 0.0) AS f,
  coalesce(sum(CASE WHEN path = 'slow' AND ok THEN 1 ELSE 0 END) OVER w / nullif(sum(CASE WHEN path = 'slow' THEN 1 ELSE 0 END) OVER w, 0), 0.0) AS s FROM lg WINDOW w AS (PARTITION BY tenant ORDER BY seq ROWS UNBOUNDED PRECEDING)),
de AS (SELECT *, CASE WHEN k < 3 THEN 0.0 WHEN f < 0.6 THEN -0.05 WHEN f > 0.85 AND s > 0.85 THEN 0.025 ELSE 0.0 END AS delta FROM cu),
th AS (SELECT tenant, seq, k, CAST(1.5 AS DOUBLE) AS threshold FROM de WHERE k = 1
  UNION ALL SELECT de.tenant, de.seq, de.k, CAST(round(greatest(0.8, least(2.5, threshold + delta)), 3) AS DOUBLE) FROM th JOIN de ON de.tenant = th.tenant AND de.k = th.k + 1)"""


_ALL = ADAPTED.replace(f"CAST(user_id % {TENANTS} AS VARCHAR) AS tenant", "'all' AS tenant")


@query("feedback_report", f"""WITH RECURSIVE {_ALL},
c AS (SELECT count(*) AS total_feedbacks, count(*) FILTER (WHERE path = 'fast') AS fast_n, count(*) FILTER (WHERE path = 'slow') AS slow_n, coalesce(100.0 * count(*) FILTER (WHERE path = 'fast' AND ok) / nullif(count(*) FILTER (WHERE path = 'fast'), 0), 0.0) AS f,
  coalesce(100.0 * count(*) FILTER (WHERE path = 'slow' AND ok) / nullif(count(*) FILTER (WHERE path = 'slow'), 0), 0.0) AS s, greatest(0, count(*) - 2) AS threshold_history FROM lg),
t AS (SELECT coalesce(max_by(threshold, k), 1.5) AS current_threshold FROM th)
SELECT current_threshold, total_feedbacks, fast_n, slow_n, CAST(round(f, 2) AS DOUBLE) AS fast_pct, CAST(round(s, 2) AS DOUBLE) AS slow_pct, threshold_history,
  'Current Threshold : ' || CAST(current_threshold AS VARCHAR) || chr(10) || 'Total Feedbacks   : ' || total_feedbacks || chr(10) || 'Fast Path Entries : ' || fast_n || chr(10) || 'Slow Path Entries : ' || slow_n || chr(10)
  || 'Fast Accuracy     : ' || printf('%.2f', f) || '%' || chr(10) || 'Slow Accuracy     : ' || printf('%.2f', s) || '%' || chr(10) || 'Threshold History : ' || threshold_history || ' changes' AS report FROM c, t""")
def feedback_report(spark, d):
    return feedback.report(feedback_log(spark, d))


@query("adaptive_threshold", f"WITH RECURSIVE {ADAPTED} SELECT tenant, seq, threshold FROM th")
def adaptive_threshold(spark, d):
    return feedback.thresholds(feedback_log(spark, d), ("tenant",)).select("tenant", "seq", "threshold")


# --- stores and statistics ------------------------------------------------------------------------------------------

@query("source_counts", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def source_counts(spark, d):
    return statistics.value_counts(table(spark, d, "documents"), "source")


@query("distinct_sources", "SELECT count(DISTINCT source) AS sources, count(*) AS n, min_by(source, doc_id) AS first_source, max_by(source, doc_id) AS last_source FROM documents")
def distinct_sources(spark, d):
    return statistics.ends(table(spark, d, "documents"), "source", "doc_id")


@query("length_stats", "SELECT round(avg(n_chars), 4) AS mean_chars, max(n_chars) AS max_chars, min(n_chars) AS min_chars FROM documents")
def length_stats(spark, d):
    return statistics.spread_of(table(spark, d, "documents"), "n_chars", "chars")


@query("document_stats", "SELECT source, count(*) AS pages, sum(length(text)) AS chars, round(avg(length(text)), 2) AS chars_a_page, sum(len(string_split(text, '|')) - 1) AS cells FROM documents GROUP BY source")
def document_stats(spark, d):
    return statistics.document_stats(table(spark, d, "documents"), "source")


@query("new_vs_stored", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def new_vs_stored(spark, d):
    return S.new_files(table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("chunk_store_append", "SELECT source AS source_file, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY source")
def chunk_store_append(spark, d):
    """Half the documents are stored, then all are appended: nothing twice."""
    path = f"{scratch_folder(spark)}/store"
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "n_chars", F.col("source").alias("source_file"))
    S.append_chunks(chunks.where("lang = 'en'"), path)
    S.append_chunks(chunks, path)
    return spark.read.parquet(path).groupBy("source_file").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first_id"))


@query("vector_export", "SELECT doc_id AS chunk_id, 0 AS char_count, CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE 0.7 END AS authority_score, CASE WHEN doc_id % 3 = 0 THEN 'a,b' ELSE '' END AS tags FROM documents")
def vector_export(spark, d):
    store = table(spark, d, "documents").select(
        F.col("doc_id").alias("chunk_id"), "text", F.lit(None).cast("int").alias("char_count"), F.col("source").alias("source_file"), F.when(F.col("doc_id") % 2 == 1, 0.7).alias("authority_score"),
        F.lit(None).cast("double").alias("trust_weight"), F.when(F.col("doc_id") % 3 == 0, "a , ,b").alias("crop_tags"))
    return S.export_vectors(store).select("chunk_id", "char_count", "authority_score", F.array_join("crop_tags", ",").alias("tags"))


#: Order states as a processing log of customers' files.
def _registry(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("filename"), status.alias("status"), F.struct("o_orderdate", "o_orderkey").alias("processed_at"), F.col("o_orderkey").alias("chunks_created"))


LATEST = "la AS (SELECT o_custkey AS filename, max_by(CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'done' END, (o_orderdate, o_orderkey)) AS status, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS chunks_created FROM orders GROUP BY o_custkey)"


@query("registry_latest", f"WITH {LATEST} SELECT filename, status, chunks_created FROM la")
def registry_latest(spark, d):
    return reg.latest(_registry(spark, d)).select("filename", "status", "chunks_created")


@query("registry_done", f"WITH {LATEST} SELECT filename, chunks_created FROM la WHERE status = 'done'")
def registry_done(spark, d):
    return reg.done(_registry(spark, d)).select("filename", "chunks_created")


@query("registry_summary", f"WITH {LATEST} SELECT status, count(*) AS n FROM la GROUP BY status")
def registry_summary(spark, d):
    return reg.summary(_registry(spark, d))


@query("reextract_reset", "SELECT o_custkey AS filename, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) GROUP BY o_custkey")
def reextract_reset(spark, d):
    listed = table(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("filename"))
    return reg.reset(_registry(spark, d), listed).groupBy("filename").agg(F.count("*").alias("n"))


_TOKEN = r"""(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<a(\s(?:[^>"\x27]|"[^"]*"|\x27[^\x27]*\x27)*)>(.*?)</a\s*>"""
_HREF = r"""(?is)\shref\s*=\s*("[^"]*"|\x27[^\x27]*\x27|[^\s"\x27>]+)"""
_plain = lambda x: "replace(replace(replace(replace(replace(" + x + ", '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', chr(32)), '&amp;', '&')"


@query("link_scrape", rf"""WITH p AS (SELECT page_id, url, replace(replace(html, '<a href="/a', '<a class=x href=/a'), '</ul>', '</ul><!-- <a href="/these">hidden</a> -->') AS html FROM pages),
k AS (SELECT page_id, url, unnest(list_filter(list_zip(regexp_extract_all(html, '{_TOKEN}', 1), regexp_extract_all(html, '{_TOKEN}', 2)), lambda x: regexp_matches(x[1], '{_HREF}'))) AS t, generate_subscripts(list_filter(regexp_extract_all(html, '{_TOKEN}', 1), lambda x: regexp_matches(x, '{_HREF}')), 1) - 1 AS idx FROM p),
a AS (SELECT page_id, url, idx, {_plain("trim(regexp_extract(t[1], '" + _HREF + "', 1), '\"' || chr(39))")} AS href, t[2] AS body FROM k),
t AS (SELECT *, regexp_replace({_plain("regexp_replace(body, '<[^>]*>', '', 'g')")}, '^\s+|\s+$', '', 'g') AS x FROM a WHERE contains(lower(href), 'th')),
f AS (SELECT page_id, idx, CASE WHEN x = '' THEN 'Untitled' ELSE x END AS title, CASE WHEN starts_with(href, 'http') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href
  ELSE regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)$', '\1/'), '[^/]*$', '') || href END AS link FROM t)
SELECT page_id, idx, link, title FROM f WHERE length(title) > 3""")
def link_scrape(spark, d):
    """Some addresses without quotes, and an anchor in a comment. The pages have no links to the default suffix, so another substring is asked for."""
    html = F.replace(F.replace("html", F.lit('<a href="/a'), F.lit("<a class=x href=/a")), F.lit("</ul>"), F.lit('</ul><!-- <a href="/these">hidden</a> -->'))
    # the closing quote of such an address is part of it, as browsers read it
    return S.links(table(spark, d, "pages").withColumn("html", html), "th")


@query("per_source_cap", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type <> 'error') WHERE k <= 3")
def per_source_cap(spark, d):
    return S.cap_per_source(table(spark, d, "events").withColumn("ok", F.col("event_type") != "error"), "user_id", "event_id", 3).select("user_id", "event_id")


@query("safe_filename", r"SELECT doc_id, source || '_' || replace(trim(substr(regexp_replace(text, '[^\p{L}\p{N} _-]', '_', 'g'), 1, 60)), ' ', '_') || '_' || CAST(doc_id AS VARCHAR) || '.pdf' AS filename FROM documents")
def safe_filename(spark, d):
    return table(spark, d, "documents").select("doc_id", S.safe_filename(F.col("text"), F.concat("source", F.lit(" of all")), F.col("doc_id")).alias("filename"))


@query("line_classify", r"""WITH t AS (SELECT doc_id, string_split('# Head' || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10) || '---' || chr(10) || text, chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(range(len(l))) AS idx, unnest(l) AS line FROM t),
f AS (SELECT *, starts_with(trim(line), '```') AS fence, coalesce(sum(CASE WHEN starts_with(trim(line), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM x)
SELECT doc_id, CASE WHEN fence THEN 'fence' WHEN n % 2 = 1 THEN 'code' WHEN regexp_matches(line, '^#{1,6} ') THEN 'h' || CAST(length(regexp_extract(line, '^(#{1,6}) ', 1)) AS VARCHAR)
  WHEN regexp_matches(trim(line), '^(---+|\*\*\*+|___+)$') THEN 'rule' WHEN trim(line) = '' THEN 'blank' ELSE 'paragraph' END AS kind, count(*) AS n FROM f GROUP BY ALL""")
def line_classify(spark, d):
    text = F.concat(F.lit("# Head\n```\n"), "text", F.lit("\n```\n---\n"), "text")
    kinds = texts(spark, d).select("doc_id", F.explode(S.line_kinds(text)).alias("x"))
    return kinds.groupBy("doc_id", F.col("x.kind").alias("kind")).agg(F.count("*").alias("n"))


@query("random_sample", "SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents) WHERE k <= 3")
def random_sample(spark, d):
    """Three documents by the hash of seed and id; the sample is the operator's point."""
    return graph.hashed_sample(table(spark, d, "documents").select("doc_id", "text"), "doc_id", 3, 42)


@query("index_status", f"WITH {Q.BM25} SELECT n_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM po) AS n_postings, (SELECT count(DISTINCT term) FROM po) AS n_terms FROM st")
def index_status(spark, d):
    """The index of part of the documents is stored; asked for all of them it is stale and rebuilt."""
    from sheaf.sources import stores

    path = scratch_folder(spark)
    docs = texts(spark, d).select(F.col("doc_id").alias("chunk_id"), "text", "lang")
    stores.write_index(docs.where("lang = 'de'"), path)
    index = stores.current_index(docs, path)
    n = lambda t: t.select(F.count("*").alias("n")).scalar().cast("int")
    return index.stats.select("n_docs", F.round("avgdl", 6).alias("avgdl"), n(index.postings).alias("n_postings"), n(index.terms).alias("n_terms"))


@query("auto_metadata", "WITH k(source_file, title) AS (VALUES ('src1', 'One'), ('src2', NULL)) SELECT source AS source_file, coalesce(title, source) AS title, 2024 AS year, 0.9 AS authority_score, count(*) AS n FROM documents LEFT JOIN k ON source = source_file GROUP BY ALL")
def auto_metadata(spark, d):
    from sheaf.sources.services import with_metadata_defaults

    known = spark.createDataFrame([("src1", "One"), ("src2", None)], "source_file string, title string")
    files = table(spark, d, "documents").groupBy(F.col("source").alias("source_file")).agg(F.count("*").alias("n"))
    return with_metadata_defaults(files, known).select("source_file", "title", "year", "authority_score", "n")


@query("download_filter", "SELECT page_id, url FROM pages WHERE contains(lower(CASE WHEN page_id % 3 = 0 THEN 'Application/PDF' ELSE 'text/html' END), 'pdf') OR ends_with(lower(url), '.pdf')")
def download_filter(spark, d):
    p = table(spark, d, "pages").withColumn("kind", F.when(F.col("page_id") % 3 == 0, "Application/PDF").otherwise("text/html"))
    return p.where(S.wanted_download(F.col("kind"), F.col("url"))).select("page_id", "url")


@query("reply_match", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'view' WHEN 1 THEN 'INFERRED' ELSE event_type END AS matched_source, CAST(CASE event_id % 4 WHEN 0 THEN 0.8 WHEN 1 THEN 0.3 ELSE 0.5 END AS DOUBLE) AS confidence,
  CASE WHEN event_id % 4 = 0 OR event_id % 4 > 1 AND event_type = 'view' THEN 'FRESH' WHEN event_id % 4 = 1 THEN 'INFERRED' ELSE 'UNKNOWN' END AS freshness_label,
  CAST(CASE WHEN event_id % 4 = 0 THEN 0.8 WHEN event_id % 4 = 1 THEN 0.15 WHEN event_type = 'view' THEN 0.65 ELSE 0.25 END AS DOUBLE) AS combined_score FROM events""")
def reply_match(spark, d):
    """Replies that are no JSON (half of the sentence's words are in the chunk), that name no source, that name one."""
    kind = F.col("event_id") % 4
    reply = F.when(kind == 0, "no json").when(kind == 1, "{}").otherwise(F.to_json(F.struct(F.col("event_type").alias("matched_source"), F.lit(0.5).alias("confidence"))))
    replies = table(spark, d, "events").select(F.col("event_id").alias("query_id"), F.lit(0).alias("idx"), F.lit("green water").alias("sentence"), reply.alias("reply"))
    chunks = replies.select("query_id", F.lit("view").alias("source_file"), F.lit("Water it").alias("text"), F.lit(0.8).alias("temporal_score"), F.lit("FRESH").alias("freshness_label"), F.lit(1).alias("chunk_rank"))
    return provenance.model_match(replies, chunks).select(F.col("query_id").alias("event_id"), "matched_source", "confidence", "freshness_label", "combined_score")


_shown = "CASE WHEN length(sentence) > 80 THEN substr(sentence, 1, 80) || '...' ELSE sentence END"
_two = lambda x: f"CAST(CAST(round(CAST({x} AS DECIMAL(18, 6)), 2) AS DECIMAL(18, 2)) AS VARCHAR)"  # noqa: E731  halves of the decimal value go up
_fresh = "CASE WHEN s > 0.1 THEN freshness_label ELSE 'UNKNOWN' END"


@query("provenance_report", f"""WITH {MATCHED}, pr AS (SELECT pm.*, sentence, {_fresh} AS label, CASE WHEN s > 0.1 THEN 'heuristic overlap' ELSE 'matching failed' END AS reason FROM pm JOIN be USING (conv_id, turn, idx)),
su AS (SELECT conv_id, turn, count(*) AS n, {Q.rnd('avg(confidence)', 3)} AS c, {Q.rnd('avg(temporal_score)', 4)} AS t, {Q.rnd('avg(combined_score)', 4)} AS o, count(*) FILTER (WHERE confidence > 0.7) AS high, count(*) FILTER (WHERE matched_source = 'UNKNOWN') AS inferred FROM pm GROUP BY conv_id, turn),
bl AS (SELECT conv_id, turn, string_agg('📝 "' || {_shown} || '"' || chr(10) || '   └─ Source     : ' || matched_source || chr(10) || '   └─ Confidence : ' || {_two('confidence')} || chr(10) || '   └─ Freshness  : ' || label
  || ' (temporal score: ' || printf('%.4f', temporal_score) || ')' || chr(10) || '   └─ Combined   : ' || printf('%.4f', combined_score) || chr(10) || '   └─ Reason     : ' || reason, chr(10) || chr(10) ORDER BY idx) AS b FROM pr GROUP BY conv_id, turn)
SELECT conv_id, turn, b || chr(10) || chr(10) || '📊 PROVENANCE SUMMARY' || chr(10) || '   Total sentences analysed : ' || n || chr(10) || '   Avg confidence           : ' || {_two('c')} || chr(10) || '   Avg temporal score       : ' || printf('%.4f', t) || chr(10)
  || '   Avg combined score       : ' || printf('%.4f', o) || chr(10) || '   High confidence (>0.7)   : ' || high || ' sentences' || chr(10) || '   Inferred (no source)     : ' || inferred || ' sentences' AS report FROM bl JOIN su USING (conv_id, turn)""")
def provenance_report(spark, d):
    return provenance.report(matched(spark, d)).select("query_id.*", "report")


# --- streams --------------------------------------------------------------------------------------------------------

@query("stream_threshold", f"WITH RECURSIVE {ADAPTED} SELECT tenant AS key, seq, threshold FROM th")
def stream_threshold(spark, d):
    """The adaptive threshold from a stream: one state a tenant."""
    from sheaf.streaming.feedback import threshold_stream

    root = scratch_folder(spark)
    log = feedback_log(spark, d).select(F.col("tenant").alias("key"), "seq", "path", "was_accurate")
    log.write.parquet(f"{root}/log")
    stream = threshold_stream(spark.readStream.schema(log.schema).parquet(f"{root}/log"))
    started = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema("key string, seq long, threshold double").parquet(f"{root}/out")


#: Pages are cleaned and built to a full text, a line feed after each, before they are chunked.
_INGEST = CHUNKS.replace(f"{Q.sentences('text')} AS s FROM documents", f"{Q.sentences('page')} AS s FROM (SELECT doc_id, {Q.clean('text')} || chr(10) AS page FROM documents)").replace("coalesce(NOT (length(lag(sentence) OVER w) >= 20 AND length(sentence) >= 20), false)", "false")


@query("stream_ingest", f"""WITH RECURSIVE {_INGEST}
SELECT 'doc' || doc_id || '.json' AS source_file, count(*) AS n_chunks, count(*) AS n_ids, CAST(sum(length(text)) AS BIGINT) AS chars FROM chunks GROUP BY doc_id""")
def stream_ingest(spark, d):
    """Documents as extracted files through the ingest stream, twice; the second run finds nothing new."""
    from sheaf.schemas import EXTRACTED, METADATA
    from sheaf.streaming.ingest import ingest_stream

    root = scratch_folder(spark)
    pages = F.array(F.struct(F.lit(1).alias("page_number"), F.col("text"), F.array().cast("array<string>").alias("tables_text")))
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc"), "doc_id", F.lit(".json")).alias("filename"), pages.alias("pages"), F.lit(1).alias("total_pages"))
    docs.write.json(f"{root}/in")
    meta = spark.createDataFrame([], METADATA)
    for _ in range(2):
        ingest_stream(spark, f"{root}/in", f"{root}/chunks", f"{root}/state", meta, EXTRACTED, registry=f"{root}/registry").awaitTermination()
    stored = spark.read.parquet(f"{root}/chunks")
    return stored.groupBy("source_file").agg(F.count("*").alias("n_chunks"), F.countDistinct("chunk_id").alias("n_ids"), F.sum("char_count").alias("chars"))
