"""The question pipeline as a whole, with trust, freshness, gate, weather, an adapted threshold and traced answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.functions import rules as R
from sheaf.functions import text as T
from sheaf.operators import gates, pipeline
from sheaf.operators.providers import Providers
from sheaf.schemas import WEATHER

from . import sql as Q
from .fixtures import REGISTRY, STAGES
from .gate_queries import _keys, _kind, _word
from .graph_queries import _ALL, feedback_log
from .registry import query, stored_index, table
from .retrieval_queries import TRUST, corpus, source_trust, vectors

READING = {
    "current": {"temperature": 39.5, "humidity": 90.0, "rain": 0.0, "wind": 12.0, "code": 3},
    "daily": {"date": ["Mon", "Tue"], "tmax": [30.0, 31.5], "tmin": [20.0, 21.0], "rain": [1.5, 0.0], "rain_prob": [80.0, 10.0], "et0": [4.5, None], "uv": [1.0, 2.0]},
}
#: The reading above as a block, written out.
BLOCK = """=== REAL-TIME WEATHER: Salem ===
As of 2025-06-01 08:00:
Current: Overcast, 39.5°C, Humidity 90.0%, Wind 12.0 km/h
Rainfall today: 0.0 mm

7-Day Forecast:
  Mon: 20.0–30.0°C, 1.5mm rain (80.0% chance), ET0: 4.5mm
  Tue: 21.0–31.5°C, No rain (10.0% chance)

⚠️  Agricultural Alerts:
  • Dry week ahead — irrigation required
  • High heat stress risk — water crops in early morning
  • High humidity — fungal disease risk is elevated
  • Rain likely in next 3 days — delay fertilizer application
========================================"""
SEASONAL = "Season notes. The soil is to be kept moist in this month."
KINDS = ("early growth", "growth", "ripening time")


def questions(spark, d):
    """Benchmark items: half of them ask about spraying, some have long probe replies, stages go by turns."""
    i = F.col("item_id")
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    q = table(spark, d, "benchmark").select(
        i.alias("query_id"), F.when(i % 2 == 0, F.concat(F.lit("Should I spray tomorrow in Salem? "), "text")).otherwise(F.col("text")).alias("query"),
        F.when(i % 3 == 0, F.repeat(F.lit("word "), (i % 40).cast("int"))).otherwise("brief").alias("response"), F.get(F.array(*map(F.lit, KINDS)), (i % 3).cast("int")).alias("stage"))
    return q.join(vec, "query_id")


def consistent(rows):
    """Scores by the chunk's number; every seventh has no samples."""
    return rows.where(F.col("chunk_id") % 7 != 3).select("query_id", "chunk_id", (0.2 * (1 + F.col("chunk_id") % 5)).alias("mscp_score"))


_rate = " ".join(f"WHEN '{t}' THEN {r}" for t, r in R.DECAY.items())
_low = "lower(cs.source_file)"
_best = f"regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}_]+')"
PIPELINE = f"""WITH RECURSIVE {_ALL}, t AS (SELECT coalesce(max_by(threshold, k), 1.5) AS threshold FROM th),
asked AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'Should I spray tomorrow in Salem? ' || text ELSE text END AS text, CASE WHEN item_id % 3 = 0 THEN repeat('word ', item_id % 40) ELSE 'brief' END AS response,
  CASE item_id % 3 WHEN 0 THEN 'early growth' WHEN 1 THEN 'growth' ELSE 'ripening time' END AS stage FROM benchmark WHERE item_id IN (SELECT vec_id FROM embeddings)),
u AS (SELECT item_id AS query_id, text AS query, response, stage FROM asked),
k AS (SELECT *, CASE {_kind} ELSE 'FACTUAL' END AS query_type, len(string_split_regex(lower(query), '\\s+')) AS words, CASE WHEN trim(response) = '' THEN 0 ELSE len(string_split_regex(trim(response), '\\s+')) END AS w FROM u),
ro AS (SELECT *, CASE WHEN (CASE WHEN w < 15 THEN 0.8 WHEN w < 25 THEN 1.2 ELSE 2.0 END) < threshold AND query_type IN ('FACTUAL', 'STATISTICAL') AND words <= 12 AND (CASE WHEN query_type <> 'FACTUAL' THEN 0.9 WHEN words <= 30 THEN 0.7 ELSE 0.5 END) >= 0.6
  THEN 'fast' ELSE 'slow' END AS path FROM k, t),
{Q.sparse(10, T.GATE_STOP_WORDS).replace('FROM benchmark)', 'FROM asked)')}, {Q.dense(10).replace('FROM benchmark b', 'FROM asked b')}, {Q.MERGED}, {TRUST},
hs AS (SELECT me.*, {Q.rnd('(0.6 * dense_score + 0.4 * sparse_score) * coalesce(trust_weight, 1.0)', 4)} AS final_score, coalesce(trust_weight, 1.0) AS trust_weight FROM me LEFT JOIN tw USING (chunk_id)),
cs AS (SELECT * EXCLUDE (source), d.source AS source_file FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id) AS retrieval_rank FROM hs) h JOIN documents d ON d.doc_id = h.chunk_id WHERE retrieval_rank <= 5),
rr AS (SELECT cs.*, ro.query_type, ro.path, ro.stage, ro.query, coalesce(m.authority_score, cs.trust_weight, 1.0) AS authority, {Q.rnd('final_score * (coalesce(m.authority_score, cs.trust_weight, 1.0) * (1 - coalesce(m.bias_penalty, 0.0)))', 4)} AS ra FROM cs JOIN ro USING (query_id) LEFT JOIN meta m USING (source_file)),
ms AS (SELECT *, CASE WHEN path = 'fast' OR ra < 0.35 THEN 1.0 WHEN chunk_id % 7 = 3 THEN 0.5 ELSE 0.2 * (1 + chunk_id % 5) END AS mscp, path = 'fast' OR ra < 0.35 OR chunk_id % 7 = 3 OR 0.2 * (1 + chunk_id % 5) >= 0.55 AS trusted FROM rr),
ft AS (SELECT *, {Q.rnd('ra * mscp * authority', 4)} AS final_trust FROM ms),
inc AS (SELECT * FROM (SELECT *, trusted AND final_trust >= 0.22 AS passes, bool_or(trusted AND final_trust >= 0.22) OVER (PARTITION BY query_id) AS any_pass, row_number() OVER (PARTITION BY query_id ORDER BY final_trust DESC, chunk_id) AS best FROM ft) WHERE passes OR NOT any_pass AND best = 1),
rg(key, base, pub) AS (VALUES {Q.rows(REGISTRY)}),
kt AS (SELECT *, {Q.first_contained(_low.replace('cs.', ''), [key for key, _, _ in REGISTRY])} AS key FROM inc),
ts AS (SELECT kt.*, coalesce({Q.rnd("base * exp(-(CASE query_type " + _rate + f" ELSE {R.OTHER_DECAY} END) * greatest(0, {R.EVALUATION_YEAR} - pub))", 4)}, 0.5) AS temporal_score FROM kt LEFT JOIN rg USING (key)),
tr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY temporal_score DESC, retrieval_rank) AS temporal_rank FROM ts),
fr AS (SELECT *, lower(text) AS low, CASE WHEN query_type IN ('RECOMMENDATION', 'DIAGNOSTIC', 'PROCEDURAL') THEN stage END AS s FROM tr WHERE temporal_score >= {R.LEAST_FRESHNESS}),
ky(ord, key) AS (VALUES {Q.rows(_keys)}), wd(key, kind, ord, word) AS (VALUES {Q.rows(_word)}),
sg AS (SELECT fr.* EXCLUDE (key), CASE WHEN s IS NULL THEN 'default' ELSE coalesce((SELECT min_by(key, ord) FROM ky WHERE key = s), (SELECT min_by(key, ord) FROM ky WHERE contains(key, s) OR contains(s, key)), 'default') END AS skey FROM fr),
ga AS (SELECT sg.*, NOT EXISTS (SELECT 1 FROM wd WHERE wd.key = skey AND kind = 'blocked' AND contains(low, word)) AS ok FROM sg),
kp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY temporal_rank) AS chunk_rank FROM (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS some_ok FROM ga) WHERE ok OR NOT some_ok),
ba AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_rank) FILTER (WHERE chunk_rank <= 5) AS base FROM kp GROUP BY query_id),
wt AS (SELECT query_id, {Q.quote(BLOCK)} || chr(10) || chr(10) || coalesce(base, '') || chr(10) || chr(10) || {Q.quote(SEASONAL)} || chr(10) || chr(10) || coalesce(base, '') AS text
  FROM ro LEFT JOIN ba USING (query_id) WHERE query_type IN ('RECOMMENDATION', 'DIAGNOSTIC') AND {Q.contains_any('lower(query)', R.WEATHER_WORDS)} AND query_id % 5 > 0),
sh AS (SELECT query_id, text, source_file, path, row_number() OVER (PARTITION BY query_id ORDER BY r) AS place FROM (SELECT query_id, text, source_file, chunk_rank AS r FROM kp UNION ALL SELECT query_id, text, 'REAL-TIME WEATHER DATA', 0 FROM wt) x JOIN (SELECT query_id, path FROM ro) y USING (query_id)),
us AS (SELECT *, list_slice({Q.answer_sentences('text')}, 1, 2) AS two FROM sh WHERE place <= CASE path WHEN 'fast' THEN 3 ELSE 5 END),
an AS (SELECT query_id, path, string_agg(array_to_string(two, ' '), ' ' ORDER BY place) AS answer, string_agg(source_file, ', ' ORDER BY place) FILTER (WHERE f = 1) AS sources
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_file ORDER BY place) AS f FROM us) GROUP BY query_id, path),
se AS (SELECT query_id, unnest(range(len(s))) AS idx, unnest(s) AS sentence FROM (SELECT query_id, {Q.answer_sentences('answer')} AS s FROM an)),
sv AS (SELECT se.query_id, idx, tr.source_file, tr.temporal_score, tr.temporal_rank, CASE WHEN len({_best}) > 0 THEN len(list_filter({_best}, lambda x: contains(lower(tr.text), x))) / len({_best}) ELSE 0.0 END AS s FROM se JOIN tr USING (query_id)),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, idx ORDER BY s DESC, temporal_rank) AS k FROM sv) WHERE k = 1),
pm AS (SELECT *, CASE WHEN s > 0.1 THEN {Q.rnd('least(1.0, s + 0.3)', 3)} ELSE 0.0 END AS confidence, CASE WHEN s > 0.1 THEN {Q.rnd('(' + Q.rnd('least(1.0, s + 0.3)', 3) + ' + temporal_score) / 2', 4)} ELSE 0.0 END AS combined FROM be),
su AS (SELECT query_id, count(*) AS total_sentences, {Q.rnd('avg(confidence)', 3)} AS avg_confidence, {Q.rnd('avg(combined)', 4)} AS avg_combined_score FROM pm GROUP BY query_id)
SELECT an.query_id, ro.query_type, an.path, an.path AS answered_by, answer, sources, total_sentences, avg_confidence, avg_combined_score FROM an JOIN ro USING (query_id) LEFT JOIN su USING (query_id)"""


@query("answer_pipeline", PIPELINE)
def answer_pipeline(spark, d):
    q = questions(spark, d)
    # a row a known source, a fixed list: texts are neither shuffled by their source nor joined with themselves
    meta = F.broadcast(source_trust(spark).select("source_file", "trust_weight", "authority_score", "bias_penalty"))
    held = corpus(spark, d).join(meta, "source_file", "left")
    reading = F.from_json(F.lit(_json()), WEATHER)
    from sheaf.operators.weather import weather_report

    weather = q.where(F.col("query_id") % 5 > 0).select("query_id", weather_report(reading, gates.location(F.col("query")), F.lit("2025-06-01 08:00")).alias("report"), F.lit(SEASONAL).alias("seasonal"))
    cfg = pipeline.Config(registry=REGISTRY, stages=STAGES, trust=True, providers=Providers(consistency=consistent))
    out = pipeline.answer_queries(q, held, vectors(spark, d), cfg, weather, index=stored_index(spark, d), feedback_log=feedback_log(spark, d))
    kinds = out["routed"].select("query_id", "query_type", "path")
    sums = out["summary"].select("query_id", "total_sentences", "avg_confidence", "avg_combined_score")
    return out["answers"].join(kinds, "query_id").join(sums, "query_id", "left").select("query_id", "query_type", "path", "answered_by", "answer", "sources", "total_sentences", "avg_confidence", "avg_combined_score")


def _json() -> str:
    import json

    return json.dumps(READING)
