"""Classification, routing, context gates, weather, seasons."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.functions import rules as R
from sheaf.operators import gates, statistics, weather

from . import sql as Q
from .fixtures import STAGE_OF_LANG, STAGES, WORDS
from .registry import query, table, texts


def users(spark, d):
    """User turns as questions; the reply of the next turn is the probe's response."""
    c = table(spark, d, "conversations")
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    reply = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")).dropDuplicates(["conv_id", "turn"])
    return q.join(reply, ["conv_id", "turn"], "left")


USERS = """u AS (SELECT q.conv_id, q.turn, q.text AS query, a.text AS response FROM conversations q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user')"""
WEATHER_WORDS = ("rewh", "ononst", "with this")


@query("weather_query", f"WITH {USERS} SELECT conv_id, turn, {Q.contains_any('lower(query)', WEATHER_WORDS)} AS is_weather, {Q.contains_any('lower(query)', R.WEATHER_WORDS)} AS by_default_words FROM u")
def weather_query(spark, d):
    return users(spark, d).select("conv_id", "turn", gates.is_weather_query(F.col("query"), WEATHER_WORDS).alias("is_weather"), gates.is_weather_query(F.col("query")).alias("by_default_words"))


_found = ", ".join(f"nullif(regexp_extract(text, {Q.quote(p)}, 1), '')" for p in R.LOCATIONS)


@query("location_extract", f"SELECT doc_id, coalesce({_found}, {Q.quote(R.DEFAULT_LOCATION)}) AS location FROM documents")
def location_extract(spark, d):
    return table(spark, d, "documents").select("doc_id", gates.location(F.col("text")).alias("location"))


@query("crop_detect", f"WITH {USERS} SELECT conv_id, turn, {Q.first_contained('lower(query)', WORDS, 'default')} AS crop FROM u")
def crop_detect(spark, d):
    return users(spark, d).select("conv_id", "turn", gates.crop_of(F.col("query"), WORDS).alias("crop"))


MONTH = "1 + event_id % 12"
SEASON = f"CASE WHEN {MONTH} IN (6, 7, 8, 9) THEN 'monsoon' WHEN {MONTH} IN (3, 4, 5) THEN 'summer' ELSE 'winter' END"
CROP = "CASE event_id % 5 WHEN 0 THEN 'rice' WHEN 1 THEN 'tomato' WHEN 2 THEN 'cotton' WHEN 3 THEN 'wheat' ELSE 'millet' END"


def _season_rows(spark, d):
    m = (1 + F.col("event_id") % 12).cast("int")
    crop = F.get(F.array(*(F.lit(x) for x in ("rice", "tomato", "cotton", "wheat", "millet"))), (F.col("event_id") % 5).cast("int"))
    return table(spark, d, "events").select("event_id", m.alias("month"), gates.season(m).alias("season"), crop.alias("crop"))


@query("season", f"SELECT event_id, {SEASON} AS season FROM events")
def season(spark, d):
    return _season_rows(spark, d).select("event_id", "season")


_calendar = [(c, i + 1, s) for c, stages in R.CALENDAR.items() for i, s in enumerate(stages)]


@query("calendar_stage", f"""WITH cal(crop, month, stage) AS (VALUES {Q.rows(_calendar)}), e AS (SELECT event_id, {CROP} AS crop, {MONTH} AS month FROM events)
SELECT event_id, coalesce(a.stage, b.stage) AS stage FROM e LEFT JOIN cal a ON a.crop = e.crop AND a.month = e.month LEFT JOIN cal b ON b.crop = 'default' AND b.month = e.month""")
def calendar_stage(spark, d):
    return _season_rows(spark, d).select("event_id", gates.calendar_stage(F.col("crop"), F.col("month")).alias("stage"))


_pests = [(c, s, "; ".join(a)) for (c, s), a in R.PESTS.items()]


@query("pest_alerts", f"""WITH p(crop, season, alerts) AS (VALUES {Q.rows(_pests)}), e AS (SELECT event_id, {CROP} AS crop, {SEASON} AS season FROM events)
SELECT event_id, coalesce(a.alerts, b.alerts) AS alerts FROM e LEFT JOIN p a ON a.crop = e.crop AND a.season = e.season LEFT JOIN p b ON b.crop = 'default' AND b.season = e.season""")
def pest_alerts(spark, d):
    return _season_rows(spark, d).select("event_id", F.array_join(gates.pest_alerts(F.col("crop"), F.col("season")), "; ").alias("alerts"))


@query("entropy_proxy", f"""WITH {USERS} SELECT conv_id, turn, CASE WHEN response IS NULL THEN 2.0 WHEN w < 15 THEN 0.8 WHEN w < 25 THEN 1.2 ELSE 2.0 END AS entropy
FROM (SELECT *, CASE WHEN {Q.strip('response')} = '' THEN 0 ELSE len(string_split_regex({Q.strip('response')}, '\\s+')) END AS w FROM u)""")
def entropy_proxy(spark, d):
    return users(spark, d).select("conv_id", "turn", gates.entropy_proxy(F.col("response")).alias("entropy"))


@query("shannon_entropy", f"""SELECT user_id, {Q.rnd('sum(p) / count(*)', 4)} AS entropy FROM (SELECT user_id, -exp(-value / 100) * log2(exp(-value / 100)) AS p FROM events) GROUP BY user_id""")
def shannon_entropy(spark, d):
    lp = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(-F.col("value") / 100).alias("lp"))
    return lp.select("user_id", gates.shannon_entropy(F.col("lp")).alias("entropy"))


_kind = " ".join(f"WHEN {Q.contains_any('lower(query)', words)} THEN {Q.quote(t)}" for t, words in gates.CLASSIFIER)
CLASSED = rf"""{USERS}, k AS (SELECT *, CASE {_kind} ELSE 'FACTUAL' END AS query_type, len(string_split_regex(lower(query), '\s+')) AS words FROM u),
cl AS (SELECT *, CASE WHEN query_type <> 'FACTUAL' THEN 0.9 WHEN words <= 30 THEN 0.7 ELSE 0.5 END AS confidence, CASE WHEN words <= 12 THEN 'simple' ELSE 'complex' END AS complexity FROM k)"""


@query("classify_rules", f"WITH {CLASSED} SELECT conv_id, turn, query_type, confidence, complexity FROM cl")
def classify_rules(spark, d):
    return users(spark, d).select("conv_id", "turn", gates.classify(F.col("query")).alias("c")).select("conv_id", "turn", "c.*")


ROUTED = f"""{CLASSED}, en AS (SELECT *, CASE WHEN response IS NULL THEN '2.0' WHEN w < 15 THEN '0.8' WHEN w < 25 THEN '1.2' ELSE '2.0' END AS shown
  FROM (SELECT *, len(string_split_regex({Q.strip('response')}, '\\s+')) AS w FROM cl)),
ro AS (SELECT *, CAST(shown AS DOUBLE) < 1.5 AS low, query_type IN ('FACTUAL', 'STATISTICAL') AS kind, complexity = 'simple' AS simple, confidence >= 0.6 AS sure FROM en)"""


@query("routing", f"""WITH {ROUTED} SELECT conv_id, turn, CASE WHEN low AND kind AND simple AND sure THEN 'fast' ELSE 'slow' END AS path,
CASE WHEN low AND kind AND simple AND sure THEN 'low entropy (' || shown || ') + simple ' || query_type || ' query' ELSE concat_ws(' + ', CASE WHEN NOT low THEN 'high entropy (' || shown || ' >= 1.5)' END,
  CASE WHEN NOT kind THEN 'complex type: ' || query_type END, CASE WHEN NOT simple THEN 'complex query' END, CASE WHEN NOT sure THEN 'low confidence (' || CAST(confidence AS VARCHAR) || ')' END) END AS reason FROM ro""")
def routing(spark, d):
    u = users(spark, d).select("*", gates.classify(F.col("query")).alias("c"), gates.entropy_proxy(F.col("response")).alias("entropy")).select("conv_id", "turn", "entropy", "c.*")
    return gates.route(u).select("conv_id", "turn", "path", "reason")


@query("route_counts", f"WITH {ROUTED} SELECT count(*) FILTER (WHERE low AND kind AND simple AND sure) AS fast, count(*) FILTER (WHERE NOT (low AND kind AND simple AND sure)) AS slow FROM ro")
def route_counts(spark, d):
    return statistics.counts_of(routing(spark, d), "path", ("fast", "slow"))


_keys = [(i, k) for i, k in enumerate(STAGES)]
_word = [(k, kind, i, w) for k, lists in STAGES.items() for kind, ws in zip(("allowed", "blocked"), lists, strict=True) for i, w in enumerate(ws)]
GATED = f"""
sk AS (SELECT doc_id, lang, source, lower(text) AS low, CASE lang WHEN 'en' THEN 'early growth' WHEN 'fr' THEN 'growth' WHEN 'de' THEN 'ripening time' END AS s FROM documents),
ky(ord, key) AS (VALUES {Q.rows(_keys)}), wd(key, kind, ord, word) AS (VALUES {Q.rows(_word)}),
sg AS (SELECT sk.*, coalesce((SELECT min_by(key, ord) FROM ky WHERE key = s), (SELECT min_by(key, ord) FROM ky WHERE contains(key, s) OR contains(s, key)), 'default') AS key FROM sk),
hit AS (SELECT doc_id, min_by(word, ord) FILTER (WHERE kind = 'blocked') AS b, min_by(word, ord) FILTER (WHERE kind = 'allowed') AS a FROM sg JOIN wd ON wd.key = sg.key AND contains(low, word) GROUP BY doc_id),
ga AS (SELECT sg.doc_id, lang, source, b IS NULL AS compatible, b AS matched_blocked, CASE WHEN b IS NULL THEN a END AS matched_allowed,
  CASE WHEN key = 'default' THEN 'Default stage — permissive' WHEN b IS NOT NULL THEN 'Contains blocked topic: ' || b WHEN a IS NOT NULL THEN 'Matches allowed topic: ' || a ELSE 'Neutral content — allowed by default' END AS gate_reason FROM sg LEFT JOIN hit USING (doc_id))"""


def gated(spark, d):
    stage = F.coalesce(*(F.when(F.col("lang") == k, F.lit(v)) for k, v in STAGE_OF_LANG.items()))
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "text", stage.alias("stage"))
    return gates.stage_gate(docs, stages=STAGES)


@query("stage_gate", f"WITH {GATED} SELECT doc_id, compatible, matched_blocked, matched_allowed, gate_reason FROM ga")
def stage_gate(spark, d):
    return gated(spark, d).select("doc_id", "compatible", "matched_blocked", "matched_allowed", "gate_reason")


@query("gate_fallback", f"WITH {GATED}, f AS (SELECT *, NOT bool_or(compatible) OVER (PARTITION BY source, lang) AS fell_back FROM ga) SELECT doc_id, fell_back FROM f WHERE compatible OR fell_back")
def gate_fallback(spark, d):
    return gates.apply_gate(gated(spark, d).withColumn("query_id", F.struct("source", "lang"))).select("doc_id", "fell_back")


_top = lambda item, col: f"(SELECT {Q.quote(item)} AS item, CAST({col} AS VARCHAR) AS value, n FROM (SELECT {col}, count(*) AS n, min(event_id) AS f FROM events WHERE {col} IS NOT NULL GROUP BY {col} ORDER BY n DESC, f LIMIT 1))"


@query("gate_stats", f"SELECT 'total' AS item, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM events UNION ALL {_top('event_type', 'event_type')} UNION ALL {_top('user_id', 'user_id')} UNION ALL {_top('props', 'props')}")
def gate_stats(spark, d):
    return gates.gate_statistics(table(spark, d, "events").withColumn("seq", F.col("event_id")), ("event_type", "user_id", "props"))


@query("gate_applicability", f"WITH {CLASSED} SELECT conv_id, turn, query_type IN ('RECOMMENDATION', 'DIAGNOSTIC', 'PROCEDURAL') AS phenology, query_type IN ('RECOMMENDATION', 'DIAGNOSTIC') AND {Q.contains_any('lower(query)', R.WEATHER_WORDS)} AS weather FROM cl")
def gate_applicability(spark, d):
    u = users(spark, d).withColumn("t", gates.classify(F.col("query"))["query_type"])
    return u.select("conv_id", "turn", gates.phenology_applies(F.col("t")).alias("phenology"), gates.weather_applies(F.col("t"), F.col("query")).alias("weather"))


# --- readings -------------------------------------------------------------------------------------------------------

def _weather_rows(spark, d):
    """The first nine readings of each user as days of weather: value as rain, temperatures and probabilities from the ids; some arrays are shorter."""
    e = table(spark, d, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("k <= 9")
    week = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("x"))
    col = lambda f: F.transform("x", f)
    daily = F.struct(
        col(lambda x: F.concat(F.lit("day "), x["event_id"].cast("string"))).alias("date"), col(lambda x: (20 + x["event_id"] % 20).cast("double")).alias("tmax"), col(lambda x: (5 + x["event_id"] % 15).cast("double")).alias("tmin"),
        col(lambda x: F.when(x["event_id"] % 4 > 0, F.round(x["value"] / 10, 1))).alias("rain"), F.slice(col(lambda x: (x["event_id"] % 100).cast("double")), 1, 5).alias("rain_prob"),
        col(lambda x: F.when(x["event_id"] % 3 > 0, (x["event_id"] % 9) / 2)).alias("et0"), F.slice(col(lambda x: (x["event_id"] % 11).cast("double")), 1, 6).alias("uv"))
    u = F.col("user_id")
    current = F.struct(F.when(u % 9 > 0, (u % 45).cast("double")).alias("temperature"), (u % 100).cast("double").alias("humidity"), F.when(u % 2 > 0, (u % 7) / 4).alias("rain"), F.when(u % 5 > 0, (u % 30).cast("double")).alias("wind"), (u % 60).cast("int").alias("code"))
    raw = F.struct(current.alias("current"), daily.alias("daily"))
    return week.select("user_id", weather.weather_report(F.when(u % 13 > 0, raw), F.concat(F.lit("Place "), u.cast("string")), F.lit("2025-06-01 08:00")).alias("report"), weather.forecast(daily).alias("days"))


WEEK = """
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
dy AS (SELECT user_id, k, 'day ' || CAST(event_id AS VARCHAR) AS date, CAST(20 + event_id % 20 AS DOUBLE) AS tmax, CAST(5 + event_id % 15 AS DOUBLE) AS tmin,
  CASE WHEN event_id % 4 > 0 THEN round(value / 10, 1) ELSE 0.0 END AS rain_mm, CASE WHEN k <= 5 THEN CAST(event_id % 100 AS DOUBLE) ELSE 0.0 END AS rain_prob,
  CASE WHEN event_id % 3 > 0 THEN (event_id % 9) / 2 END AS et0, CASE WHEN k <= 6 THEN CAST(event_id % 11 AS DOUBLE) END AS uv FROM o WHERE k <= 7),
wk AS (SELECT user_id, sum(rain_mm) AS rain, bool_or(rain_prob > 70) FILTER (WHERE k <= 3) AS likely, CASE WHEN user_id % 9 > 0 THEN CAST(user_id % 45 AS DOUBLE) END AS t, CAST(user_id % 100 AS DOUBLE) AS h FROM dy GROUP BY user_id),
al AS (SELECT *, list_filter([CASE WHEN rain > 100 THEN 'Heavy rainfall expected — avoid pesticide spraying' END, CASE WHEN rain < 5 THEN 'Dry week ahead — irrigation required' END,
  CASE WHEN t > 38 THEN 'High heat stress risk — water crops in early morning' END, CASE WHEN t <> 0 AND t < 15 THEN 'Cold temperature — protect sensitive seedlings' END,
  CASE WHEN h > 85 THEN 'High humidity — fungal disease risk is elevated' END, CASE WHEN likely THEN 'Rain likely in next 3 days — delay fertilizer application' END], lambda a: a IS NOT NULL) AS alerts FROM wk)"""


@query("weather_forecast_zip", f"WITH {WEEK} SELECT user_id, CAST(k - 1 AS INTEGER) AS day, date, tmax, tmin, rain_mm, rain_prob, et0, uv FROM dy")
def weather_forecast_zip(spark, d):
    return _weather_rows(spark, d).select("user_id", F.posexplode("days").alias("day", "x")).select("user_id", "day", "x.*")


@query("weather_alerts", f"WITH {WEEK} SELECT user_id, round(rain, 1) AS total_rain_7d, array_to_string(alerts, '; ') AS alerts FROM al WHERE user_id % 13 > 0")
def weather_alerts(spark, d):
    w = _weather_rows(spark, d).where(F.col("report").isNotNull())
    return w.select("user_id", "report.total_rain_7d", F.array_join("report.alerts", "; ").alias("alerts"))


CONTEXT = f"""{WEEK}, w(code, name) AS (VALUES {Q.rows(R.WEATHER_CODES.items())}),
ln AS (SELECT user_id, string_agg('  ' || date || ': ' || CAST(tmin AS VARCHAR) || '–' || CAST(tmax AS VARCHAR) || '°C, ' || CASE WHEN rain_mm <> 0 THEN CAST(rain_mm AS VARCHAR) || 'mm rain (' ELSE 'No rain (' END
  || CAST(rain_prob AS VARCHAR) || '% chance)' || CASE WHEN et0 <> 0 THEN ', ET0: ' || CAST(et0 AS VARCHAR) || 'mm' ELSE '' END, chr(10) ORDER BY k) AS days FROM dy GROUP BY user_id),
cx AS (SELECT al.user_id, CASE WHEN user_id % 13 = 0 THEN 'Weather data unavailable.' ELSE '=== REAL-TIME WEATHER: Place ' || CAST(al.user_id AS VARCHAR) || ' ===' || chr(10) || 'As of 2025-06-01 08:00:' || chr(10)
  || 'Current: ' || coalesce(name, 'Unknown') || ', ' || coalesce(CAST(t AS VARCHAR), 'N/A') || '°C, Humidity ' || CAST(h AS VARCHAR) || '%, Wind ' || CASE WHEN user_id % 5 > 0 THEN CAST(CAST(user_id % 30 AS DOUBLE) AS VARCHAR) ELSE 'N/A' END || ' km/h' || chr(10)
  || 'Rainfall today: ' || CASE WHEN user_id % 2 > 0 THEN CAST((user_id % 7) / 4 AS VARCHAR) ELSE '0.0' END || ' mm' || chr(10) || chr(10) || '7-Day Forecast:' || chr(10) || days || chr(10)
  || CASE WHEN len(alerts) > 0 THEN chr(10) || '⚠️  Agricultural Alerts:' || chr(10) || array_to_string(list_transform(alerts, lambda a: '  • ' || a), chr(10)) || chr(10) ELSE '' END || '{"=" * 40}' END AS context
  FROM al JOIN ln USING (user_id) LEFT JOIN w ON code = al.user_id % 60)"""


@query("weather_context", f"WITH {CONTEXT} SELECT user_id, context FROM cx")
def weather_context(spark, d):
    return _weather_rows(spark, d).select("user_id", weather.weather_context(F.col("report")).alias("context"))


_question = "CASE WHEN user_id % 3 = 0 THEN 'Will it rain tomorrow in Salem?' ELSE 'What is compost?' END"


@query("enrich_weather", f"WITH {CONTEXT} SELECT user_id, CASE WHEN user_id % 3 = 0 AND user_id % 13 > 0 THEN context || chr(10) || chr(10) ELSE '' END || 'base text' AS context FROM cx")
def enrich_weather(spark, d):
    """A third of the users ask about the weather."""
    return _weather_rows(spark, d).select("user_id", weather.enrich(F.expr(_question), F.lit("base text"), F.col("report")).alias("context"))


@query("weather_codes", f"WITH w(code, name) AS (VALUES {Q.rows(R.WEATHER_CODES.items())}) SELECT event_id, coalesce(name, 'Unknown') AS condition FROM events LEFT JOIN w ON code = event_id % 100")
def weather_codes(spark, d):
    return table(spark, d, "events").select("event_id", weather.decode((F.col("event_id") % 100).cast("int")).alias("condition"))


@query("lookback_means", """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS s, count(value) AS n FROM events GROUP BY ALL),
w AS (SELECT event_type, day, sum(s) OVER m AS ms, sum(n) OVER m AS mn, sum(s) OVER k AS ks, sum(n) OVER k AS kn FROM d
  WINDOW m AS (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW), k AS (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW))
SELECT event_type, CAST(day AS VARCHAR) AS day, round(ms / nullif(mn, 0), 4) AS month_mean, round(ks / nullif(kn, 0), 4) AS week_mean, round(ks, 2) AS week_sum FROM w""")
def lookback_means(spark, d):
    """Readings of a place over the last thirty and seven days, for every day."""
    out = weather.lookback(table(spark, d, "events"), "value", ["event_type"])
    return out.select("event_type", F.col("day").cast("string").alias("day"), F.round("month_mean", 4).alias("month_mean"), F.round("week_mean", 4).alias("week_mean"), F.round("week_sum", 2).alias("week_sum"))


@query("lookback_stage", """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS s, count(value) AS n FROM events GROUP BY ALL),
w AS (SELECT event_type, day, sum(s) OVER m / nullif(sum(n) OVER m, 0) AS t, sum(s) OVER m AS r FROM d WINDOW m AS (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW))
SELECT event_type, CAST(day AS VARCHAR) AS day, CASE WHEN t IS NULL OR r IS NULL THEN 'none' WHEN r > 100 AND t BETWEEN 25 AND 35 THEN 'monsoon' ELSE 'other' END AS kind FROM w""")
def lookback_stage(spark, d):
    """The satellite's stage of each day from the thirty days up to it."""
    out = weather.lookback(table(spark, d, "events"), "value", ["event_type"], windows={"month": 30})
    stage = weather.satellite_stage(F.col("month_mean"), F.col("month_sum"))["stage"]
    kind = F.when(F.col("month_mean").isNull() | F.col("month_sum").isNull(), "none").when(stage == "active growth / monsoon stage", "monsoon").otherwise("other")
    return out.select("event_type", F.col("day").cast("string").alias("day"), kind.alias("kind"))


@query("soil_label", "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'UNAVAILABLE' WHEN value / 200 > 0.3 THEN 'WET — delay fertilizer application' WHEN value / 200 > 0.15 THEN 'OPTIMAL — good time for fertilizer' ELSE 'DRY — irrigate before fertilizing' END AS label FROM events")
def soil_label(spark, d):
    return table(spark, d, "events").select("event_id", weather.soil_label(F.when(F.col("event_id") % 11 != 0, F.col("value") / 200)).alias("label"))


SATELLITE = """s AS (SELECT user_id, avg(CASE WHEN event_id % 6 > 0 THEN 10 + (user_id * 7) % 30 + event_id % 3 END) AS t, sum(CASE WHEN event_id % 5 > 0 THEN round(value, 2) END) AS r FROM events GROUP BY user_id),
b AS (SELECT *, CASE WHEN r > 100 AND t BETWEEN 25 AND 35 THEN 'active growth / monsoon stage' WHEN r < 20 AND t > 35 THEN 'dry season management' WHEN r IS NOT NULL AND t < 15 THEN 'dormancy or winter stage' END AS stage,
  CASE WHEN r > 100 AND t BETWEEN 25 AND 35 THEN 0.7 WHEN r < 20 AND t > 35 THEN 0.6 WHEN r IS NOT NULL AND t < 15 THEN 0.6 ELSE 0.0 END AS confidence FROM s)"""


def _satellite(spark, d):
    e = table(spark, d, "events")
    series = e.select("user_id", F.when(F.col("event_id") % 6 > 0, 10 + (F.col("user_id") * 7) % 30 + F.col("event_id") % 3).alias("temperature"), F.when(F.col("event_id") % 5 > 0, F.round("value", 2)).alias("rain"))
    return weather.daily_means(series, "user_id").withColumn("s", weather.satellite_stage(F.col("avg_temp"), F.col("total_rain")))


@query("satellite_stage", f"WITH {SATELLITE} SELECT user_id, round(t, 4) AS avg_temp, round(r, 2) AS total_rain, stage, confidence FROM b")
def satellite_stage(spark, d):
    return _satellite(spark, d).select("user_id", F.round("avg_temp", 4).alias("avg_temp"), F.round("total_rain", 2).alias("total_rain"), "s.*")


@query("stage_selection", f"WITH {SATELLITE} SELECT user_id, CASE WHEN confidence > 0 THEN stage ELSE 'from calendar' END AS stage FROM b")
def stage_selection(spark, d):
    return _satellite(spark, d).select("user_id", weather.stage_choice(F.col("s"), F.lit("from calendar")).alias("stage"))


@query("seasonal_context", f"""WITH p(crop, season, alerts) AS (VALUES {Q.rows([(c, s, "".join(f"  ⚠️  {a}" + chr(10) for a in al)) for (c, s), al in R.PESTS.items()])}), cal(crop, month, stage) AS (VALUES {Q.rows(_calendar)}),
e AS (SELECT event_id, {CROP} AS crop, {SEASON} AS season, {MONTH} AS month, CASE WHEN event_id % 11 > 0 THEN (event_id % 40) / 100 END AS m FROM events)
SELECT event_id, chr(10) || '=== SEASONAL AGRICULTURAL CONTEXT ===' || chr(10) || 'Crop          : ' || e.crop || chr(10) || 'Growth Stage  : ' || coalesce(ca.stage, cb.stage) || ' (Month ' || CAST(e.month AS VARCHAR) || ')' || chr(10)
  || 'Soil Moisture : ' || CASE WHEN m IS NULL THEN 'UNAVAILABLE' WHEN m > 0.3 THEN 'WET — delay fertilizer application' WHEN m > 0.15 THEN 'OPTIMAL — good time for fertilizer' ELSE 'DRY — irrigate before fertilizing' END || chr(10)
  || 'Soil M³/M³    : ' || coalesce(CAST(m AS VARCHAR), 'None') || chr(10) || 'Season        : ' || e.season || chr(10) || 'Pest Alerts   :' || chr(10) || coalesce(a.alerts, b.alerts) || '======================================' AS context
FROM e LEFT JOIN p a ON a.crop = e.crop AND a.season = e.season LEFT JOIN p b ON b.crop = 'default' AND b.season = e.season LEFT JOIN cal ca ON ca.crop = e.crop AND ca.month = e.month LEFT JOIN cal cb ON cb.crop = 'default' AND cb.month = e.month""")
def seasonal_context(spark, d):
    m = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 11 > 0, (F.col("event_id") % 40) / 100).alias("m"))
    r = _season_rows(spark, d).join(m, "event_id")
    crop, month = F.col("crop"), F.col("month")
    return r.select("event_id", weather.seasonal_context(crop, gates.calendar_stage(crop, month), month, weather.soil_label(F.col("m")), F.col("m"), F.col("season"), gates.pest_alerts(crop, F.col("season"))).alias("context"))


_reply = """CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'no json' WHEN 2 THEN '{}' WHEN 3 THEN '{"query_type": "' || upper(event_type) || '", "complexity": "complex"}'
  ELSE '{"query_type": "DIAGNOSTIC", "confidence": 0.25, "reasoning": "why", "key_topics": ["a", "b"]}' END"""


@query("classify_reply", """SELECT event_id, CASE event_id % 5 WHEN 3 THEN upper(event_type) WHEN 4 THEN 'DIAGNOSTIC' ELSE 'FACTUAL' END AS query_type, CAST(CASE event_id % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 0.5 WHEN 4 THEN 0.25 ELSE 0.7 END AS DOUBLE) AS confidence,
  CASE event_id % 5 WHEN 3 THEN 'complex' ELSE 'simple' END AS complexity, CASE event_id % 5 WHEN 4 THEN 'a,b' ELSE '' END AS topics FROM events""")
def classify_reply(spark, d):
    """Replies of a classifying model: none, no JSON, without keys, with some, with all."""
    c = table(spark, d, "events").select("event_id", gates.parsed_classification(F.expr(_reply)).alias("c"))
    return c.select("event_id", "c.query_type", "c.confidence", "c.complexity", F.array_join("c.key_topics", ",").alias("topics"))


@query("service_replies", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 13.0827 ELSE round(10 + event_id / 12345.0, 4) END AS latitude, CASE WHEN event_id % 3 = 0 THEN 'Chennai, Tamil Nadu' ELSE 'Place' END AS place, event_id % 3 > 0 AS found,
  CASE WHEN event_id % 4 > 0 THEN CAST(event_id % 50 AS DOUBLE) END AS temperature, CASE WHEN event_id % 4 > 0 THEN 1.5 END AS et0, CASE WHEN event_id % 5 > 0 THEN event_id % 40 / 100 END AS soil_moisture,
  CASE WHEN event_id % 5 > 0 THEN 'reading' ELSE 'Soil moisture data unavailable' END AS advisory, CASE WHEN event_id % 6 > 0 THEN event_id % 45 + 0.5 END AS avg_temp FROM events""")
def service_replies(spark, d):
    """Replies of the four services, some of them broken."""
    from sheaf.sources import services as V

    e, i = texts(spark, d, "events").select("event_id"), F.col("event_id")  # one row group of many rows would be one task
    text = lambda n, fmt, *c: F.when(i % n == 0, "oops").otherwise(F.format_string(fmt, *c))
    rows = e.select(
        "event_id", V.place_of(text(3, '[{"lat": "%s", "lon": "77.1", "display_name": "Place"}]', (10 + i / 12345.0).cast("string"))).alias("g"),
        V.weather_of(text(4, '{"current": {"temperature_2m": %d.0, "weather_code": 3}, "daily": {"time": ["x"], "et0_fao_evapotranspiration": [1.5]}}', i % 50)).alias("w"),
        V.soil_of(text(5, '{"hourly": {"soil_moisture_0_to_1cm": [%s]}}', ((i % 40) / 100).cast("string"))).alias("s"),
        V.satellite_of(text(6, '{"properties": {"parameter": {"T2M": {"a": %d, "b": null, "c": %d}, "PRECTOTCORR": {"a": 1.0}}}}', i % 45, i % 45 + 1)).alias("n"))
    return rows.select("event_id", "g.latitude", "g.place", "g.found", F.col("w.current.temperature").alias("temperature"), F.get("w.daily.et0", 0).alias("et0"), "s.soil_moisture",
                       F.when(F.col("s.advisory").startswith("Soil"), F.col("s.advisory")).otherwise("reading").alias("advisory"), "n.avg_temp")
