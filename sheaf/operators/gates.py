"""Query classification, routing, context gates and their statistics. Rules are literal columns: nothing is joined that grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.functions import rules as R
from sheaf.functions.numbers import rounded

ENTROPY_THRESHOLD, MIN_CONFIDENCE = 1.5, 0.6
FAST_TYPES = ("FACTUAL", "STATISTICAL")
GATED_TYPES = ("RECOMMENDATION", "DIAGNOSTIC", "PROCEDURAL")
WEATHER_TYPES = ("RECOMMENDATION", "DIAGNOSTIC")

#: Offline classifier: first matching rule wins; (type, words any of which the lower-cased query contains).
CLASSIFIER = (
    ("DIAGNOSTIC", ("why ", "disease", "symptom", "yellow", "spots", "problem")),
    ("RECOMMENDATION", ("should", "recommend", "best ", "suggest")),
    ("PROCEDURAL", ("how to", "how do", "steps", "procedure")),
    ("COMPARATIVE", ("compare", "versus", " vs ", "difference")),
    ("STATISTICAL", ("how many", "how much", "rate", "average", "number")),
)


def first_contained(text: Column, words, default: str | None = None) -> Column:
    """The first of ``words`` that is a substring of ``text`` (already lower-cased), else ``default``."""
    return F.coalesce(*(F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words), F.lit(default))


def is_weather_query(q: Column, words=R.WEATHER_WORDS) -> Column:
    low = F.lower(F.coalesce(q, F.lit("")))
    return F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(low, w))


def location(q: Column, patterns=R.LOCATIONS, default: str = R.DEFAULT_LOCATION) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(F.coalesce(q, F.lit("")), p, 1), F.lit("")) for p in patterns), F.lit(default))


def crop_of(q: Column, crops=R.CROP_NAMES) -> Column:
    return first_contained(F.lower(F.coalesce(q, F.lit(""))), crops, "default")


def season(month: Column) -> Column:
    return F.when(month.isin(6, 7, 8, 9), "monsoon").when(month.isin(3, 4, 5), "summer").otherwise("winter")


def calendar_stage(crop: Column, month: Column) -> Column:
    table = F.create_map(*(x for c, stages in R.CALENDAR.items() for x in (F.lit(c), F.array(*(F.lit(s) for s in stages)))))
    return F.get(F.coalesce(table[crop], table[F.lit("default")]), month - 1)


def pest_alerts(crop: Column, season_name: Column) -> Column:
    table = F.create_map(*(x for (c, s), alerts in R.PESTS.items() for x in (F.lit(f"{c}/{s}"), F.array(*(F.lit(a) for a in alerts)))))
    return F.coalesce(table[F.concat(crop, F.lit("/"), season_name)], table[F.concat(F.lit("default/"), season_name)])


def shannon_entropy(logprobs: Column) -> Column:
    """Mean of -p log2 p over an array of log probabilities, four places; empty or null gives 0."""
    total = F.aggregate(logprobs, F.lit(0.0), lambda s, lp: s - F.when(F.exp(lp) > 0, F.exp(lp) * F.log2(F.exp(lp))).otherwise(0.0))
    return F.when(F.coalesce(F.size(logprobs), F.lit(0)) > 0, rounded(total / F.size(logprobs), 4)).otherwise(0.0)


def entropy_proxy(response: Column) -> Column:
    """By the words of a response: 0.8 under 15, 1.2 under 25, else 2; a missing response counts as uncertain (threshold + 0.5)."""
    stripped = F.regexp_replace(response, r"^\s+|\s+$", "")
    words = F.when(stripped == "", 0).otherwise(F.size(F.split(stripped, r"\s+")))
    return F.when(response.isNull(), ENTROPY_THRESHOLD + 0.5).when(words < 15, 0.8).when(words < 25, 1.2).otherwise(2.0)


def classify(q: Column) -> Column:
    """``struct(query_type, confidence, complexity)`` by the offline rules; a null query is FACTUAL at 0.5 and complex."""
    low = F.lower(F.coalesce(q, F.lit("")))
    kind = F.coalesce(*(F.when(F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(low, w)), F.lit(t)) for t, words in CLASSIFIER), F.lit("FACTUAL"))
    ruled = kind != "FACTUAL"
    words = F.size(F.split(low, r"\s+"))
    return F.struct(
        kind.alias("query_type"),
        F.when(q.isNull(), 0.5).when(ruled, 0.9).otherwise(F.when(words <= 30, 0.7).otherwise(0.5)).alias("confidence"),
        F.when(q.isNotNull() & (words <= 12), "simple").otherwise("complex").alias("complexity"),
    )


def parsed_classification(reply: Column) -> Column:
    """A model's JSON reply as ``struct(query_type, confidence, complexity, reasoning, key_topics)``: defaults for missing keys, FACTUAL at 0.5 where it is no JSON."""
    read = F.from_json(reply, "query_type string, confidence double, complexity string, reasoning string, key_topics array<string>, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    ok = reply.isNotNull() & read["_bad"].isNull()
    return F.struct(
        F.when(ok, F.coalesce(read["query_type"], F.lit("FACTUAL"))).otherwise("FACTUAL").alias("query_type"),
        F.when(ok, F.coalesce(read["confidence"], F.lit(0.7))).otherwise(0.5).alias("confidence"),
        F.when(ok, F.coalesce(read["complexity"], F.lit("simple"))).otherwise("simple").alias("complexity"),
        F.when(ok, F.coalesce(read["reasoning"], F.lit(""))).otherwise("error: no JSON").alias("reasoning"),
        F.when(ok, F.coalesce(read["key_topics"], F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("key_topics"),
    )


def route(df: DataFrame, threshold: Column | float = ENTROPY_THRESHOLD) -> DataFrame:
    """``path`` and ``reason`` from entropy, query_type, complexity, confidence."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    low, kind = F.col("entropy") < t, F.col("query_type").isin(*FAST_TYPES)
    simple, sure = F.col("complexity") == "simple", F.col("confidence") >= MIN_CONFIDENCE
    text = lambda c: c.cast("string")
    why = F.concat_ws(
        " + ",
        F.when(~low, F.concat(F.lit("high entropy ("), text(F.col("entropy")), F.lit(" >= "), text(t), F.lit(")"))),
        F.when(~kind, F.concat(F.lit("complex type: "), F.col("query_type"))),
        F.when(~simple, F.lit("complex query")),
        F.when(~sure, F.concat(F.lit("low confidence ("), text(F.col("confidence")), F.lit(")"))),
    )
    fast = low & kind & simple & sure
    quick = F.concat(F.lit("low entropy ("), text(F.col("entropy")), F.lit(") + simple "), F.col("query_type"), F.lit(" query"))
    return df.withColumn("path", F.when(fast, "fast").otherwise("slow")).withColumn("reason", F.when(fast, quick).otherwise(why))


def stage_key(stage: Column, stages=R.STAGES) -> Column:
    """Rule key of a stage: exact, else the first key that contains it or that it contains, else default."""
    s = F.lower(F.regexp_replace(F.coalesce(stage, F.lit("")), r"^\s+|\s+$", ""))
    exact = [F.when(s == k, F.lit(k)) for k in stages]
    part = [F.when(F.contains(F.lit(k), s) | F.contains(s, F.lit(k)), F.lit(k)) for k in stages]
    return F.when(s == "", "default").otherwise(F.coalesce(*exact, *part, F.lit("default")))


def stage_gate(df: DataFrame, text: str = "text", stage: str = "stage", stages=R.STAGES) -> DataFrame:
    """``compatible, gate_reason, matched_blocked, matched_allowed``: the first blocked keyword blocks, else the first allowed one passes, else neutral."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))

    def first(which: int) -> Column:
        found = [F.when(F.col("_stage_key") == k, first_contained(low, [w.lower() for w in lists[which]])) for k, lists in stages.items() if lists[which]]
        shown = F.create_map(*(F.lit(x) for w in dict.fromkeys(w for lists in stages.values() for w in lists[which]) for x in (w.lower(), w)))
        return shown[F.coalesce(*found, F.lit(None).cast("string"))]

    permissive = F.col("_stage_key").isin(*(k for k, (allowed, _) in stages.items() if not allowed))
    out = df.withColumn("_stage_key", stage_key(F.col(stage), stages))
    out = out.withColumn("matched_blocked", F.when(~permissive, first(1))).withColumn("matched_allowed", F.when(~permissive & F.col("matched_blocked").isNull(), first(0)))
    # The reasons.
    reason = (
        F.when(permissive, "Default stage — permissive")
        .when(F.col("matched_blocked").isNotNull(), F.concat(F.lit("Contains blocked topic: "), F.col("matched_blocked")))
        .when(F.col("matched_allowed").isNotNull(), F.concat(F.lit("Matches allowed topic: "), F.col("matched_allowed")))
        .otherwise("Neutral content — allowed by default")
    )
    return out.withColumn("compatible", F.col("matched_blocked").isNull()).withColumn("gate_reason", reason).drop("_stage_key")


def apply_gate(gated: DataFrame, by: str = "query_id") -> DataFrame:
    """Keep what is compatible; where nothing of a query is, keep all of it (``fell_back``)."""
    some = F.max(F.col("compatible").cast("int")).over(Window.partitionBy(by)) == 1
    return gated.withColumn("fell_back", ~some).where(F.col("compatible") | F.col("fell_back"))


def gate_statistics(log: DataFrame, columns=("stage", "matched_blocked_keyword", "blocked_source")) -> DataFrame:
    """``item, value, n``: the number of rows and the commonest non-null value of each column, the one seen first on ties (``seq`` orders the log). All columns are counted in one scan."""
    values = F.array(*(F.struct(F.lit(c).alias("item"), F.col(c).cast("string").alias("value")) for c in columns))
    counts = log.select("seq", F.explode(values).alias("x")).select("seq", "x.*").where(F.col("value").isNotNull()).groupBy("item", "value").agg(F.count("*").alias("n"), F.min("seq").alias("_first"))
    best = counts.groupBy("item").agg(F.max_by(F.struct("value", "n"), F.struct(F.col("n"), -F.col("_first"))).alias("b")).select("item", "b.*")
    return log.agg(F.lit("total").alias("item"), F.lit(None).cast("string").alias("value"), F.count("*").alias("n")).select("item", "value", "n").unionByName(best)


def phenology_applies(query_type: Column) -> Column:
    return query_type.isin(*GATED_TYPES)


def weather_applies(query_type: Column, q: Column) -> Column:
    return query_type.isin(*WEATHER_TYPES) & is_weather_query(q)
