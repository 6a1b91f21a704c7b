"""Weather, soil and satellite readings to labels, alerts and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.rules import WEATHER_CODES

from .gates import is_weather_query


def decode(code: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for item in WEATHER_CODES.items() for x in item))[code], F.lit("Unknown"))


def forecast(daily: Column, days: int = 7) -> Column:
    """Parallel arrays of a day each as an array of structs, the first ``days`` dates. A shorter array leaves null, rain and its probability 0."""
    at = lambda name, i: F.get(daily[name], i)
    return F.transform(F.slice(F.coalesce(daily["date"], F.array().cast("array<string>")), 1, days), lambda d, i: F.struct(
        d.alias("date"), at("tmax", i).alias("tmax"), at("tmin", i).alias("tmin"), F.coalesce(at("rain", i), F.lit(0.0)).alias("rain_mm"),
        F.coalesce(at("rain_prob", i), F.lit(0.0)).alias("rain_prob"), at("et0", i).alias("et0"), at("uv", i).alias("uv")))


def total_rain(days: Column, n: int = 7) -> Column:
    return F.aggregate(F.slice(days, 1, n), F.lit(0.0), lambda s, x: s + F.coalesce(x["rain_mm"], F.lit(0.0)))


def alerts(days: Column, temperature: Column, humidity: Column) -> Column:
    """The six rules in order; a temperature or humidity of 0 or null raises none."""
    rain = total_rain(days)
    # The alerts' thresholds and texts.
    found = F.array(
        F.when(rain > 100, "Heavy rainfall expected — avoid pesticide spraying"),
        F.when(rain < 5, "Dry week ahead — irrigation required"),
        F.when((temperature != 0) & (temperature > 38), "High heat stress risk — water crops in early morning"),
        F.when((temperature != 0) & (temperature < 15), "Cold temperature — protect sensitive seedlings"),
        F.when(humidity > 85, "High humidity — fungal disease risk is elevated"),
        F.when(F.exists(F.slice(days, 1, 3), lambda x: F.coalesce(x["rain_prob"] > 70, F.lit(False))), "Rain likely in next 3 days — delay fertilizer application"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def soil_label(moisture: Column) -> Column:
    # Bounds and labels.
    return F.when(moisture.isNull(), "UNAVAILABLE").when(moisture > 0.3, "WET — delay fertilizer application").when(moisture > 0.15, "OPTIMAL — good time for fertilizer").otherwise("DRY — irrigate before fertilizing")


def soil_advisory(moisture: Column) -> Column:
    """The label as advice; a missing reading says so."""
    return F.when(moisture.isNull(), "Soil moisture data unavailable").otherwise(soil_label(moisture))


def lookback(readings: DataFrame, value: str, by: list[str], ts: str = "ts", windows: dict[str, int] | None = None) -> DataFrame:
    """``by, day, name_mean, name_sum...``: for each place and day with a reading, means and sums over the days from ``n - 1`` before it to itself, a pair for each window (``name: n``; month and week by default).

    Readings are summed up by day first, before anything is shuffled, so a place with most of the readings costs its days, not its rows. Null readings do not count; a window without any has null.
    """
    windows = windows or {"month": 30, "week": 7}
    days = readings.where(F.col(ts).isNotNull()).groupBy(*by, F.to_date(ts).alias("day")).agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"))
    keys = ", ".join(f"`{c}`" for c in by)
    over = lambda what, n: F.expr(f"sum({what}) OVER (PARTITION BY {keys} ORDER BY day RANGE BETWEEN INTERVAL {n - 1} DAYS PRECEDING AND CURRENT ROW)")
    sums = days.select(*by, "day", *(over(x, n).alias(f"_{name}{x}") for name, n in windows.items() for x in ("_sum", "_n")))
    return sums.select(*by, "day", *(c for name in windows for c in ((F.col(f"_{name}_sum") / F.nullif(F.col(f"_{name}_n"), F.lit(0))).alias(f"{name}_mean"), F.col(f"_{name}_sum").alias(f"{name}_sum"))))


def satellite_stage(temperature: Column, rain: Column) -> Column:
    """``struct(stage, confidence)`` of mean temperature and total rain over the window; without either there is no stage."""
    pick = lambda stage, c: F.struct(F.lit(stage).alias("stage"), F.lit(c).alias("confidence"))
    # Bounds, stages and confidences.
    return (
        F.when(temperature.isNull() | rain.isNull(), pick(None, 0.0))
        .when((rain > 100) & temperature.between(25, 35), pick("active growth / monsoon stage", 0.7))
        .when((rain < 20) & (temperature > 35), pick("dry season management", 0.6))
        .when(temperature < 15, pick("dormancy or winter stage", 0.6))
        .otherwise(pick(None, 0.0))
    )


def daily_means(series: DataFrame, by: str) -> DataFrame:
    """Mean temperature and total rain of ``temperature, rain`` rows, ignoring nulls; null where there are nulls only."""
    return series.groupBy(by).agg(F.avg("temperature").alias("avg_temp"), F.sum("rain").alias("total_rain"))


def stage_choice(satellite: Column, calendar: Column) -> Column:
    """The satellite's stage where it has any confidence, else the calendar's."""
    return F.when(satellite["confidence"] > 0, satellite["stage"]).otherwise(calendar)


def seasonal_context(crop: Column, stage: Column, month: Column, soil: Column, moisture: Column, season: Column, pests: Column) -> Column:
    lines = F.array_join(F.transform(pests, lambda a: F.concat(F.lit("  ⚠️  "), a, F.lit("\n"))), "")
    # The lines of the block.
    return F.concat(
        F.lit("\n=== SEASONAL AGRICULTURAL CONTEXT ===\nCrop          : "), crop, F.lit("\nGrowth Stage  : "), stage, F.lit(" (Month "), month.cast("string"), F.lit(")\nSoil Moisture : "), soil,
        F.lit("\nSoil M³/M³    : "), F.coalesce(moisture.cast("string"), F.lit("None")), F.lit("\nSeason        : "), season, F.lit("\nPest Alerts   :\n"), lines, F.lit("=" * 38))


def weather_report(raw: Column, place: Column, at: Column) -> Column:
    """A service's reading (``schemas.WEATHER``) as place, time, current conditions, seven days, rain and alerts; null for no reading."""
    days = forecast(raw["daily"])
    now = raw["current"]
    current = F.struct(now["temperature"].alias("temperature_c"), now["humidity"].alias("humidity_pct"), F.coalesce(now["rain"], F.lit(0.0)).alias("rain_mm"), now["wind"].alias("wind_kmh"), decode(F.coalesce(now["code"], F.lit(0))).alias("condition"))
    return F.when(raw.isNotNull(), F.struct(
        place.alias("location"), at.alias("timestamp"), current.alias("current"), days.alias("forecast_7d"), F.round(total_rain(days), 1).alias("total_rain_7d"), alerts(days, now["temperature"], now["humidity"]).alias("alerts")))


def weather_context(report: Column) -> Column:
    """A report as a block of text: current conditions, a line a day, alerts."""
    shown = lambda x, missing: F.coalesce(x.cast("string"), F.lit(missing))
    now = report["current"]
    # The lines of the block.
    rain = lambda d: F.when(d["rain_mm"] != 0, F.concat(d["rain_mm"].cast("string"), F.lit("mm rain ("), shown(d["rain_prob"], "None"), F.lit("% chance)"))).otherwise(F.concat(F.lit("No rain ("), shown(d["rain_prob"], "None"), F.lit("% chance)")))
    days = F.transform(report["forecast_7d"], lambda d: F.concat(
        F.lit("  "), d["date"], F.lit(": "), shown(d["tmin"], "None"), F.lit("–"), shown(d["tmax"], "None"), F.lit("°C, "), rain(d), F.when(d["et0"] != 0, F.concat(F.lit(", ET0: "), d["et0"].cast("string"), F.lit("mm"))).otherwise("")))
    warned = F.when(F.size(report["alerts"]) > 0, F.concat(F.array(F.lit("\n⚠️  Agricultural Alerts:")), F.transform(report["alerts"], lambda a: F.concat(F.lit("  • "), a)))).otherwise(F.array().cast("array<string>"))
    head = F.array(
        F.concat(F.lit("=== REAL-TIME WEATHER: "), report["location"], F.lit(" ===")), F.concat(F.lit("As of "), report["timestamp"], F.lit(":")),
        F.concat(F.lit("Current: "), now["condition"], F.lit(", "), shown(now["temperature_c"], "N/A"), F.lit("°C, Humidity "), shown(now["humidity_pct"], "N/A"), F.lit("%, Wind "), shown(now["wind_kmh"], "N/A"), F.lit(" km/h")),
        F.concat(F.lit("Rainfall today: "), shown(now["rain_mm"], "0"), F.lit(" mm")), F.lit(""), F.lit("7-Day Forecast:"))
    return F.when(report.isNull(), "Weather data unavailable.").otherwise(F.array_join(F.concat(head, days, warned, F.array(F.lit("=" * 40))), "\n"))


def enrich(query: Column, context: Column, report: Column) -> Column:
    """The context with the weather in front of it, for a weather question that has a report."""
    return F.when(is_weather_query(query) & report.isNotNull(), F.concat(weather_context(report), F.lit("\n\n"), context)).otherwise(context)
