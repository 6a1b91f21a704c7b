"""Readings from services (weather, soil, satellite, places), each with a default for when the service fails.

A service is a function ``key -> dict``; it runs on the executors, one call a row, and never sees more than its timeout. Without one the
defaults stand, so everything works offline.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sheaf.operators import weather
from sheaf.session import ship

# The place of what cannot be found, and of the context gate.
DEFAULT_PLACE = {"latitude": 13.0827, "longitude": 80.2707, "place": "Chennai, Tamil Nadu"}
CENTRE = {"latitude": 20.5937, "longitude": 78.9629}
DEFAULT_SOIL = {"soil_moisture": None, "label": "UNAVAILABLE"}
DEFAULT_SATELLITE = {"stage": None, "confidence": 0.0}


def _once(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is computed once a row, however often it is named: a reply is not parsed again for each of its fields."""
    return F.get(F.transform(F.array(value), make), 0)


def place_of(reply: Column) -> Column:
    """A geocoder's JSON reply (an array of matches) as ``struct(latitude, longitude, place, found)``: the first match, four places; else the default."""
    d = DEFAULT_PLACE

    def made(first: Column) -> Column:
        found = first["lat"].isNotNull() & first["lon"].isNotNull()
        return F.struct(
            F.when(found, F.round(first["lat"].cast("double"), 4)).otherwise(d["latitude"]).alias("latitude"), F.when(found, F.round(first["lon"].cast("double"), 4)).otherwise(d["longitude"]).alias("longitude"),
            F.when(found, first["display_name"]).otherwise(d["place"]).alias("place"), found.alias("found"))

    return _once(F.get(F.from_json(reply, "array<struct<lat:string,lon:string,display_name:string>>"), 0), made)


def weather_of(reply: Column) -> Column:
    """A forecast service's JSON reply as ``schemas.WEATHER``; null where it is none."""
    read = F.from_json(reply, "current struct<temperature_2m:double,relative_humidity_2m:double,rain:double,wind_speed_10m:double,weather_code:int>, daily struct<time:array<string>,rain_sum:array<double>,"
                       "temperature_2m_max:array<double>,temperature_2m_min:array<double>,precipitation_probability_max:array<double>,et0_fao_evapotranspiration:array<double>,uv_index_max:array<double>>")

    def made(r: Column) -> Column:
        now, day = r["current"], r["daily"]
        return F.when(now.isNotNull() | day.isNotNull(), F.struct(
            F.struct(now["temperature_2m"].alias("temperature"), now["relative_humidity_2m"].alias("humidity"), now["rain"].alias("rain"), now["wind_speed_10m"].alias("wind"), now["weather_code"].alias("code")).alias("current"),
            F.struct(day["time"].alias("date"), day["temperature_2m_max"].alias("tmax"), day["temperature_2m_min"].alias("tmin"), day["rain_sum"].alias("rain"), day["precipitation_probability_max"].alias("rain_prob"),
                     day["et0_fao_evapotranspiration"].alias("et0"), day["uv_index_max"].alias("uv")).alias("daily")))

    return _once(read, made)


def soil_of(reply: Column) -> Column:
    """A soil service's JSON reply as ``struct(soil_moisture, label, advisory, precipitation, evapotranspiration)``: the first hour and day."""
    read = F.from_json(reply, "hourly struct<soil_moisture_0_to_1cm:array<double>>, daily struct<precipitation_sum:array<double>,et0_fao_evapotranspiration:array<double>>")

    def made(r: Column) -> Column:
        m = F.get(r["hourly"]["soil_moisture_0_to_1cm"], 0)
        return F.struct(m.alias("soil_moisture"), weather.soil_label(m).alias("label"), weather.soil_advisory(m).alias("advisory"),
                        F.get(r["daily"]["precipitation_sum"], 0).alias("precipitation"), F.get(r["daily"]["et0_fao_evapotranspiration"], 0).alias("evapotranspiration"))

    return _once(read, made)


def satellite_of(reply: Column) -> Column:
    """A satellite service's JSON reply (values by day) as ``struct(stage, confidence, avg_temp, total_rain)``; nulls are left out of means and sums."""
    read = F.from_json(reply, "properties struct<parameter:struct<T2M:map<string,double>,PRECTOTCORR:map<string,double>>>")
    some = lambda r, m: F.filter(F.map_values(r["properties"]["parameter"][m]), lambda x: x.isNotNull())
    total = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x))

    def made(v: Column) -> Column:
        stage = weather.satellite_stage(v["mean"], v["rain"])
        return F.struct(stage["stage"].alias("stage"), stage["confidence"].alias("confidence"), v["mean"].alias("avg_temp"), v["rain"].alias("total_rain"))

    lists = _once(read, lambda r: F.struct(some(r, "T2M").alias("t"), some(r, "PRECTOTCORR").alias("p")))
    return _once(_once(lists, lambda v: F.struct((total(v["t"]) / F.size(v["t"])).alias("mean"), total(v["p"]).alias("rain"))), made)


# What to ask of each public service: address, seconds to wait, parameters.
REQUESTS = {
    "place": ("https://nominatim.openstreetmap.org/search", 5, {"format": "json", "limit": "1"}),
    "weather": ("https://api.open-meteo.com/v1/forecast", 8, {"current": "temperature_2m,relative_humidity_2m,rain,wind_speed_10m,weather_code", "daily": "temperature_2m_max,temperature_2m_min,rain_sum,precipitation_probability_max,et0_fao_evapotranspiration,uv_index_max,wind_speed_10m_max", "forecast_days": "7", "timezone": "Asia/Kolkata"}),
    "soil": ("https://api.open-meteo.com/v1/forecast", 10, {"hourly": "soil_moisture_0_to_1cm", "daily": "precipitation_sum,et0_fao_evapotranspiration", "forecast_days": "1", "timezone": "Asia/Kolkata"}),
    "satellite": ("https://power.larc.nasa.gov/api/temporal/daily/point", 10, {"parameters": "ALLSKY_SFC_SW_DWN,T2M,PRECTOTCORR", "community": "AG", "format": "JSON"}),
}
SATELLITE_DAYS = 30


def request_of(service: str, key: dict, today: str | None = None) -> str:
    """The address that asks a service for ``{latitude, longitude}``, or for the coordinates of ``{location}`` in India; ``today`` (ISO date) ends the satellite's window of thirty days."""
    import datetime
    import urllib.parse

    address, _, fixed = REQUESTS[service]
    if service == "place":
        asked = fixed | {"q": f"{key['location']}, India"}
    else:
        asked = fixed | {"latitude": key["latitude"], "longitude": key["longitude"]}
    if service == "satellite":
        end = datetime.date.fromisoformat(today) if today else datetime.date.today()
        asked |= {"start": (end - datetime.timedelta(days=SATELLITE_DAYS)).strftime("%Y%m%d"), "end": end.strftime("%Y%m%d")}
    return f"{address}?{urllib.parse.urlencode(asked)}"


def fetcher(service: str, today: str | None = None) -> Callable[[dict], dict]:
    """A function ``key -> {reply}`` that asks a service over HTTP, for ``readings`` (keys as in ``request_of``)."""
    wait = REQUESTS[service][1]

    def fetch(key: dict) -> dict:
        import urllib.request

        asked = urllib.request.Request(request_of(service, key, today), headers={"User-Agent": "sheaf"})
        with urllib.request.urlopen(asked, timeout=wait) as got:  # noqa: S310  fixed https addresses
            return {"reply": got.read().decode()}

    return fetch


def readings(keys: DataFrame, schema: str, default: dict, fetch: Callable[[dict], dict] | None = None) -> DataFrame:
    """``keys``' columns with the fields of ``schema``: what ``fetch`` returns, or ``default`` where it raises, returns nothing or is not given.

    Equal keys are asked once. Calls that shall be remembered from one run to the next go through ``ledger.replies``.
    """
    ship(keys.sparkSession)
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    kinds = dict(keys.dtypes)
    full = ", ".join(f"`{c}` {kinds[c]}" for c in keys.columns) + ", " + schema

    def run(batches: Iterator):
        import pandas as pd

        for pdf in batches:
            rows = []
            for key in pdf.to_dict("records"):
                try:
                    got = fetch(key) if fetch else None
                except Exception:  # noqa: BLE001  a failing service must not fail the batch
                    got = None
                rows.append({c: (got or default).get(c) for c in names})
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    asked = keys.distinct().mapInPandas(run, full).select(F.struct(*keys.columns).alias("_key"), *names)
    return keys.withColumn("_own", F.struct(*keys.columns)).join(asked, F.col("_own").eqNullSafe(F.col("_key"))).select(*keys.columns, *names)


class RowsSource(DataSource):
    """``spark.read.format("service")``: rows of a callable named ``module:function`` that takes a partition number and yields tuples."""

    @classmethod
    def name(cls) -> str:
        return "service"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.call, self.parts = options["call"], int(options.get("parts", "1"))

    def partitions(self):
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition):
        import importlib

        module, name = self.call.split(":")
        yield from getattr(importlib.import_module(module), name)(partition.value)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(RowsSource)


def with_metadata_defaults(files: DataFrame, known: DataFrame, year: int = 2024, authority: float = 0.9) -> DataFrame:
    """Metadata of each file: what is known, else what new files get."""
    out = files.join(known, "source_file", "left")
    values = {"title": F.col("source_file"), "source_org": F.lit(""), "year": F.lit(year), "authority_score": F.lit(authority), "bias_penalty": F.lit(0.0), "domain": F.lit("agriculture"), "region": F.lit("India")}
    for c, v in values.items():
        out = out.withColumn(c, F.coalesce(c, v) if c in out.columns else v)
    return out


def scraped_metadata(links: DataFrame) -> DataFrame:
    """Metadata of scraped files ``(source_file, title, source_name, source_domain, priority)``: the source's priority is the authority."""
    return links.select(
        "source_file", "title", F.col("source_name").alias("source_org"), F.col("source_domain").alias("publisher"), F.lit(2024).alias("year"), F.col("priority").alias("authority_score"),
        F.lit(0.0).alias("bias_penalty"), F.lit("agriculture_research").alias("domain"), F.lit("India").alias("region"))
