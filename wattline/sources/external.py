"""Sources outside the market operator: weather observations and forecasts, fuel price, outage schedules, gridded forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.clock import local_date, local_to_utc, round_to_hour
from wattline.functions.numeric import nan_to_null
from wattline.sources.feeds import read_text_rows
from wattline.settings import MARKET_TZ

# fixed values: physical ranges outside which a report is dropped
OBS_RANGES = {"temp_c": (-45.0, 45.0), "dewpoint_c": (-60.0, 35.0), "wind_ms": (0.0, 60.0)}
OBS_COLUMNS = {"DATE": "obs_utc", "temperature": "temp_c", "dew_point_temperature": "dewpoint_c", "wind_speed": "wind_ms"}
# fixed values: columns of the archived outage schedule; older files have no message, which then is NULL
OUTAGE_HEADERS = ["PTID", "Outage ID", "Equipment Name", "Equipment Type", "Date Out", "Time Out", "Date In", "Time In", "Called In", "Status", "Status Date", "Message"]
# fixed values: forecast latencies in hours
FORECAST_LATENCY_H = 6
GRID_RUN_LATENCY_H = 2


def weather_observations(raw: DataFrame) -> DataFrame:
    """Station reports (text columns DATE, temperature, dew_point_temperature, wind_speed, station) -> hourly means.

    A report counts for its nearest hour; the mean is known half an hour after it.
    """
    rows = raw.select("station", *[F.col(src).alias(dst) for src, dst in OBS_COLUMNS.items()])
    rows = rows.withColumn("obs_utc", F.try_to_timestamp("obs_utc"))
    for c, (lo, hi) in OBS_RANGES.items():
        v = F.col(c).try_cast("double")
        rows = rows.withColumn(c, F.when(v.between(lo, hi), v))
    useful = F.coalesce(*[F.col(c) for c in OBS_RANGES]).isNotNull() & F.col("obs_utc").isNotNull()
    hourly = rows.filter(useful).groupBy(round_to_hour(F.col("obs_utc")).alias("ts_utc"), "station").agg(
        *[F.avg(c).alias(c) for c in OBS_RANGES], F.count(F.lit(1)).alias("n_reports"))
    return hourly.withColumn("available_utc", F.col("ts_utc") + F.expr("INTERVAL 30 MINUTE"))


def read_weather_observations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Pipe-separated station files; the station code is the part of the file name before the first underscore."""
    raw = read_text_rows(spark, paths, list(OBS_COLUMNS), sep="|")
    return weather_observations(raw.withColumn("station", F.regexp_extract("_file", r"([^/_]+)_[^/]*$", 1)))


def forecast_vintages(wide: DataFrame, station: str = "station", ts: str = "ts_utc", stem: str = "temperature_2m") -> DataFrame:
    """One column per lead (`stem`, `stem_previous_day1` ..) -> one row per (hour, station, lead) with its publication time."""
    leads = [c for c in wide.columns if c == stem or c.startswith(f"{stem}_previous_day")]
    long = wide.unpivot([station, ts], leads, "_var", "temp_c").filter(F.col("temp_c").isNotNull())
    lead = F.coalesce(F.regexp_extract("_var", r"previous_day(\d+)$", 1).try_cast("int"), F.lit(0))
    long = long.withColumn("lead_days", lead)
    known = F.col(ts) - F.make_dt_interval(F.col("lead_days")) + F.make_dt_interval(hours=F.lit(FORECAST_LATENCY_H))
    return long.select(F.col(ts).alias("ts_utc"), F.col(station).alias("station"), "lead_days", F.col("temp_c").cast("double"),
                       known.alias("available_utc"))


def gas_prices(raw: DataFrame, tz: str = MARKET_TZ) -> DataFrame:
    """(trade_date, price) -> price known from the next local midnight."""
    rows = raw.select(F.col("trade_date").cast("date"), F.col("price_usd_mmbtu").cast("double")).dropna()
    return rows.withColumn("available_utc", local_to_utc(F.date_add("trade_date", 1).cast("timestamp"), tz))


def outage_schedule(raw: DataFrame, tz: str = MARKET_TZ) -> DataFrame:
    """Archived snapshots of the forward outage schedule; the snapshot time is in the file name (YYYYMMDDTHHMMZ.csv)."""
    stamp = F.try_to_timestamp(F.regexp_extract("_file", r"(\d{8}T\d{4})Z\.csv$", 1), F.lit("yyyyMMdd'T'HHmm"))
    def at(day: str, time: str | None, fmt: str):
        text = F.concat_ws(" ", F.trim(f"`{day}`"), F.trim(f"`{time}`")) if time else F.trim(f"`{day}`")
        return local_to_utc(F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz"), tz)

    return raw.select(
        stamp.alias("snapshot_utc"), F.col("PTID").try_cast("bigint").alias("ptid"), F.trim("`Outage ID`").alias("outage_id"),
        F.trim("`Equipment Name`").alias("equipment"), F.trim("`Equipment Type`").alias("equipment_type"),
        at("Date Out", "Time Out", "MM/dd/yyyy HH:mm").alias("sched_out_utc"),
        at("Date In", "Time In", "MM/dd/yyyy HH:mm").alias("sched_in_utc"), F.trim("`Called In`").alias("called_in"),
        F.trim("Status").alias("status"), at("Status Date", None, "MM-dd-yyyy HH:mm").alias("status_date_utc"),
        F.trim("Message").alias("message"), stamp.alias("available_utc"))


def read_outage_schedule(spark: SparkSession, paths: str | list[str], tz: str = MARKET_TZ) -> DataFrame:
    return outage_schedule(read_text_rows(spark, paths, OUTAGE_HEADERS), tz)


def zone_forecast(cells: DataFrame, cell_zones: DataFrame, tz: str = MARKET_TZ) -> DataFrame:
    """Gridded run values -> zone aggregates for the hours of the delivery day (run date + 1).

    `cells`: run_utc, lead_h, iy, ix, tmp2m, dpt2m (K), u80, v80, tcdc, cape, refc, ltng.  `cell_zones`: zone, iy, ix.
    A missing reflectivity counts as below the threshold.
    """
    kelvin = F.lit(273.15)
    j = cells.join(cell_zones, ["iy", "ix"])
    v = {c: nan_to_null(F.col(c).cast("double")) for c in ("tmp2m", "dpt2m", "u80", "v80", "tcdc", "cape", "refc", "ltng")}
    out = j.groupBy("run_utc", "lead_h", "zone").agg(
        F.avg(v["tmp2m"] - kelvin).alias("temp_c"), F.avg(v["dpt2m"] - kelvin).alias("dewpoint_c"),
        F.avg(F.hypot(v["u80"], v["v80"])).alias("wind80_ms"), F.avg(v["tcdc"]).alias("cloud_pct"),
        F.percentile(v["cape"], F.lit(0.9)).alias("cape_p90"),
        F.avg(F.when(v["refc"] >= 40, 1.0).otherwise(0.0)).alias("refl40_share"), F.avg(v["ltng"]).alias("lightning_density"))
    out = out.withColumn("ts_utc", F.col("run_utc") + F.make_dt_interval(hours=F.col("lead_h")))
    out = out.withColumn("available_utc", F.col("run_utc") + F.make_dt_interval(hours=F.lit(GRID_RUN_LATENCY_H)))
    on_day = local_date(F.col("ts_utc"), tz) == F.date_add(F.to_date("run_utc"), 1)
    return out.filter(on_day).select("ts_utc", "zone", "run_utc", "lead_h", "temp_c", "dewpoint_c", "wind80_ms", "cloud_pct",
                                     "cape_p90", "refl40_share", "lightning_density", "available_utc")
