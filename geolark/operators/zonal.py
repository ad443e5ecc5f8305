"""Reductions over zones and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.suitability import irrigation_needed, moisture_index, moisture_status, water_assessment
from .quantiles import exact_quantiles


def in_buffer(lat: Column, lng: Column, at_lat: float, at_lng: float, km: float) -> Column:
    """Whether a point lies within km of another: a box that data skipping can use, then the distance on the sphere."""
    reach = km / 111.0
    box = lat.between(at_lat - reach, at_lat + reach) & (F.abs(lng - at_lng) <= F.lit(reach) / F.greatest(F.lit(0.01), F.cos(F.radians(lat))))
    h = F.pow(F.sin(F.radians(lat - at_lat) / 2), F.lit(2)) + F.cos(F.radians(lat)) * F.cos(F.radians(F.lit(at_lat))) * F.pow(F.sin(F.radians(lng - at_lng) / 2), F.lit(2))
    return box & (2 * 6371.0088 * F.asin(F.sqrt(h)) <= km)


def one_decimal(x: Column) -> Column:
    """x to one decimal as C and SQL engines do it: the double ten times as large is rounded half up, where round() looks at x's shortest decimal."""
    return F.round(x * 10) / 10


def zonal_stats(rows: DataFrame, zone: str, value: str) -> DataFrame:
    """(zone, mean, min, max, p90). Zones whose values are all null have nulls."""
    rows = rows.select(F.col(zone).alias("zone"), F.col(value).alias("v"))
    plain = rows.groupBy("zone").agg(F.round(F.avg("v"), 4).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    p90 = exact_quantiles(rows, "v", [0.9], "zone").select(F.col("zone").alias("_zone"), F.round("q0", 4).alias("p90"))
    return plain.join(p90, F.col("zone").eqNullSafe(F.col("_zone")), "left").select("zone", "mean", "min", "max", "p90")


def zonal_mean_vector(rows: DataFrame, zone: str, vector: str) -> DataFrame:
    """(zone, v): mean of each band; zones without vectors, or with all means zero, are left out."""
    flat = rows.where(F.col(vector).isNotNull()).select(F.col(zone).alias("zone"), F.posexplode(vector).alias("band", "x"))
    means = flat.groupBy("zone", "band").agg(F.avg("x").alias("m"))
    v = F.transform(F.array_sort(F.collect_list(F.struct("band", "m"))), lambda s: s["m"])
    return means.groupBy("zone").agg(v.alias("v")).where(F.exists("v", lambda x: x != 0))


def mosaic_latest(images: DataFrame, key: str, ts: str, columns: list[str]) -> DataFrame:
    """For each key the values of the last image that has it."""
    last = images.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(ts, *columns)).alias("s"), F.max(ts).alias(ts))
    return last.select(key, ts, "s.*")


def sum_then_mean(series: DataFrame, zone: str, cell: str, value: str, scale: float = 1.0) -> DataFrame:
    """(zone, total): each cell's sum over time, then the mean over the zone's cells."""
    per = series.groupBy(zone, cell).agg((F.sum(value) * scale).alias("s"))
    return per.groupBy(F.col(zone).alias("zone")).agg(F.avg("s").alias("total"))


def water_balance(rain: DataFrame, et: DataFrame) -> DataFrame:
    """(zone, rain, et, balance, irrigation, assessment); a missing evaporation counts as 800."""
    both = rain.select("zone", F.col("total").alias("rain")).join(et.select("zone", F.col("total").alias("et")), "zone", "left")
    e = F.coalesce("et", F.lit(800.0))
    b = F.col("rain") - e
    return both.select("zone", F.round("rain", 4).alias("rain"), F.round(e, 4).alias("et"), F.round(b, 4).alias("balance"), irrigation_needed(b).alias("irrigation"), water_assessment(b).alias("assessment"))


def moisture(series: DataFrame, zone: str, cell: str, vv: str, ts: str) -> DataFrame:
    """(zone, index, status, latest): mean over time of each cell, then over the zone."""
    per = series.groupBy(zone, cell).agg(F.avg(vv).alias("m"), F.max(ts).alias("t"))
    z = per.groupBy(F.col(zone).alias("zone")).agg(F.avg("m").alias("m"), F.max("t").alias("latest"))
    index = moisture_index(F.col("m"))
    return z.select("zone", F.round(index, 6).alias("index"), moisture_status(index).alias("status"), "latest")


def weather_summary(days: DataFrame, place: str) -> DataFrame:
    """One row a place from daily values; nulls are skipped, and a measure without values takes its default."""
    r = lambda c, default: F.coalesce(one_decimal(c), F.lit(default))
    return days.groupBy(place).agg(
        r(F.avg("temp_mean"), 20.0).alias("temp_mean"),
        r(F.min("temp_min"), 15.0).alias("temp_min"),
        r(F.max("temp_max"), 30.0).alias("temp_max"),
        r(F.sum("rain"), 1000.0).alias("rain"),
        F.count_if(F.coalesce(F.col("rain") > 1.0, F.lit(False))).alias("wet_days"),
        r(F.avg("humidity"), 70.0).alias("humidity"),
        r(F.avg("sunshine") / 3600, 6.0).alias("sun_hours"),
        r(F.avg("cloud"), 50.0).alias("cloud"),
    )


def clearest_per_interval(images: DataFrame, ts: str, cloud: str, start: str, days: int, key: str) -> DataFrame:
    """The least cloudy image (earliest, then smallest key on ties) of each interval of `days` from `start` that has one."""
    bucket = F.floor(F.datediff(ts, F.lit(start).cast("date")) / days).cast("int")
    rows = images.withColumn("interval", bucket).where("interval >= 0")
    best = F.min_by(F.struct(key, ts, cloud), F.struct(cloud, ts, key))
    return rows.groupBy("interval").agg(best.alias("s")).select("interval", f"s.{key}", f"s.{ts}", f"s.{cloud}")


def daily_cap(events: DataFrame, ts: str, key: str, cap: int) -> DataFrame:
    """The first `cap` events of each day. Each partition keeps a day's first ones before the shuffle."""
    w = Window.partitionBy(F.to_date(ts)).orderBy(ts, key)
    return events.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap)


def over_limit(events: DataFrame, ts: str, who: str, limit: int, every: str = "1 minute") -> DataFrame:
    """(window start, who, n) of the clock-aligned windows in which someone exceeds a limit."""
    n = events.groupBy(F.window(ts, every).alias("w"), who).agg(F.count("*").alias("n"))
    return n.where(F.col("n") > limit).select(F.col("w.start").alias("window_start"), who, "n")


def scenes(images: DataFrame, cloud: str = "cloud", craft: str = "craft", ts: str = "ts", most: float = 70.0, only: str | None = None) -> DataFrame:
    """Images below a cloud share, of one spacecraft if given, in time order."""
    rows = images.where(F.col(cloud) < most)
    return (rows if only is None else rows.where(F.col(craft) == only)).orderBy(ts)


def radar_scenes(images: DataFrame, mode: str = "IW", bands: tuple[str, ...] = ("VV", "VH")) -> DataFrame:
    """Radar images of a mode that have all of the given polarisations."""
    rows = images.where(F.col("mode") == mode)
    for b in bands:
        rows = rows.where(F.array_contains("pol", b))
    return rows
