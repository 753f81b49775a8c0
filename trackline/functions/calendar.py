"""Calendar of a local zone over UTC wall-clock timestamps (timestamp_ntz, session zone UTC)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = "Europe/Kyiv"


def local(ts: Column, zone: str = ZONE) -> Column:
    """The local wall clock at a UTC instant."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def utc(ts: Column, zone: str = ZONE) -> Column:
    """The UTC instant of a local wall clock."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)


def local_day(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(local(ts, zone))


def bucket(ts: Column, unit: str, zone: str = ZONE) -> Column:
    """Start, in UTC, of the hour, local day or local week (from Monday) of an instant.

    Hours are cut in UTC: through local time the hour that an autumn fold repeats would fall into one bucket.
    """
    if unit == "hour":
        return F.date_trunc("hour", ts).cast("timestamp_ntz")
    return utc(F.date_trunc(unit, local(ts, zone)).cast("timestamp_ntz"), zone)


def unit_for(start: datetime, end: datetime) -> str:
    span = end - start
    return "hour" if span <= timedelta(days=3) else "day" if span <= timedelta(days=120) else "week"


def clamp_period(start: datetime | None, end: datetime | None, now: datetime) -> tuple[datetime, datetime]:
    """The end is now at most, cut to the minute; the span is one hour to 366 days, a day if unknown."""
    now = now.replace(second=0, microsecond=0) if end is None or end > now else now
    end = now if end is None or end > now else end
    start = end - timedelta(days=1) if start is None else start
    return min(max(start, end - timedelta(days=366)), end - timedelta(hours=1)), end


def spine(spark: SparkSession, start: datetime, end: datetime, unit: str, zone: str = ZONE) -> DataFrame:
    """``bucket``: every bucket that meets [start, end); days of a clock change have 23 or 25 hours."""
    one = spark.range(1).select(F.lit(start).cast("timestamp_ntz").alias("a"), (F.lit(end) - F.expr("interval 1 microsecond")).cast("timestamp_ntz").alias("b"))
    if unit == "hour":
        steps = F.sequence(F.date_trunc("hour", "a"), F.date_trunc("hour", "b"), F.expr("interval 1 hour"))
        return one.select(F.explode(steps).cast("timestamp_ntz").alias("bucket"))
    first, last = (F.to_date(F.date_trunc(unit, local(F.col(c), zone))) for c in "ab")
    steps = F.sequence(first, last, F.expr("interval 1 day" if unit == "day" else "interval 7 days"))
    return one.select(F.explode(steps).alias("d")).select(utc(F.col("d").cast("timestamp_ntz"), zone).alias("bucket"))


def stamp(ts: Column) -> Column:
    """Timestamps as text, for results that leave the engine."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def rounded_down(ts: Column, minutes: int = 5) -> Column:
    """The last full ``minutes`` at an instant: all viewers of a preset period within them ask for the same one."""
    step = minutes * 60_000_000
    return F.timestamp_micros(F.floor(F.unix_micros(ts.cast("timestamp")) / step) * step).cast("timestamp_ntz")


def preset(now: Column, hours: int, minutes: int = 5) -> tuple[Column, Column]:
    """Start and end of the period of ``hours`` up to now, rounded down."""
    end = rounded_down(now, minutes)
    return end - F.make_dt_interval(hours=F.lit(hours)), end
