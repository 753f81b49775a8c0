"""Interval algebra: alerts as half-open intervals [start, end), a null end is open."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(a: str | Column, b: str | Column) -> Column:
    """Seconds from a to b, fractions included."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.timestamp_diff("MICROSECOND", a, b) / 1e6


def pair_events(events: DataFrame, key: str, ts: str, opens: Column, closes: Column, order: list[str], slice_hours: int = 24) -> DataFrame:
    """``key, start, end`` of every opening event; the end is the key's next closing event, null if there is none.

    A key's history is cut into time slices: within one, a running minimum from the latest event back finds the next
    closing event; where a slice has none left, it is the first one of the slices behind it, of which only that minimum is
    carried. So a key of any length is many tasks, each linear in its events.
    """
    rows = events.filter(opens | closes).select(key, ts, *order, opens.alias("__open"), F.when(closes, F.col(ts)).alias("__close"))
    rows = rows.withColumn("__slice", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (slice_hours * 3_600_000_000)))
    later = Window.partitionBy(key).orderBy(F.desc("__slice")).rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(key, "__slice").agg(F.min("__close").alias("__first")).withColumn("__carried", F.min("__first").over(later)).drop("__first")
    within = Window.partitionBy(key, "__slice").orderBy(F.desc(ts), *[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("__next", F.min("__close").over(within)).filter("__open").join(carried, [key, "__slice"])
    return found.select(key, F.col(ts).alias("start"), F.coalesce("__next", "__carried").alias("end"))


def structured_alerts(events: DataFrame) -> DataFrame:
    """One interval per (source_id, alert_id), whatever the order in which its events arrive.

    ``events``: source_id, alert_id, kind (started / finished), at, finished_at, level, arrival. Start is the least start,
    end the first end that arrived, also one a start carries; level the last one stated. An end before its start is kept
    as it came; :func:`repaired` reopens such rows.
    """
    ends = F.when(F.col("kind") == "finished", F.col("at")).otherwise(F.col("finished_at"))
    return events.groupBy("source_id", "alert_id").agg(
        F.min(F.when(F.col("kind") == "started", F.col("at"))).alias("start"),
        F.min_by(ends, F.when(ends.isNotNull(), F.col("arrival"))).alias("end"),
        F.max_by("level", F.when(F.col("level").isNotNull(), F.col("arrival"))).alias("level"),
    )


def repaired(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("end", F.when(F.col("end") >= F.col("start"), F.col("end")))


class _Place:
    """The open intervals of one place, one of a source at most; events come in order."""

    def __init__(self, place_id: int, limit: timedelta):
        self.place_id, self.limit, self.open = place_id, limit, {}

    def close(self, source: int, at: datetime | None) -> dict:
        a = self.open.pop(source)
        end = a["start"] + self.limit
        return a | {"end": end if at is None else min(at, end)}

    def take(self, e: dict) -> Iterator[dict]:
        for source in [s for s, a in self.open.items() if e["at"] - a["start"] > self.limit]:
            yield self.close(source, None)
        if e["kind"] == "cancel":
            for source in list(self.open):
                yield self.close(source, e["at"])
        elif e["source_id"] not in self.open:
            self.open[e["source_id"]] = {"source_id": e["source_id"], "place_id": self.place_id, "start": e["at"], "level": e["level"]}
        elif e["level"]:
            self.open[e["source_id"]]["level"] = e["level"]


def text_alerts(events: DataFrame, places: DataFrame, max_age_hours: float = 3) -> DataFrame:
    """``source_id, place_id, start, end, level`` from announcements and all-clears in messages.

    ``events``: id, source_id, place_id, kind (alert / cancel), at, level. An all-clear ends what is in force in its place
    and the places directly inside. A repeat keeps an interval and may raise its level; after ``max_age_hours`` it starts a
    new one, and an interval nobody ends expires then. Events pass through a task sorted by place and time; what is held is
    the open intervals of one place, however long its history.
    """
    child = places.filter("parent_id is not null").select(F.col("parent_id").alias("place_id"), F.col("place_id").alias("child"))
    inside = events.filter("kind = 'cancel'").join(child, "place_id").withColumn("place_id", F.col("child")).drop("child")
    every = events.unionByName(inside).select("id", F.col("source_id").cast("long").alias("source_id"), F.col("place_id").cast("int").alias("place_id"), "kind", F.col("at").cast("timestamp_ntz").alias("at"), F.col("level").cast("int").alias("level"))
    limit = timedelta(hours=max_age_hours)
    schema = pa.schema([("source_id", pa.int64()), ("place_id", pa.int32()), ("start", pa.timestamp("us")), ("end", pa.timestamp("us")), ("level", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, out = None, []
        for batch in batches:
            for e in batch.to_pylist():
                if place is None or e["place_id"] != place.place_id:
                    out += [place.close(s, None) for s in list(place.open)] if place else []
                    place = _Place(e["place_id"], limit)
                out += place.take(e)
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
        yield pa.RecordBatch.from_pylist([place.close(s, None) for s in list(place.open)] if place else [], schema)

    ordered = every.filter("place_id is not null").repartition("place_id").sortWithinPartitions("place_id", "at", "id")
    return ordered.mapInArrow(run, "source_id long, place_id int, start timestamp_ntz, end timestamp_ntz, level int")


def clip(alerts: DataFrame, start: Column, end: Column) -> DataFrame:
    """The part inside [start, end), as from_at and to_at; open intervals run to the end, empty ones go."""
    a, b = F.greatest(F.col("start"), start), F.least(F.coalesce(F.col("end"), end), end)
    return alerts.withColumns({"from_at": a, "to_at": b}).filter("from_at < to_at")


def split_hours(clipped: DataFrame, hours: int = 1) -> DataFrame:
    """Rows (.., bucket, hours): the share of each clipped interval in the UTC buckets it meets.

    The buckets are made from the interval itself, so no range join is needed.
    """
    last = F.col("to_at") - F.expr("interval 1 microsecond")
    steps = F.sequence(F.date_trunc("hour", "from_at"), F.date_trunc("hour", last), F.expr("interval 1 hour"))
    rows = clipped.withColumn("bucket", F.explode(steps)).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))
    over = seconds(F.greatest("bucket", "from_at"), F.least(F.col("bucket") + F.expr("interval 1 hour"), F.col("to_at"))) / 3600
    return rows.withColumn("hours", over)


def merged(alerts: DataFrame, keys: list[str], start: str = "from_at", end: str = "to_at") -> DataFrame:
    """Overlapping or touching intervals of a key joined: keys, start, end, n."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = alerts.withColumn("__new", F.coalesce(F.col(start) > reach, F.lit(True)).cast("int")).withColumn("__island", F.sum("__new").over(w))
    return islands.groupBy(*keys, "__island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("__island")


def effective_level(alerts: DataFrame, keys: list[str]) -> DataFrame:
    """The highest level of the alerts in force, per key."""
    return alerts.groupBy(*keys).agg(F.max("level").alias("level"))


def in_force(alerts: DataFrame, at: Column) -> DataFrame:
    return alerts.filter((F.col("start") <= at) & (F.col("end").isNull() | (F.col("end") > at)))


def duration_bins(alerts: DataFrame, edges_min: tuple[float, ...] = (30, 60, 120, 240, 480)) -> DataFrame:
    """Closed intervals per bin of whole length; an edge belongs to the bin above it."""
    minutes = seconds("start", "end") / 60
    bins = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges_min]), lambda e: minutes >= e))
    return alerts.filter(F.col("end").isNotNull()).groupBy(bins.alias("bin")).agg(F.count("*").alias("n"))


def bucketed_interval_join(left: DataFrame, right: DataFrame, ts: str, start: str, end: str, width_s: float, keys: list[str] | None = None) -> DataFrame:
    """Points of ``left`` in intervals [start, end) of ``right``, joined on time buckets.

    An interval is repeated for each bucket it meets, a point has one; long intervals want wide buckets.
    """
    number = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / (width_s * 1e6))
    spans = right.withColumn("__b", F.explode(F.sequence(number(F.col(start)), number(F.col(end)))))
    return left.withColumn("__b", number(F.col(ts))).join(spans, [*(keys or []), "__b"]).filter((F.col(start) <= F.col(ts)) & (F.col(ts) < F.col(end))).drop("__b")

