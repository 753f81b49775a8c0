"""Arrival estimates, fading, positions at an instant and hazards, for tables of tracks and points of interest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackline.functions import geo as G

# Ordered confidence: 1 low, 2 medium, 3 high.
ROUND_MIN, IMMINENT_MIN, TOWARDS_DEG = 5, 5, 45


def fade_opacity(age_min: Column, fade_min: Column) -> Column:
    """1 when fresh, 0.2 at the fade time, 0 at twice that."""
    late = 0.2 * (1 - (age_min - fade_min) / fade_min)
    return F.when(age_min <= 0, 1.0).when(age_min >= 2 * fade_min, 0.0).when(age_min <= fade_min, 1 - 0.8 * age_min / fade_min).otherwise(late)


def eta(tracks: DataFrame, points: DataFrame, now: Column) -> DataFrame:
    """Every track against every point of interest, a small table: kind, reason, minutes and confidence.

    ``tracks``: track_id, lon, lat, accuracy_km, located, area (a region-level report), direction_deg,
    direction_confidence, speed_min, speed_max, eta_enabled, fade_min, last_seen_at, ring (of the region, or null).
    ``points``: point_id, point_lon, point_lat.
    """
    t = tracks.withColumn("__one", F.lit(1)).join(F.broadcast(points.withColumn("__one", F.lit(1))), "__one").drop("__one")
    t = t.withColumn("age", F.timestamp_diff("MICROSECOND", F.col("last_seen_at"), now) / 60e6)
    t = t.withColumn("km", G.distance_km(F.col("lon"), F.col("lat"), F.col("point_lon"), F.col("point_lat")))
    t = t.withColumn("edge", F.when(F.col("area"), G.distance_to_ring_km(F.col("point_lon"), F.col("point_lat"), F.col("ring"))))
    acc = F.coalesce("accuracy_km", F.lit(0.0))
    inside = F.when(F.col("edge").isNotNull(), F.col("edge") == 0).otherwise(F.col("km") <= acc)
    turn = G.angle_diff(G.bearing_deg(F.col("lon"), F.col("lat"), F.col("point_lon"), F.col("point_lat")), F.col("direction_deg"))
    away = F.col("direction_deg").isNotNull() & ~inside & (turn > TOWARDS_DEG)
    first = F.coalesce("edge", F.greatest(F.lit(0.0), F.col("km") - acc)) / F.col("speed_max") * 60 - F.col("age")
    last = (F.col("km") + acc) / F.col("speed_min") * 60 - F.col("age")
    reason = (
        F.when(~F.coalesce("eta_enabled", F.lit(False)), "disabled").when(~F.coalesce("located", F.lit(False)) | F.col("lon").isNull(), "noLocation")
        .when(~F.coalesce((F.col("speed_min") > 0) & (F.col("speed_max") > 0), F.lit(False)), "noSpeed").when(F.col("age") > 2 * F.col("fade_min"), "stale")
    )
    reason = F.coalesce(reason, F.when(away, "notTowards"), F.when(last <= 0, "passed"))
    kind = F.when(reason == "notTowards", "notTowards").when(reason.isNotNull(), "unknown").when(first <= IMMINENT_MIN, "imminent").otherwise("range")
    t = t.withColumns({"reason": reason, "kind": kind, "first": first, "last": last})
    shown = F.col("kind").isin("range", "imminent")
    least = F.when(F.col("kind") == "range", F.floor(F.col("first") / ROUND_MIN) * ROUND_MIN)
    most = F.greatest(F.lit(ROUND_MIN), F.ceil(F.col("last") / ROUND_MIN) * ROUND_MIN, F.coalesce(least + ROUND_MIN, F.lit(ROUND_MIN)))
    sure = F.greatest(F.lit(1), F.coalesce("direction_confidence", F.lit(1)))
    sure = F.greatest(F.lit(1), sure - F.col("area").cast("int") - (F.col("age") > F.col("fade_min")).cast("int"))
    return t.select("track_id", "point_id", "kind", "reason", least.cast("int").alias("min_minutes"), F.when(shown, most).cast("int").alias("max_minutes"), F.when(shown, sure).cast("int").alias("confidence"), "km")


def samples(revisions: DataFrame, start: Column, end: Column) -> DataFrame:
    """Located revisions of a replay window, without consecutive repeats: track_id, seen_at, lon, lat, heading."""
    rows = revisions.filter((F.col("seen_at") >= start) & (F.col("seen_at") <= end) & F.col("lon").isNotNull())
    w = Window.partitionBy("track_id").orderBy("seen_at", "revision_at")
    same = F.lag(F.struct("seen_at", "lon", "lat")).over(w).eqNullSafe(F.struct("seen_at", "lon", "lat"))
    return rows.withColumn("__same", same).filter(~F.col("__same")).select("track_id", "seen_at", "lon", "lat", "heading")


def positions(sampled: DataFrame, grid: DataFrame, lifetime_min: float) -> DataFrame:
    """Where each track is at each instant of a grid (column at): between two reports on the line between them, after
    the last one there until its lifetime ends."""
    w = Window.partitionBy("track_id").orderBy("seen_at")
    legs = sampled.withColumns({"until": F.lead("seen_at").over(w), "lon2": F.lead("lon").over(w), "lat2": F.lead("lat").over(w)})
    end = F.coalesce("until", F.col("seen_at") + F.make_dt_interval(mins=F.lit(int(lifetime_min))))
    at = legs.withColumn("__end", end).join(F.broadcast(grid), (F.col("at") >= F.col("seen_at")) & ((F.col("at") < F.col("__end")) | (F.col("until").isNull() & (F.col("at") == F.col("__end")))))
    part = F.coalesce(F.timestamp_diff("MICROSECOND", F.col("seen_at"), F.col("at")) / F.timestamp_diff("MICROSECOND", F.col("seen_at"), F.col("until")), F.lit(0.0))
    on = lambda a, b: F.col(a) + (F.coalesce(F.col(b), F.col(a)) - F.col(a)) * part
    heading = F.when(F.col("lon2").isNotNull(), G.bearing_deg(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))).otherwise(F.col("heading"))
    return at.select("track_id", "at", on("lon", "lon2").alias("lon"), on("lat", "lat2").alias("lat"), heading.alias("heading"))


def hazards(estimates: DataFrame, near_km: float = 25) -> DataFrame:
    """``hazard``: near a point (within 25 km), towards it (an arrival is expected), or null."""
    return estimates.withColumn("hazard", F.when(F.col("km") <= near_km, "near").when(F.col("kind").isin("range", "imminent"), "towards"))
