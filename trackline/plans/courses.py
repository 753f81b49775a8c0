"""Tracks of the given facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackline.operators import tracks as K
from trackline.plans import graphs
from trackline.sources import bindings as B


def track_events(spark, d):
    """Facts as events: every twentieth an all-clear of its region, every seventh only names a destination, those told again
    by another source within the hour are its repeats."""
    p = B.places(spark, d).select("place_id", F.col("parent_id").alias("region_id"), "lon", "lat")
    dest = p.select(F.col("place_id").alias("dest_id"), F.col("region_id").alias("dest_region_id"), F.col("lon").alias("dest_lon"), F.col("lat").alias("dest_lat"))
    again = graphs.copies_with_ids(spark, d).select("fact_id", F.col("o").alias("duplicate_of"))
    f = B.facts(spark, d).join(p, "place_id").join(dest, "dest_id").join(again, "fact_id", "left")
    k, i = F.col("k"), F.col("fact_id")
    end, named = i % 20 == 0, i % 7 == 0
    own = lambda c: F.when(~end & ~named, F.col(c))
    aim = lambda c: F.when(~end & named, F.col(c))
    return K.events(f.select(
        "fact_id", (i / 3).cast("long").alias("raw_message_id"), "source_id", F.when(end, "cancelled").otherwise("observed").alias("event"), F.when(~end | (i % 40 == 0), F.col("category")).alias("category"),
        F.when(k % 3 > 0, k % 2).alias("class_id"), F.when(k % 5 == 0, k % 3).alias("model_id"), "observed_at", own("lon").alias("lon"), own("lat").alias("lat"), F.when(k % 2 == 0, 3.0).otherwise(40.0).alias("accuracy_km"), own("place_id").alias("place_id"),
        F.when(~named, F.col("region_id")).alias("region_id"), aim("dest_id").alias("dest_id"), aim("dest_lon").alias("dest_lon"), aim("dest_lat").alias("dest_lat"), aim("dest_region_id").alias("dest_region_id"),
        F.when(k % 4 == 0, k * 3.6).alias("direction_deg"), F.lit(3).alias("direction_confidence"), "object_count", (k % 3 + 1).alias("confidence"), F.when(k % 2 == 0, 900.0).otherwise(200.0).alias("speed_kmh"), F.lit(45.0).alias("window_min"), "duplicate_of",
    ))


def track_revisions(spark, d):
    """Every revision of every track; what SQL cannot say is tested against one pass in order."""
    r = K.tracks(track_events(spark, d))
    rounded = [F.round(c, 6).alias(c) for c in ("lon", "lat", "heading", "association")]
    return r.select("track_id", "fact_id", "revision_at", "status", "reason", "seen_at", "category", "class_id", "model_id", *rounded, "kind", "place_id", "object_count", "facts", "sources", "confidence", F.size("added").alias("added"))


def track_paths(spark, d):
    """The path of each track that has one: its points and its ends."""
    r = K.paths(K.tracks(track_events(spark, d)))
    end = lambda i, c: F.round(F.element_at("path", i)[c], 6)
    return r.select("track_id", F.size("path").alias("points"), end(1, "lon").alias("from_lon"), end(1, "lat").alias("from_lat"), end(-1, "lon").alias("to_lon"), end(-1, "lat").alias("to_lat"))


SQL: dict[str, str] = {}
QUERIES = {f.__name__: f for f in (track_revisions, track_paths)}
