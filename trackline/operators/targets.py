"""Parsed facts into located targets: trust, place, accuracy and course, never more precise than what was said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackline.functions import geo as G
from trackline.operators.fixes import APPROACH_KM, approach_anchor

UNKNOWN, LOW, MEDIUM, HIGH, CONFIRMED = range(5)
# Radii in km under which a place is a point for bearings, from which a quadrant counts, and of a district named by its town.
PRECISE_KM, QUADRANT_KM, DISTRICT_KM = 25.0, 20.0, 25.0
DEEP = ("model", "family")
PLACE = "struct<place_id: long, name: string, level: string, lon: double, lat: double, radius_km: double, parent_id: long, quadrant_deg: double, text: string>"


def trust_cap(trust: Column) -> Column:
    """The most that a source's word is worth."""
    return F.when(trust >= 0.85, HIGH).when(trust >= 0.6, MEDIUM).otherwise(LOW)


def place_kind(level: Column) -> Column:
    return F.when(level.isin("country", "region"), "region").when(level.isin("district", "hromada"), "district").when(level == "area", "area").otherwise("city")


def names_district(segment: Column, text: Column) -> Column:
    """Whether a word for district follows the first mention of a place in the segment."""
    at = F.position(F.lower(text), F.lower(segment))
    rest = F.ltrim(F.lower(F.substr(segment, at + F.length(text))))
    return F.coalesce((at > 0) & (rest.startswith("район") | rest.startswith("р-н")), F.lit(False))


def build(facts: DataFrame) -> DataFrame:
    """``facts`` with confidence, model_confidence, classification_confidence, place_id, kind, lon, lat, accuracy_km,
    direction_deg, direction_kind and direction_confidence.

    ``facts``: segment, trust, structured, target_level (null without a target), alias_confidence, hedged, compass_deg, current,
    origin, destination (``PLACE``), approach_deg (course on which the destination is reached, or null). The place is the
    current one, else the origin. A course is the compass point stated, else, where the destination lies inside the place,
    the approach to it (and the target stands short of it), else the bearing from the place to the destination.
    """
    cap, target, hedged = trust_cap(F.col("trust")), F.col("target_level").isNotNull(), F.coalesce("hedged", F.lit(False)) & F.col("target_level").isNotNull()
    said = F.least(F.when(hedged, F.greatest(F.lit(LOW), F.col("alias_confidence") - 1)).otherwise(F.col("alias_confidence")), cap)
    own = F.when(F.col("structured"), CONFIRMED).otherwise(cap)
    rows = facts.withColumns({
        "confidence": F.when(hedged, F.greatest(F.lit(LOW), own - 1)).otherwise(own),
        "model_confidence": F.when(target, F.when(F.col("target_level").isin(*DEEP), said).otherwise(UNKNOWN)),
        "classification_confidence": F.when(target, said),
        "__l": F.coalesce("current", "origin"),
    })
    l, d = F.col("__l"), F.col("destination")
    part = l["quadrant_deg"].isNotNull() & (l["radius_km"] > QUADRANT_KM)
    spot = F.when(part, G.offset(l["lon"], l["lat"], l["quadrant_deg"], l["radius_km"] * 0.5)).otherwise(F.struct(l["lon"].alias("lon"), l["lat"].alias("lat")))
    wide = F.when(part, l["radius_km"] * 0.6).otherwise(l["radius_km"])
    district = (place_kind(l["level"]) == "city") & names_district(F.col("segment"), l["text"])
    distance = G.distance_km(l["lon"], l["lat"], d["lon"], d["lat"])
    inside = F.coalesce(d["parent_id"] == l["place_id"], F.lit(False)) | ((l["radius_km"] > PRECISE_KM) & (distance <= l["radius_km"]))
    elsewhere = l.isNotNull() & d.isNotNull() & (l["place_id"] != d["place_id"])
    compass = F.col("compass_deg").isNotNull()
    approach = ~compass & elsewhere & inside & F.col("approach_deg").isNotNull()
    bearing = G.bearing_deg(l["lon"], l["lat"], d["lon"], d["lat"])
    hint = F.when(l["radius_km"] <= PRECISE_KM, MEDIUM).otherwise(LOW)
    rows = rows.withColumns({"__spot": F.when(approach, approach_anchor(d["lon"], d["lat"], F.col("approach_deg"))).when(l.isNotNull(), spot), "__approach": F.coalesce(approach, F.lit(False))})
    only_course = F.when(compass | d.isNotNull(), "direction").otherwise("unknown")
    built = rows.withColumns({
        "place_id": F.when(F.col("__approach"), d["place_id"]).otherwise(l["place_id"]),
        "kind": F.when(F.col("__approach"), "direction").when(l.isNull(), only_course).when(district, "district").otherwise(place_kind(l["level"])),
        "lon": F.col("__spot.lon"), "lat": F.col("__spot.lat"),
        "accuracy_km": F.when(F.col("__approach"), F.greatest(F.lit(APPROACH_KM), d["radius_km"])).when(district, F.greatest(wide, F.lit(DISTRICT_KM))).otherwise(wide),
        "direction_deg": F.when(compass, F.col("compass_deg")).when(F.col("__approach"), F.col("approach_deg")).when(elsewhere, bearing),
        "direction_kind": F.when(compass, "compass").when(elsewhere, "towards").otherwise("unknown"),
        "direction_confidence": F.when(compass, F.least(F.lit(HIGH), cap)).when(F.col("__approach"), F.least(F.lit(LOW), cap)).when(elsewhere, F.least(hint, cap)).otherwise(UNKNOWN),
    })
    return built.drop("__l", "__spot", "__approach")


def explained(facts: DataFrame) -> DataFrame:
    """``facts`` with ``metadata``, JSON of what was understood: language, rule, launch, target, places with roles, direction."""
    place = lambda role: F.when(F.col(role).isNotNull(), F.struct(F.col(role)["place_id"].alias("id"), F.col(role)["name"].alias("name"), F.col(role)["level"].alias("level"), F.lit(role).alias("role"), F.col(role)["text"].alias("text")))
    target = F.when(F.col("target_level").isNotNull(), F.struct(F.col("target_code").alias("code"), F.col("target_level").alias("level"), F.col("target_text").alias("text"), F.coalesce("hedged", F.lit(False)).alias("hedged")))
    direction = F.when(F.col("compass_deg").isNotNull(), F.struct(F.col("compass_deg").alias("deg"), F.lit("compass").alias("kind")))
    said = F.struct("language", F.array_compact(F.array("rule")).alias("rules"), F.coalesce("launch", F.lit(False)).alias("launch"), target.alias("target"), F.array_compact(F.array(*map(place, ("current", "origin", "destination")))).alias("places"), direction.alias("direction"))
    return facts.withColumn("metadata", F.to_json(said))
