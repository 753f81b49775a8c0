"""Where a fact places its object: fixes, anchors, approach, location kinds, speed profiles and visible tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackline.functions import geo as G

# Speeds in km/h and window in minutes where a class names none, and the approach distance.
MAX_SPEED, CRUISE_SPEED, WINDOW_MIN, APPROACH_KM, LEAST_SLACK_KM = 200.0, 175.0, 30, 15.0, 40.0


def with_class_parameters(facts: DataFrame, classes: DataFrame) -> DataFrame:
    """``v_max, v_cruise, win_min`` of each fact's class; facts of unknown classes and empty parameters take the defaults.

    ``classes``: class_id (unique), v_max, v_cruise, win_min.
    """
    named = classes.select("class_id", *[F.col(c).alias(f"__{c}") for c in ("v_max", "v_cruise", "win_min")])
    filled = {"v_max": MAX_SPEED, "v_cruise": CRUISE_SPEED, "win_min": WINDOW_MIN}
    return facts.join(named, "class_id", "left").withColumns({c: F.coalesce(f"__{c}", F.lit(v)) for c, v in filled.items()}).drop(*[f"__{c}" for c in filled])


def speed_profile(model: Column, of_class: Column, eta_of_class: Column) -> Column:
    """struct(speed, eta): the model's speed before its class's; whether arrivals are estimated is the class's to say."""
    return F.struct(F.coalesce(model, of_class).alias("speed"), F.coalesce(eta_of_class, F.lit(False)).alias("eta"))


def approach_bearings(places: DataFrame, regions: DataFrame) -> DataFrame:
    """``place_id, from_region, bearing``: the course on which a place is reached from the nearest region it is not in.

    ``places``: place_id, region_id, lon, lat; ``regions``: region_id, lon, lat, a few dozen listed by the caller. The
    regions become one row of an array, so each place looks through them without meeting rows.
    """
    listed = regions.agg(F.array_sort(F.collect_list(F.struct("region_id", "lon", "lat"))).alias("__regions"))
    outside = lambda r: ~r["region_id"].eqNullSafe(F.col("region_id"))
    ranked = F.transform(F.filter("__regions", outside), lambda r: F.struct(F.round(G.distance_km(r["lon"], r["lat"], F.col("lon"), F.col("lat")), 9).alias("km"), r["region_id"].alias("id"), r["lon"].alias("lon"), r["lat"].alias("lat")))
    near = places.withColumn("__regions", listed.scalar()).withColumn("__near", F.array_min(ranked)).filter("__near is not null")
    return near.select("place_id", F.col("__near.id").alias("from_region"), G.bearing_deg(F.col("__near.lon"), F.col("__near.lat"), F.col("lon"), F.col("lat")).alias("bearing"))


def approach_anchor(lon: Column, lat: Column, course: Column, km: float = APPROACH_KM) -> Column:
    """struct(lon, lat) of the point ``km`` short of a destination on its approach course."""
    return G.offset(lon, lat, F.pmod(course + 180, F.lit(360.0)), F.lit(km))


def location_kind(level: Column) -> Column:
    """Kind of a location by the level of its place: 0 region, 1 district or community, others a settlement."""
    return F.when(level == 0, "region").when(level.isin(1, 2), "area").when(level.isNotNull(), "settlement").otherwise("none")


def anchored(facts: DataFrame) -> DataFrame:
    """``anchor, anchor_lon, anchor_lat, slack_km``: region without slack, else own point with its accuracy, else the
    destination with its radius, 40 km at least, else none.

    ``facts``: region_id, region_lon, region_lat, lon, lat, accuracy_km, dest_lon, dest_lat, dest_km.
    """
    region, point, dest = F.col("region_id").isNotNull(), F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.col("dest_lon").isNotNull() & F.col("dest_lat").isNotNull()
    pick = lambda a, b, c: F.when(region, a).when(point, b).when(dest, c)
    return facts.withColumns({
        "anchor": F.coalesce(pick(F.lit("region"), F.lit("point"), F.lit("destination")), F.lit("none")),
        "anchor_lon": pick(F.col("region_lon"), F.col("lon"), F.col("dest_lon")), "anchor_lat": pick(F.col("region_lat"), F.col("lat"), F.col("dest_lat")),
        "slack_km": pick(F.lit(0.0), F.coalesce("accuracy_km", F.lit(0.0)), F.greatest(F.lit(LEAST_SLACK_KM), F.coalesce("dest_km", F.lit(0.0)))),
    })


def fixed(facts: DataFrame) -> DataFrame:
    """``fix_lon, fix_lat, approach``: a fact's own location, else its destination, marked as an approach."""
    own = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    return facts.withColumns({"fix_lon": F.when(own, F.col("lon")).otherwise(F.col("dest_lon")), "fix_lat": F.when(own, F.col("lat")).otherwise(F.col("dest_lat")), "approach": ~own & F.col("dest_lon").isNotNull()})


def visible_tracks(tracks: DataFrame, now: Column, lifetime_min: Column, classes: list[int], active_only: bool, sources: list[int]) -> DataFrame:
    """Tracks of the shown classes and sources (none named: all) that were seen within their lifetime."""
    shown = tracks.filter((F.col("last_seen_at") <= now) & (F.timestamp_diff("SECOND", F.col("last_seen_at"), now) <= lifetime_min * 60))
    shown = shown.filter(F.col("class_id").isin(classes)) if classes else shown
    shown = shown.filter("active") if active_only else shown
    return shown.filter(F.arrays_overlap("sources", F.array(*map(F.lit, sources)))) if sources else shown


def fan_out(edges: DataFrame, most: int, least_path: float = 0.02) -> DataFrame:
    """What a map shows of a walk (head, fact_id, via, path): the ``most`` likeliest facts behind each (head, via)."""
    order = Window.partitionBy("head", "via").orderBy(F.desc("path"), "fact_id")
    return edges.filter(F.col("path") >= least_path).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def relatives_shown(relatives: DataFrame, ancestors: DataFrame, per_node: int = 3, least_path: float = 0.02) -> DataFrame:
    """What a map shows of where else a head's ancestors could have gone: ``per_node`` links off each ancestor, likeliest first,
    and as many off each relative found so (``off_ancestor`` tells which), and nothing further.

    ``relatives``: head, from_id, to_id, path; ``ancestors``: head, fact_id, the head itself included.
    """
    likely = relatives.filter(F.col("path") >= least_path).dropDuplicates(["head", "from_id", "to_id"])
    order = Window.partitionBy("head", "from_id").orderBy(F.desc("path"), "to_id")
    capped = lambda rows: rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_node).drop("place")
    of = ancestors.select("head", F.col("fact_id").alias("from_id")).distinct()
    first = capped(likely.join(of, ["head", "from_id"], "left_semi"))
    found = first.select("head", F.col("to_id").alias("from_id")).distinct()
    second = capped(likely.join(of, ["head", "from_id"], "left_anti").join(found, ["head", "from_id"], "left_semi"))
    return first.withColumn("off_ancestor", F.lit(True)).unionByName(second.withColumn("off_ancestor", F.lit(False)))
