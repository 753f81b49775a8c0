"""Administrative units by name, and the place that a structured feed means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackline.functions import text as T
from trackline.operators import regions as R

SETTLEMENTS = ("city", "town", "village")
ANYWHERE = -1
#: Abbreviations in front of a settlement's name.
KINDS = r"^(м\.\s*|місто\s+|смт\s+|с\.\s+)"


def admin_index(units: DataFrame) -> DataFrame:
    """``level, key, region_id, place_id``: the unit of a name inside a region, and under region ``ANYWHERE`` the unit of a name
    that only one has. ``units``: place_id, level, name, region_id. Of namesakes in a region the least id counts."""
    keyed = units.select("level", T.admin_key(F.col("name")).alias("key"), "region_id", "place_id")
    inside = keyed.filter("region_id is not null").groupBy("level", "key", "region_id").agg(F.min("place_id").alias("place_id"))
    alone = keyed.groupBy("level", "key").agg(F.count("*").alias("n"), F.min("place_id").alias("place_id")).filter("n = 1")
    return inside.unionByName(alone.select("level", "key", F.lit(ANYWHERE).alias("region_id"), "place_id"))


def settlement_index(settlements: DataFrame) -> DataFrame:
    """``level, key, region_id, place_id`` as :func:`admin_index`, level settlement: the largest of a name inside each region,
    and the largest of all. ``settlements``: place_id, name, region_id, population."""
    keyed = settlements.select(F.lit("settlement").alias("level"), T.folded_name(F.col("name")).alias("key"), "region_id", F.struct(F.col("population"), (-F.col("place_id")).alias("o"), "place_id").alias("p"))
    inside = keyed.filter("region_id is not null").groupBy("level", "key", "region_id").agg(F.max("p").alias("p"))
    largest = keyed.groupBy("level", "key").agg(F.max("p").alias("p")).withColumn("region_id", F.lit(ANYWHERE))
    return inside.unionByName(largest).select("level", "key", "region_id", "p.place_id")


def find_admin(asks: DataFrame, units: DataFrame) -> DataFrame:
    """``ask_id, place_id``: a unit by level and name, inside the region first, else only if one unit has the name; null if none.

    ``asks``: ask_id, level, name, region_id (or null). A single join on a ranked key.
    """
    keyed = asks.select("ask_id", "level", T.admin_key(F.col("name")).alias("key"), F.posexplode(F.array(F.col("region_id"), F.lit(ANYWHERE))).alias("rank", "region_id"))
    found = keyed.join(admin_index(units), ["level", "key", "region_id"]).groupBy("ask_id").agg(F.min_by("place_id", "rank").alias("place_id"))
    return asks.select("ask_id").distinct().join(found, "ask_id", "left")


def _ask(rank: int, level: str, key: Column, region: Column) -> Column:
    return F.struct(F.lit(rank).alias("rank"), F.lit(level).alias("level"), key.alias("key"), region.alias("region_id"))


def resolve(feed: DataFrame, regions: DataFrame, units: DataFrame, settlements: DataFrame, polygons: DataFrame) -> DataFrame:
    """``alert_id, place_id``: from the most precise level that a feed row names down to its region; null if nothing fits.

    A community falls back to its district and region, a district to its region; a city stands for the community polygon
    around it, else for itself, else falls back to its district and region. Units are sought inside the region first, else
    must be the only ones of their name; settlements inside the region first, else the largest of all.
    ``feed``: alert_id, kind (oblast, raion, hromada, city), title, raion, oblast. ``regions``: place_id, name. ``units``:
    place_id, level (district, hromada), name, region_id. ``settlements``: place_id, name, region_id, population, lon, lat.
    ``polygons``: polygon_id (the hromada's place_id), rings.
    """
    names = regions.groupBy(T.folded_name(F.col("name")).alias("key")).agg(F.min("place_id").alias("region_id"))
    by = feed.select("alert_id", F.posexplode(F.array(T.folded_name(F.col("oblast")), T.folded_name(F.col("title")))).alias("rank", "key")).join(names, "key").groupBy("alert_id").agg(F.min_by("region_id", "rank").alias("region_id"))
    rows = feed.join(by, "alert_id", "left")
    city = T.folded_name(F.regexp_replace(F.lower(F.trim("title")), KINDS, ""))
    both = lambda rank, level, key: [_ask(rank, level, key, F.col("region_id")), _ask(rank + 1, level, key, F.lit(ANYWHERE))]
    title, raion = T.admin_key(F.col("title")), T.admin_key(F.col("raion"))
    chains = F.when(F.col("kind") == "raion", F.array(*both(0, "district", title))).when(F.col("kind") == "hromada", F.array(*both(0, "hromada", title), *both(2, "district", raion)))
    chains = chains.when(F.col("kind") == "city", F.array(*both(0, "settlement", city), *both(2, "district", raion)))
    asks = rows.select("alert_id", F.explode(chains).alias("a")).select("alert_id", "a.*")
    index = admin_index(units.filter(F.col("level").isin("district", "hromada"))).unionByName(settlement_index(settlements))
    found = asks.join(index, ["level", "key", "region_id"]).groupBy("alert_id").agg(F.min_by(F.struct("level", "place_id"), "rank").alias("f")).select("alert_id", "f.*")
    spots = settlements.select(F.col("place_id").alias("point_id"), "lon", "lat").join(found.filter("level = 'settlement'").select(F.col("place_id").alias("point_id")).distinct(), "point_id")
    around = R.containing(spots, polygons).groupBy("point_id").agg(F.min("polygon_id").alias("around"))
    found = found.join(around, (F.col("place_id") == F.col("point_id")) & (F.col("level") == "settlement"), "left")
    return rows.join(found.select("alert_id", F.coalesce("around", "place_id").alias("found")), "alert_id", "left").select("alert_id", F.coalesce("found", "region_id").alias("place_id"))
