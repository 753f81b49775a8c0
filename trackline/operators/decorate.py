"""Rows for display: tracks of facts, labels, places with their regions, nodes of a family; routes of messages, homes of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackline.functions import text as T

# Kinds of structured payloads.
STRUCTURED = ("alert.started", "alert.finished")


def fact_tracks(track_facts: DataFrame) -> DataFrame:
    """``fact_id, track_id``: the track of each fact, the lowest of several."""
    return track_facts.groupBy("fact_id").agg(F.min("track_id").alias("track_id"))


def region_level(places: DataFrame) -> DataFrame:
    """Regions, and cities that belong to none. ``places``: place_id, level, parent_id, ..."""
    return places.filter((F.col("level") == "region") | ((F.col("level") == "city") & F.col("parent_id").isNull()))


def labelled(targets: DataFrame, dimensions: dict[str, DataFrame], unknown: str = "unknown") -> DataFrame:
    """``targets`` with ``label``, the name of the deepest level that is known.

    ``dimensions``: for the columns of ``targets``, deepest first, tables (id, name) with one row an id.
    """
    rows, names = targets, []
    for column, names_of in dimensions.items():
        rows = rows.join(names_of.select(F.col("id").alias(column), F.col("name").alias(f"__{column}")), column, "left")
        names.append(f"__{column}")
    return rows.withColumn("label", F.coalesce(*names, F.lit(unknown))).drop(*names)


def placed(targets: DataFrame, places: DataFrame) -> DataFrame:
    """``targets`` (place_id, direction_deg) with place_name, region_id, region_name (null where it is the place itself) and the
    direction in whole degrees. ``places``: place_id, name, region_id (its own for a region)."""
    p = places.select("place_id", F.col("name").alias("place_name"), "region_id")
    r = places.select(F.col("place_id").alias("region_id"), F.col("name").alias("region_name"))
    rows = targets.join(p, "place_id", "left").join(r, "region_id", "left")
    hidden = F.when(F.col("region_id") != F.col("place_id"), F.col("region_name"))
    return rows.withColumns({"region_name": hidden, "direction_deg": F.bround("direction_deg")})


def family_nodes(walk: DataFrame, facts: DataFrame) -> DataFrame:
    """``head, fact_id, generation, ancestral, ...facts``: each fact of a family once, the head at 0; facts without a fix are left out.

    ``walk``: head, fact_id, generation, relative. A fact that is ancestor and relative is an ancestor. ``facts``: fact_id,
    fix_lon and what else is shown.
    """
    heads = walk.select("head", F.col("head").alias("fact_id"), F.lit(0).alias("generation"), F.lit(False).alias("relative")).distinct()
    rows = walk.select("head", "fact_id", "generation", "relative").unionByName(heads)
    first = rows.groupBy("head", "fact_id").agg(F.min(F.struct("relative", "generation")).alias("x")).select("head", "fact_id", "x.generation", (~F.col("x.relative")).alias("ancestral"))
    return first.join(facts.filter("fix_lon is not null"), "fact_id")


def route(kind: Column, text: Column) -> Column:
    """Where a message goes: structured by its payload's kind, text, or skipped where there is nothing to read."""
    said = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")) != ""
    return F.when(kind.isin(*STRUCTURED), "structured").when(said, "text").otherwise("skipped")


def home_regions(sources: DataFrame, names: DataFrame, regions: DataFrame) -> DataFrame:
    """``source_id, home_region``: the id that a source's config states, else the region of the place it names; null without.

    ``sources``: source_id, config (JSON). ``names``: name, place_id; ``regions``: place_id, region_id (null: the place itself).
    """
    v = F.try_parse_json("config")
    said = sources.select("source_id", F.when(F.schema_of_variant(F.try_variant_get(v, "$.homeRegionPlaceId", "variant")).startswith("BIGINT"), F.try_variant_get(v, "$.homeRegionPlaceId", "long")).alias("stated"), T.folded_name(F.try_variant_get(v, "$.homeRegion", "string")).alias("key"))
    named = names.groupBy(T.folded_name(F.col("name")).alias("key")).agg(F.min("place_id").alias("place_id")).join(regions, "place_id", "left").select("key", F.coalesce("region_id", "place_id").alias("named"))
    return said.join(named, "key", "left").select("source_id", F.coalesce("stated", "named").alias("home_region"))
