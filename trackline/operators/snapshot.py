"""Time travel over revisions, provenance, top rows per key, feeds and live state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackline.functions import text as T


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given order. Spark prunes each task's rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__i", F.row_number().over(w)).filter(F.col("__i") <= n).drop("__i")


def as_of(revisions: DataFrame, key: str, at: Column, ts: str, tie: str, max_age: Column | None = None) -> DataFrame:
    """The revision of each key in force at an instant; those last seen before ``at - max_age`` are left out."""
    past = revisions.filter(F.col(ts) <= at)
    found = newest(past, [key], [F.desc(ts), F.desc(tie)])
    return found.filter(F.col(ts) >= at - max_age) if max_age is not None else found


def as_of_each(revisions: DataFrame, instants: DataFrame, key: str, ts: str, at: str, tie: str) -> DataFrame:
    """For every instant and key the last revision not after it, by one sorted pass over both.

    Instants are few and go to every key; a window carries the last revision over them.
    """
    keys = revisions.select(key).distinct().withColumn("__one", F.lit(1))
    grid = keys.join(F.broadcast(instants.select(at).withColumn("__one", F.lit(1))), "__one").drop("__one")
    row = F.struct(*[F.col(c) for c in revisions.columns])
    events = revisions.select(key, F.col(ts).alias("__t"), F.lit(0).alias("__q"), F.col(tie).alias("__tie"), row.alias("rev")).unionByName(
        grid.select(key, F.col(at).alias("__t"), F.lit(1).alias("__q")), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy("__t", "__q", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("rev", F.last("rev", ignorenulls=True).over(w)).filter("__q = 1 and rev is not null").select(key, F.col("__t").alias(at), "rev")


def without_repeats(samples: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Samples without those equal to the one before them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    row = F.struct(*values)
    return samples.withColumn("__prev", F.lag(row).over(w)).filter(F.col("__prev").isNull() | ~F.col("__prev").eqNullSafe(row)).drop("__prev")


def provenance(tracks: DataFrame, track_facts: DataFrame, facts: DataFrame, messages: DataFrame, sources: DataFrame) -> DataFrame:
    """Track, its facts in order, their messages and sources."""
    return tracks.join(track_facts, "track_id").join(facts, "fact_id").join(messages, "raw_message_id").join(F.broadcast(sources), "source_id")


def sources_of(track_facts: DataFrame, key: str, source: str) -> DataFrame:
    return track_facts.groupBy(key).agg(F.sort_array(F.collect_set(source)).alias("sources"))


def feed(facts: DataFrame, since: Column, limit: int, ts: str = "observed_at", tie: str = "fact_id") -> DataFrame:
    """Newest rows first, none older than ``since``, at most 5000."""
    return facts.filter(F.col(ts) >= since).orderBy(F.desc(ts), F.desc(tie)).limit(min(max(limit, 1), 5000))


def merged_feed(known: DataFrame, fresh: DataFrame, key: str, ts: str, since: Column, cap: int = 500) -> DataFrame:
    """The known rows with the new ones, no id twice, none stale, newest first; the cap is the feed's length."""
    new = fresh.join(known.select(key), key, "left_anti").dropDuplicates([key])
    return known.unionByName(new).filter(F.col(ts) >= since).orderBy(F.desc(ts), F.desc(key)).limit(cap)


def changes_worth_sending(changes: DataFrame, now: Column, limits_s: dict[str, float]) -> DataFrame:
    """Per kind, ``fresh`` tells whether a change is young enough to be pushed; stale ones are only counted."""
    age = F.timestamp_diff("SECOND", F.col("at"), now)
    fresh = F.coalesce(*[F.when(F.col("kind") == kind, age <= limit) for kind, limit in limits_s.items()], F.lit(False))
    return changes.withColumn("fresh", fresh)


def ancestors(places: DataFrame, depth: int = 8) -> DataFrame:
    """``place_id, ancestor, steps``: every place with those above it, itself at 0. Loops end where they close."""
    up = places.select(F.col("place_id").alias("__p"), F.col("parent_id").alias("__up"))
    walk = places.select("place_id", F.col("place_id").alias("ancestor"), F.lit(0).alias("steps"), F.array("place_id").alias("__seen"))
    found = walk
    for i in range(1, depth + 1):
        walk = walk.join(up, walk["ancestor"] == up["__p"]).filter("__up is not null and not array_contains(__seen, __up)").select("place_id", F.col("__up").alias("ancestor"), F.lit(i).alias("steps"), F.concat("__seen", F.array("__up")).alias("__seen"))
        found = found.unionByName(walk)
    return found.drop("__seen")


def related_alerts(alerts: DataFrame, wanted: DataFrame, places: DataFrame) -> DataFrame:
    """Alerts that concern each wanted place: its own (rank 0), of places above (1), of places inside (2)."""
    line = ancestors(places)
    up = wanted.join(line, "place_id").select("place_id", F.col("ancestor").alias("alert_place"), F.when(F.col("steps") == 0, 0).otherwise(1).alias("rank"), "steps")
    down = wanted.join(line.filter("steps > 0").withColumnRenamed("place_id", "alert_place"), F.col("ancestor") == wanted["place_id"]).select(wanted["place_id"], "alert_place", F.lit(2).alias("rank"), "steps")
    both = up.unionByName(down)
    return both.join(alerts.withColumnRenamed("place_id", "alert_place"), "alert_place")


def alert_layer(levels: DataFrame, places: DataFrame) -> DataFrame:
    """One row per alerted place; a place equal in level to its nearest alerted ancestor is left out."""
    line = ancestors(places).filter("steps > 0")
    above = levels.select("place_id").join(line, "place_id").join(levels.select(F.col("place_id").alias("ancestor"), F.col("level").alias("above")), "ancestor")
    nearest = above.groupBy("place_id").agg(F.min_by("above", "steps").alias("above"))
    return levels.join(nearest, "place_id", "left").filter(F.col("above").isNull() | (F.col("above") != F.col("level"))).select("place_id", "level")


def search_places(places: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """Settlements, districts and regions whose folded name starts with a prefix of at least two characters: regions last, larger
    ones first, at most 50. ``places``: place_id, name, level, population."""
    start = " ".join(prefix.lower().split())
    if len(start) < 2:
        return places.limit(0)
    shown = places.filter(~F.col("level").isin("country", "area") & T.folded_name(F.col("name")).startswith(start))
    return shown.orderBy(F.col("level") == "region", F.desc("population"), "place_id").limit(min(max(limit, 1), 50))
