"""Copy analytics by day and source, report listings and health by instance."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackline.functions import calendar as C
from trackline.operators.copies import VERBATIM


def posts_by(posts: DataFrame, *keys: str | Column) -> DataFrame:
    """Per key: different posts, rows, and the rows that are edits of a post. ``posts``: post_key and the keys' columns."""
    counted = posts.groupBy(*keys).agg(F.countDistinct("post_key").alias("posts"), F.count("*").alias("rows"))
    return counted.withColumn("edits", F.col("rows") - F.col("posts"))


def copies_per_day(pairs: DataFrame) -> DataFrame:
    """Per copier and local day: copies, mean and median delay, share of verbatim ones. ``pairs``: primary pairs."""
    day = C.local_day(F.col("copy_at")).alias("day")
    return pairs.groupBy(F.col("copy_source").alias("source_id"), day).agg(
        F.count("*").alias("copies"), F.avg("delay_s").alias("mean_delay_s"), F.median("delay_s").alias("median_delay_s"), F.avg((F.col("kind") == VERBATIM).cast("int")).alias("verbatim_share")
    )


def copied_per_day(pairs: DataFrame) -> DataFrame:
    """Per original source and local day of the copy: how often it was copied, with the mean lead."""
    return pairs.groupBy(F.col("original_source").alias("source_id"), C.local_day(F.col("copy_at")).alias("day")).agg(F.count("*").alias("copied_by"), F.avg("delay_s").alias("mean_lead_s"))


def copier_summary(days: DataFrame, posts: DataFrame) -> DataFrame:
    """Per source over its days: copies, unique share of its posts, and copy-weighted means of the daily medians and shares.

    ``days`` as from :func:`copies_per_day`, ``posts``: source_id, posts.
    """
    weighted = lambda c: F.sum(F.col(c) * F.col("copies")) / F.sum("copies")
    made = days.groupBy("source_id").agg(F.sum("copies").alias("copies"), weighted("median_delay_s").alias("median_delay_s"), weighted("mean_delay_s").alias("mean_delay_s"), weighted("verbatim_share").alias("verbatim_share"))
    joined = posts.select("source_id", "posts").join(made, "source_id", "left").fillna(0, ["copies"])
    return joined.withColumn("unique_share", F.greatest(F.lit(0.0), 1 - F.col("copies") / F.col("posts")))


def forwards_per_day(posts: DataFrame, channels: DataFrame) -> DataFrame:
    """Per source and local day: different posts forwarded from known sources, and from channels that are none.

    ``posts``: source_id, post_key, at, channel (null if not forwarded). ``channels``: channel of each known source.
    """
    known = channels.select("channel").distinct().withColumn("internal", F.lit(True))
    rows = posts.filter("channel is not null").join(known, "channel", "left")
    post = lambda own: F.when(F.col("internal").isNotNull() == own, F.col("post_key"))
    return rows.groupBy("source_id", C.local_day(F.col("at")).alias("day")).agg(F.countDistinct(post(True)).alias("internal"), F.countDistinct(post(False)).alias("external"))


def external_channels(posts: DataFrame, channels: DataFrame, top: int = 40) -> DataFrame:
    """The channels outside the known sources that most posts were forwarded from; ties go to the smaller channel."""
    rows = posts.filter("channel is not null").join(channels.select("channel").distinct(), "channel", "left_anti")
    counted = rows.groupBy("channel").agg(F.countDistinct("source_id", "post_key").alias("posts"), F.countDistinct("source_id").alias("sources"))
    return counted.orderBy(F.desc("posts"), "channel").limit(top)


def recent_copies(pairs: DataFrame, source: int | None = None, kind: int | None = None, primary: bool = False, limit: int = 50) -> DataFrame:
    """The newest pairs, by choice of one source (on either side), of a kind, or primary ones only; 1 to 200 rows."""
    if source is not None:
        pairs = pairs.filter((F.col("copy_source") == source) | (F.col("original_source") == source))
    if kind is not None:
        pairs = pairs.filter(F.col("kind") == kind)
    if primary:
        pairs = pairs.filter("is_primary")
    return pairs.orderBy(F.desc("copy_at"), F.desc("copy")).limit(min(max(limit, 1), 200))


def latest_of_each(rows: DataFrame, keys: list[str], at: str, tie: str, n: int = 20) -> DataFrame:
    """The newest ``n`` rows of each key, numbered from 1. Spark cuts each task's rows to ``n`` a key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def with_both_sides(pairs: DataFrame, messages: DataFrame, columns: list[str]) -> DataFrame:
    """Each pair with ``columns`` of the copy's and the original's message (copy_*, original_*)."""
    for side in ("copy", "original"):
        pairs = pairs.join(messages.select(F.col("message_id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)
    return pairs


def facts_and_repeats(facts: DataFrame, repeats: DataFrame) -> DataFrame:
    """Per source and over all (source_id -1): facts and those that repeat another one. ``repeats``: fact_id."""
    marked = facts.select("fact_id", "source_id").join(repeats.select("fact_id").distinct().withColumn("repeat", F.lit(1)), "fact_id", "left")
    return _with_total(marked, F.count("*").alias("facts"), F.count("repeat").alias("repeats"))


def tracks_by_first_source(track_facts: DataFrame) -> DataFrame:
    """Per source of a track's first fact, and over all (source_id -1): the tracks. ``track_facts``: track_id, sequence, source_id."""
    return _with_total(track_facts.filter("sequence = 1"), F.countDistinct("track_id").alias("tracks"))


def _with_total(rows: DataFrame, *sums: Column) -> DataFrame:
    rolled = rows.rollup("source_id").agg(F.grouping("source_id").alias("__all"), *sums)
    return rolled.withColumn("source_id", F.when(F.col("__all") == 1, -1).otherwise(F.col("source_id"))).drop("__all")


def per_instance(worked: DataFrame, now: Column) -> DataFrame:
    """Per instance: processed, their median and 90th percentile of the amount, the last one, those of the last day, in progress."""
    done = F.col("processed_at").isNotNull() & (F.col("status") != "P")
    return worked.groupBy("instance").agg(
        F.count_if(done).alias("processed"),
        F.percentile(F.when(done, F.col("amount")), F.array(F.lit(0.5), F.lit(0.9))).alias("p"),
        F.max(F.when(done, F.col("processed_at"))).alias("last_at"),
        F.count_if(done & (F.col("processed_at") > now - F.expr("interval 1 day"))).alias("last_day"),
        F.count_if(F.col("status") == "P").alias("in_progress"),
    ).select("instance", "processed", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p90"), "last_at", "last_day", "in_progress")


def alert_history(alerts: DataFrame, now: Column, hours: int = 24, limit: int = 200) -> DataFrame:
    """Alerts that began within the last 1 to 336 hours, newest first."""
    since = now - F.make_dt_interval(hours=F.lit(min(max(hours, 1), 336)))
    return alerts.filter((F.col("start") >= since) & (F.col("start") <= now)).orderBy(F.desc("start"), "place_id").limit(limit)


def live(tracks: DataFrame, alerts: DataFrame, now: Column, lifetime: str, active_only: bool = False) -> DataFrame:
    """``kind, id, at`` of the tracks seen within their lifetime (by choice active ones only) and of every open alert.

    ``tracks``: track_id, last_at, active. ``alerts``: place_id, start, end.
    """
    seen = tracks.filter((F.col("last_at") > now - F.expr(f"interval {lifetime}")) & (F.col("last_at") <= now))
    seen = seen.filter("active") if active_only else seen
    open_ = alerts.filter((F.col("start") <= now) & (F.col("end").isNull() | (F.col("end") > now)))
    return seen.select(F.lit("track").alias("kind"), F.col("track_id").alias("id"), F.col("last_at").alias("at")).unionByName(open_.select(F.lit("alert").alias("kind"), F.col("place_id").alias("id"), F.col("start").alias("at")))


def looked_up(rows: DataFrame, id_column: str, wanted: list[int], at: str, floor: Column, always: Column | None = None) -> DataFrame:
    """Rows of some ids that are not older than ``floor``; rows for which ``always`` holds qualify at any age."""
    fresh = F.col(at) >= floor
    return rows.filter(F.col(id_column).isin(wanted) & (fresh if always is None else fresh | always))


def merged_live(old: DataFrame, new: DataFrame, id_column: str, at: str, floor: Column) -> DataFrame:
    """Two live lists as one: the newest row of each id, without rows older than ``floor``."""
    both = old.unionByName(new).filter(F.col(at) >= floor)
    w = Window.partitionBy(id_column).orderBy(F.desc(at))
    return both.withColumn("__i", F.row_number().over(w)).filter("__i = 1").drop("__i")


def places_of_level(places: DataFrame, level: int) -> DataFrame:
    """The places of a level: 0 has no parent, 1 a parent without one, and so on."""
    known = places.withColumn("level", F.when(F.col("parent_id").isNull(), 0))
    for depth in range(1, level + 1):
        above = known.filter(F.col("level") == depth - 1).select(F.col("place_id").alias("__p"))
        known = known.join(above, F.col("parent_id") == F.col("__p"), "left").withColumn("level", F.coalesce("level", F.when(F.col("__p").isNotNull(), depth))).drop("__p")
    return known.filter(F.col("level") == level)


def recent_per_place(facts: DataFrame, since: Column, until: Column) -> DataFrame:
    """Per place: facts of a window that lie in the place or head for it, each once, and the newest one's time."""
    near = facts.filter((F.col("observed_at") >= since) & (F.col("observed_at") < until))
    spread = near.select("fact_id", "observed_at", F.explode(F.array_distinct(F.array_compact(F.array("place_id", "dest_id")))).alias("place_id"))
    return spread.groupBy("place_id").agg(F.count("*").alias("facts"), F.max("observed_at").alias("last_at"))


def shares(counts: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's part of the whole, of a histogram with few keys."""
    summed = counts.groupBy(key).agg(F.sum(value).alias(value))
    return summed.withColumn("share", F.col(value) / summed.agg(F.sum(value).alias("all")).scalar())


def report_buckets(now: datetime, span: str) -> tuple[datetime, datetime, str]:
    """Start, end and unit of a report of ``24h`` (hours), ``7d`` or ``30d`` (local days), up to ``now``."""
    if span == "24h":
        end = now.replace(minute=0, second=0, microsecond=0) + timedelta(hours=1)
        return end - timedelta(hours=24), end, "hour"
    return now - timedelta(days={"7d": 7, "30d": 30}[span]), now, "day"


def bucket_of(ts: Column, starts: list[datetime]) -> Column:
    """The last of the given bucket starts that is not after an instant; an earlier instant falls into the first.

    The starts are those of one report, some hundred at most.
    """
    known = F.array(*[F.lit(s).cast("timestamp_ntz") for s in sorted(starts)])
    return F.coalesce(F.try_element_at(F.filter(known, lambda s: s <= ts), F.lit(-1)), F.get(known, F.lit(0))) if starts else F.lit(None).cast("timestamp_ntz")


def report_period(now_local_midnight: datetime, days: int) -> tuple[datetime, datetime]:
    """A period of 1 to 90 local days that ends with today: from local midnight ``days - 1`` ago to the next one."""
    days = min(max(days, 1), 90)
    return now_local_midnight - timedelta(days=days - 1), now_local_midnight + timedelta(days=1)
