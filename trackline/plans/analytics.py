"""Queries on copies by day, forwards, listings and health by instance."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from trackline.functions import calendar as C
from trackline.operators import analytics as R
from trackline.operators import intervals as I
from trackline.operators.copies import NEAR, VERBATIM, earliest_told
from trackline.plans.stats import LOCAL, STAMP
from trackline.plans.timelines import _A
from trackline.sources import bindings as B

NOW, BACK = "2024-01-30 12:00:00", "2024-01-29 00:00:00"


def _ts(text):
    return F.expr(f"timestamp_ntz'{text}'")


def _day(df):
    return df.withColumn("day", F.col("day").cast("string"))


def _pairs(spark, d):
    """Copies of facts as pairs: the earliest fact of another source with the place and category within the hour before."""
    first = earliest_told(B.facts(spark, d), ["place_id", "category"], ["object_count"])
    kind = F.when(F.col("object_count") == F.col("x.object_count"), VERBATIM).otherwise(NEAR)
    return first.select("copy", "copy_source", "copy_at", "x.original", "x.original_source", "x.original_at", kind.alias("kind"), F.timestamp_diff("SECOND", F.col("x.original_at"), F.col("copy_at")).cast("double").alias("delay_s"), F.lit(True).alias("is_primary"))


def _posts(spark, d):
    """Documents as posts: three rows in turn are one post and its edits."""
    m = B.messages(spark, d)
    return m.select("source", F.floor(F.col("raw_message_id") / 3).alias("post_key"), "published_at")


def _forwards(spark, d):
    o, i, c = (B.table(spark, d, t) for t in ("orders", "lineitem", "customer"))
    rows = o.join(i, o.o_orderkey == i.l_orderkey).join(c, o.o_custkey == c.c_custkey)
    return rows.select(F.col("c_nationkey").alias("source_id"), F.col("o_orderkey").alias("post_key"), F.col("l_shipdate").cast("timestamp_ntz").alias("at"), F.col("l_suppkey").alias("channel"))


def _channels(spark, d):
    return B.table(spark, d, "supplier").filter("s_acctbal >= 5000").select(F.col("s_suppkey").alias("channel"))


def posts_per_day(spark, d):
    return _day(R.posts_by(_posts(spark, d), "source", C.local_day(F.col("published_at")).alias("day")))


def posts_per_hour(spark, d):
    return R.posts_by(_posts(spark, d), "source", F.hour(C.local(F.col("published_at"))).alias("hour")).select("source", "hour", "posts")


def copies_per_day(spark, d):
    r = _day(R.copies_per_day(_pairs(spark, d)))
    return r.withColumns({c: F.round(c, 6) for c in ("mean_delay_s", "verbatim_share")})


def copied_per_day(spark, d):
    return _day(R.copied_per_day(_pairs(spark, d))).withColumn("mean_lead_s", F.round("mean_lead_s", 6))


def copier_summary(spark, d):
    posts = B.facts(spark, d).groupBy("source_id").agg(F.count("*").alias("posts"))
    r = R.copier_summary(R.copies_per_day(_pairs(spark, d)), posts)
    return r.withColumns({c: F.round(c, 6) for c in ("median_delay_s", "mean_delay_s", "verbatim_share", "unique_share")})


def forwards_per_day(spark, d):
    return _day(R.forwards_per_day(_forwards(spark, d), _channels(spark, d)))


def external_channels(spark, d):
    return R.external_channels(_forwards(spark, d), _channels(spark, d))


def recent_copies(spark, d):
    return R.recent_copies(_pairs(spark, d), kind=NEAR, primary=True, limit=500).select("copy", "original", "kind")


def latest_copies_of_pairs(spark, d):
    return R.latest_of_each(_pairs(spark, d), ["copy_source", "original_source"], "copy_at", "copy", 2).select("copy_source", "original_source", "copy", "place")


def copies_with_both_sides(spark, d):
    sides = B.facts(spark, d).select(F.col("fact_id").alias("message_id"), "category", "object_count")
    return R.with_both_sides(_pairs(spark, d).select("copy", "original"), sides, ["category", "object_count"])


def facts_and_repeats(spark, d):
    return R.facts_and_repeats(B.facts(spark, d), _pairs(spark, d).select(F.col("copy").alias("fact_id")))


def processing_per_instance(spark, d):
    w = B.worked(spark, d).withColumn("instance", F.col("line"))
    r = R.per_instance(w, _ts("1998-08-01 00:00:00"))
    return r.withColumns({"last_at": C.stamp(F.col("last_at")), "p50": F.round("p50", 6), "p90": F.round("p90", 6)})


def _alerts(spark, d):
    return I.pair_events(B.facts(spark, d), "place_id", "observed_at", F.col("category") == "signup", F.col("category") == "purchase", ["fact_id"])


def alert_history(spark, d):
    return R.alert_history(_alerts(spark, d), _ts(NOW), 36, 200).select("place_id", C.stamp(F.col("start")).alias("start"))


def _tracks(spark, d):
    return B.facts(spark, d).groupBy("source_id").agg(F.max("observed_at").alias("last_at"), (F.max_by("category", F.struct("observed_at", "fact_id")) != "error").alias("active")).withColumnRenamed("source_id", "track_id")


def live_now(spark, d):
    r = R.live(_tracks(spark, d), _alerts(spark, d), _ts(NOW), "6 hours", active_only=True)
    return r.groupBy("kind").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), C.stamp(F.max("at")).alias("newest"))


def looked_up_alerts(spark, d):
    r = R.looked_up(_alerts(spark, d), "place_id", [3, 7, 11], "start", _ts(BACK), F.col("end").isNull())
    return r.select("place_id", C.stamp(F.col("start")).alias("start"), C.stamp(F.col("end")).alias("end"))


def merged_tracks(spark, d):
    f = B.facts(spark, d).select(F.col("source_id").alias("track_id"), "observed_at")
    newest = lambda rows: rows.groupBy("track_id").agg(F.max("observed_at").alias("last_at"))
    old, new = newest(f.filter(F.col("observed_at") < _ts(NOW))), newest(f.filter(F.col("observed_at") >= _ts(BACK)))
    return R.merged_live(old, new, "track_id", "last_at", _ts(BACK)).select("track_id", C.stamp(F.col("last_at")).alias("last_at"))


def places_below_regions(spark, d):
    return R.places_of_level(B.places(spark, d), 1).select("place_id", "name", "level")


def facts_near_places(spark, d):
    return R.recent_per_place(B.facts(spark, d), _ts(BACK), _ts(NOW)).withColumn("last_at", C.stamp(F.col("last_at")))


def category_shares(spark, d):
    counts = B.facts(spark, d).groupBy("category", "source_id").agg(F.count("*").alias("n"))
    return R.shares(counts, "category", "n").withColumn("share", F.round("share", 9))


def facts_per_report_bucket(spark, d):
    starts = [datetime(2024, 1, 3) + timedelta(hours=37 * i) for i in range(15)]
    return B.facts(spark, d).groupBy(C.stamp(R.bucket_of(F.col("observed_at"), starts)).alias("bucket")).agg(F.count("*").alias("n"))


_F, _P, _W = B.FACTS_SQL, B.PLACES_SQL, B.WORKED_SQL
_C = f"""{_F}, pairs AS (SELECT c.fact_id AS copy, c.source_id AS copy_source, c.observed_at AS copy_at, arg_min(o.fact_id, (o.observed_at, o.fact_id)) AS original,
    arg_min(o.source_id, (o.observed_at, o.fact_id)) AS original_source, CASE WHEN c.object_count = arg_min(o.object_count, (o.observed_at, o.fact_id)) THEN 2 ELSE 1 END AS kind,
    CAST(trunc((epoch_us(c.observed_at) - epoch_us(min(o.observed_at))) / 1e6) AS DOUBLE) AS delay_s, CAST({LOCAL.format('c.observed_at')} AS DATE) AS day
  FROM facts c JOIN facts o ON o.place_id = c.place_id AND o.category = c.category AND o.observed_at < c.observed_at AND o.observed_at >= c.observed_at - INTERVAL 1 HOUR AND o.source_id <> c.source_id
  GROUP BY c.fact_id, c.source_id, c.observed_at, c.object_count)"""
_D = """days AS (SELECT copy_source AS source_id, day, count(*) AS copies, avg(delay_s) AS mean_delay_s, quantile_cont(delay_s, 0.5) AS median_delay_s, avg(CASE WHEN kind = 2 THEN 1.0 ELSE 0.0 END) AS verbatim_share
  FROM pairs GROUP BY 1, 2)"""
_M = f"""posts AS (SELECT source, doc_id // 3 AS post_key, {LOCAL.format("(TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE)")} AS made FROM documents)"""
_X = f"""fwd AS (SELECT c_nationkey AS source_id, o_orderkey AS post_key, CAST({LOCAL.format('CAST(l_shipdate AS TIMESTAMP)')} AS DATE) AS day, l_suppkey AS channel, l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 5000) AS internal
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey)"""

SQL = {
    "posts_per_day": f"WITH {_M} SELECT source, CAST(CAST(made AS DATE) AS VARCHAR) AS day, count(DISTINCT post_key) AS posts, count(*) AS rows, count(*) - count(DISTINCT post_key) AS edits FROM posts GROUP BY 1, 2",
    "posts_per_hour": f"WITH {_M} SELECT source, CAST(hour(made) AS INTEGER) AS hour, count(DISTINCT post_key) AS posts FROM posts GROUP BY 1, 2",
    "copies_per_day": f"WITH {_C}, {_D} SELECT source_id, CAST(day AS VARCHAR) AS day, copies, round(mean_delay_s, 6) AS mean_delay_s, median_delay_s, round(verbatim_share, 6) AS verbatim_share FROM days",
    "copied_per_day": f"WITH {_C} SELECT original_source AS source_id, CAST(day AS VARCHAR) AS day, count(*) AS copied_by, round(avg(delay_s), 6) AS mean_lead_s FROM pairs GROUP BY 1, 2",
    "copier_summary": f"""WITH {_C}, {_D}, p AS (SELECT source_id, count(*) AS posts FROM facts GROUP BY 1), m AS (SELECT source_id, CAST(sum(copies) AS BIGINT) AS copies, sum(median_delay_s * copies) / sum(copies) AS med,
      sum(mean_delay_s * copies) / sum(copies) AS mean, sum(verbatim_share * copies) / sum(copies) AS share FROM days GROUP BY 1)
      SELECT p.source_id, posts, coalesce(copies, 0) AS copies, round(med, 6) AS median_delay_s, round(mean, 6) AS mean_delay_s, round(share, 6) AS verbatim_share, round(greatest(0.0, 1 - coalesce(copies, 0) / posts), 6) AS unique_share
      FROM p LEFT JOIN m ON m.source_id = p.source_id""",
    "forwards_per_day": f"WITH {_X} SELECT source_id, CAST(day AS VARCHAR) AS day, count(DISTINCT post_key) FILTER (WHERE internal) AS internal, count(DISTINCT post_key) FILTER (WHERE NOT internal) AS external FROM fwd GROUP BY 1, 2",
    "external_channels": f"WITH {_X} SELECT channel, count(DISTINCT (source_id, post_key)) AS posts, count(DISTINCT source_id) AS sources FROM fwd WHERE NOT internal GROUP BY 1 ORDER BY posts DESC, channel LIMIT 40",
    "recent_copies": f"WITH {_C} SELECT copy, original, CAST(kind AS INTEGER) AS kind FROM pairs WHERE kind = 1 ORDER BY copy_at DESC, copy DESC LIMIT 200",
    "latest_copies_of_pairs": f"""WITH {_C} SELECT copy_source, original_source, copy, CAST(i AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY copy_source, original_source ORDER BY copy_at DESC, copy DESC) AS i FROM pairs)
      WHERE i <= 2""",
    "copies_with_both_sides": f"""WITH {_C} SELECT copy, original, a.category AS copy_category, a.object_count AS copy_object_count, b.category AS original_category, b.object_count AS original_object_count
      FROM pairs JOIN facts a ON a.fact_id = copy JOIN facts b ON b.fact_id = original""",
    "facts_and_repeats": f"""WITH {_C} SELECT CASE WHEN grouping(source_id) = 1 THEN -1 ELSE source_id END AS source_id, count(*) AS facts, count(copy) AS repeats
      FROM (SELECT f.source_id, p.copy FROM facts f LEFT JOIN pairs p ON p.copy = f.fact_id) GROUP BY ROLLUP (source_id)""",
    "processing_per_instance": f"""WITH {_W}, w AS (SELECT *, processed_at IS NOT NULL AND status <> 'P' AS done FROM worked) SELECT line AS instance, count(*) FILTER (WHERE done) AS processed, round(quantile_cont(amount, 0.5) FILTER (WHERE done), 6) AS p50,
      round(quantile_cont(amount, 0.9) FILTER (WHERE done), 6) AS p90, {STAMP.format('max(processed_at) FILTER (WHERE done)')} AS last_at,
      count(*) FILTER (WHERE done AND processed_at > TIMESTAMP '1998-07-31') AS last_day, count(*) FILTER (WHERE status = 'P') AS in_progress FROM w GROUP BY 1""",
    "alert_history": f"""WITH {_F}, {_A} SELECT place_id, {STAMP.format('"start"')} AS "start" FROM alerts WHERE "start" >= TIMESTAMP '{NOW}' - INTERVAL 36 HOUR AND "start" <= TIMESTAMP '{NOW}' ORDER BY alerts."start" DESC, place_id LIMIT 200""",
    "live_now": f"""WITH {_F}, {_A}, t AS (SELECT source_id AS id, max(observed_at) AS seen, arg_max(category, (observed_at, fact_id)) <> 'error' AS active FROM facts GROUP BY 1),
      l AS (SELECT 'track' AS kind, id, seen FROM t WHERE active AND seen > TIMESTAMP '{NOW}' - INTERVAL 6 HOUR AND seen <= TIMESTAMP '{NOW}'
        UNION ALL SELECT 'alert', place_id, "start" FROM alerts WHERE "start" <= TIMESTAMP '{NOW}' AND ("end" IS NULL OR "end" > TIMESTAMP '{NOW}'))
      SELECT kind, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, {STAMP.format('max(seen)')} AS newest FROM l GROUP BY 1""",
    "looked_up_alerts": f"""WITH {_F}, {_A} SELECT place_id, {STAMP.format('"start"')} AS "start", {STAMP.format('"end"')} AS "end" FROM alerts WHERE place_id IN (3, 7, 11) AND (alerts."start" >= TIMESTAMP '{BACK}' OR alerts."end" IS NULL)""",
    "merged_tracks": f"WITH {_F} SELECT source_id AS track_id, {STAMP.format('max(observed_at)')} AS last_at FROM facts WHERE observed_at >= TIMESTAMP '{BACK}' GROUP BY 1",
    "places_below_regions": f"WITH {_P} SELECT place_id, name, 1 AS level FROM places WHERE parent_id IN (SELECT place_id FROM places WHERE parent_id IS NULL)",
    "facts_near_places": f"""WITH {_F}, s AS (SELECT fact_id, observed_at, place_id FROM facts UNION SELECT fact_id, observed_at, dest_id FROM facts) SELECT place_id, count(*) AS facts, {STAMP.format('max(observed_at)')} AS last_at
      FROM s WHERE observed_at >= TIMESTAMP '{BACK}' AND observed_at < TIMESTAMP '{NOW}' GROUP BY 1""",
    "category_shares": f"WITH {_F} SELECT category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM facts GROUP BY 1",
    "facts_per_report_bucket": f"""WITH {_F}, b AS (SELECT TIMESTAMP '2024-01-03' + range * INTERVAL 37 HOUR AS s FROM range(15)),
      x AS (SELECT (SELECT coalesce(max(s) FILTER (WHERE s <= observed_at), min(s)) FROM b) AS s FROM facts) SELECT {STAMP.format('s')} AS bucket, count(*) AS n FROM x GROUP BY 1""",
}

QUERIES = {name: globals()[name] for name in SQL}
