"""Queries on intervals, snapshots and hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackline.functions import calendar as C
from trackline.operators import intervals as I
from trackline.operators import snapshot as N
from trackline.plans.stats import LOCAL, STAMP
from trackline.sources import bindings as B

FROM, TO, AT = "2024-01-05 00:00:00", "2024-01-25 00:00:00", "2024-01-15 12:00:00"


def _ts(text):
    return F.expr(f"timestamp_ntz'{text}'")


def _alerts(spark, d):
    opens, closes = F.col("category") == "signup", F.col("category") == "purchase"
    return I.pair_events(B.facts(spark, d), "place_id", "observed_at", opens, closes, ["fact_id"])


def alert_intervals(spark, d):
    a = _alerts(spark, d)
    return a.select("place_id", C.stamp(F.col("start")).alias("start"), C.stamp(F.col("end")).alias("end"))


def alert_summary(spark, d):
    a = I.clip(_alerts(spark, d), _ts(FROM), _ts(TO))
    return a.groupBy("place_id").agg(F.count("*").alias("n"), F.round(F.sum(I.seconds("from_at", "to_at") / 3600), 4).alias("hours"), F.count_if(F.col("end").isNull() | (F.col("end") > _ts(TO))).alias("open"))


def alert_hours_per_bucket(spark, d):
    a = I.split_hours(I.clip(_alerts(spark, d), _ts(FROM), _ts(TO)))
    return a.groupBy(C.stamp(F.col("bucket")).alias("bucket")).agg(F.round(F.sum("hours"), 4).alias("hours"), F.count("*").alias("n"))


def alert_hours_per_local_day(spark, d):
    a = I.split_hours(I.clip(_alerts(spark, d), _ts(FROM), _ts(TO)))
    days = a.groupBy(C.local_day(F.col("bucket")).cast("string").alias("day")).agg(F.round(F.sum("hours"), 4).alias("hours"))
    return days.orderBy(F.desc("hours"), "day").limit(10)


def alert_durations(spark, d):
    return I.duration_bins(_alerts(spark, d))


def alert_unions(spark, d):
    m = I.merged(I.clip(_alerts(spark, d), _ts(FROM), _ts(TO)), ["place_id"])
    return m.groupBy("place_id").agg(F.count("*").alias("islands"), F.sum("n").alias("n"), F.round(F.sum(I.seconds("start", "end") / 60), 3).alias("minutes"))


def alerts_in_force(spark, d):
    return I.in_force(_alerts(spark, d), _ts(AT)).groupBy("place_id").agg(F.count("*").alias("n"))


def facts_under_alert(spark, d):
    a = _alerts(spark, d).filter("end is not null").select("place_id", "start", "end")
    f = B.facts(spark, d).filter("category = 'error'").select("fact_id", "place_id", "observed_at")
    return I.bucketed_interval_join(f, a, "observed_at", "start", "end", 7200.0, ["place_id"]).groupBy("place_id").agg(F.count("*").alias("pairs"), F.countDistinct("fact_id").alias("facts"))


def snapshot_at(spark, d):
    r = N.as_of(B.facts(spark, d), "source_id", _ts(AT), "observed_at", "fact_id", F.expr("interval 3 hours"))
    return r.select("source_id", "fact_id", "category", C.stamp(F.col("observed_at")).alias("observed_at"))


def snapshots_over_time(spark, d):
    at = spark.range(30).select(F.expr("timestamp_ntz'2024-01-01 12:00:00' + make_dt_interval(int(id))").alias("at"))
    r = N.as_of_each(B.facts(spark, d).select("source_id", "fact_id", "observed_at"), at, "source_id", "observed_at", "at", "fact_id")
    return r.select("source_id", C.stamp(F.col("at")).alias("at"), F.col("rev.fact_id").alias("fact_id"))


def newest_per_source(spark, d):
    return N.newest(B.facts(spark, d), ["source_id"], [F.desc("observed_at"), F.desc("fact_id")], 6).select("source_id", "fact_id")


def deduped_samples(spark, d):
    f = N.without_repeats(B.facts(spark, d), ["source_id"], ["observed_at", "fact_id"], ["category"])
    return f.groupBy("source_id").agg(F.count("*").alias("n"), F.sum("fact_id").alias("ids"))


def fact_feed(spark, d):
    return N.feed(B.facts(spark, d), F.expr("timestamp_ntz'2024-01-30 18:00:00'"), 300).select("fact_id", "category", "place_id")


def merged_live_feed(spark, d):
    f = B.facts(spark, d).select("fact_id", "observed_at")
    stored, fresh = f.filter("observed_at < timestamp_ntz'2024-01-30 18:00:00'"), f.filter("observed_at >= timestamp_ntz'2024-01-30 12:00:00'")  # they overlap
    return N.merged_feed(stored, fresh, "fact_id", "observed_at", F.expr("timestamp_ntz'2024-01-30 00:00:00'")).select("fact_id")


def change_freshness(spark, d):
    c = B.facts(spark, d).select(F.col("category").alias("kind"), F.col("observed_at").alias("at"))
    r = N.changes_worth_sending(c, F.expr("timestamp_ntz'2024-01-31 00:00:00'"), {"view": 86400.0, "click": 3600.0, "error": 864000.0})
    return r.groupBy("kind", "fresh").agg(F.count("*").alias("n"))


def place_lines(spark, d):
    return N.ancestors(B.places(spark, d))


def alerts_concerning(spark, d):
    p = B.places(spark, d)
    live = I.in_force(_alerts(spark, d), _ts(AT)).select("place_id", "start")
    live = live.unionByName(live.filter("place_id % 5 = 0").withColumn("place_id", F.col("place_id") % 25 + 100).filter("place_id < 105"))
    return N.related_alerts(live, p.select("place_id"), p).groupBy("place_id", "rank").agg(F.count("*").alias("n"))


def timeline(spark, d):
    f = B.facts(spark, d)
    bucket = F.window(F.col("observed_at").cast("timestamp"), "60 minutes")["start"]
    return f.groupBy(C.stamp(bucket).alias("bucket")).agg(F.count("*").alias("facts"), F.countDistinct("source_id").alias("sources"))


def sources_per_place(spark, d):
    s = N.sources_of(B.facts(spark, d), "place_id", "source_id")
    return s.select("place_id", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


_F, _P = B.FACTS_SQL, B.PLACES_SQL
_A = """alerts AS (SELECT place_id, observed_at AS "start", (SELECT min(b.observed_at) FROM facts b WHERE b.place_id = a.place_id AND b.category = 'purchase'
  AND (b.observed_at > a.observed_at OR (b.observed_at = a.observed_at AND b.fact_id > a.fact_id))) AS "end" FROM facts a WHERE category = 'signup')"""
_C = """clipped AS (SELECT *, greatest("start", TIMESTAMP '2024-01-05') AS from_at, least(coalesce("end", TIMESTAMP '2024-01-25'), TIMESTAMP '2024-01-25') AS to_at FROM alerts
  WHERE greatest("start", TIMESTAMP '2024-01-05') < least(coalesce("end", TIMESTAMP '2024-01-25'), TIMESTAMP '2024-01-25'))"""
_SEC = "(epoch_us({1}) - epoch_us({0})) / 1e6"
_H = f"""parts AS (SELECT *, {_SEC.format("greatest(bucket, from_at)", "least(bucket + INTERVAL 1 HOUR, to_at)")} / 3600 AS hours FROM (
  SELECT *, unnest(generate_series(date_trunc('hour', from_at), to_at - INTERVAL 1 MICROSECOND, INTERVAL 1 HOUR)) AS bucket FROM clipped))"""
_AT = "TIMESTAMP '2024-01-15 12:00:00'"
_LIVE = f"""live AS (SELECT place_id FROM alerts WHERE "start" <= {_AT} AND ("end" IS NULL OR "end" > {_AT}))"""

SQL = {
    "alert_summary": f"""WITH {_F}, {_A}, {_C} SELECT place_id, count(*) AS n, round(sum({_SEC.format("from_at", "to_at")} / 3600), 4) AS hours,
      count(*) FILTER (WHERE "end" IS NULL OR "end" > TIMESTAMP '2024-01-25') AS open FROM clipped GROUP BY 1""",
    "alert_hours_per_bucket": f"WITH {_F}, {_A}, {_C}, {_H} SELECT {STAMP.format('bucket')} AS bucket, round(sum(hours), 4) AS hours, count(*) AS n FROM parts GROUP BY 1",
    "alert_hours_per_local_day": f"WITH {_F}, {_A}, {_C}, {_H} SELECT CAST(CAST({LOCAL.format('bucket')} AS DATE) AS VARCHAR) AS day, round(sum(hours), 4) AS hours FROM parts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "alert_durations": f"""WITH {_F}, {_A} SELECT CAST(len(list_filter([30, 60, 120, 240, 480], lambda e: {_SEC.format('"start"', '"end"')} / 60 >= e)) AS INTEGER) AS bin, count(*) AS n
      FROM alerts WHERE "end" IS NOT NULL GROUP BY 1""",
    "alert_unions": f"""WITH {_F}, {_A}, {_C}, m AS (SELECT *, CASE WHEN from_at > max(to_at) OVER (PARTITION BY place_id ORDER BY from_at, to_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        THEN 1 ELSE 0 END AS new FROM clipped), i AS (SELECT *, sum(new) OVER (PARTITION BY place_id ORDER BY from_at, to_at ROWS UNBOUNDED PRECEDING) AS island FROM m),
      j AS (SELECT place_id, island, min(from_at) AS a, max(to_at) AS b, count(*) AS n FROM i GROUP BY 1, 2)
      SELECT place_id, count(*) AS islands, CAST(sum(n) AS BIGINT) AS n, round(sum({_SEC.format("a", "b")} / 60), 3) AS minutes FROM j GROUP BY 1""",
    "alerts_in_force": f"WITH {_F}, {_A}, {_LIVE} SELECT place_id, count(*) AS n FROM live GROUP BY 1",
    "facts_under_alert": f"""WITH {_F}, {_A} SELECT f.place_id, count(*) AS pairs, count(DISTINCT fact_id) AS facts FROM facts f JOIN alerts a ON a.place_id = f.place_id
      AND a."start" <= f.observed_at AND f.observed_at < a."end" WHERE f.category = 'error' GROUP BY 1""",
    "snapshot_at": f"""WITH {_F} SELECT source_id, fact_id, category, {STAMP.format('observed_at')} AS observed_at FROM (
      SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY observed_at DESC, fact_id DESC) AS i FROM facts WHERE observed_at <= {_AT}) WHERE i = 1 AND observed_at >= {_AT} - INTERVAL 3 HOUR""",
    "snapshots_over_time": f"""WITH {_F}, q AS (SELECT TIMESTAMP '2024-01-01 12:00:00' + range * INTERVAL 1 DAY AS moment FROM range(30))
      SELECT source_id, {STAMP.format('moment')} AS "at", arg_max(fact_id, (observed_at, fact_id)) AS fact_id FROM q JOIN facts ON observed_at <= moment GROUP BY 1, 2""",
    "newest_per_source": f"WITH {_F} SELECT source_id, fact_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY observed_at DESC, fact_id DESC) AS i FROM facts) WHERE i <= 6",
    "deduped_samples": f"""WITH {_F} SELECT source_id, count(*) AS n, CAST(sum(fact_id) AS BIGINT) AS ids FROM (
      SELECT *, lag(category) OVER (PARTITION BY source_id ORDER BY observed_at, fact_id) AS prev FROM facts) WHERE prev IS DISTINCT FROM category GROUP BY 1""",
    "fact_feed": f"WITH {_F} SELECT fact_id, category, place_id FROM facts WHERE observed_at >= TIMESTAMP '2024-01-30 18:00:00' ORDER BY observed_at DESC, fact_id DESC LIMIT 300",
    "merged_live_feed": f"WITH {_F} SELECT fact_id FROM facts WHERE observed_at >= TIMESTAMP '2024-01-30' ORDER BY observed_at DESC, fact_id DESC LIMIT 500",
    "change_freshness": f"""WITH {_F} SELECT category AS kind, coalesce(date_diff('second', observed_at, TIMESTAMP '2024-01-31') - CASE WHEN (epoch_us(observed_at) % 1000000) > 0 THEN 1 ELSE 0 END
      <= CASE category WHEN 'view' THEN 86400 WHEN 'click' THEN 3600 WHEN 'error' THEN 864000 END, false) AS fresh, count(*) AS n FROM facts GROUP BY 1, 2""",
    "place_lines": f"WITH {_P} SELECT place_id, place_id AS ancestor, 0 AS steps FROM places UNION ALL SELECT place_id, parent_id, 1 FROM places WHERE parent_id IS NOT NULL",
    "alerts_concerning": f"""WITH {_F}, {_P}, {_A}, {_LIVE}, l AS (SELECT place_id AS p FROM live UNION ALL SELECT place_id % 25 + 100 FROM live WHERE place_id % 5 = 0 AND place_id % 25 < 5),
      r AS (SELECT place_id, place_id AS p, 0 AS rank FROM places UNION ALL SELECT place_id, parent_id, 1 FROM places WHERE parent_id IS NOT NULL
        UNION ALL SELECT parent_id, place_id, 2 FROM places WHERE parent_id IS NOT NULL)
      SELECT place_id, rank, count(*) AS n FROM r JOIN l USING (p) GROUP BY 1, 2""",
    "timeline": f"""WITH {_F} SELECT {STAMP.format("date_trunc('hour', observed_at)")} AS bucket, count(*) AS facts, count(DISTINCT source_id) AS sources FROM facts GROUP BY 1""",
    "alert_intervals": f"""WITH {_F}, {_A} SELECT place_id, {STAMP.format('"start"')} AS "start", {STAMP.format('"end"')} AS "end" FROM alerts""",
    "sources_per_place": f"""WITH {_F} SELECT place_id, array_to_string(list_sort(list(DISTINCT source_id)), ',') AS sources FROM facts GROUP BY 1""",
}

QUERIES = {name: globals()[name] for name in SQL}
