"""Report queries and their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from trackline.functions import calendar as C
from trackline.operators import stats as S
from trackline.sources import bindings as B

DAY0, DAY1 = datetime(2024, 1, 1), datetime(2024, 1, 31)
LOCAL = "timezone('Europe/Kyiv', timezone('UTC', {0}))"
DAY_START = "timezone('UTC', timezone('Europe/Kyiv', date_trunc('{1}', timezone('Europe/Kyiv', timezone('UTC', {0})))))"
STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def _stamped(df, *names):
    return df.withColumns({n: C.stamp(F.col(n)) for n in names})


def facts_per_day(spark, d):
    return _stamped(S.per_bucket(B.facts(spark, d), "day"), "bucket")


def facts_per_week(spark, d):
    return _stamped(S.per_bucket(B.facts(spark, d), "week"), "bucket")


def facts_per_hour(spark, d):
    return _stamped(S.per_bucket(B.facts(spark, d), "hour"), "bucket")


def _tracks(facts):
    return facts.groupBy("source_id", "category").agg(F.min("observed_at").alias("first_seen_at"), F.count("*").alias("facts"))


def tracks_per_day(spark, d):
    return _stamped(S.per_bucket(_tracks(B.facts(spark, d)), "day", "first_seen_at"), "bucket")


def class_totals(spark, d):
    facts = B.facts(spark, d)
    return S.per_class(facts, _tracks(facts))


def facts_by_region(spark, d):
    return S.by_region(B.facts(spark, d).withColumn("place_id", F.when(F.col("k") < 90, F.col("place_id"))), B.places(spark, d), 3)


def region_routes(spark, d):
    return S.routes(B.facts(spark, d), B.places(spark, d), 400)


def region_route_matrix(spark, d):
    return S.route_matrix(S.routes(B.facts(spark, d), B.places(spark, d), 400), 3)


def hour_weekday_matrix(spark, d):
    return S.week_matrix(B.facts(spark, d))


def fact_slices(spark, d):
    return S.slices(B.facts(spark, d), ["category", "place_id", "dest_id"])


def source_statistics(spark, d):
    return S.source_stats(B.worked(spark, d), F.col("amount") > 90000, 86400.0 * 30)


def pipeline_rollup(spark, d):
    r = S.rollup_report(B.worked(spark, d))
    return r.withColumns({c: F.round(c, 6) for c in ("p50", "p90", "mean")})


def processed_per_bucket(spark, d):
    w = B.worked(spark, d).filter("status = 'F'")
    p = lambda q: F.expr(f"percentile_cont({q}) WITHIN GROUP (ORDER BY amount) FILTER (WHERE amount > 0)")
    return w.groupBy(C.stamp(F.date_trunc("month", "processed_at")).alias("bucket")).agg(F.count("*").alias("processed"), F.round(p(0.5), 6).alias("p50"), F.round(p(0.9), 6).alias("p90"))


def queue_by_status(spark, d):
    return B.worked(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("message_id").alias("messages"))


def received_per_source_hour(spark, d):
    facts = B.facts(spark, d)
    counts = facts.groupBy("place_id", F.hour("observed_at").alias("hour")).agg(F.count("*").alias("n"))
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    return S.dense(counts, hours, facts.select("place_id").distinct(), "hour", "place_id", "n")


def dense_day_series(spark, d):
    facts = B.facts(spark, d)
    days = C.spine(spark, DAY0, DAY1, "day")
    counts = S.per_bucket(facts, "day")
    return _stamped(S.dense(counts, days, facts.select("category").distinct(), "bucket", "category", "n"), "bucket")


def posts_and_edits(spark, d):
    return B.posts(spark, d).groupBy("source").agg(F.countDistinct("post_key").alias("posts"), F.count("*").alias("rows")).withColumn("edits", F.col("rows") - F.col("posts"))


def delay_histogram(spark, d):
    w = B.worked(spark, d).withColumn("delay", S.lag_seconds("processed_at", "received_at"))
    return S.histogram(w, "delay", [86400.0 * x for x in (0, 30, 60, 365, 1000)])


def delay_details(spark, d):
    w = B.worked(spark, d).withColumn("delay", S.lag_seconds("processed_at", "received_at") / 86400)
    return w.groupBy("source_id").agg(F.count("*").alias("n"), F.median("delay").alias("median"), F.min("delay").alias("min"), F.round(F.avg("delay"), 6).alias("mean"))


def first_reports(spark, d):
    f = S.track_firsts(B.facts(spark, d), "place_id")
    return f.withColumn("day", F.col("day").cast("string"))


def first_reports_per_source(spark, d):
    f = S.track_firsts(B.facts(spark, d), "place_id")
    g = f.groupBy("source_id").agg(F.sum("firsts").alias("firsts"), F.sum("participations").alias("participations"), F.sum("lag_sum").alias("s"), F.sum("lag_count").alias("c"))
    return g.select("source_id", "firsts", "participations", F.round(F.when(F.col("c") > 0, F.col("s") / F.col("c")), 3).alias("mean_lag_s"))


def rolling_values(spark, d):
    r = S.rolling_timings(B.facts(spark, d), "object_count", "observed_at", "60 minutes", "30 minutes")
    return _stamped(r, "start").withColumn("mean", F.round("mean", 6))


def source_health(spark, d):
    facts = B.facts(spark, d)
    names = B.table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"))
    last = facts.groupBy("source_id").agg(F.max("observed_at").alias("last_at"))
    return _stamped(S.health(names, last, F.expr("timestamp_ntz'2024-01-31 00:00:00'"), 7200.0), "last_at")


def place_tree(spark, d):
    p = B.places(spark, d)
    children = p.filter("parent_id is not null").select(F.col("parent_id").alias("region_id"), "place_id", "name")
    regions = p.filter("parent_id is null").select(F.col("place_id").alias("region_id"), F.col("name").alias("region"))
    t = S.tree(children, regions, "region_id", ["place_id", "name"], ["region_id", "region"])
    return t.select("region_id", "region", F.to_json("children").alias("children"))


def event_counters(spark, d):
    m = B.messages(spark, d)
    lag = S.lag_seconds("received_at", "published_at")
    return m.groupBy("source").agg(F.count("*").alias("n"), F.median(lag).alias("p50"), F.expr("percentile(timestampdiff(SECOND, published_at, received_at), 0.9)").alias("p90"), F.max(lag).alias("max"))


def index_status(spark, d):
    m = B.messages(spark, d)
    return m.agg(F.count("*").alias("indexed"), F.count_if(F.length("text") >= 40).alias("fingerprinted"), F.max("raw_message_id").alias("max_id"), (F.max("raw_message_id") - F.lit(100)).alias("backlog"))


_F, _P, _W = B.FACTS_SQL, B.PLACES_SQL, B.WORKED_SQL


def _bucket_sql(unit, src="facts", ts="observed_at"):
    b = f"date_trunc('hour', {ts})" if unit == "hour" else DAY_START.format(ts, unit)
    return f"SELECT {STAMP.format(b)} AS bucket, category, count(*) AS n FROM {src} GROUP BY 1, 2"


_TRACKS = "tracks AS (SELECT source_id, category, min(observed_at) AS first_seen_at FROM facts GROUP BY 1, 2)"
_REGION = "region_of AS (SELECT place_id, coalesce(parent_id, place_id) AS region FROM places)"
_ROUTES = f"""routes AS (SELECT a.region AS origin, b.region AS destination, count(*) AS n FROM facts JOIN region_of a ON a.place_id = facts.place_id
  JOIN region_of b ON b.place_id = dest_id WHERE a.region <> b.region GROUP BY 1, 2)"""
_LAG = "date_diff('second', received_at, processed_at)"
_FIRSTS = f"""seen AS (SELECT place_id, category, source_id, min(observed_at) AS first_at FROM facts GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY place_id, category ORDER BY first_at, source_id) AS r, min(first_at) OVER (PARTITION BY place_id, category) AS start FROM seen),
lagged AS (SELECT *, CASE WHEN r > 1 THEN CAST(trunc((epoch_us(first_at) - epoch_us(start)) / 1000000) AS DOUBLE) END AS lag FROM ranked)"""

SQL = {
    "facts_per_day": f"WITH {_F} {_bucket_sql('day')}",
    "facts_per_week": f"WITH {_F} {_bucket_sql('week')}",
    "facts_per_hour": f"WITH {_F} {_bucket_sql('hour')}",
    "tracks_per_day": f"WITH {_F}, {_TRACKS} {_bucket_sql('day', 'tracks', 'first_seen_at')}",
    "class_totals": f"""WITH {_F}, {_TRACKS} SELECT f.category, facts, objects, coalesce(tracks, 0) AS tracks FROM
      (SELECT category, count(*) AS facts, CAST(sum(object_count) AS BIGINT) AS objects FROM facts GROUP BY 1) f
      LEFT JOIN (SELECT category, count(*) AS tracks FROM tracks GROUP BY 1) t ON f.category IS NOT DISTINCT FROM t.category""",
    "facts_by_region": f"""WITH {_F}, {_P}, {_REGION}, c AS (SELECT region, count(*) AS n FROM (SELECT CASE WHEN k < 90 THEN place_id END AS p FROM facts) LEFT JOIN region_of ON place_id = p GROUP BY 1),
      r AS (SELECT *, row_number() OVER (ORDER BY n DESC, region) AS i FROM c WHERE region IS NOT NULL)
      SELECT CASE WHEN i <= 3 THEN CAST(region AS VARCHAR) ELSE 'other' END AS region, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1 UNION ALL SELECT 'unlocated', n FROM c WHERE region IS NULL""",
    "region_routes": f"WITH {_F}, {_P}, {_REGION}, {_ROUTES} SELECT * FROM routes ORDER BY n DESC, origin, destination LIMIT 400",
    "region_route_matrix": f"""WITH {_F}, {_P}, {_REGION}, {_ROUTES}, o AS (SELECT origin FROM routes GROUP BY 1 ORDER BY sum(n) DESC, 1 LIMIT 3),
      e AS (SELECT destination FROM routes GROUP BY 1 ORDER BY sum(n) DESC, 1 LIMIT 3)
      SELECT origin, destination, coalesce(n, 0) AS n FROM (SELECT * FROM o, e) LEFT JOIN routes USING (origin, destination)""",
    "hour_weekday_matrix": f"WITH {_F} SELECT CAST((dayofweek(t) + 6) % 7 AS INTEGER) AS weekday, CAST(hour(t) AS INTEGER) AS hour, count(*) AS n FROM (SELECT {LOCAL.format('observed_at')} AS t FROM facts) GROUP BY 1, 2",
    "fact_slices": f"""WITH {_F} SELECT 'category' AS slice, category AS value, count(*) AS n FROM facts GROUP BY 2
      UNION ALL SELECT 'place_id', CAST(place_id AS VARCHAR), count(*) FROM facts GROUP BY 2 UNION ALL SELECT 'dest_id', CAST(dest_id AS VARCHAR), count(*) FROM facts GROUP BY 2""",
    "source_statistics": f"""WITH {_W}, h AS (SELECT DISTINCT message_id FROM worked WHERE amount > 90000)
      SELECT source_id, count(*) AS messages, count(*) FILTER (WHERE status = 'F') AS processed, count(h.message_id) AS with_facts,
        quantile_cont(CAST({_LAG} AS DOUBLE), 0.5) FILTER (WHERE {_LAG} >= 0 AND {_LAG} < 86400 * 30) AS median_lag_s
      FROM worked LEFT JOIN h USING (message_id) GROUP BY 1""",
    "pipeline_rollup": f"""WITH {_W} SELECT CASE WHEN grouping(source_id) = 1 THEN -1 ELSE source_id END AS source_id, count(*) AS received, count(*) FILTER (WHERE status = 'F') AS processed,
        count(*) FILTER (WHERE status = 'O') AS pending, count(*) FILTER (WHERE status = 'P') AS in_progress, round(quantile_cont(amount, 0.5), 6) AS p50, round(quantile_cont(amount, 0.9), 6) AS p90,
        round(avg(amount), 6) AS mean FROM worked GROUP BY ROLLUP (source_id)""",
    "processed_per_bucket": f"WITH {_W} SELECT {STAMP.format("date_trunc('month', processed_at)")} AS bucket, count(*) AS processed, round(quantile_cont(amount, 0.5), 6) AS p50, round(quantile_cont(amount, 0.9), 6) AS p90 FROM worked WHERE status = 'F' GROUP BY 1",
    "queue_by_status": f"WITH {_W} SELECT status, count(*) AS n, count(DISTINCT message_id) AS messages FROM worked GROUP BY 1",
    "received_per_source_hour": f"""WITH {_F}, g AS (SELECT * FROM (SELECT DISTINCT place_id FROM facts), (SELECT CAST(range AS INTEGER) AS hour FROM range(24)))
      SELECT place_id, hour, count(fact_id) AS n FROM g LEFT JOIN (SELECT fact_id, place_id, CAST(hour(observed_at) AS INTEGER) AS hour FROM facts) USING (place_id, hour) GROUP BY 1, 2""",
    "dense_day_series": f"""WITH {_F}, days AS (SELECT timezone('UTC', timezone('Europe/Kyiv', CAST(range AS TIMESTAMP))) AS b FROM range(DATE '2024-01-01', DATE '2024-02-01', INTERVAL 1 DAY)),
      g AS (SELECT * FROM days, (SELECT DISTINCT category FROM facts)), f AS (SELECT {DAY_START.format('observed_at', 'day')} AS b, category FROM facts)
      SELECT {STAMP.format('g.b')} AS bucket, g.category, count(f.b) AS n FROM g LEFT JOIN f ON f.b = g.b AND f.category = g.category GROUP BY 1, 2""",
    "posts_and_edits": "SELECT role AS source, count(DISTINCT conv_id) AS posts, count(*) AS rows, count(*) - count(DISTINCT conv_id) AS edits FROM conversations GROUP BY 1",
    "delay_histogram": f"""WITH {_W} SELECT CAST(len(list_filter([0, 30, 60, 365, 1000], lambda e: {_LAG} >= e * 86400)) AS INTEGER) AS bin, count(*) AS n FROM worked WHERE processed_at IS NOT NULL GROUP BY 1""",
    "delay_details": f"WITH {_W} SELECT source_id, count(*) AS n, quantile_cont({_LAG} / 86400, 0.5) AS median, min({_LAG} / 86400) AS min, round(avg({_LAG} / 86400), 6) AS mean FROM worked GROUP BY 1",
    "first_reports": f"""WITH {_F}, {_FIRSTS} SELECT CAST(CAST({LOCAL.format('start')} AS DATE) AS VARCHAR) AS day, source_id, category, count(*) FILTER (WHERE r = 1) AS firsts, count(*) AS participations,
      coalesce(sum(lag), 0) AS lag_sum, count(lag) AS lag_count FROM lagged GROUP BY 1, 2, 3""",
    "first_reports_per_source": f"WITH {_F}, {_FIRSTS} SELECT source_id, count(*) FILTER (WHERE r = 1) AS firsts, count(*) AS participations, round(sum(lag) / count(lag), 3) AS mean_lag_s FROM lagged GROUP BY 1",
    "rolling_values": f"""WITH {_F}, w AS (SELECT time_bucket(INTERVAL 30 MINUTE, observed_at) - i * INTERVAL 30 MINUTE AS start, object_count FROM facts, (SELECT unnest([0, 1]) AS i))
      SELECT {STAMP.format('start')} AS start, count(*) AS samples, round(avg(object_count), 6) AS mean, quantile_disc(object_count, 0.5) AS p50, quantile_disc(object_count, 0.9) AS p90, max(object_count) AS max FROM w GROUP BY 1""",
    "source_health": f"""WITH {_F}, l AS (SELECT source_id, max(observed_at) AS last_at FROM facts GROUP BY 1)
      SELECT c_custkey AS source_id, {STAMP.format('last_at')} AS last_at, CASE WHEN last_at IS NULL THEN 'idle' WHEN date_diff('second', last_at, TIMESTAMP '2024-01-31') > 21600 THEN 'stale' ELSE 'ok' END AS state
      FROM customer LEFT JOIN l ON source_id = c_custkey""",
    "place_tree": """SELECT r_regionkey + 100 AS region_id, r_name AS region, '[' || coalesce(string_agg('{"place_id":' || n_nationkey || ',"name":"' || n_name || '"}', ',' ORDER BY n_nationkey), '') || ']' AS children
      FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2""",
    "event_counters": """SELECT source, count(*) AS n, quantile_cont(CAST(doc_id % 600 AS DOUBLE), 0.5) AS p50, quantile_cont(CAST(doc_id % 600 AS DOUBLE), 0.9) AS p90, CAST(max(doc_id % 600) AS DOUBLE) AS max
      FROM documents GROUP BY 1""",
    "index_status": "SELECT count(*) AS indexed, count(*) FILTER (WHERE length(text) >= 40) AS fingerprinted, max(doc_id) AS max_id, max(doc_id) - 100 AS backlog FROM documents",
}

QUERIES = {name: globals()[name] for name in SQL}
