"""Queries on repeats, ratings, links and copies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackline.operators import copies, dedup, links, ratings
from trackline.operators import snapshot as N
from trackline.sources import bindings as B


def who_copies_whom(spark, d):
    """Flagship: messages copied from another source within six hours, per pair of sources."""
    r = copies.pair_report(copies.who_copies_whom(B.messages(spark, d)))
    return r.withColumns({c: F.round(c, 4) for c in ("mean_delay_s", "median_delay_s", "min_delay_s", "mean_jaccard")})


def message_pairs(spark, d):
    r = copies.who_copies_whom(B.messages(spark, d))
    return r.select("copy", "copy_source", "original", "original_source", "kind", "delay_s", F.round("jaccard", 6).alias("jaccard"), F.round("containment", 6).alias("containment"), "is_primary")


def _repeatable(spark, d):
    f = B.facts(spark, d)
    return f.select("fact_id", F.col("fact_id").alias("raw_message_id"), F.lit(1).alias("event_type"), "category", F.lit(None).cast("int").alias("class_id"), "place_id", F.lit(None).cast("int").alias("dest_id"), "observed_at", "source_id")


def fact_repeats(spark, d):
    return dedup.mark_repeats(_repeatable(spark, d), 30).select("fact_id", "duplicate_of")


def copies_with_ids(spark, d):
    """Each repeated fact with the earliest fact of another source that it repeats."""
    r = copies.earliest_told(B.facts(spark, d), ["place_id", "category"], [])
    return r.select(F.col("copy").alias("fact_id"), "copy_source", "copy_at", "x.original_at", F.col("x.original").alias("o"), "x.original_source")


def _copies_of_facts(spark, d):
    return copies_with_ids(spark, d).select("copy_source", "copy_at", "original_source", "original_at")


def source_days(spark, d):
    r = ratings.daily_stats(B.facts(spark, d), _copies_of_facts(spark, d))
    return r.withColumn("rating", ratings.rating(F.col("facts"), F.col("copies"), F.col("copied_by"))).withColumn("day", F.col("day").cast("string"))


def source_ratings(spark, d):
    return ratings.over_days(ratings.daily_stats(B.facts(spark, d), _copies_of_facts(spark, d)))


def source_copy_pairs(spark, d):
    return ratings.copy_pairs(_copies_of_facts(spark, d))


def source_groups(spark, d):
    f = B.facts(spark, d)
    return ratings.source_groups(ratings.copy_pairs(_copies_of_facts(spark, d)), f.groupBy("source_id").agg(F.count("*").alias("facts")), 2, 0.02)


def _linkable(spark, d):
    p = B.places(spark, d).select("place_id", "lon", "lat")
    f = B.facts(spark, d).join(F.broadcast(p), "place_id")
    none = F.lit(None).cast("int")
    return f.select("fact_id", F.col("fact_id").alias("raw_message_id"), "category", "observed_at", (F.lit(10) + F.length("category")).alias("win_min"), F.lit(200.0).alias("v_max"), F.lit(175.0).alias("v_cruise"), "lon", "lat", F.lit(40.0).alias("slack_km"),
        F.when(F.col("k") % 2 == 0, (F.col("k") * 3.6)).alias("direction_deg"), "place_id", "dest_id", none.alias("model_id"), none.alias("family_id"), (F.col("k") % 4).alias("class_id"))


def link_weights(spark, d):
    w = links.select_top(links.weighted(links.candidate_pairs(_linkable(spark, d), 120)))
    return w.select("from_id", "to_id", "probability", F.round("gap_km", 3).alias("gap_km"), F.round("dt", 3).alias("dt"))


def fact_links(spark, d):
    return links.link(_linkable(spark, d)).select("from_id", "to_id", F.round("probability", 3).alias("probability"))


def _edges(spark, d):
    """A plain edge table: from each fact to the next two of its place, with fixed probabilities."""
    w = Window.partitionBy("place_id").orderBy("observed_at", "fact_id")
    f = B.facts(spark, d).select(F.col("fact_id").alias("from_id"), F.lead("fact_id", 1).over(w).alias("one"), F.lead("fact_id", 2).over(w).alias("two"))
    nexts = F.array(F.struct(F.col("one").alias("to_id"), F.lit(0.5).alias("probability")), F.struct(F.col("two").alias("to_id"), F.lit(0.25).alias("probability")))
    f = f.select("from_id", F.explode(nexts).alias("x"))
    return f.select("from_id", "x.*").filter("to_id is not null")


def _heads(spark, d):
    return N.newest(B.facts(spark, d), ["source_id"], [F.desc("observed_at"), F.desc("fact_id")]).select("fact_id")


def best_chains(spark, d):
    return links.best_chains(_edges(spark, d), _heads(spark, d), 6)


def link_predecessors(spark, d):
    p = links.predecessors(_edges(spark, d), _heads(spark, d), 3)
    return p.groupBy("head", "fact_id").agg(F.min("generation").alias("generation"), F.round(F.max("path"), 6).alias("path"))


def link_families(spark, d):
    f = links.family(_edges(spark, d), _heads(spark, d), 2)
    return f.select("head", "fact_id", "generation", F.round("path", 6).alias("path"), "relative")


def links_both_ways(spark, d):
    return links.links_of(_edges(spark, d), _heads(spark, d))


def kept_messages(spark, d):
    """Messages kept by an insert that is unique on the conversation and turn, and on the content."""
    c = B.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("arrival"), F.concat_ws("/", F.col("conv_id") % 50, "turn").alias("key"), "role", "text")
    c = dedup.content_hash(c.withColumn("payload", F.lit(None).cast("string")), "role", "text", "payload")
    return dedup.idempotent(c).select("arrival", "key", "hash")


_F, _P = B.FACTS_SQL, B.PLACES_SQL
_R = """repeats AS (SELECT c.source_id AS copy_source, c.observed_at AS copy_at, arg_min(o.source_id, (o.observed_at, o.fact_id)) AS original_source, min(o.observed_at) AS original_at
  FROM facts c JOIN facts o ON o.place_id = c.place_id AND o.category = c.category AND o.observed_at < c.observed_at AND o.observed_at >= c.observed_at - INTERVAL 1 HOUR AND o.source_id <> c.source_id
  GROUP BY c.fact_id, c.source_id, c.observed_at),
rep AS (SELECT *, CAST(trunc((epoch_us(copy_at) - epoch_us(original_at)) / 1e6) AS DOUBLE) AS lead_time, CAST(timezone('Europe/Kyiv', timezone('UTC', copy_at)) AS DATE) AS day FROM repeats)"""
_D = """days AS (SELECT coalesce(f.day, m.day, g.day) AS day, coalesce(f.source_id, m.source_id, g.source_id) AS source_id, coalesce(f.n, 0) AS facts, coalesce(m.n, 0) AS copies, coalesce(g.n, 0) AS copied_by,
    coalesce(g.s, 0) AS lead_s FROM (SELECT CAST(timezone('Europe/Kyiv', timezone('UTC', observed_at)) AS DATE) AS day, source_id, count(*) AS n FROM facts GROUP BY 1, 2) f
  FULL JOIN (SELECT day, copy_source AS source_id, count(*) AS n FROM rep GROUP BY 1, 2) m ON m.day = f.day AND m.source_id = f.source_id
  FULL JOIN (SELECT CAST(timezone('Europe/Kyiv', timezone('UTC', original_at)) AS DATE) AS day, original_source AS source_id, count(*) AS n, sum(greatest(0, lead_time)) AS s FROM rep GROUP BY 1, 2) g ON g.day = coalesce(f.day, m.day) AND g.source_id = coalesce(f.source_id, m.source_id)),
rated AS (SELECT *, CASE WHEN facts > 0 THEN round(0.7 * (1 - copies / facts) + 0.3 * least(1.0, copied_by / facts), 3) END AS rating FROM days)"""
_E = """edges AS (SELECT * FROM (SELECT fact_id AS from_id, lead(fact_id, 1) OVER w AS to_id, 0.5::DOUBLE AS probability FROM facts WINDOW w AS (PARTITION BY place_id ORDER BY observed_at, fact_id)
  UNION ALL SELECT fact_id, lead(fact_id, 2) OVER w, 0.25 FROM facts WINDOW w AS (PARTITION BY place_id ORDER BY observed_at, fact_id)) WHERE to_id IS NOT NULL),
heads AS (SELECT arg_max(fact_id, (observed_at, fact_id)) AS head FROM facts GROUP BY source_id)"""
_WALK = """walk AS (SELECT head, head AS fact_id, 0 AS generation, 1.0::DOUBLE AS path FROM heads
  UNION ALL SELECT head, from_id, generation + 1, path * probability FROM walk JOIN edges ON to_id = fact_id WHERE generation < {0})"""

SQL = {
    "source_days": f"WITH {_F}, {_R}, {_D} SELECT CAST(day AS VARCHAR) AS day, source_id, facts, copies, copied_by, lead_s, rating FROM rated",
    "source_ratings": f"""WITH {_F}, {_R}, {_D} SELECT source_id, CAST(sum(facts) AS BIGINT) AS facts, CAST(sum(copies) AS BIGINT) AS copies, CAST(sum(copied_by) AS BIGINT) AS copied_by,
      round(sum(rating * facts) / sum(facts), 9) AS rating FROM rated GROUP BY 1""",
    "source_copy_pairs": f"WITH {_F}, {_R} SELECT copy_source, original_source, count(*) AS n, round(avg(lead_time), 3) AS mean_delay_s FROM rep GROUP BY 1, 2",
    "source_groups": f"""WITH RECURSIVE {_F}, {_R}, tot AS (SELECT source_id, count(*) AS facts FROM facts GROUP BY 1),
      strong AS (SELECT copy_source AS a, original_source AS b FROM rep JOIN tot ON source_id = copy_source GROUP BY 1, 2, facts HAVING count(*) >= 2 AND count(*) >= 0.02 * facts),
      tied AS (SELECT a, b FROM strong UNION SELECT b, a FROM strong), reach AS (SELECT a AS node, a AS r FROM tied UNION SELECT node, b FROM reach JOIN tied ON a = r)
      SELECT node AS source_id, min(r) AS group_id FROM reach GROUP BY 1""",
    "best_chains": f"""WITH RECURSIVE {_F}, {_E}, best AS (SELECT to_id, arg_max(from_id, (probability, from_id)) AS prev FROM edges GROUP BY 1),
      chain AS (SELECT head, 0 AS step, head AS fact_id FROM heads UNION ALL SELECT head, step + 1, prev FROM chain JOIN best ON to_id = fact_id WHERE step < 6) SELECT * FROM chain""",
    "link_predecessors": f"WITH RECURSIVE {_F}, {_E}, {_WALK.format(3)} SELECT head, fact_id, min(generation) AS generation, round(max(path), 6) AS path FROM walk WHERE generation > 0 GROUP BY 1, 2",
    "link_families": f"""WITH RECURSIVE {_F}, {_E}, {_WALK.format(2)}, up AS (SELECT head, fact_id, min(generation) AS generation, max(path) AS path FROM walk WHERE generation > 0 GROUP BY 1, 2),
      down AS (SELECT head, fact_id, generation, path, 0 AS depth FROM up UNION ALL SELECT d.head, to_id, d.generation - 1, d.path * probability, depth + 1 FROM down d JOIN edges ON from_id = d.fact_id
        WHERE depth < 2 AND d.generation >= 1 AND d.path * probability >= 0.02 AND to_id <> d.head)
      SELECT head, fact_id, generation, round(path, 6) AS path, false AS relative FROM up
      UNION ALL SELECT head, fact_id, min(generation), round(max(path), 6), true FROM down d WHERE depth > 0 AND NOT EXISTS (SELECT 1 FROM up u WHERE u.head = d.head AND u.fact_id = d.fact_id) GROUP BY 1, 2""",
    "links_both_ways": f"""WITH {_F}, {_E} SELECT from_id AS fact_id, to_id AS other, true AS outgoing, probability FROM edges WHERE from_id IN (SELECT head FROM heads)
      UNION ALL SELECT to_id, from_id, false, probability FROM edges WHERE to_id IN (SELECT head FROM heads)""",
}
SQL["fact_repeats"] = f"""WITH RECURSIVE {_F}, f AS (SELECT fact_id, place_id, category, row_number() OVER (PARTITION BY place_id, category ORDER BY observed_at, fact_id) AS rn,
    count(*) OVER (PARTITION BY place_id, category ORDER BY observed_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 30 MINUTE FOLLOWING) + 1 AS nxt FROM facts),
  o AS (SELECT place_id, category, rn, nxt, fact_id FROM f WHERE rn = 1 UNION ALL SELECT f.place_id, f.category, f.rn, f.nxt, f.fact_id FROM o JOIN f ON f.place_id = o.place_id AND f.category = o.category AND f.rn = o.nxt),
  m AS (SELECT f.fact_id, last_value(o.fact_id IGNORE NULLS) OVER (PARTITION BY f.place_id, f.category ORDER BY f.rn) AS orig FROM f LEFT JOIN o ON o.fact_id = f.fact_id)
  SELECT fact_id, CASE WHEN orig <> fact_id THEN orig END AS duplicate_of FROM m"""
SQL["link_weights"] = f"""WITH {_F}, {_P}, l AS (SELECT fact_id, category, observed_at, 10 + length(category) AS win, lon, lat, CASE WHEN k % 2 = 0 THEN k * 3.6::DOUBLE END AS dir, place_id, dest_id, k % 4 AS class_id FROM facts JOIN places USING (place_id)),
  p AS (SELECT c.fact_id AS from_id, n.fact_id AS to_id, (epoch_us(n.observed_at) - epoch_us(c.observed_at)) / 6e7 AS dt, n.class_id = c.class_id AS same_class, c.dir AS dir,
    n.place_id IN (c.place_id, c.dest_id) OR n.dest_id IN (c.place_id, c.dest_id) AS same_place,
    2 * 6371.0088 * asin(least(1.0, sqrt(power(sin(radians(n.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(n.lat)) * power(sin(radians(n.lon - c.lon) / 2), 2)))) AS km,
    degrees(atan2(sin(radians(n.lon - c.lon)) * cos(radians(n.lat)), cos(radians(c.lat)) * sin(radians(n.lat)) - sin(radians(c.lat)) * cos(radians(n.lat)) * cos(radians(n.lon - c.lon)))) AS bearing
    FROM l n JOIN l c ON c.category = n.category AND c.observed_at < n.observed_at AND c.observed_at >= n.observed_at - n.win * INTERVAL 1 MINUTE),
  g AS (SELECT *, greatest(0, km - 80) AS gap FROM p),
  t AS (SELECT *, CASE WHEN dir IS NOT NULL AND gap > 10 THEN abs(fmod(bearing - dir + 1260, 360) - 180) END AS theta FROM g),
  x AS (SELECT *, coalesce(theta, 0) / 180 * 4 AS turn, gap / 175 * 60 + coalesce(theta, 0) / 180 * 4 AS need, CASE WHEN same_place THEN 20 WHEN gap <= 10 THEN 10 ELSE 0 END AS dwell FROM t),
  w AS (SELECT *, CASE WHEN dt + 3 < gap / 200 * 60 + turn THEN 0 WHEN dt - need - dwell <= 0 THEN 1 ELSE exp(-(dt - need - dwell) / 20) END / (1 + km / 60)
    * CASE WHEN gap <= 10 THEN 1 WHEN theta IS NULL THEN 0.6 ELSE greatest(0.05, (1 + cos(radians(theta))) / 2) END * CASE WHEN same_class THEN 0.85 ELSE 0.3 END AS weight FROM x),
  b AS (SELECT *, max(weight) OVER (PARTITION BY to_id) AS best FROM w WHERE weight > 0),
  i AS (SELECT *, row_number() OVER (PARTITION BY to_id ORDER BY weight DESC, from_id) AS i FROM b WHERE weight >= 0.1 AND weight >= 0.5 * best),
  s AS (SELECT *, sum(weight) OVER (PARTITION BY to_id) AS total FROM i WHERE i <= 3)
  SELECT from_id, to_id, round(weight / greatest(total, 1.0), 3) AS probability, round(gap, 3) AS gap_km, round(dt, 3) AS dt FROM s"""

QUERIES = {f.__name__: f for f in (who_copies_whom, message_pairs, fact_repeats, source_days, source_ratings, source_copy_pairs, source_groups, link_weights, fact_links, best_chains, link_predecessors, link_families, links_both_ways, kept_messages)}
