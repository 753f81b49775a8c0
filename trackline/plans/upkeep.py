"""Queries on display rows, routes, periods, counters kept by batches, and model answers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trackline.functions import calendar as C
from trackline.operators import answers as Q
from trackline.operators import decorate as D
from trackline.operators import ratings
from trackline.operators.components import shared_dir, written
from trackline.plans import graphs, understanding
from trackline.sources import bindings as B
from trackline.streaming import counters

NOW = "2024-01-30 12:00:00"


def message_routes(spark, d):
    """Conversation turns as messages: some structured, some without anything to read."""
    c = B.table(spark, d, "conversations")
    kind = F.when(F.col("turn") % 7 == 1, "alert.started").when(F.col("turn") % 7 == 2, "alert.finished").when(F.col("turn") % 7 == 3, "other")
    text = F.when(F.col("conv_id") % 4 == 0, F.lit(" \n\t ")).when(F.col("conv_id") % 4 != 1, F.col("text"))
    return c.groupBy("role", D.route(kind, text).alias("route")).agg(F.count("*").alias("n"))


def fact_tracks(spark, d):
    """Parts as facts and orders as the tracks that hold them."""
    return D.fact_tracks(B.table(spark, d, "lineitem").select(F.col("l_partkey").alias("fact_id"), F.col("l_orderkey").alias("track_id")))


def _leveled(spark, d):
    return B.places(spark, d).withColumns({"level": F.when(F.col("place_id") >= 100, "region").when(F.col("place_id") % 3 == 0, "city").otherwise("town"), "parent_id": F.when(F.col("place_id") % 6 != 0, F.col("parent_id"))})


def region_level_facts(spark, d):
    """Facts of places at region level: regions, and cities in none."""
    p = D.region_level(_leveled(spark, d)).select("place_id", "name")
    return B.facts(spark, d).join(p, "place_id").groupBy("place_id", "name").agg(F.count("*").alias("n"))


def decorated_facts(spark, d):
    """Facts with the label of their deepest known type, their place and its region, and a whole direction."""
    k = F.col("k")
    f = B.facts(spark, d).select("fact_id", "place_id", F.when(k % 3 == 0, k % 11).alias("model_id"), F.when(k % 2 == 0, k % 25).alias("class_id"), (k % 7).alias("category_id"), F.when(k % 4 != 0, k * 3.625).alias("direction_deg"))
    f = f.withColumn("place_id", F.when(F.col("fact_id") % 6 == 0, F.col("place_id") % 5 + 100).otherwise(F.col("place_id")))
    nation, region = B.table(spark, d, "nation"), B.table(spark, d, "region")
    models = B.table(spark, d, "supplier").filter("s_suppkey < 8").select(F.col("s_suppkey").cast("int").alias("id"), F.col("s_name").alias("name"))
    dims = {"model_id": models, "class_id": nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), "category_id": region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))}
    p = B.places(spark, d).select("place_id", "name", F.coalesce("parent_id", "place_id").alias("region_id"))
    r = D.placed(D.labelled(f, dims), p)
    return r.select("fact_id", "label", "place_name", "region_id", "region_name", "direction_deg")


def family_nodes(spark, d):
    """The nodes of each source's link family, with place and category."""
    p = B.places(spark, d).select("place_id", F.col("name").alias("place_name"), F.when(F.col("place_id") % 10 != 0, F.col("lon")).alias("fix_lon"))
    f = B.facts(spark, d).join(p, "place_id").select("fact_id", "place_name", "fix_lon", "category")
    return D.family_nodes(graphs.link_families(spark, d), f).select("head", "fact_id", "generation", "ancestral", "place_name", "category")


def sources_with_counts(spark, d):
    """All sources with the number of their messages, none included."""
    n = B.table(spark, d, "nation").select(F.col("n_nationkey").alias("source_id"), F.col("n_name").alias("name"))
    m = B.facts(spark, d).filter("source_id % 3 <> 0").groupBy("source_id").agg(F.count("*").alias("n"))
    return n.join(m, "source_id", "left").select("source_id", "name", F.coalesce("n", F.lit(0)).alias("messages"))


def home_regions(spark, d):
    """Suppliers as sources, whose config names a place, states an id, or says nothing of use."""
    i = F.col("s_suppkey")
    s = B.table(spark, d, "supplier").join(B.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    config = F.when(i % 5 == 0, F.concat(F.lit('{"homeRegionPlaceId": '), 100 + i % 5, F.lit(', "homeRegion": "x"}'))).when(i % 5 == 1, F.concat(F.lit('{"homeRegion": "  '), F.lower("n_name"), F.lit(' "}')))
    config = config.when(i % 5 == 2, F.lit('{"homeRegionPlaceId": "7", "homeRegion": "nowhere"}')).when(i % 5 == 3, F.lit('{"homeRegion": '))
    p = B.places(spark, d)
    return D.home_regions(s.select(i.alias("source_id"), config.alias("config")), p.select("name", "place_id"), p.select("place_id", F.col("parent_id").alias("region_id"))).select("source_id", F.col("home_region").cast("long").alias("home_region"))


def preset_periods(spark, d):
    """Facts by the preset day that a viewer at their time would ask for."""
    start, end = C.preset(F.col("observed_at"), 24)
    return B.facts(spark, d).groupBy(C.stamp(start).alias("start"), C.stamp(end).alias("end")).agg(F.count("*").alias("n"))


def source_days_by_batch(spark, d):
    """Daily counters of sources, kept in four batches: facts without repeats, then their repeats, the later half first."""
    f = B.facts(spark, d)
    repeats = written(graphs.copies_with_ids(spark, d).select("fact_id", F.col("o").alias("duplicate_of")), "repeats")
    half = F.expr("timestamp_ntz'2024-01-16 00:00:00'")
    plain = f.select("fact_id", "source_id", "observed_at", F.lit(None).cast("long").alias("duplicate_of"), F.lit(1).cast("long").alias("seq"))
    marked = f.join(repeats, "fact_id").select("fact_id", "source_id", "observed_at", "duplicate_of", F.lit(2).cast("long").alias("seq"))
    folder = f"{shared_dir(spark)}/counters-{uuid.uuid4().hex}"
    batches = [rows.filter(when) for rows in (marked, plain) for when in (F.col("observed_at") >= half, F.col("observed_at") < half)]
    for n, rows in enumerate(batches):
        counters.count(rows, n, folder)
    r = counters.daily(spark, folder)
    return r.select(F.col("day").cast("string").alias("day"), F.col("source_id").cast("long").alias("source_id"), "facts", "copies", "copied_by", "lead_s", ratings.rating(F.col("facts"), F.col("copies"), F.col("copied_by")).alias("rating"))


def _answers(spark, d):
    """An answer for each order: some cut off, some with parts of the wrong type, codes and places known and unknown."""
    i = F.col("o_orderkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    event = F.get(F.array(*map(F.lit, ("TargetObserved", "air_raid_alert", "Nonsense", "ExplosionReport"))), (i % 4).cast("int"))
    first = text('{"event_type": "', event, '", "target": {"level": "', F.when(i % 3 == 0, "Model").otherwise("class"), '", "code": "C', i % 9, '"}, "direction_deg": ', F.when(i % 10 == 0, '"north"').otherwise((i % 720 - 360).cast("string")), ', "hedged": ', F.when(i % 2 == 0, "true").otherwise("null"), ', "count": ', i % 6, ', "segment": ', i % 5, ', "places": [{"name": "', F.col("o_orderpriority"), '", "role": "destination"}, {"name": " 1-urgent", "role": "Origin"}]}')
    second = F.when(i % 6 == 0, ', {"event_type": "AlertCancelled"}, {"event_type": "TargetObserved"}, 7').otherwise("")
    whole = text('{"facts": [', first, second, "]}")
    answer = F.when(i % 7 == 0, F.substring(whole, 1, 40)).when(i % 11 == 0, F.lit('{"facts": null}')).otherwise(whole)
    return B.table(spark, d, "orders").select(i.alias("message_id"), answer.alias("answer"))


def model_answers(spark, d):
    codes = spark.range(6).select(F.when(F.col("id") % 2 == 0, "class").otherwise("model").alias("level"), F.concat(F.lit("c"), "id").alias("code"), (F.col("id") + 50).alias("target_id"))
    names = B.table(spark, d, "orders").select(F.col("o_orderpriority").alias("name")).distinct().filter("name <> '5-LOW'").select("name", F.left("name", F.lit(1)).cast("long").alias("place_id"))
    r = Q.mapped(_answers(spark, d), codes, names, B.table(spark, d, "orders").select(F.col("o_orderkey").alias("message_id"), F.lit(3).alias("n")))
    return r.select("message_id", F.col("fact").cast("int").alias("fact"), "event", "target_id", "confidence", "hedged", "count", "direction_deg", "segment", "origin", "destination", "unknown_codes", "unknown_places")


def second_looks(spark, d):
    """Facts' words as messages of the last three hours that tell of launches or defence and gave no fact."""
    m = understanding.spoken(spark, d).join(B.facts(spark, d).select("fact_id", "observed_at"), "fact_id").select(F.col("fact_id").alias("message_id"), "tokens", F.col("observed_at").alias("published_at"))
    r = Q.second_look(m, m.filter("message_id % 4 = 0"), ["пуск", "ппо", "загроз"], F.expr(f"timestamp_ntz'{NOW}'"), 72)
    return r.select("message_id")


_F, _P = B.FACTS_SQL, B.PLACES_SQL
_KEPT = """kept AS (SELECT fact_id, f.source_id, observed_at, o AS duplicate_of, osrc, oat FROM facts f LEFT JOIN (SELECT c.fact_id AS cid, arg_min(o.fact_id, (o.observed_at, o.fact_id)) AS o, arg_min(o.source_id, (o.observed_at, o.fact_id)) AS osrc, min(o.observed_at) AS oat
    FROM facts c JOIN facts o ON o.place_id = c.place_id AND o.category = c.category AND o.observed_at < c.observed_at AND o.observed_at >= c.observed_at - INTERVAL 1 HOUR AND o.source_id <> c.source_id GROUP BY 1) ON cid = fact_id)"""
_DAY = "CAST(CAST(timezone('Europe/Kyiv', timezone('UTC', {0})) AS DATE) AS VARCHAR)"

SQL = {
    "message_routes": r"""SELECT role, CASE WHEN turn % 7 IN (1, 2) THEN 'structured' WHEN conv_id % 4 > 1 AND trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) <> '' THEN 'text' ELSE 'skipped' END AS route, count(*) AS n FROM conversations GROUP BY 1, 2""",
    "fact_tracks": "SELECT l_partkey AS fact_id, min(l_orderkey) AS track_id FROM lineitem GROUP BY 1",
    "region_level_facts": f"WITH {_F}, {_P} SELECT place_id, name, count(*) AS n FROM facts JOIN places USING (place_id) WHERE place_id % 6 = 0 GROUP BY 1, 2",
    "decorated_facts": f"""WITH {_F}, {_P}, f AS (SELECT fact_id, k, CASE WHEN fact_id % 6 = 0 THEN place_id % 5 + 100 ELSE place_id END AS place_id FROM facts),
      x AS (SELECT k * 3.625::DOUBLE AS v, * FROM f)
      SELECT fact_id, coalesce(s_name, n_name, r_name, 'unknown') AS label, p.name AS place_name, coalesce(p.parent_id, p.place_id) AS region_id, q.name AS region_name,
        CASE WHEN k % 4 <> 0 THEN CASE WHEN v - floor(v) = 0.5 THEN floor(v) + floor(v) % 2 ELSE round(v) END END AS direction_deg
      FROM x LEFT JOIN supplier ON s_suppkey < 8 AND k % 3 = 0 AND s_suppkey = k % 11 LEFT JOIN nation ON k % 2 = 0 AND n_nationkey = k % 25 LEFT JOIN region ON r_regionkey = k % 7
      JOIN places p ON p.place_id = x.place_id LEFT JOIN places q ON q.place_id = p.parent_id""",
    "family_nodes": f"""WITH fam AS ({graphs.SQL['link_families']}), {_F.replace('facts AS', 'fx AS')}, {_P}, r AS (SELECT head, fact_id, generation, relative FROM fam UNION SELECT head, head, 0, false FROM fam),
      x AS (SELECT head, fact_id, arg_min(generation, (relative, generation)) AS generation, NOT min(relative) AS ancestral FROM r GROUP BY 1, 2)
      SELECT x.head, x.fact_id, generation, ancestral, name AS place_name, category FROM x JOIN fx ON fx.fact_id = x.fact_id JOIN places p ON p.place_id = fx.place_id WHERE p.place_id % 10 <> 0""",
    "sources_with_counts": f"WITH {_F} SELECT n_nationkey AS source_id, n_name AS name, count(fact_id) AS messages FROM nation LEFT JOIN facts ON source_id = n_nationkey AND source_id % 3 <> 0 GROUP BY 1, 2",
    "home_regions": "SELECT s_suppkey AS source_id, CAST(CASE s_suppkey % 5 WHEN 0 THEN 100 + s_suppkey % 5 WHEN 1 THEN n_regionkey + 100 END AS BIGINT) AS home_region FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "preset_periods": f"WITH {_F}, t AS (SELECT time_bucket(INTERVAL 5 MINUTE, observed_at) AS e FROM facts) SELECT strftime(e - INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS start, strftime(e, '%Y-%m-%d %H:%M:%S') AS \"end\", count(*) AS n FROM t GROUP BY 1, 2",
    "source_days_by_batch": f"""WITH {_F}, {_KEPT}, t AS (SELECT {_DAY.format('observed_at')} AS day, source_id, count(*) AS facts, count(duplicate_of) AS copies FROM kept GROUP BY 1, 2),
      g AS (SELECT {_DAY.format('oat')} AS day, osrc AS source_id, count(*) AS copied_by, sum(greatest(0, trunc((epoch_us(observed_at) - epoch_us(oat)) / 1e6))) AS lead_s FROM kept WHERE duplicate_of IS NOT NULL GROUP BY 1, 2)
      SELECT day, CAST(source_id AS BIGINT) AS source_id, coalesce(facts, 0) AS facts, coalesce(copies, 0) AS copies, coalesce(copied_by, 0) AS copied_by, coalesce(lead_s, 0)::DOUBLE AS lead_s,
        CASE WHEN facts > 0 THEN round(0.7 * (1 - copies / facts) + 0.3 * least(1.0, coalesce(copied_by, 0) / facts), 3) END AS rating FROM t FULL JOIN g USING (day, source_id)""",
    "model_answers": """WITH a AS (SELECT o_orderkey AS i, o_orderpriority AS p FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0),
      f AS (SELECT i, p, 0 AS fact, ['target_observed', 'air_raid_alert', 'unknown', 'explosion'][i % 4 + 1] AS e, CASE WHEN i % 3 = 0 THEN 'model' ELSE 'class' END AS level, i % 9 AS c FROM a
        UNION ALL SELECT i, NULL, 1, 'alert_cancelled', NULL, NULL FROM a WHERE i % 6 = 0),
      t AS (SELECT *, CASE WHEN c < 6 AND (c % 2 = 0) = (level = 'class') THEN c + 50 END AS target FROM f)
      SELECT i AS message_id, fact, CASE WHEN e = 'unknown' THEN 'target_observed' ELSE e END AS event, CAST(target AS BIGINT) AS target_id, CASE WHEN target IS NOT NULL THEN CASE WHEN level = 'model' THEN 2 ELSE 1 END END AS confidence,
        fact = 0 AND i % 2 = 0 AS hedged, CASE WHEN fact = 0 THEN CAST(i % 6 AS INTEGER) END AS count, CASE WHEN fact = 0 AND i % 10 <> 0 THEN ((i % 720 - 360 + 720) % 360)::DOUBLE END AS direction_deg,
        CASE WHEN fact = 0 THEN CAST(least(i % 5, 2) AS INTEGER) ELSE 0 END AS segment, CASE WHEN fact = 0 THEN 1::BIGINT END AS origin, CASE WHEN p <> '5-LOW' THEN CAST(left(p, 1) AS BIGINT) END AS destination,
        CAST(c IS NOT NULL AND target IS NULL AS INTEGER) AS unknown_codes, CAST(coalesce(p = '5-LOW', false) AS BIGINT) AS unknown_places
      FROM t WHERE target IS NOT NULL OR e NOT IN ('unknown', 'target_observed')""",
    "second_looks": f"""WITH {_F}, {understanding._TOKENS} SELECT DISTINCT fact_id AS message_id FROM tok JOIN facts USING (fact_id) WHERE fact_id % 4 <> 0 AND observed_at >= TIMESTAMP '{NOW}' - INTERVAL 72 HOUR
      AND (starts_with(w, 'пуск') OR starts_with(w, 'ппо') OR starts_with(w, 'загроз'))""",
}

QUERIES = {name: globals()[name] for name in SQL}
