"""Queries on polygons and administrative units: what holds a point, whom a settlement belongs to, what a feed's names mean."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackline.operators import admin as A
from trackline.operators import regions as R
from trackline.sources import bindings as B

#: Directions of the corners of a generated outline; their lengths follow from the nation's number and the corner's.
CORNERS = ((10, 0), (7, 7), (0, 10), (-7, 7), (-10, 0), (-7, -7), (0, -10), (7, -7))


def polygons(spark, d):
    """polygon_id, level, rings: an outline for each nation, smaller for every fourth, which are cities; even ones have a hole
    and an island."""
    p = B.places(spark, d).filter("parent_id is not null").select(F.col("place_id").alias("polygon_id"), "lon", "lat")
    n, city = F.col("polygon_id"), F.col("polygon_id") % 4 == 0
    scale = F.when(city, F.lit(256.0)).otherwise(F.lit(64.0))
    corner = lambda x, y, at=0.0: F.struct((F.col("lon") + x).alias("lon"), (F.col("lat") + y + at).alias("lat"))
    outline = F.array(*[corner(x * (6 + (n * 7 + k * 3) % 5) / scale, y * (6 + (n * 7 + k * 3) % 5) / scale) for k, (x, y) in enumerate(CORNERS)])
    diamond = [F.array(*[corner(F.lit(x / 80), F.lit(y / 80), at) for x, y in CORNERS[::2]]) for at in (0.0, 2.0)]
    rings = F.when(n % 2 == 0, F.array(outline, *diamond)).otherwise(F.array(outline))
    return p.select("polygon_id", F.when(city, "city").otherwise("region").alias("level"), rings.alias("rings"))


def _points(spark, d):
    """A point for each fact, spread over the grid of places and a little beyond."""
    i = F.col("fact_id")
    return B.facts(spark, d).select(i.alias("point_id"), (23.0 + (i * 7919) % 14000 / 1000).alias("lon"), (45.5 + (i * 104729) % 8000 / 1000).alias("lat"))


def polygons_at_facts(spark, d):
    """The polygon of each level that a fact's point lies in."""
    return R.polygon_at(_points(spark, d), polygons(spark, d)).select(F.col("point_id").alias("fact_id"), "level", "polygon_id")


def spatial_parents(spark, d):
    """The city that holds a point, else the region, else the nearest region within 0.05 degrees."""
    r = R.spatial_parents(_points(spark, d), polygons(spark, d), ["city", "region"], "region", 0.05)
    return r.select(F.col("point_id").alias("fact_id"), F.col("parent_id").cast("int").alias("parent_id"))


def nearest_polygons(spark, d):
    """The polygon whose edge is nearest to a point, up to half a degree away."""
    r = R.nearest(_points(spark, d), polygons(spark, d), 0.5)
    return r.select(F.col("point_id").alias("fact_id"), "polygon_id", F.round("degrees", 9).alias("degrees"))


def _units(spark, d):
    """Nations as districts, suppliers as communities of thirty names in all regions, so that many have namesakes."""
    nation = B.table(spark, d, "nation")
    district = nation.select((1000 + F.col("n_nationkey")).alias("place_id"), F.lit("district").alias("level"), F.concat(F.initcap("n_name"), F.lit(" район")).alias("name"), (F.col("n_regionkey") + 100).alias("region_id"))
    s = B.table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    community = s.select((10000 + F.col("s_suppkey")).alias("place_id"), F.lit("hromada").alias("level"), F.concat(F.lit("Name"), F.col("s_suppkey") * 7 % 30, F.lit("  територіальна Громада")).alias("name"), (F.col("n_regionkey") + 100).alias("region_id"))
    return district.unionByName(community)


def _settlements(spark, d):
    c = B.table(spark, d, "customer").join(B.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    i = F.col("c_custkey")
    return c.select((100000 + i).alias("place_id"), F.concat(F.lit("Town’"), i % 90).alias("name"), (F.col("n_regionkey") + 100).alias("region_id"), F.floor(F.col("c_acctbal")).cast("long").alias("population"), (23.0 + (i * 7919) % 14000 / 1000).alias("lon"), (45.5 + (i * 104729) % 8000 / 1000).alias("lat"))


def admin_units_found(spark, d):
    """Districts and communities asked for by name, with and without a region."""
    i = F.col("fact_id")
    level = F.when(i % 3 == 0, "district").otherwise("hromada")
    name = F.when(i % 3 == 0, F.concat(F.upper(F.col("n_name")), F.lit("   район"))).otherwise(F.concat(F.lit("NAME"), i % 41, F.when(i % 2 == 0, " тг").otherwise(" Громада")))
    asks = B.facts(spark, d).join(B.table(spark, d, "nation"), F.col("place_id") == F.col("n_nationkey")).select(i.alias("ask_id"), level.alias("level"), name.alias("name"), F.when(i % 4 > 0, i % 5 + 100).alias("region_id"))
    return A.find_admin(asks, _units(spark, d)).select(F.col("ask_id").alias("fact_id"), F.col("place_id").cast("long").alias("place_id"))


def feed_places(spark, d):
    """The place that each row of a structured feed means, through all fallbacks."""
    i, n = F.col("fact_id"), B.table(spark, d, "nation").join(B.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    f = B.facts(spark, d).join(n, F.col("place_id") == F.col("n_nationkey"))
    kind = F.element_at(F.array(*map(F.lit, ("oblast", "raion", "hromada", "city", "other"))), (i % 5 + 1).cast("int"))
    title = F.when(kind == "oblast", F.col("r_name")).when(kind == "raion", F.when(i % 2 == 0, F.concat("n_name", F.lit(" район"))).otherwise("nowhere")).when(kind == "hromada", F.concat(F.lit("Name"), i % 41, F.lit(" ТГ"))).when(kind == "city", F.concat(F.when(i % 2 == 0, "м. ").otherwise("смт "), F.lit("Town'"), i % 130)).otherwise("anything")
    raion = F.when(i % 3 == 0, F.concat("n_name", F.lit(" район")))
    feed = f.select(i.alias("alert_id"), kind.alias("kind"), title.alias("title"), raion.alias("raion"), F.when(i % 7 > 0, F.lower(F.col("r_name"))).alias("oblast"))
    regions = B.table(spark, d, "region").select((F.col("r_regionkey") + 100).alias("place_id"), F.col("r_name").alias("name"))
    # Every other outline stands for a community.
    shapes = polygons(spark, d).filter("polygon_id % 2 = 1").select((F.col("polygon_id") + 10000).alias("polygon_id"), "rings")
    r = A.resolve(feed, regions, _units(spark, d), _settlements(spark, d), shapes)
    return r.select(F.col("alert_id").alias("fact_id"), F.col("place_id").cast("long").alias("place_id"))


_CORNERS = ", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(CORNERS))
_POLY = f"""corners(k, ux, uy) AS (VALUES {_CORNERS}),
  vertex AS (SELECT place_id AS id, 0 AS ring, k, 8 AS n, lon + ux * (6 + (place_id * 7 + k * 3) % 5) / CASE WHEN place_id % 4 = 0 THEN 256.0::DOUBLE ELSE 64.0::DOUBLE END AS x,
      lat + uy * (6 + (place_id * 7 + k * 3) % 5) / CASE WHEN place_id % 4 = 0 THEN 256.0::DOUBLE ELSE 64.0::DOUBLE END AS y FROM places, corners WHERE parent_id IS NOT NULL
    UNION ALL SELECT place_id, 1 + up, k // 2, 4, lon + ux / 80.0::DOUBLE, lat + uy / 80.0::DOUBLE + 2.0::DOUBLE * up FROM places, corners, (VALUES (0), (1)) u(up) WHERE parent_id IS NOT NULL AND place_id % 2 = 0 AND k % 2 = 0),
  edge AS (SELECT a.id, CASE WHEN a.id % 4 = 0 THEN 'city' ELSE 'region' END AS level, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM vertex a JOIN vertex b ON a.id = b.id AND a.ring = b.ring AND b.k = (a.k + 1) % a.n),
  point AS (SELECT fact_id, 23.0::DOUBLE + (fact_id * 7919) % 14000 / 1000 AS lon, 45.5::DOUBLE + (fact_id * 104729) % 8000 / 1000 AS lat FROM facts),
  held AS (SELECT fact_id, level, id FROM point JOIN edge ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)"""
_GAP = """SELECT fact_id, id, level, sqrt(power(lon - x1 - t * (x2 - x1), 2) + power(lat - y1 - t * (y2 - y1), 2)) AS degrees
    FROM (SELECT *, greatest(0, least(1, ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / (power(x2 - x1, 2) + power(y2 - y1, 2)))) AS t FROM point, edge)"""
_F, _P = B.FACTS_SQL, B.PLACES_SQL
_UNITS = """units AS (SELECT 1000 + n_nationkey AS place_id, 'district' AS level, lower(n_name) || ' район' AS key, n_regionkey + 100 AS region_id FROM nation
    UNION ALL SELECT 10000 + s_suppkey, 'hromada', 'name' || (s_suppkey * 7 % 30), n_regionkey + 100 FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  towns AS (SELECT 100000 + c_custkey AS place_id, 'town''' || (c_custkey % 90) AS key, n_regionkey + 100 AS region_id, floor(c_acctbal) AS population, 23.0::DOUBLE + (c_custkey * 7919) % 14000 / 1000 AS lon, 45.5::DOUBLE + (c_custkey * 104729) % 8000 / 1000 AS lat
    FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_FIND = "coalesce((SELECT min(u.place_id) FROM units u WHERE u.level = {0} AND u.key = {1} AND u.region_id = {2}), (SELECT CASE WHEN count(*) = 1 THEN min(u.place_id) END FROM units u WHERE u.level = {0} AND u.key = {1}))"

SQL = {
    "polygons_at_facts": f"WITH {_F}, {_P}, {_POLY} SELECT fact_id, level, min(id) AS polygon_id FROM held GROUP BY 1, 2",
    "spatial_parents": f"""WITH {_F}, {_P}, {_POLY}, h AS (SELECT fact_id, arg_min(id, (level, id)) AS id FROM held GROUP BY 1),
      c AS (SELECT fact_id, arg_min(id, (degrees, id)) AS id FROM ({_GAP}) WHERE level = 'region' AND degrees <= 0.05 GROUP BY 1)
      SELECT fact_id, CAST(coalesce(h.id, c.id) AS INTEGER) AS parent_id FROM facts LEFT JOIN h USING (fact_id) LEFT JOIN c USING (fact_id)""",
    "nearest_polygons": f"WITH {_F}, {_P}, {_POLY} SELECT fact_id, arg_min(id, (degrees, id)) AS polygon_id, round(min(degrees), 9) AS degrees FROM ({_GAP}) WHERE degrees <= 0.5 GROUP BY 1",
    "admin_units_found": f"""WITH {_F}, {_UNITS}, asks AS (SELECT fact_id, CASE WHEN fact_id % 3 = 0 THEN 'district' ELSE 'hromada' END AS level, CASE WHEN fact_id % 3 = 0 THEN lower(n_name) || ' район' ELSE 'name' || (fact_id % 41) END AS key,
        CASE WHEN fact_id % 4 > 0 THEN fact_id % 5 + 100 END AS region_id FROM facts JOIN nation ON place_id = n_nationkey)
      SELECT fact_id, CAST({_FIND.format('asks.level', 'asks.key', 'asks.region_id')} AS BIGINT) AS place_id FROM asks""",
    "feed_places": f"""WITH {_F}, {_P}, {_UNITS}, {_POLY}, feed AS (SELECT fact_id, fact_id % 5 AS kind, lower(n_name) || ' район' AS district, fact_id % 3 = 0 AS stated, fact_id % 2 = 0 AS even, CASE WHEN fact_id % 7 > 0 OR fact_id % 5 = 0 THEN r_regionkey + 100 END AS rid
        FROM facts JOIN nation ON place_id = n_nationkey JOIN region ON n_regionkey = r_regionkey),
      a AS (SELECT *, CASE WHEN stated THEN {_FIND.format("'district'", 'district', 'rid')} END AS d, CASE WHEN even THEN {_FIND.format("'district'", 'district', 'rid')} END AS t, {_FIND.format("'hromada'", "'name' || (fact_id % 41)", 'rid')} AS h,
        coalesce((SELECT arg_max(w.place_id, (w.population, -w.place_id)) FROM towns w WHERE w.key = 'town''' || (fact_id % 130) AND w.region_id = rid), (SELECT arg_max(w.place_id, (w.population, -w.place_id)) FROM towns w WHERE w.key = 'town''' || (fact_id % 130))) AS c FROM feed),
      around AS (SELECT place_id, min(id) + 10000 AS hid FROM (SELECT w.place_id, id FROM towns w JOIN edge ON id % 2 = 1 AND (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1) GROUP BY 1)
      SELECT fact_id, CAST(coalesce(CASE kind WHEN 1 THEN t WHEN 2 THEN coalesce(h, d) WHEN 3 THEN coalesce(hid, c, d) END, rid) AS BIGINT) AS place_id FROM a LEFT JOIN around ON around.place_id = c""",
}

QUERIES = {name: globals()[name] for name in SQL}
