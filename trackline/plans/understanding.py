"""Queries on what messages report: event phrases, levels, covered mentions, targets built from facts, and model answers.

The given tables hold no such messages, so the texts are put together from a list of words by the facts' numbers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trackline.operators import parse as R
from trackline.operators import phrases as P
from trackline.operators import targets as Y
from trackline.sources import bindings as B

WORDS = "увага повітряна тривога тривоги відбій загроза минула загрозу знято відсутня не фіксується чисто оголошено працює ппо сили збито вибухи приліт рівень жовтий червоний рівні пуски місто зараз область курсом рух".split()
LENGTH = 9


def _word(i, j: int):
    return (i * (j * 7 + 3) + j * j * 5 + F.floor(i / 7)) % len(WORDS)


def spoken(spark, d):
    """fact_id, tokens: nine words for each fact."""
    i = F.col("fact_id")
    words = F.array(*map(F.lit, WORDS))
    return B.facts(spark, d).select("fact_id", F.array(*[F.get(words, _word(i, j).cast("int")) for j in range(LENGTH)]).alias("tokens"))


def event_types(spark, d):
    """Event, rule, launch and level of each fact's words; every other fact also names a target."""
    r = spoken(spark, d).withColumn("e", P.event(F.col("tokens"), F.col("fact_id") % 2 == 0))
    return r.select("fact_id", "e.event", "e.rule", "e.launch", "e.level")


def mentions_kept(spark, d):
    """Of each order's lines, taken as mentions, those that no other line covers."""
    m = F.struct(F.col("l_linenumber").cast("int").alias("start"), (F.col("l_partkey") % 5).cast("int").alias("code"), (F.col("l_partkey") % 5 % 4).cast("int").alias("level"), (F.col("l_suppkey") % 2).cast("int").alias("category_id"), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey") % 3).cast("int").alias("class_id"))
    r = B.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(m).alias("m")).withColumn("kept", P.collapsed(F.col("m")))
    return r.select("l_orderkey", F.size("m").cast("long").alias("mentions"), F.array_join(F.transform("kept", lambda x: x["start"].cast("string")), ",").alias("kept"))


LEVELS = ("region", "district", "area", "city", "town")


def _parsed(spark, d):
    """Facts with a place, an origin or neither, and with a destination inside or outside of it."""
    p = B.places(spark, d)
    n = F.col("place_id")
    level = F.get(F.array(*map(F.lit, LEVELS)), (n % 5).cast("int"))
    radius = F.when(level == "region", 146.0).when(level.isin("district", "area"), 30.0).otherwise(n % 7 + 1.0)
    place = F.struct(n.cast("long").alias("place_id"), "name", level.alias("level"), "lon", "lat", radius.alias("radius_km"), F.col("parent_id").cast("long").alias("parent_id"))
    named = p.select(n.alias("id"), place.alias("p"))
    k, m = F.col("k"), F.col("fact_id") % 7
    quadrant = F.when(k % 6 == 0, (k % 4) * 90.0)
    full = lambda c, q: F.struct(*[F.col(c)[x].alias(x) for x in ("place_id", "name", "level", "lon", "lat", "radius_km", "parent_id")], q.alias("quadrant_deg"), F.col(c)["name"].alias("text"))
    f = B.facts(spark, d).join(named.select(F.col("id").alias("place_id"), F.col("p").alias("a")), "place_id")
    f = f.join(named.select(F.col("id").alias("dest_id"), F.col("p").alias("b")), "dest_id").join(named.select(F.col("id").alias("region"), F.col("p").alias("c")), F.col("a.parent_id") == F.col("region"))
    return f.select(
        "fact_id", F.concat(F.lit("two at "), F.when(m == 0, F.col("c.name")).otherwise(F.col("a.name")), F.when(k % 4 == 0, "  Р-н").otherwise(" and on")).alias("segment"),
        (k / 100).alias("trust"), (k % 11 == 0).alias("structured"), F.get(F.array(*map(F.lit, ("category", "class", "family", "model"))), (k % 5).cast("int")).alias("target_level"), (k % 4).cast("int").alias("alias_confidence"), (k % 3 == 0).alias("hedged"),
        F.when(k % 5 == 0, k * 3.6).alias("compass_deg"), F.when(m > 1, full("a", quadrant)).alias("current"), F.when(m == 0, full("c", quadrant)).alias("origin"), F.when(m != 3, full("b", F.lit(None).cast("double"))).alias("destination"), F.when(k % 3 != 0, k * 2.0).alias("approach_deg"),
    )


def targets_built(spark, d):
    r = Y.build(_parsed(spark, d))
    rounded = [F.round(c, 6).alias(c) for c in ("lon", "lat", "accuracy_km", "direction_deg")]
    return r.select("fact_id", "confidence", "model_confidence", "classification_confidence", "place_id", "kind", *rounded, "direction_kind", "direction_confidence")


def _word_of(name: str):
    """A name as one word."""
    return F.lower(F.regexp_replace(name, r"[_\s]+", ""))


def _dictionary(spark, d):
    """Three aliases, and the nations as cities in their regions."""
    aliases = spark.range(3).select(
        F.get(F.array(*map(F.lit, ("шахед", "бпла", "балістик"))), F.col("id").cast("int")).alias("alias"), F.get(F.array(*map(F.lit, ("SHAHED", "UAV", "BALLISTIC"))), F.col("id").cast("int")).alias("code"),
        F.get(F.array(*map(F.lit, ("family", "category", "class"))), F.col("id").cast("int")).alias("level"), (F.col("id") / 2).cast("long").alias("category_id"), *[F.lit(None).cast("long").alias(c) for c in ("class_id", "family_id", "model_id")], F.lit(2).alias("confidence"),
        F.lit("*").alias("lang"), F.lit(None).cast("long").alias("source_id"), F.lit(False).alias("exact"), F.lit(10).alias("priority"),
    )
    region = F.col("parent_id").isNull()
    places = B.places(spark, d).select(F.col("place_id").cast("long").alias("place_id"), _word_of("name").alias("name"), F.array(_word_of("name")).alias("stems"), F.when(region, "region").otherwise("city").alias("level"), F.col("parent_id").cast("long").alias("parent_id"), F.coalesce("parent_id", "place_id").cast("long").alias("region_id"), F.lit(90_000).cast("long").alias("population"))
    return aliases, places


def parsed_messages(spark, d):
    """Facts put into words, by templates, and read again: sightings with courses, origins, headings, bare targets, all-clears."""
    i, p = F.col("fact_id"), B.places(spark, d)
    own, dest, region = (p.select(F.col("place_id").alias(f"{n}_id"), _word_of("name").alias(n), *([F.col("parent_id").alias("up")] if n == "own" else [])) for n in ("own", "dest", "region"))
    f = B.facts(spark, d).select("fact_id", "k", F.col("place_id").alias("own_id"), "dest_id").join(own, "own_id").join(dest, "dest_id").join(region, F.col("up") == F.col("region_id"))
    said = lambda *parts: F.concat(*[F.lit(x) if x not in ("own", "dest", "region") else F.col(x) for x in parts])
    text = F.when(i % 6 == 0, F.concat((F.col("k") % 9 + 1).cast("string"), said(" шахеди курсом на ", "dest"))).when(i % 6 == 1, said("БпЛА з ", "own", " на ", "dest")).when(i % 6 == 2, said("Балістика!\n", "own", " - в укриття"))
    text = text.when(i % 6 == 3, said("region", ":\nшахеди біля ", "own", "\nБпЛА летить")).when(i % 6 == 4, F.lit("Відбій повітряної тривоги")).otherwise(F.lit("Просто новини"))
    messages = f.select(i.alias("message"), F.lit(1).cast("long").alias("source_id"), F.lit(None).cast("long").alias("home"), text.alias("text"))
    r = R.facts(messages, *_dictionary(spark, d))
    return r.select(F.col("message").alias("fact_id"), F.col("segment").cast("int").alias("segment"), "event", F.col("target.code").alias("code"), F.col("count").alias("n"), F.col("current.place_id").alias("place"), F.col("origin.place_id").alias("origin"), F.col("destination.place_id").alias("destination"), "inherited", "in_section")


_F, _P = B.FACTS_SQL, B.PLACES_SQL
_LIST = ", ".join(f"'{w}'" for w in WORDS)
_TOKENS = f"""tok AS (SELECT fact_id, j, [{_LIST}][CAST((fact_id * (j * 7 + 3) + j * j * 5 + fact_id // 7) % {len(WORDS)} AS INTEGER) + 1] AS w FROM facts, (SELECT CAST(unnest(range({LENGTH})) AS BIGINT) AS j))"""
_RULES = "rules(n, a, b, event, rule) AS (VALUES " + ", ".join(f"({n}, '{s[0]}', {repr(s[1]) if len(s) > 1 else 'NULL'}, '{e}', 'event:{'_'.join(s)}')" for n, (s, e) in enumerate(P.PHRASES)) + ")"
_FITS = "starts_with({0}.w, {1}) AND length({0}.w) - length({1}) <= 4"
_KM = "2 * 6371.0088 * asin(least(1.0, sqrt(power(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * power(sin(radians({3} - {1}) / 2), 2))))"
_BEARING = "fmod(degrees(atan2(sin(radians({3} - {1})) * cos(radians({2})), cos(radians({0})) * sin(radians({2})) - sin(radians({0})) * cos(radians({2})) * cos(radians({3} - {1})))) + 360, 360)"
_LAT = "degrees(asin(sin(radians({0})) * cos({3} / 6371.0088) + cos(radians({0})) * sin({3} / 6371.0088) * cos(radians({2}))))"
_LON = "degrees(radians({1}) + atan2(sin(radians({2})) * sin({3} / 6371.0088) * cos(radians({0})), cos({3} / 6371.0088) - sin(radians({0})) * sin(radians(" + _LAT + "))))"
_LEVEL = "CASE WHEN {0} IN ('country', 'region') THEN 'region' WHEN {0} IN ('district', 'hromada') THEN 'district' WHEN {0} = 'area' THEN 'area' ELSE 'city' END"

SQL = {
    "event_types": f"""WITH {_F}, {_TOKENS}, {_RULES},
      hits AS (SELECT fact_id, n, event FROM tok x JOIN rules ON b IS NULL AND {_FITS.format('x', 'a')}
        UNION SELECT x.fact_id, n, event FROM tok x JOIN rules ON b IS NOT NULL AND {_FITS.format('x', 'a')} JOIN tok y ON y.fact_id = x.fact_id AND y.j > x.j AND y.j <= x.j + 5 AND {_FITS.format('y', 'b')}),
      lev AS (SELECT x.fact_id, arg_min(CASE WHEN starts_with(y.w, 'жовт') THEN 'yellow' ELSE 'red' END, (x.j, y.j)) AS level FROM tok x JOIN tok y ON x.fact_id = y.fact_id AND abs(x.j - y.j) <= 2
        AND (starts_with(x.w, 'рівн') OR starts_with(x.w, 'рівен')) AND (starts_with(y.w, 'жовт') OR starts_with(y.w, 'червон')) GROUP BY 1),
      f AS (SELECT fact_id, fact_id % 2 = 0 AS target, level, bool_or(starts_with(w, 'пуск')) AS launch FROM tok LEFT JOIN lev USING (fact_id) GROUP BY 1, 2, 3),
      g AS (SELECT f.fact_id, f.target, f.level, f.launch, min(n) FILTER (NOT (f.target AND f.level IS NULL AND event = 'air_raid_alert')) AS n FROM f LEFT JOIN hits USING (fact_id) GROUP BY 1, 2, 3, 4)
      SELECT fact_id, coalesce(event, CASE WHEN target THEN 'target_observed' ELSE 'unknown' END) AS event, rule, launch, level FROM g LEFT JOIN rules USING (n)""",
    "parsed_messages": f"""WITH {_F}, {_P}, f AS (SELECT fact_id AS i, k, place_id::BIGINT AS own, dest_id::BIGINT AS dest, parent_id::BIGINT AS region FROM facts JOIN places USING (place_id))
      SELECT i AS fact_id, 0 AS segment, 'target_observed' AS event, 'SHAHED' AS code, CAST(k % 9 + 1 AS INTEGER) AS n, NULL::BIGINT AS place, NULL::BIGINT AS origin, dest AS destination, NULL::VARCHAR AS inherited, false AS in_section FROM f WHERE i % 6 = 0
      UNION ALL SELECT i, 0, 'target_observed', 'UAV', NULL, NULL, own, dest, NULL, false FROM f WHERE i % 6 = 1
      UNION ALL SELECT i, 1, 'target_observed', 'BALLISTIC', NULL, own, NULL, NULL, 'carry', false FROM f WHERE i % 6 = 2
      UNION ALL SELECT i, 1, 'target_observed', 'SHAHED', NULL, own, NULL, NULL, NULL, false FROM f WHERE i % 6 = 3
      UNION ALL SELECT i, 2, 'target_observed', 'UAV', NULL, region, NULL, NULL, NULL, true FROM f WHERE i % 6 = 3
      UNION ALL SELECT i, 0, 'alert_cancelled', NULL, NULL, NULL, NULL, NULL, NULL, false FROM f WHERE i % 6 = 4""",
    "mentions_kept": """WITH m AS (SELECT l_orderkey, l_linenumber AS start, l_partkey % 5 AS code, l_partkey % 5 % 4 AS level, l_suppkey % 2 AS cat, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 3 END AS class FROM lineitem),
      k AS (SELECT *, NOT EXISTS (SELECT 1 FROM m b WHERE b.l_orderkey = m.l_orderkey AND ((b.code = m.code AND b.start < m.start) OR (b.cat = m.cat AND m.level < b.level AND (m.class IS NULL OR m.class = b.class)))) AS kept FROM m)
      SELECT l_orderkey, count(*) AS mentions, coalesce(string_agg(CAST(start AS VARCHAR), ',' ORDER BY start) FILTER (kept), '') AS kept FROM k GROUP BY 1""",
    "targets_built": f"""WITH {_F}, {_P}, lv AS (SELECT place_id AS id, name, parent_id, lon, lat, ['region', 'district', 'area', 'city', 'town'][place_id % 5 + 1] AS level,
        CASE place_id % 5 WHEN 0 THEN 146.0::DOUBLE WHEN 1 THEN 30.0 WHEN 2 THEN 30.0 ELSE place_id % 7 + 1 END AS radius FROM places),
      j AS (SELECT fact_id, k, fact_id % 7 AS m, CASE WHEN k >= 85 THEN 3 WHEN k >= 60 THEN 2 ELSE 1 END AS cap, k % 11 = 0 AS structured, ['category', 'class', 'family', 'model'][k % 5 + 1] AS tl, k % 4 AS ac, k % 3 = 0 AS hedge,
        CASE WHEN k % 5 = 0 THEN k * 3.6::DOUBLE END AS compass, CASE WHEN k % 6 = 0 THEN k % 4 * 90.0::DOUBLE END AS quad, CASE WHEN k % 3 <> 0 THEN k * 2.0::DOUBLE END AS app, k % 4 = 0 AS unit,
        CASE WHEN fact_id % 7 > 1 THEN a.id WHEN fact_id % 7 = 0 THEN c.id END AS lid, CASE WHEN fact_id % 7 > 1 THEN a.level WHEN fact_id % 7 = 0 THEN c.level END AS ll, CASE WHEN fact_id % 7 > 1 THEN a.radius WHEN fact_id % 7 = 0 THEN c.radius END AS lr,
        CASE WHEN fact_id % 7 > 1 THEN a.lon ELSE c.lon END AS x, CASE WHEN fact_id % 7 > 1 THEN a.lat ELSE c.lat END AS y, CASE WHEN fact_id % 7 <> 3 THEN b.id END AS did, b.parent_id AS dp, b.radius AS dr, b.lon AS dx, b.lat AS dy
        FROM facts f JOIN lv a ON a.id = f.place_id JOIN lv b ON b.id = f.dest_id JOIN lv c ON c.id = a.parent_id),
      h AS (SELECT *, hedge AND tl IS NOT NULL AS hedged, CASE WHEN structured THEN 4 ELSE cap END AS own, least(CASE WHEN hedge AND tl IS NOT NULL THEN greatest(1, ac - 1) ELSE ac END, cap) AS said,
        lid IS NOT NULL AND did IS NOT NULL AND lid <> did AS other, quad IS NOT NULL AND lr > 20 AS part, {_LEVEL.format('ll')} = 'city' AND unit AS district FROM j),
      g AS (SELECT *, compass IS NULL AND other AND app IS NOT NULL AND (coalesce(dp = lid, false) OR (lr > 25 AND {_KM.format('y', 'x', 'dy', 'dx')} <= lr)) AS appr FROM h)
      SELECT fact_id, CAST(CASE WHEN hedged THEN greatest(1, own - 1) ELSE own END AS INTEGER) AS confidence, CAST(CASE WHEN tl IN ('family', 'model') THEN said WHEN tl IS NOT NULL THEN 0 END AS INTEGER) AS model_confidence,
        CAST(CASE WHEN tl IS NOT NULL THEN said END AS INTEGER) AS classification_confidence, CAST(CASE WHEN appr THEN did ELSE lid END AS BIGINT) AS place_id,
        CASE WHEN appr THEN 'direction' WHEN lid IS NULL THEN CASE WHEN compass IS NOT NULL OR did IS NOT NULL THEN 'direction' ELSE 'unknown' END WHEN district THEN 'district' ELSE {_LEVEL.format('ll')} END AS kind,
        round(CASE WHEN appr THEN {_LON.format('dy', 'dx', '(app + 180)', '15')} WHEN lid IS NULL THEN NULL WHEN part THEN {_LON.format('y', 'x', 'quad', '(lr * 0.5)')} ELSE x END, 6) AS lon,
        round(CASE WHEN appr THEN {_LAT.format('dy', 'dx', '(app + 180)', '15')} WHEN lid IS NULL THEN NULL WHEN part THEN {_LAT.format('y', 'x', 'quad', '(lr * 0.5)')} ELSE y END, 6) AS lat,
        round(CASE WHEN appr THEN greatest(15, dr) WHEN lid IS NULL THEN NULL WHEN district THEN greatest(CASE WHEN part THEN lr * 0.6::DOUBLE ELSE lr END, 25) WHEN part THEN lr * 0.6::DOUBLE ELSE lr END, 6) AS accuracy_km,
        round(CASE WHEN compass IS NOT NULL THEN compass WHEN appr THEN app WHEN other THEN {_BEARING.format('y', 'x', 'dy', 'dx')} END, 6) AS direction_deg,
        CASE WHEN compass IS NOT NULL THEN 'compass' WHEN other THEN 'towards' ELSE 'unknown' END AS direction_kind,
        CAST(CASE WHEN compass IS NOT NULL THEN cap WHEN appr THEN 1 WHEN other THEN least(CASE WHEN lr <= 25 THEN 2 ELSE 1 END, cap) ELSE 0 END AS INTEGER) AS direction_confidence FROM g""",
}

QUERIES = {name: globals()[name] for name in SQL}
