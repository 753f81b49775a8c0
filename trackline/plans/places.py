"""Queries on anchors, approaches, visible tracks, and on the texts and names of messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackline.functions import geo as G
from trackline.functions import text as T
from trackline.operators import estimate as E
from trackline.operators import fixes as X
from trackline.plans import graphs
from trackline.sources import bindings as B

NOW = "2024-01-30 12:00:00"


def approach_courses(spark, d):
    p = B.places(spark, d)
    regions = p.filter("parent_id is null").select(F.col("place_id").alias("region_id"), "lon", "lat")
    inner = p.filter("parent_id is not null").withColumnRenamed("parent_id", "region_id")
    r = X.approach_bearings(inner, regions).join(inner.select("place_id", "lon", "lat"), "place_id").withColumn("a", X.approach_anchor(F.col("lon"), F.col("lat"), F.col("bearing")))
    return r.select("place_id", "from_region", F.round("bearing", 6).alias("bearing"), F.round("a.lon", 6).alias("anchor_lon"), F.round("a.lat", 6).alias("anchor_lat"))


def _placed(spark, d):
    """Facts with the data of their place and destination: of five facts one is of a whole region, two have a point, one
    has a destination only and one has nothing."""
    p = B.places(spark, d)
    own = p.select("place_id", F.col("parent_id").alias("region_id"), "lon", "lat")
    dest = p.select(F.col("place_id").alias("dest_id"), F.col("lon").alias("dest_lon"), F.col("lat").alias("dest_lat"))
    region = p.select(F.col("place_id").alias("region_id"), F.col("lon").alias("region_lon"), F.col("lat").alias("region_lat"))
    f = B.facts(spark, d).join(own, "place_id").join(dest, "dest_id").join(region, "region_id").withColumn("m", F.col("fact_id") % 5)
    when = lambda test, *names: {n: F.when(test, F.col(n)) for n in names}
    f = f.withColumns({**when(F.col("m") == 0, "region_id", "region_lon", "region_lat"), **when(F.col("m").isin(1, 2), "lon", "lat"), **when(F.col("m").isin(0, 1, 3), "dest_lon", "dest_lat")})
    return f.withColumns({"accuracy_km": F.when(F.col("m") == 1, F.col("k").cast("double")), "dest_km": F.when(F.col("k") > 50, F.col("k").cast("double"))})


def anchors_of_facts(spark, d):
    r = X.anchored(_placed(spark, d))
    return r.select("fact_id", "anchor", "anchor_lon", "anchor_lat", "slack_km")


def fixes_of_facts(spark, d):
    r = X.fixed(_placed(spark, d))
    level = F.when(F.col("m") == 0, 0).when(F.col("m") == 1, F.lit(1)).when(F.col("m") == 2, F.lit(3))
    return r.select("fact_id", "fix_lon", "fix_lat", "approach", X.location_kind(level).alias("kind"))


def class_parameters(spark, d):
    c = B.table(spark, d, "region").select(F.col("r_regionkey").alias("class_id"), F.when(F.col("r_regionkey") != 2, 100.0 + 50 * F.col("r_regionkey")).alias("v_max"), F.lit(None).cast("double").alias("v_cruise"), (10 + F.col("r_regionkey")).alias("win_min"))
    f = X.with_class_parameters(B.facts(spark, d).withColumn("class_id", F.col("k") % 7), c)
    profile = X.speed_profile(F.when(F.col("k") % 2 == 0, F.col("k").cast("double")), F.col("v_max"), F.col("class_id") < 3)
    r = f.withColumn("p", profile).groupBy("class_id", "v_max", "v_cruise", F.col("win_min").cast("int").alias("win_min"), F.col("p.eta").alias("eta"))
    return r.agg(F.count("*").alias("n"), F.sum("p.speed").alias("speeds"))


def tracks_on_map(spark, d):
    last = F.struct("observed_at", "fact_id")
    t = B.facts(spark, d).groupBy("place_id", "category").agg(F.max("observed_at").alias("last_seen_at"), F.array(F.min_by("source_id", last), F.max_by("source_id", last)).alias("sources"), (F.max_by("object_count", last) % 2 == 0).alias("active"))
    t = t.withColumn("class_id", F.col("place_id") % 4)
    r = X.visible_tracks(t, F.expr(f"timestamp_ntz'{NOW}'"), F.lit(600) + F.col("class_id") * 300, [0, 1, 3], True, [])
    return r.select("place_id", "category", "class_id")


def shown_grandparents(spark, d):
    e, h = graphs._edges(spark, d), graphs._heads(spark, d)
    one = e.join(h.select(F.col("fact_id").alias("to_id")), "to_id").select(F.col("to_id").alias("head"), F.col("from_id").alias("via"), F.col("probability").alias("p"))
    two = one.join(e.select(F.col("to_id").alias("via"), "from_id", "probability"), "via").select("head", "via", F.col("from_id").alias("fact_id"), (F.col("p") * F.col("probability")).alias("path"))
    return X.fan_out(two, 1, 0.1).select("head", "via", "fact_id", "path")


def message_languages(spark, d):
    m = B.messages(spark, d)
    return m.groupBy("source", T.language(F.col("text")).alias("language")).agg(F.count("*").alias("n"), F.sum(F.size(T.tokens(F.col("text")))).alias("tokens"))


def canonical_messages(spark, d):
    m = B.messages(spark, d).withColumn("c", T.canonical(F.col("text")))
    return m.select("raw_message_id", F.length("c").cast("long").alias("length"), F.md5("c").alias("digest"), F.md5(T.preview(F.col("c"), 40)).alias("preview"))


def likeness_to_previous(spark, d):
    """Each message against the one before it, by shingles."""
    m = B.messages(spark, d).select("raw_message_id", T.shingle_hashes(T.canonical(F.col("text"))).alias("a"))
    before = m.select((F.col("raw_message_id") + 1).alias("raw_message_id"), F.col("a").alias("b"))
    r = m.join(before, "raw_message_id")
    return r.select("raw_message_id", F.size("a").cast("long").alias("shingles"), F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"), F.round(T.containment(F.col("a"), F.col("b")), 6).alias("containment"))


def name_keys(spark, d):
    """Names of places and of suppliers under which they are found."""
    names = B.places(spark, d).select("name").unionByName(B.table(spark, d, "supplier").select(F.col("s_name").alias("name"))).distinct()
    return names.select("name", T.folded_name(F.col("name")).alias("folded"), T.admin_key(F.concat(F.col("name"), F.lit("  Громада"))).alias("admin"), F.array_join(T.name_variants(F.col("name")), "|").alias("variants"))


def hosts_as_channels(spark, d):
    u = B.table(spark, d, "pages").select(T.channel_name(F.regexp_replace("url", r"^https?://[^/?#]*/", "https://t.me/")).alias("channel"))
    return u.groupBy("channel").agg(F.count("*").alias("n"))


def cleaned_messages(spark, d):
    m = B.messages(spark, d)
    return m.select("raw_message_id", F.md5(T.clean(F.col("text"))).alias("digest"))


def words_shared_with_previous(spark, d):
    """Each message against the one before it, by words of four letters and more."""
    m = B.messages(spark, d).select("raw_message_id", F.col("text").alias("a"))
    r = m.join(m.select((F.col("raw_message_id") + 1).alias("raw_message_id"), F.col("a").alias("b")), "raw_message_id").withColumn("w", T.shared_words(F.col("a"), F.col("b")))
    return r.select("raw_message_id", F.md5(F.array_join("w.words", " ")).alias("digest"), F.round("w.share", 6).alias("share"))


def faded_facts(spark, d):
    """Facts of the day before an instant: how faded they are then, and where their course leads."""
    now = F.expr(f"timestamp_ntz'{NOW}'")
    f = B.facts(spark, d).filter((F.col("observed_at") > F.expr(f"timestamp_ntz'{NOW}' - interval 1 day")) & (F.col("observed_at") <= now)).join(B.places(spark, d).select("place_id", "lon", "lat"), "place_id")
    age = F.timestamp_diff("MICROSECOND", F.col("observed_at"), now) / 60e6
    ahead = G.forecast_point(F.col("lon"), F.col("lat"), F.col("k") * 3.6, F.when(F.col("k") % 3 > 0, F.col("k") * 4.0))
    r = f.withColumn("ahead", ahead)
    return r.select("fact_id", F.round(E.fade_opacity(age, F.lit(360.0)), 6).alias("opacity"), F.round("ahead.lon", 6).alias("lon"), F.round("ahead.lat", 6).alias("lat"))


_F, _P = B.FACTS_SQL, B.PLACES_SQL
_KM = "2 * 6371.0088 * asin(least(1.0, sqrt(power(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * power(sin(radians({b}lon - {a}lon) / 2), 2))))"
_PLACED = """placed AS (SELECT fact_id, f.fact_id % 5 AS m, k, CASE WHEN m = 0 THEN p.parent_id END AS region_id, CASE WHEN m = 0 THEN r.lon END AS region_lon, CASE WHEN m = 0 THEN r.lat END AS region_lat,
    CASE WHEN m IN (1, 2) THEN p.lon END AS lon, CASE WHEN m IN (1, 2) THEN p.lat END AS lat, CASE WHEN m IN (0, 1, 3) THEN q.lon END AS dest_lon, CASE WHEN m IN (0, 1, 3) THEN q.lat END AS dest_lat
  FROM facts f JOIN places p ON p.place_id = f.place_id JOIN places q ON q.place_id = f.dest_id JOIN places r ON r.place_id = p.parent_id)"""
_CANON = r"""canon AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(lower(nfc_normalize(coalesce(text, ''))), '(https?://|www\.|t\.me/)\S+|[@#][\p{L}\p{N}_]+', ' ', 'g'), chr(10)),
    lambda v: trim(regexp_replace(v, '[^\p{L}\p{Nd}]+', ' ', 'g'))), lambda v: v <> '' AND NOT (length(v) <= 40 AND regexp_matches(v, 'підпис|подпис|subscribe'))), ' ') AS c FROM documents)"""

SQL = {
    "approach_courses": f"""WITH {_P}, c AS (SELECT p.place_id, p.lon, p.lat, r.place_id AS rid, r.lon AS rlon, r.lat AS rlat, round({_KM.format(a='r.', b='p.')}, 9) AS km FROM places p JOIN places r ON r.parent_id IS NULL AND r.place_id <> p.parent_id),
      n AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY km, rid) = 1),
      b AS (SELECT *, fmod(degrees(atan2(sin(radians(lon - rlon)) * cos(radians(lat)), cos(radians(rlat)) * sin(radians(lat)) - sin(radians(rlat)) * cos(radians(lat)) * cos(radians(lon - rlon)))) + 360, 360) AS bearing FROM n),
      o AS (SELECT *, radians(fmod(bearing + 180, 360)) AS t, 15 / 6371.0088 AS s FROM b), y AS (SELECT *, asin(sin(radians(lat)) * cos(s) + cos(radians(lat)) * sin(s) * cos(t)) AS lat2 FROM o)
      SELECT place_id, rid AS from_region, round(bearing, 6) AS bearing, round(degrees(radians(lon) + atan2(sin(t) * sin(s) * cos(radians(lat)), cos(s) - sin(radians(lat)) * sin(lat2))), 6) AS anchor_lon, round(degrees(lat2), 6) AS anchor_lat FROM y""",
    "anchors_of_facts": f"""WITH {_F}, {_P}, {_PLACED} SELECT fact_id, CASE WHEN m = 0 THEN 'region' WHEN m IN (1, 2) THEN 'point' WHEN m = 3 THEN 'destination' ELSE 'none' END AS anchor, coalesce(region_lon, lon, dest_lon) AS anchor_lon, coalesce(region_lat, lat, dest_lat) AS anchor_lat,
      CASE WHEN m = 1 THEN k::DOUBLE WHEN m IN (0, 2) THEN 0::DOUBLE WHEN m = 3 THEN greatest(40, CASE WHEN k > 50 THEN k ELSE 0 END)::DOUBLE END AS slack_km FROM placed""",
    "fixes_of_facts": f"""WITH {_F}, {_P}, {_PLACED} SELECT fact_id, coalesce(lon, dest_lon) AS fix_lon, coalesce(lat, dest_lat) AS fix_lat, m IN (0, 3) AS approach, CASE m WHEN 0 THEN 'region' WHEN 1 THEN 'area' WHEN 2 THEN 'settlement' ELSE 'none' END AS kind FROM placed""",
    "class_parameters": f"""WITH {_F}, f AS (SELECT k, k % 7 AS class_id, CASE WHEN k % 7 IN (0, 1, 3, 4) THEN 100.0::DOUBLE + 50 * (k % 7) ELSE 200.0::DOUBLE END AS v_max, 175.0::DOUBLE AS v_cruise, CAST(CASE WHEN k % 7 < 5 THEN 10 + k % 7 ELSE 30 END AS INTEGER) AS win_min FROM facts)
      SELECT class_id, v_max, v_cruise, win_min, class_id < 3 AS eta, count(*) AS n, sum(CASE WHEN k % 2 = 0 THEN k::DOUBLE ELSE v_max END) AS speeds FROM f GROUP BY 1, 2, 3, 4, 5""",
    "tracks_on_map": f"""WITH {_F}, t AS (SELECT place_id, category, max(observed_at) AS seen, arg_max(object_count, (observed_at, fact_id)) % 2 = 0 AS active, place_id % 4 AS class_id FROM facts GROUP BY 1, 2)
      SELECT place_id, category, class_id FROM t WHERE active AND class_id <> 2 AND seen <= TIMESTAMP '{NOW}' AND seen > TIMESTAMP '{NOW}' - (600 + class_id * 300) * INTERVAL 1 MINUTE - INTERVAL 1 SECOND""",
    "shown_grandparents": f"""WITH {_F}, {graphs._E}, w AS (SELECT head, a.from_id AS via, b.from_id AS fact_id, a.probability * b.probability AS path FROM heads JOIN edges a ON a.to_id = head JOIN edges b ON b.to_id = a.from_id)
      SELECT * FROM w WHERE path >= 0.1 QUALIFY row_number() OVER (PARTITION BY head, via ORDER BY path DESC, fact_id) = 1""",
    "message_languages": r"""WITH t AS (SELECT source, lower(coalesce(text, '')) AS t, len(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[-''/.][\p{L}\p{N}]+)*')) AS n FROM documents)
      SELECT source, CASE WHEN length(regexp_replace(t, '[^a-z]', '', 'g')) > length(regexp_replace(t, '[^а-яіїєґё]', '', 'g')) THEN 'en'
        WHEN length(regexp_replace(t, '[^ыэёъ]', '', 'g')) > length(regexp_replace(t, '[^іїєґ]', '', 'g')) THEN 'ru' ELSE 'uk' END AS language, count(*) AS n, CAST(sum(n) AS BIGINT) AS tokens FROM t GROUP BY 1, 2""",
    "canonical_messages": f"WITH {_CANON} SELECT doc_id AS raw_message_id, length(c) AS length, md5(c) AS digest, md5(CASE WHEN length(c) > 40 THEN left(c, 40) || '…' ELSE c END) AS preview FROM canon",
    "likeness_to_previous": f"""WITH {_CANON}, s AS (SELECT doc_id, CASE WHEN c = '' THEN [] ELSE list_distinct(list_transform(range(1, greatest(length(c) - 3, 1) + 1), lambda i: substr(c, i, 4))) END AS s FROM canon),
      p AS (SELECT a.doc_id, len(a.s) AS n, len(b.s) AS m, len(list_intersect(a.s, b.s)) AS shared FROM s a JOIN s b ON b.doc_id + 1 = a.doc_id)
      SELECT doc_id AS raw_message_id, n AS shingles, CASE WHEN n + m > shared THEN round(shared / (n + m - shared), 6) ELSE 0.0 END AS jaccard, CASE WHEN least(n, m) > 0 THEN round(shared / least(n, m), 6) ELSE 0.0 END AS containment FROM p""",
    "cleaned_messages": r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(nfc_normalize(coalesce(text, '')), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '(https?://|www\.|t\.me/)\S+', ' ', 'g') AS t FROM documents)
      SELECT doc_id AS raw_message_id, md5(regexp_replace(translate(lower(t), 'ё«»“”„’ʼ`—–−', 'е' || repeat(chr(34), 5) || repeat(chr(39), 3) || repeat('-', 3)), '[^\p{L}\p{N}\n.,!?;:''"/+%°()-]+', ' ', 'g')) AS digest FROM a""",
    "words_shared_with_previous": r"""WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:[-''/.][\p{L}\p{N}]+)*'), lambda x: length(x) >= 4)) AS w FROM documents),
      p AS (SELECT a.doc_id, list_sort(list_intersect(a.w, b.w)) AS s, least(len(a.w), len(b.w)) AS n FROM w a JOIN w b ON b.doc_id + 1 = a.doc_id)
      SELECT doc_id AS raw_message_id, md5(array_to_string(s, ' ')) AS digest, CASE WHEN n > 0 THEN round(len(s) / n, 6) ELSE 0.0 END AS share FROM p""",
    "faded_facts": f"""WITH {_F}, {_P}, f AS (SELECT fact_id, k, lon, lat, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(observed_at)) / 6e7 AS age, radians(k * 3.6::DOUBLE) AS t, (CASE WHEN k % 3 > 0 THEN greatest(k * 4.0::DOUBLE * 0.1, 8) ELSE 20 END) / 6371.0088 AS s
        FROM facts JOIN places USING (place_id) WHERE observed_at > TIMESTAMP '{NOW}' - INTERVAL 1 DAY AND observed_at <= TIMESTAMP '{NOW}'),
      y AS (SELECT *, asin(sin(radians(lat)) * cos(s) + cos(radians(lat)) * sin(s) * cos(t)) AS lat2 FROM f)
      SELECT fact_id, round(CASE WHEN age <= 0 THEN 1.0::DOUBLE WHEN age >= 720 THEN 0 WHEN age <= 360 THEN 1 - 0.8::DOUBLE * age / 360 ELSE 0.2::DOUBLE * (1 - (age - 360) / 360) END, 6) AS opacity,
        round(degrees(radians(lon) + atan2(sin(t) * sin(s) * cos(radians(lat)), cos(s) - sin(radians(lat)) * sin(lat2))), 6) AS lon, round(degrees(lat2), 6) AS lat FROM y""",
    "name_keys": f"""WITH {_P}, n AS (SELECT name FROM places UNION SELECT s_name FROM supplier), f AS (SELECT name, trim(regexp_replace(translate(lower(name), '—–−', '---'), '\\s+', ' ', 'g')) AS folded FROM n)
      SELECT name, folded, folded AS admin, folded AS variants FROM f""",
    "hosts_as_channels": r"""SELECT lower(regexp_extract(trim(regexp_replace(url, '^https?://[^/?#]*/', 'https://t.me/')), '^(?:https?://)?(?:t\.me/|telegram\.me/)?(?:s/)?@?([A-Za-z0-9_]+)', 1)) AS channel, count(*) AS n FROM pages GROUP BY 1""",
}

QUERIES = {name: globals()[name] for name in SQL}
