from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trackline.operators import tracks as K
from trackline.operators import dedup, estimate, intervals, links

T0 = datetime(2026, 9, 14)
at = lambda m: T0 + timedelta(minutes=m)
FACT = "fact_id long, raw_message_id long, source_id long, category string, class_id int, family_id int, model_id int, observed_at timestamp_ntz, lon double, lat double, accuracy_km double, place_id int, direction_deg double, confidence int, speed_kmh double, window_min double"


def fact(i, lon, lat, m, model=None, family=5, source=1, course=180.0):
    return (i, i, source, "uav", 1, family, model, at(m), lon, lat, 40.0, i, course, 2, 200.0, 60.0)


def test_tracks(spark):
    rows = [fact(1, 34.8, 50.9, 0), fact(2, 34.55, 49.59, 50), fact(3, 24.0, 49.84, 10), fact(4, 34.5, 49.3, 60, source=2), fact(5, 34.8, 50.9, 2, model=9), fact(6, 0.0, 0.0, 5)]
    df = spark.createDataFrame(rows, FACT)
    got = {r.fact_id: r for r in K.tracks(df).collect()}
    assert {got[i].track_id for i in (1, 2, 4, 5)} == {1} and got[4].confidence == 3 and got[4].facts == 4
    assert got[3].track_id == 3 and got[6].track_id == 6
    again = {r.fact_id: r.track_id for r in K.tracks(spark.createDataFrame(rows[::-1], FACT)).collect()}
    assert again == {i: r.track_id for i, r in got.items()}


def test_two_key_insert(spark):
    rows = [(1, "k1", "ha"), (2, "k2", "ha"), (3, "k2", "hc"), (4, "k1", "hb"), (5, "k3", "hb")]
    df = spark.createDataFrame(rows, "arrival long, key string, hash string")
    assert sorted(r.arrival for r in dedup.idempotent(df).collect()) == [1, 3, 5]
    stored = spark.createDataFrame([("k1", "zz")], "key string, hash string")
    assert sorted(r.arrival for r in dedup.idempotent(df, stored).collect()) == [2, 5]


def test_repeats_are_no_originals(spark):
    rows = [(i, i, 1, "uav", None, 7, None, at(m)) for i, m in enumerate([0, 2, 4, 4.5, 20])]
    df = spark.createDataFrame(rows, "fact_id long, raw_message_id long, event_type int, category string, class_id int, place_id int, dest_id int, observed_at timestamp_ntz")
    got = {r.fact_id: r.duplicate_of for r in dedup.mark_repeats(df).collect()}
    assert got == {0: None, 1: 0, 2: None, 3: 2, 4: None}


def test_links_leave_what_is_given(spark):
    row = lambda i, m: (i, i, "uav", at(m), 120, 200.0, 175.0, 30.0, 50.0, 10.0, None, 1, None, None, None, 1)
    schema = "fact_id long, raw_message_id long, category string, observed_at timestamp_ntz, win_min int, v_max double, v_cruise double, lon double, lat double, slack_km double, direction_deg double, place_id int, dest_id int, model_id int, family_id int, class_id int"
    got = {(r.from_id, r.to_id): r.probability for r in links.link(spark.createDataFrame([row(1, 0), row(2, 5), row(3, 10)], schema)).collect()}
    assert got[1, 2] == 0.85 and got[2, 3] == 0.85
    assert got.get((1, 3), 0) <= 0.15


def test_alert_summary(spark):
    rows = [(1, at(-60), at(60)), (2, at(90), at(150)), (1, at(180), None), (1, at(-240), at(-180))]
    alerts = spark.createDataFrame(rows, "place_id int, start timestamp_ntz, end timestamp_ntz")
    a = intervals.clip(alerts, F.lit(T0).cast("timestamp_ntz"), F.lit(at(240)).cast("timestamp_ntz"))
    hours = {r.bucket.hour: r.h for r in intervals.split_hours(a).groupBy("bucket").agg(F.sum("hours").alias("h")).collect()}
    assert hours == pytest.approx({0: 1.0, 1: 0.5, 2: 0.5, 3: 1.0})


def test_text_alerts(spark):
    rows = [(1, 5, 20, "alert", at(0), 1), (2, 5, 20, "alert", at(30), 2), (3, 5, 10, "cancel", at(60), 0), (4, 5, 20, "alert", at(120), 1), (5, 6, 20, "cancel", at(-30), 0)]
    events = spark.createDataFrame(rows, "id long, source_id long, place_id int, kind string, at timestamp_ntz, level int")
    places = spark.createDataFrame([(20, 10), (10, None)], "place_id int, parent_id int")
    got = sorted((r.start, r.end, r.level) for r in intervals.text_alerts(events, places).collect())
    assert got == [(at(0), at(60), 2), (at(120), at(300), 1)]


def test_structured_alerts_any_order(spark):
    rows = [(1, "a", "finished", at(60), None, None, 1), (1, "a", "started", at(0), None, 2, 2), (1, "b", "started", at(5), at(9), 1, 3), (1, "c", "finished", at(-5), None, None, 4), (1, "c", "started", at(0), None, 1, 5)]
    events = spark.createDataFrame(rows, "source_id int, alert_id string, kind string, at timestamp_ntz, finished_at timestamp_ntz, level int, arrival int")
    got = {r.alert_id: (r.start, r.end, r.level) for r in intervals.structured_alerts(events).collect()}
    assert got == {"a": (at(0), at(60), 2), "b": (at(5), at(9), 1), "c": (at(0), at(-5), 1)}
    fixed = {r.alert_id: r.end for r in intervals.repaired(intervals.structured_alerts(events)).collect()}
    assert fixed["c"] is None


def test_eta_and_fade(spark):
    schema = "track_id int, lon double, lat double, accuracy_km double, located boolean, area boolean, direction_deg double, direction_confidence int, speed_min double, speed_max double, eta_enabled boolean, fade_min double, last_seen_at timestamp_ntz, ring array<struct<lon:double,lat:double>>"
    base = (31.9, 51.4, 40.0, True, False, 225.0, 2, 150.0, 200.0, True, 20.0, at(-5), None)
    change = lambda i, **kw: (i, *[kw.get(k, v) for k, v in zip(["lon", "lat", "acc", "located", "area", "course", "sure", "lo", "hi", "on", "fade", "seen", "ring"], base)])
    rows = [change(1), change(2, course=45.0), change(3, on=False), change(4, seen=at(-60)), change(5, lon=30.6, lat=50.5)]
    points = spark.createDataFrame([(1, 30.52, 50.45)], "point_id int, point_lon double, point_lat double")
    got = {r.track_id: r for r in estimate.eta(spark.createDataFrame(rows, schema), points, F.lit(T0).cast("timestamp_ntz")).collect()}
    assert got[1].kind == "range" and got[1].min_minutes >= 20 and got[1].max_minutes <= 80 and got[1].min_minutes % 5 == got[1].max_minutes % 5 == 0 and got[1].confidence == 2
    assert [got[i].kind for i in (2, 3, 4, 5)] == ["notTowards", "unknown", "unknown", "imminent"] and got[4].reason == "stale"
    fades = spark.createDataFrame([(0.0,), (10.0,), (20.0,), (40.0,)], "a double").select(estimate.fade_opacity(F.col("a"), F.lit(20.0)).alias("o")).collect()
    assert [r.o for r in fades] == pytest.approx([1, 0.6, 0.2, 0])


def test_positions(spark):
    revs = spark.createDataFrame([(1, at(0), at(0), 30.0, 50.0, 90.0), (1, at(1), at(0), 30.0, 50.0, 90.0), (1, at(10), at(10), 31.0, 50.0, 90.0)], "track_id int, revision_at timestamp_ntz, seen_at timestamp_ntz, lon double, lat double, heading double")
    s = estimate.samples(revs, F.lit(at(-1)).cast("timestamp_ntz"), F.lit(at(60)).cast("timestamp_ntz"))
    grid = spark.createDataFrame([(at(m),) for m in (5, 12, 100)], "at timestamp_ntz")
    got = {r.at: r.lon for r in estimate.positions(s, grid, 30).collect()}
    assert got == pytest.approx({at(5): 30.5, at(12): 31.0})


def test_text_alerts_equal_one_pass(spark):
    """A crowded history against intervals kept in a list and looked through for each event."""
    import random

    draw, limit = random.Random(4), timedelta(hours=3)
    rows = [(i, draw.randint(1, 3), draw.choice([10, 20, 21]), draw.choice(["alert"] * 4 + ["cancel"]), at(draw.randint(0, 3000)), draw.choice([0, 1, 2, None])) for i in range(600)]
    places = spark.createDataFrame([(10, None), (20, 10), (21, 10)], "place_id int, parent_id int")
    df = spark.createDataFrame(rows, "id long, source_id long, place_id int, kind string, at timestamp_ntz, level int")
    got = sorted(map(str, map(tuple, intervals.text_alerts(df, places).select("source_id", "place_id", "start", "end", "level").collect())))
    want = []
    for place in (10, 20, 21):
        held = []
        for _, source, p, kind, when, level in sorted(rows, key=lambda r: (r[4], r[0])):
            if p != place and not (kind == "cancel" and p == 10):
                continue
            live = [a for a in held if a[3] is None]
            if kind == "cancel":
                for a in live:
                    a[3] = when
                continue
            mine = [a for a in live if a[0] == source]
            if mine and when - mine[0][2] > limit:
                mine[0][3], mine = when, []
            if not mine:
                held.append([source, place, when, None, level])
            elif level:
                mine[0][4] = level
        want += [(a[0], a[1], a[2], a[2] + limit if a[3] is None else min(a[3], a[2] + limit), a[4]) for a in held]
    assert got == sorted(map(str, want)) and len(want) > 100


def test_two_key_insert_equals_one_pass(spark):
    import random

    draw = random.Random(8)
    rows = [(i, f"k{draw.randint(0, 120)}", f"h{draw.randint(0, 120)}") for i in range(400)] + [(500 + i, f"x{i}", f"y{i}") for i in range(20)]
    keys, hashes, want = set(), set(), []
    for i, k, h in rows:
        if k not in keys and h not in hashes:
            keys.add(k)
            hashes.add(h)
            want.append(i)
    df = spark.createDataFrame(draw.sample(rows, len(rows)), "arrival long, key string, hash string")
    assert sorted(r.arrival for r in dedup.idempotent(df).collect()) == want and 40 < len(want) < 200
    assert dedup.idempotent(df.limit(0)).count() == 0
