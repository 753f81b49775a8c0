"""Course of tracks: single updates, the pass over a table against one board, and the stream against the table."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trackline.operators import tracks as K
from trackline.streaming import tracks as S

T0 = datetime(2026, 9, 14)
NAMES = [column.split()[0] for column in K.EVENT.split(",")]


def fact(i, lon, lat, m, **more):
    base = dict.fromkeys(NAMES) | {"fact_id": i, "raw_message_id": i, "source_id": 1, "category": "uav", "class_id": 1, "family_id": 1, "observed_at": T0 + timedelta(minutes=m), "lon": lon, "lat": lat, "accuracy_km": 40.0, "kind": "region", "place_id": i, "confidence": 3, "speed_kmh": 200.0, "window_min": 60.0, "direction_confidence": 3}
    if lon is None:
        base |= {"accuracy_km": None, "kind": None, "place_id": None}
    return base | more


def run(*facts, until=None, rule=K.Rule()):
    board, out = K.Board(rule), []
    for f in facts:
        out += board.take(f)
    if until is not None:
        out += board.expire(T0 + timedelta(minutes=until))
    return out, board


def scored(f, first):
    board = run(first)[1]
    return K.score(f, K.anchor(f, K.Rule()), board.tracks[first["fact_id"]], K.Rule())


def test_scores():
    first = fact(1, 34.8, 50.9, 0, direction_deg=180.0)
    assert scored(fact(2, 34.55, 49.59, 50, direction_deg=180.0), first) >= 0.6
    assert scored(fact(2, 24.0, 49.84, 10), first) <= 0.3
    assert K.similarity(fact(2, 34.8, 50.9, 5, model_id=11), run(fact(1, 34.8, 50.9, 0, model_id=10))[1].tracks[1]) == 0.2
    assert scored(fact(2, 34.7, 50.5, 15, direction_deg=180.0), first) > scored(fact(2, 34.7, 50.5, 15, direction_deg=0.0), first)
    # Moving where the track is heading fits better than moving against it.
    assert scored(fact(2, 34.8, 49.5, 50), first) > scored(fact(2, 34.8, 52.3, 50), first)


def test_one_source_listing_two_places_means_two_objects():
    first = fact(1, 32.0, 51.4, 0, place_id=1, source_id=7, accuracy_km=150.0)
    assert scored(fact(2, 34.2, 51.0, 2, place_id=2, source_id=7, accuracy_km=150.0), first) <= 0.3
    assert scored(fact(2, 34.2, 51.0, 2, place_id=2, source_id=8, accuracy_km=150.0), first) >= 0.6


def test_specific_model_path_and_derived_course():
    out, board = run(fact(1, 34.8, 50.9, 0), fact(2, 34.55, 49.59, 45, model_id=10))
    t = board.tracks[1]
    assert (t.model_id, t.facts, t.heading_confidence) == (10, 2, 1) and 170 < t.heading < 200
    assert out[0]["added"] == [] and len(out[1]["added"]) == 2
    less = run(fact(1, 34.8, 50.9, 0, model_id=10), fact(2, 34.8, 50.9, 5, family_id=None, model_id=None, class_id=None))[1].tracks[1]
    assert less.model_id == 10 and less.facts == 2


def test_older_fact_moves_nothing():
    out, board = run(fact(1, 34.55, 49.59, 50), fact(2, 34.8, 50.9, 20, direction_deg=90.0, source_id=2))
    t = board.tracks[1]
    assert (t.at, t.first_at, t.seen_at, t.facts, t.heading) == ((34.55, 49.59), T0 + timedelta(minutes=20), T0 + timedelta(minutes=50), 2, None)
    assert out[1]["fact_id"] == 2 and out[1]["revision_at"] == T0 + timedelta(minutes=50) and out[1]["sources"] == 2


def test_coarse_positions_and_origins():
    t = run(fact(1, 34.8, 50.9, 0, accuracy_km=147.0), fact(2, 34.55, 49.59, 30, accuracy_km=135.0))[1].tracks[1]
    assert t.heading is None and t.last_point is None  # areas that overlap prove no move
    out, board = run(fact(1, 34.8, 50.9, 0, accuracy_km=147.0), fact(2, 34.55, 50.7, 10, accuracy_km=3.0), fact(3, 34.4, 50.5, 20, accuracy_km=3.0))
    assert [len(r["added"]) for r in out] == [0, 0, 2] and out[2]["added"][0]["lon"] == 34.55
    far = fact(2, 32.0, 51.35, 10, place_id=6, origin_id=6, direction_deg=225.0, accuracy_km=148.0)
    t = run(fact(1, 30.45, 50.30, 0, place_id=5), far)[1].tracks[1]
    assert (t.place_id, t.heading, t.last_point) == (5, 225.0, None)
    t = run(fact(1, 30.45, 50.30, 0, place_id=5), fact(2, 30.79, 50.51, 10, place_id=7, origin_id=7, accuracy_km=3.0))[1].tracks[1]
    assert t.place_id == 7 and t.last_point == (30.79, 50.51)


def to(i, m, **more):
    return fact(i, None, None, m, **({"dest_id": 39, "dest_lon": 30.79, "dest_lat": 50.51, "dest_km": 3.0, "confidence": 2} | more))


def test_named_destinations():
    out, board = run(to(1, 0), fact(2, 30.6, 50.45, 5, accuracy_km=3.0, kind="city"))
    assert (out[0]["kind"], out[0]["place_id"], out[0]["accuracy_km"]) == (K.APPROACH, 39, 40.0) and out[1]["kind"] == "city" and out[1]["added"] == []
    t = run(fact(1, 30.45, 50.30, 0, accuracy_km=146.0), to(2, 4))[1].tracks[1]
    assert (t.place_id, t.kind, t.heading) == (39, K.APPROACH, None)
    out, board = run(fact(1, 30.45, 50.30, 0, accuracy_km=3.0), to(2, 4))
    assert 30 < board.tracks[1].heading < 60 and board.tracks[1].heading_confidence == 1 and out[1]["added"] == []
    t = run(to(1, 0, approach_deg=200.0))[1].tracks[1]
    assert t.heading == 200.0 and t.at[1] > 50.51 and K.km(t.at, (30.79, 50.51)) == pytest.approx(18.0)
    assert run(fact(1, 30.0, 50.0, 0, direction_deg=225.0), fact(2, 30.0, 49.0, 50))[1].tracks[1].heading == 225.0
    assert run(fact(1, None, None, 0))[0] == []


def test_repeats_confirm():
    out, board = run(fact(1, 30.0, 50.0, 0, confidence=1), fact(2, 30.0, 50.0, 1, confidence=1, source_id=2, duplicate_of=1), fact(3, 30.0, 50.0, 2, confidence=1, source_id=2, duplicate_of=9))
    assert [(r["fact_id"], r["facts"], r["sources"], r["confidence"]) for r in out] == [(1, 1, 1, 1), (2, 1, 2, 3)]
    out, _ = run(fact(1, 30.0, 50.0, 0, confidence=1), fact(2, 30.0, 50.0, 1, confidence=1, duplicate_of=1))
    assert [(r["sources"], r["confidence"]) for r in out] == [(1, 1), (1, 1)]


def test_cancellation_and_silence():
    here = {"region_id": 5, "dest_region_id": None}
    end = lambda i, m, **more: fact(i, None, None, m, event="cancelled", category=None, region_id=5) | more
    out, _ = run(fact(1, 30.0, 50.0, 0, **here), fact(2, 20.0, 50.0, 1, region_id=6), fact(3, 10.0, 50.0, 2, category="ballistic", **here), end(4, 10, category="uav"), end(5, 20), fact(6, 30.0, 50.0, 25, **here))
    assert [(r["track_id"], r["status"], r["fact_id"]) for r in out] == [(1, "active", 1), (2, "active", 2), (3, "active", 3), (1, "cancelled", 4), (3, "cancelled", 5), (6, "active", 6)]
    old, _ = run(fact(1, 30.0, 50.0, 30, **here), end(2, 10))
    assert [r["status"] for r in old] == ["active"]  # an older all-clear closes nothing seen after it
    out, board = run(fact(1, 30.0, 50.0, 0, window_min=20.0), fact(2, 30.0, 50.0, 45, window_min=20.0), until=500)
    assert [(r["status"], r["reason"], r["revision_at"]) for r in out if r["track_id"] == 1][:2] == [("active", None, T0), ("closed", "timeout", T0 + timedelta(minutes=40))]
    assert board.tracks == {}
    out, _ = run(fact(1, 30.0, 50.0, 0, window_min=30.0, direction_deg=0.0), fact(2, 30.0, 50.1, 61, window_min=200.0, model_id=1, direction_deg=0.0))
    assert [r["track_id"] for r in out] == [1, 1, 1] and [r["status"] for r in out] == ["active", "closed", "active"]  # reported again in time


def test_two_facts_of_a_message_are_two_tracks():
    out, _ = run(fact(1, 30.0, 50.0, 0, raw_message_id=9), fact(2, 30.0, 50.0, 0, raw_message_id=9), fact(3, 30.0, 50.0, 5, raw_message_id=10))
    assert [r["track_id"] for r in out] == [1, 2, 1]


def test_state_survives_packing():
    board = run(fact(1, 34.8, 50.9, 0), fact(2, 34.55, 49.59, 45, model_id=10))[1]
    t = board.tracks[1]
    assert K.Track.unpacked(t.packed()) == t


def crowd(seed, n=160):
    """Two far apart theatres with quiet hours, repeats, destinations and all-clears."""
    draw, rows = random.Random(seed), []
    now = 0.0
    for i in range(n):
        now += draw.expovariate(1 / 6) if draw.random() < 0.97 else 400
        x, y = draw.choice([(30.0, 50.0), (120.0, -20.0)])
        region = draw.choice([1, 2])
        f = fact(i, x + draw.gauss(0, 1), y + draw.gauss(0, 1), round(now, 1), source_id=draw.randint(1, 3), category=draw.choice(["uav", "uav", "missile"]), class_id=draw.choice([1, 1, 2, None]), accuracy_km=draw.choice([3.0, 40.0]), region_id=region, confidence=draw.randint(1, 3), window_min=30.0, direction_deg=draw.choice([None, 90.0, 180.0]), raw_message_id=i // 2, speed_kmh=draw.choice([200.0, 300.0]))
        kind = draw.random()
        if kind < 0.08:
            f = fact(i, None, None, round(now, 1), event="cancelled", category=draw.choice([None, "uav"]), region_id=region)
        elif kind < 0.16:
            f |= {"lon": None, "lat": None, "accuracy_km": None, "dest_id": 7, "dest_lon": x, "dest_lat": y, "dest_region_id": 1, "place_id": None}
        elif kind < 0.24 and rows and rows[-1]["event"] is None:
            f = rows[-1] | {"fact_id": i, "raw_message_id": 1000 + i, "source_id": 9, "duplicate_of": rows[-1]["duplicate_of"] or rows[-1]["fact_id"], "observed_at": rows[-1]["observed_at"] + timedelta(seconds=30)}
        rows.append(f)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], K.EVENT)


def keyed(rows):
    return sorted(str(tuple(r[n] for n in ("track_id", "fact_id", "revision_at", "status", "reason", "first_at", "seen_at", "lon", "lat", "kind", "heading", "facts", "sources", "confidence", "class_id", "object_count", "association"))) for r in rows)


def wanted(rows):
    ordered = sorted(rows, key=lambda f: (f["observed_at"], f["fact_id"]))
    board, out = K.Board(), []
    for f in ordered:
        out += board.take(f)
    return keyed([*out, *board.expire(ordered[-1]["observed_at"])])


def test_components_change_nothing(spark):
    rows = crowd(5)
    made = K.tracks(frame(spark, rows)).collect()
    assert keyed(made) == wanted(rows)
    assert {r.status for r in made} == {"active", "closed", "cancelled"} and len({r.track_id for r in made}) > 10
    paths = {r.track_id: r.path for r in K.paths(K.tracks(frame(spark, rows))).collect()}
    assert paths and all(len(p) >= 2 and all(a != b for a, b in zip(p, p[1:])) for p in paths.values())


def test_query_equals_one_pass(spark):
    from trackline.plans import courses

    d = "/root/testdata/sf0.001"
    rows = [r.asDict() for r in courses.track_events(spark, d).collect()]
    made = K.tracks(courses.track_events(spark, d)).collect()
    assert keyed(made) == wanted(rows)
    assert {r.status for r in made} == {"active", "closed", "cancelled"} and any(r.duplicate_of for r in courses.track_events(spark, d).collect())
    assert courses.track_revisions(spark, d).count() == len(made) and courses.track_paths(spark, d).count() > 0


def test_empty_tables(spark):
    assert K.tracks(frame(spark, [])).count() == 0
    assert K.tracks(frame(spark, [fact(1, None, None, 0), fact(2, None, None, 3, event="cancelled", region_id=4)])).count() == 0


def test_stream_in_any_order_gives_the_same(spark, tmp_path):
    rows = crowd(6, 90)
    draw = random.Random(1)
    arriving = sorted(rows, key=lambda f: (f["observed_at"] + timedelta(minutes=draw.uniform(0, 9)), f["fact_id"]))
    cuts = [0, 20, 45, 46, 70, 90]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        frame(spark, arriving[a:b]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    folder = str(tmp_path / "out")
    query = S.follow(stream, folder, str(tmp_path / "checkpoint"), lambda: datetime(2030, 1, 1), timedelta(minutes=10))
    query.awaitTermination()
    assert query.exception() is None
    sizes = [S.state_of(spark, folder, n).first() for n in (3, 4)]
    assert all(s.waiting < 40 and s.open < 40 for s in sizes)
    late = fact(500, *next((f["lon"], f["lat"]) for f in rows if f["lon"]), 0, region_id=1)
    S.advance(frame(spark, []), 5, folder, None, timedelta(minutes=10))
    assert keyed(S.revisions(spark, folder).collect()) == wanted(rows)
    S.advance(frame(spark, []), 5, folder, None, timedelta(minutes=10))  # the batch comes again
    assert keyed(S.revisions(spark, folder).collect()) == wanted(rows)
    last = max(rows, key=lambda f: (f["observed_at"], f["fact_id"]))
    seen = S.revisions(spark, folder).filter("status = 'active'").orderBy(F.desc("seen_at"), F.desc("fact_id")).first()
    late |= {"category": seen.category, "class_id": seen.class_id, "lon": seen.lon, "lat": seen.lat, "observed_at": seen.seen_at - timedelta(minutes=12), "raw_message_id": 5000, "place_id": None}
    S.advance(frame(spark, [late]), 6, folder, None, timedelta(minutes=10))
    after = S.revisions(spark, folder).filter("fact_id = 500").first()
    assert last and after.seen_at >= late["observed_at"] and (after.facts == 1 or after.seen_at > late["observed_at"])


def test_clock():
    wall, ten = datetime(2026, 9, 14, 12), timedelta(minutes=10)
    old = datetime(2022, 3, 1)
    assert S.event_clock(None, old, old - ten, wall, ten) == old - ten  # a backlog goes at its own pace
    assert S.event_clock(None, wall, wall - ten, wall, ten) == wall - ten
    assert S.event_clock(None, wall - 3 * ten, None, wall, ten) == wall - ten  # nothing waits: now
    assert S.event_clock(wall, old, old, wall, ten) == wall  # never back


def test_backlog_closes_what_live_reading_closes(spark, tmp_path):
    rows = sorted(crowd(8, 40), key=lambda f: f["observed_at"])
    parts = [rows[:15], rows[15:30], rows[30:]]
    for name, wall in (("live", lambda part: part[-1]["observed_at"] + timedelta(minutes=1)), ("backlog", lambda part: datetime(2030, 1, 1))):
        for n, part in enumerate(parts):
            S.advance(frame(spark, part), n, str(tmp_path / name), wall(part), timedelta(minutes=2))
        S.advance(frame(spark, []), 3, str(tmp_path / name), None, timedelta(minutes=2))
    live, backlog = (keyed(S.revisions(spark, str(tmp_path / n)).collect()) for n in ("live", "backlog"))
    assert live == backlog == wanted(rows)
