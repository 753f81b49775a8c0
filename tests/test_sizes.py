"""Faults that showed on larger tables only."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from trackline.operators import copies, links, stats, tracks
from trackline.plans import analytics, graphs

T0 = datetime(2024, 1, 1)


def test_silence_counts_to_the_microsecond(spark):
    now = datetime(2024, 1, 31)
    silent = {1: timedelta(hours=6), 2: timedelta(hours=6, microseconds=1), 3: timedelta(hours=6, microseconds=-1), 4: None}
    sources = spark.createDataFrame([(i,) for i in silent], "source_id long")
    last = spark.createDataFrame([(i, now - s) for i, s in silent.items() if s], "source_id long, last_at timestamp_ntz")
    got = {r.source_id: r.state for r in stats.health(sources, last, F.expr("timestamp_ntz'2024-01-31 00:00:00'"), 7200.0).collect()}
    assert got == {1: "ok", 2: "stale", 3: "ok", 4: "idle"}


def test_earliest_told_against_all_pairs(spark):
    rng, hour = random.Random(3), timedelta(hours=1)
    rows = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["a", "b", None]), T0 + timedelta(hours=rng.choice([0, 23, 24, 25]), minutes=15 * rng.randrange(8), microseconds=rng.choice([0, 0, 1])), rng.randrange(9)) for i in range(400)]
    rows += rows[:40]
    want = {}
    for i, s, k, at, n in rows:
        fits = [(t, j, z, m) for j, z, q, t, m in rows if k is not None and q == k and s is not None and z is not None and z != s and at - hour <= t < at]
        if fits:
            want[i, s, at, n] = min(fits)
    facts = spark.createDataFrame(rows, "fact_id long, source_id long, kind string, observed_at timestamp_ntz, n int")
    got = {(r.copy, r.copy_source, r.copy_at, r.n): tuple(r.x) for r in copies.earliest_told(facts, ["kind"], ["n"]).collect()}
    assert got == want and len(want) > 150


def test_copies_of_facts_meet_without_pairs(spark):
    for rows in (analytics._pairs(spark, "/root/testdata/sf0.001"), graphs.copies_with_ids(spark, "/root/testdata/sf0.001")):
        assert "Join" not in rows._jdf.queryExecution().toString()


LINKABLE = "fact_id long, raw_message_id long, category string, observed_at timestamp_ntz, win_min int, v_max double, v_cruise double, lon double, lat double, slack_km double, direction_deg double, place_id int, dest_id int, model_id int, family_id int, class_id int"


def test_links_meet_near_facts_only(spark):
    rng = random.Random(8)
    rows = [(i, i, rng.choice(["uav", "jet"]), T0 + timedelta(minutes=rng.uniform(0, 90)), rng.choice([15, 30]), rng.choice([200.0, 600.0, None]), 175.0, rng.choice([179.9, -179.9, 30.0]) + rng.uniform(-3, 3), rng.choice([0.0, 60.0]) + rng.uniform(-2, 2), rng.choice([5.0, 40.0]), rng.choice([None, 90.0]), rng.randrange(20), None, None, None, 1) for i in range(200)]
    rows = [(*r[:7], (r[7] + 180) % 360 - 180, *r[8:]) for r in rows]
    for some in (rows, [r for r in rows if r[5] is not None]):
        facts = spark.createDataFrame(some, LINKABLE)
        n, c = facts.select(F.struct(*facts.columns).alias("n")), facts.select(F.struct(*facts.columns).alias("c"))
        dt = F.timestamp_diff("MICROSECOND", F.col("c.observed_at"), F.col("n.observed_at")) / 60e6
        every = n.crossJoin(c).withColumn("dt", dt).filter("n.category = c.category and n.fact_id <> c.fact_id and dt > 0 and dt <= n.win_min")
        want = {(r.from_id, r.to_id): r.weight for r in links.weighted(every).collect()}
        got = {(r.from_id, r.to_id): r.weight for r in links.weighted(links.candidate_pairs(facts, 120)).collect()}
        assert got == want and len(want) > 50
    far = [(i, i, "uav", T0 + timedelta(seconds=i), 30, 200.0, 175.0, 5.0 * (i % 60), 10.0 * (i // 60), 10.0, None, i, None, None, None, 1) for i in range(240)]
    assert links.candidate_pairs(spark.createDataFrame(far, LINKABLE), 120).count() == 0


def test_links_pass_facts_not_pairs(spark, monkeypatch):
    """Against one pass in order over all weights; what goes into the slices is facts, at most twice each."""
    rng, rule = random.Random(4), links.Rule()
    rows = [(i, i // 2, rng.choice(["uav", "jet"]), T0 + timedelta(minutes=rng.choice([rng.uniform(0, 150), 60])), rng.choice([15, 30]), rng.choice([200.0, 600.0, None]), 175.0, 30.0 + rng.choice([0.0, 0.5, 1.0]), 50.0, rng.choice([5.0, 40.0, None]), rng.choice([None, 90.0]), rng.choice([None, 1, 2]), rng.choice([None, 1, 2]), rng.choice([None, 1, 2]), rng.choice([None, 1, 2]), rng.choice([None, 1, 2])) for i in range(250)]
    facts = spark.createDataFrame(rows, LINKABLE)
    by_successor = {}
    for r in links.weighted(links.candidate_pairs(facts, 40)).filter(F.col("weight") >= rule.least).collect():
        by_successor.setdefault((r.observed_at, r.to_id), []).append((r.from_id, r.weight))
    left, want = {}, {}
    for (_, n), found in sorted(by_successor.items()):
        rest = {c: 0 if left.get(c, 1.0) <= rule.exhausted else left.get(c, 1.0) for c, _ in found}
        weights = sorted((-w * rest[c], c) for c, w in found)
        good = [(c, -w) for w, c in weights if -w >= rule.least and -w >= rule.of_best * -weights[0][0]][: rule.most]
        scale = max(1.0, sum(w for _, w in good))
        for c, w in good:
            want[c, n] = int(w / scale * 1000 + 0.5) / 1000
            left[c] = round(max(0.0, rest[c] - want[c, n]), 3)
    seen, real = [], links.passed
    monkeypatch.setattr(links, "passed", lambda rows, *a: (seen.append(rows.count()), real(rows, *a))[1])
    monkeypatch.setattr(links, "PAIRS", 100)
    assert {(r.from_id, r.to_id): r.probability for r in links.link(facts, 40).collect()} == want and len(want) > 200
    assert seen[0] <= 2 * len(rows)


def test_source_statistics_pass_messages_once(spark, monkeypatch):
    """Against a count by hand; what is counted comes from one pass over the rows, not joined with itself."""
    rng = random.Random(5)
    lag = lambda: rng.choice([None, timedelta(seconds=-1), timedelta(seconds=rng.randrange(90)), timedelta(seconds=100), timedelta(hours=9)])
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, 1, 2, 3]), rng.choice(["F", "O", None]), T0, (d := lag()) and T0 + d, rng.choice([None, 1.0, 2.0, 9.0])) for _ in range(300)]
    rows += [(900, 4, "O", T0, None, 1.0)]
    hits = {r[0] for r in rows if r[0] is not None and (r[5] or 0) > 5}
    want = {}
    for source in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == source]
        lags = sorted(s for r in own if r[4] is not None and 0 <= (s := (r[4] - r[3]).total_seconds()) < 100)
        want[source] = (len(own), sum(r[2] == "F" for r in own), sum(r[0] in hits for r in own), (lags[(len(lags) - 1) // 2] + lags[len(lags) // 2]) / 2 if lags else None)
    plans, real = [], stats.written
    monkeypatch.setattr(stats, "written", lambda df, name: (plans.append(df._jdf.queryExecution().toString()), real(df, name))[1])
    worked = spark.createDataFrame(rows, "message_id long, source_id int, status string, received_at timestamp_ntz, processed_at timestamp_ntz, amount double")
    got = {r.source_id: (r.messages, r.processed, r.with_facts, r.median_lag_s) for r in stats.source_stats(worked, F.col("amount") > 5, 100.0).collect()}
    assert got == want and plans and not any("Join" in p for p in plans)


def test_tracks_write_events_once(spark, monkeypatch):
    """Against one pass in order; besides the events themselves only cells and classes are written, and no fact looks itself up by its id."""
    rng = random.Random(9)
    fields = [f.name for f in tracks.events(spark.range(0)).schema]
    rows = [dict.fromkeys(fields) | {"fact_id": i, "raw_message_id": i, "source_id": rng.randrange(5), "event": "observed", "category": rng.choice(["uav", "jet"]), "observed_at": T0 + timedelta(minutes=2 * i), "lon": 30.0 + rng.randrange(4), "lat": 48.0 + rng.choice([0, 20]), "accuracy_km": 10.0, "confidence": 1, "speed_kmh": 200.0, "window_min": 30.0} for i in range(600)]
    for r in rows[::9]:
        r.update(lon=None, lat=None, dest_lon=31.0, dest_lat=48.0, dest_km=20.0)
    board, want = tracks.Board(), []
    for r in rows:
        want += board.take(r)
    want += board.expire(rows[-1]["observed_at"])
    sizes, real = {}, tracks.written
    monkeypatch.setattr(tracks, "written", lambda df, name: (sizes.__setitem__(name, sizes.get(name, 0) + df.count()), real(df, name))[1])
    made = tracks.tracks(spark.createDataFrame([tuple(r[f] for f in fields) for r in rows], tracks.EVENT))
    assert sizes.pop("track-events") == len(rows) and sum(sizes.values()) < len(rows) / 2
    assert not any("Join" in line and "fact_id" in line for line in made._jdf.queryExecution().toString().splitlines())
    named = lambda r: (r["track_id"], r["fact_id"] or 0, r["status"], r["revision_at"], r["facts"], r["lon"], r["lat"])
    assert sorted(map(named, made.collect())) == sorted(map(named, want)) and len(want) > 600
