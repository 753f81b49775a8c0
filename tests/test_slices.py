"""Sliced passes against one pass in order, on streams that never fall silent."""

import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from trackline.operators import dedup, links

T0 = datetime(2026, 9, 14)


def test_repeats_over_many_slices(spark):
    rng = random.Random(5)
    rows, now = [], 0.0
    for i in range(1500):
        now += rng.expovariate(1 / 1.1)
        rows.append((i, i // 2, 1, rng.choice(["a", "b"]), rng.choice([None, 1, 2]), rng.choice([None, 7]), 3, T0 + timedelta(minutes=now)))
    schema = "fact_id long, raw_message_id long, event_type int, category string, class_id int, place_id int, dest_id int, observed_at timestamp_ntz"
    got = {r.fact_id: r.duplicate_of for r in dedup.mark_repeats(spark.createDataFrame(rows, schema)).collect()}
    want, originals = {}, []
    for f in rows:
        fits = (o for o in originals if o[3] == f[3] and o[5] == f[5] and o[1] != f[1] and f[7] - o[7] <= timedelta(minutes=3) and (None in (f[4], o[4]) or f[4] == o[4]))
        want[f[0]] = next((o[0] for o in fits), None)
        if want[f[0]] is None:
            originals.append(f)
    assert got == want and sum(v is not None for v in want.values()) > 200
    empty = dedup.mark_repeats(spark.createDataFrame([], schema))
    assert empty.count() == 0 and "duplicate_of" in empty.columns


def test_links_over_many_slices(spark):
    schema = "fact_id long, raw_message_id long, category string, observed_at timestamp_ntz, win_min int, v_max double, v_cruise double, lon double, lat double, slack_km double, direction_deg double, place_id int, dest_id int, model_id int, family_id int, class_id int"
    rows = [(i, i, "uav", T0 + timedelta(minutes=4 * i), 20, 200.0, 175.0, 30.0, 50.0, 10.0, None, 1, None, None, None, 1) for i in range(200)]
    facts = spark.createDataFrame(rows, schema)
    fine = {(r.from_id, r.to_id): r.probability for r in links.link(facts, 20).collect()}
    whole = {(r.from_id, r.to_id): r.probability for r in links.link(facts, 100_000).collect()}
    assert fine == whole and len(fine) >= 199
    given = {}
    for (a, _), p in fine.items():
        given[a] = given.get(a, 0) + p
    assert max(given.values()) <= 1.001


FACT = "fact_id long, raw_message_id long, event_type int, category string, class_id int, place_id int, dest_id int, observed_at timestamp_ntz"


def test_equal_facts_have_one_mark(spark):
    one, other = ((i, i, 1, "a", None, 7, None, T0 + timedelta(hours=3, minutes=m)) for i, m in ((1, 55), (2, 65)))
    for rows in ([one, other], [one, one, other], [one, other, other], [one, one, other, other, other]):
        got = [(r.fact_id, r.duplicate_of) for r in dedup.mark_repeats(spark.createDataFrame(rows, FACT), 30).collect()]
        assert sorted(got, key=str) == sorted(((i, 1 if i == 2 else None) for i, *_ in rows), key=str)


def test_rounds_do_not_grow_with_slices(spark, monkeypatch):
    """A fact every 25 minutes and a window of 30: every other one is a repeat, for ever."""
    from trackline.operators import slices

    count, written = [0], slices.written
    monkeypatch.setattr(slices, "written", lambda df, name: (count.__setitem__(0, count[0] + (name in ("slice-fresh", "slices-met"))), written(df, name))[1])
    taken = []
    for n in (57, 345):
        rows = [(i, i, 1, "a", None, 7, None, T0 + timedelta(minutes=25 * i)) for i in range(n)]
        count[0] = 0
        got = {r.fact_id: r.duplicate_of for r in dedup.mark_repeats(spark.createDataFrame(rows, FACT), 30).collect()}
        assert got == {i: i - 1 if i % 2 else None for i in range(n)}
        taken.append(count[0])
    assert taken[1] <= taken[0] + 4 and taken[1] <= 14


def test_dense_facts_take_few_rounds(spark, monkeypatch):
    """The denser the facts, the longer ways stay apart; slices of any length give one pass in order, long ones in few rounds."""
    from trackline.operators import slices

    rng = random.Random(7)
    rows = [(i, i // 2, 1, "a", rng.choice([None, 1, 2]), 7, None, T0 + timedelta(seconds=rng.randrange(3 * 86400))) for i in range(2500)]
    want, originals = {}, []
    for f in sorted(rows, key=lambda r: (r[7], r[0])):
        fits = (o for o in originals if o[1] != f[1] and f[7] - o[7] <= timedelta(minutes=30) and (None in (f[4], o[4]) or f[4] == o[4]))
        want[f[0]] = next((o[0] for o in fits), None)
        if want[f[0]] is None:
            originals.append(f)
    rounds, written = [], slices.written
    monkeypatch.setattr(slices, "written", lambda df, name: (rounds.append(name == "slice-fresh"), written(df, name))[1])
    facts = spark.createDataFrame(rows, FACT)
    for most, few in ((None, 2), (600, 6)):
        if most:
            monkeypatch.setattr(dedup, "SLICE_ROWS", most)
        rounds.clear()
        assert {r.fact_id: r.duplicate_of for r in dedup.mark_repeats(facts, 30).collect()} == want
        assert sum(rounds) <= few


LINKABLE = "fact_id long, raw_message_id long, category string, observed_at timestamp_ntz, win_min int, v_max double, v_cruise double, lon double, lat double, slack_km double, direction_deg double, place_id int, dest_id int, model_id int, family_id int, class_id int"


def test_dense_links_take_one_round(spark, monkeypatch):
    """Slices of any length give the links of one pass in order; long ones, in one round."""
    from trackline.operators import slices

    rng, rule = random.Random(9), links.Rule()
    rows = [(i, i // 2, "uav", T0 + timedelta(minutes=rng.uniform(0, 700)), rng.choice([20, 30]), 200.0, 175.0, 30.0 + rng.choice([0.0, 0.3]), 50.0, 10.0, rng.choice([None, 90.0]), rng.choice([None, 1, 2]), None, None, None, rng.choice([1, 2, 3])) for i in range(900)]
    facts = spark.createDataFrame(rows, LINKABLE)
    by_successor = {}
    for r in links.weighted(links.candidate_pairs(facts, 120)).filter(F.col("weight") >= rule.least).collect():
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
    rounds, written = [0], slices.written
    monkeypatch.setattr(slices, "written", lambda df, name: (rounds.__setitem__(0, rounds[0] + (name == "slice-fresh")), written(df, name))[1])
    assert {(r.from_id, r.to_id): r.probability for r in links.link(facts, 60).collect()} == want and len(want) > 800
    assert rounds[0] <= 2  # the data may lie on both sides of a slice's border
    monkeypatch.setattr(links, "SLICE_ROWS", 1)
    assert {(r.from_id, r.to_id): r.probability for r in links.link(facts, 60).collect()} == want


def test_spent_predecessors_are_not_weighed():
    """However many facts a window holds, a successor meets those that have something left, and a block of neighbours."""
    n, rule = 3000, links.Rule()
    same = dict.fromkeys(links.WEIGHED, 1.0) | {"v_max": 200.0, "v_cruise": 175.0, "slack_km": 10.0}
    facts = pd.DataFrame({"key": "a", "fact_id": range(n), "raw_message_id": range(n), "at": [i * 100_000 for i in range(n)], "win_min": 30, "told": False, **same})
    met = sum(len(i) for i, _, _ in links._pairs(facts, facts["fact_id"].to_numpy(), [0.0] * n, rule))
    assert met == sum(i % links.BLOCK for i in range(n))
    whole = sum(len(i) for i, _, _ in links._pairs(facts, facts["fact_id"].to_numpy(), [1.0] * n, rule))
    assert whole == n * (n - 1) // 2
