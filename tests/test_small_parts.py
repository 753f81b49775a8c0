"""Parts of reports and feeds: exact percentiles, place search, poll differences, pushes, explanations."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackline.functions import text as T
from trackline.operators import snapshot, targets
from trackline.operators.percentiles import exact
from trackline.sources import feeds
from trackline.streaming import jobs

T0 = datetime(2026, 9, 14, 12)


def test_percentiles(spark):
    draw = random.Random(2)
    rows = [(draw.choice([1, 1, 1, 2, None]), draw.choice([None, draw.randint(0, 50) / 4, draw.random()])) for _ in range(3000)] + [(3, 7.5), (4, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r.k: (r.a, r.b, r.c) for r in exact(df, ["k"], "v", {"a": 0.5, "b": 0.9, "c": 0.0}).collect()}
    want = {k: [v for i, v in rows if i == k and v is not None] for k in (1, 2, 3, None)}
    assert set(got) == set(want)
    for k, values in want.items():
        assert got[k] == pytest.approx(tuple(np.percentile(values, [50, 90, 0])))
    whole = exact(df, [], "v", {"a": 0.25}).collect()
    assert len(whole) == 1 and whole[0].a == pytest.approx(np.percentile([v for _, v in rows if v is not None], 25))
    assert exact(df.limit(0), ["k"], "v", {"a": 0.5}).count() == 0


def test_place_search(spark):
    places = spark.createDataFrame([(1, "Суми", "city", 260_000), (2, "Сумська  область", "region", 0), (3, "Сумівка", "village", 900), (4, "СУМИ’", "town", 5_000), (5, "Сумський край", "area", 1), (6, "Київ", "city", 3_000_000)], "place_id int, name string, level string, population int")
    found = lambda *a: [r.place_id for r in snapshot.search_places(places, *a).collect()]
    assert found(" Сум") == [1, 4, 3, 2] and found("сумська область") == [2] and found("с") == [] and found("су", 0) == [1]


def test_poll_differences(spark):
    ids = lambda *i: spark.createDataFrame([(x,) for x in i], "alert_id int")
    at = F.lit(T0).cast("timestamp_ntz")
    diff = lambda *a: {(r.alert_id, r.kind) for r in feeds.snapshot_changes(*a).collect()}
    assert diff(ids(1, 2), ids(2, 3), at) == {(1, "alert.finished"), (3, "alert.started")}
    assert diff(ids(1, 2), ids(2, 3, 9), at, ids(2, 7, 9)) == {(1, "alert.finished"), (3, "alert.started"), (7, "alert.finished"), (9, "alert.started")}
    assert diff(ids(1), ids(1), at, ids(1)) == set()


def test_stale_changes_are_counted(spark, tmp_path):
    rows = [("track", T0 - timedelta(minutes=m), m) for m in (1, 30, 200)] + [("other", T0, 0)]
    spark.createDataFrame(rows, "kind string, at timestamp, m int").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("kind string, at timestamp, m int").parquet(str(tmp_path / "in"))
    pushed, stale = [], []
    query = jobs.push_changes(stream, lambda: T0, {"track": 3600}, lambda df, n: pushed.extend(r.m for r in df.collect()), str(tmp_path / "c"), stale)
    query.awaitTermination()
    assert sorted(pushed) == [1, 30] and stale == [(0, 2)]
    messages = spark.createDataFrame([(1, T0 - timedelta(seconds=31)), (2, T0 - timedelta(seconds=29))], "id int, received_at timestamp_ntz")
    assert [r.id for r in jobs.settled(messages, F.lit(T0).cast("timestamp_ntz")).collect()] == [1]


def test_explanations(spark):
    place = {"place_id": 4, "name": "Київ", "level": "city", "lon": 30.5, "lat": 50.3, "radius_km": 20.0, "parent_id": None, "quadrant_deg": None, "text": "києва"}
    schema = f"language string, rule string, launch boolean, target_code string, target_level string, target_text string, hedged boolean, compass_deg double, current {targets.PLACE}, origin {targets.PLACE}, destination {targets.PLACE}"
    rows = [("uk", "event:x", None, "UAV", "class", "бпла", True, 90.0, place, None, place), ("ru", None, True, None, None, None, None, None, None, None, None)]
    a, b = (json.loads(r.metadata) for r in targets.explained(spark.createDataFrame(rows, schema)).collect())
    assert a["rules"] == ["event:x"] and a["target"] == {"code": "UAV", "level": "class", "text": "бпла", "hedged": True} and [p["role"] for p in a["places"]] == ["current", "destination"] and a["direction"]["deg"] == 90.0
    assert b == {"language": "ru", "rules": [], "launch": True, "places": []}


def test_signature_of_a_long_text(spark):
    hashes = [(h * 0x9E3779B97F4A7C15) % (1 << 64) - (1 << 63) for h in range(30_000)]
    df = spark.createDataFrame([(hashes,), (hashes[:100],), (hashes[:8192],)], "v array<long>").select(T.minhash(F.col("v")).alias("s"))
    long, short, piece = (r.s for r in df.collect())
    assert len(long) == 64 and all(a <= c <= b for a, b, c in zip(long, short, piece, strict=True))


def test_names_of_communities(spark):
    names = {"Вовчанська територіальна громада": "вовчанська", "Вовчанська  ТГ": "вовчанська", "Вовчанська ОТГ": "вовчанська", "Громадське": "громадське", "Бахмутський район": "бахмутський район"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.k for r in df.select(T.admin_key(F.col("n")).alias("k")).collect()] == list(names.values())
    variants = {r.n: set(r.v) for r in df.sparkSession.createDataFrame([("Чернігів",), ("Київ",), ("Біла Церква",), ("Подільський",)], "n string").select("n", T.name_variants(F.col("n")).alias("v")).collect()}
    assert "чернігов" in variants["Чернігів"] and "києв" in variants["Київ"] and "біла церкв" in variants["Біла Церква"] and "поділь" in variants["Подільський"]


def test_signs_and_token_spans(spark):
    texts = {"🛵🛵 ➡️ Суми": "шахед шахед курсом на суми", "🟢Відбій ✈️!": "відбій відбій авіація !", "↗️ ракета 🟡": "у північно-східному напрямку ракета", "plain text": "plain text"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [" ".join(r.c.split()) for r in df.select(T.clean(F.col("t")).alias("c")).collect()] == list(texts.values())
    lines = ["х-101/555 летить, летить на ле-ле.", "", "  a b  a.b-c' d", None, "ёж — їжак"]
    rows = spark.createDataFrame([(t,) for t in lines], "t string").select("t", T.token_spans(F.col("t")).alias("s"), T.tokens(F.col("t")).alias("k")).collect()
    for r in rows:
        assert (r.s is None) == (r.t is None)
        if r.t is not None:
            assert [x.token for x in r.s] == r.k and all(r.t[x.start : x.end] == x.token for x in r.s) and all(a.end <= b.start for a, b in zip(r.s, r.s[1:]))


def test_relatives_on_a_map(spark):
    from trackline.operators import fixes

    links = [(1, 2, 10 + i, 0.5 - i / 10) for i in range(5)] + [(1, 10, 20 + i, 0.2 - i / 100) for i in range(4)] + [(1, 20, 30, 0.19), (1, 14, 40, 0.9), (1, 2, 50, 0.01), (1, 2, 10, 0.5), (2, 10, 60, 0.5)]
    df = spark.createDataFrame(links, "head int, from_id int, to_id int, path double")
    ancestors = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "head int, fact_id int")
    got = {(r.head, r.from_id, r.to_id, r.off_ancestor) for r in fixes.relatives_shown(df, ancestors).collect()}
    assert got == {(1, 2, 10, True), (1, 2, 11, True), (1, 2, 12, True), (1, 10, 20, False), (1, 10, 21, False), (1, 10, 22, False)}


def test_batches_of_texts_are_worked_on_in_slices():
    import pyarrow as pa

    from trackline.functions import text as T

    seen = []
    work = lambda texts: seen.append(texts) or pa.array([t and t[:3] for t in texts], pa.string())
    texts = ["x" * 5000, None, ""] * 1000
    assert T.in_slices(pa.array(texts), work).to_pylist() == [t and t[:3] for t in texts]
    assert max(map(len, seen)) <= T.SLICE_ROWS and max(sum(len(t or "") for t in part) for part in seen) <= 2 * T.SLICE_BYTES
    assert T.in_slices(pa.array([], pa.string()), work).to_pylist() == []
    assert T.in_slices(pa.array(["y" * 3 * T.SLICE_BYTES] * 2), work).to_pylist() == ["yyy"] * 2 and len(seen[-1]) == 1
