"""Counters and repeats batch by batch, model answers, versions of derived tables."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trackline.operators import answers, dedup, ratings
from trackline.sources import versions
from trackline.streaming import counters, repeats

T0 = datetime(2026, 9, 14, 20)


def feed(seed):
    """Facts; some come again as repeats of an earlier or later one, some of those then repeat another."""
    draw, rows, seq = random.Random(seed), [], 0
    at = {i: T0 + timedelta(minutes=3 * i + draw.random()) for i in range(120)}
    source = {i: draw.randint(1, 4) for i in at}
    for i in draw.sample(sorted(at), len(at)):
        rows.append((i, source[i], at[i], None, seq := seq + 1))
    for i in draw.sample(sorted(at), 50):
        for _ in range(draw.choice([1, 1, 2])):
            other = max(0, i - draw.randint(1, 5))
            rows.append((i, source[i], at[i], draw.choice([other, other, None]) if other != i else None, seq := seq + 1))
    return rows


def whole(spark, rows):
    latest = {}
    for r in rows:
        if r[0] not in latest or r[4] > latest[r[0]][4]:
            latest[r[0]] = r
    facts = spark.createDataFrame(list(latest.values()), counters.ROW)
    o = facts.select(F.col("fact_id").alias("duplicate_of"), F.col("source_id").alias("original_source"), F.col("observed_at").alias("original_at"))
    copies = facts.join(o, "duplicate_of").filter("source_id <> original_source").select(F.col("source_id").alias("copy_source"), "original_source", F.col("observed_at").alias("copy_at"), "original_at")
    daily = ratings.daily_stats(facts, copies)
    pairs = copies.groupBy(F.expr("to_date(from_utc_timestamp(copy_at, 'Europe/Kyiv'))").alias("day"), "copy_source", "original_source").agg(F.count("*").alias("n"), F.sum(F.greatest(F.lit(0), F.timestamp_diff("SECOND", F.col("original_at"), F.col("copy_at")))).cast("double").alias("delay_s"))
    return listed(daily), listed(pairs)


def listed(df):
    return sorted(str(sorted(r.asDict().items())) for r in df.collect())


@pytest.mark.parametrize("cuts", [[0, 200], [0, 30, 31, 120, 150, 200]])
def test_counters_equal_the_whole_table(spark, tmp_path, cuts):
    rows, folder = feed(3), str(tmp_path)
    frame = lambda part: spark.createDataFrame(part, counters.ROW)
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        counters.count(frame(rows[a:b]), n, folder)
    counters.count(frame(rows[cuts[-2] : cuts[-1]]), len(cuts) - 2, folder)  # the last batch is run again
    counters.count(frame(rows[5:40]), len(cuts), folder)  # old rows come again
    counters.count(frame([]), len(cuts) + 1, folder)
    daily, pairs = whole(spark, rows)
    assert listed(counters.daily(spark, folder)) == daily and listed(counters.pairs(spark, folder)) == pairs
    assert len(pairs) > 5


def test_repeats_in_a_stream(spark, tmp_path):
    rng, rows, now = random.Random(9), [], 0.0
    for i in range(160):
        now += rng.expovariate(1 / 0.8)
        rows.append((i, i // 2, 1, rng.choice(["a", "b"]), rng.choice([None, 1, 2]), rng.choice([None, 7]), 3, T0 + timedelta(minutes=now)))
    schema = "fact_id long, raw_message_id long, event_type int, category string, class_id int, place_id int, dest_id int, observed_at timestamp"
    for n, (a, b) in enumerate([(0, 50), (50, 51), (51, 110), (110, 160)]):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = repeats.mark(stream).writeStream.option("checkpointLocation", str(tmp_path / "c")).outputMode("append").format("parquet").start(str(tmp_path / "out"))
    query.processAllAvailable()
    query.stop()
    got = {r.fact_id: r.duplicate_of for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = spark.createDataFrame(rows, schema.replace("timestamp", "timestamp_ntz"))
    want = {r.fact_id: r.duplicate_of for r in dedup.mark_repeats(batch).collect()}
    assert got == want and sum(v is not None for v in want.values()) > 20


def test_model_answers(spark):
    said = lambda *facts: json.dumps({"facts": list(facts)})
    target = lambda level, code: {"level": level, "code": code}
    rows = [
        (1, said({"event_type": "TargetObserved", "target": target("Model", "X1"), "direction_deg": -90, "count": 3, "places": [{"name": "Суми", "role": "Destination"}, {"name": "Atlantis", "role": "Current"}, {"name": "  суми ", "role": "?"}]})),
        (2, said({"event_type": "AirRaidAlert", "segment": 9}, {"event_type": "Nonsense", "target": target("class", "uav"), "hedged": True}, {"event_type": "TargetObserved"}, {"target": target("class", "nothing")}, None, 5, "text")),
        (3, said({"event_type": "explosion_report", "count": "many", "direction_deg": "north", "places": "none", "target": None})), (4, '{"facts": [{"event_type": "TargetObs'), (5, "null"), (6, None), (7, ""), (8, '{"facts": {}}'), (9, "[1, 2]"), (10, said({"event_type": None, "target": {"code": "X1"}})),
    ]
    codes = spark.createDataFrame([("model", "x1", 11), ("class", "UAV", 5), ("category", "x1", 12)], "level string, code string, target_id int")
    names = spark.createDataFrame([("Суми", 7), ("СУМИ", 8), ("Київ", 9)], "name string, place_id int")
    segments = spark.createDataFrame([(1, 1), (2, 3)], "message_id int, n int")
    got = {(r.message_id, r.fact): r for r in answers.mapped(spark.createDataFrame(rows, "message_id int, answer string"), codes, names, segments).collect()}
    assert set(got) == {(1, 0), (2, 0), (2, 1), (3, 0)}
    r = got[1, 0]
    assert (r.event, r.target_id, r.confidence, r.direction_deg, r["count"], r.destination, r.current, r.unknown_places, r.unknown_codes) == ("target_observed", 11, 2, 270.0, 3, 7, 7, 1, 0)
    assert (got[2, 0].event, got[2, 0].target_id, got[2, 0].segment) == ("air_raid_alert", None, 2)
    assert (got[2, 1].event, got[2, 1].target_id, got[2, 1].confidence, got[2, 1].hedged) == ("target_observed", 5, 1, True)
    assert (got[3, 0].event, got[3, 0]["count"], got[3, 0].direction_deg, got[3, 0].current) == ("explosion", None, None, None)


def test_second_look(spark):
    rows = [(1, ["шахед"], T0), (2, ["шахеди", "летять"], T0), (3, ["погода"], T0), (4, ["ракета"], T0 - timedelta(hours=5)), (5, [], T0)]
    messages = spark.createDataFrame(rows, "message_id int, tokens array<string>, published_at timestamp_ntz")
    facts = spark.createDataFrame([(1,)], "message_id int")
    look = lambda hours: sorted(r.message_id for r in answers.second_look(messages, facts, ["шахед", "ракет"], F.lit(T0).cast("timestamp_ntz"), hours).collect())
    assert look(3) == [2] and look(0) == [2, 4]


def test_versions(spark, tmp_path):
    path, raw = str(tmp_path), spark.createDataFrame([(1, "alert", 5), (2, "text", 6), (3, "text", 7)], "id int, part string, v int")
    counted = lambda df: lambda parts: df.groupBy("part").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    read = lambda *a: {r.part: (r.n, r.total) for r in versions.read(spark, path, "sums", "n long, total long", *a).collect()}
    assert versions.current(spark, path) == 0 and read() == {}
    assert versions.rebuild(spark, path, {"sums": counted(raw), "other": counted(raw)}) == 1
    assert read() == {"alert": (1, 5), "text": (2, 13)}
    more = raw.union(spark.createDataFrame([(4, "alert", 9), (5, "text", 100)], raw.schema))
    assert versions.rebuild(spark, path, {"sums": counted(more)}, ["alert"]) == 2
    assert read() == {"alert": (2, 14), "text": (2, 13)} and read(1) == {"alert": (1, 5), "text": (2, 13)}

    def broken(parts):
        return more.withColumn("n", F.raise_error(F.lit("lost"))).select("n", F.col("v").cast("long").alias("total"), "part")

    with pytest.raises(Exception, match="lost"):
        versions.rebuild(spark, path, {"other": counted(more), "sums": broken})
    assert versions.current(spark, path) == 2 and read() == {"alert": (2, 14), "text": (2, 13)}
    assert versions.rebuild(spark, path, {"sums": counted(more.filter("part <> 'alert'"))}, ["alert"]) == 3
    assert read() == {"text": (2, 13)}
    assert versions.rebuild(spark, path, {"sums": counted(more.limit(0)), "other": counted(raw)}) == 4
    assert read() == {} and versions.read(spark, path, "other", "n long, total long").count() == 2
