from datetime import datetime, timedelta

from pyspark.sql import functions as F

from trackline.operators import copies as C
from trackline.sources import feeds
from trackline.streaming import jobs

T0 = datetime(2026, 9, 1)


def run(stream, spark, folder, mode="append"):
    out = str(folder / "out")
    jobs.into_batches(stream, lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(out), str(folder / "checkpoint"), mode).awaitTermination(120)
    return spark.read.parquet(out)


def test_pairs_equal_batch(spark, tmp_path):
    text = "a message of some length that two channels repeat within minutes of each other word for word "
    rows = [(i, f"s{i % 3}", text + "and so on" * (i % 2) if i % 4 else f"{text[::-1]} {i}", T0 + timedelta(minutes=i)) for i in range(24)]
    df = spark.createDataFrame(rows, "raw_message_id long, source string, text string, published_at timestamp")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    got = run(jobs.near_duplicates(jobs.files(spark, str(tmp_path / "in"), df.schema, 1)), spark, tmp_path)
    batch = C.candidates(C.fingerprints(df))
    key = lambda d: {(r.copy, r.original) for r in d.collect()}
    assert key(got) == key(batch) and key(batch)
    assert got.count() == len(key(got))  # each pair once


def test_alert_states_in_any_order(spark, tmp_path):
    at = lambda h: T0 + timedelta(hours=h)
    rows = [(1, 7, "finished", at(5), None, None, 2), (1, 7, "started", at(1), None, "yellow", 3), (1, 7, "started", at(2), at(9), "red", 4), (2, 7, "started", at(3), None, None, 1)]
    schema = "source_id int, alert_id int, kind string, at timestamp, finished_at timestamp, level string, arrival long"
    for i, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    stream = spark.readStream.schema(spark.createDataFrame(rows, schema).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    got = run(jobs.alert_states(stream), spark, tmp_path, "update")
    last = {r.source_id: (r.start, r.end, r.level) for r in got.orderBy("batch").collect()}
    assert last == {1: (at(1), at(5), "red"), 2: (at(3), None, None)}


def test_windows_and_replaced_days(spark, tmp_path):
    rows = [(i, "ab"[i % 2], T0 + timedelta(minutes=7 * i)) for i in range(60)]
    df = spark.createDataFrame(rows, "fact_id long, category string, observed_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    got = run(jobs.counts_per_window(jobs.files(spark, str(tmp_path / "in"), df.schema), "1 hour"), spark, tmp_path, "complete")
    want = df.groupBy(F.date_trunc("hour", "observed_at").alias("start"), "category").agg(F.count("*").alias("n"))
    assert {tuple(r)[:3] for r in got.select("start", "category", "n").collect()} == {tuple(r) for r in want.collect()}
    day = lambda n, v: spark.createDataFrame([(n, v)], "day string, v int")
    path = str(tmp_path / "days")
    jobs.replace_days(spark, day("1", 1).union(day("2", 1)), path)
    jobs.replace_days(spark, day("2", 9), path)
    assert {(r.day, r.v) for r in spark.read.parquet(path).collect()} == {(1, 1), (2, 9)}


def test_feeds(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "alert_id int")
    at = F.lit(T0)
    got = {(r.alert_id, r.kind) for r in feeds.snapshot_changes(ids(1, 2), ids(2, 3), at).collect()}
    assert got == {(1, "alert.finished"), (3, "alert.started")}
    df = spark.createDataFrame([("12:e99", "channel 77"), ("13", "someone")], "m string, f string")
    rows = df.select(feeds.post_key(F.col("m")).alias("p"), feeds.is_edit(F.col("m")).alias("e"), feeds.forwarded_channel(F.col("f")).alias("c")).collect()
    assert [tuple(r) for r in rows] == [("12", True, 77), ("13", False, None)]
    polls = spark.createDataFrame([(1, T0, True, None, None), (1, T0 + timedelta(1), False, None, "x"), (1, T0 + timedelta(2), False, None, "y")], "source_id int, at timestamp, ok boolean, message_at timestamp, error string")
    r = feeds.poll_health(polls).first()
    assert (r.failures, r.error, r.last_success_at) == (2, "y", T0)
    log = spark.createDataFrame([("f", i, v) for i, v in enumerate(["2026-01-01 10:00 [ERR] a", "  more", "2026-01-01 10:01 [INF] b"])], "file string, line_no int, value string")
    assert [r.entry for r in feeds.log_entries(log, "ERR").collect()] == ["2026-01-01 10:00 [ERR] a\n  more"]
    raw = spark.createDataFrame([('{"messageId": 5, "views": 0, "text": "hi", "editDate": "2026-01-01T00:00:00Z"}',)], "raw_payload string")
    m = feeds.message_rows(feeds.message_columns(raw)).first()
    assert m.views is None and m.source_message_id == "5:e1767225600"
