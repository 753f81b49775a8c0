from datetime import datetime, timedelta

from pyspark.sql import functions as F

from trackline.operators import analytics as R

T0 = datetime(2026, 9, 1)


def test_listings(spark):
    rows = [(i, i % 3, (i + 1) % 3, T0 + timedelta(minutes=i), 1 + i % 2, i % 5 == 0) for i in range(300)]
    pairs = spark.createDataFrame(rows, "copy long, copy_source int, original_source int, copy_at timestamp_ntz, kind int, is_primary boolean")
    assert [r["copy"] for r in R.recent_copies(pairs, limit=3).collect()] == [299, 298, 297]
    assert R.recent_copies(pairs, limit=999).count() == 200 and R.recent_copies(pairs, limit=0).count() == 1
    some = R.recent_copies(pairs, source=1, kind=2, primary=True).collect()
    assert some and all(1 in (r.copy_source, r.original_source) and r.kind == 2 and r.is_primary for r in some)
    assert R.latest_of_each(pairs, ["copy_source"], "copy_at", "copy", 4).count() == 12


def test_periods_and_buckets(spark):
    now = datetime(2026, 9, 5, 10, 20)
    assert R.report_buckets(now, "24h") == (datetime(2026, 9, 4, 11), datetime(2026, 9, 5, 11), "hour")
    assert R.report_buckets(now, "7d") == (datetime(2026, 8, 29, 10, 20), now, "day")
    assert R.report_period(T0, 0) == (T0, T0 + timedelta(days=1)) and R.report_period(T0, 400)[0] == T0 - timedelta(days=89)
    df = spark.createDataFrame([(T0 - timedelta(days=9),), (T0,), (T0 + timedelta(hours=5),), (None,)], "at timestamp_ntz")
    got = [r.b for r in df.select(R.bucket_of(F.col("at"), [T0 + timedelta(hours=4), T0]).alias("b")).collect()]
    assert got == [T0, T0, T0 + timedelta(hours=4), T0]


def test_alert_pairs_across_slices(spark):
    from trackline.operators import intervals

    rows = [(1, T0, "open", 1), (1, T0 + timedelta(days=3), "close", 2), (1, T0 + timedelta(days=3), "open", 3), (1, T0 + timedelta(days=9), "close", 4), (2, T0, "open", 5), (1, T0 + timedelta(days=20), "open", 6)]
    df = spark.createDataFrame(rows, "place_id int, at timestamp_ntz, kind string, id int")
    got = sorted((r.place_id, r.start, r.end or datetime.max) for r in intervals.pair_events(df, "place_id", "at", F.col("kind") == "open", F.col("kind") == "close", ["id"]).collect())
    day = lambda n: T0 + timedelta(days=n)
    assert got == [(1, T0, day(3)), (1, day(3), day(9)), (1, day(20), datetime.max), (2, T0, datetime.max)]


def test_one_place_with_many_events(spark):
    from trackline.operators import intervals

    df = spark.range(300_000).select(F.lit(1).alias("place_id"), F.expr("timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("at"), (F.col("id") % 2 == 0).alias("o"), "id")
    r = intervals.pair_events(df, "place_id", "at", F.col("o"), ~F.col("o"), ["id"]).agg(F.count("*").alias("n"), F.max(F.timestamp_diff("SECOND", F.col("start"), F.col("end"))).alias("s")).first()
    assert (r.n, r.s) == (150_000, 1)
