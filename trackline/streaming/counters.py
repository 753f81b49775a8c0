"""Counters of sources by day, kept up to date batch by batch.

The feed is a table of facts with changes: a fact comes again, with a higher ``seq``, when it is found to repeat another one or
another one than before. Each batch writes what it changes, as signed numbers under its own batch number: what the touched facts
and their copies add up to now, less what they added up to before. So a late original moves the credit of its copy, rows
that come twice change nothing, a batch that is run again writes the same files, and the counters are the sum of all batches.

Rows are kept by day, and only the days of a batch and ``horizon`` days around them are read, as a repeat and its original are
minutes apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackline.functions import calendar as C
from trackline.operators.components import written

ROW = "fact_id long, source_id long, observed_at timestamp_ntz, duplicate_of long, seq long"
DAILY = "day date, source_id long, facts long, copies long, copied_by long, lead_s double"
PAIRS = "day date, copy_source long, original_source long, n long, delay_s double"


def _latest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("fact_id").agg(F.max(F.struct("seq", "source_id", "observed_at", "duplicate_of")).alias("r")).select("fact_id", "r.*")


def _shares(rows: DataFrame, touched: DataFrame, zone: str) -> DataFrame:
    """One row for each fact that is touched or repeats a touched one: its source and day, and the credit it gives."""
    day = lambda c: C.local_day(F.col(c), zone)
    mine = rows.join(touched, "fact_id", "left_semi").unionByName(rows.join(touched.select(F.col("fact_id").alias("duplicate_of")), "duplicate_of", "left_semi")).distinct()
    originals = rows.select(F.col("fact_id").alias("duplicate_of"), F.col("source_id").alias("original_source"), F.col("observed_at").alias("original_at"))
    both = mine.join(originals, "duplicate_of", "left").withColumn("copy", F.coalesce(F.col("original_source") != F.col("source_id"), F.lit(False)))
    lead = F.greatest(F.lit(0.0), F.timestamp_diff("SECOND", F.col("original_at"), F.col("observed_at")).cast("double"))
    return both.select("source_id", day("observed_at").alias("day"), "copy", "original_source", day("original_at").alias("original_day"), lead.alias("lead"))


def _daily(shares: DataFrame, sign: int) -> DataFrame:
    own = shares.select("day", "source_id", F.lit(sign).alias("facts"), (F.col("copy").cast("int") * sign).alias("copies"), F.lit(0).alias("copied_by"), F.lit(0.0).alias("lead_s"))
    return own.unionByName(shares.filter("copy").select(F.col("original_day").alias("day"), F.col("original_source").alias("source_id"), F.lit(0).alias("facts"), F.lit(0).alias("copies"), F.lit(sign).alias("copied_by"), (F.col("lead") * sign).alias("lead_s")))


def _pairs(shares: DataFrame, sign: int) -> DataFrame:
    return shares.filter("copy").select("day", F.col("source_id").alias("copy_source"), "original_source", F.lit(sign).alias("n"), (F.col("lead") * sign).alias("delay_s"))


def count(fresh: DataFrame, batch: int, folder: str, zone: str = C.ZONE, horizon: int = 1) -> None:
    """Take a batch of rows (``ROW``) in; for ``foreachBatch``."""
    spark = fresh.sparkSession
    day = C.local_day(F.col("observed_at"), zone)
    rows = fresh.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in ROW.split(", ")]).withColumn("day", day)
    rows.write.mode("overwrite").partitionBy("day").parquet(f"{folder}/rows/batch={batch}")
    span = rows.agg(F.min("day").alias("low"), F.max("day").alias("high")).first()
    if span.low is None:
        return
    near = F.col("day").between(F.date_sub(F.lit(span.low), horizon), F.date_add(F.lit(span.high), horizon))
    kept = written(spark.read.schema(f"{ROW}, batch int, day date").parquet(f"{folder}/rows").filter(near & (F.col("batch") <= batch)), "counter-rows")
    touched = kept.filter(F.col("batch") == batch).select("fact_id").distinct()
    now, before = (_shares(_latest(kept.filter(f"batch <= {n}").drop("batch", "day")), touched, zone) for n in (batch, batch - 1))
    add = lambda columns: [F.sum(c).cast("double" if c.endswith("_s") else "long").alias(c) for c in columns]
    for name, of, keys, sums in (("daily", _daily, ["day", "source_id"], ["facts", "copies", "copied_by", "lead_s"]), ("pairs", _pairs, ["day", "copy_source", "original_source"], ["n", "delay_s"])):
        delta = of(now, 1).unionByName(of(before, -1)).groupBy(*keys).agg(*add(sums))
        delta.filter(" or ".join(f"{c} <> 0" for c in sums)).write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """``day, source_id, facts, copies, copied_by, lead_s`` of all batches so far."""
    total = spark.read.schema(DAILY).parquet(f"{folder}/daily").groupBy("day", "source_id").agg(*[F.sum(c).alias(c) for c in ("facts", "copies", "copied_by", "lead_s")])
    return total.filter("facts <> 0 or copies <> 0 or copied_by <> 0")


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """``day, copy_source, original_source, n, delay_s`` of all batches so far."""
    total = spark.read.schema(PAIRS).parquet(f"{folder}/pairs").groupBy("day", "copy_source", "original_source").agg(F.sum("n").alias("n"), F.sum("delay_s").alias("delay_s"))
    return total.filter("n <> 0")
