"""Copies between sources over facts, source ratings and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackline.functions import calendar as C
from trackline.operators.components import connected


def daily_stats(facts: DataFrame, repeats: DataFrame, zone: str = C.ZONE) -> DataFrame:
    """``day, source_id, facts, copies, copied_by, lead_s``: two totals joined in full, as either side may be absent.

    A copy counts on its own day, being copied and the lead (not below zero) on the original's.
    ``repeats``: copy_source, original_source, copy_at, original_at of facts repeated by another source.
    """
    told = facts.groupBy(C.local_day(F.col("observed_at"), zone).alias("day"), "source_id").agg(F.count("*").alias("facts"))
    lead = F.greatest(F.lit(0.0), F.timestamp_diff("SECOND", F.col("original_at"), F.col("copy_at")).cast("double"))
    made = repeats.groupBy(C.local_day(F.col("copy_at"), zone).alias("day"), F.col("copy_source").alias("source_id")).agg(F.count("*").alias("copies"))
    got = repeats.groupBy(C.local_day(F.col("original_at"), zone).alias("day"), F.col("original_source").alias("source_id")).agg(F.count("*").alias("copied_by"), F.sum(lead).alias("lead_s"))
    every = told.join(made, ["day", "source_id"], "full").join(got, ["day", "source_id"], "full")
    return every.fillna(0, ["facts", "copies", "copied_by"]).fillna(0.0, ["lead_s"])


def rating(facts: Column, copies: Column, copied_by: Column) -> Column:
    """0.7 originality + 0.3 influence, three decimals; null without facts."""
    return F.when(facts > 0, F.round(0.7 * (1 - copies / facts) + 0.3 * F.least(F.lit(1.0), copied_by / facts), 3))


def over_days(daily: DataFrame) -> DataFrame:
    """Rating of each source over several days, days weighted by their facts."""
    r = daily.withColumn("rating", rating(F.col("facts"), F.col("copies"), F.col("copied_by")))
    return r.groupBy("source_id").agg(F.sum("facts").alias("facts"), F.sum("copies").alias("copies"), F.sum("copied_by").alias("copied_by"), F.round(F.sum(F.col("rating") * F.col("facts")) / F.sum("facts"), 9).alias("rating"))


def copy_pairs(repeats: DataFrame) -> DataFrame:
    """Copies per pair of different sources, with the mean delay; copies before their original are left out."""
    lead = F.timestamp_diff("SECOND", F.col("original_at"), F.col("copy_at")).cast("double")
    good = repeats.withColumn("lead", lead).filter("copy_source <> original_source and lead >= 0")
    return good.groupBy("copy_source", "original_source").agg(F.count("*").alias("n"), F.round(F.avg("lead"), 3).alias("mean_delay_s"))


def source_groups(pairs: DataFrame, totals: DataFrame, least: int = 3, share: float = 0.3) -> DataFrame:
    """``source_id, group_id`` of sources tied by pairs of enough copies that are a large share of the copier's facts."""
    strong = pairs.join(totals, F.col("copy_source") == F.col("source_id")).filter((F.col("n") >= least) & (F.col("n") >= share * F.col("facts")))
    return connected(strong.select(F.col("copy_source").alias("a"), F.col("original_source").alias("b"))).select(F.col("node").alias("source_id"), F.col("comp").alias("group_id"))
