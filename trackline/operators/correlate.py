"""Association scores as columns. The ordered pass that attaches each fact to its best track is in ``tracks``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackline.operators.tracks import Rule


def score(minutes: Column, distance: Column, gap: Column, direction: Column, similarity: Column, speed: Column, window: Column, split: Column, rule: Rule = Rule()) -> Column:
    """0.30 time + 0.35 space + 0.15 direction + 0.20 class; capped where the move is impossible or a source lists two objects.

    ``direction`` is an angle difference or null, ``split`` tells that one source names two places.
    """
    a, b, c, d = rule.weights
    time = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - minutes / window))
    reach = speed * minutes / 60 + rule.slack_km
    space = F.when(gap <= reach, F.when(reach > 0, 1 - 0.5 * gap / reach).otherwise(1.0)).otherwise(0.0)
    total = a * time + b * space + c * F.coalesce(1 - direction / 180, F.lit(0.5)) + d * similarity
    apart = split & (minutes < rule.split_min) & (distance > 2 * speed * minutes / 60 + 20)
    return F.when((space == 0) | apart, F.least(total, F.lit(rule.impossible))).otherwise(total)


def class_similarity(model_a: Column, model_b: Column, family_a: Column, family_b: Column) -> Column:
    return F.when(model_a == model_b, 1.0).when(model_a.isNotNull() & model_b.isNotNull(), 0.2).when(family_a == family_b, 0.9).when(family_a.isNotNull() & family_b.isNotNull(), 0.3).otherwise(0.7)


def closed_at(revisions: DataFrame, window_min: float) -> DataFrame:
    """Tracks with the event time at which silence closes them: twice the window after they were last seen."""
    last = revisions.groupBy("track_id").agg(F.max("seen_at").alias("seen_at"), F.max("facts").alias("facts"), F.max_by("confidence", "facts").alias("confidence"))
    return last.withColumn("closed_at", F.col("seen_at") + F.make_dt_interval(mins=F.lit(int(2 * window_min))))
