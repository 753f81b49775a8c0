"""Exact percentiles of groups of any size, by cumulative counts over their distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackline.operators.components import written


def exact(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], weight: str | None = None) -> DataFrame:
    """``keys`` and a column for each of ``shares`` (name: 0 to 1): the percentile between the two nearest ranks, as Spark's own.

    Values are counted in the tasks and sorted over all tasks by range; each range knows how many values stand before it, so
    no group is held or sorted in one place. Null values do not count; a group without values has no row; null keys are a key.
    A row counts once, or as often as its ``weight`` says.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg((F.sum(weight) if weight else F.count("*")).alias("__n"))
    ranged = written(counts.repartitionByRange(*keys, "__v").withColumn("__part", F.spark_partition_id()), "percentile-counts")
    same = lambda a, b, on: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in on]
    parts = ranged.groupBy(*keys, "__part").agg(F.sum("__n").alias("__in"))
    order = Window.partitionBy(*keys).orderBy("__part") if keys else Window.orderBy("__part")  # a row for each range
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    parts = parts.withColumns({"__before": F.sum("__in").over(order) - F.col("__in"), "__all": F.sum("__in").over(whole)})
    running = F.sum("__n").over(Window.partitionBy(*keys, "__part").orderBy("__v"))
    placed = ranged.withColumn("__run", running).alias("a").join(parts.alias("b"), same("a", "b", [*keys, "__part"]))
    placed = placed.select(*[f"a.{k}" for k in keys], "__v", "__all", (F.col("__before") + F.col("__run")).alias("__to"), (F.col("__before") + F.col("__run") - F.col("__n")).alias("__from"))
    out = []
    for name, share in shares.items():
        rank = (F.col("__all") - 1) * share
        low, high = F.floor(rank), F.ceil(rank)
        held = lambda k: F.max(F.when((F.col("__from") <= k) & (k < F.col("__to")), F.col("__v")))
        part = F.max(rank - low)
        out.append(((1 - part) * held(low) + part * held(high)).alias(name))
    return placed.groupBy(*keys).agg(*out)
