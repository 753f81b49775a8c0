"""Connected components of an edge table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local session gets one of its own; a
    cluster has to name one."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="trackline-"))
        configured = context.getCheckpointDir()
    return configured.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once in the folder that all executors share and read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """``node, comp`` for edges (a, b): each node with the least node of its component.

    In each round every component points to its least neighbour, if that is less, and to where that one points; components
    that point at each other's end become one, and edges inside one go. Only components that are less than all their
    neighbours stay, at most half of them, so a chain of any length ends in a logarithm of rounds. Each is written down; if
    ``rounds`` do not get there, it is an error, never a partial result.
    """
    graph = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "pairs")
    labels = written(graph.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct(), "labels")
    for _ in range(rounds):
        up = written(graph.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("up")), "ups")
        far = up.select(F.col("a").alias("up"), F.col("up").alias("far"))
        up = written(up.join(far, "up").select("a", F.col("far").alias("up")), "ups")
        labels = written(labels.join(up, F.col("comp") == F.col("a"), "left").select("node", F.coalesce("up", "comp").alias("comp")), "labels")
        ends = graph.join(up.withColumnRenamed("up", "x"), "a").join(up.select(F.col("a").alias("b"), F.col("up").alias("y")), "b")
        graph = written(ends.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "pairs")
        if graph.isEmpty():
            return labels
    raise RuntimeError(f"components are not stable after {rounds} rounds")
