"""Derived tables in versions: a rebuild is seen when all of it is there, and touches only what it is asked to.

A version's manifest is a small table that says, for each derived table and part of it, which version wrote the rows. It is
written last, by one job that commits as a whole: a reader sees the version before or the new one, never a mixture, and a
rebuild that fails leaves readers where they were. Parts that a rebuild does not touch stay in the folders they are in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

MANIFEST = "version long, name string, part string, written_by long"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException:  # nothing built yet
        return spark.createDataFrame([], MANIFEST)


def current(spark: SparkSession, path: str) -> int:
    """The number of the latest complete version; 0 without one."""
    return _manifest(spark, path).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def read(spark: SparkSession, path: str, name: str, schema: str, version: int | None = None) -> DataFrame:
    """A derived table as of a version, the latest by default. ``schema``: its columns without ``part``."""
    version = current(spark, path) if version is None else version
    rows = _manifest(spark, path).filter((F.col("version") == version) & (F.col("name") == name))
    folders = [f"{path}/{name}/v={r.written_by}" for r in rows.select("written_by").distinct().collect()]
    kept = rows.select("part", F.col("written_by").alias("v"))
    if not folders:
        return spark.createDataFrame([], f"{schema}, part string")
    every = spark.read.schema(f"{schema}, v long, part string").option("basePath", f"{path}/{name}").parquet(*folders)
    return every.join(kept, ["v", "part"], "left_semi").drop("v")


def rebuild(spark: SparkSession, path: str, tables: dict[str, Callable[[list[str] | None], DataFrame]], parts: list[str] | None = None) -> int:
    """Build derived tables anew, and return the version's number.

    Each of ``tables`` is called with ``parts`` (None: all) and gives its rows with a column ``part``; what it derives from raw
    rows in order of publication is its own to see to. With ``parts``, only they are replaced, also where no rows are left;
    the rest of the tables stays as the version before has it.
    """
    before, number = _manifest(spark, path), current(spark, path) + 1
    written = spark.createDataFrame([], "name string, part string")
    for name, build in tables.items():
        rows = build(parts)
        rows = rows if parts is None else rows.filter(F.col("part").isin(parts))
        target = f"{path}/{name}/v={number}"
        rows.write.mode("overwrite").partitionBy("part").parquet(target)
        made = spark.read.schema(rows.drop("part").schema.add("part", "string")).parquet(target).select("part").distinct()
        written = written.unionByName(made.select(F.lit(name).alias("name"), "part"))
    fresh = written.select(F.lit(number).cast("long").alias("version"), "name", "part", F.lit(number).cast("long").alias("written_by"))
    kept = before.filter(F.col("version") == number - 1)
    kept = kept.filter(~F.col("name").isin(list(tables))) if parts is None else kept.filter(~(F.col("name").isin(list(tables)) & F.col("part").isin(parts)))
    rows = fresh.unionByName(kept.withColumn("version", F.lit(number).cast("long")))
    none = spark.createDataFrame([(number, "", "", 0)], MANIFEST)  # a version of no rows is one too
    rows.unionByName(none).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return number
