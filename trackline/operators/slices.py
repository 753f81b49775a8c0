"""Order-dependent passes over keys of any size, in slices of time that run side by side.

What a slice decides depends on its rows and on what the slice before it hands over, its state. All slices run at once with
an empty state; then slices run for each state that they may be handed and have not run with yet, until there is none. By
then every slice is known as a function from the states it may meet to the state it hands on. These functions are composed
by doubling, so the states that really occur are found in as many steps as the logarithm of the longest way. States that come
together again, whatever was before, keep the first loop short: its length is that of the memory of the pass, not of the key.
A pass whose states never meet again costs one round a slice, as it must run in order.

A task holds one slice of some keys, about ``GROUP_ROWS`` rows where no single slice of a key has more.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trackline.operators.components import shared_dir, written

SLICE = ["part", "slot", "key"]
RUN = [*SLICE, "state"]
TYPED = "part long, slot long, key string, state long"
GROUP_ROWS = 5000


def slot(ts: Column, minutes: float) -> Column:
    """Number of the slice of ``minutes`` that holds an instant."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / int(minutes * 60e6))


def passed(rows: DataFrame, step: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, carry: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The output of ``step(rows, state)`` over the slices of each key in order, with columns part, slot, key and ``schema``.

    ``rows``: key, slot, ... ; ``step`` gets one slice of several keys, which it must keep apart by the column key, in both of its
    arguments and in what it returns. ``carry`` takes the output of slices, with the columns
    ``RUN``, and gives the rows that each hands to the next slice, with the same four columns. Equal rows count each; a state
    is named by the number and the sum of its rows' hashes. Outputs of each round are written in the shared folder.
    """
    spark = rows.sparkSession
    base = f"{shared_dir(spark)}/slices-{uuid.uuid4().hex}"
    typed = f"{TYPED}, {schema}"
    rows = rows.withColumns({"key": F.col("key").cast("string"), "slot": F.col("slot").cast("long")})
    rows = written(rows, "slice-rows")
    size = rows.agg(F.count("*").alias("rows"), F.count_distinct("slot").alias("slots")).first()
    parts = max(1, size.rows // (max(1, size.slots) * GROUP_ROWS))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    slices = written(rows.select(*SLICE).distinct(), "slice-names")
    columns = spark.createDataFrame([], typed).columns
    state_columns = [c for c in carry(spark.createDataFrame([], typed)).columns if c not in RUN]

    def run(group: tuple, mine: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        variants = given[["key", "state"]].drop_duplicates()
        named = (variants["key"] + "\x1f" + variants["state"].astype(str)).tolist()
        of_variant = dict(zip(named, variants.itertuples(index=False, name=None), strict=True))
        mine = mine.drop(columns=["part", "slot"]).merge(variants.assign(__variant=named), on="key")
        mine = mine.assign(key=mine["__variant"]).drop(columns=["__variant", "state"])
        held = given[given["__given"].notna()]
        out = step(mine, held[state_columns].assign(key=held["key"] + "\x1f" + held["state"].astype(str)))
        keys = [of_variant[v] for v in out["key"]]
        return out.assign(part=group[0], slot=group[1], key=pd.Series([k for k, _ in keys], out.index, object), state=[s for _, s in keys])[columns]

    due, given, n = slices.withColumn("state", F.lit(0).cast("long")), None, 0
    while True:
        due = written(due, "slice-runs")
        if due.isEmpty():
            break
        due.write.parquet(f"{base}/runs/n={n}")
        if given is None:
            given = due.withColumn("__given", F.lit(None).cast("boolean"))
            for field in carry(spark.createDataFrame([], typed)).schema:
                if field.name in state_columns:
                    given = given.withColumn(field.name, F.lit(None).cast(field.dataType))
        mine = rows.join(due.select(*SLICE).distinct(), SLICE, "left_semi")
        mine.groupBy("part", "slot").cogroup(given.groupBy("part", "slot")).applyInPandas(run, typed).write.parquet(f"{base}/out/n={n}")
        handed = carry(spark.read.schema(typed).parquet(f"{base}/out/n={n}"))
        hashes = F.sum(F.xxhash64(*state_columns).cast("decimal(38,0)"))
        named = handed.groupBy(*RUN).agg(F.xxhash64(F.count("*"), hashes).alias("next"))
        ways = due.join(named, RUN, "left").select(*RUN, F.coalesce("next", F.lit(0)).alias("next"))
        ways.write.parquet(f"{base}/ways/n={n}")
        ways = spark.read.schema(f"{TYPED}, next long").parquet(f"{base}/ways/n={n}")
        before = spark.read.schema(TYPED).parquet(f"{base}/runs")
        fresh = ways.groupBy("part", (F.col("slot") + 1).alias("slot"), "key", F.col("next").alias("state")).agg(F.min(F.col("state")).alias("from"))
        fresh = written(fresh.join(slices, SLICE, "left_semi").join(before, RUN, "left_anti"), "slice-fresh")
        states = handed.select("part", (F.col("slot") + 1).alias("slot"), "key", F.col("state").alias("from"), *state_columns, F.lit(True).alias("__given"))
        due, given, n = fresh.select(*RUN), fresh.join(states, [*SLICE, "from"]).drop("from"), n + 1
    if n == 0:
        return spark.createDataFrame([], StructType([f for f in StructType.fromDDL(typed) if f.name != "state"]))
    met = _met(spark.read.schema(f"{TYPED}, next long").parquet(f"{base}/ways"), slices)
    return spark.read.schema(typed).parquet(f"{base}/out").join(met, RUN, "left_semi").drop("state")


def _met(ways: DataFrame, slices: DataFrame) -> DataFrame:
    """The one state of each slice that it really meets.

    A slice that has run with one state only meets that. From there on the ways lead to the others; each round follows ways
    twice as long as the round before.
    """
    wanted = slices.count()
    met = written(ways.groupBy(*SLICE).agg(F.count("*").alias("states"), F.min("state").alias("state")).filter("states = 1").select(*RUN), "slices-met")
    jumps = ways.select(*RUN, (F.col("slot") + 1).alias("to_slot"), F.col("next").alias("to_state"))
    while met.count() < wanted:
        reached = met.join(jumps, RUN).select("part", F.col("to_slot").alias("slot"), "key", F.col("to_state").alias("state")).join(slices, SLICE, "left_semi")
        met = written(met.unionByName(reached).distinct(), "slices-met")
        ahead = jumps.select("part", "key", F.col("slot").alias("to_slot"), F.col("state").alias("to_state"), F.col("to_slot").alias("far_slot"), F.col("to_state").alias("far_state"))
        jumps = written(jumps.join(ahead, ["part", "key", "to_slot", "to_state"]).select(*RUN, F.col("far_slot").alias("to_slot"), F.col("far_state").alias("to_state")), "slice-jumps")
    return met
