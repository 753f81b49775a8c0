"""Streaming twins of the batch jobs. Event time is ``published_at`` or ``observed_at``; sinks take a batch function."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from trackline.operators import copies as C
from trackline.operators.snapshot import changes_worth_sending


def files(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 1000) -> DataFrame:
    """New Parquet files of a folder; the checkpoint of the query remembers what was read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def near_duplicates(messages: DataFrame, rule: C.Rule = C.Rule()) -> DataFrame:
    """Candidate pairs of messages of different sources that share a band within the time limit, whichever came first.

    Both sides carry a watermark of that limit, so the join's state is bounded; a late original still meets its copies. A
    pair comes once, from the first band that the two share, without further state.
    ``messages``: raw_message_id, source, text, published_at (timestamp).
    """
    prints = C.fingerprints(messages, rule).select("raw_message_id", "source", "published_at", "bands", F.explode("bands").alias("band"))
    a = prints.select(*[F.col(c).alias(f"a_{c}") for c in prints.columns]).withWatermark("a_published_at", f"{rule.hours} hours")
    b = prints.select(*[F.col(c).alias(f"b_{c}") for c in prints.columns]).withWatermark("b_published_at", f"{rule.hours} hours")
    span = F.expr(f"interval {rule.hours} hours")
    near = (F.col("b_published_at") >= F.col("a_published_at") - span) & (F.col("b_published_at") <= F.col("a_published_at") + span)
    later = (F.col("a_published_at") > F.col("b_published_at")) | ((F.col("a_published_at") == F.col("b_published_at")) & (F.col("a_raw_message_id") > F.col("b_raw_message_id")))
    pairs = a.join(b, (F.col("a_band") == F.col("b_band")) & near & (F.col("a_source") != F.col("b_source")) & later)
    pairs = pairs.filter(F.get(F.array_intersect("a_bands", "b_bands"), F.lit(0)) == F.col("a_band"))
    return pairs.select(F.col("a_raw_message_id").alias("copy"), F.col("b_raw_message_id").alias("original"))


def counts_per_window(facts: DataFrame, length: str, slide: str | None = None, late: str = "1 hour", ts: str = "observed_at", by: str = "category") -> DataFrame:
    """Facts per tumbling or sliding window and group; windows close once the watermark passes them."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    return facts.withWatermark(ts, late).groupBy(window.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(facts: DataFrame, key: str, gap: str, late: str = "1 hour", ts: str = "observed_at") -> DataFrame:
    """Runs of a key's facts without a silence longer than ``gap``, as batch closing of tracks does it."""
    return facts.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of_each(messages: DataFrame, keys: list[str], late: str = "1 hour", ts: str = "received_at") -> DataFrame:
    """Rows whose keys were not seen within the watermark."""
    return messages.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


ALERT = "source_id int, alert_id int, start timestamp, end timestamp, level string"
ALERT_STATE = "start timestamp, end timestamp, end_arrival long, level string, level_arrival long"


def alert_states(events: DataFrame, keep: str = "7 days") -> DataFrame:
    """Update mode: start, end and level of each alert so far, in whatever order its events arrive.

    The start is the least one, the end the first that arrived, the level the last one stated. An alert's state goes when
    the watermark is ``keep`` past its last event, so state is bounded by the alerts of that time.
    ``events``: source_id int, alert_id int, kind, at timestamp, finished_at timestamp, level string, arrival long.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, end, end_arrival, level, level_arrival = state.get if state.exists else (None,) * 5
        newest = None
        for batch in batches:
            for e in batch.sort_values("arrival").itertuples():
                at, closed = (None if pd.isna(v) else pd.Timestamp(v).to_pydatetime() for v in (e.at, e.at if e.kind == "finished" else e.finished_at))
                if e.kind == "started" and at is not None:
                    start = at if start is None else min(start, at)
                if closed is not None and (end_arrival is None or e.arrival < end_arrival):
                    end, end_arrival = closed, int(e.arrival)
                if not pd.isna(e.level) and (level_arrival is None or e.arrival > level_arrival):
                    level, level_arrival = e.level, int(e.arrival)
                newest = at if newest is None or (at is not None and at > newest) else newest
        state.update((start, end, end_arrival, level, level_arrival))
        if newest is not None:
            limit = pd.Timestamp(newest) + pd.Timedelta(keep)
            state.setTimeoutTimestamp(max(int(limit.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"source_id": [key[0]], "alert_id": [key[1]], "start": [start], "end": [end], "level": [level]})

    return events.withWatermark("at", keep).groupBy("source_id", "alert_id").applyInPandasWithState(step, ALERT, ALERT_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def into_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Hand every micro-batch with its number to ``handle``, which must give the same result when a batch comes again;
    ends when all that is there is read."""
    return stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replace_days(spark: SparkSession, df: DataFrame, path: str, day: str = "day") -> None:
    """Write only the days that ``df`` has; other days of the folder stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def settled(messages: DataFrame, now: Column, lag_s: float = 30) -> DataFrame:
    """Messages that arrived before a safety lag: ids still being written behind them cannot be passed over."""
    return messages.filter(F.timestamp_diff("SECOND", F.col("received_at"), now) >= lag_s)


def push_changes(changes: DataFrame, now: Callable[[], datetime], limits_s: dict[str, float], push: Callable[[DataFrame, int], None], checkpoint: str, stale: list[tuple[int, int]] | None = None) -> StreamingQuery:
    """Hand the fresh changes of each micro-batch to ``push``; stale ones, as a rebuild makes them, are only counted: (batch, n)
    is added to ``stale``. ``changes``: kind, at, ...; kinds without a limit are stale."""

    def handle(batch: DataFrame, number: int) -> None:
        marked = changes_worth_sending(batch, F.lit(now()).cast("timestamp"), limits_s).persist()
        try:
            push(marked.filter("fresh").drop("fresh"), number)
            if stale is not None:
                stale.append((number, marked.filter("not fresh").count()))
        finally:
            marked.unpersist()

    return into_batches(changes, handle, checkpoint)
