"""Tracks from a stream of facts: the pass of ``operators/tracks`` over one micro-batch after the other.

Facts wait until the event clock is ``delay`` past them and then go through in order of event time, so any order of arrival
within that time gives the revisions of the whole table. A fact that comes later still finds its track: it is counted and
leaves a revision, and moves nothing.

Kept between batches are the facts that wait, the open tracks and the clock, each batch's beside the one's before it; a batch
that comes again starts from the same state and writes the same files. The state is bounded: facts wait for ``delay`` at
most, and tracks go when they are closed and no fact in time can reach them.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trackline.operators import tracks as K

BEHIND_MIN = 30.0
CLOCK = "batch long, newest timestamp_ntz, clock timestamp_ntz, waiting long, open long, state_bytes long"


def event_clock(before: datetime | None, newest: datetime | None, oldest_waiting: datetime | None, wall: datetime, delay: timedelta) -> datetime | None:
    """Up to when events are complete: ``delay`` before now, or, while the oldest event that waits is half an hour behind
    now, before the newest event seen. So an old backlog closes tracks at its own pace. The clock never goes back."""
    behind = oldest_waiting is not None and oldest_waiting < wall - timedelta(minutes=BEHIND_MIN)
    now = (newest if behind else wall) - delay
    return now if before is None else max(before, now)


def _paths(folder: str, batch: int) -> dict[str, str]:
    """Two generations of state take turns; revisions stay."""
    return {n: f"{folder}/{n}-{batch % 2}" for n in ("waiting", "open", "clock")} | {"revisions": f"{folder}/revisions/batch={batch}"}


def advance(fresh: DataFrame, batch: int, folder: str, wall: datetime | None, delay: timedelta, rule: K.Rule = K.Rule()) -> None:
    """Take the facts of a micro-batch in. ``wall`` None: everything that waits is due, as at the end of a table."""
    spark = fresh.sparkSession
    to, was = _paths(folder, batch), _paths(folder, batch - 1)
    event_schema = spark.createDataFrame([], K.EVENT).schema
    clock, newest, state = None, None, None
    waiting = K.events(fresh)
    if batch > 0:
        last = spark.read.schema(CLOCK).parquet(was["clock"]).first()
        if last.batch != batch - 1:
            raise RuntimeError(f"batch {batch} follows {last.batch}")
        clock, newest = last.clock, last.newest
        waiting = waiting.unionByName(spark.read.schema(event_schema).parquet(was["waiting"]))
        state = spark.read.schema(K.STATE).parquet(was["open"]).select("track_id", "category", "state")
    waiting = K.written(waiting, "track-waiting")
    span = waiting.agg(F.min("observed_at").alias("oldest"), F.max("observed_at").alias("newest")).first()
    newest = max((t for t in (newest, span.newest) if t is not None), default=None)
    clock = newest if wall is None else event_clock(clock, newest, span.oldest, wall, delay)
    if clock is None:
        clock = datetime(1970, 1, 1)
    made = K.written(K.advance(waiting.filter(F.col("observed_at") <= F.lit(clock)), state, clock, rule), "track-made")
    made.filter("state is null").drop("state").write.mode("overwrite").parquet(to["revisions"])
    waiting.filter(F.col("observed_at") > F.lit(clock)).write.mode("overwrite").parquet(to["waiting"])
    made.filter("state is not null").select("track_id", "category", F.col("revision_at").alias("state_at"), "state").write.mode("overwrite").parquet(to["open"])
    held = spark.read.schema(K.STATE).parquet(to["open"]).agg(F.count("*").alias("open"), F.coalesce(F.sum(F.length("state")), F.lit(0)).alias("bytes")).first()
    kept = spark.read.schema(event_schema).parquet(to["waiting"]).count()
    spark.createDataFrame([(batch, newest, clock, kept, held.open, held.bytes)], CLOCK).write.mode("overwrite").parquet(to["clock"])


def follow(facts: DataFrame, folder: str, checkpoint: str, wall: Callable[[], datetime], delay: timedelta = timedelta(minutes=10), rule: K.Rule = K.Rule()) -> StreamingQuery:
    """A query that keeps the tracks of a stream of facts (columns of ``EVENT``) in ``folder``; ends when all that is there is
    read. Repeats must be marked before (``duplicate_of``)."""
    handle = lambda fresh, batch: advance(fresh, batch, folder, wall(), delay, rule)
    return facts.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def revisions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(K.REVISION).parquet(f"{folder}/revisions")


def state_of(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    """batch, newest, clock, and the size of the state: facts that wait, open tracks, their bytes."""
    return spark.read.schema(CLOCK).parquet(_paths(folder, batch)["clock"])
