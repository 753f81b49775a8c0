"""Repeated facts in a stream, by a list of originals kept for each place."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackline.operators.dedup import place_key

MARK = "fact_id long, raw_message_id long, observed_at timestamp, duplicate_of long"
ORIGINALS = "ids array<long>, messages array<long>, classes array<long>, times array<timestamp>"


def mark(facts: DataFrame, minutes: float = 3, late: str = "10 minutes") -> DataFrame:
    """Append mode: each fact with ``duplicate_of``, the earliest fact of another message, itself no duplicate, that says the
    same (as ``dedup.mark_repeats``; classes equal or one unknown), or null.

    Facts of a place must arrive in order of time from one micro-batch to the next; inside one they may stand in any order. The
    state of a place is its originals of the last ``minutes``; it goes when the watermark has passed them. Facts later than
    ``late`` are dropped by the watermark. ``facts``: fact_id, raw_message_id, event_type, category, class_id, place_id,
    dest_id, observed_at (timestamp).
    """
    limit = pd.Timedelta(minutes=minutes)

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get, strict=True)) if state.exists else []
        originals = [(i, m, c, pd.Timestamp(t)) for i, m, c, t in held]
        rows = pd.concat(list(batches)).sort_values(["observed_at", "fact_id"])
        out = []
        for fact, message, kind, at in rows[["fact_id", "message", "class", "observed_at"]].itertuples(index=False, name=None):
            kind = None if pd.isna(kind) else int(kind)
            originals = [o for o in originals if at - o[3] <= limit]
            hit = next((o[0] for o in originals if o[1] != message and (kind is None or o[2] is None or o[2] == kind)), None)
            if hit is None:
                originals.append((int(fact), int(message), kind, at))
            out.append((fact, message, at, hit))
        state.update(tuple([v.to_pydatetime() for v in column] if n == 3 else list(column) for n, column in enumerate(zip(*originals, strict=True))) if originals else ([], [], [], []))
        end = int((rows["observed_at"].max() + limit).timestamp() * 1000)
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["fact_id", "raw_message_id", "observed_at", "duplicate_of"]).astype({"duplicate_of": "Int64"})

    slim = facts.withWatermark("observed_at", late).select(place_key().alias("key"), "fact_id", F.col("raw_message_id").cast("long").alias("message"), F.col("class_id").cast("long").alias("class"), "observed_at")
    return slim.groupBy("key").applyInPandasWithState(step, MARK, ORIGINALS, "append", GroupStateTimeout.EventTimeTimeout)
