"""Idempotent ingest by two keys, and repeated facts across messages."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackline.operators.components import connected
from trackline.operators.slices import passed, slot

#: A slice of repeats is as long as keeps that of the busiest key within about so many facts; at least eight times the limit.
SLICE_ROWS = 100_000


def content_hash(df: DataFrame, code: str, text: str, payload: str) -> DataFrame:
    """``hash``: sha256 of source, text and payload, a line each; nulls count as empty."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in (code, text, payload)]
    return df.withColumn("hash", F.sha2(F.concat_ws("\n", *parts), 256))


def idempotent(arrivals: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The rows that an insert with two unique keys keeps, first arrival first.

    ``arrivals``: arrival (order), key, hash, ... ``stored``: key, hash of rows already in. A row is refused if its key or
    hash is taken; a refused row takes neither. So one pass in order is needed, but only inside groups of rows that are
    linked by shared keys or hashes. Rows that share nothing skip it, and equal (key, hash) rows meet as their first. A group
    passes through its task as a sorted stream; what is held is its keys and hashes taken so far.
    """
    if stored is not None:
        arrivals = arrivals.join(stored.select("key").distinct(), "key", "left_anti").join(stored.select("hash").distinct(), "hash", "left_anti")
    first = arrivals.groupBy("key", "hash").agg(F.min("arrival").alias("arrival"))
    by_key = first.groupBy("key").agg(F.min("arrival").alias("b"), F.count("*").alias("n")).filter("n > 1").join(first, "key").select(F.col("arrival").alias("a"), "b")
    by_hash = first.groupBy("hash").agg(F.min("arrival").alias("b"), F.count("*").alias("n")).filter("n > 1").join(first, "hash").select(F.col("arrival").alias("a"), "b")
    groups = connected(by_key.unionByName(by_hash))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comp, keys, hashes = None, set(), set()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["comp"] != comp:
                    comp, keys, hashes = r["comp"], set(), set()
                if r["key"] not in keys and r["hash"] not in hashes:
                    keys.add(r["key"])
                    hashes.add(r["hash"])
                    out.append(r["arrival"])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["arrival"])

    linked = first.join(groups, F.col("arrival") == F.col("node")).select("comp", F.col("arrival").cast("long").alias("arrival"), "key", "hash")
    kept = linked.repartition("comp").sortWithinPartitions("comp", "arrival").mapInArrow(keep, "arrival long")
    alone = first.join(groups, F.col("arrival") == F.col("node"), "left_anti").select("arrival")
    return arrivals.join(kept.unionByName(alone), "arrival", "left_semi")


def place_key() -> Column:
    """What facts must share to say the same: event, category, and the place, or the destination of those without one."""
    place = F.when(F.col("place_id").isNotNull(), F.struct(F.lit(0).alias("kind"), F.col("place_id").cast("long").alias("id"))).otherwise(F.struct(F.lit(1).alias("kind"), F.col("dest_id").cast("long").alias("id")))
    return F.to_json(F.struct("event_type", "category", place.alias("place")))


def mark_repeats(facts: DataFrame, minutes: float = 3) -> DataFrame:
    """``duplicate_of``: the earliest fact of another message, itself no duplicate, that says the same; else null.

    ``facts``: fact_id, raw_message_id, event_type, category, class_id, place_id, dest_id, observed_at. The same: event,
    category, place (or destination where neither has a place), classes equal or one unknown, at most ``minutes`` apart.
    A duplicate cannot be an original, so the facts of a place are passed in order, slice by slice (``slices.passed``); what
    a slice hands over are its originals within ``minutes`` of its end. The denser the facts, the longer ways from different
    originals stay apart, so slices are as long as ``SLICE_ROWS`` allows: rounds follow the rows of the busiest place, not time. A fact that is given twice is one fact with two rows:
    they have one mark, and as many rows come out as go in.
    """
    width, limit = max(8 * minutes, 60), pd.Timedelta(minutes=minutes)
    busiest = facts.groupBy(place_key(), slot(F.col("observed_at"), width)).count().agg(F.max("count")).first()[0]
    width *= max(1, SLICE_ROWS // (busiest or SLICE_ROWS))
    slim = facts.select(place_key().alias("key"), slot(F.col("observed_at"), width).alias("slot"), "fact_id", F.col("raw_message_id").cast("long").alias("message"), F.col("class_id").cast("long").alias("class"), "observed_at").distinct()

    def step(rows: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        columns, order = ["key", "fact_id", "message", "class", "observed_at"], ["observed_at", "fact_id"]
        of_key, out = defaultdict(deque), []
        for fact in given.sort_values(order)[columns].itertuples(index=False, name=None):
            of_key[fact[0]].append(fact)
        for fact in rows.sort_values(order)[columns].itertuples(index=False, name=None):
            key, _, message, kind, at = fact
            originals = of_key[key]
            while originals and at - originals[0][4] > limit:
                originals.popleft()
            hit = next((o[1] for o in originals if o[2] != message and (pd.isna(kind) or pd.isna(o[3]) or o[3] == kind)), None)
            if hit is None:
                originals.append(fact)
            out.append((*fact, hit))
        return pd.DataFrame(out, columns=[*columns, "duplicate_of"]).astype({"message": "Int64", "class": "Int64", "duplicate_of": "Int64"})

    def carry(out: DataFrame) -> DataFrame:
        end = (F.col("slot") + 1) * int(width * 60e6)
        late = F.unix_micros(F.col("observed_at").cast("timestamp")) >= end - int(minutes * 60e6)
        return out.filter(F.col("duplicate_of").isNull() & late).drop("duplicate_of")

    marks = passed(slim, step, "fact_id long, message long, class long, observed_at timestamp_ntz, duplicate_of long", carry)
    return facts.join(marks.filter("duplicate_of is not null").select("fact_id", "duplicate_of").distinct(), "fact_id", "left")


def outcomes(attempts: DataFrame, most: int = 3, most_transient: int = 10) -> DataFrame:
    """Per message: state from its ledger of attempts (message_id, at, ok, transient, error).

    Transient failures do not count as attempts up to their own limit.
    """
    counted = F.count_if(~F.col("ok") & ~F.col("transient"))
    passing = F.count_if(~F.col("ok") & F.col("transient"))
    failures = counted + F.greatest(passing - most_transient, F.lit(0))
    state = F.when(F.bool_or("ok"), "processed").when(failures >= most, "failed").otherwise("pending")
    last = F.max_by("error", F.when(~F.col("ok"), F.col("at")))
    return attempts.groupBy("message_id").agg(state.alias("state"), counted.cast("int").alias("attempts"), last.alias("error"))


