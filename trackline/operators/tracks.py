"""Facts into tracks, in order: attachment, updates, confirmation by repeats, cancellation, silence.

A :class:`Board` holds the open tracks of one component and takes one event after another. Facts can only meet tracks within
reach in space and time, so facts are put into components first: occupied cells of space and time, as wide as the reach of a
category, are linked to the occupied cells around them (never facts to facts). The events of a component then pass through a
task in order, as a sorted stream; what is in memory is the open tracks, not the component. Components may be larger than
need be: that costs parallel work, never a result.

Open tracks can be handed in and out (``state``), so the same pass runs over a whole table or over one micro-batch after the
other (``streaming/tracks.py``) with the same revisions.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trackline.functions.geo import RADIUS_KM, cube
from trackline.operators.components import connected, written

#: The columns of an event; those a table lacks are null. ``event``: observed (or null), cancelled. A cancellation needs
#: region_id and may name a category.
EVENT = """fact_id long, raw_message_id long, source_id long, event string, category string, class_id long, family_id long, model_id long, model_confidence int,
  observed_at timestamp_ntz, lon double, lat double, accuracy_km double, kind string, place_id long, region_id long, origin_id long, dest_id long, dest_lon double, dest_lat double,
  dest_km double, dest_region_id long, approach_deg double, direction_deg double, direction_confidence int, object_count int, confidence int, speed_kmh double, window_min double,
  duplicate_of long, reason string"""
REVISION = """track_id long, fact_id long, revision_at timestamp_ntz, status string, reason string, first_at timestamp_ntz, seen_at timestamp_ntz, category string, class_id long, family_id long, model_id long,
  lon double, lat double, kind string, accuracy_km double, place_id long, heading double, heading_confidence int, object_count int, facts int, sources int, confidence int,
  association double, added array<struct<lon: double, lat: double>>"""
STATE = "track_id long, category string, state_at timestamp_ntz, state string"

ACTIVE, CLOSED, CANCELLED = "active", "closed", "cancelled"
APPROACH = "approach"  # kind of a position that is only where a named destination is approached


@dataclass(frozen=True)
class Rule:
    """Fixed values of the score and of a track's course."""

    attach: float = 0.6
    slack_km: float = 30.0
    impossible: float = 0.3
    window_min: float = 30.0
    speed_kmh: float = 200.0
    reach_min: float = 120.0
    split_min: float = 8.0
    close_windows: float = 2.0
    path_km: float = 50.0  # positions this precise belong to the path
    anchor_km: float = 40.0  # around a destination that is only named
    short_km: float = 15.0  # how far short of it an object is that comes from a known side
    weights: tuple[float, float, float, float] = (0.30, 0.35, 0.15, 0.20)


def km(a: tuple[float, float], b: tuple[float, float]) -> float:
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * RADIUS_KM * math.asin(min(1.0, math.sqrt(h)))


def course(a: tuple[float, float], b: tuple[float, float]) -> float:
    y1, y2, d = math.radians(a[1]), math.radians(b[1]), math.radians(b[0] - a[0])
    return math.degrees(math.atan2(math.sin(d) * math.cos(y2), math.cos(y1) * math.sin(y2) - math.sin(y1) * math.cos(y2) * math.cos(d))) % 360


def turn(a: float, b: float) -> float:
    return abs((a - b + 540) % 360 - 180)


def ahead(at: tuple[float, float], bearing: float, distance: float) -> tuple[float, float]:
    y, b, r = math.radians(at[1]), math.radians(bearing), distance / RADIUS_KM
    y2 = math.asin(math.sin(y) * math.cos(r) + math.cos(y) * math.sin(r) * math.cos(b))
    x2 = math.radians(at[0]) + math.atan2(math.sin(b) * math.sin(r) * math.cos(y), math.cos(r) - math.sin(y) * math.sin(y2))
    return (math.degrees(x2) + 180) % 360 - 180, math.degrees(y2)


def minutes(a: datetime, b: datetime) -> float:
    return (a - b).total_seconds() / 60


@dataclass
class Track:
    track_id: int
    category: str
    first_at: datetime
    seen_at: datetime
    updated_at: datetime
    status: str = ACTIVE
    reason: str | None = None
    class_id: int | None = None
    family_id: int | None = None
    model_id: int | None = None
    model_confidence: int = 0
    at: tuple[float, float] | None = None
    kind: str | None = None
    accuracy_km: float | None = None
    place_id: int | None = None
    region_id: int | None = None
    heading: float | None = None
    heading_confidence: int = 0
    source_id: int | None = None
    object_count: int | None = None
    facts: int = 0
    best: int = 0
    speed_kmh: float | None = None
    window_min: float | None = None
    last_point: tuple[float, float] | None = None  # of the path
    sources: list[int] = field(default_factory=list)
    messages: dict[str, datetime] = field(default_factory=dict)  # those within reach: none of them has another fact here
    recent: dict[str, list] = field(default_factory=dict)  # facts within reach that a repeat may name: time, source, confidence

    def confidence(self) -> int:
        return min(3, max(1, self.best + (len(self.sources) >= 2) + (self.facts >= 3)))

    def closes_at(self, rule: Rule) -> datetime:
        return self.seen_at + timedelta(minutes=rule.close_windows * (self.window_min or rule.window_min))

    def packed(self) -> str:
        return json.dumps(asdict(self), default=datetime.isoformat)

    @classmethod
    def unpacked(cls, text: str) -> Track:
        values, time = json.loads(text), datetime.fromisoformat
        for name in ("first_at", "seen_at", "updated_at"):
            values[name] = time(values[name])
        for name in ("at", "last_point"):
            values[name] = tuple(values[name]) if values[name] else None
        values["messages"] = {k: time(v) for k, v in values["messages"].items()}
        values["recent"] = {k: [time(v[0]), *v[1:]] for k, v in values["recent"].items()}
        return cls(**values)


@dataclass(frozen=True)
class Anchor:
    at: tuple[float, float]
    km: float
    place_id: int | None


def anchor(f: dict, rule: Rule) -> Anchor | None:
    """Where a fact is for the score: its position, else around the destination it names, else nowhere."""
    if f["lon"] is not None and f["lat"] is not None:
        return Anchor((f["lon"], f["lat"]), f["accuracy_km"] or 0.0, f["place_id"])
    if f["dest_lon"] is not None and f["dest_lat"] is not None:
        return Anchor((f["dest_lon"], f["dest_lat"]), max(f["dest_km"] or 0.0, rule.anchor_km), f["dest_id"])
    return None


def similarity(f: dict, t: Track) -> float:
    for name, equal, other in (("model_id", 1.0, 0.2), ("family_id", 0.9, 0.3)):
        mine, theirs = f[name], getattr(t, name)
        if mine is not None and mine == theirs:
            return equal
        if mine is not None and theirs is not None:
            return other
    return 0.7


def score(f: dict, a: Anchor, t: Track, rule: Rule) -> float:
    """How well a fact continues a track: time, space, direction and class, weighted; capped where it cannot be."""
    if t.at is None:
        return 0.0
    own = f["class_id"] is not None
    window = (f["window_min"] if own else t.window_min) or rule.window_min
    speed = (f["speed_kmh"] if own else t.speed_kmh) or rule.speed_kmh
    apart = abs(minutes(f["observed_at"], t.seen_at))
    distance = km(t.at, a.at)
    gap, reach = max(0.0, distance - a.km - (t.accuracy_km or 0.0)), speed * apart / 60 + rule.slack_km
    space = 0.0 if gap > reach else 1 - 0.5 * gap / reach if reach > 0 else 1.0
    direction = 0.5
    if t.heading is not None and f["direction_deg"] is not None:
        direction = 1 - turn(f["direction_deg"], t.heading) / 180
    elif t.heading is not None and gap > 15:
        direction = 1 - turn(course(t.at, a.at), t.heading) / 180
    parts = (min(1.0, max(0.0, 1 - apart / window)), space, direction, similarity(f, t))
    total = sum(w * p for w, p in zip(rule.weights, parts, strict=True))
    listed = f["source_id"] == t.source_id and apart < rule.split_min and None not in (a.place_id, t.place_id) and a.place_id != t.place_id
    if space == 0 or (listed and distance > 2 * speed * apart / 60 + 20):
        return min(total, rule.impossible)
    return total


class Board:
    """The open tracks of a component, and the revisions that each event makes."""

    def __init__(self, rule: Rule = Rule(), tracks: Iterable[Track] = ()):
        self.rule, self.tracks = rule, {t.track_id: t for t in tracks}

    def take(self, f: dict) -> Iterator[dict]:
        yield from self.expire(f["observed_at"])
        if f["event"] == "cancelled":
            yield from self._cancel(f)
        elif f["duplicate_of"] is not None:
            yield from self._confirm(f)
        else:
            yield from self._attach(f)

    def expire(self, now: datetime) -> Iterator[dict]:
        """Close what has been silent for long, at the time that ends its silence; forget what no event can reach."""
        for t in list(self.tracks.values()):
            if t.status == ACTIVE and t.closes_at(self.rule) <= now:
                t.status, t.reason = CLOSED, "timeout"
                t.updated_at = max(t.updated_at, t.closes_at(self.rule))
                yield self._revision(t, None)
            if t.status != ACTIVE and minutes(now, t.seen_at) > self.rule.reach_min:
                del self.tracks[t.track_id]

    def _cancel(self, f: dict) -> Iterator[dict]:
        for t in sorted(self.tracks.values(), key=lambda t: t.track_id):
            if t.status == ACTIVE and t.region_id is not None and t.region_id == f["region_id"] and f["category"] in (None, t.category) and t.seen_at <= f["observed_at"]:
                t.status, t.reason = CANCELLED, f["reason"] or "cancelled"
                t.updated_at = max(t.updated_at, f["observed_at"])
                yield self._revision(t, f["fact_id"])

    def _confirm(self, f: dict) -> Iterator[dict]:
        """A repeat goes to the track of its original; another source makes the original one step surer."""
        original = str(f["duplicate_of"])
        t = next((t for t in self.tracks.values() if original in t.recent), None)
        if t is None:
            return
        known = t.recent[original]
        if known[1] != f["source_id"]:
            known[2] = min(3, known[2] + 1)
        t.best = max(t.best, known[2], f["confidence"] or 0)
        self._seen(t, f)
        t.updated_at = max(t.updated_at, f["observed_at"])
        yield self._revision(t, f["fact_id"])

    def _attach(self, f: dict) -> Iterator[dict]:
        a, rule = anchor(f, self.rule), self.rule
        if a is None or f["category"] is None:
            return
        message, best, top = str(f["raw_message_id"]), None, 0.0
        for t in sorted(self.tracks.values(), key=lambda t: t.track_id):
            open_ = t.status == ACTIVE or t.reason == "timeout"
            near = open_ and t.category == f["category"] and abs(minutes(f["observed_at"], t.seen_at)) <= rule.reach_min and message not in t.messages
            if near and (t.class_id is None or f["class_id"] in (None, t.class_id)):
                s = score(f, a, t, rule)
                if s >= rule.attach and s > top:
                    best, top = t, s
        if best is None:
            at = f["observed_at"]
            best, top = Track(f["fact_id"], f["category"], at, at, at), 1.0
            self.tracks[best.track_id] = best
        best.status, best.reason = ACTIVE, None
        added = self._apply(best, f)
        best.recent[str(f["fact_id"])] = [f["observed_at"], f["source_id"], f["confidence"] or 0]
        best.best = max(best.best, f["confidence"] or 0)
        self._seen(best, f)
        yield self._revision(best, f["fact_id"], top, added)

    def _seen(self, t: Track, f: dict) -> None:
        t.messages[str(f["raw_message_id"])] = f["observed_at"]
        if f["source_id"] not in t.sources:
            t.sources.append(f["source_id"])
        stale = f["observed_at"] - timedelta(minutes=self.rule.reach_min)
        t.messages = {k: at for k, at in t.messages.items() if at >= stale}
        t.recent = {k: v for k, v in t.recent.items() if v[0] >= stale}

    def _apply(self, t: Track, f: dict) -> list[tuple[float, float]]:
        """Merge a fact into its track; the points that join the path. An older fact is counted and may name the class, but
        moves nothing."""
        newer = f["observed_at"] >= t.seen_at
        t.facts += 1
        t.updated_at, t.first_at = max(t.updated_at, f["observed_at"]), min(t.first_at, f["observed_at"])
        depth = lambda m, n, c: 3 if m is not None else 2 if n is not None else 1 if c is not None else 0
        mine, theirs = depth(f["model_id"], f["family_id"], f["class_id"]), depth(t.model_id, t.family_id, t.class_id)
        if (mine, f["model_confidence"] or 0) > (theirs, t.model_confidence):
            for name in ("class_id", "family_id", "model_id"):
                setattr(t, name, f[name] if f[name] is not None else getattr(t, name))
            t.model_confidence = f["model_confidence"] or 0
        if f["class_id"] is not None and f["class_id"] == t.class_id:
            t.speed_kmh, t.window_min = f["speed_kmh"], f["window_min"]
        if f["object_count"] is not None and (newer or t.object_count is None):
            t.object_count = f["object_count"]
        if not newer:
            return []
        t.seen_at, t.source_id = f["observed_at"], f["source_id"]
        added = []
        if f["lon"] is not None and f["lat"] is not None:
            coarse_origin = f["place_id"] is not None and f["place_id"] == f["origin_id"] and (f["accuracy_km"] or 0.0) > self.rule.path_km
            if t.at is None or not coarse_origin:
                added = self._move(t, f)
        elif f["dest_lon"] is not None and f["dest_lat"] is not None:
            self._towards(t, f)
        if f["direction_deg"] is not None:
            t.heading, t.heading_confidence = f["direction_deg"], f["direction_confidence"] or 0
        return added

    def _guess(self, t: Track, f: dict, heading: float) -> None:
        """A course that no one stated never replaces one that was."""
        if f["direction_deg"] is None and (t.heading is None or t.heading_confidence <= 1):
            t.heading, t.heading_confidence = heading, 1

    def _move(self, t: Track, f: dict) -> list[tuple[float, float]]:
        here, accuracy, before, was = (f["lon"], f["lat"]), f["accuracy_km"] or 0.0, t.at, t.accuracy_km or 0.0
        fixed = before is not None and t.kind != APPROACH
        distance = km(before, here) if before else 0.0
        moved = fixed and distance > max(20.0, was + accuracy)
        t.at, t.kind, t.accuracy_km, t.place_id, t.region_id = here, f["kind"], f["accuracy_km"], f["place_id"], f["region_id"]
        if moved:
            self._guess(t, f, course(before, here))
        if accuracy > self.rule.path_km and not moved:
            return []
        points = [before] if t.last_point is None and fixed and (was <= self.rule.path_km or moved) else []
        points = [*points, here] if (points or [t.last_point])[-1] != here else points
        if t.last_point is None and len(points) < 2:  # a path begins with two points; the first is kept as the position until then
            return []
        t.last_point = here
        return points

    def _towards(self, t: Track, f: dict) -> None:
        """Only a destination is named: the object is on its approach, which is no fix."""
        there, radius = (f["dest_lon"], f["dest_lat"]), f["dest_km"] or 0.0
        fixed = t.at is not None and t.kind != APPROACH
        if f["approach_deg"] is not None:
            self._guess(t, f, f["approach_deg"])
            t.at = ahead(there, (f["approach_deg"] + 180) % 360, radius + self.rule.short_km)
        else:
            if fixed and (t.accuracy_km or 0.0) <= self.rule.path_km and km(t.at, there) > 5 and t.place_id != f["dest_id"]:
                self._guess(t, f, course(t.at, there))
            t.at = there
        t.kind, t.accuracy_km, t.place_id, t.region_id = APPROACH, max(radius, self.rule.anchor_km), f["dest_id"], f["dest_region_id"]

    def _revision(self, t: Track, fact_id: int | None, association: float | None = None, added: Iterable = ()) -> dict:
        lon, lat = t.at or (None, None)
        return {
            "track_id": t.track_id, "fact_id": fact_id, "revision_at": t.updated_at, "status": t.status, "reason": t.reason, "first_at": t.first_at, "seen_at": t.seen_at, "category": t.category,
            "class_id": t.class_id, "family_id": t.family_id, "model_id": t.model_id, "lon": lon, "lat": lat, "kind": t.kind, "accuracy_km": t.accuracy_km, "place_id": t.place_id, "heading": t.heading,
            "heading_confidence": t.heading_confidence, "object_count": t.object_count, "facts": t.facts, "sources": len(t.sources), "confidence": t.confidence(), "association": association,
            "added": [{"lon": x, "lat": y} for x, y in added],
        }


def events(facts: DataFrame) -> DataFrame:
    """``facts`` with all columns of ``EVENT``, missing ones null."""
    fields = StructType.fromDDL(EVENT).fields
    return facts.select(*[(F.col(f.name) if f.name in facts.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def _sizes(rows: DataFrame, rule: Rule) -> DataFrame:
    """``category, size``: the reach of each category; a row for each class, so it goes to every task."""
    size = F.greatest(F.max("speed_kmh"), F.lit(rule.speed_kmh)) * rule.reach_min / 60 + rule.slack_km + 2 * F.greatest(F.max("accuracy_km"), F.lit(2 * rule.anchor_km))
    return F.broadcast(written(rows.groupBy("category").agg(size.alias("size")), "track-sizes"))


def _node(x: str = "cx", y: str = "cy", z: str = "cz", s: str = "slot") -> Column:
    return F.xxhash64("category", x, y, z, s)


def _placed(rows: DataFrame, sizes: DataFrame, rule: Rule, at: Column, lon: Column, lat: Column) -> DataFrame:
    """``rows`` with their cell, its slot of time and the name of both, ``node``."""
    slot = F.floor(F.unix_micros(at.cast("timestamp")) / (rule.reach_min * 60e6)).alias("slot")
    return rows.join(sizes, "category").select(*rows.columns, *cube(lon, lat, F.col("size")), slot).withColumn("node", _node())


def _linked(cells: DataFrame) -> DataFrame:
    """``node, comp`` of the cells (category, cx, cy, cz, slot, node) that have others around them."""
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    around = cells
    for name in ("cx", "cy", "cz", "slot"):
        around = around.withColumn("__d", F.explode(step)).withColumn(name, F.col(name) + F.col("__d")).drop("__d")
    links = around.select(F.col("node").alias("a"), _node().alias("b")).filter("a < b").join(cells.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")
    return connected(links)


def advance(facts: DataFrame, state: DataFrame | None, until: datetime | None, rule: Rule = Rule()) -> DataFrame:
    """The revisions that ``facts`` make of the tracks in ``state``, and the tracks that are open afterwards: the columns of
    ``REVISION`` and ``state`` (not null in the rows of open tracks alone).

    Silence is judged up to ``until``, or up to the last event. Equal event times go by fact_id.
    """
    rows = written(events(facts), "track-events")
    spark = rows.sparkSession
    if until is None:
        until = rows.agg(F.max("observed_at")).first()[0]
    seen = rows.filter("coalesce(event, 'observed') <> 'cancelled' and category is not null")
    # What a fact or an open track needs to get its component is its cell, so cells meet components, never facts by their ids.
    lon, lat = F.coalesce("lon", "dest_lon"), F.coalesce("lat", "dest_lat")
    seen = seen.filter(F.col("fact_id").isNotNull() & lon.isNotNull() & lat.isNotNull())
    reach = seen.select("category", F.greatest("accuracy_km", "dest_km").alias("accuracy_km"), "speed_kmh")
    if state is not None:
        open_ = state.withColumn("t", F.from_json("state", "seen_at timestamp_ntz, at array<double>, accuracy_km double, speed_kmh double, region_id long")).filter("t.at[0] is not null and t.at[1] is not null")
        reach = reach.unionByName(open_.select("category", "t.accuracy_km", "t.speed_kmh"))
    sizes, cell = _sizes(reach, rule), ["category", "cx", "cy", "cz", "slot", "node"]
    seen = _placed(seen, sizes, rule, F.col("observed_at"), lon, lat)
    cells = seen.select(*cell)
    if state is not None:
        open_ = _placed(open_, sizes, rule, F.col("t.seen_at"), F.col("t.at")[0], F.col("t.at")[1])
        cells = cells.unionByName(open_.select(*cell))
    cells = written(cells.distinct(), "track-cells")
    comps = _linked(cells)
    of_comp = lambda df: df.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")).drop(*cell[1:])
    seen = of_comp(seen)
    own = seen.select("comp", "category", F.col("observed_at").alias("at"), "region_id", "dest_region_id")
    if state is not None:
        open_ = of_comp(open_)
        own = own.unionByName(open_.select("comp", "category", F.col("t.seen_at").alias("at"), F.col("t.region_id").alias("region_id"), F.lit(None).cast("long").alias("dest_region_id")))
    # A cancellation goes to the components that have something in its region, in its day or the day before.
    day = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / int(86_400e6))
    regions = own.select("comp", "category", "at", F.explode(F.array("region_id", "dest_region_id")).alias("region_id")).filter("region_id is not null")
    regions = regions.select("comp", "category", "region_id", F.explode(F.array(day("at"), day("at") + 1)).alias("day")).distinct()
    ends = rows.filter("event = 'cancelled' and region_id is not null").withColumn("day", day("observed_at")).alias("e")
    routed = ends.join(regions.alias("r"), (F.col("e.region_id") == F.col("r.region_id")) & (F.col("e.day") == F.col("r.day")) & (F.col("e.category").isNull() | (F.col("e.category") == F.col("r.category"))))
    routed = routed.select("e.*", "r.comp").drop("day").distinct()
    stream = seen.unionByName(routed).withColumn("state", F.lit(None).cast("string"))
    if state is not None:
        held = open_.select("comp", "state", *[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(EVENT).fields])
        stream = held.unionByName(stream)
    schema = f"{REVISION}, state string"
    kinds = spark.createDataFrame([], schema)
    arrow = _arrow(kinds.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comp, board, out = None, None, []

        def done() -> list[dict]:
            made = list(board.expire(until))
            return made + [{"track_id": t.track_id, "category": t.category, "revision_at": t.updated_at, "state": t.packed()} for t in board.tracks.values()]

        for batch in batches:
            for row in batch.to_pylist():
                if row["comp"] != comp:
                    out += done() if board else []
                    comp, board = row["comp"], Board(rule)
                if row["state"] is not None:
                    t = Track.unpacked(row["state"])
                    board.tracks[t.track_id] = t
                else:
                    out += board.take(row)
            yield pa.RecordBatch.from_pylist(out, arrow)
            out = []
        yield pa.RecordBatch.from_pylist(done() if board else [], arrow)

    ordered = stream.repartition("comp").sortWithinPartitions("comp", F.col("state").isNull(), "observed_at", "fact_id")
    return ordered.mapInArrow(run, schema)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def tracks(facts: DataFrame, rule: Rule = Rule(), until: datetime | None = None) -> DataFrame:
    """All revisions of the tracks of ``facts`` (columns of ``EVENT``). A track is named by its first fact."""
    return advance(facts, None, until, rule).filter("state is null").drop("state")


def paths(revisions: DataFrame) -> DataFrame:
    """``track_id, path``: the points that a track's revisions added, in order."""
    order = F.array_sort(F.collect_list(F.struct("revision_at", "facts", "added")))
    return revisions.filter(F.size("added") > 0).groupBy("track_id").agg(F.flatten(F.transform(order, lambda r: r["added"])).alias("path"))
