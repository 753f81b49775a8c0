"""Probabilistic links between facts, and walks over them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackline.functions import geo as G
from trackline.operators.components import connected
from trackline.operators.slices import RUN, passed, slot


@dataclass(frozen=True)
class Rule:
    """Fixed values of the link weights."""

    prior_km: float = 60.0
    fade_min: float = 20.0
    turn_min: float = 4.0
    late_min: float = 3.0
    overlap_km: float = 10.0
    least: float = 0.1
    of_best: float = 0.5
    most: int = 3
    exhausted: float = 0.05


#: What holds all pairs of a successor together, and so keeps them where they met.
HELD = ["category", "near", "slot"]


def _near_cells(facts: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """``facts`` with their ``cell``, and the pairs (category, near, cell) of occupied cells whose facts a link may join.

    A link has a weight only over a gap that its successor covers by its window's end. Cells are cubes as wide as the
    farthest such reach of the category with the slack of both ends; of neighbours, those stay whose boxes of longitude and latitude are as near
    as that. What lacks a speed or a slack reaches everywhere.
    """
    end, everywhere = F.coalesce("slack_km", F.lit(2 * G.RADIUS_KM)), F.lit(4 * G.RADIUS_KM)
    reach = F.coalesce(F.when(F.col("v_max") > 0, F.greatest(F.lit(0.0), (F.col("win_min") + rule.late_min) / 60 * F.col("v_max"))), everywhere)
    size = facts.groupBy("category").agg((F.max(reach) + 2 * F.greatest(F.lit(0.0), F.max(end)) + 1).alias("__reach"))
    placed = facts.filter("lon is not null and lat is not null").join(F.broadcast(size), "category").withColumn("__cell", F.struct(*G.cube(F.col("lon"), F.col("lat"), F.col("__reach"))))
    bounds = [f(c).alias(f"{n}_{c}") for c in ("lon", "lat") for f, n in ((F.min, "low"), (F.max, "high"))]
    cells = placed.groupBy("category", F.col("__cell").alias("cell")).agg(F.first("__reach").alias("reach"), *bounds)
    step, around = F.array(*[F.lit(i) for i in (-1, 0, 1)]), cells.select("category", "cell", *[F.struct(*[c for c in cells.columns if c != "category"]).alias("b")], "cell.*")
    for c in ("cx", "cy", "cz"):
        around = around.withColumn("__d", F.explode(step)).withColumn(c, F.col(c) + F.col("__d")).drop("__d")
    around = around.select("category", F.struct("cx", "cy", "cz").alias("cell"), F.col("b").alias("a"))
    met = around.join(cells.select("category", "cell", F.struct(*[c for c in cells.columns if c != "category"]).alias("b")), ["category", "cell"])
    apart = lambda c: F.greatest(F.lit(0.0), F.col(f"a.low_{c}") - F.col(f"b.high_{c}"), F.col(f"b.low_{c}") - F.col(f"a.high_{c}"))
    turn = F.least(apart("lon"), F.greatest(F.lit(0.0), 360 - (F.greatest("a.high_lon", "b.high_lon") - F.least("a.low_lon", "b.low_lon"))))
    narrow = F.least(*[F.cos(F.radians(f"{x}.{n}_lat")) for x in ("a", "b") for n in ("low", "high")])
    chord = F.pow(F.sin(F.radians(apart("lat")) / 2), 2) + F.pow(narrow, 2) * F.pow(F.sin(F.radians(turn) / 2), 2)
    near = met.filter(2 * G.RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(chord))) <= F.col("a.reach"))
    return placed.drop("__reach"), near.select("category", F.col("a.cell").alias("__cell"), F.col("b.cell").alias("near"))


def candidate_pairs(facts: DataFrame, window_min: float, rule: Rule = Rule()) -> DataFrame:
    """Pairs (c, n) of one category and different messages, c earlier by at most its successor's window and near enough to
    be linked; ``category, near, slot``, the successor's cell and slot, hold all pairs of a successor.

    ``facts``: fact_id, raw_message_id, category, observed_at, win_min, v_max, v_cruise, ... Joined on category, a cell of space
    (:func:`_near_cells`) and a time slot as wide as the longest window in use; the earlier side also stands in the next slot and in the cells around.
    """
    widest = facts.agg(F.max("win_min")).first()[0] or window_min
    window_min = min(widest, window_min) if widest > 0 else window_min
    slot = F.floor(F.unix_seconds(F.col("observed_at").cast("timestamp")) / (window_min * 60))
    row = F.struct(*facts.columns)
    placed, near = _near_cells(facts, rule)
    later = placed.select("category", F.col("__cell").alias("near"), slot.alias("slot"), row.alias("n"))
    earlier = placed.join(near, ["category", "__cell"]).select("category", "near", F.explode(F.array(slot, slot + 1)).alias("slot"), row.alias("c"))
    minutes = F.timestamp_diff("MICROSECOND", F.col("c.observed_at"), F.col("n.observed_at")) / 60e6
    pairs = later.join(earlier, ["category", "near", "slot"]).withColumn("dt", minutes)
    return pairs.filter((F.col("dt") > 0) & (F.col("dt") <= F.col("n.win_min")) & (F.col("c.raw_message_id") != F.col("n.raw_message_id")))


def class_factor(a: str, b: str) -> Column:
    """How well two facts' model, family and class agree."""
    m, f, c = ((F.col(f"{a}.{k}"), F.col(f"{b}.{k}")) for k in ("model_id", "family_id", "class_id"))
    equal = lambda p: p[0].isNotNull() & (p[0] == p[1])
    both = lambda p: p[0].isNotNull() & p[1].isNotNull()
    return F.when(equal(m), 1.0).when(both(m), 0.2).when(equal(f), 0.9).when(both(f), 0.3).when(equal(c), 0.85).when(both(c), 0.3).otherwise(0.7)


def weighted(pairs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``from_id, to_id, observed_at, weight, gap_km, dt, theta, need_min`` of the physically possible pairs.

    A pair needs lon, lat, slack_km on both sides; the course counts only where the object had to move.
    """
    km = G.distance_km(F.col("c.lon"), F.col("c.lat"), F.col("n.lon"), F.col("n.lat"))
    p = pairs.withColumn("km", km).withColumn("gap", F.greatest(F.lit(0.0), F.col("km") - F.col("c.slack_km") - F.col("n.slack_km")))
    course = G.angle_diff(G.bearing_deg(F.col("c.lon"), F.col("c.lat"), F.col("n.lon"), F.col("n.lat")), F.col("c.direction_deg"))
    p = p.withColumn("theta", F.when(F.col("c.direction_deg").isNotNull() & (F.col("gap") > rule.overlap_km), course))
    turn = F.coalesce(F.col("theta"), F.lit(0.0)) / 180 * rule.turn_min
    same = F.coalesce(F.col("n.place_id").isin(F.col("c.place_id"), F.col("c.dest_id")), F.lit(False)) | F.coalesce(F.col("n.dest_id").isin(F.col("c.place_id"), F.col("c.dest_id")), F.lit(False))
    dwell = F.when(same, 20.0).when(F.col("gap") <= rule.overlap_km, 10.0).otherwise(0.0)
    need = F.col("gap") / F.col("n.v_cruise") * 60 + turn
    over = F.col("dt") - need - dwell
    time = F.when(F.col("dt") + rule.late_min < F.col("gap") / F.col("n.v_max") * 60 + turn, 0.0).when(over <= 0, 1.0).otherwise(F.exp(-over / rule.fade_min))
    heading = F.when(F.col("gap") <= rule.overlap_km, 1.0).when(F.col("theta").isNull(), 0.6).otherwise(F.greatest(F.lit(0.05), (1 + F.cos(F.radians("theta"))) / 2))
    weight = time / (1 + F.col("km") / rule.prior_km) * heading * class_factor("n", "c")
    found = F.struct(F.col("c.fact_id").alias("from_id"), F.col("n.fact_id").alias("to_id"), F.col("n.observed_at").alias("observed_at"), weight.alias("weight"), F.col("gap").alias("gap_km"), "dt", "theta", need.alias("need_min"))
    held = [c for c in HELD if c in pairs.columns]
    return p.select(*held, F.explode(F.array(found)).alias("x")).select(*held, "x.*").filter("weight > 0")  # so the weight is not worked out again in the join's condition


def select_top(weights: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Per successor: weights that are large enough and near the best, the three highest, scaled down to a sum of one."""
    held = [c for c in HELD if c in weights.columns]
    w = Window.partitionBy(*held, "to_id")
    good = weights.filter(F.col("weight") >= rule.least).withColumn("__best", F.max("weight").over(w)).filter(F.col("weight") >= rule.of_best * F.col("__best"))
    top = good.withColumn("__i", F.row_number().over(w.orderBy(F.desc("weight"), "from_id"))).filter(F.col("__i") <= rule.most)
    total = top.withColumn("__sum", F.sum("weight").over(w))
    return total.withColumn("probability", F.round(F.col("weight") / F.greatest(F.col("__sum"), F.lit(1.0)), 3)).drop("__best", "__i", "__sum", *held)


def _fixed(n: dict[str, np.ndarray], c: dict[str, np.ndarray], rule: Rule) -> dict[str, np.ndarray]:
    """What the weight of pairs as in :func:`weighted` takes from the columns of successors and predecessors; unknown is NaN."""
    x, y, u, v = (np.radians(f[k]) for f, k in ((c, "lon"), (c, "lat"), (n, "lon"), (n, "lat")))
    h = np.sin((v - y) / 2) ** 2 + np.cos(y) * np.cos(v) * np.sin((u - x) / 2) ** 2
    km = 2 * G.RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(h)))
    gap = np.fmax(0.0, km - c["slack_km"] - n["slack_km"])
    turned = np.degrees(np.arctan2(np.sin(u - x) * np.cos(v), np.cos(y) * np.sin(v) - np.sin(y) * np.cos(v) * np.cos(u - x)))
    course = np.abs(np.mod(np.mod(turned + 360, 360.0) - c["direction_deg"] + 540, 360.0) - 180)
    theta = np.where(gap > rule.overlap_km, course, np.nan)
    turn = np.nan_to_num(theta) / 180 * rule.turn_min
    same = np.logical_or.reduce([n[p] == c[q] for p in ("place_id", "dest_id") for q in ("place_id", "dest_id")])
    dwell = np.where(same, 20.0, np.where(gap <= rule.overlap_km, 10.0, 0.0))
    need = gap / n["v_cruise"] * 60 + turn
    heading = np.where(gap <= rule.overlap_km, 1.0, np.where(np.isnan(theta), 0.6, np.maximum(0.05, (1 + np.cos(np.radians(theta))) / 2)))
    cases, factors = [], []
    for k, alike, other in (("model_id", 1.0, 0.2), ("family_id", 0.9, 0.3), ("class_id", 0.85, 0.3)):
        cases += [n[k] == c[k], ~(np.isnan(n[k]) | np.isnan(c[k]))]
        factors += [alike, other]
    fast = gap / n["v_max"] * 60 + turn
    return {"gap_km": gap, "theta": theta, "need_min": need, "dwell": dwell, "fast": fast, "far": 1 + km / rule.prior_km, "heading": heading, "like": np.select(cases, factors, 0.7)}


def _weight(fixed: dict[str, np.ndarray], dt: np.ndarray, rule: Rule) -> np.ndarray:
    """The weight of pairs that are ``dt`` minutes apart; it is never above 1."""
    over = dt - fixed["need_min"] - fixed["dwell"]
    time = np.where(dt + rule.late_min < fixed["fast"], 0.0, np.where(over <= 0, 1.0, np.exp(-over / rule.fade_min)))
    return time / fixed["far"] * fixed["heading"] * fixed["like"]


#: What a pair's weight depends on besides its time, how many pairs are weighed at once, and of how many successors.
WEIGHED, PAIRS, BLOCK = ["lon", "lat", "slack_km", "direction_deg", "v_max", "v_cruise", "place_id", "dest_id", "model_id", "family_id", "class_id"], 500_000, 64
#: A slice of links is as long as keeps that of the busiest key within about so many facts; at least the window or the longest reach back.
SLICE_ROWS = 400_000


def _fixed_of(facts: pd.DataFrame, rule: Rule) -> Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]:
    """:func:`_fixed` by positions of successors and predecessors: looked up where few facts differ in it, else worked out."""
    columns = {k: facts[k].to_numpy(float) for k in WEIGHED}
    kind = pd.DataFrame(columns).groupby(WEIGHED, dropna=False, sort=False).ngroup().to_numpy(np.int64)
    kinds, one = np.unique(kind, return_index=True)
    between = lambda i, j: _fixed({k: v[i] for k, v in columns.items()}, {k: v[j] for k, v in columns.items()}, rule)
    if len(kinds) ** 2 > min(PAIRS, 4 * len(facts)):
        return between
    with np.errstate(all="ignore"):
        known = between(np.repeat(one, len(one)), np.tile(one, len(one)))
    return lambda i, j: {k: v[kind[i] * len(one) + kind[j]] for k, v in known.items()}


def _pairs(facts: pd.DataFrame, ident: np.ndarray, left: list[float], rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """Positions of successors and predecessors with weights of ``rule.least`` and more, by successor, falling weight and the predecessor's id,
    a few successors and no more than about ``PAIRS`` looked at together. ``facts`` are sorted by key, time and id.

    A predecessor with less ``left`` than ``rule.least`` (by its ``ident``) can be no source any more, as weights end at 1, and is not looked at again: so
    what a successor meets is what the facts before it have left over, however many its window holds.
    """
    code, at, win = pd.factorize(facts["key"])[0].astype(np.int64), facts["at"].to_numpy(), facts["win_min"].to_numpy(float)
    message, ids, told = facts["raw_message_id"].to_numpy(), facts["fact_id"].to_numpy(), facts["told"].to_numpy(bool)
    fixed = _fixed_of(facts, rule)
    line = at - at.min() + code * (at.max() - at.min() + 1)  # keys one behind the other
    same = np.r_[False, (code[1:] == code[:-1]) & (at[1:] == at[:-1]) & (ids[1:] == ids[:-1])]
    one = np.maximum.accumulate(np.where(same, 0, np.arange(len(ids))))  # rows of one fact stand for its first
    back = np.minimum(np.nan_to_num(win) * 60e6 + 1, float(at.max() - at.min() + 1)).astype(np.int64)
    high = np.searchsorted(line, line)
    low = np.where(told, high, np.maximum(np.searchsorted(code, code), np.searchsorted(line, line - back)))
    reached = np.minimum.accumulate(np.where(told, len(ids), low)[::-1])[::-1]  # by this or a later successor
    met, start = np.zeros(0, np.int64), 0
    while start < len(ids):
        met = met[np.searchsorted(met, reached[start]) :]
        met = met[np.array([left[i] for i in ident[met].tolist()], float) >= rule.least]
        stop = start + max(1, min(BLOCK, PAIRS // (len(met) + BLOCK)))
        while stop < len(ids) and same[stop]:
            stop += 1
        met = np.r_[met, np.arange(start, min(stop, len(ids)))]
        first = np.searchsorted(met, low[start:stop])
        size = np.maximum(0, np.searchsorted(met, high[start:stop]) - first)
        i = np.repeat(np.arange(start, start + len(size)), size)
        j = met[np.repeat(first - np.cumsum(size) + size, size) + np.arange(len(i))]
        dt = (at[i] - at[j]) / 60e6
        fits = np.flatnonzero((dt > 0) & (dt <= win[i]) & (message[i] != message[j]))
        i, j, dt = i[fits], j[fits], dt[fits]
        with np.errstate(all="ignore"):
            found = fixed(i, j)
            found |= {"dt": dt, "weight": _weight(found, dt, rule)}
            good = np.flatnonzero(found["weight"] >= rule.least)  # weights only fall
        good = good[np.lexsort((ids[j[good]], -found["weight"][good], one[i[good]]))]
        yield one[i[good]], j[good], {k: v[good] for k, v in found.items()}
        start = stop


def link(facts: DataFrame, window_min: float = 120, rule: Rule = Rule()) -> DataFrame:
    """Links of every fact to its likely predecessors, ``from_id, to_id, probability, gap_km, dt, theta, need_min``.

    What a predecessor has given to earlier successors lowers what is left for later ones, so the facts of a category
    are passed in order, in slices (``slices.passed``), each group of cells that are near each other by itself. A slice runs once for each state
    that it may meet, so slices are as long as ``SLICE_ROWS`` allows, the window or the longest reach back at least; most groups are one slice and pass once.
    A slice gets its facts, and those of the slice before that it can still reach; pairs are weighed in it, a
    bounded number at a time, and never leave it. It hands over what it took from those that the next one can still reach.
    """
    columns = ["from_id", "to_id", "probability", "gap_km", "dt", "theta", "need_min"]
    node = lambda category, cell: F.xxhash64(category, cell)
    placed, near = _near_cells(facts.filter("raw_message_id is not null and observed_at is not null"), rule)
    groups = connected(near.select(node("category", "__cell").alias("a"), node("category", "near").alias("b")))
    longest = facts.agg(F.max("win_min")).first()[0] or window_min
    placed = placed.join(groups, node("category", "__cell") == F.col("node"))
    width, widest = max(float(window_min), float(longest)), int(60e6 * longest)
    busiest = placed.groupBy("comp", slot(F.col("observed_at"), width)).count().agg(F.max("count")).first()[0]
    width *= max(1, SLICE_ROWS // (busiest or SLICE_ROWS))
    at = F.unix_micros(F.col("observed_at").cast("timestamp"))

    def step(rows: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "at", "fact_id"], ignore_index=True)
        ids, at = rows["fact_id"].to_numpy(), rows["at"].to_numpy()
        ident = rows.groupby(["key", "fact_id"], sort=False).ngroup().to_numpy()
        left, least, of_best, most, exhausted = [1.0] * len(rows), rule.least, rule.of_best, rule.most, rule.exhausted
        held = given.merge(rows[["key", "fact_id"]].assign(ident=ident).drop_duplicates(), left_on=["key", "from_id"], right_on=["key", "fact_id"])
        for i, taken in zip(held["ident"].to_numpy(int).tolist(), held["taken"].to_numpy(float).tolist(), strict=True):
            left[i] = 1.0 - taken
        out = []
        for successors, predecessors, found in _pairs(rows, ident, left, rule) if len(rows) else ():
            kept, shares, weights, sources, names = [], [], found["weight"].tolist(), ident[predecessors].tolist(), ids[predecessors].tolist()
            starts = np.r_[np.flatnonzero(np.r_[True, successors[1:] != successors[:-1]]), len(successors)].tolist() if len(successors) else [0]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                floor, best, good = least, 0.0, []
                for i in range(a, b):
                    weight = weights[i]
                    if weight < floor:  # as all that follow
                        break
                    rest = left[sources[i]]
                    weight *= rest
                    if weight >= floor and rest > exhausted:
                        good.append((-weight, names[i], i, rest))
                        if weight > best:
                            best = weight
                            if of_best * weight > floor:
                                floor = of_best * weight
                        if len(good) > most:
                            good.sort()
                            del good[most:]
                            if -good[-1][0] > floor:
                                floor = -good[-1][0]
                good = sorted(g for g in good if -g[0] >= of_best * best)
                total = 0.0
                for weight, *_ in good:
                    total -= weight
                for weight, _, i, rest in good:
                    p = math.floor(-weight / max(1.0, total) * 1000 + 0.5) / 1000
                    left[sources[i]] = round(max(0.0, rest - p), 3)
                    kept.append(i)
                    shares.append(p)
            out.append((successors[kept], predecessors[kept], np.array(shares, float), *(found[c][kept] for c in ("gap_km", "dt", "theta", "need_min"))))
        if not out:
            return pd.DataFrame(columns=["key", *columns, "at"])
        to, of, shares, gap, dt, theta, need = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame({"key": rows["key"].to_numpy()[to], "from_id": ids[of], "to_id": ids[to], "probability": shares, "gap_km": gap, "dt": dt, "theta": theta, "need_min": need, "at": at[to]})

    def carry(out: DataFrame) -> DataFrame:
        late = F.col("at") - F.floor(F.col("dt") * 60e6) >= (F.col("slot") + 1) * int(width * 60e6) - widest - 1_000_000
        return out.filter(late).groupBy(*RUN, "from_id").agg(F.least(F.lit(1.0), F.round(F.sum("probability"), 3)).alias("taken"))

    own = slot(F.col("observed_at"), width)
    reached = at >= (own + 1) * int(width * 60e6) - widest
    slots = F.when(reached, F.array(own, own + 1)).otherwise(F.array(own))
    rows = placed.select(F.col("comp").alias("key"), F.posexplode(slots).alias("told", "slot"), "fact_id", "raw_message_id", at.alias("at"), "win_min", *WEIGHED).withColumn("told", F.col("told") == 1)
    return passed(rows, step, "from_id long, to_id long, probability double, gap_km double, dt double, theta double, need_min double, at long", carry).select(*[F.when(~F.isnan("theta"), F.col("theta")).alias(c) if c == "theta" else c for c in columns])


def with_duplicates(links: DataFrame, repeats: DataFrame) -> DataFrame:
    """``kind`` 0 links between facts that repeat nothing, and a link of kind 4 and probability 1 from each original to its repeat."""
    gone = repeats.filter("duplicate_of is not null").select("fact_id", "duplicate_of")
    kept = links.select("from_id", "to_id", "probability").join(gone.select(F.col("fact_id").alias("from_id")), "from_id", "left_anti").join(gone.select(F.col("fact_id").alias("to_id")), "to_id", "left_anti")
    return kept.withColumn("kind", F.lit(0)).unionByName(gone.select(F.col("duplicate_of").alias("from_id"), F.col("fact_id").alias("to_id"), F.lit(1.0).alias("probability"), F.lit(4).alias("kind")))


def best_chains(links: DataFrame, heads: DataFrame, steps: int) -> DataFrame:
    """``head, step, fact_id``: from every head back over the likeliest predecessor (ties: higher id), all heads at once."""
    best = links.groupBy("to_id").agg(F.max_by("from_id", F.struct("probability", "from_id")).alias("prev"))
    at = heads.select(F.col("fact_id").alias("head"), F.lit(0).alias("step"), "fact_id")
    found = at
    for i in range(1, steps + 1):
        at = at.join(best, F.col("fact_id") == F.col("to_id")).select("head", F.lit(i).alias("step"), F.col("prev").alias("fact_id"))
        found = found.unionByName(at)
    return found


def predecessors(links: DataFrame, heads: DataFrame, depth: int) -> DataFrame:
    """``head, fact_id, generation, path``: every walk back of up to ``depth`` links, with its probability."""
    step = links.select("to_id", "from_id", "probability")
    at = heads.select(F.col("fact_id").alias("head"), "fact_id", F.lit(0).alias("generation"), F.lit(1.0).alias("path"))
    found = None
    for i in range(1, depth + 1):
        at = at.join(step, F.col("fact_id") == F.col("to_id")).select("head", F.col("from_id").alias("fact_id"), F.lit(i).alias("generation"), (F.col("path") * F.col("probability")).alias("path"))
        found = at if found is None else found.unionByName(at)
    return found


def family(links: DataFrame, heads: DataFrame, depth: int, least_path: float = 0.02) -> DataFrame:
    """Ancestors (least generation, best path) and relatives: descendants of ancestors, not below the head's generation,
    on paths likely enough, that are no ancestors. ``head, fact_id, generation, path, relative``."""
    up = predecessors(links, heads, depth).groupBy("head", "fact_id").agg(F.min("generation").alias("generation"), F.max("path").alias("path"))
    step = links.select("to_id", "from_id", "probability")
    at, found = up, None
    for _ in range(depth):
        at = at.join(step, F.col("fact_id") == F.col("from_id")).select("head", F.col("to_id").alias("fact_id"), (F.col("generation") - 1).alias("generation"), (F.col("path") * F.col("probability")).alias("path"))
        at = at.filter((F.col("generation") >= 0) & (F.col("path") >= least_path) & (F.col("fact_id") != F.col("head")))
        found = at if found is None else found.unionByName(at)
    rest = found.groupBy("head", "fact_id").agg(F.min("generation").alias("generation"), F.max("path").alias("path")).join(up.select("head", "fact_id"), ["head", "fact_id"], "left_anti")
    return up.withColumn("relative", F.lit(False)).unionByName(rest.withColumn("relative", F.lit(True)))


def links_of(links: DataFrame, facts: DataFrame) -> DataFrame:
    """Links of each fact in both directions: fact_id, other, outgoing, probability."""
    wanted = facts.select("fact_id")
    out = links.select(F.col("from_id").alias("fact_id"), F.col("to_id").alias("other"), F.lit(True).alias("outgoing"), "probability")
    back = links.select(F.col("to_id").alias("fact_id"), F.col("from_id").alias("other"), F.lit(False).alias("outgoing"), "probability")
    return out.unionByName(back).join(wanted, "fact_id", "left_semi")
