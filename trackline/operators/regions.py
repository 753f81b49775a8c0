"""Points in polygons by a grid: polygon at a point, nearest polygon, spatial parents.

A polygon is an array of rings, outer ones and holes of all its parts alike: a point is inside if a ray from it crosses an
odd number of edges. The grid cells that edges touch are the polygon's edge cells, the cells between them that lie inside are
its inner cells. Points and polygons meet by an equality join on the cell; in an inner cell nothing is left to test, in an edge
cell the ray is counted against the edges that pass the cell's row, not against the whole polygon. Equal to counting all
edges, and all of it in Spark's own functions.

The grid's lines lie off round coordinates. ``polygons``: polygon_id, rings (array<array<struct<lon,lat>>>, closed or not),
and any other columns. Polygons without three points are empty; points without coordinates are nowhere. A cell holds as many
polygons as overlap there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = 0.25  # degrees
ORIGIN = 0.00731
PAD = 1e-9


def _index(x: Column, size: float) -> Column:
    return F.floor((x - ORIGIN) / size)


def edges(polygons: DataFrame) -> DataFrame:
    """``polygon_id, x1, y1, x2, y2``: the sides of all rings."""
    ring = polygons.select("polygon_id", F.explode("rings").alias("r")).filter(F.size("r") >= 3)
    ends = F.zip_with("r", F.concat(F.slice("r", 2, F.size("r") - 1), F.slice("r", 1, 1)), lambda a, b: F.struct(a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"), b["lat"].alias("y2")))
    return ring.select("polygon_id", F.inline(ends)).filter((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def _crosses(e: Column, x: Column, y: Column) -> Column:
    """Whether a ray from the point to the right meets the side."""
    spans = (e["y1"] > y) != (e["y2"] > y)
    return F.when(spans, x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]).otherwise(False)


def _odd(sides: Column, x: Column, y: Column) -> Column:
    return F.size(F.filter(sides, lambda e: _crosses(e, x, y))) % 2 == 1


def edge_cells(polygons: DataFrame, size: float = CELL) -> DataFrame:
    """``polygon_id, iy, ix, x1, y1, x2, y2``: each side in each cell it touches, a rim of ``PAD`` around it included."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges(polygons).withColumn("iy", F.explode(F.sequence(_index(low - PAD, size), _index(high + PAD, size))))
    bottom, top = F.col("iy") * size + ORIGIN - PAD, (F.col("iy") + 1) * size + ORIGIN + PAD
    at = lambda y: F.col("x1") + (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1"))
    flat = high == low
    a = F.when(flat, F.col("x1")).otherwise(at(F.greatest(low, F.least(high, bottom))))
    b = F.when(flat, F.col("x2")).otherwise(at(F.greatest(low, F.least(high, top))))
    return rows.withColumn("ix", F.explode(F.sequence(_index(F.least(a, b) - PAD, size), _index(F.greatest(a, b) + PAD, size))))


def cover(polygons: DataFrame, size: float = CELL) -> tuple[DataFrame, DataFrame]:
    """Cells (``polygon_id, ix, iy, inner``) and rows (``polygon_id, iy, sides``) of each polygon."""
    side = F.struct("x1", "y1", "x2", "y2")
    rows = edge_cells(polygons, size).groupBy("polygon_id", "iy").agg(F.collect_set(side).alias("sides"), F.collect_set("ix").alias("touched"))
    cell = rows.withColumn("ix", F.explode(F.sequence(F.array_min("touched"), F.array_max("touched"))))
    middle = lambda c: (F.col(c) + 0.5) * size + ORIGIN
    edge = F.array_contains("touched", F.col("ix"))
    cell = cell.withColumn("inner", ~edge).filter(edge | _odd(F.col("sides"), middle("ix"), middle("iy")))
    return cell.select("polygon_id", "ix", "iy", "inner"), rows.select("polygon_id", "iy", "sides")


def containing(points: DataFrame, polygons: DataFrame, size: float = CELL) -> DataFrame:
    """``points`` (point_id, lon, lat) with each ``polygon_id`` that holds them."""
    cells, rows = cover(polygons, size)
    met = points.select("point_id", "lon", "lat", _index(F.col("lon"), size).alias("ix"), _index(F.col("lat"), size).alias("iy")).join(cells, ["ix", "iy"])
    inner = met.filter("inner")
    tested = met.filter("not inner").join(rows, ["polygon_id", "iy"]).filter(_odd(F.col("sides"), F.col("lon"), F.col("lat")))
    return inner.select("point_id", "polygon_id").unionByName(tested.select("point_id", "polygon_id"))


def polygon_at(points: DataFrame, polygons: DataFrame, size: float = CELL) -> DataFrame:
    """``point_id, level, polygon_id``: of each level the first polygon (least id) that holds the point."""
    held = containing(points, polygons, size).join(polygons.select("polygon_id", "level"), "polygon_id")
    return held.groupBy("point_id", "level").agg(F.min("polygon_id").alias("polygon_id"))


def nearest(points: DataFrame, polygons: DataFrame, within: float, size: float = CELL) -> DataFrame:
    """``point_id, polygon_id, degrees``: the polygon whose edge is nearest, at most ``within`` degrees away; ties go to the
    least id. For points outside all polygons this is the distance to the polygon.

    A point looks at as many rings of cells around its own as ``within`` needs.
    """
    reach = int(-(-within // size))
    around = lambda c: F.explode(F.sequence(_index(F.col(c), size) - reach, _index(F.col(c), size) + reach))
    spread = points.select("point_id", "lon", "lat", around("lon").alias("ix")).withColumn("iy", around("lat"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = ((F.col("lon") - F.col("x1")) * dx + (F.col("lat") - F.col("y1")) * dy) / (dx * dx + dy * dy)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    gap = F.sqrt(F.pow(F.col("lon") - F.col("x1") - t * dx, 2) + F.pow(F.col("lat") - F.col("y1") - t * dy, 2))
    near = spread.join(edge_cells(polygons, size), ["ix", "iy"]).withColumn("degrees", gap).filter(F.col("degrees") <= within)
    return near.groupBy("point_id").agg(F.min(F.struct("degrees", "polygon_id")).alias("n")).select("point_id", "n.polygon_id", "n.degrees")


def spatial_parents(points: DataFrame, polygons: DataFrame, levels: list[str], last: str, within: float = 0.05, size: float = CELL) -> DataFrame:
    """``point_id, parent_id``: the polygon of the first of ``levels`` that holds the point, else the nearest one of level
    ``last`` within a distance, else null."""
    rank = reduce(lambda case, level: case.when(F.col("level") == level, levels.index(level)), levels[1:], F.when(F.col("level") == levels[0], 0))
    ranked = polygons.filter(F.col("level").isin(levels)).withColumn("rank", rank)
    held = containing(points, ranked, size).join(ranked.select("polygon_id", "rank"), "polygon_id").groupBy("point_id").agg(F.min(F.struct("rank", "polygon_id")).alias("h")).select("point_id", F.col("h.polygon_id").alias("held"))
    lost = points.join(held, "point_id", "left_anti")
    close = nearest(lost, polygons.filter(F.col("level") == last), within, size).select("point_id", F.col("polygon_id").alias("close"))
    return points.select("point_id").join(held, "point_id", "left").join(close, "point_id", "left").select("point_id", F.coalesce("held", "close").alias("parent_id"))
