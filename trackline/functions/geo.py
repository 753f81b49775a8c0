"""Geometry on the sphere. Points are pairs of longitude and latitude columns in degrees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0088


def distance_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance by the haversine formula."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing from the first point to the second, in [0, 360)."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(angle + 360, F.lit(360.0))


def cube(lon: Column, lat: Column, size: Column) -> list[Column]:
    """The cell of a point of the sphere in a grid of cubes."""
    x, y = F.radians(lon), F.radians(lat)
    return [F.floor(RADIUS_KM * v / size).alias(n) for n, v in (("cx", F.cos(y) * F.cos(x)), ("cy", F.cos(y) * F.sin(x)), ("cz", F.sin(y)))]


def offset(lon: Column, lat: Column, bearing: Column, km: Column) -> Column:
    """struct(lon, lat) of the point at a bearing and distance."""
    a, b, r = F.radians(lat), F.radians(bearing), km / RADIUS_KM
    lat2 = F.asin(F.sin(a) * F.cos(r) + F.cos(a) * F.sin(r) * F.cos(b))
    lon2 = F.radians(lon) + F.atan2(F.sin(b) * F.sin(r) * F.cos(a), F.cos(r) - F.sin(a) * F.sin(lat2))
    return F.struct((F.pmod(F.degrees(lon2) + 180, F.lit(360.0)) - 180).alias("lon"), F.degrees(lat2).alias("lat"))


def angle_diff(a: Column, b: Column) -> Column:
    """Difference of two bearings, in [0, 180]."""
    return F.abs(F.pmod(a - b + 540, F.lit(360.0)) - 180)


def covering_radius_km(ring: Column, lon: Column, lat: Column) -> Column:
    """Distance from a centre to the farthest point of a ring, an array of struct(lon, lat)."""
    return F.array_max(F.transform(ring, lambda p: distance_km(lon, lat, p["lon"], p["lat"])))


def circle(lon: Column, lat: Column, km: Column, points: int = 32) -> Column:
    """Closed ring around a point."""
    return F.transform(F.sequence(F.lit(0), F.lit(points)), lambda i: offset(lon, lat, i * (360.0 / points), km))


def sector(lon: Column, lat: Column, bearing: Column, half_angle: Column, km: Column, points: int = 12) -> Column:
    """Closed ring of a cone from a point along a bearing."""
    tip = F.array(F.struct(lon.alias("lon"), lat.alias("lat")))
    arc = F.transform(F.sequence(F.lit(0), F.lit(points)), lambda i: offset(lon, lat, bearing - half_angle + i * (2.0 / points) * half_angle, km))
    return F.concat(tip, arc, tip)


def forecast_point(lon: Column, lat: Column, bearing: Column, speed_kmh: Column, minutes: float = 6, least_km: float = 8, default_km: float = 20) -> Column:
    """Where a track is heading: some minutes ahead, at least ``least_km``, a fixed distance without a speed."""
    return offset(lon, lat, bearing, F.when(speed_kmh.isNotNull(), F.greatest(speed_kmh * (minutes / 60), F.lit(float(least_km)))).otherwise(F.lit(float(default_km))))


def _rings(values: pa.Array) -> list[np.ndarray]:
    return [np.array([[p["lon"], p["lat"]] for p in v or []], float).reshape(-1, 2) for v in values.to_pylist()]


def _inside(x: float, y: float, ring: np.ndarray) -> bool:
    if len(ring) < 3:
        return False
    a, b = ring, np.roll(ring, -1, axis=0)
    spans = (a[:, 1] > y) != (b[:, 1] > y)
    rise = np.where(spans, b[:, 1] - a[:, 1], 1.0)
    return bool((spans & (x < (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / rise + a[:, 0])).sum() % 2)


def _edge_km(x: float, y: float, ring: np.ndarray) -> float:
    """Distance to the nearest segment, on a plane that touches the sphere at the point."""
    scale = np.array([np.cos(np.radians(y)), 1.0]) * np.pi / 180 * RADIUS_KM
    a = (ring - [x, y]) * scale
    d = np.roll(a, -1, axis=0) - a
    t = np.clip(-(a * d).sum(1) / np.maximum((d * d).sum(1), 1e-12), 0, 1)
    return float(np.hypot(*(a + t[:, None] * d).T).min())


def point_in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Whether a point lies in a ring, by counting crossings."""

    @F.arrow_udf("boolean")
    def inside(xs: pa.Array, ys: pa.Array, rings: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else _inside(x, y, r) for x, y, r in zip(xs.to_pylist(), ys.to_pylist(), _rings(rings), strict=True)], pa.bool_())

    return inside(lon, lat, ring)


def distance_to_ring_km(lon: Column, lat: Column, ring: Column) -> Column:
    """Distance from a point to a region's edge, 0 inside; null for an empty ring."""

    @F.arrow_udf("double")
    def gap(xs: pa.Array, ys: pa.Array, rings: pa.Array) -> pa.Array:
        rows = zip(xs.to_pylist(), ys.to_pylist(), _rings(rings), strict=True)
        return pa.array([None if x is None or y is None or len(r) == 0 else 0.0 if _inside(x, y, r) else _edge_km(x, y, r) for x, y, r in rows], pa.float64())

    return gap(lon, lat, ring)


def _simplified(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker with an explicit stack."""
    keep = np.zeros(len(ring), bool)
    if len(ring):
        keep[[0, -1]] = True
    stack = [(0, len(ring) - 1)]
    while stack:
        i, j = stack.pop()
        if j <= i + 1:
            continue
        a, d, p = ring[i], ring[j] - ring[i], ring[i + 1 : j]
        n = np.hypot(*d)
        off = np.abs(d[0] * (p[:, 1] - a[1]) - d[1] * (p[:, 0] - a[0])) / n if n else np.hypot(*(p - a).T)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return ring[keep]


def simplify(ring: Column, tolerance: float) -> Column:
    """A ring with fewer points, none farther than ``tolerance`` degrees from the old line."""

    @F.arrow_udf("array<struct<lon:double,lat:double>>")
    def fewer(rings: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))
        return pa.array([[{"lon": x, "lat": y} for x, y in _simplified(r, tolerance).tolist()] for r in _rings(rings)], kind)

    return fewer(ring)
