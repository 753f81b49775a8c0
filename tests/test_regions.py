import json
import random

from trackline.operators import admin as A
from trackline.operators import regions as R
from trackline.sources import feeds


def inside(rings, x, y):
    n = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            n += (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return n % 2 == 1


def gap(rings, x, y):
    def side(a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        n = dx * dx + dy * dy
        t = max(0, min(1, ((x - a[0]) * dx + (y - a[1]) * dy) / n)) if n else 0
        return ((x - a[0] - t * dx) ** 2 + (y - a[1] - t * dy) ** 2) ** 0.5

    return min(side(a, b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1]))


def frame(spark, shapes):
    rows = [(i, level, [[{"lon": float(x), "lat": float(y)} for x, y in ring] for ring in rings]) for i, (level, rings) in shapes.items()]
    return spark.createDataFrame(rows, "polygon_id int, level string, rings array<array<struct<lon:double,lat:double>>>")


def made(seed):
    draw = random.Random(seed)
    star = lambda x, y, n, low, high: [(x + draw.uniform(low, high) * a, y + draw.uniform(low, high) * b) for a, b in [(1, 0), (0.7, 0.7), (0, 1), (-0.7, 0.7), (-1, 0), (-0.7, -0.7), (0, -1), (0.7, -0.7)][:n]]
    shapes = {}
    for i in range(20):
        x, y = draw.uniform(-3, 3), draw.uniform(-3, 3)
        shapes[i] = ("city" if i % 3 == 0 else "region", [star(x, y, 8, 0.3, 2), star(x, y, 8, 0.05, 0.2), star(x + 3, y, 5, 0.01, 0.3)])
    shapes[20] = ("region", [[(10.00731, 10.00731), (10.50731, 10.00731), (10.50731, 10.50731), (10.00731, 10.50731), (10.00731, 10.00731)]])  # on the grid's lines, closed
    shapes[21] = ("region", [[(-0.01, -30), (0.01, -30), (0.01, 30), (-0.01, 30)]])  # thinner than a cell
    shapes[22] = ("region", [[(1.0, 1.0), (2.0, 2.0)], []])  # no area
    return shapes


def test_points_equal_counting_all_edges(spark):
    shapes, draw = made(1), random.Random(2)
    points = {i: (draw.uniform(-6, 8), draw.uniform(-6, 6)) for i in range(1500)} | {1500 + i: (draw.uniform(9.9, 10.6), draw.uniform(9.9, 10.6)) for i in range(200)} | {1800: (0.0, 0.0), 1801: (0.0, 29.9)}
    df = spark.createDataFrame([(i, *p) for i, p in points.items()] + [(1900, None, 1.0), (1901, None, None)], "point_id int, lon double, lat double")
    for size in (0.25, 1.0):
        got = {tuple(r) for r in R.containing(df, frame(spark, shapes), size).collect()}
        assert got == {(i, k) for i, p in points.items() for k, (_, rings) in shapes.items() if inside([r for r in rings if len(r) > 2], *p)}
    levels = {(r.point_id, r.level): r.polygon_id for r in R.polygon_at(df, frame(spark, shapes)).collect()}
    assert levels[1801, "region"] == 21
    want = {}
    for i, p in points.items():
        for k, (level, rings) in sorted(shapes.items()):
            if inside([r for r in rings if len(r) > 2], *p):
                want.setdefault((i, level), k)
    assert levels == want


def test_parents(spark):
    shapes, draw = made(3), random.Random(4)
    points = {i: (draw.uniform(-6, 8), draw.uniform(-6, 6)) for i in range(800)}
    df = spark.createDataFrame([(i, *p) for i, p in points.items()] + [(900, None, None)], "point_id int, lon double, lat double")
    found = R.spatial_parents(df, frame(spark, shapes), ["city", "region"], "region", 0.3)
    got = {r.point_id: r.parent_id for r in found.collect()}
    for i, p in points.items():
        fit = {k: rings for k, (_, rings) in shapes.items() if k != 22}
        held = [k for level in ("city", "region") for k in sorted(fit) if shapes[k][0] == level and inside(fit[k], *p)]
        near = sorted((gap(rings, *p), k) for k, rings in fit.items() if shapes[k][0] == "region")
        want = held[0] if held else near[0][1] if near[0][0] <= 0.3 else None
        assert got[i] == want
    assert got[900] is None and len(got) == 801
    plan = found._jdf.queryExecution().optimizedPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_tables(spark):
    none = spark.createDataFrame([], "point_id int, lon double, lat double")
    one = spark.createDataFrame([(1, 0.0, 0.0)], "point_id int, lon double, lat double")
    assert R.containing(none, frame(spark, made(1))).count() == 0
    assert R.spatial_parents(one, frame(spark, {}), ["city", "region"], "region").first().parent_id is None


def test_features_with_parts_and_holes(spark, tmp_path):
    square = lambda x, n: [[x, 0.0], [x + n, 0.0], [x + n, n * 1.0], [x, n * 1.0], [x, 0.0]]
    hole = [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0], [1.0, 1.0]]
    kinds = [("UA-1", "Polygon", [square(0.0, 4), hole]), ("UA-2", "MultiPolygon", [[square(10.0, 4)], [square(20.0, 4)]]), ("RU-9", "Polygon", [square(30.0, 1)]), ("UA80", "Polygon", [square(30.0, 1)]), (None, "Polygon", [square(0.0, 9)]), ("UA-3", "Point", [1.0, 2.0])]
    body = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"shapeISO": c, "name": "n"}, "geometry": {"type": t, "coordinates": p}} for c, t, p in kinds]}
    (tmp_path / "a.json").write_text(json.dumps(body, indent=1))
    found = feeds.features(spark, str(tmp_path / "a.json"))
    codes = spark.createDataFrame([("UA-1",), ("UA-2",), ("UA-3",), ("UA80",)], "code string")
    got = {r.code: r.rings for r in feeds.chosen_features(found, "shapeISO", codes, skip=("UA80", "UA85")).collect()}
    assert {k: len(v) for k, v in got.items()} == {"UA-1": 2, "UA-2": 2}
    chosen = feeds.chosen_features(found, "shapeISO", codes, skip=("UA80",)).selectExpr("cast(substr(code, 4) as int) as polygon_id", "'region' as level", "rings")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 21.0, 1.0), (4, 15.0, 1.0)], "point_id int, lon double, lat double")
    assert {tuple(r) for r in R.containing(points, chosen).collect()} == {(1, 1), (3, 2)}


def test_newest_fresh_row_wins(spark):
    stored = spark.createDataFrame([("a", 1, "old"), ("b", 2, "old")], "key string, n int, note string")
    fresh = spark.createDataFrame([("a", 3, 10), ("a", 4, 12), ("a", 5, 11), ("c", 6, 1)], "key string, n int, at int")
    assert {tuple(r) for r in feeds.upsert(stored, fresh, "key", "at").select("key", "n", "note").collect()} == {("a", 4, None), ("b", 2, "old"), ("c", 6, None)}


UNITS = [(1, "district", "Бахмутський район", 100), (2, "hromada", "Вовчанська територіальна громада", 101), (3, "hromada", "Садова громада", 100), (4, "hromada", "Садова ТГ", 101), (5, "hromada", "Садова громада", 101), (6, "district", "Київський район", None)]


def test_admin_units(spark):
    units = spark.createDataFrame(UNITS, "place_id int, level string, name string, region_id int")
    asks = [(1, "district", "бахмутський  Район", None, 1), (2, "hromada", "Вовчанська ТГ", 100, 2), (3, "hromada", "Садова територіальна громада", 101, 4), (4, "hromada", "Садова громада", None, None), (5, "hromada", "Садова громада", 102, None), (6, "district", "Вовчанська громада", None, None), (7, "district", None, None, None), (8, "district", "Київський район", 100, 6)]
    df = spark.createDataFrame([a[:4] for a in asks], "ask_id int, level string, name string, region_id int")
    assert {r.ask_id: r.place_id for r in A.find_admin(df, units).collect()} == {a[0]: a[4] for a in asks}


def test_every_fallback_of_a_feed_row(spark):
    units = spark.createDataFrame(UNITS, "place_id int, level string, name string, region_id int")
    regions = spark.createDataFrame([(100, "Донецька область"), (101, "Харківська область")], "place_id int, name string")
    towns = spark.createDataFrame([(20, "Ізюм", 101, 50, 5.0, 5.0), (21, "Ізюм", 100, 900, 0.5, 0.5), (22, "Лиман", 100, 5, 0.5, 0.5), (23, "Лиман", 101, 7, 7.0, 7.0)], "place_id int, name string, region_id int, population int, lon double, lat double")
    polygons = frame(spark, {3: ("hromada", [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]])})
    d, k = "Донецька область", "Харківська область"
    feed = [
        ("oblast", d, None, d, 100), ("oblast", k, None, "?", 101), ("raion", "Бахмутський район", None, d, 1), ("raion", "Бахмутський район", None, k, 1), ("raion", "Ізюмський район", None, k, 101),
        ("hromada", "Садова громада", None, k, 4), ("hromada", "Нова громада", "Бахмутський район", d, 1), ("hromada", "Нова громада", "Інший район", d, 100), ("hromada", "Нова громада", None, "?", None),
        ("city", "м. Ізюм", None, k, 20), ("city", "м.Ізюм", None, d, 3), ("city", "смт Лиман", None, "?", 23), ("city", "Ізюм", None, "?", 3), ("city", "м. Новий", "Бахмутський район", d, 1), ("city", "м. Новий", None, d, 100), ("street", "any", None, k, 101), (None, None, None, None, None),
    ]
    df = spark.createDataFrame([(i, *f[:4]) for i, f in enumerate(feed)], "alert_id int, kind string, title string, raion string, oblast string")
    assert {r.alert_id: r.place_id for r in A.resolve(df, regions, units, towns, polygons).collect()} == {i: f[4] for i, f in enumerate(feed)}
