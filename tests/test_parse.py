"""A small dictionary and a corpus of messages, each with the facts that it tells."""

from pyspark.sql import functions as F

from trackline.operators import parse as R
from trackline.operators import phrases as P
from trackline.operators import targets as Y

ALIASES = [
    ("шахед", "SHAHED", "family", 1, 1, 1, None, 3, "*", None, False, 10), ("бпла", "UAV", "category", 1, None, None, None, 2, "*", None, False, 10), ("дрон", "UAV", "category", 1, None, None, None, 2, "uk", None, False, 10),
    ("балістик", "BALLISTIC", "class", 2, 5, None, None, 2, "*", None, False, 10), ("крилата ракета", "CRUISE", "class", 2, 6, None, None, 2, "*", None, False, 10), ("ракет", "MISSILE", "category", 2, None, None, None, 2, "*", None, False, 10),
    ("х-101", "KH101", "model", 2, 6, 7, 8, 3, "*", None, True, 20), ("мопед", "SHAHED", "family", 1, 1, 1, None, 2, "*", 7, False, 10), ("geran", "SHAHED", "family", 1, 1, 1, None, 2, "en", None, False, 10),
]
ALIAS = "alias string, code string, level string, category_id long, class_id long, family_id long, model_id long, confidence int, lang string, source_id long, exact boolean, priority int"
PLACES = [
    (1, "Київ", ["київ", "києв"], "city", None, 1, 2_900_000), (2, "Сумська область", ["сумськ област", "сумщин"], "region", None, 2, 0), (3, "Чернігівська область", ["чернігівськ област", "чернігівщин"], "region", None, 3, 0), (4, "Київська область", ["київськ област", "київщин"], "region", None, 4, 0),
    (10, "Суми", ["сум"], "city", 2, 2, 260_000), (11, "Конотоп", ["конотоп"], "city", 2, 2, 84_000), (12, "Бровари", ["бровар"], "city", 4, 4, 108_000), (13, "Подільський район", ["подільськ район", "поділ"], "district", 1, 1, 0),
    (20, "Дмитрівка", ["дмитрівк"], "village", 2, 2, 3_000), (21, "Дмитрівка", ["дмитрівк"], "village", 4, 4, 9_000), (22, "Мир", ["мир"], "village", 3, 3, 90), (23, "Ніжин", ["ніжин"], "town", 3, 3, 66_000),
]
PLACE = "place_id long, name string, stems array<string>, level string, parent_id long, region_id long, population long"


def parsed(spark, *texts, source=1, home=None):
    aliases, places = spark.createDataFrame(ALIASES, ALIAS), spark.createDataFrame(PLACES, PLACE)
    messages = spark.createDataFrame([(i, source, t, home) for i, t in enumerate(texts)], "message int, source_id long, text string, home long")
    rows = R.facts(messages, aliases, places).orderBy("message", "segment", "target.start").collect()
    return [[r for r in rows if r.message == i] for i in range(len(texts))]


def said(r):
    place = lambda p: p and p.name
    return (r.event, r.target and r.target.code, r["count"], place(r.current), place(r.origin), place(r.destination))


CORPUS = {
    "3 шахеди на Конотоп": [("target_observed", "SHAHED", 3, None, None, "Конотоп")],
    "Група БпЛА курсом на Бровари": [("target_observed", "UAV", 3, None, None, "Бровари")],
    "БпЛА з Чернігівщини на Київ": [("target_observed", "UAV", None, None, "Чернігівська область", "Київ")],
    "БпЛА над Конотопом": [("target_observed", "UAV", None, "Конотоп", None, None)],
    "БпЛА шахед х5 повз Ніжин": [("target_observed", "SHAHED", 5, "Ніжин", None, None)],
    "Сумщина:\nшахеди біля Дмитрівки\nБпЛА летить": [("target_observed", "SHAHED", None, "Дмитрівка", None, None), ("target_observed", "UAV", None, "Сумська область", None, None)],
    "Балістика!\nСуми - в укриття": [("target_observed", "BALLISTIC", None, "Суми", None, None)],
    "Шахеди:\nна Конотоп\nна Бровари": [("target_observed", "SHAHED", None, None, None, "Конотоп"), ("target_observed", "SHAHED", None, None, None, "Бровари")],
    "Відбій повітряної тривоги": [("alert_cancelled", None, None, None, None, None)],
    "Вибухи у Києві": [("explosion", None, None, "Київ", None, None)],
    "Крилата ракета х-101 на Суми": [("target_observed", "KH101", None, None, None, "Суми")],
    "Нам потрібен мир": [],
    "Просто новини без цілей": [],
}


def test_corpus(spark):
    got = parsed(spark, *CORPUS)
    for (text, want), rows in zip(CORPUS.items(), got, strict=True):
        assert [said(r) for r in rows] == want, text


def test_gates_numbers_and_quadrants(spark):
    numbers = {"близько 10 шахедів": (10, True), "до 5х шахедів": (5, True), "кілька шахедів": (3, True), "п'ять шахедів": (5, False), "шахеди 5 од": (5, False), "шахеди 5": (None, False), "1500 шахедів": (None, False), "шахеди": (None, False), "два великих шахеди": (2, False)}
    gates = ["Чернігівщина:\nБпЛА на Дмитрівку", "БпЛА на Дмитрівку", "БпЛА на Дмитрівку, це Сумщина", "БпЛА над Мир", "БпЛА мир", "БпЛА Поділ", "Київ: БпЛА над Подолом і Поділ", "БпЛА сумнівний"]
    quadrants = ["БпЛА на півночі Київщини", "БпЛА у східній частині Сумщини", "БпЛА в центрі Києва", "Балістика!\nкурсом на південь\nна Суми", "мопед на Суми", "geran на Суми", "Можливо 2 шахеди на півночі Київщини"]
    rows = parsed(spark, *gates, *quadrants, *numbers)
    names = [[p.place_id for p in r[0].places] for r in rows[:8]]
    assert names[0] == [3]  # no Dmytrivka lies there: somewhere in the section
    assert names[1] == [21] and names[2] == [20, 2]
    assert names[3] == [22] and names[4] == []  # a small village needs a cue
    assert names[5] == [] and names[6][:2] == [1, 13]  # a city's district needs the city
    assert rows[6][0].current.place_id == 13  # the nested place wins
    assert names[7] == []
    rows = rows[8:]
    assert [r[0].current.quadrant_deg for r in rows[:3]] == [0.0, 90.0, None]
    assert [(r.target.code, r.inherited, r.segment) for r in rows[3]] == [("BALLISTIC", "carry", 1)]
    assert rows[4] == [] and len(rows[5]) == 1  # one source's alias; English counts everywhere
    assert rows[6][0].hedged
    assert [(r[0]["count"], r[0].approximate) for r in rows[7:]] == list(numbers.values())


def test_home_and_source(spark):
    rows = parsed(spark, "БпЛА Поділ", "мопед на Суми", source=7, home=1)
    assert [p.place_id for p in rows[0][0].places] == [13] and len(rows[1]) == 1


def test_facts_become_targets(spark):
    place = {"place_id": 4, "name": "Київська область", "level": "region", "lon": 30.5, "lat": 50.3, "radius_km": 146.0, "parent_id": None, "quadrant_deg": 0.0, "text": "київщини"}
    town = place | {"place_id": 12, "name": "Бровари", "level": "city", "radius_km": 3.0, "parent_id": 4, "quadrant_deg": None, "lat": 50.51, "lon": 30.79, "text": "бровар"}
    schema = f"i int, segment string, trust double, structured boolean, target_level string, alias_confidence int, hedged boolean, compass_deg double, current {Y.PLACE}, origin {Y.PLACE}, destination {Y.PLACE}, approach_deg double"
    data = [(1, "", 0.9, False, "family", 3, True, None, place, None, None, None), (2, "", 0.7, False, "family", 3, False, None, place, None, town, 200.0), (3, "біля бровар район", 0.5, True, None, None, False, 45.0, town, None, None, None), (4, "", 0.9, False, "class", 2, False, None, None, None, None, None)]
    got = {r.i: r for r in Y.build(spark.createDataFrame(data, schema)).collect()}
    assert (got[1].confidence, got[1].model_confidence, round(got[1].accuracy_km, 3)) == (2, 2, 87.6) and got[1].lat > 50.9
    assert (got[2].kind, got[2].place_id, got[2].direction_deg, got[2].direction_confidence) == ("direction", 12, 200.0, 1)
    assert (got[3].confidence, got[3].kind, got[3].accuracy_km, got[3].direction_kind) == (4, "district", 25.0, "compass")
    assert (got[4].kind, got[4].lon, got[4].model_confidence) == ("unknown", None, 0)


def test_phrases(spark):
    cases = {"увага відбій зараз тривоги": ("alert_cancelled", 0), "загроза поки що ще не минула": ("target_cancelled", 4), "загроза раз два три чотири п'ять минула": ("unknown", None), "повітряна тривога": ("air_raid_alert", 10), "не зараз фіксують": ("target_cancelled", 8), "": ("unknown", None)}
    df = spark.createDataFrame([(i, t.split()) for i, t in enumerate(cases)], "i int, t array<string>")
    got = df.select("i", P.event(F.col("t"), F.lit(False)).alias("e")).orderBy("i").select("e.*").collect()
    assert [r.event for r in got] == [e for e, _ in cases.values()]
    assert [r.rule for r in got] == [n if n is None else "event:" + "_".join(P.PHRASES[n][0]) for _, n in cases.values()]
    header = spark.createDataFrame([(0, ["повітряна", "тривога"]), (1, ["тривога", "жовтий", "рівень"]), (2, ["рівень", "небезпеки", "червоний"])], "i int, t array<string>")
    got = header.select("i", P.event(F.col("t"), F.lit(True)).alias("e")).orderBy("i").select("e.*").collect()
    assert [(r.event, r.level) for r in got] == [("target_observed", None), ("air_raid_alert", "yellow"), ("target_observed", "red")]


def test_only_dictionaries_are_broadcast(spark, monkeypatch):
    plans, real = [], R.written
    noted = lambda df: plans.append(df._jdf.queryExecution().toString()) or df
    monkeypatch.setattr(R, "written", lambda df, name: real(noted(df), name))
    messages = spark.createDataFrame([(1, 1, "шахед на Суми", None)], "message int, source_id long, text string, home long")
    noted(R.facts(messages, spark.createDataFrame(ALIASES, ALIAS), spark.createDataFrame(PLACES, PLACE)))
    assert len(plans) > 5 and any("SortMergeJoin [message" in p for p in plans)
    assert not any("BroadcastHashJoin [message" in p for p in plans)
