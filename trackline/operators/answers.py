"""Stored answers of a language model into facts, and the messages that would need one.

Answers are loose JSON: any part may be missing, null or of the wrong type, and some are no JSON at all. They are parsed once into
a variant; each field is then taken with a cast that gives null where it does not fit. Codes and place names are looked up in
their dictionaries by joins; what no dictionary knows is dropped and counted, never invented.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackline.functions import text as T

# The events and roles that an answer may name, in lower case without marks.
EVENTS = {"targetobserved": "target_observed", "airraidalert": "air_raid_alert", "alertcancelled": "alert_cancelled", "targetcancelled": "target_cancelled", "airdefenseactivity": "air_defence", "explosionreport": "explosion", "unknown": "unknown"}
ROLES = ("current", "origin", "destination", "transit")
LEVELS = ("category", "class", "family", "model")
# Confidence of a code by its level; a model's is medium, all others are low.
MEDIUM, LOW = 2, 1


def _field(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def spoken_facts(answers: DataFrame) -> DataFrame:
    """``message_id, fact, event, level, code, hedged, count, approximate, direction_deg, launch, segment, quote, places``: one
    row for each object in an answer's ``facts``; fact is its place there. ``answers``: message_id, answer."""
    parsed = answers.select("message_id", F.try_parse_json("answer").alias("v"))
    each = parsed.select("message_id", F.posexplode(_field(F.col("v"), "$.facts", "array<variant>")).alias("fact", "f")).filter("f is not null")
    f = F.col("f")
    name = F.lower(F.regexp_replace(_field(f, "$.event_type", "string"), "[^A-Za-z]", ""))
    known = F.create_map(*[F.lit(x) for kv in EVENTS.items() for x in kv])
    level = F.lower(_field(f, "$.target.level", "string"))
    code = F.nullif(_field(f, "$.target.code", "string"), F.lit(""))
    flag = lambda path: F.coalesce(_field(f, path, "boolean"), F.lit(False))
    return each.select(
        "message_id", "fact", F.coalesce(F.try_element_at(known, name), F.lit("unknown")).alias("event"), F.when(level.isin(*LEVELS), level).alias("level"), F.lower(code).alias("code"), flag("$.hedged").alias("hedged"),
        _field(f, "$.count", "int").alias("count"), flag("$.count_approx").alias("approximate"), F.pmod(_field(f, "$.direction_deg", "double"), F.lit(360.0)).alias("direction_deg"), flag("$.launch").alias("launch"),
        F.coalesce(_field(f, "$.segment", "int"), F.lit(0)).alias("segment"), _field(f, "$.quote", "string").alias("quote"), _field(f, "$.places", "array<variant>").alias("places"),
    )


def mapped(answers: DataFrame, codes: DataFrame, names: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """``message_id, fact, event, target_id, confidence, hedged, count, approximate, direction_deg, launch, segment, quote, current,
    origin, destination, transit, unknown_codes, unknown_places``.

    A fact without a known code is kept only if its event is one of its own, such as an alert. An event that no one knows is an
    observation. Of several places of a role the first known one counts; an unknown role is the current place. Directions are
    taken into 0 to 360. ``codes``: level, code, target_id. ``names``: name, place_id (of equal names the least id).
    ``segments``: message_id, n; a segment's number is kept inside them.
    """
    facts = spoken_facts(answers)
    dictionary = codes.groupBy("level", F.lower("code").alias("code")).agg(F.min("target_id").alias("target_id"))
    facts = facts.join(dictionary, ["level", "code"], "left")
    key = ["message_id", "fact"]
    place = facts.select(*key, F.posexplode("places").alias("at", "p")).select(*key, "at", T.folded_name(_field(F.col("p"), "$.name", "string")).alias("name"), F.lower(_field(F.col("p"), "$.role", "string")).alias("role")).filter("name <> ''")
    known = place.join(names.groupBy(T.folded_name(F.col("name")).alias("name")).agg(F.min("place_id").alias("place_id")), "name", "left")
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("current")
    named = known.withColumn("role", role).groupBy(*key).agg(*[F.min_by("place_id", F.when(F.col("place_id").isNotNull() & (F.col("role") == r), F.col("at"))).alias(r) for r in ROLES], F.count_if(F.col("place_id").isNull()).alias("unknown_places"))
    rows = facts.drop("places").join(named, key, "left")
    if segments is not None:
        last = segments.groupBy("message_id").agg((F.max("n") - 1).alias("__last"))
        rows = rows.join(last, "message_id", "left").withColumn("segment", F.greatest(F.lit(0), F.least("segment", F.coalesce("__last", F.lit(0))))).drop("__last")
    kept = rows.filter(F.col("target_id").isNotNull() | ~F.col("event").isin("unknown", "target_observed"))
    return kept.select(
        *key, F.when(F.col("event") == "unknown", "target_observed").otherwise(F.col("event")).alias("event"), "target_id", F.when(F.col("target_id").isNotNull(), F.when(F.col("level") == "model", MEDIUM).otherwise(LOW)).alias("confidence"), "hedged", "count", "approximate", "direction_deg", "launch", "segment", "quote", *ROLES,
        (F.col("code").isNotNull() & F.col("target_id").isNull()).cast("int").alias("unknown_codes"), F.coalesce("unknown_places", F.lit(0)).cast("long").alias("unknown_places"),
    )


def second_look(messages: DataFrame, facts: DataFrame, stems: list[str], now: Column, hours: float) -> DataFrame:
    """Messages without a fact that hold a word with one of the stems and are no older than ``hours`` (0: of any age).

    ``messages``: message_id, tokens, published_at. ``facts``: message_id.
    """
    told = F.exists("tokens", lambda t: reduce(lambda a, b: a | b, [t.startswith(s) for s in stems]))
    rows = messages.filter(told) if hours <= 0 else messages.filter(told & (F.col("published_at") >= now - F.make_dt_interval(mins=F.lit(int(hours * 60)))))
    return rows.join(facts.select("message_id").distinct(), "message_id", "left_anti")
