"""Feeds into messages: payloads, row build, snapshot differences, alert histories, forwards, poll health, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MESSAGE = "kind STRING, channelId BIGINT, channel STRING, messageId INT, date TIMESTAMP, editDate TIMESTAMP, text STRING, forwardedFrom STRING, forwardedDate TIMESTAMP, hasMedia BOOLEAN, mediaType STRING, views INT, groupedId BIGINT, urls ARRAY<STRING>"
ALERT = "kind STRING, at TIMESTAMP, alert STRUCT<id: BIGINT, alert_type: STRING, alert_level: STRING, location_type: STRING, location_title: STRING, location_oblast: STRING, location_raion: STRING, started_at: TIMESTAMP, finished_at: TIMESTAMP>"


def message_columns(raw: DataFrame, payload: str = "raw_payload") -> DataFrame:
    """The payload's fields as columns; missing ones, and zero views and groups, are null."""
    p = raw.withColumn("__p", F.from_json(payload, MESSAGE)).select(*raw.columns, "__p.*")
    return p.withColumns({c: F.when(F.col(c) != 0, F.col(c)) for c in ("views", "groupedId")})


def message_rows(posts: DataFrame) -> DataFrame:
    """source_message_id with the edit's time behind it, published_at, text; rows with neither text nor media go."""
    kept = posts.filter((F.coalesce(F.trim("text"), F.lit("")) != "") | F.coalesce("hasMedia", F.lit(False)))
    edit = F.when(F.col("editDate").isNotNull(), F.concat(F.lit(":e"), F.unix_timestamp("editDate").cast("string"))).otherwise("")
    return kept.withColumns({"source_message_id": F.concat(F.col("messageId").cast("string"), edit), "published_at": F.coalesce("editDate", "date")})


def post_key(source_message_id: Column) -> Column:
    return F.regexp_replace(source_message_id, r":e\d+$", "")


def is_edit(source_message_id: Column) -> Column:
    return F.regexp_like(source_message_id, F.lit(r":e\d+$"))


def forwarded_channel(text: Column) -> Column:
    return F.regexp_extract(text, r"^channel (\d+)$", 1).try_cast("long")


def channel_map(messages: DataFrame) -> DataFrame:
    """channel_id, source_id: the source that last wrote under a channel."""
    return messages.filter("channel_id is not null").groupBy("channel_id").agg(F.max_by("source_id", "raw_message_id").alias("source_id"))


def resolve_forwards(messages: DataFrame, channels: DataFrame) -> DataFrame:
    """forwarded_source_id of forwards from a known other source; forwarded_external where the channel is unknown."""
    known = channels.select(F.col("channel_id").alias("__c"), F.col("source_id").alias("__s"))
    m = messages.withColumn("__f", forwarded_channel(F.col("forwarded_from"))).join(known, F.col("__f") == F.col("__c"), "left")
    inside = F.when(F.col("__s") != F.col("source_id"), F.col("__s"))
    return m.withColumns({"forwarded_source_id": inside, "forwarded_external": F.col("forwarded_from").isNotNull() & F.col("__s").isNull()}).drop("__f", "__c", "__s")


def snapshot_changes(known: DataFrame, active: DataFrame, at: Column, stored: DataFrame | None = None) -> DataFrame:
    """alert_id, kind, at: what a poll's active set starts and ends against the set of the poll before.

    ``stored``: alerts without an end in the store; those in neither set were not started by this feed, or ended unseen, and end
    too. Ending is idempotent by id, so an alert that ends again is no harm.
    """
    one = lambda df, name: df.select("alert_id").distinct().withColumn(name, F.lit(True))
    held = one(known if stored is None else known.select("alert_id").unionByName(stored.select("alert_id")), "__k")
    before = one(known, "__b")
    both = held.join(one(active, "__a"), "alert_id", "full").join(before, "alert_id", "left")
    starts, ends = F.col("__a").isNotNull() & F.col("__b").isNull(), F.col("__a").isNull()
    return both.filter(starts | ends).select("alert_id", F.when(ends, "alert.finished").otherwise("alert.started").alias("kind"), at.alias("at"))


def history_events(alerts: DataFrame) -> DataFrame:
    """A start and an end event of every closed alert; open ones and those without a start have none."""
    closed = alerts.filter("started_at is not null and finished_at is not null")
    pair = F.array(F.struct(F.lit("alert.started").alias("kind"), F.col("started_at").alias("at")), F.struct(F.lit("alert.finished").alias("kind"), F.col("finished_at").alias("at")))
    return closed.select("alert_id", F.explode(pair).alias("e")).select("alert_id", "e.*")


def above_watermark(messages: DataFrame, watermark: int, received_before: Column, limit: int = 500) -> DataFrame:
    """The next messages in order of id that arrived before the safety lag."""
    return messages.filter((F.col("raw_message_id") > watermark) & (F.col("received_at") < received_before)).orderBy("raw_message_id").limit(limit)


def resume_points(messages: DataFrame) -> DataFrame:
    """The highest numeric message id stored of each source."""
    return messages.groupBy("source_id").agg(F.max(F.split("source_message_id", ":")[0].try_cast("long")).alias("last_id"))


def poll_health(polls: DataFrame) -> DataFrame:
    """Per source: last poll, success and message, failures since the last success, and the last error's first 2000 signs."""
    w = Window.partitionBy("source_id").orderBy("at")
    runs = polls.withColumn("__run", F.sum(F.col("ok").cast("int")).over(w))
    last_run = F.max("__run").over(Window.partitionBy("source_id"))
    tail = runs.withColumn("__last", last_run)
    return tail.groupBy("source_id").agg(
        F.max("at").alias("last_polled_at"), F.max(F.when(F.col("ok"), F.col("at"))).alias("last_success_at"), F.max("message_at").alias("last_message_at"),
        F.count_if((F.col("__run") == F.col("__last")) & ~F.col("ok")).alias("failures"), F.left(F.max_by("error", F.when(~F.col("ok"), F.col("at"))), F.lit(2000)).alias("error"),
    )


def insert_only(stored: DataFrame, file_rows: DataFrame, key: str) -> DataFrame:
    """The stored rows, and those of the file whose key is new."""
    return stored.unionByName(file_rows.join(stored.select(key), key, "left_anti"), allowMissingColumns=True)


def upsert(stored: DataFrame, fresh: DataFrame, key: str, newest: str) -> DataFrame:
    """Rows by key, the fresh ones winning; of several fresh rows of a key the one with the greatest ``newest``, a column of
    ``fresh`` alone. Ties go to the row that sorts last, so the outcome does not depend on partitions."""
    columns = [c for c in fresh.columns if c not in (key, newest)]
    last = fresh.groupBy(key).agg(F.max(F.struct(newest, *columns)).alias("__r")).select(key, *[F.col("__r")[c].alias(c) for c in columns])
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(last, allowMissingColumns=True)


def prune_aliases(stored: DataFrame, files: DataFrame) -> DataFrame:
    """Aliases that the files still have, or that belong to one source."""
    keys = ["alias", "target"]
    gone = stored.filter("source_id is null").join(files.select(*keys), keys, "left_anti")
    return stored.join(gone.select(*keys), keys, "left_anti").unionByName(stored.filter("source_id is not null").join(gone.select(*keys), keys, "left_semi"))


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Classes of a JSON file of categories, with the defaults of missing metadata: category, code, name, eta_enabled, display, fade_min, window_min, speeds."""
    meta = "STRUCT<speedKmhMin: DOUBLE, speedKmhMax: DOUBLE, etaEnabled: BOOLEAN, displayMode: STRING, fadeMinutes: INT, correlationWindowMinutes: INT>"
    schema = f"categories ARRAY<STRUCT<code: STRING, name: STRING, classes: ARRAY<STRUCT<code: STRING, name: STRING, metadata: {meta}>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("categories").alias("c")).select(F.col("c.code").alias("category"), F.explode("c.classes").alias("k"))
    m = "k.metadata."
    return rows.select(
        "category", F.col("k.code").alias("code"), F.col("k.name").alias("name"), F.coalesce(m + "etaEnabled", F.lit(False)).alias("eta_enabled"), F.coalesce(m + "displayMode", F.lit("uav")).alias("display"),
        F.coalesce(m + "fadeMinutes", F.lit(20)).alias("fade_min"), F.coalesce(m + "correlationWindowMinutes", F.lit(30)).alias("window_min"), F.col(m + "speedKmhMin").alias("speed_min"), F.col(m + "speedKmhMax").alias("speed_max"),
    )


def settlements(spark: SparkSession, path: str) -> DataFrame:
    """Populated places of a tab-separated gazetteer dump, with level by size and radius by the root of the population."""
    names = "geonameid LONG, name STRING, asciiname STRING, alternatenames STRING, lat DOUBLE, lon DOUBLE, fclass STRING, fcode STRING, country STRING, cc2 STRING, admin1 STRING, admin2 STRING, admin3 STRING, admin4 STRING, population LONG"
    raw = spark.read.schema(names).option("sep", "\t").option("quote", "").csv(path)
    level = F.when((F.col("population") >= 50_000) | F.col("fcode").isin("PPLC", "PPLA"), "city").when(F.col("population") >= 5_000, "town").otherwise("village")
    kept = raw.filter((F.col("fclass") == "P") & ~F.col("fcode").isin("PPLX", "PPLH", "PPLQ", "PPLW"))
    return kept.select("geonameid", "name", "lon", "lat", "population", level.alias("level"), F.greatest(F.lit(1.5), 0.01 * F.sqrt("population")).alias("radius_km"))


def alternate_names(names: DataFrame) -> DataFrame:
    """geonameid with its uk and ru names, preferred ones first (columns seq, geonameid, lang, name, preferred)."""
    rows = names.filter(F.col("lang").isin("uk", "ru")).groupBy("geonameid", "lang").agg(F.array_sort(F.collect_list(F.struct((~F.col("preferred")).alias("late"), "seq", "name"))).alias("n"))
    return rows.groupBy("geonameid").agg(*[F.first(F.when(F.col("lang") == x, F.col("n.name")), ignorenulls=True).alias(x) for x in ("uk", "ru")])


def features(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON collections: properties as a map, type, and rings: outer ones and holes of all parts, in order."""
    schema = "features ARRAY<STRUCT<properties: MAP<STRING, STRING>, geometry: STRUCT<type: STRING, coordinates: STRING>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.properties", "f.geometry.*")
    one, many = F.from_json("coordinates", "array<array<array<double>>>"), F.flatten(F.from_json("coordinates", "array<array<array<array<double>>>>"))
    rings = F.when(F.col("type") == "MultiPolygon", many).when(F.col("type") == "Polygon", one)
    return rows.select("properties", "type", F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))).alias("rings"))


def chosen_features(found: DataFrame, name: str, codes: DataFrame | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """Features with rings whose property ``name`` is in ``codes`` (column code), if given, and begins with none of ``skip``;
    the property as column code."""
    rows = found.withColumn("code", F.col("properties")[name]).filter(F.col("code").isNotNull() & F.col("rings").isNotNull())
    for prefix in skip:
        rows = rows.filter(~F.col("code").startswith(prefix))
    return rows.join(codes.select("code").distinct(), "code", "left_semi") if codes is not None else rows


def log_entries(lines: DataFrame, level: str | None = None, contains: str | None = None) -> DataFrame:
    """Entries of log files: a line that starts with a date opens one, the lines behind it belong to it.

    ``lines``: file, line_no, value.
    """
    w = Window.partitionBy("file").orderBy("line_no")
    starts = F.regexp_like("value", F.lit(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}"))
    numbered = lines.withColumn("__e", F.sum(starts.cast("int")).over(w))
    entries = numbered.groupBy("file", "__e").agg(F.min("line_no").alias("line_no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda r: r["value"]), "\n").alias("entry"))
    entries = entries.withColumn("level", F.regexp_extract("entry", r"\[(TRC|DBG|INF|WRN|ERR|FTL)\]", 1)).drop("__e")
    entries = entries.filter(F.col("level") == level) if level else entries
    return entries.filter(F.lower("entry").contains(contains.lower())) if contains else entries
