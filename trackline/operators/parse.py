"""Messages into facts with all rules: dictionaries joined to tokens, gates of places, roles, quadrants, counts, inheritance.

Dictionaries meet tokens by an equality join on the first three letters. Places are chosen twice: first without context, which
gives the regions that a message is about and its section headers, then with both. What runs along a message, headings and
bare targets that carry over, is a fold over its segments; everything else is joins, windows and array functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackline.functions import text as T
from trackline.operators import extract as X
from trackline.operators import phrases as P
from trackline.operators.components import written

# Number words, stems of vague numbers, words in front of a number that make it vague, and units behind one.
NUMBERS = {"один": 1, "одна": 1, "пара": 2, "два": 2, "дві": 2, "три": 3, "чотири": 4, "п'ять": 5, "шість": 6, "сім": 7, "вісім": 8, "дев'ять": 9, "десять": 10, "две": 2, "пять": 5, "шесть": 6, "семь": 7, "восемь": 8, "девять": 9}
VAGUE = (("одиничн", 1), ("одиночн", 1), ("груп", 3), ("декільк", 3), ("кільк", 3), ("нескольк", 3), ("масован", 10), ("рій", 5))
ABOUT, UNITS = ("до", "близько", "понад", "орієнтовно", "~", "около"), ("од", "шт", "одиниць", "одиниці")
# Words for kinds of places, words before a small place, prepositions and endings that tell a place's part.
KINDS = ("район", "р-н", "област", "обл", "громад", "місто", "місті", "село", "селищ", "смт", "вулиц", "масив")
CUES = ("на", "в", "у", "до", "з", "із", "зі", "від", "над", "біля", "поблизу", "неподалік", "повз", "через", "н.п", "с", "смт", "м", "село", "селище", "районі", "бік", "сторону", "напрямку")
FROM = ("з", "із", "зі", "від", "из", "со", "от")
NEAR = ("над", "поблизу", "біля", "неподалік", "повз", "районі", "околицях", "околиці", "територією", "території", "межах", "небі", "возле", "около", "вблизи")
THROUGH = ("через", "повз")
TOWARDS = ("курсом на", "курс на", "курсом в", "курсом у", "в напрямку", "у напрямку", "напрямку", "в бік", "у бік", "в сторону", "прямує на", "прямують на", "рухається на", "рухаються на", "летить на", "летять на", "до", "в напрямку на", "у напрямку на", "тримає курс на", "тримають курс на", "курсом", "курс")
LOCATIVE, ACCUSATIVE = ("і", "ї", "ах", "ях", "ій", "ому", "ім", "ині", "щині"), ("у", "ю", "щину", "ину")
QUARTERS = (("північно-схід", 45.0), ("північно-захід", 315.0), ("південно-схід", 135.0), ("південно-захід", 225.0), ("півноч", 0.0), ("північн", 0.0), ("півдн", 180.0), ("південн", 180.0), ("схід", 90.0), ("сход", 90.0), ("східн", 90.0), ("захід", 270.0), ("заход", 270.0), ("західн", 270.0), ("центр", -1.0))
PARTS = ("частині", "частина", "частин", "області", "обл")
SMALL = 500  # inhabitants under which a village needs a cue
LEVELS = ("country", "region", "area", "city", "district", "hromada", "town", "village")
BONUS = {"region": 5, "area": 5, "city": 4, "district": 3, "town": 2}
TARGET_DEPTH = {"category": 1, "class": 2, "family": 3, "model": 4}


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _ends(word: Column, endings) -> Column:
    return _any([word.endswith(e) for e in endings])


def _before(tokens: Column, start: Column, n: int) -> Column:
    return F.when(start >= n, F.get(tokens, start - n)).otherwise("")


def count_near(tokens: Column, start: Column) -> Column:
    """struct(count, approximate) of the objects that a mention at ``start`` speaks of; nulls where no number is named.

    Up to three words before it: a number below 1000, a number word, or a vague one, the first that stands there. Else up to
    three words behind it: ``x5``, or a number with a unit.
    """
    words = F.create_map(*[F.lit(v) for kv in NUMBERS.items() for v in kv])
    found = lambda n, about: F.struct(n.cast("int").alias("count"), about.alias("approximate"))
    number = lambda text: F.when(F.regexp_like(text, F.lit(r"^[0-9]{1,3}$")) & (text.try_cast("int") > 0), text.try_cast("int"))

    def before(i: Column) -> Column:
        t = F.get(tokens, i)
        figure, vague = number(F.regexp_replace(t, "[хx]+$", "")), F.coalesce(*[F.when(t.startswith(s), v) for s, v in VAGUE])
        about = F.when(i > 0, F.get(tokens, i - 1)).otherwise("").isin(*ABOUT)
        word = F.try_element_at(words, t)
        return F.when(figure.isNotNull(), found(figure, about)).when(word.isNotNull(), found(word, F.lit(False))).when(vague.isNotNull(), found(vague, F.lit(True)))

    def after(i: Column) -> Column:
        t = F.get(tokens, i)
        bare = F.regexp_replace(t, "^[хx]+", "")
        unit = F.coalesce(F.get(tokens, i + 1).isin(*UNITS), F.lit(False))
        return F.when(number(bare).isNotNull() & ((bare != t) | unit), found(number(bare), F.lit(False)))

    places = F.concat(F.transform(F.filter(F.sequence(start - 3, start - 1), lambda i: i >= 0), before), F.transform(F.filter(F.sequence(start + 1, start + 3), lambda i: i < F.size(tokens)), after))
    none = F.struct(F.lit(None).cast("int").alias("count"), F.lit(False).alias("approximate"))
    return F.when(start <= F.size(tokens), F.coalesce(F.get(F.filter(places, lambda v: v.isNotNull()), F.lit(0)), none)).otherwise(none)


def quadrant(tokens: Column, start: Column) -> Column:
    """Bearing of the part of a place that the words before it name ("in the eastern part of"); null without one."""
    def at(i: Column) -> Column:
        between = F.forall(F.slice(tokens, i + 2, start - i - 1), lambda t: t.isin(*PARTS))
        t = F.get(tokens, i)
        degree = F.coalesce(*[F.when(t.startswith(stem) & (F.length(t) - len(stem) <= 4), F.lit(d)) for stem, d in QUARTERS])
        return F.when(between, degree)

    named = F.transform(F.filter(F.sequence(start - 3, start - 1), lambda i: i >= 0), at)
    first = F.get(F.filter(named, lambda d: d.isNotNull()), F.lit(0))
    return F.when(first >= 0, first)


def role(tokens: Column, start: Column, n: Column, language: Column, nominative: Column) -> Column:
    """destination, origin, transit or current, by up to three words before a place and its own ending."""
    one, two, three = (_before(tokens, start, k) for k in (1, 2, 3))
    phrases = [(p.split(), p) for p in TOWARDS]
    towards = _any([{1: one == p, 2: F.concat_ws(" ", two, one) == p, 3: F.concat_ws(" ", three, two, one) == p}[len(w)] for w, p in phrases])
    name = F.get(tokens, start + n - 1)
    at = one.isin("на", "в", "у")
    return (
        F.when(towards, "destination").when(one.isin(*FROM) | ((one == "с") & (language == "ru")) | ((one == "боку") & (two == "з")), "origin").when(one.isin(*THROUGH), "transit")
        .when(one.isin(*NEAR) | two.isin(*NEAR), "current").when(at & _ends(name, LOCATIVE), "current").when(at & (_ends(name, ACCUSATIVE) | nominative), "destination").otherwise("current")
    )


def adjective(stem: Column, tokens: Column, i: Column) -> Column:
    """A place's adjective before a word for district or community."""
    t, unit = F.get(tokens, i), F.get(tokens, i + 1)
    rest = F.substr(t, F.length(stem) + 1)
    follows = F.coalesce(unit.startswith("район") | (unit == "р-н") | unit.startswith("громад") | unit.startswith("тг"), F.lit(False))
    return t.startswith(stem) & follows & F.length(rest).between(3, 9) & (rest.contains("ськ") | rest.contains("цьк") | rest.contains("зьк"))


def _met(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """Both sides grow with the messages, so neither is to be broadcast: their files are small for their rows, as messages
    repeat each other, and Spark goes by the files."""
    return left.join(right.hint("merge"), key, how)


def mentions(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """``message, segment, targets``: the targets of each segment, by place, none covered by another.

    ``rows``: message, segment, source_id, language, tokens. ``aliases``: alias, code, level, category_id, class_id, family_id, model_id, confidence,
    lang (``*``: any; en counts everywhere), source_id (null: all sources), exact, priority.
    """
    named = aliases.withColumn("target", F.to_json(F.struct("code", "level", "category_id", "class_id", "family_id", "model_id", "confidence")))
    met = X.matches(rows, named.select("alias", "target", "exact", "priority").distinct(), ["message", "segment"])
    allowed = named.select("alias", "target", "lang", F.col("source_id").alias("only"))
    fit = _met(met, rows.select("message", "segment", "source_id", "language"), ["message", "segment"]).join(allowed, ["alias", "target"])
    fit = fit.filter((F.col("only").isNull() | (F.col("only") == F.col("source_id"))) & (F.col("lang").isin("*", "en") | (F.col("lang") == F.col("language"))))
    kept = X.resolve_overlaps(fit.select("message", "segment", "start", "n", "alias", "target", "priority", "chars").distinct(), ["message", "segment"])
    t = F.from_json("target", "code string, level string, category_id long, class_id long, family_id long, model_id long, confidence int")
    depth = F.create_map(*[F.lit(v) for kv in TARGET_DEPTH.items() for v in kv])[t["level"]]
    item = F.struct("start", t["code"].alias("code"), depth.alias("level"), t["category_id"].alias("category_id"), t["class_id"].alias("class_id"), t["family_id"].alias("family_id"), t["model_id"].alias("model_id"), t["confidence"].alias("confidence"), "n", "alias")
    return kept.groupBy("message", "segment").agg(F.collect_list(item).alias("m")).select("message", "segment", P.collapsed(F.col("m")).alias("targets"))


def candidates(rows: DataFrame, targets: DataFrame, places: DataFrame) -> DataFrame:
    """``message, segment, start, n, place_id, name, level, parent_id, region_id, population, chars, score``: every place at every token.

    Words for kinds of places and tokens of targets are no places; a short stem needs a token of about its length. ``places``:
    place_id, name, stems (array of variants), level, parent_id, region_id (its own for a region), population.
    """
    words = places.select("place_id", F.explode("stems").alias("stem")).withColumn("words", T.tokens(F.lower("stem"))).filter(F.size("words") > 0).withColumn("p3", F.left(F.col("words")[0], F.lit(3))).drop("stem").distinct()
    at = rows.select("message", "segment", "tokens", F.posexplode("tokens").alias("start", "token")).withColumn("p3", F.left("token", F.lit(3)))
    unit = _any([F.col("token").startswith(k) & (F.length("token") - len(k) <= 3) for k in KINDS])
    taken = targets.select("message", "segment", F.explode("targets").alias("t")).select("message", "segment", F.explode(F.sequence("t.start", F.col("t.start") + F.col("t.n") - 1)).alias("start"))
    met = _met(at.filter(~unit), taken, ["message", "segment", "start"], "left_anti").join(words, "p3")
    own, start = F.slice("tokens", F.col("start") + 1, F.size("words")), F.col("start")
    whole = (F.size(own) == F.size("words")) & F.forall(F.zip_with("words", own, lambda w, t: F.coalesce(T.stem_match(w, t, F.lit(False)), F.lit(False))), lambda v: v)
    stem = F.col("words")[0]
    adjectival = (F.size("words") == 1) & adjective(stem, F.col("tokens"), start)
    risky = (F.size("words") == 1) & (F.length(stem) <= 4) & (F.length("token") - F.length(stem) > 2) & ~adjectival
    chars = F.aggregate("words", F.lit(0), lambda n, w: n + F.length(w))
    fit = met.filter((whole | adjectival) & ~risky).select("message", "segment", "start", F.size("words").alias("n"), "place_id", chars.alias("chars"))
    fit = fit.groupBy("message", "segment", "start", "n", "place_id").agg(F.max("chars").alias("chars"))
    bonus = F.coalesce(*[F.when(F.col("level") == k, v) for k, v in BONUS.items()], F.lit(1))
    return fit.join(places.select("place_id", "name", "level", "parent_id", "region_id", "population"), "place_id").withColumn("score", F.col("chars") * 10 + bonus)


def _chosen(found: DataFrame, rows: DataFrame, context: DataFrame | None, cities: DataFrame) -> DataFrame:
    """One place for each span that stands: best candidate, gates, no overlaps. With ``context`` (message, regions) the segment's
    section and the message's regions count.

    A district of a city needs the city in the segment, in the message or as the source's home. A town or village outside the
    section is a namesake; a small village needs a cue before it or its own section.
    """
    key = ["message", "segment"]
    if context is None:
        found = found.withColumns({"regions": F.array().cast("array<long>"), "section": F.lit(None).cast("long"), "home": F.lit(None).cast("long")})
    else:
        found = _met(_met(found, rows.select(*key, "section", "home"), key), context, ["message"], "left").withColumn("regions", F.coalesce("regions", F.array().cast("array<long>")))
    city = cities.select(F.col("place_id").alias("parent_id"), F.lit(True).alias("of_city"))
    here = found.join(cities.select("place_id"), "place_id", "left_semi").groupBy(*key).agg(F.collect_set("place_id").alias("cities"))
    found = _met(found.join(city, "parent_id", "left"), here, key, "left")
    told = F.coalesce(F.array_contains("cities", F.col("parent_id")), F.lit(False)) | F.array_contains("regions", F.col("parent_id")) | F.coalesce(F.col("home") == F.col("parent_id"), F.lit(False))
    found = found.filter((F.col("level") != "district") | F.col("of_city").isNull() | told)
    inside = F.coalesce((F.col("region_id") == F.col("section")) | (F.col("place_id") == F.col("section")), F.lit(False))
    near = F.coalesce(F.array_contains("regions", F.col("region_id")) | (F.col("home") == F.col("region_id")), F.lit(False))
    order = F.struct((-F.col("chars")).alias("a"), (~inside).alias("b"), (~near).alias("c"), (~F.col("level").isin("region", "area")).alias("d"), (-F.col("population")).alias("e"), "place_id", "name", "level", "parent_id", "region_id", "population", inside.alias("inside"))
    best = found.groupBy(*key, "start", "n").agg(F.min(order).alias("p"), F.max("score").alias("score"), F.collect_set(T.folded_name(F.col("name"))).alias("names"), F.first("section").alias("section"))
    best = _met(best, rows.select(*key, "tokens", "language"), key)
    cued = F.exists(F.array(_before(F.col("tokens"), F.col("start"), 1), _before(F.col("tokens"), F.col("start"), 2)), lambda t: F.rtrim(t, F.lit(".")).isin(*CUES))
    foreign = F.col("section").isNotNull() & F.col("p.level").isin("town", "village") & ~F.col("p.inside")
    weak = (F.col("p.level") == "village") & (F.col("p.population") < SMALL) & ~cued & ~F.col("p.inside")
    spoken = F.array_join(F.slice("tokens", F.col("start") + 1, F.col("n")), " ")
    part = role(F.col("tokens"), F.col("start"), F.col("n"), F.col("language"), F.array_contains("names", spoken))
    best = best.filter(~foreign & ~weak)
    item = F.struct((-F.col("n")).alias("a"), (-F.col("score")).alias("b"), "start", "n", F.col("p.place_id").alias("place_id"), F.col("p.name").alias("name"), F.col("p.level").alias("level"), F.col("p.parent_id").alias("parent_id"), F.col("p.region_id").alias("region_id"), part.alias("role"), quadrant(F.col("tokens"), F.col("start")).alias("quadrant_deg"), spoken.alias("text"))
    lists = best.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("m"))
    kept = F.aggregate("m", F.slice("m", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: (x["start"] < y["start"] + y["n"]) & (y["start"] < x["start"] + x["n"])), acc).otherwise(F.concat(acc, F.array(x))))
    by_place = F.array_sort(F.transform(kept, lambda x: F.struct(x["start"], x["n"], x["place_id"], x["name"], x["level"], x["parent_id"], x["region_id"], x["role"], x["quadrant_deg"], x["text"])))
    return lists.select(*key, by_place.alias("places"))


def current_of(places: Column) -> Column:
    """The place an object is at: of the current ones the first that lies in another of them, else the first, else a transit."""
    now = F.filter(places, lambda p: p["role"] == "current")
    nested = F.filter(now, lambda p: F.exists(now, lambda q: F.coalesce(q["place_id"] == p["parent_id"], F.lit(False))))
    return F.coalesce(F.get(nested, F.lit(0)), F.get(now, F.lit(0)), first_of(places, "transit"))


def first_of(places: Column, part: str) -> Column:
    return F.get(F.filter(places, lambda p: p["role"] == part), F.lit(0))


def facts(messages: DataFrame, aliases: DataFrame, places: DataFrame) -> DataFrame:
    """The facts of all messages: message, segment, text, event, rule, launch, level, target, hedged, count, approximate, places,
    current, origin, destination, direction_deg, inherited (carry, header or null), in_section.

    A line that only names a region, or a city of its own, heads a section: the lines behind it lie there, and are somewhere in
    it if they name a target and no place. ``Target:`` heads all lines behind it, a bare target only the next one, and is no
    fact of its own then. ``messages``: message, source_id, text, home (region of the source, or null).
    """
    key = ["message", "segment"]
    base = messages.select("message", "source_id", "home", "text", T.language(F.col("text")).alias("language"))
    rows = X.segments(base, "text").select("message", "source_id", "home", "language", F.col("segment_index").alias("segment"), F.col("segment").alias("line"), "tokens")
    rows = written(rows, "segments")  # read by each of the steps below
    found_targets = written(mentions(rows, aliases), "mentions")
    none = spark_none(rows, "targets array<struct<start:int,code:string,level:int,category_id:long,class_id:long,family_id:long,model_id:long,confidence:int,n:int,alias:string>>")
    found = written(candidates(rows, found_targets, places), "place-candidates")
    cities = places.filter("level = 'city' and parent_id is null").select("place_id")
    first = _chosen(candidates(rows, found_targets.limit(0), places), rows, None, cities)
    told = first.select("message", F.explode("places").alias("p")).filter(F.col("p.level").isin("region", "city", "area") & F.col("p.region_id").isNotNull())
    context = written(told.groupBy("message").agg(F.collect_set(F.col("p.region_id").cast("long")).alias("regions")), "message-regions")
    heads = _chosen(found, rows.withColumn("section", F.lit(None).cast("long")), context, cities)
    rows = _met(rows, found_targets, key, "left").withColumn("targets", F.coalesce("targets", none))
    top = F.col("h")[0]
    region_level = top["level"].isin("region", "area") | ((top["level"] == "city") & top["parent_id"].isNull())
    colon = F.rtrim("line").endswith(":")
    head = (F.size("targets") == 0) & (F.size("h") == 1) & region_level & (colon | (F.size("tokens") <= 2))
    along = Window.partitionBy("message").orderBy("segment")
    rows = _met(rows, heads.withColumnRenamed("places", "h"), key, "left").withColumn("is_head", F.coalesce(head, F.lit(False)))
    rows = rows.withColumn("section_place", F.last(F.when(F.col("is_head"), top), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    rows = written(rows.withColumn("section", F.col("section_place.place_id").cast("long")).drop("h"), "segment-sections")
    chosen = _chosen(found, rows, context, cities)
    rows = _met(rows.filter(~F.col("is_head")), chosen, key, "left")
    somewhere = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("n"), *[F.col("section_place")[c].alias(c) for c in ("place_id", "name", "level", "parent_id", "region_id")], F.lit("current").alias("role"), F.lit(None).cast("double").alias("quadrant_deg"), F.col("section_place.name").alias("text")))
    placed = F.coalesce(F.size("places") > 0, F.lit(False))
    fallback = ~placed & F.col("section_place").isNotNull() & (F.size("targets") > 0)
    rows = rows.withColumns({"in_section": fallback, "places": F.when(placed, F.col("places")).when(fallback, somewhere).otherwise(F.slice(somewhere, 1, 0))})
    rows = rows.withColumns({"direction_deg": X.direction(F.col("tokens")), "e": P.event(F.col("tokens"), F.size("targets") > 0), "hedged": X.hedged(F.col("tokens"), F.col("line")), "colon": F.rtrim("line").endswith(":")})
    rows = written(rows, "segment-facts")
    line = F.struct("segment", F.get("targets", F.lit(0)).alias("own"), (F.size("places") > 0).alias("placed"), F.col("direction_deg").isNotNull().alias("directed"), F.col("e.event").isin("unknown", "target_observed").alias("plain"), "colon")
    carried = rows.groupBy("message").agg(F.array_sort(F.collect_list(line)).alias("lines")).select("message", F.explode(_inherited(F.col("lines"))).alias("x")).select("message", "x.*")
    rows = _met(rows, carried, key).filter("not dropped").withColumn("targets", F.when(F.col("inherited").isNotNull(), F.array("given")).otherwise(F.col("targets")))
    event = F.when((F.size("targets") > 0) & (F.col("e.event") == "unknown"), "target_observed").otherwise(F.col("e.event"))
    out = rows.filter((F.size("targets") > 0) | (F.col("e.event") != "unknown")).withColumn("target", F.explode_outer("targets"))
    counted = count_near(F.col("tokens"), F.col("target.start"))
    return out.select(
        *key, F.col("line").alias("text"), event.alias("event"), "e.rule", "e.launch", F.col("e.level").alias("level"), "target", (F.col("hedged") & F.col("target").isNotNull()).alias("hedged"),
        F.when(F.col("target").isNotNull(), counted["count"]).alias("count"), F.coalesce(F.when(F.col("target").isNotNull(), counted["approximate"]), F.lit(False)).alias("approximate"), "places",
        current_of(F.col("places")).alias("current"), first_of(F.col("places"), "origin").alias("origin"), first_of(F.col("places"), "destination").alias("destination"), "direction_deg", "inherited", "in_section",
    )


def spark_none(rows: DataFrame, column: str) -> Column:
    """An empty array of the type that ``column`` declares."""
    kind = column.split(" ", 1)[1]
    return F.array().cast(kind)


def _inherited(lines: Column) -> Column:
    """Array of struct(segment, given, inherited, dropped) of a message's lines in order.

    State: the heading target, the bare target that the next line takes over, and the line it stands in.
    """
    target = lines[0]["own"]
    nothing = F.when(F.lit(False), target)
    start = F.struct(nothing.alias("heading"), nothing.alias("carry"), F.lit(-1).alias("carried_from"), F.slice(F.transform(lines, lambda x: F.struct(x["segment"].alias("segment"), x["own"].alias("given"), F.lit("").alias("inherited"), F.lit(False).alias("dropped"))), 1, 0).alias("out"))

    def walk(s: Column, x: Column) -> Column:
        own = x["own"].isNotNull()
        heads = own & x["colon"] & ~x["placed"]
        silent = heads & x["plain"]
        takes = ~own & (x["placed"] | x["directed"]) & x["plain"]
        how = F.when(takes & s["carry"].isNotNull(), "carry").when(takes & s["heading"].isNotNull(), "header")
        given = F.when(how == "carry", s["carry"]).when(how == "header", s["heading"])
        mine = F.when(own, x["own"]).otherwise(given)
        carries = mine.isNotNull() & ~x["placed"] & ~(F.coalesce(how, F.lit("")) == "carry")
        before = F.when(how == "carry", F.transform(s["out"], lambda o: F.struct(o["segment"].alias("segment"), o["given"].alias("given"), o["inherited"].alias("inherited"), (o["dropped"] | (o["segment"] == s["carried_from"])).alias("dropped")))).otherwise(s["out"])
        row = F.struct(x["segment"].alias("segment"), given.alias("given"), F.coalesce(how, F.lit("")).alias("inherited"), silent.alias("dropped"))
        return F.struct(
            F.when(heads, x["own"]).otherwise(s["heading"]).alias("heading"), F.when(silent, s["carry"]).when(carries, mine).alias("carry"),
            F.when(silent, s["carried_from"]).when(carries, x["segment"]).otherwise(-1).alias("carried_from"), F.concat(before, F.array(row)).alias("out"),
        )

    return F.transform(F.aggregate(lines, start, walk, lambda s: s["out"]), lambda o: F.struct(o["segment"].alias("segment"), o["given"].alias("given"), F.nullif(o["inherited"], F.lit("")).alias("inherited"), o["dropped"].alias("dropped")))
