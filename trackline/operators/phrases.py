"""What a segment reports: event types by ordered phrases, alert levels, launches, and mentions that others cover.

The phrases become one trie. A segment's tokens are walked once, as a fold whose state holds, for each node of the trie, the
latest token at which a way to it began; a way is dead when it is longer than the window. So the work is tokens times nodes,
however phrases overlap, and nothing leaves Spark's own functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackline.functions import text as T

WINDOW = 5  # tokens from the first word of a phrase to its last

# Phrases of stems in order of precedence, and the event that each tells of.
PHRASES = (
    (("відбій", "тривог"), "alert_cancelled"),
    (("відбій", "повітрян"), "alert_cancelled"),
    (("отбой", "тревог"), "alert_cancelled"),
    (("відбій",), "alert_cancelled"),
    (("загроз", "минул"), "target_cancelled"),
    (("загрозу", "знято"), "target_cancelled"),
    (("відбій", "загроз"), "target_cancelled"),
    (("загроз", "відсутн"), "target_cancelled"),
    (("не", "фіксу"), "target_cancelled"),
    (("чисто",), "target_cancelled"),
    (("повітрян", "тривог"), "air_raid_alert"),
    (("оголошен", "тривог"), "air_raid_alert"),
    (("воздушн", "тревог"), "air_raid_alert"),
    (("тривога",), "air_raid_alert"),
    (("робот", "ппо"), "air_defence"),
    (("працю", "ппо"), "air_defence"),
    (("ппо", "працю"), "air_defence"),
    (("сил", "ппо"), "air_defence"),
    (("збит",), "air_defence"),
    (("вибух",), "explosion"),
    (("взрыв",), "explosion"),
    (("прильот",), "explosion"),
    (("приліт",), "explosion"),
    (("влучанн",), "explosion"),
)
LAUNCHES = ("пуск", "зліт", "злет", "запуск", "взлет")
LEVEL_WORDS = ("рівн", "рівен")
LEVELS = (("жовт", "yellow"), ("червон", "red"))

NONE = 1_000_000  # later than any phrase and any token


def _trie(phrases) -> list[tuple[int | None, str, int]]:
    """(parent, stem, rule) of each node, parents first; rule is the first phrase that ends there."""
    nodes, at = [], {}
    for rule, (stems, _) in enumerate(phrases):
        for k, stem in enumerate(stems):
            if stems[: k + 1] not in at:
                at[stems[: k + 1]] = len(nodes)
                nodes.append((at.get(stems[:k]), stem, NONE))
        i = at[stems]
        nodes[i] = (*nodes[i][:2], min(nodes[i][2], rule))
    return nodes


def _starts_with(token: Column, stems) -> Column:
    return reduce(lambda a, b: a | b, [token.startswith(s) for s in stems])


def alert_level(tokens: Column) -> Column:
    """yellow or red, the first named within two tokens of the first word for level that has one; else null."""
    colour = lambda t: F.coalesce(*[F.when(t.startswith(stem), level) for stem, level in LEVELS])
    near = lambda i: F.slice(tokens, F.greatest(i - 2, F.lit(0)) + 1, F.least(i, F.lit(2)) + 3)
    named = F.transform(tokens, lambda t, i: F.when(_starts_with(t, LEVEL_WORDS), F.get(F.filter(F.transform(near(i), colour), lambda c: c.isNotNull()), F.lit(0))))
    return F.get(F.filter(named, lambda c: c.isNotNull()), F.lit(0))


def first_phrases(tokens: Column, phrases=PHRASES, passed_over: str = "air_raid_alert", window: int = WINDOW) -> Column:
    """struct(any, other): the first phrase of the list that the tokens hold in order within the window, and the first one
    that does not tell of ``passed_over``; ``NONE`` without one. Null tokens hold nothing."""
    nodes = _trie(phrases)
    hits = F.transform(tokens, lambda t, i: F.struct(i.alias("i"), F.array(*[T.stem_match(F.lit(stem), t, F.lit(False)) for _, stem, _ in nodes]).alias("fits")))
    start = F.struct(F.array(*[F.lit(-NONE)] * len(nodes)).alias("began"), F.lit(NONE).alias("any"), F.lit(NONE).alias("other"))

    def walk(state: Column, token: Column) -> Column:
        began, ended = [], []
        for n, (parent, _, rule) in enumerate(nodes):
            way = token["i"] if parent is None else state["began"][parent]
            reached = token["fits"][n] & (way >= token["i"] - window)
            began.append(F.when(reached, way).otherwise(state["began"][n]))
            if rule < NONE:
                ended.append((phrases[rule][1] == passed_over, F.when(reached, rule).otherwise(NONE)))
        return F.struct(F.array(*began).alias("began"), F.least(state["any"], *[r for _, r in ended]).alias("any"), F.least(state["other"], *[r for over, r in ended if not over]).alias("other"))

    return F.aggregate(F.coalesce(hits, F.slice(hits, 1, 0)), start, walk, lambda s: F.struct(s["any"].alias("any"), s["other"].alias("other")))


def event(tokens: Column, has_target: Column, phrases=PHRASES) -> Column:
    """struct(event, rule, launch, level). An alert that also names a target is a header and no fact, unless it states a
    level. Without a phrase a target is observed, and nothing else is known."""
    level = alert_level(tokens)
    rules = F.array(*[F.lit("event:" + "_".join(stems)) for stems, _ in phrases])
    events = F.array(*[F.lit(e) for _, e in phrases])

    def told(bound: Column) -> Column:
        i = F.when(has_target & bound["level"].isNull(), bound["p"]["other"]).otherwise(bound["p"]["any"])
        name = F.when(i < NONE, F.get(events, i)).otherwise(F.when(has_target, "target_observed").otherwise("unknown"))
        return F.struct(name.alias("event"), F.when(i < NONE, F.get(rules, i)).alias("rule"), bound["launch"].alias("launch"), bound["level"].alias("level"))

    launch = F.coalesce(F.exists(tokens, lambda t: _starts_with(t, LAUNCHES)), F.lit(False))
    return F.element_at(F.transform(F.array(F.struct(first_phrases(tokens, phrases).alias("p"), launch.alias("launch"), level.alias("level"))), told), 1)


def collapsed(mentions: Column) -> Column:
    """Mentions of a segment without those that say less than others of it, by place.

    ``mentions``: array of struct(start, code, level, category_id, class_id, ...), deeper levels larger. Of a code only the first
    mention stays; one goes if another of its category is deeper and its class is the same or its own unknown.
    """
    earlier = lambda a, b: (a["code"] == b["code"]) & ((b["level"] > a["level"]) | ((b["level"] == a["level"]) & (b["start"] < a["start"])))
    deeper = lambda a, b: (a["category_id"] == b["category_id"]) & (a["level"] < b["level"]) & (a["class_id"].isNull() | (a["class_id"] == b["class_id"]))
    return F.array_sort(F.filter(mentions, lambda a: ~F.exists(mentions, lambda b: F.coalesce(earlier(a, b) | deeper(a, b), F.lit(False)))))
