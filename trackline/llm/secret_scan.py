"""Secret scans: fixed patterns plus sliding-window entropy, in DataFrame functions only.

Every position counts code points from 0, ends are exclusive. A null text is scanned as an empty one, an empty table gives
an empty one, and texts are scanned whole, however long: running sums and maxima go over blocks of an array, so a text
with many matches costs little more than its matches. Columns of the input other than the text are passed through by
:func:`scan` and :func:`mask` untouched; the columns that are added take names the input does not have. Rows are judged
alone, so repeated rows and ties need no rule.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackline.llm.common import free_name

# The base patterns, by kind, in the order in which ties are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

BASE, FOUND = "base_spans", "found_spans"  # names of the columns that scan() adds, lengthened where the input has them
BLOCK = 64  # of running sums
SPANS = "array<struct<start:int,rank:int,end:int,match:string>>"

# A candidate for the entropy test: a run of key characters, long enough, with a digit and a letter in it.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"

# Runs of a narrower class inside a candidate, such as a key glued to a name: maximal, long enough, with a digit and a letter.
RUNS = {
    "alphanumeric_bits": r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{20,}",
    "hex_bits": r"(?<![A-Fa-f0-9])(?=[A-Fa-f]*[0-9])(?=[0-9]*[A-Fa-f])[A-Fa-f0-9]{20,}",
}


@dataclass(frozen=True)
class EntropyRule:
    """Window length and, by character class, the bits a window must reach."""

    window: int = 20
    hex_bits: float = 3.0
    alphanumeric_bits: float = 3.7
    base64_bits: float = 3.9
    # Words that mark placeholders, and shapes of public identifiers.
    allow: str = r"(?i)example|sample|placeholder|changeme|dummy|your[_-]|xxxx|^[0-9]+$|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^[a-z]+(?:[-_/][a-z]+)*[-_/]?[0-9]{1,8}$|^[0-9]{4}-[0-9]{2}-[0-9]{2}"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, start: Column, over) -> Column:
    """Running results of ``over(so far, value)`` along an array, for sums, maxima and the like.

    Blocks first: an array that grows by one element at a time is copied as often, so only short ones do.
    """

    def grown(xs: Column, first: Column) -> Column:
        return F.aggregate(
            xs,
            F.struct(first.alias("at"), F.array().cast("array<int>").alias("all")),
            lambda acc, x: _let(over(acc["at"], x), lambda at: F.struct(at.alias("at"), F.concat(acc["all"], F.array(at)).alias("all"))),
            lambda acc: acc["all"],
        )

    def in_blocks(blocks: Column) -> Column:
        ends = grown(F.transform(blocks, lambda xs: F.aggregate(xs, start, over)), start)
        return _let(F.concat(F.array(start), ends), lambda carried: F.flatten(F.transform(blocks, lambda xs, i: grown(xs, F.get(carried, i)))))

    def cut(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(BLOCK)), lambda i: F.slice(xs, i, BLOCK))

    return _let(values, lambda xs: _let(cut(xs), in_blocks))


def _spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """All matches of ``pattern`` as structs (start, kind rank, end, match).

    The text between the matches comes from ``split``; running lengths of both give the positions.
    """

    def placed(matches: Column) -> Column:
        lengths = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(matches)), matches, lambda gap, m: F.length(gap) + F.length(m))
        ends = _running(lengths, F.lit(0), lambda so_far, n: so_far + n)
        return F.zip_with(matches, ends, lambda m, end: F.struct((end - F.length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), m.alias("match")))

    found = F.when(F.regexp_like(text, F.lit(pattern)), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(F.array().cast(SPANS))
    return F.filter(found, keep) if keep is not None else found


def _reach(spans: Column, cover: Column) -> Column:
    """For each of ``spans``, in order of start: how far the spans of ``cover`` that start no later than it reach."""
    mark = lambda xs, own: F.transform(xs, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end")))

    def reached(merged: Column) -> Column:
        reach = _running(F.transform(merged, lambda s: F.when(s["own"] == 0, s["end"]).otherwise(0)), F.lit(0), lambda far, end: F.greatest(far, end))
        both = F.zip_with(merged, reach, lambda s, far: F.struct(s["own"].alias("own"), far.alias("far")))
        return F.transform(F.filter(both, lambda x: x["own"] == 1), lambda x: x["far"])

    return _let(F.array_sort(F.concat(mark(cover, 0), mark(spans, 1))), reached)


def _outside(spans: Column, cover: Column) -> Column:
    """Those of ``spans`` (in order of start) that no span of ``cover`` holds whole."""
    both = F.zip_with(spans, _reach(spans, cover), lambda s, far: F.struct(s.alias("s"), far.alias("far")))
    outside = F.transform(F.filter(both, lambda x: x["far"] < x["s"]["end"]), lambda x: x["s"])
    return F.when((F.size(spans) == 0) | (F.size(cover) == 0), spans).otherwise(outside)


def _alphabet_bits(value: Column, rule: EntropyRule) -> Column:
    """The limit of the narrowest character class that holds the whole candidate."""
    return (
        F.when(F.regexp_like(value, F.lit(r"^[0-9a-fA-F]+$")), F.lit(rule.hex_bits))
        .when(F.regexp_like(value, F.lit(r"^[0-9A-Za-z]+$")), F.lit(rule.alphanumeric_bits))
        .otherwise(F.lit(rule.base64_bits))
    )


def peak_entropy(value: Column, window: int) -> Column:
    """The highest Shannon entropy, in bits, of any ``window`` consecutive characters of ``value``.

    One pass: the state is the window and the sum of c*log2(c) over the counts c of its characters. A step counts the
    entering and the leaving character only and changes the sum by what they change, so no window is recounted.
    """
    bits = F.lit(math.log2(window))
    weights = F.array(*[F.lit(n * math.log2(n) if n > 1 else 0.0) for n in range(window + 2)])
    term = lambda n: F.get(weights, n)
    count = lambda text, char: F.length(text) - F.length(F.replace(text, char, F.lit("")))

    def step(acc: Column, entering: Column) -> Column:
        full = F.length(acc["window"]) >= window
        rest = F.when(full, F.substring(acc["window"], 2, window)).otherwise(acc["window"])
        out = count(acc["window"], F.substring(acc["window"], 1, 1))
        left = acc["total"] - F.when(full, _let(out, lambda n: term(n) - term(n - 1))).otherwise(0.0)

        def moved(kept: Column) -> Column:
            total = left + _let(count(kept, entering), lambda n: term(n + 1) - term(n))
            return _let(total, lambda t: F.struct(F.concat(kept, entering).alias("window"), t.alias("total"), F.when(F.length(kept) + 1 >= window, F.greatest(acc["best"], bits - t / window)).otherwise(acc["best"]).alias("best")))

        return _let(rest, moved)

    start = F.struct(F.lit("").alias("window"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
    return F.aggregate(F.split(value, ""), start, step, lambda acc: acc["best"])


def scan(docs: DataFrame, text_col: str = "text", rule: EntropyRule = EntropyRule()) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, and their names: arrays of (start, rank, end, match) in order of start, then kind.

    The first holds the fixed kinds: per kind leftmost matches that do not overlap, failing lengths dropped. The second
    adds high-entropy strings that lie outside every base span and are not on the allow-list: candidates that reach the
    limit of their own class, and in the others the runs of a narrower class that reach the limit of that class.
    Null and empty texts get two empty arrays. No shuffle: a row's spans are made where the row is.
    """
    names = [free_name(docs, name) for name in (BASE, FOUND, "open_spans", "hit_spans", "run_spans")]
    base, found, open_, hit, runs = (F.col(name) for name in names)
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign = _spans(text, ASSIGN, "assign", lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 6)
    access = _spans(text, ACCESS, "access", lambda s: F.length(s["match"]) >= 20)
    hexes = _spans(text, HEX, "hex")
    rows = docs.withColumn(names[0], F.array_sort(F.concat(assign, access, hexes)))

    unlisted = lambda s: ~F.regexp_like(s["match"], F.lit(rule.allow))
    rows = rows.withColumn(names[4], _spans(text, CANDIDATE, "entropy", unlisted))
    rows = rows.withColumn(names[2], _outside(runs, base))
    rows = rows.withColumn(names[3], F.filter(open_, lambda s: peak_entropy(s["match"], rule.window) >= _alphabet_bits(s["match"], rule)))
    rows = rows.withColumn(names[2], F.array_except(open_, hit))

    def inner(candidate: Column, pattern: str) -> Column:
        """The shorter runs inside a candidate, placed in the text."""
        shorter = F.filter(_spans(candidate["match"], pattern, "entropy"), lambda s: F.length(s["match"]) < F.length(candidate["match"]))
        return F.transform(shorter, lambda s: F.struct((s["start"] + candidate["start"]).alias("start"), s["rank"].alias("rank"), (s["end"] + candidate["start"]).alias("end"), s["match"].alias("match")))

    def reaches(bits: float):
        return lambda s: peak_entropy(s["match"], rule.window) >= bits

    def runs_of(pattern: str):
        return lambda candidate: inner(candidate, pattern)

    for name, pattern in RUNS.items():
        shorter = F.filter(F.flatten(F.transform(open_, runs_of(pattern))), unlisted)
        rows = rows.withColumn(names[4], F.when(F.size(open_) > 0, shorter).otherwise(F.array().cast(SPANS)))
        rows = rows.withColumn(names[3], F.concat(hit, F.filter(_outside(runs, F.concat(base, hit)), reaches(getattr(rule, name)))))
    return rows.withColumn(names[1], F.array_sort(F.concat(base, hit))).drop(*names[2:]), names[0], names[1]


def _listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")


def report(docs: DataFrame, rule: EntropyRule = EntropyRule()) -> DataFrame:
    """One row per input row: counts per kind, the digest of the base spans and all spans as text."""
    rows, base, found = scan(docs.select("doc_id", "text"), rule=rule)
    count = lambda kind: F.size(F.filter(F.col(base), lambda s: s["rank"] == KINDS.index(kind))).cast("long")
    return rows.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_listed(F.col(base)), 256).alias("base_sha256"),
        _listed(F.col(found)).alias("spans"),
    )


def mask(docs: DataFrame, mark: str = "[SECRET]", rule: EntropyRule = EntropyRule()) -> DataFrame:
    """The same rows and columns with every found span of the text replaced by ``mark``; spans that touch merge.

    Before each span stands the text since the farthest end of the spans before it; what overlaps them adds nothing.
    """
    rows, _, found = scan(docs, rule=rule)
    text, spans = F.col("text"), F.col(found)
    ends = _running(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b))

    def replaced(far: Column) -> Column:
        piece = lambda s, at: F.when(s["start"] >= at, F.concat(F.substring(text, at + 1, s["start"] - at), F.lit(mark))).otherwise(F.lit(""))
        return F.concat(F.array_join(F.transform(spans, lambda s, i: piece(s, F.get(far, i))), ""), F.substring(text, F.element_at(far, -1) + 1, F.length(text)))

    joined = _let(F.concat(F.array(F.lit(0)), ends), replaced)
    some = F.size(spans) > 0
    masked = rows.withColumn("text", F.when(some, joined).otherwise(text))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(some, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)
