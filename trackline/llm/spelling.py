"""Spelling variants by asymmetric q-chunks.

Two words are near if one edit of a code point (insertion, deletion, replacement) leads from one to the other. The shorter
word of a pair (of equal ones either) contributes two disjoint chunks, its halves; the other contributes its positional grams
of the halves' lengths. One edit touches one half and leaves the other whole, where it was or, if the edit stands before it,
moved by one. So near words meet in the bucket of a chunk: the front half at the gram's own place, the back half at a place
within one, which the words' lengths give. Grams at other places meet no chunk within that shift and are not sent. What
meets is verified by the edit distance.

Buckets of more than ``most`` chunks are refined: where the front halves agree, what is left must itself be one edit apart,
so one of its halves stays whole, and words only meet where that agrees as well (likewise behind a shared back half). So in
a large bucket three quarters of both words agree, and a word meets few others; nothing is left out.

A word's form is the near word found most often, if that is at least ``factor`` times as often as the word; forms lead to
forms until a word has none. As counts grow by that factor, a way is no longer than the logarithm of the largest count, and
doubling it finds its end in a few rounds.

Words are counted in the tasks before they are shuffled, so that frequent words are one row per task and flush. Null texts
have no words, a null id is written as nothing, rows count as often as they stand there, ties of forms go to the first word
in code-point order; texts of any length are walked match by match. An empty table gives an empty table. Only doc_id and
text are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackline.llm.common import stored, text_slices

SHORTEST = 7  # code points of a word
COUNTED = 100_000  # distinct words that a task counts before it hands them on
RUN = re.compile(f"[a-zÀ-ÿ]{{{SHORTEST},}}")  # of lower-cased text; shorter runs give no word
ROUNDS = 8


def variant(run: str, key: str) -> str:
    """The word that a lower-cased run of document ``key`` stands for: one in 31 loses a code point, by hash."""
    h = zlib.crc32(f"{key}:{run}".encode())
    return run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs: DataFrame, least: int = 2) -> DataFrame:
    """``word, n`` of all words of at least seven code points that occur ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in text_slices(batches):
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
            for doc_id, text in zip(batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), texts, strict=True):
                runs = Counter(m.group() for m in RUN.finditer((text.as_py() or b"").lower().decode()))  # bytes: A-Z only
                key = "" if doc_id is None else str(doc_id)
                for found, n in runs.items():
                    word = variant(found, key)
                    if len(word) >= SHORTEST:
                        counts[word] += n
                if len(counts) > COUNTED:
                    yield handed()
        yield handed()

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _meet(longer: int, length: Column, side: int, part: Column, rest: Column) -> Column:
    """A bucket, named by the shorter word's length, the half and its text; and what is left of the word."""
    return F.struct(F.lit(longer).alias("longer"), F.concat_ws(" ", length, F.lit(side), part).alias("bucket"), rest.alias("rest"))


def _halves(text: Column, half: Column, shift) -> list[tuple[Column, Column]]:
    """(part, rest) for the front ``half`` and for what stands behind it, moved by ``shift``."""
    at = (half + shift).cast("int")
    front, back = text.substr(F.lit(1), half), text.substr(at + 1, F.length(text))
    return [(front, text.substr(half + 1, F.length(text))), (back, text.substr(F.lit(1), at))]


def _half(length: Column) -> Column:
    return F.floor(length / 2).cast("int")


def near_pairs(words: DataFrame, most: int = 64) -> DataFrame:
    """``a, a_n, b, b_n``: each pair of near words once."""
    length = F.length("word")

    def parts(longer: int) -> list[Column]:
        """The buckets in which a word meets shorter ones (``longer`` by 0 or 1)."""
        return [_meet(longer, length - longer, side, part, rest) for side, (part, rest) in enumerate(_halves(F.col("word"), _half(length - longer), longer))]

    short = words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.inline(F.array(*parts(0)))).drop("longer")
    other = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.inline(F.array(*parts(0), *parts(1)))).filter(F.length("b") - F.col("longer") >= SHORTEST)
    large = stored(short.groupBy("bucket").count().filter(F.col("count") > most).select("bucket", F.lit(True).alias("large")), "large-buckets")

    def refined(rows: DataFrame, half: Column, shift) -> DataFrame:
        finer = [F.concat_ws(" ", F.lit(side), part) for side, (part, _) in enumerate(_halves(F.col("rest"), half, shift))]
        return rows.join(large, "bucket", "left").withColumn("finer", F.explode(F.when(F.col("large"), F.array(*finer)).otherwise(F.array(F.lit(""))))).drop("large", "rest")

    short = refined(short, _half(F.length("rest")), 0)
    other = refined(other, _half(F.length("rest") - F.col("longer")), F.col("longer"))
    met = short.join(other, ["bucket", "finer"]).filter((F.col("longer") == 1) | (F.col("a") < F.col("b")))
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()


def _ends(forms: DataFrame) -> DataFrame:
    """``word, root``: where the ways of ``word, form`` end."""
    ways = stored(forms.select("word", F.col("form").alias("root")), "ways")
    for _ in range(ROUNDS):
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if ways.join(ahead, "root", "left_semi").isEmpty():
            return ways
        ways = stored(ways.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "ways")
    raise RuntimeError("forms do not end")  # ways of more than 2 ** ROUNDS steps: not with counts that grow by a factor of two


def group(words: DataFrame, factor: int = 10, most: int = 64) -> DataFrame:
    """Each word with its form, the end of its way, and the number of near words."""
    pairs = near_pairs(words, most)
    near = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    fit = -F.col("best.less") >= factor * F.col("n")
    rows = words.join(best, "word", "left").select("word", F.when(fit, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fit, -F.col("best.less")).alias("form_n"))
    rows = stored(rows, "spelling")
    ends = _ends(rows.filter("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame) -> DataFrame:
    return group(stored(word_counts(docs), "words"))


#: crc32 is folded over the bytes with its table, which a rule builds; near words meet by deleting one code point of each.
ORACLE = r"""
WITH crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents
), each AS (
  SELECT id, run, count(*) AS n, encode(id || ':' || run) AS b FROM runs WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, octet_length(b) + 1), lambda k: CAST('0x' || substr(hex(b), 2 * k - 1, 2) AS BIGINT))),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS h
  FROM each, crc
), w AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, sum(n) AS n
  FROM hashed GROUP BY 1 HAVING sum(n) >= 2 AND length(word) >= 7
), del AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS BIGINT) AS i FROM w)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM del a JOIN del b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT w.word, del.word, del.n FROM w JOIN del ON w.word = del.rest
  UNION SELECT del.word, w.word, w.n FROM w JOIN del ON w.word = del.rest
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS other, max(m) AS m FROM near GROUP BY word
), f AS (
  SELECT w.word, CASE WHEN m >= 10 * n THEN other END AS form, CAST(n AS BIGINT) AS n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN CAST(m AS BIGINT) END AS form_n
  FROM w LEFT JOIN best ON w.word = best.word
), way AS (
  WITH RECURSIVE r AS (
    SELECT word, word AS here, form AS next FROM f UNION ALL SELECT r.word, r.next, f.form FROM r JOIN f ON r.next = f.word
  ) SELECT word, here FROM r WHERE next IS NULL
)
SELECT f.word, form, way.here AS root, n, n_near, form_n FROM f JOIN way ON f.word = way.word
"""
