"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Spark counts the character 4-grams of all training texts per language, and from them, by grouping, the lower orders (how
many distinct grams a gram continues), the contexts' totals and the discounts. No gram is dropped: every count of every
text is in these sums. The arrays name a gram by a hash of ``CELL_BITS`` bits, a cell; grams that share a cell share its
counts, which bounds the model (at most 2**CELL_BITS rows of one float a language for each order) for any corpus, and
changes nothing else. A cell's context and ending are those of its least gram.

All languages share the arrays: one sorted cell per gram, one row of log-probabilities beside it, one column per language.
A text goes to the language of lowest cross-entropy per letter or space; it is flagged as rejected where that entropy
exceeds what all training texts of the language that it tells right show, but for one in 200.

Letters are lower-cased, runs of anything else become one space. Null texts and texts without letters are ``und`` with
score 0, as is every text if there is nothing to learn from; an empty table gives an empty one. Texts are taken whole,
however long. Ties go to the first language name. Only doc_id, text and (to learn) lang are read, so other columns,
whatever their names, cannot clash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackline.llm.common import fold, stored

N = 4
CELL_BITS = 23  # bits of a gram's name in the model
CALIBRATION_QUANTILE = 0.995
CALIBRATION_STEP = 1 / 4096  # nats; the rejection limit is the upper end of the step that holds the quantile
EVIDENCE = 40  # characters of evidence that the score counts at most
SLICE_CHARS = 500_000


def letters(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\P{L}+", " ")))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts, each behind N-1 spaces and before one, as code points, and where each text's scored part starts."""
    pad = " " * (N - 1)
    joined = "".join(f"{pad}{t} " for t in texts)
    sizes = np.fromiter((len(t) + N for t in texts), np.int64, len(texts))
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64), np.r_[0, np.cumsum(sizes)]


def _hash(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n codes, by the position of its first."""
    out = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for k in range(n):
        out = (out + codes[k : k + len(out)] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _hash_grams(grams: list[str]) -> np.ndarray:
    n = len(grams[0])
    return _hash(np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).astype(np.uint64), n)[::n]


def _slices(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t) + N
        if size >= SLICE_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def count_grams(docs: DataFrame) -> DataFrame:
    """``lang, gram, n`` over all rows of ``docs`` (columns lang, text); the counts of a task meet before the shuffle."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], int] = defaultdict(int)

        def rows() -> pa.RecordBatch:
            keys = list(total)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64())], names=["lang", "gram", "n"])

        for batch in batches:
            langs = batch.column(0)
            for lang in pc.unique(langs).to_pylist():
                for part in _slices(batch.column(1).filter(pc.equal(langs, lang)).to_pylist()):
                    codes, starts = _codes(part)
                    grams = _hash(codes, N)
                    ends = np.zeros(len(codes), bool)
                    for k in range(1, N):  # a gram may not reach into the next text
                        ends[(starts[1:] - k).clip(0)] = True
                    _, first, n = np.unique(grams[~ends[: len(grams)]], return_index=True, return_counts=True)
                    place = np.flatnonzero(~ends[: len(grams)])[first]
                    text = codes.astype(np.uint32).tobytes().decode("utf-32-le")
                    for at, c in zip(place.tolist(), n.tolist(), strict=True):
                        total[lang, text[at : at + N]] += c
            if len(total) > 400_000:
                yield rows()
                total.clear()
        yield rows()

    return docs.select("lang", "text").mapInArrow(local, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _cells(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.uint32)


def cell(gram: Column, bits: int) -> Column:
    """The cell of each gram of a column of grams of one length; 0 for the empty context."""

    @F.arrow_udf("long")
    def of(grams: pa.Array) -> pa.Array:
        names = grams.to_pylist()
        return pa.array(_cells(_hash_grams(names), bits).astype(np.int64) if names and names[0] else np.zeros(len(names), np.int64))

    return of(gram)


def orders(counts: DataFrame) -> list[DataFrame]:
    """``lang, gram, n`` of the orders 1 to N: counts of the N-grams, and below them numbers of distinct continuations."""
    found = [stored(counts, "grams")]
    for size in range(N - 1, 0, -1):
        longer = found[0].select("lang", F.substring("gram", 2, size).alias("gram"))
        found.insert(0, stored(longer.groupBy("lang", "gram").agg(F.count("*").alias("n")), "grams"))
    return found


class Model:
    """Sorted cells and log-probabilities of each order; weights of the contexts for backing off."""

    def __init__(self, langs: list[str], letters_seen: int, bits: int):
        self.langs, self.bits = langs, bits
        self.limit = np.full(len(langs), np.inf)
        self.floor = 1.0 / (letters_seen + 1)
        self.orders: list[tuple[np.ndarray, np.ndarray]] = []  # by order n: cells, log P[cell, lang]
        self.backoff: list[tuple[np.ndarray, np.ndarray]] = []  # by context length n: cells, log weight[cell, lang]

    def add(self, entries: pa.Table, contexts: pa.Table, discount: np.ndarray) -> None:
        """The next order from its rows (lang, cell, n, context, ending), (lang, cell, total, kinds) and discounts by language."""
        heads, row = np.unique(contexts["cell"].to_numpy(), return_inverse=True)
        total, kinds = (np.zeros((len(heads), len(self.langs)), np.float32) for _ in range(2))
        lang = contexts["lang"].to_numpy()
        total[row, lang], kinds[row, lang] = contexts["total"].to_numpy(), contexts["kinds"].to_numpy()
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1)
        cells, first, row = np.unique(entries["cell"].to_numpy(), return_index=True, return_inverse=True)
        count = np.zeros((len(cells), len(self.langs)), np.float64)
        count[row, entries["lang"].to_numpy()] = entries["n"].to_numpy()
        head = np.searchsorted(heads, entries["context"].to_numpy()[first])
        if self.orders:
            below, logs = self.orders[-1]
            low = np.exp(logs[np.searchsorted(below, entries["ending"].to_numpy()[first].astype(np.uint32))].astype(np.float64))
        else:
            low = self.floor
        p = np.maximum(count - discount, 0) / np.maximum(total[head], 1) + weight[head] * low
        self.orders.append((cells.astype(np.uint32), np.log(p).astype(np.float32)))
        self.backoff.append((heads.astype(np.uint32), np.log(weight).astype(np.float32)))

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(table[0], keys).clip(max=len(table[0]) - 1)
        return at, table[0][at] == keys

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """log P of every code from the N-th on, given the N-1 before it, by language."""
        size = len(codes) - N + 1
        out = np.zeros((size, len(self.langs)))
        open_ = np.arange(size)
        for n in range(N, 0, -1):
            keys = _cells(_hash(codes, n)[open_ + N - n], self.bits)
            at, hit = self._find(self.orders[n - 1], keys)
            out[open_[hit]] += self.orders[n - 1][1][at[hit]]
            open_ = open_[~hit]
            if len(open_) == 0:
                return out
            if n > 1:
                heads = _cells(_hash(codes, n - 1)[open_ + N - n], self.bits)
                at, hit = self._find(self.backoff[n - 1], heads)
                out[open_[hit]] += self.backoff[n - 1][1][at[hit]]
            else:
                out[open_] += self.backoff[0][1][0] + np.log(self.floor)
        return out

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy in nats per character, by text and language."""
        codes, starts = _codes(texts)
        logs = self.log_probabilities(codes)
        sums = np.add.reduceat(logs, starts[:-1], axis=0)
        for k in range(1, N):  # grams that reach into the next text
            edge = starts[1:-1] - k
            sums[:-1] -= logs[edge]
        return -sums / (np.diff(starts) - N + 1)[:, None]

    def judge(self, texts: list[str]) -> list[tuple[str, float, float | None, bool]]:
        """Language, score, entropy and rejection of each text of letters and spaces."""
        out: list[tuple[str, float, float | None, bool]] = [("und", 0.0, None, True)] * len(texts)
        some = [i for i, t in enumerate(texts) if t]
        if not some or not self.langs:
            return out
        h = self.entropies([texts[i] for i in some])
        best = h.argmin(1)
        lowest = h[np.arange(len(some)), best]
        size = np.minimum([len(texts[i]) for i in some], EVIDENCE)
        share = 1 / np.exp(-(h - lowest[:, None]) * size[:, None]).sum(1)
        rejected = lowest > self.limit[best]
        score = np.where(rejected, share / 2, share)
        for i, b, s, e, r in zip(some, best.tolist(), score.tolist(), lowest.tolist(), rejected.tolist(), strict=True):
            out[i] = (self.langs[b], s, e, r)
        return out


JUDGED = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("rejected", pa.bool_())])


def predictor(spark, model: Model):
    """A function from a text column to struct(lang_pred, score, entropy, rejected)."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double,entropy:double,rejected:boolean>")
    def judged(values: pa.Array) -> pa.Array:
        rows = [r for part in _slices(values.to_pylist()) for r in shared.value.judge(part)]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], JUDGED.field(k).type) for k in range(4)], fields=list(JUDGED))

    return lambda text: judged(letters(text))


def model_of(counts: DataFrame, bits: int = CELL_BITS) -> Model:
    """The model of ``lang, gram, n``. What reaches the driver is bounded by the number of cells."""
    tables = orders(counts)
    langs = [r.lang for r in tables[0].select("lang").distinct().orderBy("lang").collect()]
    model = Model(langs, tables[0].select("gram").distinct().count(), bits)
    number = F.create_map(*[F.lit(x) for k, lang in enumerate(langs) for x in (lang, k)]) if langs else None
    for n, rows in enumerate(tables if langs else [], 1):
        few = {r.lang: (r.ones, r.twos) for r in rows.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect()}
        discount = np.array([ones / (ones + 2 * twos) if ones and twos else 0.5 for ones, twos in (few.get(lang, (0, 0)) for lang in langs)])
        named = rows.select(
            number[F.col("lang")].alias("lang"),
            "n",
            "gram",
            cell(F.col("gram"), bits).alias("cell"),
            cell(F.substring("gram", 1, n - 1), bits).alias("context"),
            cell(F.substring("gram", 2, n - 1), bits).alias("ending"),
        )
        entries = named.groupBy("lang", "cell").agg(F.sum("n").alias("n"), F.min_by(F.struct("context", "ending"), "gram").alias("x"))
        contexts = named.groupBy("lang", F.col("context").alias("cell")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        model.add(entries.select("lang", "cell", "n", "x.context", "x.ending").orderBy("cell", "lang").toArrow(), contexts.toArrow(), discount)
    return model


def limits(entropies: DataFrame, quantile: float = CALIBRATION_QUANTILE) -> DataFrame:
    """``lang, limit`` of all rows (lang, entropy), from their counts by step: the least step's end with that share of the rows."""
    steps = entropies.groupBy("lang", F.floor(F.col("entropy") / CALIBRATION_STEP).alias("step")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("lang")
    summed = steps.withColumns({"upto": F.sum("n").over(by.orderBy("step")), "all": F.sum("n").over(by)})
    return summed.filter(F.col("upto") >= quantile * F.col("all")).groupBy("lang").agg(((F.min("step") + 1) * CALIBRATION_STEP).alias("limit"))


def _calibrated(model: Model, judged: DataFrame) -> Model:
    """``model`` with its limits from ``judged`` (lang, lang_pred, entropy), its training rows."""
    if model.langs:
        for r in limits(judged.filter("lang = lang_pred").select("lang", "entropy")).collect():
            model.limit[model.langs.index(r.lang)] = r.limit
    return model


def _known() -> Column:
    return F.col("lang").isNotNull() & F.col("text").isNotNull()


def _counted(known: DataFrame) -> Model:
    return model_of(count_grams(known.select("lang", letters(F.col("text")).alias("text"))))


def train(docs: DataFrame) -> Model:
    """A model of all rows of ``docs`` (doc_id, lang, text) with a language and a text."""
    known = docs.filter(_known())
    model = _counted(known)
    # Written down, as a filter on the verdict would have every text judged for the filter and again for the entropy.
    return _calibrated(model, stored(known.select("lang", predictor(docs.sparkSession, model)(F.col("text")).alias("r")).select("lang", "r.*"), "judged"))


def report(docs: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """Predictions for every row, learned from rows whose fold is not ``held``.

    Each text is judged once: the verdicts are written down, the limits follow from those of the training rows, and then
    decide which verdicts are rejected. A row that lacks an id counts as held in or out by the empty id; repeated rows get
    equal results.
    """
    held_out = fold(F.col("doc_id"), parts) == held
    model = _counted(docs.filter(~held_out & _known()))
    verdict = predictor(docs.sparkSession, model)(F.col("text"))
    judged = stored(docs.select("doc_id", held_out.alias("held_out"), F.when(~held_out & _known(), F.col("lang")).alias("lang"), verdict.alias("r")).select("doc_id", "held_out", "lang", "r.*"), "judged")
    _calibrated(model, judged)
    limit = F.element_at(F.create_map(*[F.lit(x) for lang, most in zip(model.langs, model.limit.tolist(), strict=True) for x in (lang, most)]), F.col("lang_pred")) if model.langs else F.lit(None)
    rejected = F.col("rejected") | F.coalesce(F.col("entropy") > limit, F.lit(False))
    score = F.when(F.col("entropy") > limit, F.col("score") / 2).otherwise(F.col("score"))
    return judged.select("doc_id", "held_out", "lang_pred", score.alias("score"), "entropy", rejected.alias("rejected"))
