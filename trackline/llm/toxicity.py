"""Toxicity scores from a learned lexicon, matched through Levenshtein automata, and the context of each match.

Spark counts, over labelled training texts, in how many toxic and clean texts each word stands. Words that lean to
toxic texts strongly enough, in enough different surroundings, make the lexicon. The lexicon's trie is intersected with
the Levenshtein automata of its terms; the product is made deterministic as words are read, so a word costs one table
step per character and most words die after two or three. Misspelled forms seen in training keep their own evidence.

A match counts less inside quotation marks or after a reporting word, so one quoted term does not condemn a text. The
score is one minus the chance that neither the text's base rate nor any match makes it toxic. Null and empty texts have
no match and get the base rate; an empty table gives an empty one. Texts are scored whole, however long. Repeated rows get
equal scores; of several labels of a document the highest counts. Only ``doc_id``, ``text`` and ``toxic`` are read, and
:func:`remove` returns all columns as they are, so other columns' names cannot clash.

The lexicon and its forms are all the words of the labelled rows that meet the thresholds; their number is bounded by the
bounded number of those rows alone. What a worker remembers of words and automaton states is forgotten beyond a limit and
made anew.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackline.llm.common import fold, text_slices

WORD = re.compile(r"\w+")
QUOTES = "\"'“”„«»‘’`"
# Words that announce somebody else's words.
REPORTING = frozenset("said says called calls wrote writes quote quotes quoted quoting word term insult dit appelle mot terme sagte nannte wort zitat dijo llama palabra".split())
MAX_CACHED = 400_000  # words that a worker remembers
MAX_STATES = 100_000  # automaton states that it remembers


@dataclass(frozen=True)
class Rule:
    max_labelled: int = 20_000  # bound of the labelled rows that the lexicon is learned from, by id hash
    min_texts: int = 6  # toxic texts that a term stands in
    min_share: float = 0.9  # of the texts with the term that are toxic
    min_chance: float = 0.6  # below it, a form is no match
    min_surroundings: int = 6
    quoted: float = 0.4  # what a quoted match counts
    misspelled: float = 0.9  # how sure a rare misspelling is before any is seen in training
    frequent: int = 4  # texts from which on a form has evidence of its own
    reject: float = 0.7

    def edits(self, term: str) -> int:
        return 0 if len(term) < 5 else 1


class Automaton:
    """The lexicon trie intersected with its terms' Levenshtein automata, made deterministic on demand."""

    def __init__(self, terms, edits):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.allowed = [0]  # by node: the most edits that any term below it allows
        self.edits = edits
        for term in sorted(terms):
            node, n = 0, edits(term)
            self.allowed[0] = max(self.allowed[0], n)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.allowed.append(0)
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], n)
            self.term[node] = term
        self.alphabet = {c for kids in self.children for c in kids}
        self._forget()

    def _forget(self) -> None:
        self.sets: list[frozenset] = []
        self.numbers: dict[frozenset, int] = {}
        self.accepts: list[str | None] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._number(self._closed({(0, 0)}))

    def _closed(self, states: set[tuple[int, int]]) -> frozenset:
        """With the states that skip letters of a term, and without those that another one covers."""
        todo, seen = list(states), dict[int, int]()
        while todo:
            node, e = todo.pop()
            if e > self.allowed[node] or seen.get(node, 99) <= e:
                continue
            seen[node] = e
            todo += [(kid, e + 1) for kid in self.children[node].values()]
        return frozenset(seen.items())

    def _number(self, states: frozenset) -> int:
        if states not in self.numbers:
            self.numbers[states] = len(self.sets)
            self.sets.append(states)
            self.moves.append({})
            ends = [(e, self.term[n]) for n, e in states if self.term[n] is not None and e <= self.edits(self.term[n])]
            self.accepts.append(min(ends)[1] if ends else None)
        return self.numbers[states]

    def _move(self, number: int, c: str) -> int:
        after: set[tuple[int, int]] = set()
        for node, e in self.sets[number]:
            after.add((node, e + 1))
            after |= {(kid, e + (letter != c)) for letter, kid in self.children[node].items()}
        return self._number(self._closed(after))

    def match(self, word: str) -> str | None:
        """The nearest term within its edits, first by name among equals; None if there is none."""
        if len(self.sets) > MAX_STATES:
            self._forget()
        at, dead = self.start, None
        for c in word:
            c = c if c in self.alphabet else "\0"
            moves = self.moves[at]
            if c not in moves:
                moves[c] = self._move(at, c)
            at = moves[c]
            if not self.sets[at]:
                return dead
        return self.accepts[at]


class Model:
    """Base rate; terms and forms with their chance of marking a toxic text; by term, how sure its rare forms are."""

    def __init__(self, base: float, terms: dict[str, float], forms: dict[str, float], sure: dict[str, float], rule: Rule):
        self.base, self.terms, self.forms, self.sure, self.rule = base, terms, forms, sure, rule
        self._made()

    def _made(self) -> None:
        self.automaton = Automaton(self.terms, self.rule.edits)
        self.clean: set[str] = set()
        self.hits: dict[str, float] = {}

    def __getstate__(self):
        return self.base, self.terms, self.forms, self.sure, self.rule

    def __setstate__(self, state):
        self.base, self.terms, self.forms, self.sure, self.rule = state
        self._made()

    def chance(self, word: str) -> float:
        """Of a text with the word being toxic; what is not likelier than not is no match."""
        p = self.terms.get(word) or self.forms.get(word)
        if p is None:
            term = self.automaton.match(word)
            p = 0.0 if term is None else self.terms[term] * self.sure.get(term, self.rule.misspelled)
        return p if p >= self.rule.min_chance else 0.0

    def matched(self, words: set[str]) -> set[str]:
        if len(self.clean) + len(self.hits) > MAX_CACHED:
            self.clean.clear()
            self.hits.clear()
        for w in words - self.clean - self.hits.keys():
            p = self.chance(w)
            if p > 0:
                self.hits[w] = p
            else:
                self.clean.add(w)
        return words & self.hits.keys()

    def quotes(self, text: str, start: int, end: int, before: list[str]) -> bool:
        """Whether the match stands between an opening and a closing mark of its line, or follows a reporting word."""
        if any(w in REPORTING for w in before):
            return True
        left = text[max(text.rfind("\n", 0, start), start - 200, 0) : start]
        right = text[end : end + 200].split("\n", 1)[0]
        a = max((left.rfind(q) for q in QUOTES), default=-1)
        b = min((k for k in map(right.find, QUOTES) if k >= 0), default=-1)
        if a < 0 or b < 0:
            return False
        opening = (a == 0 or not left[a - 1].isalnum()) and (a + 1 == len(left) or not left[a + 1].isspace())
        closing = (b == 0 or not right[b - 1].isspace()) and (b + 1 == len(right) or not right[b + 1].isalnum())
        return opening and closing

    def score(self, text: str | None) -> tuple[float, list[str]]:
        text = (text or "").lower()
        found = self.matched(set(WORD.findall(text))) if self.terms else set()
        clean = 1 - self.base
        if found:
            best: dict[str, float] = {}
            before: list[str] = []
            for m in WORD.finditer(text):
                word = m[0]
                if word in found and best.get(word, 0) < self.hits[word]:
                    p = self.hits[word] * (self.rule.quoted if self.quotes(text, m.start(), m.end(), before) else 1)
                    best[word] = max(best.get(word, 0), p)
                before = [*before[-3:], word]
            for p in best.values():
                clean *= 1 - p
        return 1 - clean, sorted(found)


def _labelled(docs: DataFrame, labels: DataFrame, parts: int, held: int, rule: Rule) -> DataFrame:
    """A bounded set of labelled training texts; its ids are few enough to go to every task."""
    known = labels.filter(F.col("toxic").isNotNull() & (fold(F.col("doc_id"), parts) != held)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rule.max_labelled)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))


def _word_counts(labelled: DataFrame) -> DataFrame:
    """``word, toxic, clean, around``: texts of either label with the word, and a 64-bit sketch of its neighbours."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[int]] = {}

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *(pa.array([v[k] - (1 << 64) * (v[k] >> 63) for v in total.values()], pa.int64()) for k in range(3))], names=["word", "toxic", "clean", "around"])

        for batch in text_slices(batches, max_bytes=1_000_000):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = WORD.findall(text.lower())
                seen = set()
                for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                    entry = total.setdefault(word, [0, 0, 0])
                    if word not in seen:
                        seen.add(word)
                        entry[0 if toxic > 0 else 1] += 1
                    entry[2] |= 1 << ((len(before) * 31 + len(after) * 7 + sum(map(ord, before[:3] + after[:3]))) & 63)
            if len(total) > 300_000:
                yield rows()
                total.clear()
        yield rows()

    counts = labelled.mapInArrow(local, "word string, toxic long, clean long, around long")
    return counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.expr("bit_or(around)").alias("around"))


def _forms(counts: DataFrame, terms: dict[str, float], rule: Rule) -> tuple[dict[str, float], dict[str, float]]:
    """Evidence of words near a term: of each frequent one, and of each term's rare ones together."""
    shared = counts.sparkSession.sparkContext.broadcast(Model(0.0, terms, {}, {}, rule))

    @F.arrow_udf("string")
    def nearest(words: pa.Array) -> pa.Array:
        return pa.array([shared.value.automaton.match(w) for w in words.to_pylist()], pa.string())

    near = counts.withColumn("term", nearest("word")).filter(F.col("term").isNotNull() & (F.col("term") != F.col("word"))).persist()
    texts = F.col("toxic") + F.col("clean")
    forms = {r.word: r.toxic / (r.toxic + r.clean + 0.5) for r in near.filter(texts >= rule.frequent).collect()}
    rare = near.filter(texts < rule.frequent).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sure = {r.term: (r.toxic + rule.misspelled) / (r.toxic + r.clean + 1) for r in rare.collect()}
    near.unpersist()
    return forms, sure


def train(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, rule: Rule = Rule()) -> Model:
    """Lexicon, forms and base rate from labelled rows whose fold is not ``held``."""
    spark = docs.sparkSession
    labelled = _labelled(docs, labels, parts, held, rule)
    counts = _word_counts(labelled).persist()
    chance = F.col("toxic") / (F.col("toxic") + F.col("clean") + 0.5)
    chosen = counts.filter((F.col("toxic") >= rule.min_texts) & (chance >= rule.min_share) & (F.bit_count("around") >= rule.min_surroundings) & (F.length("word") >= 3))
    terms = {r.word: r.p for r in chosen.select("word", chance.alias("p")).collect()}
    forms, sure = _forms(counts, terms, rule) if terms else ({}, {})
    counts.unpersist()
    shared = spark.sparkContext.broadcast(Model(0.0, terms, forms, sure, rule))

    @F.arrow_udf("boolean")
    def unmatched(texts: pa.Array) -> pa.Array:
        return pa.array([not shared.value.score(t)[1] for t in texts.to_pylist()])

    rest = labelled.filter(unmatched("text")).agg(F.count("*").alias("n"), F.sum((F.col("toxic") > 0).cast("int")).alias("t")).first()
    return Model(min(0.5, ((rest.t or 0) + 0.5) / (rest.n + 1)) if rest.n else 0.0, terms, forms, sure, rule)


def scorer(spark: SparkSession, model: Model):
    """A function from a text column to struct(score, matched)."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score:double,matched:array<string>>")
    def scored(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts:
            rows.append(shared.value.score(text.as_py()))
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], names=["score", "matched"])

    return lambda text: scored(text)


def report(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, rule: Rule = Rule()) -> DataFrame:
    """One row per input row: score, decision and the matched forms."""
    model = train(docs, labels, parts, held, rule)
    scored = docs.select("doc_id", (fold(F.col("doc_id"), parts) == held).alias("held_out"), scorer(docs.sparkSession, model)(F.col("text")).alias("r"))
    return scored.select("doc_id", "held_out", F.col("r.score").alias("score"), (F.col("r.score") >= rule.reject).cast("int").alias("predicted"), F.col("r.matched").alias("matched"))


def remove(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs``, all columns, that are not judged toxic by what ``train_docs`` teach."""
    model = train(train_docs, labels, parts, held, rule)
    return docs.filter(scorer(docs.sparkSession, model)(F.col("text"))["score"] < rule.reject)
