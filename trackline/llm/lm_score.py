"""Language-model scores from the marginal likelihood of a subword lattice, with word counts of the corpus.

A word's lattice probability sums over all its segmentations into pieces of an existing vocabulary, by the forward
recursion in log space. The model adds what the corpus teaches as one more arc over each whole word: absolute
discounting takes ``discount`` from every word count and hands that mass to the lattice,

    P(w) = max(c - discount, 0) / N + discount * V / N * lattice(w),

so every word, seen or not, has a probability and a text's score is the log10 of its marginal probability.

Shape of the job: one pass cuts the rows into chunks of bounded text and writes, per chunk, its distinct words (with
training count and lattice probability) and its texts as numbers of those words. Counts are totalled over one shuffle
by word, of one row per word and chunk however often the word stands there, and come back to the chunks in one shuffle by
chunk. No word, text or chunk is ever a group of unbounded size, and no part of the vocabulary is broadcast.

Null texts count as empty: one end token. Repeated rows are counted and scored each. A very long text is a chunk of its own,
taken whole. An empty table gives no rows. Only doc_id and text are read, so columns of other names cannot clash.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackline.llm.common import fold, stored, text_slices
from trackline.llm.lattice import LITERAL_MARK, Lattice, Units, Vocabulary, vocabulary

CHUNK_BYTES = 12_000_000
LATTICE_WORDS = 16_000  # distinct words whose lattices are built at once
DISCOUNT = 0.75
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
CHUNK = "chunk long, doc_id long, held_out boolean, words binary, word string, number int, n long, lattice double"


class Numbers(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def lattice_logs(vocab: Vocabulary, words: list[str]) -> np.ndarray:
    """Natural log of each word's lattice probability, behind the word mark."""
    out = np.zeros(len(words))
    for at in range(0, len(words), LATTICE_WORDS):
        part = words[at : at + LATTICE_WORDS]
        flat, begins = vocab.codes(part)
        units = Units(vocab, flat, begins)
        logs = np.zeros(len(flat))
        if len(units.start):
            logs[units.start] = Lattice(vocab, units.codes, units.offset).log_total()[units.kind]
        for i in np.flatnonzero(~units.known).tolist():
            char = "▁" if flat[i] == LITERAL_MARK else chr(flat[i])
            logs[i] = vocab.log_p[vocab.byte_id[list(char.encode())]].sum()
        out[at : at + len(part)] = np.add.reduceat(logs, begins[:-1])
    return out


def _chunks(path: str):
    """Rows of both kinds for each chunk: its words, then its texts. The empty word is the end token, number 0."""

    def chunk(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        vocab, squeeze = vocabulary(path), zstandard.ZstdCompressor(level=1)
        key, numbers = uuid.uuid4().int >> 65, Numbers({b"": 0})
        texts = [np.fromiter(map(numbers.__getitem__, (t or "").encode().translate(LOWER).split()), np.int32) for _, t, _ in rows]
        train = [a for a, (_, _, held) in zip(texts, rows, strict=True) if not held]
        counts = np.bincount(np.concatenate(train), minlength=len(numbers)) if train else np.zeros(len(numbers), np.int64)
        counts[0] = len(train)
        words = [w.decode() for w in numbers]
        logs = np.r_[vocab.log_end, lattice_logs(vocab, words[1:])]
        n = len(words)
        none = lambda kind, m: pa.nulls(m, kind)
        names = ["chunk", "doc_id", "held_out", "words", "word", "number", "n", "lattice"]
        for a in range(0, n, 100_000):
            m = min(n, a + 100_000) - a
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, key)), none(pa.int64(), m), none(pa.bool_(), m), none(pa.binary(), m), pa.array(words[a : a + m]), pa.array(np.arange(a, a + m, dtype=np.int32)), pa.array(counts[a : a + m].astype(np.int64)), pa.array(logs[a : a + m])], names=names
            )
        m = len(rows)
        packed = [squeeze.compress(a.tobytes()) for a in texts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(m, key)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_()), pa.array(packed, pa.binary()), none(pa.string(), m), none(pa.int32(), m), none(pa.int64(), m), none(pa.float64(), m)], names=names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in text_slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                size += len(row[1] or "") + 8
                if size >= CHUNK_BYTES:
                    yield from chunk(rows)
                    rows, size = [], 0
        if rows:
            yield from chunk(rows)

    return run


def score(docs: DataFrame, path: str, parts: int = 5, held: int = 1, discount: float = DISCOUNT) -> DataFrame:
    """Scores of every row; counts come from the rows whose fold is not ``held``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold(F.col("doc_id"), parts) == held).alias("held_out"))
    chunks = stored(rows.mapInArrow(_chunks(path), CHUNK), "lm-chunks")
    by_word = Window.partitionBy("word")
    counted = stored(
        chunks.filter(F.col("word").isNotNull())
        .select("word", "chunk", "number", "n", "lattice")
        .withColumn("c", F.sum("n").over(by_word))
        .withColumn("first", F.row_number().over(by_word.orderBy("chunk")) == 1)
        .select("chunk", "number", "n", "lattice", "c", "first"),
        "lm-counts",
    )
    known = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("first") & (F.col("c") > 0)).alias("v")).first()
    total, kinds = known.n, known.v

    def scores(key, words: pa.Table, texts: pa.Table) -> pa.Table:
        number = words.column("number").to_numpy()
        c, lattice = np.zeros(len(number)), np.zeros(len(number))
        c[number] = words.column("c").to_numpy()
        lattice[number] = words.column("lattice").to_numpy()
        base = np.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
        if total:
            rest = math.log(discount * kinds / total) + lattice
            seen = np.log(np.maximum(c - discount, 1e-300) / total)
            model = np.where(c > discount, np.logaddexp(rest, seen), rest) / math.log(10)
        else:
            model = lattice / math.log(10)
        unpack, out = zstandard.ZstdDecompressor(), []
        for packed in texts.column("words").to_pylist():
            w = np.frombuffer(unpack.decompress(packed), np.int32) if packed else np.zeros(0, np.int32)
            out.append((len(w) + 1, int((c[w] > 0).sum() + (c[0] > 0)), float(base[w].sum() + base[0]), float(model[w].sum() + model[0])))
        n, k, b, m = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table(
            [texts.column("doc_id"), texts.column("held_out"), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array([total] * len(n), pa.int64()), pa.array(b, pa.float64()), pa.array(m, pa.float64())],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    texts = chunks.filter(F.col("words").isNotNull()).select("chunk", "doc_id", "held_out", "words")
    return (
        counted.select("chunk", "number", "c", "lattice")
        .groupBy("chunk")
        .cogroup(texts.groupBy("chunk"))
        .applyInArrow(scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )
