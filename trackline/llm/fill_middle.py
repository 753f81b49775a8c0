"""Fill-in-middle by piece tables.

A document is an immutable buffer of UTF-8 bytes, and the three sentinels are another one. What is done to a document is
done to descriptors (buffer, start, length) over the two: a cut splits a descriptor, an arrangement permutes descriptors,
the inverse permutation puts them back, and a hash runs over the bytes that the descriptors name, one after another. Text
is copied once, where an output is wanted as a column.

Units of a document are its words with the white space before them, and white space at its end. All draws come from the
sha256 of seed and id, so the outcome depends on nothing else: not on partitions, order or retries.

A null text counts as empty; an empty text, or one that writes a sentinel out, stays plain. A null id is drawn as an empty
one. Repeated rows are treated alike, very long texts whole (a slice of rows holds about 2 MB, or one text), an empty table
gives an empty table. Columns of other names stay; where one has the name of a column added here, the added name gets an
underscore.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trackline.llm.common import free_name, text_slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = PREFIX + SUFFIX + MIDDLE
TEXT, MARK = 0, 1  # the two buffers
#: Places of the descriptors of a cut document: each part behind its sentinel.
ORDER = {"psm": (0, 1, 2, 3, 4, 5), "spm": (2, 3, 0, 1, 4, 5)}
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Rule:
    seed: int = 42
    arranged: int = 50  # of 100 documents
    suffix_first: int = 80  # of 100 arranged ones


class PieceTable:
    """Descriptors over immutable buffers; no operation touches the bytes."""

    def __init__(self, buffers: tuple[memoryview, ...], pieces: list[tuple[int, int, int]]):
        self.buffers, self.pieces = buffers, pieces

    @classmethod
    def of(cls, text: bytes) -> PieceTable:
        return cls((memoryview(text), memoryview(MARKS)), [(TEXT, 0, len(text))])

    def cut(self, *places: int) -> PieceTable:
        """Split at byte offsets of the content, in ascending order; an empty part keeps a descriptor of its own."""
        out, at, rest = [], 0, list(places)
        for buffer, start, length in self.pieces:
            while rest and rest[0] <= at + length:
                head = rest.pop(0) - at
                out.append((buffer, start, head))
                start, length, at = start + head, length - head, at + head
            out.append((buffer, start, length))
            at += length
        return PieceTable(self.buffers, out)

    def permuted(self, order: tuple[int, ...]) -> PieceTable:
        return PieceTable(self.buffers, [self.pieces[i] for i in order])

    def views(self) -> Iterator[memoryview]:
        return (self.buffers[b][s : s + n] for b, s, n in self.pieces if n)

    def sha256(self) -> str:
        """Of the content, fed descriptor by descriptor."""
        h = hashlib.sha256()
        for view in self.views():
            h.update(view)
        return h.hexdigest()

    def content(self) -> bytes:
        return b"".join(self.views())


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    out = [0] * len(order)
    for place, i in enumerate(order):
        out[i] = place
    return tuple(out)


def arrange(table: PieceTable, form: str) -> PieceTable:
    """A table cut into prefix, middle and suffix, with its sentinels, in the order of ``form``."""
    prefix, middle, suffix = table.pieces
    marks = [(MARK, MARKS.index(m), len(m)) for m in (PREFIX, SUFFIX, MIDDLE)]
    return PieceTable(table.buffers, [marks[0], prefix, marks[1], suffix, marks[2], middle]).permuted(ORDER[form])


def restore(output: bytes, form: str) -> PieceTable:
    """The document that ``output`` was made of, as descriptors over ``output``: it is cut before and behind each sentinel,
    the inverse permutation puts the parts in their places, and the sentinels are left out."""
    table = PieceTable.of(output)
    if form == "plain":
        return table
    places = sorted(output.index(m) for m in (PREFIX, SUFFIX, MIDDLE))
    cut = table.cut(*(p for at in places for p in (at, at + 3)))
    parts = PieceTable(cut.buffers, cut.pieces[1:]).permuted(inverse(ORDER[form]))  # the first is the nothing before the first sentinel
    return parts.permuted((1, 5, 3))


def unit_ends(text: bytes) -> np.ndarray:
    """Byte offsets at which the units of a text end."""
    if not text:
        return np.zeros(0, np.int64)
    space = SPACE[np.frombuffer(text, np.uint8)]
    ends = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
    return np.r_[ends, len(text)] if space[-1] else ends


def chars(text: bytes, start: int, end: int) -> int:
    """Code points between two byte offsets: the bytes that begin one."""
    return int(np.count_nonzero(np.frombuffer(text, np.uint8)[start:end] & 0xC0 != 0x80))


@dataclass(frozen=True)
class Made:
    table: PieceTable
    form: str
    units: int
    prefix_chars: int | None
    middle_chars: int | None


def make(text: bytes, key: str, rule: Rule = Rule()) -> Made:
    """The piece table of a document's output, and what was drawn."""
    ends, table = unit_ends(text), PieceTable.of(text)
    digest = hashlib.sha256(f"{rule.seed}:{key}".encode()).hexdigest()
    first, second, third, fourth = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or third % 100 >= rule.arranged:
        return Made(table, "plain", len(ends), None, None)
    offsets = np.r_[0, ends]
    low, high = sorted(int(offsets[h % (len(ends) + 1)]) for h in (first, second))
    form = "spm" if fourth % 100 < rule.suffix_first else "psm"
    return Made(arrange(table.cut(low, high), form), form, len(ends), chars(text, 0, low), chars(text, low, high))


def _rows(batch: pa.RecordBatch, text: str, key: str) -> Iterator[tuple[bytes, str]]:
    texts = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
    keys = batch.column(batch.schema.get_field_index(key))
    for t, k in zip(texts, keys, strict=True):
        yield t.as_py() or b"", "" if k.as_py() is None else str(k.as_py())


def arranged(docs: DataFrame, rule: Rule = Rule(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with the output in place of the text, and columns form, pieces (the output's descriptors: buffer 0 is the
    document, 1 the sentinels ``MARKS``; bytes), prefix_chars and middle_chars."""
    names = {n: free_name(docs, n) for n in ("form", "pieces", "prefix_chars", "middle_chars")}
    added = StructType.fromDDL("{form} string, {pieces} array<struct<buffer: int, start: long, length: long>>, {prefix_chars} long, {middle_chars} long".format(**names))
    schema = StructType([*docs.schema.fields, *added.fields])
    piece = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text):
            made = [make(t, k, rule) for t, k in _rows(batch, text, key)]
            at = batch.schema.get_field_index(text)
            columns = batch.columns[:at] + [pa.array([m.table.content().decode() for m in made], batch.schema.field(at).type)] + batch.columns[at + 1 :]
            pieces = pa.array([[{"buffer": b, "start": s, "length": n} for b, s, n in m.table.pieces] for m in made], piece)
            columns += [pa.array([m.form for m in made], pa.string()), pieces, pa.array([m.prefix_chars for m in made], pa.int64()), pa.array([m.middle_chars for m in made], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names.values()])

    return docs.mapInArrow(run, schema)


def restored(outputs: DataFrame, text: str = "text", form: str = "form") -> DataFrame:
    """The same rows with the documents back in the text column, rebuilt from the output and its form alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text):
            at = batch.schema.get_field_index(text)
            forms = batch.column(batch.schema.get_field_index(form)).to_pylist()
            texts = batch.column(at).cast(pa.large_binary()).to_pylist()
            back = [restore(t, f).content().decode() for t, f in zip(texts, forms, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(back, batch.schema.field(at).type), *batch.columns[at + 1 :]], names=batch.schema.names)

    return outputs.mapInArrow(run, outputs.schema)


def report(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row per input row: units, form, lengths, and the hashes of the output and of the text rebuilt from it."""
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            made = [make(t, k, rule) for t, k in _rows(batch, "text", "doc_id")]
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("doc_id")),
                pa.array([m.units for m in made], pa.int64()), pa.array([m.form for m in made], pa.string()),
                pa.array([m.prefix_chars for m in made], pa.int64()), pa.array([m.middle_chars for m in made], pa.int64()),
                pa.array([m.table.sha256() for m in made], pa.string()), pa.array([restore(m.table.content(), m.form).sha256() for m in made], pa.string()),
            ], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS UBIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS UBIGINT) AS h4
  FROM d
), c AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n,
    CAST(least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS BIGINT) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
    coalesce(array_to_string(units[b + 1:], ''), '') AS suffix
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
