"""Reversible incremental line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without white space at its ends, A-Z in lower case; keys are named by 128-bit hashes, and only those
of at least ``least_chars`` code points count. The index keeps three tables in the shared folder, one generation of files for
each batch of documents that went in or out:

* ``holders``: signed reference counts by key and document; what is held is what sums to more than nothing;
* ``repeated``: for each key that a batch touched and that at least ``least_docs`` documents hold, or held before it, how many
  do now and the largest id among them; the latest generation of a key counts;
* ``filters``: a cuckoo filter for each shard with the repeated keys. Keys that come to be repeated are inserted, keys that no
  longer are get deleted; a shard that would become too full is built anew, from the exact table, and when shards would hold
  too many keys there are twice as many.

:func:`insert` and :func:`delete` take documents in and out, :func:`clean` drops a document's repeated lines. Cleaning asks
the filters first: lines that miss are kept at once, only lines that hit meet the exact table, so a false hit costs a look-up
and nothing else. The filters go to the tasks where they take at most ``FILTER_BYTES``; beyond that every line's key meets
the exact table in a join, with the same outcome.

Counts are partial before they are shuffled, so a line that a third of the documents hold is no large group; it is one row
per task. The look-up join on it can be split, as nothing above it needs its rows together.

Null and empty texts are one empty line. Documents without id hold nothing that counts and lose every repeated line. Two rows
with one id are one document. Deleting takes the same rows that were inserted; deleting others leaves negative counts, which
hold nothing until they are made up. An empty table changes nothing. Very long texts are taken whole, in slices of rows of
about 2 MB or one text. Columns of other names stay; added ones get an underscore where a column has their name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trackline.llm.common import free_name, mix64, shared_dir, text_slices

SPACE = b" \t\n\x0b\x0c\r"
KEY = ["hi", "lo"]
FILTER_BYTES = 64_000_000  # filters that go to the tasks
SHARD_KEYS = 200_000
SLOTS, LOAD, KICKS = 4, 0.85, 200
SPREAD = mix64(np.arange(1 << 16)) >> np.uint64(8)

HOLDERS = "hi long, lo long, doc_id long, refs int"
REPEATED = "hi long, lo long, docs long, last long"
FILTERS = "shard int, keys long, cells binary, stash array<long>"


@dataclass(frozen=True)
class Index:
    """Names a generation of the tables; older ones stay readable."""

    path: str
    generation: int = 0
    shards: int = 1
    least_docs: int = 3
    least_chars: int = 20


def empty(spark: SparkSession, least_docs: int = 3, least_chars: int = 20) -> Index:
    return Index(f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}", least_docs=least_docs, least_chars=least_chars)


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket. What finds no place after ``KICKS`` moves goes to a stash."""

    def __init__(self, cells: np.ndarray, stash: list[int] = (), keys: int = 0):
        self.cells, self.stash, self.keys, self.mask = cells.tolist(), list(stash), keys, len(cells) // SLOTS - 1

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        return cls(np.zeros(SLOTS << max(3, int(np.ceil(np.log2(max(1, keys) / (LOAD * SLOTS) + 1)))), np.uint16))

    def _free(self, bucket: int, fp: int) -> bool:
        for i in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
            if not self.cells[i]:
                self.cells[i] = fp
                return True
        return False

    def add(self, hi: np.ndarray, lo: np.ndarray) -> None:
        fps, buckets, _ = places(hi, lo, self.mask)
        for fp, at in zip(fps.tolist(), buckets.tolist(), strict=True):
            self.keys += 1
            if self._free(at, fp) or self._free(other := at ^ int(SPREAD[fp]) & self.mask, fp):
                continue
            at = other
            for kick in range(KICKS):
                i = SLOTS * at + kick % SLOTS
                fp, self.cells[i] = self.cells[i], fp
                at ^= int(SPREAD[fp]) & self.mask
                if self._free(at, fp):
                    break
            else:
                self.stash.append(at << 16 | fp)

    def remove(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Only keys that are in."""
        fps, buckets, others = places(hi, lo, self.mask)
        for fp, a, b in zip(fps.tolist(), buckets.tolist(), others.tolist(), strict=True):
            self.keys -= 1
            for i in (*range(SLOTS * a, SLOTS * a + SLOTS), *range(SLOTS * b, SLOTS * b + SLOTS)):
                if self.cells[i] == fp:
                    self.cells[i] = 0
                    break
            else:
                self.stash.remove(a << 16 | fp if a << 16 | fp in self.stash else b << 16 | fp)

    def packed(self) -> np.ndarray:
        return np.array(self.cells, np.uint16)


def places(hi: np.ndarray, lo: np.ndarray, mask) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint and both buckets of each key."""
    fp = np.maximum(lo.astype(np.uint64) >> np.uint64(48), np.uint64(1))
    mask = np.asarray(mask).astype(np.uint64)
    first = (hi.astype(np.uint64) >> np.uint64(24)) & mask
    return fp, first, first ^ (SPREAD[fp.astype(np.int64)] & mask)


class Filters:
    """The filters of all shards in one array."""

    def __init__(self, rows: list, shards: int):
        self.shards, cells = shards, []
        self.start, self.mask, at = np.zeros(shards, np.int64), np.full(shards, -1, np.int64), 0
        self.stash: dict[int, list[int]] = {}
        for r in rows:
            mine = np.frombuffer(r.cells, np.uint16)
            self.start[r.shard], self.mask[r.shard] = at, len(mine) // SLOTS - 1
            at += len(mine) // SLOTS
            cells.append(mine)
            if r.stash:
                self.stash[r.shard] = list(r.stash)
        self.cells = np.concatenate(cells or [np.zeros(0, np.uint16)]).reshape(-1, SLOTS)

    def hit(self, keys: np.ndarray) -> np.ndarray:
        """Whether each row (hi, lo) may be a repeated key."""
        shard = keys[:, 0] & (self.shards - 1)
        found = self.mask[shard] >= 0
        hi, lo, shard = keys[found, 0], keys[found, 1], shard[found]
        fp, a, b = places(hi, lo, self.mask[shard])
        start, small = self.start[shard], fp.astype(np.uint16)[:, None]
        inside = (self.cells[start + a.astype(np.int64)] == small).any(axis=1) | (self.cells[start + b.astype(np.int64)] == small).any(axis=1)
        for s, stash in self.stash.items():
            mine, f = shard == s, fp.astype(np.int64)
            inside |= mine & (np.isin(a.astype(np.int64) << 16 | f, stash) | np.isin(b.astype(np.int64) << 16 | f, stash))
        out = np.zeros(len(keys), bool)
        out[found] = inside
        return out


def line_key(line: bytes, least_chars: int) -> bytes | None:
    """The hash of a line's key; none where the key is too short."""
    key = line.strip(SPACE).lower()  # bytes: A-Z only
    if len(key) < least_chars or (len(key) < 4 * least_chars and len(key.decode()) < least_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _pairs(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)


def _texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    return [t or b"" for t in batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).to_pylist()]


def _keys(docs: DataFrame, least_chars: int, keep: list[str], probe=None) -> DataFrame:
    """``keep``, hi, lo: each distinct key of each document; with ``probe`` only those that the filters may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = probe.value if probe else None
        for batch in text_slices(batches):
            rows, keys = [], []
            for i, text in enumerate(_texts(batch)):
                mine = {k for line in text.split(b"\n") if (k := line_key(line, least_chars))}
                rows += [i] * len(mine)
                keys += mine
            rows, keys = np.array(rows, np.int64), _pairs(keys)
            if filters:
                hit = filters.hit(keys)
                rows, keys = rows[hit], keys[hit]
            kept = [batch.column(batch.schema.get_field_index(c)).take(pa.array(rows)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(keys[:, 0]), pa.array(keys[:, 1])], names=[*keep, *KEY])

    slim = docs.select(*keep, "text")
    schema = StructType([*slim.select(*keep).schema.fields, *StructType.fromDDL("hi long, lo long").fields])
    return slim.mapInArrow(run, schema)


def _read(spark: SparkSession, index: Index, table: str, schema: str) -> DataFrame:
    """All generations up to the index's own, with column gen."""
    return spark.read.schema(f"{schema}, gen int").parquet(f"{index.path}/{table}").filter(F.col("gen") <= index.generation)


def repeated(spark: SparkSession, index: Index) -> DataFrame:
    """hi, lo, docs, last of the keys that are repeated now."""
    if not index.generation:
        return spark.createDataFrame([], REPEATED)
    rows = _read(spark, index, "repeated", REPEATED)
    if index.generation > 1:
        rows = rows.groupBy(*KEY).agg(F.max_by(F.struct("docs", "last"), "gen").alias("now")).select(*KEY, "now.*")
    return rows.filter(F.col("docs") >= index.least_docs).select(*KEY, "docs", "last")


def _passed(index: Index, docs: DataFrame, sign: int) -> Index:
    spark, new = docs.sparkSession, replace(index, generation=index.generation + 1)
    at = lambda table: f"{index.path}/{table}/gen={new.generation}"
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    _keys(slim, index.least_chars, ["doc_id"]).select(*KEY, "doc_id", F.lit(sign).alias("refs")).write.parquet(at("holders"))

    holders = _read(spark, new, "holders", HOLDERS)
    touched = holders.filter(F.col("gen") == new.generation).select(*KEY).distinct()
    if index.generation:
        holders = holders.join(touched, KEY, "left_semi")
    held = holders.groupBy(*KEY, "doc_id").agg(F.sum("refs").alias("refs")).filter("refs > 0")
    now = held.groupBy(*KEY).agg(F.count("doc_id").alias("docs"), F.max("doc_id").alias("last")).filter(F.col("docs") >= index.least_docs)
    if index.generation:
        was = repeated(spark, index).join(touched, KEY, "left_semi").select(*KEY, F.lit(True).alias("was"))
        now = now.join(was, KEY, "full").select(*KEY, F.coalesce("docs", F.lit(0)).cast("long").alias("docs"), "last", F.coalesce("was", F.lit(False)).alias("was"))
    else:
        now = now.withColumn("was", F.lit(False))
    now.write.parquet(at("repeated"))

    changes = spark.read.schema(f"{REPEATED}, was boolean").parquet(at("repeated")).select(*KEY, "was", (F.col("docs") >= index.least_docs).alias("is")).filter("was <> is")
    state = repeated(spark, new)
    new = replace(new, shards=max(index.shards, 1 << max(0, int(np.ceil(np.log2(state.count() / SHARD_KEYS or 1))))))
    _filters(spark, index, new, state, changes).write.parquet(at("filters"))
    return new


def _filters(spark: SparkSession, index: Index, new: Index, state: DataFrame, changes: DataFrame) -> DataFrame:
    """The filters of the new generation: old ones with the changes, or anew from the exact table where they would be too full."""
    shard = F.col("hi").bitwiseAND(F.lit(new.shards - 1)).cast("int").alias("shard")
    old = filters(spark, index) if new.shards == index.shards else spark.createDataFrame([], FILTERS)
    load = state.groupBy(shard).agg(F.count("*").alias("due")).join(old.select("shard", (F.length("cells") / 2).alias("cells")), "shard", "left")
    anew = load.filter(F.col("cells").isNull() | (F.col("due") > LOAD * F.col("cells"))).select("shard")
    every = state.select(shard, *KEY, F.lit(True).alias("is")).join(anew, "shard", "left_semi")
    some = changes.select(shard, *KEY, "is").join(anew, "shard", "left_anti")

    def run(key: tuple, before: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        more, less = keys[keys["is"]], keys[~keys["is"].astype(bool)]
        if len(before):
            f = Cuckoo(np.frombuffer(before.cells[0], np.uint16), list(before.stash[0]), int(before["keys"][0]))
        else:
            f = Cuckoo.sized(len(more))
        f.remove(less.hi.to_numpy(), less.lo.to_numpy())
        f.add(more.hi.to_numpy(), more.lo.to_numpy())
        return pd.DataFrame({"shard": [key[0]], "keys": [f.keys], "cells": [f.packed().tobytes()], "stash": [f.stash]})

    kept = old.join(anew, "shard", "left_anti")
    return kept.groupBy("shard").cogroup(every.unionByName(some).groupBy("shard")).applyInPandas(run, FILTERS)


def filters(spark: SparkSession, index: Index) -> DataFrame:
    if not index.generation:
        return spark.createDataFrame([], FILTERS)
    return spark.read.schema(FILTERS).parquet(f"{index.path}/filters/gen={index.generation}")


def insert(index: Index, docs: DataFrame) -> Index:
    """The index with the documents in."""
    return _passed(index, docs, 1)


def delete(index: Index, docs: DataFrame) -> Index:
    """The index without the documents, as if they had never been in."""
    return _passed(index, docs, -1)


def _losses(index: Index, docs: DataFrame, row: list[str]) -> DataFrame:
    """``row``, gone: the hashes of the keys whose lines each row loses."""
    spark = docs.sparkSession
    made = filters(spark, index)
    size = made.agg(F.coalesce(F.sum(F.length("cells") + 8 * F.size("stash")), F.lit(0))).first()[0]
    probe = spark.sparkContext.broadcast(Filters(made.collect(), index.shards)) if size <= FILTER_BYTES else None
    asked = _keys(docs.select(*row, F.col("doc_id").cast("long").alias("doc_id"), "text"), index.least_chars, [*row, "doc_id"], probe)
    lost = asked.join(repeated(spark, index), KEY).filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    return lost.groupBy(*row).agg(F.collect_set(F.struct(*KEY)).alias("gone"))


def _cut(text: bytes, gone: set[bytes], least_chars: int) -> tuple[int, list[bytes]]:
    lines = text.split(b"\n")
    return len(lines), [x for x in lines if line_key(x, least_chars) not in gone] if gone else lines


def _gone(batch: pa.RecordBatch, column: str) -> list[set[bytes]]:
    """The hashes as the bytes that :func:`line_key` gives."""
    lists = batch.column(batch.schema.get_field_index(column))
    flat = lists.flatten()
    joined = np.column_stack([np.asarray(flat.field(c)).astype("<i8") for c in KEY]).tobytes() if len(flat) else b""
    keys = [joined[i : i + 16] for i in range(0, len(joined), 16)]
    out, at = [], 0
    for n in lists.value_lengths().fill_null(0).to_pylist():
        out.append(set(keys[at : at + n]))
        at += n
    return out


def _joined(index: Index, docs: DataFrame) -> tuple[DataFrame, str]:
    row = [free_name(docs, "row_a"), free_name(docs, "row_b")]
    marked = docs.withColumns({row[0]: F.xxhash64("doc_id", "text"), row[1]: F.xxhash64(F.lit(1), "text", "doc_id")})
    gone = free_name(docs, "gone")
    return marked.join(_losses(index, marked, row).withColumnRenamed("gone", gone), row, "left").drop(*row), gone


def clean(index: Index, docs: DataFrame) -> DataFrame:
    """``docs`` with the lines that stay as text, and columns n_lines and n_dropped."""
    joined, gone = _joined(index, docs)
    names = [free_name(docs, n) for n in ("n_lines", "n_dropped")]
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(f"{names[0]} long, {names[1]} long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            made = [_cut(t, g, index.least_chars) for t, g in zip(_texts(batch), _gone(batch, gone), strict=True)]
            at = batch.schema.get_field_index("text")
            columns = [*batch.columns[:at], pa.array([b"\n".join(k).decode() for _, k in made], batch.schema.field(at).type), *batch.columns[at + 1 :]]
            columns.pop(batch.schema.get_field_index(gone))
            columns += [pa.array([n for n, _ in made], pa.int64()), pa.array([n - len(k) for n, k in made], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*[c for c in batch.schema.names if c != gone], *names])

    return joined.mapInArrow(run, schema)


def report(docs: DataFrame, index: Index | None = None) -> DataFrame:
    """One row per input row: lines, lines dropped, hash of what stays. Without an index all of ``docs`` go into a new one."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = index or insert(empty(docs.sparkSession), docs)
    joined, gone = _joined(index, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            made = [_cut(t, g, index.least_chars) for t, g in zip(_texts(batch), _gone(batch, gone), strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("doc_id")), pa.array([n for n, _ in made], pa.int64()), pa.array([n - len(k) for n, k in made], pa.int64()),
                pa.array([hashlib.sha256(b"\n".join(k)).hexdigest() for _, k in made], pa.string()),
            ], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), s AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.last AS dropped FROM k LEFT JOIN s ON k.key = s.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY r
"""
