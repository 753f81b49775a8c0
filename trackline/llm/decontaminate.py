"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are folded to lower-case letters and digits with single spaces. Items are cut into
overlapping segments (short ones stay whole), so that every excerpt of ``segment + stride - 1`` bytes of an item, about 25
words, holds a whole segment and is found. If a segment of L bytes occurs in a text with at most e edits, they share at least
L + 1 - q - q*e q-grams whose positions differ by nearly the same amount. So q-gram hits are counted in overlapping
bands of diagonals; a band that meets its segment's count marks a region, and a banded alignment decides it.

The benchmark is taken in blocks of bounded size, each small enough for every task; the corpus is never shuffled. With
more than one block, each block is a pass of its own whose result is written down before the next block is sent out, so
one block at a time stands in memory whatever the benchmark's size.

Null and empty texts match nothing. Items with fewer letters and digits than ``least`` bytes identify nothing and are left
out; items with equal texts are all reported. Rows are judged alone, so repeated rows get equal results. Texts are taken
whole, however long. An empty corpus or benchmark gives no match. Columns besides the id and the text are not read by
:func:`report` and returned as they are by :func:`remove`, so their names cannot clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackline.llm.common import stored

BLOCK_BYTES = 8_000_000  # benchmark text of one block
SLICE_BYTES = 1_000_000  # text worked on at once
HITS = 2_000_000  # gram hits counted at once
REGIONS = 4096  # regions aligned at once
BANDS = 1 << 16  # more than there are bands before a text's first place
TABLE_BITS = 22


@dataclass(frozen=True)
class Rule:
    """q-gram length, edits allowed per byte, and how items are cut."""

    q: int = 10
    edit_rate: float = 0.08
    segment: int = 96
    stride: int = 48
    least: int = 20  # letters, digits and spaces of an item that identify it


def folded(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{Nd}]+", " ")))


def _grams(data: np.ndarray, q: int) -> np.ndarray:
    """A polynomial hash of every q bytes, built from hashes of powers of two."""
    base = 0x9E3779B97F4A7C15
    power = lambda n: np.uint64(pow(base, n, 1 << 64))
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, width, hashes = None, 0, 1, data.astype(np.uint64)
    while True:
        if q & width:
            part = hashes[at : at + n]
            out = part if out is None else out[:n] * power(width) + part
            at += width
        if 2 * width > q:
            return out
        hashes = hashes[: len(hashes) - width] * power(width) + hashes[width:]
        width *= 2


def banded_edits(patterns: np.ndarray, texts: np.ndarray, budgets: np.ndarray) -> np.ndarray:
    """For each row the least edits between its pattern and any piece of its text that starts at one of the first
    width(texts) - width(patterns) + 1 places; more than the row's budget where more edits are needed.

    All rows are aligned at once, cells kept by diagonal; every few steps those beyond their budgets leave.
    """
    rows, m = patterns.shape
    width = texts.shape[1] - m + 1
    out = budgets + 1
    if width <= 0 or rows == 0:
        return out
    alive, steps = np.arange(rows), np.arange(width, dtype=np.int32)
    row = np.zeros((rows, width), np.int32)
    for i in range(m):
        cells = row + (texts[:, i : i + width] != patterns[:, i : i + 1])
        np.minimum(cells[:, :-1], row[:, 1:] + 1, out=cells[:, :-1])
        row = np.minimum.accumulate(cells - steps, axis=1) + steps
        if i % 8 == 7:
            near = row.min(axis=1) <= budgets
            if not near.all():
                alive, row, texts, patterns, budgets = alive[near], row[near], texts[near], patterns[near], budgets[near]
                if len(alive) == 0:
                    return out
    out[alive] = row.min(axis=1)
    return out


class Block:
    """The segments of some items and the table of their q-grams."""

    def __init__(self, items: list[tuple[int, bytes]], rule: Rule):
        self.q = rule.q
        items_of: dict[bytes, list[int]] = {}
        for item, text in items:
            if len(text) < max(rule.q, rule.least):
                continue
            starts = [0] if len(text) <= rule.segment else [*range(0, len(text) - rule.segment, rule.stride), len(text) - rule.segment]
            for at in starts:
                items_of.setdefault(text[at : at + rule.segment], []).append(item)
        self.texts = [np.frombuffer(t, np.uint8) for t in items_of]
        self.items = [sorted(set(i)) for i in items_of.values()]  # of equal segments one stands for all
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.minimum((sizes * rule.edit_rate).astype(np.int64), (sizes - rule.q) // rule.q)
        self.least = sizes + 1 - rule.q - rule.q * self.edits
        grams = [_grams(t, rule.q) for t in self.texts]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.segment = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.place = np.concatenate([np.arange(len(g)) for g in grams])[order] if grams else np.zeros(0, np.int64)
        self.keys, self.first, self.many = np.unique(flat[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self._slot(self.keys)] = True

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - TABLE_BITS)

    def _regions(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows (text, segment, first diagonal, last diagonal) of the bands that meet the lemma."""
        grams = _grams(data, self.q)
        at = np.flatnonzero(self.table[self._slot(grams)])
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + self.q <= offsets[row + 1]
        at, row = at[inside], row[inside]
        key = np.searchsorted(self.keys, grams[at]).clip(max=len(self.keys) - 1)
        same = self.keys[key] == grams[at]
        at, row, key = at[same], row[same], key[same]
        if len(at) == 0:
            return np.zeros((0, 4), np.int64)
        many = self.many[key]
        found, span = [], len(data) + 2 * BANDS
        cut = np.flatnonzero(np.diff(np.cumsum(many) // HITS)) + 1
        for shift in (0, 1):
            codes, counts = [], []
            for part in np.split(np.arange(len(at)), cut):
                code, count = np.unique(self._codes(at[part], row[part], key[part], offsets, shift, span), return_counts=True)
                codes.append(code)
                counts.append(count)
            code, count = codes[0], counts[0]
            if len(codes) > 1:
                code, which = np.unique(np.concatenate(codes), return_inverse=True)
                count = np.bincount(which, np.concatenate(counts)).astype(np.int64)
            both, band = np.divmod(code, span)
            text, segment = np.divmod(both, len(self.texts))
            keep = count >= self.least[segment]
            text, segment, half = text[keep], segment[keep], self.edits[segment[keep]] + 1
            low = (band[keep] - BANDS) * 2 * half - shift * half
            found.append(np.stack([text, segment, low, low + 2 * half - 1], 1))
        return np.concatenate(found)

    def _codes(self, at: np.ndarray, row: np.ndarray, key: np.ndarray, offsets: np.ndarray, shift: int, span: int) -> np.ndarray:
        """Text, segment and band of each hit of the grams at some places, as one number."""
        many = self.many[key]
        hit = np.repeat(np.arange(len(at)), many)
        source = np.repeat(self.first[key] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        segment = self.segment[source]
        half = self.edits[segment] + 1
        band = (at[hit] - offsets[row[hit]] - self.place[source] + shift * half) // (2 * half)
        return (row[hit] * len(self.texts) + segment) * span + band + BANDS

    def _aligned(self, regions: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The edits of each region, aligned together in groups of equal lengths."""
        sizes = np.array([len(t) for t in self.texts], np.int64)[regions[:, 1]]
        budgets, out = self.edits[regions[:, 1]], np.zeros(len(regions), np.int64)
        for size in np.unique(sizes):
            for budget in np.unique(budgets[sizes == size]):
                mine = np.flatnonzero((sizes == size) & (budgets == budget))
                for part in np.array_split(mine, -(-len(mine) // REGIONS)):
                    row, segment, low, high = regions[part].T
                    a, wide = offsets[row] + low - budget, int(high[0] - low[0]) + size + 2 * budget + 1
                    place = a[:, None] + np.arange(wide)
                    inside = (place >= offsets[row][:, None]) & (place < offsets[row + 1][:, None])
                    texts = np.where(inside, data[place.clip(0, len(data) - 1)], 0)  # zeros stand outside the text and equal no byte of a segment
                    patterns = np.stack([self.texts[s] for s in segment.tolist()])
                    out[part] = banded_edits(patterns, texts, np.full(len(part), budget))
        return out

    def matches(self, values: pa.Array) -> list[list[dict]]:
        """For each text, the items found in it with the fewest edits of any of their segments."""
        values = values.fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
        data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        best: list[dict] = [{} for _ in range(len(values))]
        if not self.texts:
            return [[] for _ in best]
        regions = self._regions(data, offsets)
        edits = self._aligned(regions, data, offsets) if len(regions) else np.zeros(0, np.int64)
        good = edits <= self.edits[regions[:, 1]]
        for row, segment, e in np.column_stack([regions[good, 0], regions[good, 1], edits[good]]).tolist():
            for item in self.items[segment]:
                best[row][item] = min(e, best[row].get(item, e))
        return [[{"item_id": i, "edits": e} for i, e in sorted(x.items())] for x in best]


@lru_cache(maxsize=1)
def _block(shared: Shared) -> Block:
    return Block(shared.items.value, shared.rule)


class Shared:
    """A broadcast block of items, equal to others of the same broadcast."""

    def __init__(self, items: Broadcast, rule: Rule):
        self.items, self.rule, self.name = items, rule, uuid.uuid4().hex

    def __hash__(self) -> int:
        return hash(self.name)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Shared) and self.name == other.name


def _slices(values: pa.Array) -> Iterator[pa.Array]:
    sizes = np.asarray(pc.fill_null(pc.binary_length(values), 0)).astype(np.int64)
    run = (np.cumsum(sizes) - 1).clip(0) // SLICE_BYTES
    edges = np.r_[0, np.flatnonzero(np.diff(run)) + 1, len(values)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield values.slice(a, b - a)


def _blocks(benchmark: DataFrame) -> Iterator[list]:
    """The benchmark's items in blocks of at most about BLOCK_BYTES; one block at a time is on the driver."""
    block, size = [], 0
    rows = benchmark.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", folded(F.col("text")).alias("text"))
    for r in rows.toLocalIterator():
        block.append((r.item_id, r.text.encode()))
        size += len(r.text)
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def matches(text: Column, shared: Shared) -> Column:
    """Array of (item_id, edits): the items of the block of which the text holds a segment."""

    @F.arrow_udf("array<struct<item_id:long,edits:int>>")
    def found(values: pa.Array) -> pa.Array:
        block, out = _block(shared), []
        for part in _slices(values):
            out += block.matches(part)
        return pa.array(out, pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32())])))

    return found(folded(text))


def _passes(docs: DataFrame, benchmark: DataFrame, rule: Rule, one_pass: Callable, next_docs: Callable) -> list[DataFrame]:
    """``one_pass(docs, shared)`` for each block, on ``next_docs(docs, result)`` of the block before.

    Results of several blocks are written down, and a block is freed before the next one goes out.
    """
    blocks, results = _blocks(benchmark), []
    block = next(blocks, None)
    while block is not None:
        after = next(blocks, None)
        sent = docs.sparkSession.sparkContext.broadcast(block)
        result = one_pass(docs, Shared(sent, rule))
        if results or after is not None:
            result = stored(result, "benchmark-block")
            sent.unpersist()
        results.append(result)
        docs, block = next_docs(docs, result), after
    return results


def report(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row per document row and benchmark item found in it; clean documents have no row."""

    def found(rows: DataFrame, shared: Shared) -> DataFrame:
        hits = rows.select("doc_id", F.explode(matches(F.col("text"), shared)).alias("m"))
        return hits.select("doc_id", F.col("m.item_id").alias("item_id"), F.col("m.edits").alias("edits"))

    none = docs.limit(0).select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("edits"))
    parts = _passes(docs, benchmark, rule, found, lambda rows, _: rows)
    return reduce(DataFrame.unionByName, parts) if parts else none


def remove(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark passage."""
    clean = lambda rows, shared: rows.filter(F.size(matches(F.col("text"), shared)) == 0)
    return [docs, *_passes(docs, benchmark, rule, clean, lambda _, kept: kept)][-1]
