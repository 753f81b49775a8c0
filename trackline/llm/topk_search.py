"""Exact top-k inner-product search by pivot-table elimination.

Distances from every vector to a few dozen pivots are computed first. For a query q and a vector x the triangle
inequality gives |q-x| >= max over pivots of |d(q,p) - d(x,p)|, hence q.x <= (|q|^2 + |x|^2 - bound^2) / 2. Rows of one
nearest pivot and of like distance to it form a cell; its least and greatest distance to each pivot bound all of its rows at
once. A query's cell of the highest bound is evaluated first, then the others in the order of their bounds, each against those queries
alone whose k-th best score its bound still reaches, so the result is exact whatever the pivots are.

A part is a share of the rows that a task can hold. Rows are shuffled once, as packed blocks; the queries go to every
part in blocks and pass its rows one block after the other. So what is shuffled grows with rows, and with queries times
parts; nothing is broadcast, and nothing passes the driver but the pivots, two counts, the dimension and the extremes.

Rows with a null id or vector, or a null or non-finite component, take no part. Vectors of different lengths are
compared as if the shorter ended in zeros. A repeated query id is answered once, for its smallest vector; repeated
candidate rows each count; a candidate with the query's id is the query's own row. Components must be small enough
for the products to fit in 64 bits. An empty table gives no rows. Only the id and the vector are read, so columns of other
names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackline.llm.common import release

PIVOTS = 32
PIVOT_SAMPLE = 2048  # rows among which the pivots are sought
QUERY_BLOCK, ROW_BLOCK = 1024, 4096  # queries evaluated together; a quarter of the rows for which a part is worth while
CELL, PART_BYTES = 1024, 1 << 26  # rows of a cell at most; packed vectors of a part


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """Columns ``id`` and ``v``: the usable rows, each component x as floor(scale * x)."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(~bad).select(
        F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v")
    )


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    out, n = np.zeros((len(vectors), dim), np.int64), np.asarray(pc.list_value_length(vectors)).astype(np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = values
    return out


def choose_pivots(vectors: DataFrame, rows: int, dim: int, n: int = PIVOTS) -> np.ndarray:
    """Farthest-first pivots among a bounded sample, the rows with the smallest id hashes of an even share of the ``rows``.
    They are chosen in a task; only they pass the driver."""

    def farthest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = np.concatenate([np.zeros((0, dim)), *[_matrix(b.column(0), dim).astype(np.float64) for b in batches]])
        if len(pool):
            chosen, nearest = [0], np.linalg.norm(pool - pool[0], axis=1)
            while len(chosen) < n and nearest.max() > 0:
                chosen.append(int(nearest.argmax()))
                nearest = np.minimum(nearest, np.linalg.norm(pool - pool[chosen[-1]], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array([pool[i].tobytes() for i in chosen], pa.binary())], names=["pivot"])

    share = F.pmod(F.xxhash64("id"), F.lit(max(1, rows // (4 * PIVOT_SAMPLE)))) == 0
    sample = vectors.filter(share).orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE)
    found = [np.frombuffer(r.pivot) for r in sample.select("v").mapInArrow(farthest, "pivot binary").collect()]
    return np.stack(found[:n]) if found else np.zeros((0, dim))


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], 1) if len(pivots) else np.zeros((len(x), 0))


class Part:
    """The rows of one part in cells of one nearest pivot each, with the extremes of their distances to all pivots."""

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray]], pivots: np.ndarray, product: type):
        near, away = [], []
        for _, x in blocks:
            table = _to_pivots(x, pivots) if len(pivots) else np.zeros((len(x), 1))
            near.append(table.argmin(1))
            away.append(table.min(1))
        near = np.concatenate(near)
        order = np.lexsort((np.concatenate(away), near))
        self.ids, self.x = np.concatenate([i for i, _ in blocks])[order], np.concatenate([x for _, x in blocks])[order]
        self.pivots, self.product, near = pivots, product, near[order]
        first = np.searchsorted(near, near)  # where the rows of the same pivot begin
        self.starts = np.flatnonzero((np.arange(len(near)) - first) % CELL == 0)
        self.ends = np.r_[self.starts[1:], len(near)]
        self.low, self.high, self.norm = np.zeros((len(self.starts), len(pivots))), np.zeros((len(self.starts), len(pivots))), np.zeros(len(self.starts))
        for c, (a, b) in enumerate(zip(self.starts, self.ends, strict=True)):
            table = _to_pivots(self.x[a:b], pivots)
            self.low[c], self.high[c], self.norm[c] = table.min(0), table.max(0), (self.x[a:b].astype(np.float64) ** 2).sum(1).max()

    def best(self, ids: np.ndarray, x: np.ndarray, k: int) -> pa.RecordBatch:
        """The ``k`` best rows of this part for each of a block of queries."""
        order = np.argsort(ids)
        best = Best(ids[order], x[order], k, self.product)
        bound = self._bounds(x[order])
        at = np.searchsorted(best.ids, self.ids).clip(max=len(ids) - 1)
        own = np.flatnonzero(best.ids[at] == self.ids)
        first = bound.argmax(1)

        def meet(c: int, asked: np.ndarray) -> None:
            a, b = self.starts[c], self.ends[c]
            mine = own[np.searchsorted(own, a) : np.searchsorted(own, b)]
            best.meet(asked, self.ids[a:b], self.x[a:b], mine - a, at[mine])

        for c in np.unique(first):
            meet(c, np.flatnonzero(first == c))
        for c in np.argsort(-bound.max(0), kind="stable"):
            asked = np.flatnonzero((bound[:, c] >= best.least) & (first != c))
            if len(asked):
                meet(c, asked)
        return best.rows()

    def _bounds(self, x: np.ndarray) -> np.ndarray:
        """The highest score that a row of each cell can have with each query."""
        table, norms = _to_pivots(x, self.pivots), (x.astype(np.float64) ** 2).sum(1)
        low = np.zeros((len(x), len(self.starts)))
        for p in range(len(self.pivots)):
            np.maximum(low, table[:, p, None] - self.high[None, :, p], out=low)
            np.maximum(low, self.low[None, :, p] - table[:, p, None], out=low)
        both = norms[:, None] + self.norm[None, :]
        bound = np.minimum((both - low**2) / 2, np.sqrt(norms[:, None] * self.norm[None, :]))
        return bound + 1e-9 * both + 1e-3  # keeps rounding of the distances from hiding a row


class Best:
    """The best rows so far of one block of queries, by ascending query ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, product: type):
        self.ids, self.x, self.k, self.product = ids, x.astype(product), k, product
        self.none = -np.inf if product is np.float64 else np.iinfo(product).min
        self.least, self.last = np.full(len(ids), self.none, product), np.full(len(ids), np.iinfo(np.int64).max)  # the k-th best score and its id
        self.found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, product)

    def meet(self, asked: np.ndarray, ids: np.ndarray, x: np.ndarray, own_rows: np.ndarray, own_queries: np.ndarray) -> None:
        scores = self.x[asked] @ x.astype(self.product).T
        at = np.searchsorted(asked, own_queries).clip(max=len(asked) - 1)
        own = asked[at] == own_queries
        scores[at[own], own_rows[own]] = self.none
        floor = self.least[asked]
        if len(ids) > self.k and (floor == self.none).any():
            floor = np.maximum(floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
        i, j = np.nonzero(scores >= floor[:, None])
        score, row, query = scores[i, j], ids[j], asked[i]
        open_ = (score > self.least[query]) | ((score > self.none) & (row < self.last[query]))
        if open_.any():
            self._add(query[open_], row[open_], score[open_])

    def _add(self, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        query, row, score = (np.r_[old, new] for old, new in zip(self.found, (query, row, score), strict=True))
        order = np.lexsort((row, -score, query))
        query, row, score = query[order], row[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = rank < self.k
        self.found = query[kept], row[kept], score[kept]
        full = rank == self.k - 1
        self.least[query[full]], self.last[query[full]] = score[full], row[full]

    def rows(self) -> pa.RecordBatch:
        query, row, score = self.found
        return pa.RecordBatch.from_arrays([pa.array(self.ids[query]), pa.array(row), pa.array(score.astype(np.int64))], names=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """The ``k`` highest inner products of each query row of ``vectors`` (columns id, v) with all other rows.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id.
    """
    spark = vectors.sparkSession
    known = vectors.agg(F.max(F.size("v")).alias("dim"), F.count("*").alias("n"), F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
    dim, top = max(1, known.dim or 0), max(abs(known.low or 0), abs(known.high or 0))
    packed = next(t for t in (np.int16, np.int32, np.int64) if top <= np.iinfo(t).max or t is np.int64)
    product = np.float64 if dim * top * top < 2**53 else np.int64  # doubles hold such products exactly
    held = -(-known.n * dim * np.dtype(packed).itemsize // PART_BYTES)
    parts = max(1, held, min(-(-known.n // (4 * ROW_BLOCK)), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    pivots = choose_pivots(vectors, known.n, dim)

    def pack(size: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    ids, x = batch.column(0).slice(at, size).to_numpy(), _matrix(batch.column(1).slice(at, size), dim).astype(packed)
                    yield pa.RecordBatch.from_arrays([pa.array([int(ids[0])]), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["first", "ids", "x"])

        return run

    block = "first long, ids binary, x binary"
    rows = vectors.select("id", "v").mapInArrow(pack(max(1, ROW_BLOCK // 4)), block).select(F.pmod(F.xxhash64("first"), F.lit(parts)).cast("int").alias("part"), F.lit(False).alias("asks"), "ids", "x")
    queries = vectors.filter(is_query).groupBy("id").agg(F.min("v").alias("v")).select("id", "v").mapInArrow(pack(QUERY_BLOCK), block)
    queries = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(True).alias("asks"), "ids", "x")
    met = rows.unionByName(queries).repartitionById(parts, "part").sortWithinPartitions("part", "asks")

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, blocks, asked = None, None, [], []

        def answers() -> Iterator[pa.RecordBatch]:
            if asked and part is not None:
                yield part.best(np.concatenate([i for i, _ in asked]), np.concatenate([x for _, x in asked]), k)
            asked.clear()

        for batch in batches:
            for p, asks, i, x in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("part", "asks", "ids", "x")), strict=True):
                if p.as_py() != at:
                    yield from answers()
                    part, at, blocks = None, p.as_py(), []
                    release()
                ids = np.frombuffer(i.as_buffer(), np.int64)
                one = ids, np.frombuffer(x.as_buffer(), packed).reshape(len(ids), dim)
                if not asks.as_py():
                    blocks.append(tuple(a.copy() for a in one))
                    continue
                if blocks:
                    part, blocks = Part(blocks, pivots, product), []
                asked.append(one)
                if sum(len(i) for i, _ in asked) >= QUERY_BLOCK:
                    yield from answers()
        yield from answers()

    found = met.mapInArrow(evaluate, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``; candidates are all rows."""
    return search(integer_vectors(embeddings), F.col("id") % every == 0, k)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
