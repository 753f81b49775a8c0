"""Encoding into sampled pieces, and decoding.

Forward filtering gives the summed probability of every prefix of a unit; backward sampling draws the last piece, then
the last of what is left, each in proportion to its share of all segmentations. The draw at a place of a text depends
on the row key, the seed and that place only, so a row gets the same pieces in any batch, task or run.

Decoding joins the pieces and takes off the dummy space; it gives back every text as it was, whatever its characters.
A null text has no pieces (null in :func:`encode`); an empty one is a single word mark. Rows with equal key and text
get equal pieces. Texts are taken whole; a very long one is a piece of work of its own. Columns of the input other than
text and key are passed through; those named as an added one are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackline.llm.common import mix64, text_slices
from trackline.llm.lattice import LITERAL_MARK, Lattice, Units, Vocabulary, vocabulary

SLICE_CHARS = 250_000  # of text worked on at once; its lattice takes about 200 bytes a character
SEED = 42


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= SLICE_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def sample(vocab: Vocabulary, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts in one array, and where each text's begin."""
    flat, begins = vocab.codes(texts)
    units = Units(vocab, flat, begins)
    lattice = Lattice(vocab, units.codes, units.offset)
    steps = lattice.cumulative()
    node_steps = np.r_[0, steps][lattice.first]
    chosen = np.full(len(flat) + 1, -1, np.int32)  # piece that ends at a place
    text_of = np.searchsorted(begins, units.start, "right") - 1
    seed, zero = mix64(keys.view(np.uint64))[text_of], units.start - begins[text_of]
    place = units.end.copy()
    node = lattice.last[units.kind]
    root = node - (units.end - units.start)
    alive = np.arange(len(place))
    while len(alive):
        inner = (place[alive] - units.start[alive] + zero[alive]).astype(np.uint64)
        with np.errstate(over="ignore"):
            draw = (mix64(seed[alive] + inner * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64)
        arc, target = lattice.first[node[alive]], node_steps[node[alive]] + draw
        open_ = np.flatnonzero(steps[arc] <= target)  # a node has few arcs, so walking along them beats a search in all
        while len(open_):
            arc[open_] += 1
            open_ = open_[steps[arc[open_]] <= target[open_]]
        chosen[place[alive]] = lattice.piece[arc]
        node[alive] = lattice.begin[arc]
        place[alive] -= lattice.length[arc]
        alive = alive[node[alive] > root[alive]]
    lone = np.flatnonzero(~units.known)  # characters written as bytes
    count = (chosen >= 0).astype(np.int64)
    spelled = ["▁" if c == LITERAL_MARK else chr(c) for c in flat[lone].tolist()]
    spelled = [c.encode() for c in spelled]
    count[lone + 1] = [len(s) for s in spelled]
    before = np.r_[0, np.cumsum(count)]
    ids = np.zeros(before[-1], np.int32)
    ends = np.flatnonzero(chosen >= 0)
    ids[before[ends]] = chosen[ends]
    if len(lone):
        at = before[lone + 1]
        sizes = count[lone + 1]
        where = np.repeat(at - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        ids[where] = vocab.byte_id[np.frombuffer(b"".join(spelled), np.uint8)]
    return ids, before[begins + 1]


def decoded(vocab: Vocabulary, ids: np.ndarray) -> str:
    """The text of some piece ids."""
    return b"".join(map(vocab.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


def _ids(vocab: Vocabulary, texts: list[str | None], keys: np.ndarray) -> pa.ListArray:
    flat, begins = sample(vocab, [t or "" for t in texts], keys)
    return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(flat), mask=pa.array([t is None for t in texts]))


def encode(text: Column, key: Column, path: str, temperature: float = 1.0, seed: int = SEED) -> Column:
    """Array of sampled piece ids of each text; ``key`` is the row key that seeds the draws.

    The ids of a whole Arrow batch are held at once; for large tables :func:`pieces` sends them on slice by slice.
    """

    @F.arrow_udf("array<int>")
    def ids(values: pa.Array, keys: pa.Array) -> pa.Array:
        texts, seeds = values.to_pylist(), keys.to_numpy(zero_copy_only=False)
        vocab = vocabulary(path, temperature)
        parts = [_ids(vocab, texts[a:b], seeds[a:b]) for a, b in _slices(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return ids(text, F.xxhash64(key, F.lit(seed)))


def pieces(docs: DataFrame, path: str, key: str = "doc_id", temperature: float = 1.0, seed: int = SEED) -> DataFrame:
    """``docs`` with ``piece_ids``, their number ``n_pieces`` (0 for a null text), and ``lossless``: decoding gave the text back.

    Rows are encoded, decoded and sent on in slices of ``SLICE_CHARS``, so a task holds the ids of one slice.
    """
    added = T.StructType([T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("lossless", T.BooleanType())])
    kept = [c for c in docs.columns if c.lower() not in {f.name for f in added}]
    seeded = docs.select(*kept, F.xxhash64(F.col(key), F.lit(seed)))
    schema = T.StructType([*docs.select(*kept).schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, temperature)
        for batch in text_slices(batches, "text", SLICE_CHARS):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            ids = _ids(vocab, texts, batch.column(len(kept)).to_numpy())
            flat, edges = ids.values.to_numpy(), ids.offsets.to_numpy()
            spelled = [decoded(vocab, flat[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            same = pa.array([t is None or t == back for t, back in zip(texts, spelled, strict=True)])
            count = pa.array([0 if t is None else n for t, n in zip(texts, np.diff(edges).tolist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], ids, count, same], names=schema.names)

    return seeded.mapInArrow(run, schema)


def decode(ids: Column, path: str) -> Column:
    """The text of each array of piece ids; null for null."""

    @F.arrow_udf("string")
    def text(values: pa.Array) -> pa.Array:
        vocab, flat, edges = vocabulary(path), values.values.to_numpy(zero_copy_only=False), values.offsets.to_numpy()
        spelled = zip(edges[:-1], edges[1:], values.is_null().to_pylist(), strict=True)
        return pa.array([None if null else decoded(vocab, flat[a:b]) for a, b, null in spelled], pa.string())

    return text(ids)


def report(docs: DataFrame, path: str, temperature: float = 1.0, seed: int = SEED) -> DataFrame:
    """One row per input row: number of pieces, digest of their ids, and whether decoding gave the text back.

    The ids are digested as little-endian 32-bit numbers. Null texts count as empty here.
    """

    @F.arrow_udf("struct<n_pieces:long,ids_sha256:string,lossless:boolean>")
    def digest(values: pa.Array, keys: pa.Array) -> pa.Array:
        texts, seeds = [t or "" for t in values.to_pylist()], keys.to_numpy(zero_copy_only=False)
        vocab, n, sha, same = vocabulary(path, temperature), [], [], []
        for a, b in _slices(texts):
            flat, begins = sample(vocab, texts[a:b], seeds[a:b])
            for i, t in enumerate(texts[a:b]):
                own = flat[begins[i] : begins[i + 1]]
                n.append(len(own))
                sha.append(hashlib.sha256(own.astype("<i4").tobytes()).hexdigest())
                same.append(decoded(vocab, own) == t)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], names=["n_pieces", "ids_sha256", "lossless"])

    row = digest(F.col("text"), F.xxhash64(F.col("doc_id"), F.lit(seed)))
    return docs.select("doc_id", row.alias("r")).select("doc_id", "r.*")
