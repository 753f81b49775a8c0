"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A text is its word 5-grams (shorter texts: all their words) over lower-cased letters and digits, each weighted by one
plus the whole part of log2 of its count. Similarity is the probability Jaccard of the normalised weights; on texts
whose grams do not repeat it is the plain Jaccard. Each gram's arrivals are a Poisson process of its weight's rate over
the signature's registers; grams drop out once their next arrival is later than every register's best, so the work per
text stays near its number of grams. Two texts agree on a register with the probability Jaccard's probability.

Exact copies meet first, by a digest of the folded text, and only one of each goes on. Bands of registers make buckets.
In each bucket every text meets the bucket's head; texts of small buckets also meet each other. Candidate pairs whose
signatures agree too rarely go (four standard errors below the similarity); every other one is verified on its weighted
grams, in 61-bit names, and only verified pairs are links. Classes are the connected components of the links. In large
buckets the texts that are not in the head's class meet a new head among themselves. Heads only join the bulk of a large
bucket cheaply: at last all texts of a large bucket that are still in different classes meet, in blocks of bounded size,
so no pair of a bucket stays open. That is quadratic in the texts of a bucket outside its largest class, on signatures
alone. Tests hold the classes against all pairs.

Null texts and texts without words are alone in their class. Rows with the same id form one document: its class is that
of any of its texts (the least id joins them). A class is named by the least id in it. Texts are taken whole, however
long; an empty table gives an empty result; columns besides ``doc_id`` and ``text`` are not read, so their names cannot
clash, and :func:`keep_one` returns them as they were.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from trackline.llm.common import free_name, mix64, stored, text_slices, unit


@dataclass(frozen=True)
class Rule:
    gram: int = 5
    similarity: float = 0.8
    bands: int = 21
    rows: int = 6
    slack: float = 0.14  # by which a signature may fall short of the similarity: four standard errors
    small: int = 12  # texts of a bucket that all meet each other
    rounds: int = 2  # in which the texts of large buckets meet heads, before the rest meet each other
    block: int = 2000  # texts of a large bucket in one block
    block_grams: int = 1_000_000  # and their grams
    part: int = 20_000  # pairs that are verified in one piece
    few: int = 1_000_000  # ids that are sent to every task; more are joined by a shuffle

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def folded(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{Nd}]+", " ")))


class WordHashes(dict):
    """64-bit hashes of words, kept until there are too many."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) > 150_000:
            self.clear()
        self[word] = value
        return value


def _grams(texts: list[str], size: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All grams of all texts as 64-bit names, the text of each, and where each text's begin."""
    words = [t.encode().split() for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((hashes[w] for ws in words for w in ws), np.uint64, int(lengths.sum()))
    begin = np.r_[0, np.cumsum(lengths)]
    n_grams = np.where(lengths == 0, 0, np.maximum(lengths - size + 1, 1))
    out_begin = np.r_[0, np.cumsum(n_grams)]
    text = np.repeat(np.arange(len(texts)), n_grams)
    at = np.arange(out_begin[-1]) - out_begin[text] + begin[text]
    gram = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            inside = at + k < begin[text + 1]
            word = np.where(inside, flat[np.minimum(at + k, max(len(flat) - 1, 0))], np.uint64(0)) if len(flat) else gram
            gram = (gram ^ word) * np.uint64(0x9E3779B97F4A7C15)
            gram ^= gram >> np.uint64(32)
    return gram, text, out_begin


def _weights(count: np.ndarray) -> np.ndarray:
    """The bit length of each count, eight at most."""
    return np.minimum(np.frexp(count.astype(np.float64))[1], 8).astype(np.uint64)


def weighted_grams(texts: list[str], size: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct grams, text by text in rising order, packed as 29 bits of hash and 3 bits of weight - 1.

    Also where each text's grams begin. Only signatures use these short names.
    """
    gram, text, _ = _grams(texts, size, hashes)
    key = (text.astype(np.uint64) << np.uint64(32)) | (gram >> np.uint64(35) << np.uint64(3))
    key, count = np.unique(key, return_counts=True)
    edges = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    return ((key & np.uint64(0xFFFFFFFF)) | (_weights(count) - np.uint64(1))).astype(np.uint32), edges


def wide_grams(texts: list[str], size: int, hashes: WordHashes) -> Iterator[np.ndarray]:
    """Each text's distinct grams in rising order, packed as 61 bits of hash and 3 bits of weight - 1."""
    gram, _, edges = _grams(texts, size, hashes)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        name, count = np.unique(gram[a:b] >> np.uint64(3), return_counts=True)
        yield (name << np.uint64(3)) | (_weights(count) - np.uint64(1))


def signatures(grams: np.ndarray, edges: np.ndarray, registers: int) -> np.ndarray:
    """Each text's registers: 32-bit names of the grams whose arrivals came first.

    Round i takes the i-th arrival of every gram still in play: after an exponential wait of the gram's rate, at a random
    register. A gram leaves when its arrival is later than its text's latest register.
    """
    n = len(edges) - 1
    text = np.repeat(np.arange(n), np.diff(edges))
    name = grams >> np.uint32(3)
    rate = (grams & np.uint32(7)).astype(np.float64) + 1.0
    best = np.full((n, registers), np.inf)
    owner = np.zeros((n, registers), np.uint32)
    state = mix64(name.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    time = np.zeros(len(grams))
    alive = np.arange(len(grams))
    while len(alive):
        with np.errstate(over="ignore"):
            state = mix64(state + np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log(unit(state)) / rate[alive]
        spot = text[alive] * registers + (mix64(state) % np.uint64(registers)).astype(np.int64)
        order = np.lexsort((time, spot))
        first = order[np.r_[True, spot[order][1:] != spot[order][:-1]]]
        better = first[time[first] < best.flat[spot[first]]]
        best.flat[spot[better]] = time[better]
        owner.flat[spot[better]] = name[alive[better]]
        stay = time < best.max(1)[text[alive]]
        alive, state, time = alive[stay], state[stay], time[stay]
    return owner


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Probability Jaccard of two texts' packed grams."""
    three, seven = a.dtype.type(3), a.dtype.type(7)
    if len(a) == 0 or len(b) == 0:
        return 0.0
    na, nb, wa, wb = a >> three, b >> three, (a & seven) + 1.0, (b & seven) + 1.0
    at = np.searchsorted(nb, na).clip(max=len(nb) - 1)
    ia = np.flatnonzero(nb[at] == na)
    pa_, pb = wa[ia], wb[at[ia]]
    order = np.argsort(pb / pa_, kind="stable")
    # For a shared gram of ratio r: sum over all of max(a'/a, b'/b) = (A over ratios <= r)/a + (B over ratios > r)/b.
    low = np.cumsum(pa_[order]) + (wa.sum() - pa_.sum())
    high = wb.sum() - np.cumsum(pb[order])
    return float((1.0 / (low / pa_[order] + high / pb[order])).sum())


SKETCH = "doc_id long, digest binary, sig binary, bands array<long>, size int"
MET = "key long, block_i long, block_j long, part int, a array<long>, b array<long>, comp_a array<long>, comp_b array<long>"


def _folded_docs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), folded(F.col("text")).alias("text"))


def _digest(text: str) -> bytes | None:
    return hashlib.blake2b(text.encode(), digest_size=16).digest() if text else None


def sketches(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``doc_id, digest, sig, bands, size`` of each row: the text's digest (null without words), its registers cut to a
    byte each, the keys of its bands, and its number of distinct grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in text_slices(batches, max_bytes=750_000):
            texts = batch.column(1).to_pylist()
            grams, edges = weighted_grams(texts, rule.gram, hashes)
            sig = signatures(grams, edges, rule.registers)
            band = np.zeros((len(texts), rule.bands), np.uint64)
            parts = sig.reshape(len(texts), rule.bands, rule.rows)
            with np.errstate(over="ignore"):
                for r in range(rule.rows):
                    band = mix64(band * np.uint64(31) + parts[:, :, r] + np.arange(rule.bands, dtype=np.uint64) * np.uint64(0xD6E8FEB8))
            keys = pa.array(band.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([_digest(t) for t in texts], pa.binary()),
                    pa.array([s.tobytes() for s in sig.astype(np.uint8)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * rule.bands), keys),
                    pa.array(np.diff(edges).astype(np.int32)),
                ],
                names=["doc_id", "digest", "sig", "bands", "size"],
            )

    return _folded_docs(docs).mapInArrow(run, SKETCH)


def _packed(docs: DataFrame, rule: Rule) -> DataFrame:
    """``node, grams`` of each row of (node, text), for verification."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in text_slices(batches, max_bytes=750_000):
            grams = [g.tobytes() for g in wide_grams(batch.column(1).to_pylist(), rule.gram, hashes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.binary())], names=["node", "grams"])

    return docs.mapInArrow(run, "node long, grams binary")


@F.arrow_udf(DoubleType())
def agreement(a: pa.Array, b: pa.Array) -> pa.Array:
    """Share of equal registers of two columns of signatures of equal length."""
    if len(a) == 0:
        return pa.array([], pa.float64())
    x, y = (np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(len(v), -1) for v in (a, b))
    return pa.array((x == y).mean(1))


@F.arrow_udf(DoubleType())
def exact(a: pa.Array, b: pa.Array) -> pa.Array:
    """Probability Jaccard of two columns of packed grams."""
    return pa.array([similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """``node, comp`` of every node on an edge (a, b): the least node it is connected with.

    Alternates large-star and small-star steps: neighbours are tied to the least one, so paths shrink by half or more
    in each round. Every round is written down, and a round that changes nothing is the last; if ``rounds`` do not get
    there, it is an error, never a partial result.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    state = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        near = both(state)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = near.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        state = stored(small, "edges")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components are not stable after {rounds} rounds")
    return state.groupBy("a").agg(F.min("b").alias("comp")).withColumnRenamed("a", "node").unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _heads(buckets: DataFrame) -> DataFrame:
    """Per bucket its head, number of texts, and least and greatest class. The head is the first by a hash of bucket and
    text, so a large class shows another of its texts in every bucket."""
    order = F.struct(F.xxhash64("key", "node").alias("h"), "node", "comp")
    return buckets.groupBy("key").agg(F.min(order).alias("head"), F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))


def _pairs(buckets: DataFrame, small: int) -> DataFrame:
    """Candidates (a, b) of ``key, node, comp``: each node with its bucket's head, and all of a small bucket, across classes."""
    live = buckets.join(_heads(buckets).filter("lo <> hi"), "key")
    star = live.filter(F.col("comp") != F.col("head.comp")).select(F.col("node").alias("a"), F.col("head.node").alias("b"))
    few = live.filter((F.col("n") > 2) & (F.col("n") <= small)).groupBy("key").agg(F.collect_list(F.struct("node", "comp")).alias("m"))
    first = few.select("m", F.explode("m").alias("x"))
    mutual = first.select("x", F.explode(F.filter("m", lambda y: (y["node"] < F.col("x.node")) & (y["comp"] != F.col("x.comp")))).alias("y"))
    return star.unionByName(mutual.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))).distinct()


def _with(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Pairs (a, b, ...) with ``name`` of both nodes as name_a and name_b."""
    for end in ("a", "b"):
        pairs = pairs.join(values.select(F.col("node").alias(end), F.col(name).alias(f"{name}_{end}")), end)
    return pairs


def _classes_of(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """``nodes`` with ``comp``: their class so far, the node itself where it has no link."""
    return nodes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _dealt(buckets: DataFrame, rule: Rule) -> DataFrame:
    """``key, node, comp, block`` of ``key, node, comp, size``: blocks of about ``rule.block`` texts or ``rule.block_grams`` grams.

    A class too large for one block is dealt by node into blocks of its own, the others by class into common ones.
    """
    sizes = buckets.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("grams"))
    blocks = lambda n, grams: F.greatest(F.lit(1), F.ceil(n / rule.block), F.ceil(grams / rule.block_grams))
    sizes = sizes.withColumn("own", blocks(F.col("n"), F.col("grams")))
    common = sizes.filter("own = 1").groupBy("key").agg(blocks(F.sum("n"), F.sum("grams")).alias("m"))
    alone = F.col("own") > 1
    block = F.when(alone, F.xxhash64("comp", F.pmod(F.xxhash64("node"), "own"))).otherwise(F.pmod(F.xxhash64("comp"), "m"))
    return buckets.join(sizes.select("key", "comp", "own"), ["key", "comp"]).join(common, "key", "left").select("key", "node", "comp", block.alias("block"))


def _met(buckets: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """All pairs across classes in the large buckets of ``key, node, comp`` whose signatures agree enough, many to a row.

    A bucket's texts are dealt into blocks, and every two blocks meet unless both are of one class. Of the buckets that
    two texts share, the first one has the pair. A row holds at most ``rule.part`` pairs, the likeliest first.
    """
    large = _heads(buckets).filter((F.col("n") > rule.small) & (F.col("lo") != F.col("hi"))).select("key")
    known = nodes.select("node", "sig", "bands", "size")
    dealt = stored(_dealt(buckets.join(large, "key").join(known.select("node", "size"), "node"), rule), "dealt")
    blocks = dealt.groupBy("key", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    i, j = (blocks.select("key", *[F.col(c).alias(f"{c}_{end}") for c in ("block", "lo", "hi")]) for end in "ij")
    meet = i.join(j, "key").filter("block_i <= block_j and not (lo_i = hi_i and lo_j = hi_j and lo_i = lo_j)")
    sides = meet.select("key", "block_i", "block_j", F.explode(F.array_distinct(F.array("block_i", "block_j"))).alias("block"))
    groups = dealt.join(known.drop("size"), "node").join(sides, ["key", "block"]).groupBy("key", "block_i", "block_j")

    def run(group: pa.Table) -> pa.Table:
        node, comp, block = (group[c].to_numpy() for c in ("node", "comp", "block"))
        key, first, second = (group[c][0].as_py() for c in ("key", "block_i", "block_j"))
        sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint8).reshape(len(node), -1)
        bands = group["bands"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        here = int(np.flatnonzero(bands[0] == key)[0])
        one, other = np.flatnonzero(block == first), np.flatnonzero(block == second)
        least, found = int(np.ceil((rule.similarity - rule.slack) * sig.shape[1])), []
        theirs = np.ascontiguousarray(sig[other].T)
        for at in range(0, len(one), 256):
            rows = one[at : at + 256]
            equal = np.zeros((len(rows), len(other)), np.uint16)
            for r in range(sig.shape[1]):
                equal += sig[rows, r][:, None] == theirs[r]
            open_ = (equal >= least) & (comp[rows][:, None] != comp[other])
            if first == second:
                open_ &= node[rows][:, None] > node[other]
            x, y = np.nonzero(open_)
            p, q = rows[x], other[y]
            mine = np.flatnonzero((bands[p] == bands[q]).argmax(1) == here)
            found.append((p[mine], q[mine], equal[x[mine], y[mine]]))
        p, q, share = (np.concatenate(v) for v in zip(*found, strict=True))
        out: list[list] = [[] for _ in range(8)]
        for at in range(0, len(p), rule.part):
            order = at + np.argsort(-share[at : at + rule.part].astype(np.int64), kind="stable")
            values = (key, first, second, at // rule.part, node[p[order]], node[q[order]], comp[p[order]], comp[q[order]])
            for column, value in zip(out, values, strict=True):
                column.append(value)
        kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.list_(pa.int64())] * 4
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["key", "block_i", "block_j", "part", "a", "b", "comp_a", "comp_b"])

    return groups.applyInArrow(run, MET)


class Joined(dict):
    """Classes by number, joined as links are found."""

    def root(self, x: int) -> int:
        while (above := self.get(x, x)) != x:
            self[x] = x = self.get(above, above)
        return x


def _links_met(met: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The links (a, b) among the pairs of :func:`_met`: similar by their grams, and not joined by an earlier link of the row."""
    met = stored(met.withColumn("met", F.xxhash64("key", "block_i", "block_j", "part")), "met")
    asked = met.select(F.col("met").alias("of"), F.explode(F.array_distinct(F.concat("a", "b"))).alias("node"))
    needed = stored(asked.select("node").distinct(), "asked")
    grams = stored(_distinct_grams(docs, needed, rule), "grams")

    def run(key, pairs: pa.Table, texts: pa.Table) -> pa.Table:
        own: dict[int, list[np.ndarray]] = {}
        for node, packed in zip(texts["node"].to_pylist(), texts["grams"].to_pylist(), strict=True):
            own.setdefault(node, []).append(np.frombuffer(packed, np.uint64))
        joined, links = Joined(), []
        for row in pairs.select(["a", "b", "comp_a", "comp_b"]).to_pylist():
            for a, b, x, y in zip(row["a"], row["b"], row["comp_a"], row["comp_b"], strict=True):
                x, y = joined.root(x), joined.root(y)
                if x != y and any(similarity(s, t) >= rule.similarity for s in own[a] for t in own[b]):
                    joined[x] = y
                    links.append((a, b))
        return pa.table([pa.array([v[k] for v in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    texts = asked.join(grams, "node").select("of", "node", "grams")
    return met.groupBy("met").cogroup(texts.groupBy("of")).applyInArrow(run, "a long, b long")


def _texts_of(docs: DataFrame, asked: DataFrame, rule: Rule) -> DataFrame:
    """``node, text`` of the asked nodes. Few ids (a checked number) go to the documents, else both are shuffled."""
    few = asked.count() <= rule.few
    return _folded_docs(docs).withColumnRenamed("doc_id", "node").join(F.broadcast(asked) if few else asked.hint("merge"), "node")


def _distinct_grams(docs: DataFrame, asked: DataFrame, rule: Rule) -> DataFrame:
    """``node, grams`` of the asked nodes, a row for each different text of a node."""
    grams = _packed(_texts_of(docs, asked, rule), rule)
    return grams.groupBy("node", F.xxhash64("grams").alias("h")).agg(F.first("grams").alias("grams")).drop("h")


def _proved(open_: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """Those of the pairs (a, b) of which some texts are similar by their weighted grams."""
    asked = stored(open_.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "asked")
    grams = stored(_distinct_grams(docs, asked, rule), "grams")
    return stored(_with(open_, grams, "grams").filter(exact("grams_a", "grams_b") >= rule.similarity).select("a", "b").distinct(), "proved")


def links(docs: DataFrame, nodes: DataFrame, own: DataFrame, rule: Rule) -> DataFrame:
    """``node, comp`` of the nodes with a link. ``nodes`` has node, sig, bands; ``own`` edges known beforehand."""
    buckets = nodes.select("node", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    buckets = stored(buckets.join(shared, "key"), "buckets")
    edges, comps = own, components(own) if not own.isEmpty() else own.selectExpr("a as node", "b as comp")
    every = buckets

    def judged(scored: DataFrame) -> None:
        """Verify the pairs (a, b) whose classes differ and join those that are similar."""
        nonlocal edges, comps
        open_ = _with(scored.select("a", "b"), _classes_of(scored.select(F.explode(F.array("a", "b")).alias("node")).distinct(), comps), "comp")
        open_ = stored(open_.filter("comp_a <> comp_b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "open")
        if not open_.isEmpty():
            proved = _proved(open_, docs, rule)
            if not proved.isEmpty():
                edges = edges.unionByName(proved)
                comps = components(edges)

    for step in range(1, rule.rounds + 1):
        scored = _with(_pairs(_classes_of(buckets, comps), rule.small), nodes.select("node", "sig"), "sig").select("a", "b", agreement("sig_a", "sig_b").alias("share"))
        scored = stored(scored.filter(F.col("share") >= rule.similarity - rule.slack), "scored")
        # The likelier pairs first: what they join need not be verified again.
        for tier in (F.col("share") >= rule.similarity, F.col("share") < rule.similarity):
            judged(scored.filter(tier))
        if step == rule.rounds:
            break
        met = _classes_of(buckets, comps)
        heads = _heads(met).filter((F.col("n") > rule.small) & (F.col("lo") != F.col("hi")))
        buckets = stored(met.join(heads, "key").filter(F.col("comp") != F.col("head.comp")).select("node", "key"), "buckets")
        if buckets.isEmpty():
            break
    last = stored(_links_met(_met(_classes_of(every, comps), nodes, rule), docs, rule), "links")
    return comps if last.isEmpty() else components(edges.unionByName(last))


def classes(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``doc_id, class_id`` of every input row."""
    sketched = stored(sketches(docs, rule), "sketches")
    usable = F.col("digest").isNotNull() & F.col("doc_id").isNotNull()
    first = sketched.filter(usable).groupBy("digest").agg(F.min(F.struct("doc_id", "sig", "bands", "size")).alias("x"))
    nodes = stored(first.select(F.col("x.doc_id").alias("node"), "digest", "x.sig", "x.bands", "x.size"), "nodes")
    texts = sketched.filter(F.col("digest").isNotNull()).select("doc_id", "digest").join(nodes.select("digest", "node"), "digest", "left")
    members = texts.select("doc_id", F.coalesce("node", "doc_id").alias("node")).unionByName(sketched.filter(F.col("digest").isNull()).select("doc_id", F.col("doc_id").alias("node")))
    members = stored(members, "members")
    same_id = members.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("a")).filter("a <> b")
    own = members.join(same_id.select("doc_id", "b"), "doc_id").select(F.col("node").alias("a"), "b").filter("a <> b").distinct()
    comps = links(docs, nodes, stored(own, "own"), rule)
    return _classes_of(members, comps).select("doc_id", F.col("comp").alias("class_id"))


def keep_one(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs``, all columns, that name their class; of rows with one id, one. Rows without an id stay."""
    times = free_name(docs, "times")
    kept = classes(docs, rule).filter("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias(times))
    rows = docs.join(kept, "doc_id")
    once, more = rows.filter(F.col(times) == 1), rows.filter(F.col(times) > 1).dropDuplicates(["doc_id"])
    return once.unionByName(more).select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))
