import itertools
import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trackline.llm import piece_sampling as P
from trackline.llm.lattice import Lattice, Units, vocabulary

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "the", "Thblest of  the   onthat,\nNew line\t tab ", "ñandú éèê 日本 😀 ▁literal ▁", "x" * 300, "a" + " " * 40 + "b", "\x00\x01 <s> </s> <0x41>", "und " * 50]


def segmentations(vocab, text):
    """All segmentations of a text of known characters into pieces, with their log-probabilities."""
    pieces = {vocab.bytes[i].decode(): i for i in vocab.ids.tolist()}
    text = " " + text
    out = [[] for _ in range(len(text) + 1)]
    out[0] = [((), 0.0)]
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - vocab.longest), j):
            if text[i:j] in pieces:
                k = pieces[text[i:j]]
                out[j] += [((*s, k), p + vocab.log_p[k]) for s, p in out[i]]
    return out[-1]


def test_forward_equals_enumeration():
    vocab = vocabulary(PATH)
    for text in ("then", "a", "tion the", "of it"):
        flat, begins = vocab.codes([text])
        units = Units(vocab, flat, begins)
        got = Lattice(vocab, units.codes, units.offset).log_total()[units.kind].sum()
        want = math.log(sum(math.exp(p) for _, p in segmentations(vocab, text)))
        assert got == pytest.approx(want)


def test_draws_follow_the_distribution():
    vocab = vocabulary(PATH)
    n = 20_000
    flat, begins = P.sample(vocab, ["then"] * n, np.arange(n))
    seen = Counter(tuple(flat[a:b].tolist()) for a, b in itertools.pairwise(begins))
    all_ = segmentations(vocab, "then")
    total = sum(math.exp(p) for _, p in all_)
    for s, p in all_:
        share = math.exp(p) / total
        assert abs(seen[s] / n - share) < 5 * math.sqrt(share / n) + 1e-3


def test_round_trip_and_batches():
    vocab = vocabulary(PATH)
    keys = np.arange(len(TEXTS)) * 7 - 3
    flat, begins = P.sample(vocab, TEXTS, keys)
    parts = [flat[a:b] for a, b in itertools.pairwise(begins)]
    assert [P.decoded(vocab, p) for p in parts] == TEXTS
    for t, k, p in zip(TEXTS, keys, parts, strict=True):  # alone or with others: the same pieces
        own, _ = P.sample(vocab, [t], np.array([k]))
        assert own.tolist() == p.tolist()
    other, _ = P.sample(vocab, [TEXTS[-1]], np.array([99]))
    assert other.tolist() != parts[-1].tolist()


def test_columns(spark, monkeypatch):
    rows = [(i, t, 1) for i, t in enumerate([*TEXTS, None])] + [(2, "the", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_pieces int")
    got = docs.withColumn("ids", P.encode(F.col("text"), F.col("doc_id"), PATH)).withColumn("back", P.decode(F.col("ids"), PATH)).collect()
    assert all(r.back == r.text and (r.ids is None) == (r.text is None) for r in got)
    assert [r.ids for r in got if r.doc_id == 2][0] == got[-1].ids
    report = P.report(docs, PATH).collect()
    assert all(r.lossless for r in report) and len(report) == len(rows)
    monkeypatch.setattr(P, "SLICE_CHARS", 10)
    assert P.report(docs.limit(0), PATH).count() == 0
    again = {(r.doc_id, r.ids_sha256) for r in P.report(docs.repartition(3), PATH).collect()}
    assert again == {(r.doc_id, r.ids_sha256) for r in report}


def test_pieces_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(P, "SLICE_CHARS", 50)
    rows = [(i, t, i, "x") for i, t in enumerate([*TEXTS, None, TEXTS[3]])] + [(2, "the", 5, None), (99, "ab c" * 300_000, 1, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_pieces int, lang string")
    got = P.pieces(docs, PATH)
    assert got.columns == ["doc_id", "text", "lang", "piece_ids", "n_pieces", "lossless"]
    out = got.collect()
    assert len(out) == len(rows) and all(r.lossless for r in out)
    by_id = {r.doc_id: r for r in out}
    assert by_id[len(TEXTS)].piece_ids is None and by_id[len(TEXTS)].n_pieces == 0
    vocab = vocabulary(PATH)
    for r in out:
        if r.text is not None:
            assert r.n_pieces == len(r.piece_ids) and P.decoded(vocab, np.array(r.piece_ids)) == r.text
    want = {(r.doc_id, tuple(r.ids)) for r in docs.filter("text is not null").select("doc_id", P.encode(F.col("text"), F.col("doc_id"), PATH).alias("ids")).collect()}
    assert {(r.doc_id, tuple(r.piece_ids)) for r in out if r.text is not None} == want
    assert P.pieces(docs.limit(0), PATH).count() == 0


def test_report_of_a_very_long_text_and_repeated_rows(spark):
    text = "the blest of the onthat, ñandú 日本 " * 40_000
    docs = spark.createDataFrame([(1, text, 7), (1, text, 7), (2, None, 8)], "doc_id long, text string, n_pieces int")
    rows = P.report(docs, PATH).orderBy("doc_id").collect()
    assert len(text) > 1_000_000 and rows[0] == rows[1] and rows[0].lossless and rows[0].n_pieces > 100_000
    assert (rows[2].n_pieces, rows[2].lossless) == (1, True)
