import math
import re
from collections import Counter
from zlib import crc32

import public_tokenizers
import pytest

from trackline.llm import lm_score as M
from trackline.llm.lattice import vocabulary

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["The cat\tsat on\x0bthe mat", "the DOG sat", "", None, "Ünïcödé ÉT é\xa0b 日本▁x", "cat " * 40, "   ", "new words here", "the cat sat"]


def lattice(word):
    vocab = vocabulary(PATH)
    pieces = {vocab.bytes[i].decode(): vocab.log_p[i] for i in vocab.ids.tolist()}
    known = {chr(c) for c in vocab.single}
    text = " " + word
    p = [1.0] + [0.0] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(j):
            if text[i:j] in pieces and "▁" not in text[i:j]:
                p[j] += p[i] * math.exp(pieces[text[i:j]])
        c = text[j - 1]
        if c == "▁" or (c != " " and c not in known):
            p[j] += p[j - 1] * math.exp(sum(vocab.log_p[vocab.byte_id[b]] for b in c.encode()))
    return p[-1]


def brute(rows):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), ""] for _, t in rows]
    held = [crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    c = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    vocab = vocabulary(PATH)
    out = {}
    for (i, _), ws, h in zip(rows, tokens, held):
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        lat = [math.exp(vocab.log_end) if w == "" else lattice(w) for w in ws]
        score = sum(math.log10(max(c[w] - M.DISCOUNT, 0) / n + M.DISCOUNT * v / n * p if n else p) for w, p in zip(ws, lat))
        out[i] = (h, len(ws), sum(c[w] > 0 for w in ws), n, pytest.approx(base), pytest.approx(score))
    return out


@pytest.mark.parametrize("chunk", [1, 16_000_000])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(M, "CHUNK_BYTES", chunk)
    rows = list(enumerate(TEXTS * 3))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, word string")
    got = {r.doc_id: tuple(r)[1:] for r in M.score(docs, PATH).collect()}
    assert got == brute(rows)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(i, "the cat") for i in range(200) if crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    rows = M.score(docs, PATH).collect()
    assert rows and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score < 0 for r in rows)
    assert M.score(docs.limit(0), PATH).count() == 0


def test_words_of_a_vocabulary_sum_to_one_at_most():
    vocab = vocabulary(PATH)
    assert math.exp(vocab.log_end) + sum(math.exp(p) for p in vocab.log_p if p > -1e9) == pytest.approx(1.0)


def test_very_long_text_and_repeated_rows(spark):
    rows = [(0, "the cat sat " * 120_000), (0, "the cat sat " * 120_000), (2, "cat"), (6, "dog the")]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.held_out) for r in M.score(docs, PATH).collect())
    held = {i: crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    known = {w for i, t in rows if not held[i] for w in t.split()}
    assert got == sorted((i, len(t.split()) + 1, sum(w in known for w in t.split()) + 1, held[i]) for i, t in rows)
