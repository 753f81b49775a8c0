import random
from collections import Counter

import numpy as np
import pytest

from trackline.llm import near_dedup as N

RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 8))) for _ in range(3000)]


def prose(n):
    return [RNG.choice(WORDS) for _ in range(n)]


def changed(words, n):
    words = list(words)
    for _ in range(n):
        words[RNG.randrange(len(words))] = RNG.choice(WORDS)
    return words


def weights(text):
    words = text.lower().split()
    grams = [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    return {g: min(8, c.bit_length()) for g, c in Counter(grams).items()}


def jaccard(a, b):
    return sum(1 / sum(max(a.get(x, 0) / a[d], b.get(x, 0) / b[d]) for x in a.keys() | b.keys()) for d in a.keys() & b.keys())


def brute(rows):
    """Classes from all pairs."""
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    w = [(i, weights(t or "")) for i, t in rows]
    for k, (i, a) in enumerate(w):
        for j, b in w[:k]:
            if a and b and i != j and jaccard(a, b) >= 0.8:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i, _ in rows}


def test_similarity_equals_the_definition():
    hashes = N.WordHashes()
    for _ in range(20):
        base = prose(30)
        a, b = " ".join(base * RNG.randint(1, 4)), " ".join(changed(base, 2) * RNG.randint(1, 3) + prose(5))
        grams, edges = N.weighted_grams([a, b], 5, hashes)
        got = N.similarity(grams[: edges[1]], grams[edges[1] :])
        assert got == pytest.approx(jaccard(weights(a), weights(b)), abs=1e-9)


def test_registers_estimate_the_similarity():
    hashes, errors = N.WordHashes(), []
    for _ in range(30):
        base = prose(150)
        a, b = " ".join(base + base[:40]), " ".join(changed(base, 6))
        grams, edges = N.weighted_grams([a, b, a], 5, hashes)
        sig = N.signatures(grams, edges, 126)
        assert (sig[0] == sig[2]).all()
        errors.append((sig[0] == sig[1]).mean() - jaccard(weights(a), weights(b)))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1


def test_signature_is_that_of_the_text_alone():
    hashes = N.WordHashes()
    texts = ["", "one", " ".join(prose(4)), " ".join(prose(400)), " ".join(prose(60) * 20)]
    grams, edges = N.weighted_grams(texts, 5, hashes)
    together = N.signatures(grams, edges, 126)
    for t, s in zip(texts, together, strict=True):
        assert (N.signatures(*N.weighted_grams([t], 5, hashes), 126)[0] == s).all()


def test_classes_equal_brute_force(spark):
    rows = []
    for g in range(12):
        base = prose(RNG.choice([4, 30, 120]))
        rows += [" ".join(base)] * RNG.randint(1, 3)
        rows += [" ".join(changed(base, RNG.choice([0, 1, 1, 2, 8]))) for _ in range(RNG.randint(0, 4))]
    shared = prose(60)
    rows += [" ".join(shared + prose(40)) for _ in range(30)]  # a passage that many share
    rows += [" ".join(changed(shared * 2, 1)) for _ in range(40)]  # a large class
    rows += [None, "", "  ", "!!!", "one", "ONE!", "word " * 500]
    RNG.shuffle(rows)
    rows = [(i * 3 + 1, t) for i, t in enumerate(rows)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, class_id int")
    got = {r.doc_id: r.class_id for r in N.classes(docs).collect()}
    want = brute([(i, "".join(c if c.isalnum() else " " for c in t) if t else t) for i, t in rows])
    assert got == want
    kept = sorted(r.doc_id for r in N.keep_one(docs).collect())
    assert kept == sorted(set(want.values()))


def test_edges_of_input(spark):
    schema = "doc_id long, text string"
    assert N.classes(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "x y z"), (2, "a b c d e f g"), (None, "x y z"), (None, None), (7, "alone")], schema)
    got = sorted((r.doc_id or 0, r.class_id or 0) for r in N.classes(docs).collect())
    assert got == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1), (2, 1), (7, 7)]
    kept = [r.doc_id for r in N.keep_one(docs).collect()]
    assert sorted(kept, key=str) == [1, 7, None, None]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (50, 50), (400, 500), (500, 400)]
    got = {r.node: r.comp for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100, 400: 400, 500: 400}


def test_refined_buckets(spark, monkeypatch):
    base = prose(80)
    rows = [(i, " ".join(base[: 50 + i % 3] + prose(20 if i % 2 else 2))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in N.classes(docs, N.Rule(small=3)).collect()}
    assert got == brute(rows)


def test_star_of_copies_is_one_class(spark):
    """Copies that are like the original, not like each other: no copy may leave the search before it met it."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    rows = [" ".join(words)]
    for k in range(200):
        copy = list(words)
        for j in range(7):
            copy[10 + j * 68 + rng.randrange(60)] = f"x{k}e{j}"
        rows.append(" ".join(copy))
    assert all(jaccard(weights(rows[0]), weights(t)) >= 0.86 for t in rows[1:5])
    assert jaccard(weights(rows[1]), weights(rows[2])) < 0.8
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.class_id for r in N.classes(docs).collect()} == {0}


def test_blocks_meet_all_of_a_bucket(spark):
    """Chains of edits and several families in shared buckets, with blocks smaller than the buckets."""
    rows, base = [], [f"w{i}" for i in range(200)]
    for family in range(3):
        text = list(base)
        for k in range(14):
            text[(k * 37 + family * 11) % 200] = f"f{family}k{k}"
            rows.append(" ".join(text))
    rows = list(enumerate(rows))
    random.Random(6).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in N.classes(docs, N.Rule(small=3, rounds=1, block=7)).collect()}
    assert got == brute(sorted(rows))
