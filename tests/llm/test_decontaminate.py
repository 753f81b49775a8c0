import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from trackline.llm import decontaminate as D

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def edited(text, n):
    text = list(text)
    for _ in range(n):
        i = RNG.randrange(len(text))
        kind = RNG.random()
        if kind < 0.4:
            text[i] = RNG.choice("xyz")
        elif kind < 0.7:
            del text[i]
        else:
            text.insert(i, RNG.choice("xyz"))
    return "".join(text)


def sellers(pattern, text):
    """Least edits of the pattern against any piece of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def fold(text):
    return re.sub(r"[^\w]+|_", " ", text or "").lower().strip()


def test_equals_full_alignment(spark):
    rule = D.Rule()
    items = [(i, prose(n)) for i, n in enumerate([20, 25, 18, 60])] + [(90, None), (91, "short"), (92, "")]
    texts = [None, "", prose(200)]
    for i in range(4):
        t = items[i][1]
        for n in (0, 3, 8, 14, 25, 60):
            texts.append(prose(30) + ". " + edited(t, n).upper() + "! " + prose(15))
    texts += [items[0][1], prose(5) + " " + items[3][1][:260], items[1][1][: len(items[1][1]) // 2]]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in enumerate(texts):
        for item, text in items:
            b = fold(text)
            if len(b) < max(rule.q, rule.least):
                continue
            starts = [0] if len(b) <= rule.segment else [*range(0, len(b) - rule.segment, rule.stride), len(b) - rule.segment]
            for s in starts:
                seg = b[s : s + rule.segment]
                if sellers(seg, fold(t)) <= min(int(len(seg) * rule.edit_rate), (len(seg) - rule.q) // rule.q):
                    want.add((i, item))
    got = {(r.doc_id, r.item_id) for r in D.report(docs, bench).collect()}
    assert got == want and len(want) > 8
    kept = {r.doc_id for r in D.remove(docs, bench).collect()}
    assert kept == set(range(len(texts))) - {i for i, _ in want}
    assert D.remove(docs, bench).columns == docs.columns


def test_blocks_and_empty_tables(spark, monkeypatch):
    items = [(i, prose(20)) for i in range(6)]
    docs = spark.createDataFrame([(i, prose(9) + " " + t) for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "BLOCK_BYTES", 200)
    assert {(r.doc_id, r.item_id, r.edits) for r in D.report(docs, bench).collect()} == {(i, i, 0) for i, _ in items}
    assert D.report(docs, bench.limit(0)).count() == 0 and D.remove(docs, bench.limit(0)).count() == 6
    assert D.report(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("q", [1, 3, 8, 10, 13])
def test_gram_hashes(q):
    data = np.frombuffer(b"abcabcabcabcxyzxyz", np.uint8)
    hashes = D._grams(data, q)
    pieces = [bytes(data[i : i + q]) for i in range(len(data) - q + 1)]
    assert len(hashes) == len(pieces) and len(set(hashes.tolist())) == len(set(pieces))
    assert all((hashes[i] == hashes[j]) == (pieces[i] == pieces[j]) for i in range(len(pieces)) for j in range(len(pieces)))


def test_sliced_array_with_nulls():
    text = prose(20)
    block = D.Block([(1, text.encode())], D.Rule())
    values = pa.array(["x", None, "pad " + text, text])
    assert [len(m) for m in block.matches(values.slice(1))] == [0, 1, 1]


def test_every_excerpt_of_stated_length_is_found(spark):
    """An excerpt of segment + stride - 1 bytes holds a whole segment wherever it is cut."""
    rule, item = D.Rule(), fold(prose(120))
    size = rule.segment + rule.stride - 1
    docs = spark.createDataFrame([(i, "q" + item[i : i + size] + "q") for i in range(len(item) - size)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert D.report(docs, bench).count() == docs.count()


def test_very_long_text_and_repeated_rows(spark):
    item = prose(40)
    long = " ".join(prose(500) for _ in range(600)) + " " + item + " " + prose(500)
    docs = spark.createDataFrame([(1, long, "a"), (1, long, "a"), (2, None, "b")], "doc_id long, text string, edits string")
    bench = spark.createDataFrame([(1, item), (2, item)], "item_id long, text string")
    assert len(long) > 1_000_000
    assert sorted((r.doc_id, r.item_id, r.edits) for r in D.report(docs, bench).collect()) == [(1, 1, 0), (1, 1, 0), (1, 2, 0), (1, 2, 0)]
    assert D.remove(docs, bench).collect() == [(2, None, "b")]


def test_a_line_that_many_items_share():
    """Fifty items with one line in common against texts that hold it a hundred times."""
    line = "a line of forty eight bytes that many items share x"
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("bcdfghjk") for _ in range(rng.randint(3, 7))) for _ in range(n))
    block = D.Block([(i, f"{words(20)} {line} {words(20)}".encode()) for i in range(50)], D.Rule())
    texts = pa.array([" ".join(f"{words(3)} {line}" for _ in range(100)), "clean " + words(50)])
    start = time.time()
    assert block.matches(texts) == [[], []]
    assert time.time() - start < 20


def test_counting_and_aligning_in_pieces(monkeypatch):
    items = [(i, prose(30).encode()) for i in range(8)] + [(8, prose(30).encode())]
    items.append((9, items[0][1]))
    texts = pa.array([prose(20) + " " + edited(t.decode(), n) for _, t in items for n in (0, 5, 12)])
    whole = D.Block(items, D.Rule()).matches(texts)
    monkeypatch.setattr(D, "HITS", 50)
    monkeypatch.setattr(D, "REGIONS", 3)
    assert D.Block(items, D.Rule()).matches(texts) == whole and sum(map(len, whole)) > 15
    assert {m["item_id"] for m in whole[0]} == {0, 9}
