import hashlib
from collections import defaultdict

import duckdb
import numpy as np

from trackline.llm import line_dedup as D

WS, A = " \t\n\x0b\x0c\r", "this line is repeated and long enough"
TEXTS = {
    0: f"{A}\nshort\nonly here in this document", 1: f"\t {A.upper()} \r\nshort", 2: f"{A}\n{A}\n\n", 3: None, 4: "", 5: f"x\n{A}\n {A}",
    6: "ééééééééééééééééééé", 7: "ééééééééééééééééééé", 8: "ééééééééééééééééééé", 9: "ÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉ", 10: "éééééééééééééééééééé", 11: "éééééééééééééééééééé", 12: "ok\néééééééééééééééééééé\n",
    13: "in two documents, no more than two", 14: "in two documents, no more than two", 15: "\n".join([A, *["in one document many many times"] * 4]),
}


def key(line):
    k = line.strip(WS)
    return "".join(c.lower() if c.isascii() else c for c in k)


def plain(rows, cleaned=None):
    """The contract by dictionaries: what ``cleaned`` keep, with ``rows`` in the index."""
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None:
                holders[key(line)].add(i)
    out = []
    for i, t in rows if cleaned is None else cleaned:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def sha(rows):
    return sorted(map(str, [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in rows]))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "kept") for i, t in rows], "doc_id long, text string, n_lines string")


ROWS = [*TEXTS.items(), (2, TEXTS[2]), (None, f"{A}\nno id"), (None, "alone without an id, and long")]


def test_rows_equal_the_contract(spark):
    got = D.report(frame(spark, ROWS)).collect()
    assert sorted(str(tuple(r)) for r in got) == sha(plain(ROWS))
    assert max(r.n_dropped for r in got) == 2


def test_without_filters_in_the_tasks(spark, monkeypatch):
    monkeypatch.setattr(D, "FILTER_BYTES", 0)
    assert sorted(str(tuple(r)) for r in D.report(frame(spark, ROWS)).collect()) == sha(plain(ROWS))


def test_any_order_of_insertions_and_deletions(spark, monkeypatch):
    monkeypatch.setattr(D, "SHARD_KEYS", 2)
    first, second = ROWS[:9], ROWS[9:]
    index = D.insert(D.insert(D.empty(spark), frame(spark, first)), frame(spark, second))
    assert index.shards > 0 and sorted(map(str, map(tuple, D.report(frame(spark, ROWS), index).collect()))) == sha(plain(ROWS))
    gone = [r for r in ROWS if r[0] in (5, 15, 12)]
    left = [r for r in ROWS if r not in gone]
    less = D.delete(index, frame(spark, gone))
    assert sorted(map(str, map(tuple, D.report(frame(spark, ROWS), less).collect()))) == sha(plain(left, ROWS))
    back = D.insert(less, frame(spark, gone))
    assert sorted(map(str, map(tuple, D.report(frame(spark, ROWS), back).collect()))) == sha(plain(ROWS))
    assert sorted(map(str, map(tuple, D.report(frame(spark, ROWS), index).collect()))) == sha(plain(ROWS))  # older generations stay
    nothing = D.delete(D.delete(back, frame(spark, first)), frame(spark, second))
    assert D.repeated(spark, nothing).isEmpty() and {r["keys"] for r in D.filters(spark, nothing).collect()} <= {0}
    assert all(r.n_dropped == 0 for r in D.report(frame(spark, ROWS), nothing).collect())


def test_clean_keeps_columns(spark):
    docs = frame(spark, ROWS)
    out = D.clean(D.insert(D.empty(spark), docs), docs)
    assert out.columns == ["doc_id", "text", "n_lines", "n_lines_", "n_dropped"]
    assert sorted(str((r.doc_id, r.n_lines_, r.n_dropped, r.text)) for r in out.collect()) == sorted(map(str, plain(ROWS)))


def test_empty_table_and_long_text(spark):
    assert D.report(frame(spark, [])).count() == 0
    long = "\n".join(f"line number {i} of a very long text" for i in range(60_000))
    rows = [(i, long + f"\nown ending of document {i:05}") for i in range(3)]
    assert sorted(str(tuple(r)) for r in D.report(frame(spark, rows)).collect()) == sha(plain(rows))


def test_filter_never_misses_and_forgets():
    draw = np.random.default_rng(1)
    keys = draw.integers(-(2**63), 2**63 - 1, (4000, 2))
    f = D.Cuckoo.sized(len(keys))
    f.add(keys[:, 0], keys[:, 1])
    row = type("Row", (), {"shard": 0, "cells": f.packed().tobytes(), "stash": f.stash})
    assert D.Filters([row], 1).hit(keys).all()
    others = draw.integers(-(2**63), 2**63 - 1, (100_000, 2))
    assert D.Filters([row], 1).hit(others).mean() < 0.001
    f.remove(keys[:2000, 0], keys[:2000, 1])
    row = type("Row", (), {"shard": 0, "cells": f.packed().tobytes(), "stash": f.stash})
    assert D.Filters([row], 1).hit(keys[2000:]).all() and D.Filters([row], 1).hit(keys[:2000]).mean() < 0.01 and f.keys == 2000


def test_overfull_filter_uses_its_stash():
    f = D.Cuckoo(np.zeros(32, np.uint16))
    same = np.tile(np.array([[7 << 30, 5 << 50]]), (20, 1))
    f.add(same[:, 0], same[:, 1])
    assert len(f.stash) == 12
    f.remove(same[:19, 0], same[:19, 1])
    row = type("Row", (), {"shard": 0, "cells": f.packed().tobytes(), "stash": f.stash})
    assert D.Filters([row], 1).hit(same[:1]).all() and f.keys == 1


def test_sql_gives_the_same(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}'")
    df = D.report(spark.read.parquet(path))
    found = con.execute(D.ORACLE)
    assert [x[0] for x in found.description] == df.columns
    assert sorted(found.fetchall()) == sorted(map(tuple, df.collect()))
