import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from trackline.llm import spelling as S


def plain_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain(words):
    out, forms = [], {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best and words[best] >= 10 * n else None
        out.append((w, n, len(near)))
    def root(w):
        return root(forms[w]) if forms[w] else w
    return sorted((w, forms[w] or "", root(w), n, k, words[forms[w]] if forms[w] else 0) for w, n, k in out)


def got(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def made(seed, alphabet, n):
    draw, words = random.Random(seed), []
    for _ in range(n):
        word = list("".join(draw.choice(alphabet) for _ in range(draw.randint(7, 12))))
        words.append("".join(word))
        for _ in range(draw.randint(0, 4)):
            other, k = word[:], draw.randrange(len(word))
            other[k : k + draw.randint(0, 1)] = draw.choice(["", *alphabet])
            words.append("".join(other))
    return {w: draw.choice([2, 3, 20, 30, 200, 2000, 20000]) for w in words if len(w) >= 7}


@pytest.mark.parametrize("most", [0, 3, 10_000])
@pytest.mark.parametrize("alphabet", ["ab", "abcdeé÷ÿ"])
def test_groups_equal_all_pairs(spark, alphabet, most):
    words = made(7, alphabet, 150)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(S.group(df, most=most)) == plain(words)


def test_chain_of_forms_and_ties(spark):
    words = {"abcdefg": 2, "abcdefh": 20, "abcdefhi": 200, "abcdefhij": 2000, "abcdefhijk": 20_000, "abcdefhijkl": 10**17, "zbcdefg": 2, "zbcdefx": 20, "zbcdefa": 20}
    rows = got(S.group(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert rows == plain(words)
    assert {r[2] for r in rows[:6]} == {"abcdefhijkl"} and dict((r[0], r[1]) for r in rows)["zbcdefg"] == "zbcdefa"


def test_whole_texts(spark):
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choice(["running", "Runnning", "RÉSUMÉES", "résumées", "x÷×ÿþabc", "short", "abcdefgh", "abcdefg"]) for _ in range(80)) + "\nüberall_überall") for i in range(40)]
    rows += [(None, "nothing nothing"), (None, None), (1, ""), (2, "running " * 200_000), rows[0], rows[0], (3, "İstanbul İSTANBUL"), (4, "a" * 1_500_000), (4, "a" * 1_500_000)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, word int")
    words = plain_words(rows)
    assert {r.word: r.n for r in S.word_counts(docs).collect()} == words
    assert got(S.report(docs.filter("length(text) < 1000000 or text is null"))) == plain(plain_words([r for r in rows if len(r[1] or "") < 1_000_000]))


def test_flushes_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.word: r.n for r in S.word_counts(docs).collect()}
    monkeypatch.setattr(S, "COUNTED", 10)
    assert {r.word: r.n for r in S.word_counts(docs).collect()} == want == plain_words([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark):
    assert S.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sql_gives_the_same(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}'")
    df = S.report(spark.read.parquet(path))
    found = con.execute(S.ORACLE)
    assert [x[0] for x in found.description] == df.columns
    assert sorted(map(str, found.fetchall())) == sorted(map(str, map(tuple, df.collect())))
