import hashlib
import re

import duckdb
import pytest

from trackline.llm import fill_middle as M

SP = r"[\x20\x09-\x0D]"
TEXTS = [None, "", " ", "\n\t", "one", " two words ", "a b c d e f g", "ends\r\n", "no <P> here", "half <P and S> <M", "<", "P> x <S", "Ünï cödé 😀  x\xa0y 日本 語", "x" * 5000, "w \x0b" * 3000]


def plain(text, key):
    """The contract, said with strings."""
    text = text or ""
    units = re.findall(f"{SP}*[^\\x20\\x09-\\x0D]+|{SP}+", text)
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n, sha = len(units), lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return n, form, len(p), len(m), sha(out), sha(text)


def rows(spark):
    made = [(i * len(TEXTS) + j, t, "kept") for i in range(12) for j, t in enumerate(TEXTS)]
    return [*made, made[6], made[6], (None, "no id here at all", "kept"), (None, None, None)]


def test_rows_equal_the_contract(spark):
    docs = spark.createDataFrame(rows(spark), "doc_id long, text string, form string")
    got = sorted(map(str, (tuple(r) for r in M.report(docs).collect())))
    assert got == sorted(str((k, *plain(t, k))) for k, t, _ in rows(spark))
    forms = {r.form for r in M.report(docs).collect()}
    assert forms == {"plain", "spm", "psm"}


def test_outputs_restore_and_columns_stay(spark):
    docs = spark.createDataFrame(rows(spark), "doc_id long, text string, form string")
    out = M.arranged(docs)
    assert out.columns == ["doc_id", "text", "form", "form_", "pieces", "prefix_chars", "middle_chars"]
    back = M.restored(out, form="form_").select("doc_id", "text", "form").collect()
    assert sorted(map(str, map(tuple, back))) == sorted(str((k, t or "", f)) for k, t, f in rows(spark))
    made = [r for r in out.collect() if r.form_ != "plain"]
    assert made and all(len(r.pieces) == 6 and sum(p.length for p in r.pieces if p.buffer == M.MARK) == 9 for r in made)


def test_long_text_and_empty_table(spark):
    text = "".join(f"wörd{i} " for i in range(300_000))
    docs = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")
    assert [tuple(r)[1:] for r in M.report(docs).orderBy("doc_id").collect()] == [plain(text, i) for i in range(3)]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert M.report(none).count() == 0 and M.restored(M.arranged(none)).count() == 0


@pytest.mark.parametrize("order", M.ORDER.values())
def test_cuts_and_permutations(order):
    table = M.PieceTable.of(b"abcdef").cut(0, 2, 2, 5, 6)
    assert [n for *_, n in table.pieces] == [0, 2, 0, 3, 1, 0]
    assert table.permuted(order).permuted(M.inverse(order)).content() == b"abcdef"
    assert table.permuted(order).sha256() == hashlib.sha256(table.permuted(order).content()).hexdigest()


def test_sql_gives_the_same(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}'")
    df = M.report(spark.read.parquet(path))
    found = con.execute(M.ORACLE)
    assert [x[0] for x in found.description] == df.columns
    assert sorted(found.fetchall()) == sorted(map(tuple, df.collect()))
