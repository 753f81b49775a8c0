import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trackline.llm import token_counts as T

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None,
    "",
    "   \n\t ",
    "The quick brown fox's 'lltest don't 123 4,5!! ...",
    "Thntblere of erenbleand, thonble <|endoftext|>x<|startoftext|><|endoftext |> <|ENDOFTEXT|>",
    "Ñandú ÉCOLE straße ŒUVRE İstanbul ΣΑΣ ǅ é 日本語テスト 😀😀 \x1f a\x85b c",
    "'s's 'S'T ''re'' \xa0 x\xa0y ½ ² ٣ ‍",
    "word " * 5000,
    "x" * 3000,
]


def test_counts_equal_the_library(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens long")
    tok = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in T.report(docs, PATH).collect()}
    for i, t in enumerate(TEXTS):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 2048), t


def test_whole_tokens_are_proved():
    model, tok = T.counter(PATH), Tokenizer.from_file(PATH)
    assert len(model.whole) > 20_000
    assert all(len(tok.encode(w, add_special_tokens=False).ids) == 1 for w in list(model.whole)[:500])


def test_documents_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tok = Tokenizer.from_file(PATH)
    got = {r.doc_id: r.n_tokens for r in T.report(docs, PATH).collect()}
    assert got == {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}


def test_empty_table(spark):
    assert T.report(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("bound", [0, 5])
def test_a_full_cache_changes_nothing(monkeypatch, bound):
    monkeypatch.setattr(T, "MAX_CACHED", bound)
    model = T.WholeTokens(PATH)
    assert model.count(TEXTS) == model.count(TEXTS)


def test_very_long_text_and_repeated_rows(spark):
    text = "The quick brown fox's 1234 jumps; " * 40_000
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, None, "y")], "doc_id long, text string, over_limit string")
    n = len(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids)
    assert len(text) > 1_000_000
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in T.report(docs, PATH).collect()) == [(1, len(text), n), (1, len(text), n), (2, 0, 0)]
