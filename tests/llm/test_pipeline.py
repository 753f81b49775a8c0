import re

from pyspark.sql import functions as F

import corpus_pipeline
from trackline.llm import near_dedup, secret_scan

D = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = corpus_pipeline.run(spark, D)
    rows = out.collect()
    before = {r.doc_id: r.text for r in docs.collect()}
    assert 0 < len(rows) < len(before) and len({r.doc_id for r in rows}) == len(rows)
    assert out.columns[: len(docs.columns)] == docs.columns and all(r.lossless for r in rows)
    bench = [" ".join(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    for r in rows:
        folded = " ".join(re.findall(r"\w+", before[r.doc_id].lower()))
        assert not any(b in folded for b in bench)
        assert not re.search(r"[0-9a-f]{24}", r.text)
        assert r.text == before[r.doc_id] or "[SECRET]" in r.text
    kept = spark.createDataFrame([(r.doc_id, before[r.doc_id]) for r in rows], "doc_id long, text string")
    assert near_dedup.classes(kept).filter("doc_id <> class_id").count() == 0
    assert secret_scan.report(out.select("doc_id", "text")).filter("spans <> ''").count() == 0


def test_clean_documents_stay(spark):
    docs = spark.createDataFrame([(i, f"clean text number {i} about " + " ".join(f"w{i}x{k}" for k in range(30)), "en", "s", 0) for i in range(8)], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("near-duplicates", "decontamination", "secrets"):
        kept = stages[name](spark, docs, D)
        assert kept.columns == docs.columns and sorted(kept.collect()) == sorted(docs.collect())
    assert stages["toxicity"](spark, docs, D).filter(F.col("doc_id").isNotNull()).count() == 8


def test_edges_of_every_stage(spark):
    """Nulls, empty and very long texts, repeated rows, missing ids, clashing column names; then an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, times string, found_spans int, matched string, __n int"
    long = " ".join(f"w{k}" for k in range(200_000))
    rows = [(1, None), (2, ""), (3, "one short text of some words"), (3, "one short text of some words"), (None, "no id here"), (4, long), (5, "token=abcdef123 é😀")]
    docs = spark.createDataFrame([(i, t, None, "s", None, "t", 1, "m", 2) for i, t in rows], schema)
    assert len(long) > 1_000_000
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D)
        got = out.collect()
        last = name == corpus_pipeline.STAGES[-1][0]
        assert out.columns[: len(docs.columns)] == docs.columns and (last or out.columns == docs.columns)
        assert len(got) == len(rows) - (name == "near-duplicates")
        assert all(r.times == "t" and r.found_spans == 1 and r.matched == "m" and r["__n"] == 2 for r in got)
        assert all(r.text == dict(rows)[r.doc_id] for r in got if r.doc_id != 5 or name != "secrets")
        assert not last or all(r.lossless for r in got)
        assert stage(spark, docs.limit(0), D).count() == 0
