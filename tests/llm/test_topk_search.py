import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from trackline.llm import topk_search as T

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, every=100, k=10):
    usable = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in usable:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    out = set()
    for q, qv in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in usable if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(T, "ROW_BLOCK", block)
    monkeypatch.setattr(T, "QUERY_BLOCK", 2)
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(6)]) for i in range(0, 420)]
    rows += [(500, None), (501, [None, 1.0]), (502, [float("nan")]), (503, [float("inf")]), (None, [1.0]), (600, [1.0]), (601, []), (7, rows[7][1]), (300, rows[1][1])]
    got = T.report(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)).collect()
    assert {tuple(r) for r in got} == brute(rows)


def test_empty_and_few(spark):
    assert T.report(spark.createDataFrame([], SCHEMA)).count() == 0
    got = T.report(spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 0)], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 1024 * 2048)]


def test_vectors_do_not_pass_the_driver(spark):
    x = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (F.xxhash64("id", i) % 1000 / 2000).cast("float"))
    vectors = spark.range(0, 24000, 1, 24).select(F.col("id").alias("vec_id"), x.alias("embedding"), F.lit(0).alias("score"))
    conf = spark.sparkContext._jsc.sc().conf()
    conf.set("spark.driver.maxResultSize", "3m")
    try:
        got = T.report(vectors)
        assert len(got.collect()) == 240 * 10
    finally:
        conf.remove("spark.driver.maxResultSize")
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("scale", [1, 2**10, 2**19])  # doubles do not hold the products of the last
def test_ties_and_large_components(spark, monkeypatch, scale):
    monkeypatch.setattr(T, "PART_BYTES", 1 << 10)
    monkeypatch.setattr(T, "CELL", 8)
    rng = random.Random(6)
    rows = [(i, [float(rng.choice([-scale, 0, scale]) + rng.randrange(2)) for _ in range(5)]) for i in range(300)] + [(i, [float(scale)] * 5) for i in range(300, 400)]
    got = T.report(spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, score int")).collect()
    assert {tuple(r) for r in got} == brute(rows)


def test_given_table_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    got = T.report(spark.read.parquet(f"{d}/embeddings.parquet")).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(T.ORACLE).fetchall())
