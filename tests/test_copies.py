from datetime import datetime, timedelta

from pyspark.sql import functions as F

from trackline.functions import text as T
from trackline.operators import copies as C
from trackline.operators.components import connected

T0 = datetime(2026, 9, 1, 12)
X = "first long enough message about a quiet river that runs past the old mill and the two bridges of the town"
Y = "second message has nothing in common: seven painters carry their ladders uphill while it rains on Monday noon"


def rows(*items):
    return [(i, s, p, t, T0 + timedelta(minutes=m), f) for i, (s, p, t, m, f) in enumerate(items)]


def pairs(spark, data):
    df = spark.createDataFrame(data, "raw_message_id long, source string, post_key int, text string, published_at timestamp_ntz, forward_of string")
    prints = C.fingerprints(df.select("raw_message_id", "source", "text", "published_at"))
    found = C.verified(prints, C.candidates(prints))
    return C.with_primary(C.with_posts(found, df.select("raw_message_id", "post_key", "forward_of")), ["copy_source", "copy_post"])


BASE = [("A", 1, X, 0, None), ("B", 2, "🚀 " + X.upper(), 5, None), ("B", 3, X + " and then a long remark of our own was added behind it", 40, None), ("A", 4, Y, 10, None), ("B", 5, X, 60, "A"), ("B", 3, X + " and then a long remark of our own was added behind it!", 41, None)]


def test_end_to_end(spark):
    got = {r.copy_post: r for r in pairs(spark, rows(*BASE)).collect()}
    assert set(got) == {2, 3, 5} and all(r.is_primary and r.original_post == 1 and r.copy_source == "B" for r in got.values())
    assert got[2].kind == C.VERBATIM and got[2].delay_s == 300
    assert got[3].containment > 0.85 and got[3].jaccard < 0.9 and got[3].copy == 5
    assert got[5].kind == C.FORWARD


def test_late_original_takes_over(spark):
    got = pairs(spark, rows(*BASE, ("A", 0, X, -20, None))).collect()
    assert len(got) == 6 and {(r.original_post, r.is_primary) for r in got} == {(0, True), (1, False)}


def test_report_and_order_of_rows(spark):
    data = rows(*BASE)
    one = C.pair_report(pairs(spark, data)).collect()
    assert [tuple(r)[:6] for r in one] == [("B", "A", 3, 3, 1, 1)]
    assert C.pair_report(pairs(spark, data[::-1])).collect() == one


def test_text_functions(spark):
    df = spark.createDataFrame([("Ёжик https://x.y @me #tag\nПідпис на канал\nЦе, ТЕКСТ!",), (None,)], "t string")
    assert [r.c for r in df.select(T.canonical(F.col("t")).alias("c")).collect()] == ["ёжик це текст", ""]
    one = spark.range(1)
    lit = lambda v: F.lit(v)
    assert one.select(T.shingles(lit("abcab")).alias("x")).first().x == ["abca", "bcab"]
    assert one.select(T.shingles(lit("ab")).alias("x")).first().x == ["ab"] and one.select(T.shingles(lit("")).alias("x")).first().x == []
    assert one.select(T.fnv1a(F.array(lit("a"))).alias("x")).first().x[0] & 0xFFFFFFFFFFFFFFFF == 0x089BE207B544F1E4
    assert one.select(T.segments(lit("Курс 3.5 км. Далі! ще")).alias("x")).first().x == ["Курс 3.5 км", "Далі", "ще"]
    checks = [("сум", "сумщині", False, True), ("сум", "сумуватимемо", False, False), ("х-101", "х-101", True, True), ("х-101", "х-101ми", True, True), ("міг", "мігрень", True, False)]
    df = spark.createDataFrame(checks, "s string, t string, e boolean, w boolean")
    assert all(r.got == r.w for r in df.withColumn("got", T.stem_match(F.col("s"), F.col("t"), F.col("e"))).collect())


def test_minhash_recall(spark):
    words = [f"word{i}" for i in range(60)]
    data = [(i, f"s{i % 2}", " ".join(words[: 55 + i % 3] + [f"x{i}"]), T0) for i in range(40)]
    prints = C.fingerprints(spark.createDataFrame(data, "raw_message_id long, source string, text string, published_at timestamp_ntz"))
    assert C.verified(prints, C.candidates(prints)).count() >= 0.95 * 400


def test_connected(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 70)]
    got = {r.node: r.comp for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 70: 50, 100: 50}


def test_cap_keeps_the_nearest_and_says_what_it_left(spark):
    prints = spark.createDataFrame([(i, T0 + timedelta(minutes=m), b) for i, m, b in [(1, 0, [1, 2, 3]), (2, 5, [1]), (3, 8, [1, 2]), (9, 10, [1, 2, 3])]], "raw_message_id int, published_at timestamp_ntz, bands array<int>")
    pairs = spark.createDataFrame([(9, 1), (9, 2), (9, 3)], "copy int, original int")
    kept = lambda *a: {(r.original, r.shared, r.left_out) for r in C.capped(prints, pairs, *a).collect()}
    assert kept() == {(1, 3, 0), (2, 1, 0), (3, 2, 0)}
    assert kept(2, 1) == {(3, 2, 2)} and kept(3, 2) == {(1, 3, 1), (3, 2, 1)}


def test_components_of_chains_and_stars(spark):
    import random

    draw = random.Random(3)
    names = draw.sample(range(10**9), 700)
    edges = [(names[i], names[i + 1]) for i in range(400)] + [(names[500], names[i]) for i in range(501, 560)] + [(names[600], names[600])] + [(names[601], names[602])] * 2
    got = {r.node: r.comp for r in connected(spark.createDataFrame(edges, "a long, b long"), 12).collect()}
    want = {n: min(group) for group in (names[:401], names[500:560], names[600:601], names[601:603]) for n in group}
    assert got == want
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pairs_are_counted_in_blocks_of_texts(spark, monkeypatch):
    """Copies in many small blocks and across windows, against sets; shingles are not shipped with the pairs."""
    words = X.split()
    texts = [" ".join(words[: 12 + i % 9] + [f"tail{i % 4}"] * (i % 3)) for i in range(60)]
    data = [(i, f"s{i % 7}", t, T0 + timedelta(minutes=23 * i)) for i, t in enumerate(texts)]
    messages = spark.createDataFrame(data, "raw_message_id long, source string, text string, published_at timestamp_ntz")
    prints = C.fingerprints(messages)
    assert "shingles" not in prints.columns and "canonical" in prints.columns
    pairs = C.candidates(prints)
    sets = {r.raw_message_id: {r.canonical[i : i + 4] for i in range(len(r.canonical) - 3)} for r in prints.collect()}
    likely = C._likely(prints, pairs, C.Rule())
    want = sorted((r.copy, r.original, len(sets[r.copy] & sets[r.original])) for r in likely.collect())
    assert len(want) > 50
    for most in (1000, 3):
        monkeypatch.setattr(C, "BLOCK_TEXTS", most)
        assert sorted(map(tuple, C._with_shared(prints, likely, C.Rule()).collect())) == want
    plan = C.verified(prints, pairs)._jdf.queryExecution().toString()
    assert "array_intersect" not in plan
