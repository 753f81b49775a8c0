"""The rejection limit of the language model stands on every training row."""

import math
import random

from trackline.llm import language_id as L


def test_limit_counts_every_row(spark):
    rng = random.Random(2)
    rows = [(lang, rng.gauss(m, 0.3)) for lang, m, n in (("a", 2.0, 5000), ("b", 3.0, 40)) for _ in range(n)]
    got = {r.lang: r.limit for r in L.limits(spark.createDataFrame(rows, "lang string, entropy double")).collect()}
    for lang in "ab":
        own = sorted(e for x, e in rows if x == lang)
        exact = own[math.ceil(0.995 * len(own)) - 1]
        assert exact < got[lang] <= exact + L.CALIBRATION_STEP


def test_rows_beyond_any_sample_move_the_limit(spark):
    """1500 plain texts, and 60 odd ones of which a sample may hold any number; one in 200 of all rows at most is rejected."""
    rng = random.Random(4)
    plain = "the water of the river runs to the sea and the wind over the land".split()
    texts = [" ".join(rng.choice(plain) for _ in range(12)) for _ in range(1500)] + ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(60)) for _ in range(60)]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    model = L.train(docs)
    over = sum(r[3] for r in model.judge([t.lower() for t in texts]))
    assert over <= len(texts) / 200


def test_report_judges_each_text_once(spark, monkeypatch):
    """As many judgements as rows, and the verdicts of the model that the training rows alone give, limits included."""
    rng = random.Random(6)
    words = {"en": "the water of the river runs to the sea".split(), "de": "das wasser des flusses fließt in das meer".split()}
    rows = [(i, rng.choice(["en", "de"])) for i in range(600)]
    rows = [(i, lang, "".join(rng.choice("bcdfghjk") for _ in range(40)) if i % 150 == 0 else " ".join(rng.choice(words[lang]) for _ in range(9))) for i, lang in rows]
    rows += [(1000, "en", None), (1001, None, "the sea"), (1002, "de", "12 !"), (1003, None, "zzzz qqqq xxxx")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = L.train(docs.filter(L.fold(L.F.col("doc_id"), 4) != 2))
    want = {i: v for (i, _, _), v in zip(rows, model.judge([t.lower() if t and any(c.isalpha() for c in t) else "" for _, _, t in rows]), strict=True)}
    seen, real = spark.sparkContext.accumulator(0), L.predictor

    def counting(session, model):
        def tick(text):
            seen.add(1)
            return text

        judged, passed_on = real(session, model), L.F.udf(tick, "string")
        return lambda text: judged(passed_on(text))

    monkeypatch.setattr(L, "predictor", counting)
    got = {r.doc_id: (r.lang_pred, r.score, r.entropy, r.rejected) for r in L.report(docs).collect()}
    assert got == want and 0 < sum(v[3] for i, v in got.items() if i < 1000) < 20
    assert seen.value == len(rows)
