from itertools import combinations

import pytest
from pyspark.sql import functions as F

from trackline.llm import url_filter as U

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
URLS = [None, "", "no scheme/x", "http://A.Example.ORG/en/15", "https://example.org/es/x?y=1#z", "http://org", "http://org/", "ftp://x.com/fr/9.html", "http://x.com/de/", "http://xcom/de/", "http://a.b?q=://c/d", "x://h#frag/p", "http://éX.org/ñ/É", "://", "http://x.net\n/a\nb"]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        i = min([k for k in map(rest.find, "/?#") if k >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:i])
        tail = rest[i:]
        path = tail[: min([k for k in map(tail.find, "?#") if k >= 0], default=len(tail))]
    best = None
    for verdict, rule in RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, best and best[1], best[0] if best else "allow"


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "page_id long, url string, rule string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rules_equal_brute_force(spark):
    pages, labels = frames(spark, [(i, u, "") for i, u in enumerate(URLS * 2)], [])
    got = {r.page_id: tuple(r)[1:5] for r in U.judge(pages, labels, RULES).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS * 2)}


def test_mining_equals_brute_force(spark):
    rows = [(i, f"http://{'spam' if i % 3 == 0 else 'good'}.site{i % 2}.net/{'a' if i % 4 else 'b'}/{i}", "") for i in range(120)]
    labels = [(i, 0 if i % 3 == 0 and i % 5 else 1, 1 if i % 7 == 0 else None) for i in range(120)] + [(3, None, None), (500, 0, 0)]
    pages, labelled = frames(spark, rows, labels)
    how = U.Mining(min_support=0.05)
    got = {tuple(sorted(r["items"])): (r.support, r.confidence) for r in U.mine(pages, labelled, how).collect()}
    items = {r.page_id: r.t for r in pages.select("page_id", U.tokens_of(F.col("url")).alias("t")).collect()}
    bad = {i for i, q, t in labels if q == 0 or t == 1}
    want = {}
    every = sorted({t for ts in items.values() for t in ts})
    for n in range(1, how.max_length + 1):
        for combo in combinations(every, n):
            hold = [i for i, ts in items.items() if set(combo) <= set(ts)]
            support = sum(i in bad for i in hold)
            if support >= 6 and support / len(hold) >= how.min_confidence:
                want[combo] = (support, pytest.approx(support / len(hold)))
    assert got == want and want
    verdicts = {r.page_id: r for r in U.judge(pages, labelled, [], how).collect()}
    for i, ts in items.items():
        fit = [c for combo, (_, c) in want.items() if set(combo) <= set(ts)]
        assert (verdicts[i].verdict == "block") == bool(fit)


def test_empty_tables(spark):
    pages, labels = frames(spark, [], [])
    assert U.judge(pages, labels, RULES).count() == 0
    assert U.judge(pages, spark.createDataFrame([(1, 0, 1)], labels.schema), RULES).count() == 0
