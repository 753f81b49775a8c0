import random
from zlib import crc32

import pytest

from trackline.llm import toxicity as T

RNG = random.Random(8)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(3, 8))) for _ in range(600)]
TERMS = ["idiot", "worthless", "scum"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    rule = T.Rule()
    terms = [*TERMS, "idiots", "clown", "clowning"]
    automaton = T.Automaton(terms, rule.edits)
    probes = [*terms, "", "i", "idi0t", "xidiot", "idit", "dioti", "scam", "scum", "clownz", "clownig", "wortless", "worthlessss", "ïdiot"]
    for _ in range(3000):
        t = list(RNG.choice(terms))
        for _ in range(RNG.randint(0, 3)):
            i = RNG.randrange(len(t) + 1)
            t[i : i + RNG.randint(0, 1)] = RNG.choice(["", "x", "o", "i"])
        probes.append("".join(t))
    for p in probes:
        near = sorted((distance(p, t), t) for t in terms if distance(p, t) <= rule.edits(t))
        assert automaton.match(p) == (near[0][1] if near else None), p


def made(n):
    rows, labels = [], []
    for i in range(n):
        words = [RNG.choice(WORDS) for _ in range(RNG.randint(20, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                words.insert(RNG.randrange(len(words)), RNG.choice(TERMS))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_learns_and_separates(spark):
    rows, labels = made(600)
    extra = [(1000, "You are an " + "idi0t " + " ".join(WORDS[:9])), (1001, 'They wrote "idiot" ' + " ".join(WORDS[:9])), (1002, ""), (1003, None), (1004, "IDIOT!!! " + " ".join(WORDS[:9])), (1004, "IDIOT!!! " + " ".join(WORDS[:9]))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows + extra], "doc_id long, text string, score string")
    marked = spark.createDataFrame(labels + [(0, None, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in T.report(docs, marked).collect()}
    toxic = {i for i, _, t in labels if t}
    assert all(got[i].predicted == (i in toxic) for i, _ in rows)
    assert [got[i].predicted for i in (1000, 1001, 1002, 1003, 1004)] == [1, 0, 0, 0, 1]
    assert all(r.held_out == (crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())
    kept = T.remove(docs, docs, marked)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in T.report(docs, none).collect()] == [0.0, 0.0]
    assert T.report(docs.limit(0), none).count() == 0


@pytest.mark.parametrize(("text", "quoted"), [('a "idiot" b', True), ("he said idiot", True), ('token = "abc" idiot "x"', False), ("idiot", False), ('say: "you idiot there" ok', True), ('"x\nidiot\ny"', False)])
def test_context(text, quoted):
    model = T.Model(0.0, {"idiot": 0.99}, {}, {}, T.Rule())
    assert (model.score(text)[0] < 0.5) == quoted


def test_forgetting_changes_nothing(monkeypatch):
    rule = T.Rule()
    model = T.Model(0.01, {t: 0.99 for t in TERMS}, {}, {}, rule)
    texts = [" ".join(RNG.choice([*WORDS, "idi0t", "scum", "wortless"]) for _ in range(40)) for _ in range(60)]
    want = [model.score(t) for t in texts]
    monkeypatch.setattr(T, "MAX_CACHED", 5)
    monkeypatch.setattr(T, "MAX_STATES", 5)
    small = T.Model(0.01, {t: 0.99 for t in TERMS}, {}, {}, rule)
    assert [small.score(t) for t in texts] == want


def test_more_terms_than_the_old_limit(spark):
    """Every word that meets the thresholds is a term, however many there are."""
    terms = sorted({"".join(RNG.choice("klmnopqrstuvwxyz") for _ in range(RNG.randint(6, 11))) for _ in range(2400)})
    rows, labels = [], []
    for i in range(300):
        words = [RNG.choice(WORDS) for _ in range(40)] + (RNG.sample(terms, 300) if i % 2 else [])
        RNG.shuffle(words)
        rows.append((3 * i, " ".join(words)))
        labels.append((3 * i, 1, i % 2))
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = T.train(docs, marked)
    assert len(set(terms) & set(model.terms)) > 2000


def test_rows_equal_brute_force(spark):
    """The query's rows against the definition with plain edit distances over the learned model."""
    rows, labels = made(240)
    rows += [(900, None), (901, ""), (902, " ".join(WORDS[:50] * 4000) + " idiot"), (903, 'he said "idi0t" ok')]
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model, rule = T.train(docs, marked), T.Rule()
    seen: dict[str, float] = {}

    def chance(word):
        if word not in seen:
            p = model.terms.get(word) or model.forms.get(word)
            if p is None:
                near = sorted((distance(word, t), t) for t in model.terms if abs(len(t) - len(word)) <= 1 and distance(word, t) <= rule.edits(t))
                p = model.terms[near[0][1]] * model.sure.get(near[0][1], rule.misspelled) if near else 0.0
            seen[word] = p if p >= rule.min_chance else 0.0
        return seen[word]

    def score(text):
        text, best, before = (text or "").lower(), {}, []
        for m in T.WORD.finditer(text):
            if chance(m[0]):
                p = chance(m[0]) * (rule.quoted if model.quotes(text, m.start(), m.end(), before) else 1)
                best[m[0]] = max(best.get(m[0], 0), p)
            before = [*before[-3:], m[0]]
        clean = 1 - model.base
        for p in best.values():
            clean *= 1 - p
        return 1 - clean

    got = {r.doc_id: (r.score, r.predicted) for r in T.report(docs, marked).collect()}
    for i, text in rows:
        want = score(text)
        assert got[i][0] == pytest.approx(want) and got[i][1] == int(want >= 0.7)
