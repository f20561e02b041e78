import os
import random

import pytest

from tillstar.llm import toxicity as X
from tillstar.llm.common import fold, table


def distance(a, b):
    """Edit distance with swaps of neighbours (each letter edited once)."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_as_edit_distance_to_every_term():
    rnd = random.Random(1)
    terms = ["abcab", "bacaccabac", "abab", "ccabb", "cabbacabbac", "aacb*"]
    a, errors = X.LexiconAutomaton(terms), X.tolerances(terms)
    assert errors == [1, 2, 0, 1, 2, 0]
    for _ in range(4000):
        base = rnd.choice(terms).rstrip("*")
        w = list(base)
        for _ in range(rnd.randrange(4)):
            k = rnd.randrange(len(w) + 1)
            w[k:k + rnd.randrange(2)] = rnd.choice(["", "a", "b", "c", "x"])
        if rnd.random() < 0.3 and len(w) > 2:
            k = rnd.randrange(len(w) - 1)
            w[k], w[k + 1] = w[k + 1], w[k]
        w = "".join(w)
        want = min((distance(w, t) for k, t in enumerate(terms) if not t.endswith("*") and distance(w, t) <= errors[k]), default=None)
        if w.startswith("aacb"):
            want = 0
        got = a.match(w)
        assert (got and got[1]) == want, w


def test_automaton_forgets_in_place(monkeypatch):
    rnd = random.Random(7)
    terms = ["abcab", "bacaccabac", "abab", "ccabb", "cabbacabbac", "aacb*"]
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 14))) for _ in range(3000)]
    whole = X.LexiconAutomaton(terms)
    want = [whole.match(w) for w in words]
    monkeypatch.setattr(X, "MAX_STATES", 9)
    small = X.LexiconAutomaton(terms)
    sets = small.sets
    for w, m in zip(words, want):
        assert small.match(w) == m and small.sets is sets and len(sets) <= 11


def test_whole_words_of_any_length_are_terms(spark):
    long = "".join("aeioubcd"[k * k % 8] for k in range(300))
    rows = [(long + "x", 1), (long + "y", 0), ("short " + long + "x", 1)]
    counts = {r.term: (r.t, r.c) for r in X._term_counts(spark.createDataFrame(rows, "text string, toxic int")).collect()}
    assert counts[X.forms(long + "x")[0] + " "] == (2, 0) and counts[X.forms(long + "y")[0] + " "] == (0, 1)


def corpus(spark):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(500):
        w = [f"w{rnd.randrange(300)}" for _ in range(40)]
        toxic = int(i % 4 == 0)
        if toxic:
            w[rnd.randrange(40)] = rnd.choice(["Blorgish!", "smurdle"])
        rows.append((i, " ".join(w), "s"))
        labels.append((i, toxic, 1))
    labels += [(None, 1, 1), (3, None, 1), (10**6, 1, 1)]
    return (spark.createDataFrame(rows, "doc_id long, text string, score string"),
            spark.createDataFrame(labels, "doc_id long, toxic int, text int"))


def test_misspelled_and_quoted_terms(spark):
    docs, labels = corpus(spark)
    model = X.train(docs, labels)
    assert sorted(model.terms) == ["blorgish", "smurdle"]
    texts = {1: "what a blorgihs fool", 2: "w1 s.m.u.r.d.l.e w2", 3: 'he said "smurdle" and left', 4: "w1 w2", 5: None, 6: "", 7: "blrgsh xx " + "w1 " * 30000}
    odd = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] * 2 + [(None, "smurdle", "x")], "doc_id long, text string, score string")
    got = X.score(odd, model).collect()
    assert len(got) == 15 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.doc_id: r.predicted for r in got} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, None: 1}
    assert X.score(odd.limit(0), model).count() == 0


def test_chance_as_the_binomial_tail_at_any_size():
    from fractions import Fraction
    from math import comb

    for t, c, rate in ((3, 0, 0.5), (9, 3, 0.11), (400, 1, 0.5), (401, 0, 0.5), (260, 240, 0.5), (700, 20, 0.6), (450, 300, 0.6), (50, 400, 0.11), (1200, 800, 0.6)):
        p, n = Fraction(rate), t + c
        want = float(sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(t, n + 1)))
        assert abs(X._chance(t, c, rate) - want) <= 1e-8 * want + 1e-300, (t, c, rate)
    assert X._chance(3, 2, 1.0) == 1.0 and X._chance(16000, 0, 0.5) == 0.0


def test_common_and_short_terms_of_balanced_labels(spark):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(2400):
        w = [f"w{rnd.randrange(300)}" for _ in range(20)]
        if toxic := i % 2:
            w[rnd.randrange(20)] = rnd.choice(["blorgish", "zug"])
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    model = X.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert sorted(model.terms) == ["blorgish", "zug"]
    odd = spark.createDataFrame([(1, "w1 zug w2"), (2, "w1 zugs w2"), (3, "w1 zu w2"), (4, "w1 blorgish")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in X.score(odd, model).collect()} == {1: 1, 2: 0, 3: 0, 4: 1}


def test_no_labels_and_held_out_rows_do_not_matter(spark):
    docs, labels = corpus(spark)
    model = X.train(docs, labels.limit(0))
    assert model.terms == [] and not any(r.predicted for r in X.score(docs, model).collect())
    turned = labels.where(fold("doc_id", X.FOLDS) != 0).unionByName(labels.where(fold("doc_id", X.FOLDS) == 0).selectExpr("doc_id", "1 - toxic as toxic", "text"))
    assert X.train(docs, labels) == X.train(docs, turned)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="driver test data not present")
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = X.query(spark, sf).where("held_out").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.97 * len(rows)
    assert sum(r.predicted for r in rows if r.toxic) >= 0.88 * sum(r.toxic for r in rows)
