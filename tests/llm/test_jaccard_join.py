import os
import random
from collections import defaultdict

import pytest

from tillstar.llm import jaccard_join as J


def words(t):
    return (t or "").encode().split()


def grams(t):
    w = words(t)
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Sorted (doc_id, class_id, n_links) by comparing all pairs that share a word run."""
    sets = [grams(t) for _, t in rows]
    where = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            where[g].append(k)
    links, root = defaultdict(set), list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for o in where[g]:
                shared[o] += 1
        for o, n in shared.items():
            if o != k and 5 * n >= 4 * (len(s) + len(sets[o]) - n):
                links[k].add(o)
                a, b = top(k), top(o)
                root[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted((str(i), str(least.get(top(k), i)), len(links[k])) for k, (i, _) in enumerate(rows))


def got(df):
    return sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in df.collect())


def fixture(n=40):
    rnd = random.Random(3)
    vocabulary = [f"w{k}" for k in range(800)]
    rows = [(None, "one two"), (1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "a"), (6, "a"), (6, "a")]
    i = 10
    for g in range(n):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(20, 150))]
        for _ in range(rnd.choice([1, 1, 2, 3, 8])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 4])):
                w[rnd.randrange(len(w))] = "new" + str(rnd.randrange(10**6))
            rows.append((i, rnd.choice([" ", "  ", "\n"]).join(w)))
            i += 1
    big = [rnd.choice(vocabulary) for _ in range(120)]
    for k in range(60):  # one large group of near copies
        w = list(big)
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = f"x{k}"
        rows.append((i + k, " ".join(w)))
    rows.append((9999, "long " * 50000))
    return rows


@pytest.mark.parametrize("block", [256, 7])
def test_links_and_groups_as_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK_CLASSES", block)
    rows = fixture()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, links int")
    assert got(J.jaccard_groups(df)) == brute(rows)
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    want = {c for _, c, _ in brute(rows)}
    ids = [str(r.doc_id) for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_groups(df).count() == 0 and J.keep_one(df).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    for n, fewest in J.FEWEST:
        assert J.fewest_matches(n) == fewest < 0.7 * n


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver test data not present")
def test_query_as_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in J.table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert got(J.query(spark, sf)) == brute(rows)


def test_keep_one_keeps_columns_of_any_name(spark):
    names = ["__key", "__kept", "key", "kept", "words", "row", "doc_id", "body"]
    rows = [(*[10 * k + i for i in range(6)], k, t) for k, t in enumerate(["one two three", "one two three", None, "other words"])]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` {'string' if n == 'body' else 'long'}" for n in names))
    out = J.keep_one(df, "doc_id", "body")
    assert out.columns == names and sorted(map(tuple, out.collect())) == sorted([rows[0], rows[2], rows[3]])
