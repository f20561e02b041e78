import os
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tillstar.llm import simhash_links as S


def plain_fingerprint(text):
    """Bit by bit, as defined."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))]
    values = [xxhash.xxh64(r, seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute(rows, distance=4):
    """(doc_id, fingerprint, component_id), sorted, by comparing all fingerprints."""
    fps = [plain_fingerprint(t) for _, t in rows]
    names = np.array(sorted(set(fps)), dtype=np.uint64)
    label = {int(x): int(x) for x in names}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for x in names:
        for y in names[np.bitwise_count(names ^ x) <= distance]:
            a, b = top(int(x)), top(int(y))
            label[max(a, b)] = min(a, b)
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[top(f)] = min(least.get(top(f), i), i)
    return sorted((str(i), f"{f:016x}", str(least.get(top(f)))) for (i, _), f in zip(rows, fps))


def got(df):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in df.collect())


def near_texts(rnd, groups=60, members=6):
    vocabulary = [f"w{k}" for k in range(900)]
    rows, i = [], 100
    for _ in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(150, 500))]
        for _ in range(rnd.randrange(1, members)):
            w = list(base)
            for _ in range(rnd.randrange(6)):
                w[rnd.randrange(len(w))] = f"n{rnd.randrange(10**6)}"
            rows.append((i, rnd.choice([" ", "\n", "\t "]).join(w)))
            i += 1
    return rows


@pytest.mark.parametrize("bucket", [2048, 8])
def test_components_as_all_pairs(spark, bucket):
    rnd = random.Random(5)
    rows = near_texts(rnd) + [(1, None), (2, ""), (None, " \n"), (4, "One TWO"), (5, "one two"), (5, "one two"), (6, "a b c d"), (7, "Ä b"),
                              (8, "ä b"), (None, "alone with no id at all here"), (9, "long " * 100_000)]
    big = [f"w{rnd.randrange(900)}" for _ in range(400)]
    for k in range(80):  # one large group of near copies
        w = list(big)
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = f"x{k}"
        rows.append((2000 + k, " ".join(w)))
    df = spark.createDataFrame([(*r, "x", 1, "z") for r in rows], "doc_id long, text string, fp string, key int, node string")
    assert got(S.simhash_components(df, bucket=bucket)) == brute(rows)


def test_other_names_and_empty_table(spark):
    df = spark.createDataFrame([("a", "x y"), ("b", "X y")], "name string, body string")
    out = S.simhash_components(df, "name", "body")
    assert [r.component_id for r in out.collect()] == ["a", "a"]
    assert S.simhash_components(df.limit(0), "name", "body").count() == 0


def test_hash_is_that_of_the_sql_function(spark):
    texts = ["one two", "ünï cödé", "x" * 100, "a b c d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h"))
    assert all(r.h & S.ALL_BITS == S.fingerprint(r.t.encode()) for r in df.collect())


def test_some_segment_differs_by_one_bit_at_most():
    rnd = random.Random(2)
    for distance in (1, 2, 3, 4, 5, 7):
        wild = S.wildcards(distance)
        assert sorted(b for b, _ in wild) == list(range(64))
        for _ in range(200):
            x, y = rnd.getrandbits(64), 0
            for b in rnd.sample(range(64), distance):
                y |= 1 << b
            y ^= x
            assert any(x & m == y & m for _, m in wild)


def test_connecting_links_as_all_links():
    rnd = random.Random(9)
    for _ in range(60):
        centres = [rnd.getrandbits(64) for _ in range(4)]
        rows = sorted((rnd.randrange(5), rnd.choice(centres) ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(6)))) for _ in range(60))
        keys, fps = np.array([k for k, _ in rows]), np.array([f for _, f in rows], dtype=np.uint64)

        def parts(pairs):
            label = {f: f for _, f in rows}

            def top(x):
                while label[x] != x:
                    x = label[x]
                return x

            for a, b in pairs:
                a, b = top(a), top(b)
                label[max(a, b)] = min(a, b)
            return {f: top(f) for f in label}

        links = [(a, b) for k, a in rows for m, b in rows if k == m and (a ^ b).bit_count() <= 4]
        u, v = S.connecting_links(keys, fps, 4)
        assert all((int(a) ^ int(b)).bit_count() <= 4 for a, b in zip(u, v))
        assert parts(zip(u.tolist(), v.tolist())) == parts(links)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver test data not present")
def test_query_as_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in S.table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert got(S.query(spark, sf)) == brute(rows)
