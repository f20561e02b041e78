import hashlib
import os
import random
import time
import zlib

import pytest

from tillstar.llm import periodic_runs as P


def brute(words, min_length=12):
    """Every stretch of every period, extended as far as it goes."""
    n, out = len(words), []
    smallest = {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            # a stretch with a shorter period p lies in one of period p
            if length >= max(min_length, 2 * q) and not any(s <= start and start + length <= e for s, e in smallest.get(q, [])):
                out.append((start, length, q))
                for multiple in range(2 * q, n + 1, q):
                    smallest.setdefault(multiple, []).append((start, start + length))
            i = j
    return sorted((s, n, q) for s, n, q in out)


def dropped(words, runs):
    gone = set()
    for s, n, q in runs:
        gone.update(range(s + q, s + n))
    return [w for i, w in enumerate(words) if i not in gone]


def samples():
    rnd = random.Random(11)
    for _ in range(1500):
        letters = "ab"[:rnd.choice([1, 2, 2, 2])] + rnd.choice(["", "c", "cdefg"])
        w = [rnd.choice(letters) for _ in range(rnd.randrange(0, 70))]
        if rnd.random() < 0.6 and w:  # repeated blocks, some with a change, nested at times
            for _ in range(rnd.randrange(1, 4)):
                at, size = rnd.randrange(len(w)), rnd.randrange(1, 9)
                w[at:at] = w[at:at + size] * rnd.randrange(1, 6)
            if rnd.random() < 0.4:
                w[rnd.randrange(len(w))] = "z"
        yield w[:300]


@pytest.mark.parametrize("min_length", [12, 2, 7, 16])
def test_runs_as_all_stretches(min_length):
    for w in samples():
        assert P.periodic_runs(w, min_length) == brute(w, min_length), w


def test_collapsed_words():
    for w in samples():
        runs = brute(w)
        assert P.collapsed(w, runs) == dropped(w, runs)


def test_very_long_texts_in_about_linear_time():
    rnd = random.Random(4)
    paragraph = [f"w{rnd.randrange(300)}" for _ in range(400)]
    nested = ["a"] * 20 + ["b"]
    cases = [(["long"] * 300_000, 1), (paragraph * 500, 1), (nested * 5_000, 5_001), ([f"w{rnd.randrange(5000)}" for _ in range(300_000)], 0)]
    for words, n in cases:
        start = time.time()
        runs = P.periodic_runs(words)
        assert len(runs) == n and time.time() - start < 60


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words) if n < 1500 else P.periodic_runs(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = [hashlib.sha256(b).hexdigest() for b in ("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode(), b" ".join(dropped(words, runs)))]
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), *sha)


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_odd_rows(spark, tmp_path):
    rnd = random.Random(6)
    texts = [None, "", " \n\t", "one", "a a", "x " * 40, "ä ö " * 30, "A a " * 20, "one\x1ctwo \x0bthree"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "u v " * 12), (7, "A a " * 20)]
    rows += [(i, " ".join(rnd.choice("abcdef") for _ in range(rnd.randrange(1, 60)))) for i in range(100, 160)]
    df = spark.createDataFrame([(*r, 5, "x", [1]) for r in rows], "doc_id long, text string, n int, w string, runs array<int>")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r[c] for c in NAMES) for r in P.query(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(str(expected(*r)) for r in rows)
    assert P.find_runs(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver test data not present")
def test_query_as_all_stretches(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in P.table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = [tuple(r[c] for c in NAMES) for r in P.query(spark, sf).collect()]
    assert sorted(map(str, got)) == sorted(str(expected(*r)) for r in docs)
