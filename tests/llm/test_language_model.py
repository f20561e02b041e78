import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tillstar.llm import language_model as L
from tillstar.llm.packing import vocabulary


def base(rows):
    """doc -> (held_out, n_tokens, n_known, train_tokens, base_score), as the definition says."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    toks = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(w for ws, h in zip(toks, held) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(h, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for ws, h in zip(toks, held)]


def compare(rows, got):
    want = sorted(((str(i), *b) for (i, _), b in zip(rows, base(rows))), key=str)
    have = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
    assert len(want) == len(have)
    for w, h in zip(sorted(want, key=lambda x: (x[0], x[2], x[5])), sorted(have, key=lambda x: (x[0], x[2], x[5]))):
        assert w[:5] == h[:5] and abs(w[5] - h[5]) < 1e-6 * max(1, abs(w[5]))


def test_odd_rows(spark, monkeypatch):
    rnd = random.Random(1)
    rows = [(None, "A b"), (1, None), (2, ""), (3, "Éa É \x0b\x1c x"), (3, "same"), (3, "same"), (4, "go " * 20000)]
    rows += [(i, " ".join(rnd.choice(["The", "the", "cat", "sat", "on", "mat", f"w{i}"]) for _ in range(rnd.randrange(150)))) for i in range(10, 60)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, block int, score int")
    got = L.score(df, *vocabulary()).collect()
    compare(rows, got)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert L.score(df.limit(0), *vocabulary()).count() == 0


def test_input_split_differently_between_the_passes(spark, monkeypatch, tmp_path):
    rows = [(i, " ".join(f"w{i}x{k % 7}" for k in range(100))) for i in range(400)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5, "doc_id").write.parquet(path)
    key, fit = "spark.sql.files.maxPartitionBytes", L.fit
    before = spark.conf.get(key)

    def fit_and_lose_executors(*a, **k):
        model = fit(*a, **k)
        spark.conf.set(key, "700b")
        return model

    monkeypatch.setattr(L, "fit", fit_and_lose_executors)
    try:
        got = L.score(spark.read.parquet(path), *vocabulary()).collect()
    finally:
        spark.conf.set(key, before)
    compare(rows, got)


def test_every_training_document_has_a_say(spark, monkeypatch):
    """One common word of its own in each document of three partitions: classes and network know them all."""
    rows = [(i, " ".join(["the", f"q{i}"] * 40)) for i in range(2300)]
    blocks = L._blocks(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text")
    trains = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    classes = L._class_rows(blocks, {}, *vocabulary(), 3).collect()
    assert {r.learner for r in classes} == {0, 1, 2} and {r["round"] for r in classes} == set(range(len(L.ROUNDS)))
    assert len(classes) == len(trains) > 1900 and sum(len(r.classes) for r in classes) == 4 * sum(len(L.tokens(t.encode())) for t in trains)
    blocks = L.stored(blocks, "test-blocks")
    counts = L.stored(L._word_counts(blocks), "test-counts")
    model = L.fit(blocks, counts, *vocabulary())
    tally, encoder = Counter(), L._encoder(*vocabulary())
    for t in trains:
        for w in L.tokens(t.encode()):
            ids = L.subwords(w, encoder)
            tally.update([ids[0], ids[-1]] if ids else [])
    assert list(model.class_of) == sorted(tally, key=lambda i: (-tally[i], i))[:L.CLASSES - 2]
    assert model.class_count.sum() == sum(len(L.tokens(t.encode())) for t in trains)


def test_windows_hold_each_token_once_after_the_one_before():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 63, 64, 65, 200):
        c = rnd.integers(0, L.CLASSES, (2, n)).astype(np.uint16)
        before, target, weight = L.windows_of(c, L.CLASSES)
        assert weight.sum() == n and (target.reshape(-1)[:n] == c[0]).all()
        flat = before.reshape(2, -1)
        assert (flat[:, 0] == L.CLASSES).all() and (flat[:, 1:n] == c[:, :-1]).all()


def test_the_mean_of_the_learners_counts_every_token_however_rows_are_split(spark, monkeypatch):
    monkeypatch.setattr(L, "ROUNDS", (16,))
    rnd = np.random.default_rng(4)
    texts = [rnd.integers(0, L.CLASSES, (2, k)).astype("<u2") for k in (5, 700, 64, 3000, 1, 90)]
    data = [(bytearray(np.ascontiguousarray(t.T).tobytes()), 100 - k, k % 2, 0) for k, t in enumerate(texts)]
    want, total = {}, 0
    for who in (0, 1):
        part = [texts[k] for k in reversed(range(len(texts))) if k % 2 == who]  # by rising hash
        one = L.Learner(L.new_network(L.CLASSES, np.ones(L.CLASSES)), 0)
        one.learn(*(np.concatenate(x, axis=-2) for x in zip(*(L.windows_of(c, L.CLASSES) for c in part))))
        total += one.tokens
        want = {n: want.get(n, 0) + w.astype(float) * one.tokens for n, w in one.net.items()}
    assert total == sum(t.shape[1] for t in texts)
    for splits in (1, 5):
        rows = spark.createDataFrame(data, "classes binary, hash long, learner int, round int").repartition(splits)
        got = L.train_network(rows, np.ones(L.CLASSES), 2)
        assert all(np.allclose(got[n], want[n] / total, atol=1e-6) for n in want)


def test_gradients_as_differences():
    rnd = np.random.default_rng(1)
    classes = 2 * L.MEMBERS
    net = {k: v.astype(np.float64) for k, v in L.new_network(classes, np.ones(classes)).items()}
    first, last, target = (rnd.integers(0, classes, (3, 7)) for _ in range(3))
    weight = (rnd.random((3, 7)) < 0.8).astype(float)

    def loss():
        p, kept = L.forward(net, first, last, target)
        return -(p * weight).sum() / weight.sum(), kept

    _, kept = loss()
    assert np.allclose(sum(np.exp(L.forward(net, first, last, np.full_like(target, c))[0]) for c in range(classes)), 1)
    for name, grad in L.backward(net, first, last, weight, kept).items():
        for _ in range(4):
            at = tuple(rnd.integers(0, n) for n in net[name].shape)
            net[name][at] += 1e-5
            up = loss()[0]
            net[name][at] -= 2e-5
            down = loss()[0]
            net[name][at] += 1e-5
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-5, name


def test_each_token_is_scored_once_with_the_tokens_before_it():
    rnd = np.random.default_rng(2)
    n = 40
    model = L.Model(L.new_network(L.CLASSES, np.ones(L.CLASSES)), {}, set(), np.ones(L.CLASSES), np.ones(L.CLASSES), {}, {}, 10, 5)
    first, last = rnd.integers(2, L.CLASSES, n), rnd.integers(2, L.CLASSES, n)
    inner = -rnd.random(n)
    texts = [rnd.integers(0, n, k) for k in (1, 2, 63, 64, 65, 111, 112, 113, 400)]
    got = L.score_texts(model, texts, first, last, inner)
    for t, g in zip(texts, got):
        total = 0.0
        for k in range(len(t)):
            w = 0 if k < L.CONTEXT else (k - L.OVERLAP) // (L.CONTEXT - L.OVERLAP)
            s = w * (L.CONTEXT - L.OVERLAP)
            before = [None if j == 0 else t[j - 1] for j in range(s, k + 1)]
            f = np.array([[L.CLASSES if b is None else first[b] for b in before]])
            la = np.array([[L.CLASSES if b is None else last[b] for b in before]])
            goal = np.zeros_like(f)
            goal[0, -1] = first[t[k]]
            p = 10 ** (L.forward(model.net, f, la, goal)[0][0, -1] / math.log(10) + inner[t[k]])
            if k:
                near = t[max(0, k - L.COPY_WORDS):k]
                p = (1 - L.COPY_SHARE) * p + L.COPY_SHARE * np.mean(near == t[k])
            total += math.log10(p)
        assert abs(total - g) < 1e-3 * max(1, abs(g))


def test_scoring_attends_once_for_each_token(monkeypatch):
    """The positions that a window shares with the one before are attended to, but don't attend again."""
    rnd = np.random.default_rng(5)
    model = L.Model(L.new_network(L.CLASSES, np.ones(L.CLASSES)), {}, set(), np.ones(L.CLASSES), np.ones(L.CLASSES), {}, {}, 10, 5)
    texts = [rnd.integers(0, 30, k) for k in (L.CONTEXT, L.CONTEXT + 5 * (L.CONTEXT - L.OVERLAP), L.CONTEXT)]
    attended, attention = [], L._attention
    monkeypatch.setattr(L, "_attention", lambda *a: attended.append(attention(*a)) or attended[-1])
    L.score_texts(model, texts, rnd.integers(2, L.CLASSES, 30), rnd.integers(2, L.CLASSES, 30), np.zeros(30))
    assert sum(a[-1].size // L.WIDTH for a in attended) == sum(map(len, texts))


def test_attention_to_very_unlike_inputs():
    net = {k: v.astype(np.float64) for k, v in L.new_network(L.CLASSES, np.ones(L.CLASSES)).items()}
    ids = np.random.default_rng(6).integers(0, L.CLASSES, (3, 9))
    for scale in (1e3, -1e3, 1e6, -1e6):
        far = {k: v.astype(np.float32) for k, v in (net | {"q": np.eye(L.WIDTH) * scale, "k": np.eye(L.WIDTH)}).items()}
        p, kept = L.forward(far, ids, ids, ids)
        grads = L.backward(far, ids, ids, np.ones(ids.shape, np.float32), kept)
        assert np.isfinite(p).all() and all(np.isfinite(g).all() for g in grads.values())


def test_sums_by_id():
    rnd = np.random.default_rng(7)
    ids, rows = rnd.integers(0, 9, 200) * 7, rnd.random((200, 3))
    want = np.zeros((64, 3))
    for i, r in zip(ids, rows):
        want[i] += r
    assert np.allclose(L._sums_by_id(ids, rows, 64), want)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver test data not present")
def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = L.query(spark, sf).collect()
    compare([(r.doc_id, r.text) for r in L.table(spark, sf, "documents").collect()], got)
    # the base counts all unknown words as one; texts without them compare like with like
    held = [r for r in got if r.held_out and r.n_known == r.n_tokens]
    assert len(held) > 10
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_classes_of_words_in_two_generations(monkeypatch):
    monkeypatch.setattr(L, "CACHE_WORDS", 5)
    encoder, rnd = L._encoder(*vocabulary()), random.Random(3)
    class_of = {L.subwords(w, encoder)[0]: k + 2 for k, w in enumerate((b"the", b"cat", b"on"))}
    known = L._Classes(class_of, encoder)
    for _ in range(400):
        w = rnd.choice([b"", b"the", b"cat", b"on", b"mat", b"unheardofword", b"x" * 70, str(rnd.randrange(40)).encode()])
        ids = L.subwords(w, encoder)
        want = (class_of.get(ids[0], L.OTHER), class_of.get(ids[-1], L.OTHER)) if ids else (L.END_CLASS,) * 2
        assert (known[w] & 0xFFFF, known[w] >> 16) == want and len(known) <= 5 and len(known.older) <= 5


ODD_WORDS = [b"", b"the", b"it's", b"x\xc2\xa0", b"\xc2\xa0", b"\xc2\xa0y", "\u3000a\u2028".encode(), "É\u0301a9".encode(), b"\x1c\x1d", b"\xff\xe2\x82", b"...'ll", b"7a", b"x" * 70, b"don't", b"\x00"]


def test_words_cut_together_as_one_by_one(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(L, "CUT_WORDS", 100)
    ranks, pattern = vocabulary()
    encoder, rnd = L._encoder(ranks, pattern), random.Random(8)
    assert encoder.bytes_of is not None  # the usual pattern: words are cut together
    plain = [bytes(rnd.choice(b"abcdeT'9.,") for _ in range(rnd.randrange(9))) for _ in range(700)]
    for words in ([], [b""], ODD_WORDS, plain, [*plain, *ODD_WORDS, *plain], [rnd.choice(ODD_WORDS) for _ in range(500)]):
        want = [L.subwords(w, encoder) for w in words]
        calls = []
        monkeypatch.setattr(L, "subwords", lambda w, e, f=L.subwords: calls.append(w) or f(w, e))
        ids, n = L.cut(pa.array(words, pa.binary()).view(pa.string()), encoder)
        monkeypatch.undo()
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        assert words is not plain or not calls
    try:  # another pattern may reach over blanks: one by one
        assert L._encoder(ranks, r" ?\\S+ ?|\\s").bytes_of is None
    finally:
        L._encoder(ranks, pattern)


def test_words_of_texts_and_their_counts(spark):
    texts = [None, "", " ", "A b", " lead", "trail\n", "a \t\x0b\x0c b\x1cc", "É\u00a0É x", "go " * 300]
    import pyarrow as pa

    words, n = L.split_words(pa.array(texts, pa.string()))
    codes, sizes = L.with_ends(np.arange(len(words)), n, -1)
    flat = [b"" if k < 0 else words[k].as_py().encode() for k in codes.tolist()]
    want = [L.tokens(None if t is None else t.encode()) for t in texts]
    assert flat == [w for t in want for w in t] and sizes.tolist() == [len(t) for t in want]
    rows = L.stored(L._blocks(spark.createDataFrame(list(enumerate(texts * 5)), "doc_id long, text string").repartition(3), "doc_id", "text"), "test-blocks")
    tally = Counter(w for i, t in enumerate(want * 5) for w in t if zlib.crc32(str(i).encode()) % 7 != 2)
    got = L._word_counts(rows).collect()
    assert {bytes(r.word): r["count"] for r in got} == {w: tally[w] for t in want for w in t}


def test_entries_as_defined():
    import pyarrow as pa

    encoder, rnd = L._encoder(*vocabulary()), random.Random(9)
    words = list(dict.fromkeys(bytes(rnd.choice(b"abcdeT'9.,") for _ in range(rnd.randrange(9))) for _ in range(300)))
    train = [L.subwords(w, encoder) for w in words[::2]]
    firsts = Counter(i[0] for i in train if i)
    class_of = {i: k + 2 for k, (i, _) in enumerate(firsts.most_common(10))}
    own = {i for i, _ in Counter(i for w in train for i in w).most_common(20)}
    pairs = Counter()
    for w in filter(None, train):
        pairs.update((a if a in own else L.RARE, b) for a, b in zip(w, [*w[1:], L.STOP]))
    other = {i: n for i, n in firsts.items() if i not in class_of}
    class_count, class_words = np.arange(L.CLASSES) % 7 * 5.0 + 5, np.arange(L.CLASSES) % 7 + 1.0
    model = L.Model({}, class_of, own, class_count, class_words, other, dict(pairs), 10, 5)
    counts = np.array([k % 4 for k in range(len(words))])
    first, last, inner = L.entries(model, pa.array(words, pa.binary()).view(pa.string()), counts, encoder)
    by_id, by_before = Counter(), Counter()
    for (a, b), n in pairs.items():
        by_id[b] += n
        by_before[a] += n
    for k, w in enumerate(words):
        ids = L.subwords(w, encoder)
        if not ids:
            assert (first[k], last[k], inner[k]) == (L.END_CLASS, L.END_CLASS, 0)
            continue
        c = class_of.get(ids[0], L.OTHER)
        assert (first[k], last[k]) == (c, class_of.get(ids[-1], L.OTHER))
        p = 1.0 if c != L.OTHER else (other.get(ids[0], 0) + 0.1) / (sum(other.values()) + 5026)
        for a, b in zip(ids, [*ids[1:], L.STOP]):
            a = a if a in own else L.RARE
            least = (by_id[b] + 0.1) / (sum(pairs.values()) + 5026)
            p *= (pairs[a, b] + 5 * least) / (by_before[a] + 5)
        seen = class_count[c]
        want = max(counts[k] - L.DISCOUNT, 0) / seen + L.DISCOUNT * class_words[c] / seen * p
        assert abs(inner[k] - math.log10(want + 1e-300)) < 1e-9
