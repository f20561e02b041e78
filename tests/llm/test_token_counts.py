import random

import public_tokenizers
import pyarrow as pa

from tillstar.llm.token_counts import VOCABULARY, PieceCounter, byte_pieces, count_tokens, worker_counts


def greedy(word, pieces):
    """Longest piece first, by trying all lengths; None if stuck."""
    at, n, w = 0, 0, b" " + word
    while at < len(w):
        for end in range(len(w), at, -1):
            if w[at:end] in pieces and (at > 0 or w[at:end][:1] == b" "):
                break
        else:
            return 1
        at, n = end, n + 1
    return n


def test_counts_as_trying_all_lengths():
    rnd = random.Random(1)
    for _ in range(60):
        pieces = {bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 5))) for _ in range(rnd.randrange(1, 14))}
        pieces = {p if rnd.random() < 0.6 else b" " + p for p in pieces} | ({b" "} if rnd.random() < 0.7 else set())
        pieces |= {b"a", b"b", b"c"} if rnd.random() < 0.5 else set()
        counter = PieceCounter(sorted(pieces))
        for _ in range(80):
            word = bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 12)))
            assert counter.count(word) == greedy(word, pieces), (word, pieces)


def test_real_vocabulary_and_odd_texts(spark):
    pieces = byte_pieces(public_tokenizers.path(VOCABULARY))
    known = set(pieces)
    texts = [None, "", "  \t", "The heatou", "straße\x0bçen\x1cx y", "😀😀", "a" * 3000, "the " * 5000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "one two", 1)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in count_tokens(df, pieces).collect()}
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        assert got[i] == (len(words), sum(greedy(w, known) for w in words))
    assert got[None][0] == 2
    assert count_tokens(df.limit(0), pieces).count() == 0


def test_a_worker_keeps_one_automaton_for_each_vocabulary(spark):
    pieces = [b" a", b"a", b"b", b" b"]
    kept = worker_counts(pieces)
    assert worker_counts(list(pieces)) is kept
    # (a vocabulary that differs in one piece only is another)
    other = worker_counts([b" ab", b"a", b"b", b" b"])
    assert other is not kept and other[b"ab"] == 1 and worker_counts(pieces)[b"ab"] == 2

    def made(batches):
        for batch in batches:
            first = worker_counts(pieces)
            yield pa.RecordBatch.from_arrays([pa.array([int(worker_counts(pieces) is first)], pa.int64())], names=["id"])

    from tillstar.llm.common import prepare
    prepare(spark)
    assert {r.id for r in spark.range(0, 4, 1, 2).mapInArrow(made, "id long").collect()} == {1}
