import itertools
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tillstar.llm import packing as P


def check(pieces, texts, window=1024):
    """Every id once, sequences gapless, no padding; texts: doc_id -> text."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in texts}
    want, got = Counter(i for i, _ in texts), Counter()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append((p.offset, p.length))
        part = ids[p.doc_id][p.start:p.start + p.length]
        assert len(part) == p.length > 0 and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for i, n in want.items():
        cover = Counter(k for p in by_doc[i] for k in range(p.start, p.start + p.length))
        assert set(cover) == set(range(len(ids[i]))) and set(cover.values()) == {n}
    for parts in by_seq.values():
        at = 0
        for off, length in sorted(parts):
            assert off == at
            at += length
        assert at <= window and (at == window or at & (at - 1) == 0)


def run(spark, texts):
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, offset int").repartition(3)
    return P.pack(df, *P.vocabulary()).collect()


def test_odd_texts(spark):
    texts = [(1, None), (2, ""), (3, "<|endoftext|> a"), (4, " " * 9000), (5, "a" * 30000), (6, "é😀\x01\n\n  x" * 400), (7, "the cat " * 3000)]
    texts += [(7, "the cat " * 3000)] * 3 + [(9, "dog")] * 50
    check(run(spark, texts), texts)


def test_lengths_that_never_fill_a_window(spark):
    texts = [(i, " the" * 699) for i in range(13)]
    check(run(spark, texts), texts)


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver test data not present")
def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = P.query(spark, sf).collect()
    texts = [(r.doc_id, r.text) for r in P.table(spark, sf, "documents").select("doc_id", "text").collect()]
    check(rows, texts)
    # most remainders are whole, though few documents share a length here
    pieces = Counter(r.doc_id for r in rows)
    need = {r.doc_id: -(-r.doc_tokens // 1024) for r in rows}
    assert sum(pieces[i] > need[i] for i in need) <= 0.25 * len(need)


def test_best_fill_as_trying_all_multisets():
    rnd = random.Random(1)
    for _ in range(300):
        counts = {rnd.randrange(1, 12): rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 5))}
        cap = rnd.randrange(0, 30)
        sums = [sum(n * k for n, k in zip(counts, ks)) for ks in itertools.product(*[range(c + 1) for c in counts.values()])]
        got = P.best_fill(counts, cap)
        assert sum(n * k for n, k in got.items()) == max(s for s in sums if s <= cap)
        assert all(k <= counts[n] for n, k in got.items())


def test_cuts_cover_the_line():
    for total, window in ((5000, 1024), (1024, 1024), (37, 64), (200, 64)):
        at, seqs = 0, Counter()
        while at < total:
            length = min(total - at, 7 + at % 50)
            got = P.cuts(at, length, total, window)
            assert sum(n for _, _, n in got) == length
            for s, off, n in got:
                assert seqs[s] == off
                seqs[s] += n
            at += length
        assert all(v == window or v & (v - 1) == 0 for v in seqs.values())


def test_the_rank_file_is_the_json_vocabulary():
    """Every piece has the same id in both files, and merges rank as their results do."""
    import base64
    import json

    import public_tokenizers

    ranks, _ = P.vocabulary()
    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    pieces = {bytes(letters[c] for c in piece): i for piece, i in model["vocab"].items() if all(c in letters for c in piece)}
    assert all(pieces[p] == i for p, i in known.items()) and len(known) >= len(pieces) - 1
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [model["vocab"][m] for m in merged]
    assert ids == sorted(ids)
