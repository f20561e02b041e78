r"""Operator 4: greedy word-piece counts in linear time.

A word (a run of bytes other than space and U+0009..U+000D) is cut greedily: the
longest vocabulary piece that starts it, then again and again the longest
continuation piece.  The vocabulary's trie gets failure links as in Aho-Corasick
matching: a node's link leads to the state after the pieces that greedy cutting would
have taken from the node's string, and the number of these popped pieces is stored
with it.  A word is then one walk that adds up numbers; no piece is built and no byte
is read twice.

Pieces are bytes.  In the byte-level vocabulary a piece that starts with a space starts
a word, the others continue one; single bytes are pieces, so each word can be cut.
A vocabulary that can't cut a word gives it one unknown piece.

NULL and empty texts: 0 words, 0 tokens.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame

from .common import id_and_text, map_texts, record_batch, table

VOCABULARY = "byte_bpe_50k.json"
# Distinct words whose counts a Python worker keeps, and bytes up to which it does.
CACHE_WORDS, CACHE_BYTES = 1 << 16, 64


def byte_pieces(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary file as bytes (a leading space starts a word)."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return sorted(bytes(byte_of[c] for c in piece) for piece in vocabulary if all(c in byte_of for c in piece))


class PieceCounter:
    """The automaton.  ``start`` is the state of a word not begun, ``rest`` of one that
    goes on after a piece."""

    def __init__(self, pieces: list[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]
        whole = [False, False]
        self.start, self.rest = 0, 1
        for piece in pieces:
            first = piece[:1] == b" "
            if first and b" " in piece[1:] or not piece:
                continue
            node = self.start if first else self.rest
            for b in piece:
                if b not in self.next[node]:
                    self.next[node][b] = len(self.next)
                    self.next.append({})
                    whole.append(False)
                node = self.next[node][b]
            whole[node] = True
        n = len(self.next)
        self.link, self.popped = [-1] * n, [0] * n
        level = [self.start, self.rest]
        while level:  # nodes by depth: links lead to nodes that are done
            below = []
            for u in level:
                for b, v in self.next[u].items():
                    below.append(v)
                    if whole[v]:
                        self.link[v], self.popped[v] = self.rest, 1
                        continue
                    z, count = self.link[u], self.popped[u]
                    while z >= 0 and b not in self.next[z]:
                        count += self.popped[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[v], self.popped[v] = self.next[z][b], count
            level = below

    def count(self, word: bytes) -> int:
        """Pieces of a word (without its leading space)."""
        goto, link, popped = self.next, self.link, self.popped
        u, n = goto[self.start].get(32, -1), 0
        if u < 0:
            return 1
        for b in word:
            while b not in goto[u]:
                n += popped[u]
                u = link[u]
                if u < 0:
                    return 1
            u = goto[u][b]
        while u != self.rest:
            n += popped[u]
            u = link[u]
            if u < 0:
                return 1
        return n


class _Cache(dict):
    def __init__(self, counter: PieceCounter):
        self.counter = counter

    def __missing__(self, word: bytes) -> int:
        n = self.counter.count(word)
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n


_WORKER: dict = {}


def worker_counts(vocabulary: list[bytes]) -> _Cache:
    """The worker's counts by ``vocabulary``.  (A function of the module, which tasks import: the dictionary
    here outlives them, where one that a task carries is new in each.)"""
    digest = hashlib.sha256()
    for piece in vocabulary:
        digest.update(len(piece).to_bytes(4, "little") + piece)
    if _WORKER.get("name") != digest.digest():
        _WORKER.update(name=digest.digest(), cache=_Cache(PieceCounter(vocabulary)))
    return _WORKER["cache"]


def count_tokens(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words`` and ``n_tokens`` of each row.  ``vocabulary`` (bounded by the
    vocabulary file) is sent to the tasks; each worker builds the automaton once."""
    rows = id_and_text(docs, id_col, text_col)

    def task():
        count = worker_counts(vocabulary).__getitem__

        def step(batch, texts):
            words = [t.split() for t in texts]
            yield record_batch(["doc_id", "n_words", "n_tokens"], batch.column("doc_id"),
                               [len(w) for w in words], [sum(map(count, w)) for w in words])

        return step

    return map_texts(rows, task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), byte_pieces(public_tokenizers.path(VOCABULARY)))
