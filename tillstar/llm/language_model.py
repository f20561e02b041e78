r"""Operator 3: language-model scores from a causal self-attention model on subword ids.

Tokens are a text's words (ASCII letters lower-cased; runs of bytes other than space and
U+0009..U+000D) and one end mark.  The model factors a word's probability:

    P(word | before) = P(class | before) * (max(count(word) - D, 0) + D * distinct(class) * P(spelling)) / count(class)

The class is the word's first subword id (the 1,022 most frequent ids of all training tokens
have classes of their own, the others share one, the end mark has one).  P(class |
before) comes from a one-layer causal self-attention network in numpy over the first and
last subword ids of the words before; its output is a choice of 32 groups, then of 32 members.  ``count`` are counts of all training tokens of the
corpus, less an absolute discount D whose mass goes to spelling.  P(spelling) multiplies
smoothed transitions between the word's subword ids, up to a stop symbol, counted over
all training words, so unseen words have probability too.  A small share goes to the
last words before (copies).

Texts are scored in windows of ``CONTEXT`` tokens that overlap by ``OVERLAP``: each token is
scored once, with at least ``OVERLAP`` tokens (or all) before it, by masked attention over
batches of windows.

The network learns from every window of every training document, once, in rounds over ever larger
parts of them.  In each round learners start from the network of the round before and learn
from their part; their parameters, weighted by their tokens, are summed on Spark and
their mean is the next network.  Documents are dealt to rounds and learners by hash and read in
its order, and there is a learner for every 4 million tokens, so the network does not depend on
how the input is split.  Classes, transitions and counts cover the corpus.  Words and their counts never meet in one place:
each block of documents sends its distinct words to be counted and gets their counts back.
A block is a piece of an input partition (``BLOCK_BYTES`` of input).  Rows are stored once with
their block and every later pass reads that table, so ``docs`` may be split differently each
time it is read; a word without its count is an error.

NULL text counts as empty: the end mark alone.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, fold, map_texts, record_batch, release, slices, stored, table

FOLDS, HELD_OUT = 7, 2
CLASSES, MEMBERS, WIDTH, HIDDEN = 1024, 32, 16, 16
# Subword ids that have transitions of their own, and the discount of word counts.
SPELL_IDS, DISCOUNT = 4096, 0.75
CONTEXT, OVERLAP = 32, 8
# Rounds of learning, as ends of their parts (in sixteenths) of the training rows: every window is learned from once.
ROUNDS = (1, 2, 4, 8, 16)
# Training tokens of a learner in all rounds, about.
LEARNER_TOKENS = 4 << 20
COPY_SHARE, COPY_WORDS = 0.02, 8
BLOCK_BYTES = 16 << 20
# Words whose classes a training task keeps, twice.
CACHE_WORDS = 1 << 17
# Words cut at once, and ids within words that are counted at once.
CUT_WORDS, COUNT_IDS = 1 << 12, 1 << 22
# Pieces of this pattern never reach over a blank that stands between two characters other than white space.
BLANKS_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Words that a task holds of a block before they are counted, and before they are cut into classes.
HELD_WORDS, CLASS_WORDS = 300_000, 1 << 22
_NO_WORD = pa.array([""])
_OTHER_SPACE = re.compile(r"[^\S ]")
# Tokens that a training task shuffles at once (more only if one text has more).
STEP_TOKENS = 1 << 19
# Windows of a training step, and windows scored at once.
TRAIN_BATCH, BATCH = 128, 128
END, STOP, RARE = b"", -1, -2
OTHER, END_CLASS = 0, 1
_WORKER: dict = {}


def tokens(text: bytes | None) -> list[bytes]:
    """The words and the end mark (an empty word)."""
    return [*text.lower().split(), END] if text else [END]


def _encoder(ranks: bytes, pattern: str):
    key = (hashlib.sha256(ranks).digest(), pattern)
    if _WORKER.get("key") != key:
        import tiktoken

        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        size = np.zeros(max(known.values()) + 1, np.int64)
        size[np.fromiter(known.values(), np.int64, len(known))] = [len(b) for b in known]
        encoder = tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        encoder.bytes_of = size if pattern == BLANKS_CUT else None
        _WORKER.update(key=key, encoder=encoder)
    return _WORKER["encoder"]


def subwords(word: bytes, encoder) -> list[int]:
    """Subword ids of a word as it follows a blank; none for the end mark."""
    return encoder.encode_ordinary(" " + word.decode("utf-8", "replace")) if word else []


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts (strings), one text after the other, and their number by text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words = lists.flatten()
    some = pc.binary_length(words).to_numpy() > 0  # white space at an end of a text gives an empty string
    until = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
    n = np.diff(np.append(0, np.cumsum(some))[until])
    return words if some.all() else words.filter(pa.array(some)), n


def with_ends(values: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """``values`` of the words of texts, ``n`` by text, with ``end`` after those of each text; and the new numbers."""
    out = np.full(len(values) + len(n), end, values.dtype)
    word = np.ones(len(out), bool)
    word[np.cumsum(n + 1) - 1] = False
    out[word] = values
    return out, n + 1


def _cut(words: pa.Array, encoder) -> tuple[np.ndarray, np.ndarray]:
    """The subword ids of words (strings, none empty), one after the other, and their number by word."""
    if encoder.bytes_of is not None:
        lists = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        try:
            text = " " + pc.binary_join(lists, " ")[0].as_py()
        except UnicodeDecodeError:
            text = None
        # cut as one text: the pattern starts a piece at each blank, so a word's ids end where its bytes do
        if text is not None and not _OTHER_SPACE.search(text):
            ids = encoder.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
            ends = np.searchsorted(np.cumsum(encoder.bytes_of[ids]), np.cumsum(pc.binary_length(words).to_numpy() + 1)) + 1
            return ids, np.diff(ends, prepend=0)
        if len(words) > 64:  # few words have other white space or are no UTF-8
            return _joined([_cut(words[:len(words) // 2], encoder), _cut(words[len(words) // 2:], encoder)])
    found = [subwords(w, encoder) for w in words.view(pa.binary()).to_pylist()]
    return np.array(list(chain.from_iterable(found)), np.int64), np.fromiter(map(len, found), np.int64, len(found))


def _joined(parts):
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def cut(words: pa.Array, encoder) -> tuple[np.ndarray, np.ndarray]:
    """``subwords`` of many words (strings): the ids, one word after the other, and their number by word."""
    some = pc.binary_length(words).to_numpy() > 0
    full = words if some.all() else words.filter(pa.array(some))
    ids, n = _joined([_cut(full[k:k + CUT_WORDS], encoder) for k in range(0, len(full), CUT_WORDS)])
    sizes = np.zeros(len(words), np.int64)
    sizes[some] = n
    return ids, sizes


def _ends(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last of the ids of each word that has any."""
    ends = np.cumsum(sizes[sizes > 0])
    return ids[ends - sizes[sizes > 0]], ids[ends - 1]


def _following(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The id that follows each id in its word, or ``STOP``."""
    after = np.append(ids[1:], STOP)
    after[np.cumsum(sizes[sizes > 0]) - 1] = STOP
    return after


# --- the network -------------------------------------------------------------


def new_network(classes: int, frequency: np.ndarray) -> dict[str, np.ndarray]:
    """Class c is member c mod ``MEMBERS`` of group c div ``MEMBERS``: the output is a choice of the group, then of
    the member, given the state times a gate of the group."""
    r = np.random.default_rng(11)
    weight = lambda *shape: (r.standard_normal(shape) * 0.3 / math.sqrt(shape[0] if len(shape) > 1 else 1)).astype(np.float32)
    groups = -(-classes // MEMBERS)
    of_member = np.zeros(groups * MEMBERS)
    of_member[:classes] = frequency
    of_member = of_member.reshape(groups, MEMBERS)
    of_group = of_member.sum(1)
    start = lambda n, total, k: np.log((n + 1) / (total + k)).astype(np.float32)
    # class `classes` is the start of a text
    return {"first": weight(classes + 1, WIDTH) * math.sqrt(classes + 1) * 0.35, "last": weight(classes + 1, WIDTH) * math.sqrt(classes + 1) * 0.35,
            "place": weight(CONTEXT, WIDTH),
            "q": weight(WIDTH, WIDTH), "k": weight(WIDTH, WIDTH), "v": weight(WIDTH, WIDTH), "o": weight(WIDTH, WIDTH),
            "w1": weight(WIDTH, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "w2": weight(HIDDEN, WIDTH),
            "group": weight(WIDTH, groups) * np.float32(0.1), "group_bias": start(of_group, of_group.sum(), groups),
            "gate": np.ones((groups, WIDTH), np.float32), "member": weight(WIDTH, MEMBERS) * np.float32(0.1),
            "member_bias": start(of_member, of_group[:, None], MEMBERS)}


_SEEN = np.tril(np.ones((CONTEXT, CONTEXT), np.float32))
# Logits within this bound are exponentiated as they are; their sums stay finite and above zero in 32 bits.
_SAFE = 60


def _safe(z: np.ndarray) -> bool:
    return z.max(initial=0) <= _SAFE and z.min(initial=0) >= -_SAFE


def _projections(net) -> np.ndarray:
    return np.concatenate([net["q"] * np.float32(WIDTH**-0.5), net["k"], net["v"]], axis=1)


def _attention(net, first, last, begin=0):
    """At each position of windows: inputs x (a row each), and their queries, keys and values; from position ``begin`` on:
    attention weights s before they are divided by their sums, one over these sums, and the means c of what they attend to.
    (Attention scores of normal inputs are small; the bound only keeps their exponentials finite.)"""
    n, t = first.shape
    x = net["first"].take(first.reshape(-1), axis=0, mode="clip")
    x += net["last"].take(last.reshape(-1), axis=0, mode="clip")
    x.reshape(n, t, WIDTH)[:] += net["place"][:t]
    q, k, v = np.split((x @ _projections(net)).reshape(n, t, 3 * WIDTH), 3, axis=2)
    s = q[:, begin:] @ k.transpose(0, 2, 1)
    if not _safe(s):
        np.clip(s, -_SAFE, _SAFE, out=s)
    np.exp(s, out=s)
    s *= _SEEN[begin:t, :t]
    share = 1 / (s.reshape(-1, t) @ np.ones((t, 1), s.dtype))
    c = (s @ v).reshape(-1, WIDTH)
    c *= share
    return x, q, k, v, s, share, c


def _chosen(z: np.ndarray, row: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of the chosen column in each row of logits, and one over the sum of the exponentials that these become."""
    if not _safe(z):
        z -= z.max(axis=1, keepdims=True)
    mine = z[row, column]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    return mine - np.log(total), 1 / total


def _outputs(net, g, target):
    """Log probability of the target classes at states (a row each), and what backward needs."""
    hi, lo = np.divmod(target, MEMBERS)
    row = np.arange(len(target))
    zg = g @ net["group"]
    zg += net["group_bias"]
    gate = net["gate"].take(hi, axis=0)
    u = g * gate
    zm = u @ net["member"]
    zm += net["member_bias"].take(hi, axis=0)
    (p_group, of_group), (p_member, of_member) = _chosen(zg, row, hi), _chosen(zm, row, lo)
    return p_group + p_member, (gate, u, hi, lo, row, zg, of_group, zm, of_member)


def _states(net, x, c):
    """The states that outputs are chosen by, of inputs x and what they attend to; and what backward needs."""
    h = x + c @ net["o"]
    r = h @ net["w1"]
    r += net["b1"]
    np.maximum(r, 0, out=r)
    return h + r @ net["w2"], h, r


def forward(net, first, last, target):
    """Natural log probability of the target class at each position of windows of inputs; and what backward needs."""
    x, q, k, v, s, share, c = _attention(net, first, last)
    g, h, r = _states(net, x, c)
    p, kept = _outputs(net, g, target.reshape(-1))
    return p.reshape(target.shape), (x, q, k, v, s, share, c, h, r, g, *kept)


def _sums_by_id(ids: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """The sum of the rows of each id below ``size``."""
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    ids = ids[order]
    begins = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    out[ids[begins]] = np.add.reduceat(rows.take(order, axis=0), begins, axis=0)
    return out


def backward(net, first, last, weight, kept):
    x, q, k, v, s, share, c, h, r, g, gate, u, hi, lo, row, pg, of_group, pm, of_member = kept
    n, t = first.shape
    each = (weight / weight.sum()).reshape(-1)
    ones = np.ones(n * t, x.dtype)
    # of the logits: the probability, less one at the target
    pg, pm = pg * (each * of_group)[:, None], pm * (each * of_member)[:, None]
    pg[row, hi] -= each
    pm[row, lo] -= each
    du = pm @ net["member"].T
    by_group = _sums_by_id(hi, np.concatenate([pm, du * g], axis=1), len(net["gate"]))
    out = {"group": g.T @ pg, "group_bias": ones @ pg, "member": u.T @ pm, "member_bias": by_group[:, :MEMBERS], "gate": by_group[:, MEMBERS:]}
    dg = pg @ net["group"].T
    du *= gate
    dg += du
    out["w2"] = r.T @ dg
    dr = dg @ net["w2"].T
    dr *= r > 0
    out["w1"], out["b1"] = h.T @ dr, ones @ dr
    dh = dg
    dh += dr @ net["w1"].T
    out["o"] = c.T @ dh
    dc = dh @ net["o"].T
    dc *= share
    by_window = dc.reshape(n, t, WIDTH)
    ds = by_window @ v.transpose(0, 2, 1)
    ds -= np.einsum("ij,ij->i", dc, c).reshape(n, t, 1)
    ds *= s
    dy = np.empty((n, t, 3 * WIDTH), x.dtype)
    dq, dk, dv = np.split(dy, 3, axis=2)
    np.matmul(ds, k, out=dq)
    np.matmul(ds.transpose(0, 2, 1), q, out=dk)
    np.matmul(s.transpose(0, 2, 1), by_window, out=dv)
    dy = dy.reshape(-1, 3 * WIDTH)
    out["q"], out["k"], out["v"] = np.split(x.T @ dy, 3, axis=1)
    # q holds the scale already
    out["q"] = out["q"] * np.float32(WIDTH**-0.5)
    dx = dh
    dx += dy @ _projections(net).T
    out["place"] = np.zeros_like(net["place"])
    out["place"][:t] = dx.reshape(n, t, WIDTH).sum(0)
    for name, ids in (("first", first), ("last", last)):
        out[name] = _sums_by_id(ids.reshape(-1), dx, len(net[name]))
    return out


def windows_of(classes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What stands before each token, the tokens and their weights (0: no token), of a text
    given as the first and last classes of its tokens (2 x tokens); windows x CONTEXT arrays."""
    n = classes.shape[1]
    size = -(-n // CONTEXT) * CONTEXT
    before, target, weight = np.zeros((2, size), np.uint16), np.zeros(size, np.uint16), np.zeros(size, np.float32)
    before[:, 0], before[:, 1:n] = start, classes[:, :-1]
    target[:n], weight[:n] = classes[0], 1
    return before.reshape(2, -1, CONTEXT), target.reshape(-1, CONTEXT), weight.reshape(-1, CONTEXT)


class Learner:
    """Adam over shuffled batches of windows, for one learner's part of one round."""

    def __init__(self, net: dict[str, np.ndarray], nth: int):
        self.net = {n: w.copy() for n, w in net.items()}
        self.m = {n: np.zeros_like(w) for n, w in net.items()}
        self.v = {n: np.zeros_like(w) for n, w in net.items()}
        self.rnd, self.step, self.tokens = np.random.default_rng(5 + nth), 0, 0
        # later rounds begin with a learned network: fewer careful steps, smaller ones
        self.careful, self.rate = (10 if nth else 50), 0.01 * (1 - 0.9 * nth / len(ROUNDS))

    def learn(self, before, target, weight) -> None:
        # windows of one length go together
        lengths = weight.sum(1).astype(np.int64)
        order = self.rnd.permutation(len(target))
        order = order[np.argsort(lengths[order], kind="stable")]
        self.tokens += int(lengths.sum())
        batches = [order[at:at + TRAIN_BATCH] for at in range(0, len(order), TRAIN_BATCH)]
        for k in self.rnd.permutation(len(batches)):
            b = batches[k]
            t = max(1, int(lengths[b].max()))  # tokens come first in a window
            first, last, goal = (x[b, :t].astype(np.int64) for x in (before[0], before[1], target))
            _, kept = forward(self.net, first, last, goal)
            self.step += 1
            rate = self.rate * min(1.0, self.step / self.careful)
            for n, grad in backward(self.net, first, last, weight[b, :t], kept).items():
                self.m[n] += np.float32(0.1) * (grad - self.m[n])
                self.v[n] += np.float32(0.01) * (grad * grad - self.v[n])
                self.net[n] -= np.float32(rate / (1 - 0.9**self.step)) * self.m[n] / (np.sqrt(self.v[n] * np.float32(1 / (1 - 0.99**self.step))) + np.float32(1e-8))


# --- the model ---------------------------------------------------------------


@dataclass
class Model:
    net: dict[str, np.ndarray]
    class_of: dict[int, int]               # subword id -> class
    own: set[int]                          # ids with transitions of their own
    class_count: np.ndarray                # training tokens by class
    class_words: np.ndarray                # distinct training words by class
    first_other: dict[int, int]            # counts of first ids of the shared class
    pairs: dict[tuple[int, int], int]      # (id before or RARE, id or STOP) -> count
    n_tokens: int
    n_distinct: int

    def __post_init__(self):
        # arrays by id (transitions: STOP is 0, RARE -1, so an id is one more) and the pairs by rising key
        found = np.array([(*k, n) for k, n in self.pairs.items()], np.int64).reshape(-1, 3)
        self.size = 2 + max([0, *self.class_of, *self.own, *self.first_other, *found[:, :2].reshape(-1).tolist()])
        self.keys = self._key(found[:, 0], found[:, 1])
        by_key = np.argsort(self.keys)
        self.keys, self.pair_count = self.keys[by_key], found[by_key, 2]
        self.id_count = np.bincount(found[:, 1] + 1, found[:, 2], self.size + 1)
        self.before_count = np.bincount(found[:, 0] - RARE, found[:, 2], self.size + 2)
        self.has_own = self._flags(self.own)
        self.n_ids, self.n_other = self.id_count.sum(), sum(self.first_other.values())
        self.class_table = class_table(self.class_of, self.size)
        first = np.zeros(self.size)
        first[list(self.first_other)] = list(self.first_other.values())
        self.first_logp = np.where(self._flags(self.class_of), 0.0, np.log10((first + 0.1) / (self.n_other + 5026.0)))

    def __getstate__(self):
        # tasks need the arrays alone
        return self.__dict__ | {"pairs": {}, "first_other": {}}

    def _flags(self, ids) -> np.ndarray:
        flags = np.zeros(self.size, bool)
        flags[list(ids)] = True
        return flags

    def _key(self, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        return (before - RARE) * (self.size + 1) + i + 1

    def transitions(self, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        """log10 P(next id or STOP | id before), of arrays."""
        least = (self.id_count[i + 1] + 0.1) / (self.n_ids + 5026.0)
        b = np.where(self.has_own[before], before, RARE)
        key = self._key(b, i)
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        n = np.where(self.keys[at] == key, self.pair_count[at], 0) if len(self.keys) else 0
        return np.log10((n + 5.0 * least) / (self.before_count[b - RARE] + 5.0))


def class_table(class_of: dict[int, int], size: int) -> np.ndarray:
    """The class of each id below ``size``."""
    table = np.full(size, OTHER)
    table[list(class_of)] = list(class_of.values())
    return table


def entries(model: Model, words: pa.Array, counts: np.ndarray, encoder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of vocabulary entries: first class, last class, log10 P(word | class)."""
    first, last = np.full(len(words), END_CLASS), np.full(len(words), END_CLASS)
    spelled = np.zeros(len(words))
    ids, sizes = cut(words, encoder)
    if len(ids):
        # an id that no training word has is like any other without counts
        ids = np.minimum(ids, model.size - 1)
        after = _following(ids, sizes)
        pairs = pa.array(ids * (model.size + 1) + after + 1).dictionary_encode()
        before, i = np.divmod(pairs.dictionary.to_numpy(), model.size + 1)
        step = model.transitions(before, i - 1)[pairs.indices.to_numpy()]
        some = sizes > 0
        begin, end = _ends(ids, sizes)
        first[some], last[some] = model.class_table[begin], model.class_table[end]
        spelled[some] = model.first_logp[begin] + np.add.reduceat(step, np.cumsum(sizes[some]) - sizes[some])
    seen = model.class_count[first]
    known = np.maximum(counts - DISCOUNT, 0.0) / np.maximum(seen, 1.0)
    share = np.where(seen > 0, DISCOUNT * model.class_words[first] / np.maximum(seen, 1.0), 1.0)
    inner = np.log10(known + share * 10.0 ** np.maximum(spelled, -300) + 1e-300)
    return first, last, np.where(first == END_CLASS, 0.0, inner)


def class_scores(net, first, last, own, target, begin=0) -> np.ndarray:
    """Natural log probabilities of the targets' classes at the positions ``own`` (from ``begin`` on) of windows of inputs."""
    x, *_, c = _attention(net, first, last, begin)
    x, own = x.reshape(*first.shape, WIDTH)[:, begin:].reshape(-1, WIDTH), own.reshape(-1)
    if not own.all():
        x, c = x[own], c[own]
    return _outputs(net, _states(net, x, c)[0], target)[0]


def score_texts(model: Model, texts: list[np.ndarray], first: np.ndarray, last: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """log10 probability of texts given as arrays of numbers of vocabulary entries (the last one is
    the end mark); ``first``, ``last``, ``inner`` are the entries' classes and log10 P(word | class)."""
    start = len(model.class_count)
    lengths = np.array([len(t) for t in texts])
    begins = np.concatenate([[0], np.cumsum(lengths)])
    words = np.concatenate(texts)
    # what stands before each token; the start of a text has a class of its own
    f, l = np.empty(len(words), np.int64), np.empty(len(words), np.int64)  # noqa: E741
    f[1:], l[1:] = first[words[:-1]], last[words[:-1]]
    f[begins[:-1]] = l[begins[:-1]] = start
    stride = CONTEXT - OVERLAP
    n_windows = 1 + np.maximum(0, -(-(lengths - CONTEXT) // stride))
    text_of = np.repeat(np.arange(len(texts)), n_windows)
    nth = np.arange(len(text_of)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    at = begins[text_of] + nth * stride
    end = begins[text_of + 1]
    # log10 P(class) of each token, then of the word, then mixed with copies
    logp = np.empty(len(words))
    width = np.minimum(CONTEXT, end - at)
    # first windows of texts are scored from their first token, the others from where they stop to overlap; those of one width go together
    for begin, some in ((0, np.flatnonzero(nth == 0)), (OVERLAP, np.flatnonzero(nth))):
        some = some[np.argsort(width[some], kind="stable")]
        for b in range(0, len(some), BATCH):
            mine = some[b:b + BATCH]
            place = at[mine, None] + np.arange(width[mine[-1]])
            own = place < end[mine, None]
            np.minimum(place, end[mine, None] - 1, out=place)
            inputs, own = (f.take(place), l.take(place)), own[:, begin:]
            scored = place[:, begin:][own]
            logp[scored] = class_scores(model.net, *inputs, own, first.take(words.take(scored)), begin)
    logp = logp / math.log(10) + inner[words]
    offset = np.arange(len(words)) - np.repeat(begins[:-1], lengths)
    back, number, copies = np.minimum(offset, COPY_WORDS).astype(np.int8), words.astype(np.int32), np.zeros(len(words), np.int8)
    for lag in range(1, COPY_WORDS + 1):
        copies[lag:] += (number[lag:] == number[:-lag]) & (back[lag:] >= lag)
    copies = copies / np.maximum(1, back)
    logp += np.where(offset > 0, math.log10(1 - COPY_SHARE), 0.0)
    near = np.flatnonzero(copies)
    logp[near] = np.log10(10.0 ** logp[near] + COPY_SHARE * copies[near])
    return np.add.reduceat(logp, begins[:-1])


# --- Spark -------------------------------------------------------------------


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, trains, block: a piece of the input partition."""
    size = docs.sparkSession.conf.get("spark.sql.files.maxPartitionBytes", "128m").lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(size[-1:], 1)
    pieces = max(1, -(-int(size.rstrip("kmg")) * unit // BLOCK_BYTES))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (fold(id_col, FOLDS) != HELD_OUT).alias("trains"),
                       (F.spark_partition_id().cast("long") * pieces + F.pmod(F.xxhash64(id_col, text_col), F.lit(pieces))).alias("block"))


def _word_counts(rows: DataFrame) -> DataFrame:
    """block, word, count (training tokens of the corpus), one (true on one row of each word)."""

    def task():
        held: dict[int, list] = {}
        size: Counter = Counter()

        def flush(block):
            words, n = zip(*held.pop(block))
            coded = pa.concat_arrays(words).dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(), np.concatenate(n), len(coded.dictionary)).astype(np.int64)
            del size[block]
            return record_batch(["block", "word", "n"], pa.array(np.full(len(n), block)), coded.dictionary.view(pa.binary()), pa.array(n))

        def step(batch, texts):
            at, trains = batch.column("block").to_numpy(), np.array(batch.column("trains").to_pylist(), bool)
            for block in np.unique(at).tolist():
                mine = np.flatnonzero(at == block)
                words, n = split_words(batch.column("text").take(pa.array(mine)))
                coded = words.dictionary_encode()
                counts = np.bincount(coded.indices.to_numpy(), np.repeat(trains[mine], n), len(coded.dictionary))
                held.setdefault(block, []).append((pa.concat_arrays([coded.dictionary, _NO_WORD]), np.append(counts, trains[mine].sum())))
                size[block] += len(counts)
                if size[block] > HELD_WORDS:  # a block may send a word twice
                    yield flush(block)

        step.end = lambda: (flush(b) for b in list(held))
        return step

    words = map_texts(rows, task, "block long, word binary, n long").groupBy("block", "word").agg(F.sum("n").alias("n"))
    everywhere = Window.partitionBy("word")
    return words.select("block", "word", F.sum("n").over(everywhere).alias("count"), (F.min("block").over(everywhere) == F.col("block")).alias("one"))


def _spelled(words: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """ids (subword ids of a word), count."""

    def task(batches):
        enc = _encoder(ranks, pattern)
        for b in batches:
            ids, sizes = cut(b.column("word").view(pa.string()), enc)
            begins = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
            yield record_batch(["ids", "count"], pa.ListArray.from_arrays(begins, pa.array(ids.astype(np.int32))), b.column("count"))

    return words.select("word", "count").mapInArrow(task, "ids array<int>, count long")


class _Classes(dict):
    """Word -> its first class, and its last one in the upper 16 bits.  When it is full it becomes the older of two
    generations, from which words that occur again come back without being cut again."""

    def __init__(self, class_of: dict[int, int], encoder):
        self.class_of, self.encoder, self.older = class_of, encoder, {}

    def __missing__(self, word: bytes) -> int:
        c = self.older.get(word)
        if c is None:
            ids = subwords(word, self.encoder)
            c = self.class_of.get(ids[0], OTHER) | self.class_of.get(ids[-1], OTHER) << 16 if ids else END_CLASS | END_CLASS << 16
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = c
        return c


def _class_rows(rows: DataFrame, class_of: dict[int, int], ranks: bytes, pattern: str, learners: int) -> DataFrame:
    """classes of each training document (of each token the first class and the last, 16 bits each), and by its
    hash the learner and the round that it goes to."""
    dealt = rows.where("trains").select("text", F.xxhash64("doc_id", "text").alias("hash"))

    def task():
        encoder = _encoder(ranks, pattern)
        known = _Classes(class_of, encoder)
        # ids above all that have classes are like the last one
        of_id = class_table(class_of, 2 + max([0, *class_of]))

        def classes(words):
            if encoder.bytes_of is None:  # one by one, so those cut before are kept
                return np.array([known[w] for w in words.view(pa.binary()).to_pylist()], np.uint32)
            first, last = _ends(*cut(words, encoder))
            return (of_id[np.minimum(first, len(of_id) - 1)] | of_id[np.minimum(last, len(of_id) - 1)] << 16).astype(np.uint32)

        some, size = [], 0

        def flush():
            # the distinct words of many texts are cut once
            words, n, hashes = zip(*some)
            some.clear()
            coded, n = pa.concat_arrays(words).dictionary_encode(), np.concatenate(n)
            out, n = with_ends(classes(coded.dictionary)[coded.indices.to_numpy()], n, END_CLASS | END_CLASS << 16)
            out, rows, bounds = out.astype("<u4"), pa.concat_arrays(hashes), np.append(0, np.cumsum(n))
            for k in range(0, len(n), BATCH_ROWS):
                ends = bounds[k:k + BATCH_ROWS + 1]
                data = pa.py_buffer(out[ends[0]:ends[-1]])
                ends = pa.py_buffer((4 * (ends - ends[0])).astype(np.int32))
                yield record_batch(["classes", "hash"], pa.Array.from_buffers(pa.binary(), len(n[k:k + BATCH_ROWS]), [None, ends, data]), rows[k:k + BATCH_ROWS])

        def step(batch, texts):
            nonlocal size
            words, n = split_words(batch.column("text"))
            some.append((words, n, batch.column("hash")))
            size += len(words)
            if size > CLASS_WORDS:
                size = 0
                yield from flush()

        step.end = lambda: flush() if some else ()
        return step

    part = F.pmod(F.col("hash"), F.lit(16))
    nth = F.coalesce(*[F.when(part < end, F.lit(k)) for k, end in enumerate(ROUNDS)])
    return map_texts(dealt, task, "classes binary, hash long").select(
        "classes", "hash", F.pmod(F.xxhash64("hash"), F.lit(learners)).cast("int").alias("learner"), nth.alias("round"))


def train_network(rows: DataFrame, frequency: np.ndarray, learners: int) -> dict[str, np.ndarray]:
    """The network after the ``ROUNDS`` over all windows of ``_class_rows``; ``frequency`` are the tokens by class.  In a
    round each learner starts from the same network; their number and parts follow from the rows alone."""
    net = new_network(CLASSES, frequency)

    for nth in range(len(ROUNDS)):
        def task(batches, net=net, nth=nth):
            learner, at, some, size = None, None, [], 0

            def learn():
                if some:
                    learner.learn(*(np.concatenate(x, axis=-2) for x in zip(*some)))
                some.clear()

            def result():
                flat = np.concatenate([learner.net[n].reshape(-1) for n in net]).astype(np.float64)
                return record_batch(["at", "n", "value"], pa.array(np.arange(len(flat))), pa.array(np.full(len(flat), learner.tokens)),
                                    pa.array(flat * learner.tokens))

            for b in batches:
                for c, who in zip(b.column("classes"), b.column("learner").to_pylist()):
                    if who != at:
                        if learner is not None:
                            learn()
                            yield result()
                        learner, at, size = Learner(net, nth), who, 0
                    some.append(windows_of(np.frombuffer(c.as_py(), "<u2").reshape(-1, 2).T, CLASSES))
                    size += some[-1][1].size
                    if size > STEP_TOKENS:
                        learn()
                        size = 0
            if learner is not None:
                learn()
                yield result()

        dealt = rows.where(F.col("round") == nth).repartition(learners, "learner").sortWithinPartitions("learner", "hash")
        # as many rows as the network has parameters, whatever the corpus
        sums = dealt.mapInArrow(task, "at long, n long, value double").groupBy("at").agg((F.sum("value") / F.sum("n")).alias("w")).collect()
        if not sums:
            continue
        flat = np.empty(len(sums))
        for r in sums:
            flat[r["at"]] = r["w"]
        ends = np.cumsum([w.size for w in net.values()])
        net = {n: p.reshape(net[n].shape).astype(np.float32) for n, p in zip(net, np.split(flat, ends[:-1]))}
    return net


def fit(rows: DataFrame, counts: DataFrame, ranks: bytes, pattern: str) -> Model:
    """Everything from the word counts of the corpus, and the network from all training rows of ``_blocks``."""
    words = counts.where("one and count > 0")
    n, distinct = (x or 0 for x in words.agg(F.sum("count"), F.count(F.lit(1))).first())
    spelled = stored(_spelled(words, ranks, pattern), "word-ids")
    # rows of both are bounded by the vocabulary file
    ends = F.explode(F.array(F.col("ids")[0], F.element_at("ids", -1))).alias("i")
    tally = spelled.where(F.size("ids") > 0).select(ends, "count").groupBy("i").agg(F.sum("count").alias("n")).collect()
    inside = spelled.select(F.explode("ids").alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()
    most = lambda found, n: [r["i"] for r in sorted(found, key=lambda r: (-r["n"], r["i"]))[:n]]
    class_of = {i: k + 2 for k, i in enumerate(most(tally, CLASSES - 2))}
    own = set(most(inside, SPELL_IDS))

    size = 2 + max([0, *class_of, *own, *(r["i"] for r in inside)])
    of_class, has_own = class_table(class_of, size), np.zeros(size, bool)
    has_own[list(own)] = True

    def task(batches):
        # kinds: 0 tokens and 3 words of a class, 1 first ids of the shared class, 2 transitions within words,
        # each distinct word once: new words are like rare ones
        def counted(kind, a, b):
            keys = pa.array((a - RARE) * (size + 1) + b + 1).dictionary_encode()
            a, b = np.divmod(keys.dictionary.to_numpy(), size + 1)
            return record_batch(["kind", "a", "b", "n"], np.full(len(a), kind), a + RARE, b - 1, np.bincount(keys.indices.to_numpy()))

        def flush():
            ids, sizes, count = (np.concatenate(x) for x in zip(*some))
            first = np.full(len(sizes), END_CLASS)
            if len(ids):
                begin, _ = _ends(ids, sizes)
                first[sizes > 0] = of_class[begin]
                yield counted(2, np.where(has_own[ids], ids, RARE), _following(ids, sizes))
                other = begin[of_class[begin] == OTHER]
                if len(other):
                    yield counted(1, np.zeros(len(other), np.int64), other)
            tokens_of, words_of = (np.zeros(CLASSES, np.int64) for _ in range(2))
            np.add.at(tokens_of, first, count)
            np.add.at(words_of, first, 1)
            for kind, n in ((0, tokens_of), (3, words_of)):
                a = np.flatnonzero(words_of)
                yield record_batch(["kind", "a", "b", "n"], np.full(len(a), kind), a, np.zeros(len(a), np.int64), n[a])
            some.clear()

        some, held = [], 0
        for b in batches:
            ids = b.column("ids")
            some.append((ids.flatten().to_numpy().astype(np.int64), np.diff(ids.offsets.to_numpy()).astype(np.int64), b.column("count").to_numpy()))
            held += len(some[-1][0])
            if held > COUNT_IDS:
                yield from flush()
                held = 0
        if some:
            yield from flush()

    # rows are bounded by the vocabulary file: SPELL_IDS x its ids, whatever the corpus
    sums = spelled.mapInArrow(task, "kind long, a long, b long, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    class_count, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sums:
        if r["kind"] in (0, 3):
            (class_words if r["kind"] else class_count)[r["a"]] = r["n"]
    learners = max(1, round(n / LEARNER_TOKENS))
    net = train_network(stored(_class_rows(rows, class_of, ranks, pattern, learners), "word-classes", "zstd"), class_count, learners)
    return Model(net, class_of, own, class_count, class_words, {r["b"]: r["n"] for r in sums if r["kind"] == 1},
                 {(r["a"], r["b"]): r["n"] for r in sums if r["kind"] == 2}, n, distinct)


def score(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score of each row."""
    rows = stored(_blocks(docs, id_col, text_col), "word-blocks", "zstd")
    counts = stored(_word_counts(rows), "word-counts")
    model = fit(rows, counts, ranks, pattern)
    doc_type = rows.schema["doc_id"].dataType.simpleString()

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        encoder = _encoder(ranks, pattern)
        vocabulary = words.column("word").combine_chunks().view(pa.string())
        count = words.column("count").to_numpy()
        first, last, inner = entries(model, vocabulary, count, encoder)
        base = np.log10((count + 1) / (model.n_tokens + model.n_distinct + 1))
        end = pc.index(vocabulary, "").as_py()
        out: list[list] = [[], [], [], []]
        for batch in texts.combine_chunks().to_batches():
            for part in slices(batch, "text"):
                found, n = split_words(part.column("text"))
                number = pc.index_in(found, value_set=vocabulary)
                if number.null_count:
                    raise KeyError("a word without its count")
                all_words, lengths = with_ends(number.to_numpy().astype(np.int64), n, end)
                begins = np.cumsum(lengths) - lengths
                out[0].extend(lengths.tolist())
                out[1].extend(np.add.reduceat(count[all_words] > 0, begins, dtype=np.int64).tolist())
                out[2].extend(np.add.reduceat(base[all_words], begins).tolist())
                # as many texts at once as have 100,000 tokens, or one more
                nth = np.cumsum(lengths) // 100_000
                for some in np.split(np.arange(len(lengths)), np.flatnonzero(np.diff(nth)) + 1):
                    own = [all_words[begins[k]:begins[k] + lengths[k]] for k in some]
                    out[3].extend(score_texts(model, own, first, last, inner).tolist())
        del vocabulary
        release()
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": pa.array([not t for t in texts.column("trains").to_pylist()]),
                         "n_tokens": pa.array(out[0], pa.int64()), "n_known": pa.array(out[1], pa.int64()),
                         "train_tokens": pa.array([model.n_tokens] * len(texts), pa.int64()),
                         "base_score": pa.array(out[2], pa.float64()), "score": pa.array(out[3], pa.float64())})

    return (rows.groupBy("block").cogroup(counts.select("block", "word", "count").groupBy("block"))
            .applyInArrow(run, f"doc_id {doc_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))


def query(spark, sf_dir: str) -> DataFrame:
    from .packing import vocabulary

    return score(table(spark, sf_dir, "documents"), *vocabulary())
