r"""Operator 2: toxicity by a learned lexicon, Levenshtein automata and context windows.

Training, on a bounded sample of labelled rows (``TRAIN_TOXIC`` and ``TRAIN_CLEAN`` rows of
least hash, outside the held-out fold, copies and near copies taken once): words and
word beginnings that occur in significantly more toxic texts than chance allows
become the lexicon; a beginning stands for all its endings.

Search: the lexicon is a trie.  A text's words run through the product of the trie with
Levenshtein automata (insertion, deletion, substitution, swap of neighbours),
made deterministic as states are met.  Long terms tolerate one error, very long ones
two, short ones none.  How far a misspelled form is to be believed is estimated on the
training rows.

Each match is weighed by a window of words around it: quotation marks and reporting
words lower it, direct address raises it.  The score is the noisy-or of the weighed
matches and the base rate of texts without any.

NULL and empty texts have no match and get the base rate.  Labels that are NULL or have no
document are ignored; a document labelled twice is toxic if any label says so.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from math import exp, lgamma, log, log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, map_texts, record_batch, stored, table

FOLDS = 5
# Bounds of the training sample, rows of each label.
TRAIN_TOXIC, TRAIN_CLEAN = 4000, 12000
# Chance that a term's toxic texts are a coincidence, at most; lengths of beginnings.
SIGNIFICANCE = 1e-6
MIN_PREFIX, MAX_PREFIX = 4, 12
# Term lengths from which one and two errors are tolerated.
ONE_ERROR, TWO_ERRORS = 5, 10
WINDOW = 6
CACHE_WORDS = 1 << 16
# States an automaton keeps, and characters of the terms a task counts, before it begins anew.
MAX_STATES, MAX_COUNTED = 200_000, 40 << 20
# Words that report speech or address someone; fixed values.
REPORTING = set("said says quote quoted quotes wrote called calls word term phrase dit mot sagte wort dijo palabra".split())
ADDRESS = set("you your you're du dich euch tu vous eres usted".split())
QUOTES = re.compile("[\"“”„«»]")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")


def forms(word: str) -> list[str]:
    """A lower-case word without punctuation at its ends, and, if it holds some, without any."""
    if word.isalnum():
        return [word]
    plain = _EDGE.sub("", word)
    joined = _INNER.sub("", plain)
    return [w for w in dict.fromkeys((plain, joined)) if w]


def tolerances(terms: list[str]) -> list[int]:
    """Errors that each term tolerates.  Beginnings, and terms of a family (two others begin
    with the same four letters), stand for many words already and tolerate none."""
    family = Counter(t[:MIN_PREFIX] for t in terms)
    return [0 if t.endswith("*") or family[t[:MIN_PREFIX]] > 2 or len(t) < ONE_ERROR else 1 if len(t) < TWO_ERRORS else 2 for t in terms]


class LexiconAutomaton:
    """Trie of terms (a term that ends in ``*`` matches all words it begins) times Levenshtein
    automata.  A state is a set of (node, errors, swap); states and steps are made as
    they are needed and kept."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.errors = tolerances(terms)
        self.child: list[dict[str, int]] = [{}]
        self.final: dict[int, int] = {}
        self.most = [0]  # errors that some term below a node tolerates
        for k, term in enumerate(terms):
            stem, node, errors = term.rstrip("*"), 0, self.errors[k]
            self.most[0] = max(self.most[0], errors)
            for c in stem:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.most.append(0)
                node = self.child[node][c]
                self.most[node] = max(self.most[node], errors)
            self.final[node] = k
        self.sets: list[frozenset] = []
        self.ids: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.open: list[tuple[int, int] | None] = []   # match if the word ends here
        self.stem: list[tuple[int, int] | None] = []   # match whatever follows
        self.start = self._state(self._closed({(0, 0, "")}))

    def _forget(self, states: frozenset) -> int:
        """Empties the tables in place and makes the start and one more state again."""
        for made in (self.ids, self.sets, self.steps, self.open, self.stem):
            made.clear()
        self.start = self._state(self._closed({(0, 0, "")}))
        return self._state(states)

    def _closed(self, states: set) -> frozenset:
        todo = list(states)
        while todo:
            node, e, swap = todo.pop()
            if swap:
                continue
            for v in self.child[node].values():  # a letter of the term is missing
                if e < self.most[v] and (v, e + 1, "") not in states:
                    states.add((v, e + 1, ""))
                    todo.append((v, e + 1, ""))
        return frozenset(states)

    def _state(self, states: frozenset) -> int:
        if states not in self.ids:
            self.ids[states] = len(self.sets)
            self.sets.append(states)
            self.steps.append({})
            ends = sorted((e, self.final[n]) for n, e, swap in states if not swap and n in self.final
                          and e <= self.errors[self.final[n]])
            self.open.append(next(((k, e) for e, k in ends), None))
            self.stem.append(next(((k, e) for e, k in ends if self.terms[k].endswith("*")), None))
        return self.ids[states]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e, swap in self.sets[state]:
            if swap:  # the second of two swapped letters
                if c == swap[0] and (v := self.child[node].get(c)) is not None and (w := self.child[v].get(swap[1])) is not None:
                    out.add((w, e, ""))
                continue
            if e < self.most[node]:
                out.add((node, e + 1, ""))
            for a, v in self.child[node].items():
                if a == c:
                    out.add((v, e, ""))
                elif e < self.most[v]:
                    out.add((v, e + 1, ""))
                    if c in self.child[v]:
                        out.add((node, e + 1, a + c))
        return self._state(self._closed(out)) if out else -1

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, errors) of the best match of a whole word."""
        state, best = self.start, None
        for c in word:
            steps = self.steps[state]
            nxt = steps.get(c)
            if nxt is None:
                if len(self.sets) > MAX_STATES:  # keep memory bounded: forget what can be made again
                    state = self._forget(self.sets[state])
                    steps = self.steps[state]
                nxt = steps[c] = self._step(state, c)
            if nxt < 0:
                return best
            state = nxt
            if (m := self.stem[state]) is not None and (best is None or m[1] < best[1]):
                best = m
        m = self.open[state]
        return m if m is not None and (best is None or m[1] < best[1]) else best


@dataclass
class ToxicityModel:
    terms: list[str] = field(default_factory=list)
    belief: dict[tuple[int, int], float] = field(default_factory=dict)  # by (term, errors)
    base_rate: float = 0.05


class _Matches(dict):
    """Matches of raw words, made on first use."""

    def __init__(self, terms: list[str]):
        self.automaton = LexiconAutomaton(terms)

    def __missing__(self, word: str):
        found = [m for w in forms(word) if (m := self.automaton.match(w)) is not None]
        best = min(found, key=lambda m: m[1]) if found else None
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = best
        return best


def context_weight(words: list[str], at: int) -> float:
    """Weight of a match at a position: 1 for plain use, less inside quotation, more in direct address."""
    before, after = words[max(0, at - WINDOW):at], words[at + 1:at + 1 + WINDOW]
    here = words[at]
    opened = sum(len(QUOTES.findall(w)) for w in before) + bool(QUOTES.match(here))
    closed = sum(len(QUOTES.findall(w)) for w in after) + bool(QUOTES.search(here[1:]))
    around = {w for x in before + after for w in forms(x)}
    quoted = opened % 2 == 1 and closed > 0
    weight = 1.0
    if quoted:
        weight *= 0.4 if around & REPORTING else 0.6
    elif around & REPORTING:
        weight *= 0.8
    return min(1.0, weight * (1.2 if around & ADDRESS else 1.0))


def text_score(words: list[str], matches: _Matches, model: ToxicityModel) -> tuple[float, int]:
    rest, n = 1.0 - model.base_rate, 0
    for at, m in enumerate(map(matches.__getitem__, words)):
        if m is not None:
            rest *= 1.0 - model.belief.get(m, 0.0) * context_weight(words, at)
            n += 1
    return 1.0 - rest, n


def _words(text: bytes | None) -> list[str]:
    return text.decode("utf-8", "replace").lower().split() if text else []


def _training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, held_out: int) -> DataFrame:
    """The sample: (text, toxic).  Copies by any of four min-hashes of word 5-grams count once."""
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
             .where(fold("__id", FOLDS) != held_out))
    pick = lambda toxic, n: known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("__id"), "__id").limit(n)
    sample = pick(1, TRAIN_TOXIC).unionByName(pick(0, TRAIN_CLEAN))
    rows = (docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
            .join(F.broadcast(sample), "__id").select("text", "toxic"))  # the sample's size is bounded above
    # a word 5-gram by its place among the text's words; min over grams, under four salts
    rows = rows.withColumn("__w", F.split(F.lower("text"), r"\s+"))
    rows = rows.withColumn("__g", F.expr("transform(sequence(0, greatest(0, size(__w) - 5)), i -> xxhash64(slice(__w, i + 1, 5)))"))
    for k in range(4):
        rows = rows.withColumn(f"__k{k}", F.expr(f"array_min(transform(__g, g -> xxhash64(g, {k})))"))
    rows = stored(rows.select("text", "toxic", *[f"__k{k}" for k in range(4)]), "toxicity-sample")
    for k in range(4):
        rows = rows.groupBy(f"__k{k}").agg(F.min_by(F.struct(*rows.columns), F.xxhash64("text")).alias("r")).select("r.*")
    return stored(rows.select("text", "toxic"), "toxicity-training")


def _term_counts(rows: DataFrame) -> DataFrame:
    """term, toxic texts, clean texts.  A term is a beginning, or a whole word with a final blank."""

    def task():
        counts: Counter = Counter()
        size = [0]  # characters of the terms counted, and a part for each

        def flush():
            size[0] = 0
            keys = list(counts)
            out = record_batch(["term", "t", "c"], pa.array([k for k, _ in keys], pa.string()),
                               pa.array([counts[k] if k[1] else 0 for k in keys], pa.int64()),
                               pa.array([0 if k[1] else counts[k] for k in keys], pa.int64()))
            counts.clear()
            return out

        def step(batch, texts):
            for text, toxic in zip(texts, batch.column("toxic").to_pylist()):
                seen = set()
                for w in {f for raw in set(_words(text)) for f in forms(raw)}:
                    # words shorter than a beginning count whole
                    seen.update(w[:n] for n in range(MIN_PREFIX, min(len(w), MAX_PREFIX) + 1))
                    seen.add(w + " ")
                for s in seen:
                    if (s, toxic) not in counts:
                        size[0] += len(s) + 64
                    counts[s, toxic] += 1
                if size[0] > MAX_COUNTED:
                    yield flush()

        step.end = lambda: iter([flush()]) if counts else iter(())
        return step

    return map_texts(rows, task, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def _chance(t: int, c: int, rate: float) -> float:
    """Probability of at least ``t`` toxic texts among ``t + c`` by chance, summed in logarithms."""
    n = t + c
    if t <= 0 or rate >= 1:
        return 1.0
    if rate <= 0:
        return 0.0
    whole, yes, no = lgamma(n + 1), log(rate), log1p(-rate)
    logs = [whole - lgamma(k + 1) - lgamma(n - k + 1) + k * yes + (n - k) * no for k in range(t, n + 1)]
    top = max(logs)
    return min(1.0, exp(top) * sum(exp(x - top) for x in logs))


def choose_terms(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> list[str]:
    """Significant terms, each as the longest form that still has most of the texts of the
    shortest; what branches into many endings stays a beginning (``stem*``)."""
    rate = toxic / max(1, toxic + clean)
    good = {s: t for s, (t, c) in counts.items() if c / max(1, clean) <= 0.02 * t / max(1, toxic) and _chance(t, c, rate) < SIGNIFICANCE}
    out = []
    for s in sorted(good, key=lambda s: (len(s), s)):
        if any(s[:n] in good for n in range(MIN_PREFIX, len(s))):
            continue
        node = s
        while not node.endswith(" "):
            longer = [x for x in good if len(x) == len(node) + 1 and x.startswith(node) and good[x] >= 0.85 * good[node]]
            if not longer:
                break
            node = max(longer, key=lambda x: (x.endswith(" "), good[x]))
        out.append(node[:-1] if node.endswith(" ") else node + "*")
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          held_out: int = 0) -> ToxicityModel:
    """Learns from labelled rows whose crc32(id) modulo ``FOLDS`` is not ``held_out``."""
    rows = _training_rows(docs, labels, id_col, text_col, label_col, held_out)
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic:
        return ToxicityModel(base_rate=1 / (clean + 20))
    # the terms that can be significant: at most as many as the bounded sample has
    found = _term_counts(rows).where((F.col("t") >= 3) & (F.col("c") * toxic <= 0.02 * clean * F.col("t"))).collect()
    terms = choose_terms({r["term"]: (r["t"], r["c"]) for r in found}, toxic, clean)

    def task():
        matches = _Matches(terms)

        def step(batch, texts):
            out = []
            for text, label in zip(texts, batch.column("toxic").to_pylist()):
                hits = {m for m in map(matches.__getitem__, set(_words(text))) if m is not None}
                exact = any(e == 0 for _, e in hits)
                # a misspelled form is evidence of its own only where no exact term stands
                out += [(k, e, label) for k, e in hits if e == 0 or not exact] or [(-1, 0, label)]
            yield record_batch(["term", "errors", "toxic"], *(pa.array(x, pa.int64()) for x in zip(*out)))

        return step

    seen = {(r["term"], r["errors"], r["toxic"]): r["n"] for r in map_texts(rows, task, "term long, errors long, toxic long")
            .groupBy("term", "errors", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    belief = {}
    for k, errors in enumerate(tolerances(terms)):
        for e in range(errors + 1):
            t, c = seen.get((k, e, 1), 0), seen.get((k, e, 0), 0)
            believed = (t + 4) / (t + c + 4.1) if e == 0 else (t + 3) / (t + c + 3 + e)
            belief[k, e] = believed if believed >= 0.5 else 0.0
    t, c = seen.get((-1, 0, 1), 0), seen.get((-1, 0, 0), 0)
    return ToxicityModel(terms, belief, min(0.4, (t + 1) / (t + c + 20)))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its ``keep`` columns) with ``score`` (0 to 1), ``predicted`` and ``n_matches``; columns of
    these names are replaced."""
    new = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_matches", T.IntegerType())]
    kept = [f for f in docs.schema.fields if f.name not in {x.name for x in new} and (keep is None or f.name in keep)]
    names = [f.name for f in kept]

    def task():
        matches = _Matches(model.terms)

        def step(batch, texts):
            got = [text_score(_words(t), matches, model) for t in texts]
            yield record_batch(names + [f.name for f in new], *[batch.column(n) for n in names],
                               pa.array([s for s, _ in got], pa.float64()), pa.array([int(s >= 0.5) for s, _ in got], pa.int32()),
                               pa.array([n for _, n in got], pa.int32()))

        return step

    return map_texts(docs, task, T.StructType(kept + new), text_col)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, model, keep=["doc_id"]).select(
        "doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", "predicted", "n_matches")
