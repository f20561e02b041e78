r"""Operator 8: secrets by pattern and by password guess cost.

Base spans, leftmost and non-overlapping for each kind: ``assign`` (a credential name, a
separator and a value of 8 characters or more), ``access`` (cloud access keys) and
``hex`` (32 or more lower-case hex digits).

The method looks at values in credential contexts (a wider set of names and
separators; a rejected value may be the name of the next one) and estimates the guesses an attacker needs: dynamic programming finds the
cheapest cut of the value into dictionary words (letter case and look-alike digits
undone), dates, repeats, keyboard walks and sequences, and brute-force spans.  A
value over ``MIN_LOG10_GUESSES`` that no ``assign`` span covers is a ``credential`` span.

Positions are code points, end exclusive; spans are ordered by start, then by kind as
listed.  NULL text counts as empty and has no spans.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts, record_batch, table

KINDS = ("assign", "access", "hex", "credential")
MIN_LOG10_GUESSES = 9.0
# Longest piece of a cut; longer runs are several pieces.
MAX_PIECE = 48
# Words from a vocabulary file count by their rank there, up to this many.
DICTIONARY_WORDS = 20_000

_FLAGS = re.IGNORECASE | re.ASCII
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _FLAGS)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
HEX_BYTES = re.compile(rb"(?<![0-9a-f])[0-9a-f]{32}")
_NAME = (r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|bearer|api[_-]?key|"
         r"access[_-]?key|private[_-]?key|client[_-]?secret|auth(?:orization)?)")
CONTEXT = re.compile(rf"""(?<![A-Za-z0-9]){_NAME}["']?"""
                     r"""(?:\x20{0,3}(?::=|=>|[:=])\x20{0,3}|\x20is\x20|\x20)["']?([^\s"']{6,})""", _FLAGS)
# A proposed value that is only the next credential name.
NAME_ALONE = re.compile(rf"{_NAME}[:=>]*", _FLAGS)
# Every context and assign name contains one of these.
NAMES = (b"pass", b"pwd", b"secret", b"token", b"credential", b"bearer", b"key", b"auth")

# The most common passwords, most common first.
COMMON = ("123456 password 123456789 12345678 12345 qwerty 1234567 111111 123123 abc123 password1 iloveyou admin "
          "welcome monkey login letmein dragon master sunshine princess football shadow superman trustno1 hello "
          "changeme secret default root test guest user example placeholder").split()
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LOOK_ALIKE = str.maketrans("043157$@!", "oaeistsai")
DATE = re.compile(r"(?:(?:19|20)\d\d(?:[-/._]?)(?:0?[1-9]|1[0-2])(?:[-/._]?)(?:0?[1-9]|[12]\d|3[01])"
                  r"|(?:0?[1-9]|[12]\d|3[01])(?:[-/._]?)(?:0?[1-9]|1[0-2])(?:[-/._]?)(?:19|20)\d\d|(?:19|20)\d\d)")


def _keyboard() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for r, row in enumerate(KEY_ROWS):
        for k, c in enumerate(row):
            near[c] = {KEY_ROWS[y][x] for y, x in ((r, k - 1), (r, k + 1), (r - 1, k), (r - 1, k + 1), (r + 1, k - 1), (r + 1, k))
                       if 0 <= y < len(KEY_ROWS) and 0 <= x < len(KEY_ROWS[y])}
    return near


NEAR = _keyboard()


@lru_cache(maxsize=4)
def dictionary(path: str) -> dict[str, int]:
    """Words and their ranks: the common passwords, then the letter pieces of a vocabulary
    file in its order (a byte-level vocabulary lists frequent pieces first)."""
    ranks = {w: k + 1 for k, w in enumerate(COMMON)}
    with open(path, encoding="utf-8") as f:
        pieces = json.load(f)["model"]["vocab"]
    for piece in sorted(pieces, key=pieces.get):
        word = piece.lstrip("Ġ").lower()
        if len(word) >= 3 and word.isascii() and word.isalpha() and len(ranks) < DICTIONARY_WORDS:
            ranks.setdefault(word, len(ranks) + 1)
    return ranks


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() else 33


class _Runs:
    """Ends of the repeats, keyboard walks and runs of code points that begin at the starts of a value, asked
    for from left to right.  A run is followed to its end once and serves all starts in it."""

    def __init__(self, value: str):
        self.value, self.low, self.n = value, value.lower(), len(value)
        if len(self.low) != self.n:  # (a few letters have two small ones)
            self.low = "".join(c.lower()[:1] or c for c in value)
        self.period = [(0, 0)] * 9      # for each size: (start, end) of the last run with that period
        self.walked, self.counted = (0, 0), (0, 0)
        steps = [0] + [ord(b) - ord(a) for a, b in zip(self.low, self.low[1:])]
        self.turns = [0] * (self.n + 1)  # changes of direction before a place
        for k in range(2, self.n):
            self.turns[k] = self.turns[k - 1] + (steps[k] != steps[k - 1])

    def repeat(self, start: int, size: int) -> int:
        """End of the whole repeats of the ``size`` characters at ``start``."""
        first, end = self.period[size]
        if not first <= start or start + size > end:
            end = min(self.n, start + size)
            while end < self.n and self.value[end] == self.value[end - size]:
                end += 1
            self.period[size] = (start, end)
        return start + (end - start) // size * size

    def walk(self, start: int) -> tuple[int, int]:
        """End and turns of the keyboard walk at ``start``."""
        first, end = self.walked
        if not first <= start < end:
            end = start + 1
            while end < self.n and self.low[end] in NEAR.get(self.low[end - 1], ()):
                end += 1
            self.walked = (start, end)
        return end, 1 + (self.turns[end - 1] - self.turns[start + 1] if end - start > 2 else 0)

    def count(self, start: int) -> int:
        """Last character of the run of rising or falling code points at ``start``."""
        value, (first, end) = self.value, self.counted
        if not first <= start < end:
            end = start + 1
            while end + 1 < self.n and abs(ord(value[end]) - ord(value[end - 1])) == 1 and \
                    ord(value[end]) - ord(value[end - 1]) == ord(value[end + 1]) - ord(value[end]):
                end += 1
            self.counted = (start, end)
        return end


def _pieces(value: str, words: dict[str, int], start: int, runs: _Runs | None = None):
    """(end, log10 guesses) of the pieces that begin at ``start``, brute-force ones last."""
    runs = runs or _Runs(value)
    n, low = runs.n, runs.low
    for end in range(start + 3, min(n, start + MAX_PIECE) + 1):
        raw = low[start:end]
        for word, extra in ((raw, 0.0), (raw.translate(LOOK_ALIKE), 0.6)):
            if word in words and (extra == 0 or word != raw):
                upper = sum(c.isupper() for c in value[start:end])
                case = 0.0 if not upper else 0.3 if upper in (1, end - start) else math.log10(math.comb(end - start, min(upper, (end - start) // 2)) + 1)
                yield end, math.log10(words[word]) + extra + case
    if m := DATE.match(value, start):
        yield m.end(), math.log10(365.0 * 60 if m.end() - start > 4 else 120)
    # repeats of 1..8 characters
    for size in range(1, min(8, n - start) + 1):
        end = runs.repeat(start, size)
        if end >= start + max(2 * size, 3):
            yield end, sum(math.log10(_alphabet(c)) for c in value[start:start + size]) + math.log10((end - start) / size)
    # walks on the keyboard and runs of code points
    end, turns = runs.walk(start)
    if end - start >= 4:
        yield end, math.log10(47) + turns * math.log10(4.6) + math.log10(end - start)
    end = runs.count(start)
    if end - start >= 2:
        yield end + 1, math.log10(_alphabet(value[start]) * 2) + math.log10(end + 1 - start)
    cost = 0.0
    for end in range(start + 1, min(n, start + MAX_PIECE) + 1):
        cost += math.log10(_alphabet(value[end - 1]))
        yield end, cost


def log10_guesses(value: str, words: dict[str, int], enough: float = math.inf) -> float:
    """Cost of the cheapest cut; each piece adds log10 of 5, the kinds to try.  Stops with a
    lower bound once every state within reach costs ``enough``; states that do lead nowhere cheaper."""
    n, runs = len(value), _Runs(value)
    best = [math.inf] * (n + 1)
    best[0] = 0.0
    cheap = 1  # states from here on that cost less than enough
    for i in range(n):
        if not cheap:
            return enough
        if best[i] >= enough:
            continue
        cheap -= 1
        for end, cost in _pieces(value, words, i, runs):
            if (total := best[i] + cost + math.log10(5)) < best[end]:
                cheap += total < enough <= best[end]
                best[end] = total
    return best[n]


def spans_of(text: str, words: dict[str, int], threshold: float = MIN_LOG10_GUESSES) -> list[tuple[int, int, str]]:
    """(start, end, kind) of one text, in order."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    assigned = list(out)
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    at = 0
    while m := CONTEXT.search(text, at):
        at = m.start(1)  # a rejected value may itself be the name before the real one
        start, value = m.start(1), m[1].rstrip(".,;:!?)]}>")
        end = start + len(value)
        # a plain word after a blank is prose, not a value
        plain = text[m.end(0) - len(m[1]) - 1] == " " and value.isalpha() and not re.search("[:=]", m[0][: m.start(1) - m.start()])
        if len(value) < 6 or plain or NAME_ALONE.fullmatch(value) or any(s < end and start < e for s, e, _ in assigned):
            continue
        if log10_guesses(value, words, threshold) >= threshold:
            out.append((start, end, "credential"))
            at = m.end()
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def may_have_secret(text: bytes) -> bool:
    """False only if the text has no span of any kind."""
    if b"AKIA" in text or HEX_BYTES.search(text):
        return True
    low = text.lower()
    return any(name in low for name in NAMES)


def _vocabulary_path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")
    return path


def _scan(docs: DataFrame, text_col: str, make, fields: list[T.StructField], keep: list[str], words: dict[str, int]) -> DataFrame:
    """``keep`` columns of ``docs`` and ``fields``, whose values ``make(text, spans)`` returns as a tuple."""
    names = [f.name for f in fields]
    schema = T.StructType([f for f in docs.schema.fields if f.name in keep and f.name not in names] + fields)
    types = [pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
             if isinstance(f.dataType, T.ArrayType) else pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in fields]
    first = [f.name for f in schema.fields if f.name not in names]

    def task():
        def step(batch, texts):
            values = []
            for t in texts:
                if t is None or not may_have_secret(t):
                    values.append(make(None, []))
                else:
                    s = t.decode("utf-8", "replace")
                    values.append(make(s, spans_of(s, words)))
            plain = batch.column(text_col)
            columns = []
            for k, kind in enumerate(types):
                made = [v[k] for v in values]
                if names[k] == text_col:  # texts without spans stay as they are
                    made = [p if m is None else m for p, m in zip(plain.to_pylist(), made)]
                columns.append(pa.array(made, kind))
            yield record_batch(first + names, *[batch.column(c) for c in first], *columns)

        return step

    return map_texts(docs, task, schema, text_col)


def find_secrets(docs: DataFrame, text_col: str = "text", out: str = "secrets", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with ``out``: array<struct<kind, start, end>> (a column of that name is replaced)."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    make = lambda text, spans: ([{"kind": k, "start": s, "end": e} for s, e, k in spans],)
    return _scan(docs, text_col, make, [T.StructField(out, T.ArrayType(span))], docs.columns, dictionary(_vocabulary_path(vocabulary)))


def _masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], "[secret]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with each secret of the text replaced by ``[secret]``; nothing else changes."""
    make = lambda text, spans: (_masked(text, spans) if spans else None,)
    rows = _scan(docs, text_col, make, [T.StructField(text_col, T.StringType())], docs.columns, dictionary(_vocabulary_path(vocabulary)))
    return rows.select(*docs.columns)


def digest_row(spans: list[tuple[int, int, str]]) -> tuple:
    joined = lambda kinds: ",".join(f"{k}:{s}:{e}" for s, e, k in spans if k in kinds)
    counts = tuple(sum(k == kind for _, _, k in spans) for kind in KINDS[:3])
    return *counts, hashlib.sha256(joined(KINDS[:3]).encode()).hexdigest(), joined(KINDS)


def query(spark, sf_dir: str) -> DataFrame:
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]]
    fields += [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _scan(docs, "text", lambda text, spans: digest_row(spans), fields, ["doc_id"], dictionary(_vocabulary_path(None)))
