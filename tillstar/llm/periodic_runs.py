r"""Operator 12: periodic runs of words, by an online sparse diagonal dynamic programme.

A text's words are its runs of bytes other than space and U+0009..U+000D, numbered from 0.  A run
is a stretch of consecutive words whose smallest period is ``q``, of length at least
``max(MIN_LENGTH, 2 * q)``, that no neighbouring word extends.

Words are read once, in order.  The diagonal of lag ``q`` holds how many of the last words equal the
word ``q`` before them.  Each word's earlier occurrences lengthen the active diagonals of their
lags or open new ones; a diagonal without an occurrence ends there, and if it is long
enough its run is emitted at once.

Two rules keep the diagonals sparse without losing a run:

- A run of period ``q`` has at least ``max(q, MIN_LENGTH - q)`` matches on its diagonal.  So an
  occurrence counts for lags ``m`` to ``2 * m - 1`` only if the last ``m`` words are equal, not the
  word alone.  Contexts of 1, 2, 4, ... words get names by pairing the names of their halves.
- While the last ``m`` words lie in a stretch of period ``p <= m / 2``, occurrences in that stretch have
  lags with a shorter period, whose diagonals begin and end with the stretch; they are passed over.

So a word repeated a million times opens one diagonal, not a million.

NULL, empty and blank texts have no words and no runs.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, map_texts, record_batch, table

MIN_LENGTH = 12
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _repeated(names: np.ndarray) -> np.ndarray:
    """Names from 0 by value; -1 for those that occur once or are negative."""
    out = np.full(len(names), -1, dtype=np.int64)
    valid = np.flatnonzero(names >= 0)
    _, name, count = np.unique(names[valid], return_inverse=True, return_counts=True)
    again = count[name] > 1
    out[valid[again]] = name[again]
    return out


def _longer(names: np.ndarray, by: int) -> np.ndarray:
    """Names of the contexts that end ``by`` words earlier and here, taken together."""
    out = np.full(len(names), -1, dtype=np.int64)
    if by < len(names):
        before, here = names[:-by], names[by:]
        out[by:] = np.where((before >= 0) & (here >= 0), before * len(names) + here, -1)
    return _repeated(out)


def contexts(ids: np.ndarray, min_length: int) -> list[tuple[int, int, int, np.ndarray]]:
    """(context, least lag, end of lags, names) by rising lag: what the last ``context`` words before
    and at each word are called (-1 where no other place has the same)."""
    least = max(1, -(-min_length // 2))
    names, m, out = _repeated(ids), 1, []
    while (names >= 0).any():
        if m < least < 2 * m:
            out.append((least, 1, 2 * m, _longer(names, least - m)))
        elif m >= least:
            out.append((m, 1 if m == least else m, 2 * m, names))
            if 4 * m > len(ids):
                break
        names, m = _longer(names, m), 2 * m
    return out


def _factors(q: int) -> list[int]:
    out, f = [], 2
    while f * f <= q:
        if q % f == 0:
            out.append(f)
            while q % f == 0:
                q //= f
        f += 1
    return out + [q] if q > 1 else out


def periodic_runs(words: list, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run, by start, then period."""
    if len(words) < min_length or len(words) < 2:
        return []
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    scales = contexts(ids, min_length)
    if not scales:
        return []
    runs: list[tuple[int, int, int]] = []

    def end(lag: int, first: int, last: int) -> None:
        # `first` to `last` equal the words `lag` before them
        start, length = first - lag, last - first + 1 + lag
        if length < max(min_length, 2 * lag):
            return
        one = ids[start:start + lag]
        if not any(np.array_equal(one, ids[start + lag // f:start + lag // f + lag]) for f in _factors(lag)):
            runs.append((start, length, lag))

    places = np.flatnonzero(scales[0][3] >= 0)
    columns = [(m, low, high, names[places].tolist(), {}) for m, low, high, names in scales]
    active: dict[int, int] = {}  # lag -> first word of the match
    last = -2
    for k, i in enumerate(places.tolist()):
        if i != last + 1 and active:
            for lag, first in active.items():
                end(lag, first, last)
            active = {}
        now: dict[int, int] = {}
        for m, low, high, names, seen in columns:
            name = names[k]
            if name < 0:
                break  # nor is any longer context found again
            earlier = seen.get(name)
            if earlier is None:
                seen[name] = [i]
                continue
            newest = i - low
            for p, first in now.items():  # shorter lags first
                if 2 * p > m:
                    break
                if first - p <= i - m + 1:
                    newest = min(newest, first - p + m - 2)
                    break
            at = bisect_right(earlier, newest) - 1
            while at >= 0 and i - earlier[at] < high:
                lag = i - earlier[at]
                now[lag] = active[lag] if lag in active else i - m + 1
                at -= 1
            earlier.append(i)
        for lag, first in active.items():
            if lag not in now:
                end(lag, first, i - 1)
        active, last = now, i
    for lag, first in active.items():
        end(lag, first, last)
    return sorted((s, n, q) for s, n, q in runs)


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that any run contains after its first ``period`` words."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    drop = np.cumsum(step[:-1]) > 0
    return [words[i] for i in np.flatnonzero(~drop).tolist()]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed`` (the
    text's words without periodic repeats, joined by one space) of each row.  Repeated rows
    give repeated results, a NULL id stays NULL, other columns are left out, an empty table
    gives no rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def task():
        def step(batch, texts):
            n_words, all_runs, rest = [], [], []
            for t in texts:
                words = t.split() if t else []
                runs = periodic_runs(words, min_length)
                n_words.append(len(words))
                all_runs.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                rest.append(b" ".join(collapsed(words, runs)))
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            yield record_batch(["doc_id", "n_words", "runs", "collapsed"], batch.column("doc_id"), pa.array(n_words, pa.int64()),
                               pa.array(all_runs, kind), pa.array(rest, pa.binary()).cast(pa.string()))

        return step

    return map_texts(rows, task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, where one text in ten (by crc32 of the id) is made periodic: with h the checksum,
    g = h div 10 and n words, word i >= a becomes word a + (i - a) mod p, for a = g mod n and
    p = 1 + (n - a) div (3 + g mod 8).  A NULL id changes nothing."""
    g = F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 10)
    chosen = F.col("doc_id").isNotNull() & (fold("doc_id", 10) == 0)
    rows = docs.select("doc_id", "text", g.alias("g"), F.when(chosen, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    rows = rows.withColumn("n", F.nullif(F.size("w"), F.lit(0))).withColumn("a", F.expr("cast(g % n as int)"))
    rows = rows.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    periodic = F.expr("array_join(concat(slice(w, 1, a), flatten(array_repeat(slice(w, a + 1, p), cast((n - a) div p as int))), "
                      "slice(w, a + 1, (n - a) % p)), ' ')")
    return rows.select("doc_id", F.when(F.col("w").isNotNull() & (F.size("w") > 0), periodic).otherwise(F.col("text")).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
                       (-F.col("best.period")).alias("period"), F.expr("best.length * 1000 div -best.period").alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256")
