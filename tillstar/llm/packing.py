r"""Operator 10: packing by minimum bin slack.

A document's tokens are its ids by the byte-level vocabulary and a closing id 0.  Each
full window of tokens is a sequence of its own; what remains (under one window) is
packed.  Remainders are counted by length: at most ``window - 1`` numbers,
however many documents there are.  For each new sequence the longest remaining length
is taken, and subset-sum dynamic programming over the remaining multiset (sets of
reachable sums as bits of an integer, counts split into powers of two) finds the
multiset that fills the window closest to capacity; backtracking gives its
counts.  The multiset is used as often as the counts allow, so the plan has few rows
and comes from the counts alone.

Where no multiset fills a window exactly, remainders are laid end to end and cut at window
ends; the last incomplete window is cut into powers of two, which need no padding.

Places follow from a remainder's length and its rank among those of that length.
Ranks are counted within each task that tokenizes and shifted by the counts of
earlier tasks, so no length's remainders meet in one task.

NULL text counts as empty: one token, id 0.  Rows of an empty table: none.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, map_texts, record_batch, stored, table

WINDOW = 1024
END_ID = 0
_WORKER: dict = {}


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def _encoder(ranks: bytes, pattern: str):
    key = (hashlib.sha256(ranks).digest(), pattern)
    if _WORKER.get("key") != key:
        import tiktoken

        table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _WORKER.update(key=key, encoder=tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=table_, special_tokens={}))
    return _WORKER["encoder"]


def tokenized(docs: DataFrame, ranks: bytes, pattern: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: tokens, crc32 of each full window and of the remainder, the
    remainder's ids, the task that made the row (``part``), its number there (``row``),
    the number of earlier remainders of the same length there (``nth``) and of
    earlier full windows (``full_at``)."""
    rows = id_and_text(docs, id_col, text_col)

    def task():
        from pyspark import TaskContext

        encoder, part = _encoder(ranks, pattern), TaskContext.get().partitionId()
        seen: Counter = Counter()
        state = {"row": 0, "full": 0}

        def step(batch, texts):
            out: list[list] = [[] for _ in range(8)]
            for t in texts:
                ids = np.append(encoder.encode_to_numpy(t.decode("utf-8", "replace"), disallowed_special=()), END_ID).astype("<u4")
                n = len(ids)
                full = [crc(ids[k:k + window]) for k in range(0, n - window + 1, window)]
                rest = ids[n - n % window:]
                values = (n, full, len(rest), crc(rest), rest.astype("<u2").tobytes(), state["row"], seen[len(rest)], state["full"])
                for column, v in zip(out, values):
                    column.append(v)
                seen[len(rest)] += 1
                state["row"] += 1
                state["full"] += len(full)
            yield record_batch(["doc_id", "doc_tokens", "full", "rest", "rest_crc", "rest_ids", "part", "row", "nth", "full_at"],
                               batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64())),
                               pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary()),
                               pa.array([part] * len(texts), pa.int64()), *(pa.array(c, pa.int64()) for c in out[5:]))

        return step

    return map_texts(rows, task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, doc_tokens long, full array<long>, rest long, "
                                 "rest_crc long, rest_ids binary, part long, row long, nth long, full_at long")


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum is closest to ``capacity`` from below."""
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted((n for n in counts if n <= capacity), reverse=True):
        left, chunk = min(counts[length], capacity // length), 1
        while left > 0 and not reach >> capacity & 1:
            take = min(chunk, left)
            more = reach | (reach << (length * take)) & mask
            if more != reach:
                steps.append((length, take, reach))
                reach = more
            left, chunk = left - take, chunk * 2
        if reach >> capacity & 1:
            break
    total, out = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            out[length] += take
            total -= length * take
    return dict(out)


@dataclass
class Plan:
    """``slots``: rows (length, from rank, to rank, first sequence, sequences, offset): the remainders of
    a length with these ranks go, round after round, to these sequences at this
    offset (further rounds follow each other).  ``loose``: length -> (from rank, start in the line of loose remainders)."""

    slots: list[tuple[int, int, int, int, int, int]]
    loose: dict[int, tuple[int, int]]
    sequences: int
    loose_tokens: int


def plan(counts: dict[int, int], window: int = WINDOW) -> Plan:
    left = {n: c for n, c in counts.items() if c > 0 and n > 0}
    used: Counter = Counter()
    slots, loose, sequences = [], Counter(), 0
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        chosen = Counter(best_fill({n: c for n, c in rest.items() if c > 0}, window - longest))
        chosen[longest] += 1
        times = min(left[n] // k for n, k in chosen.items())
        if sum(n * k for n, k in chosen.items()) == window:
            offset = 0
            for n in sorted(chosen, reverse=True):
                slots.append((n, used[n], used[n] + chosen[n] * times, sequences, times, offset))
                used[n] += chosen[n] * times
                offset += n * chosen[n]
            sequences += times
        else:
            for n, k in chosen.items():
                loose[n] += k * times
        for n, k in chosen.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    starts, at = {}, 0
    for n in sorted(loose, reverse=True):  # loose remainders of a length have its last ranks
        starts[n] = (used[n], at)
        at += n * loose[n]
    return Plan(slots, starts, sequences, at)


def cuts(start: int, length: int, total: int, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(sequence in the line, offset there, length) of the pieces of a remainder that begins at
    ``start`` of a line of ``total`` tokens."""
    whole = total // window
    ends = [window * (k + 1) for k in range(start // window, whole)] if start < whole * window else []
    ends = [e for e in ends if e - window < start + length]
    tail, at = [], whole * window
    for bit in range(window.bit_length(), -1, -1):
        if (total - whole * window) >> bit & 1:
            tail.append((at, 1 << bit))
            at += 1 << bit
    out, begin = [], start
    for e in ends:
        stop = min(e, start + length)
        if stop > begin:
            out.append((begin // window, begin % window, stop - begin))
            begin = stop
    for k, (first, size) in enumerate(tail):
        lo, hi = max(begin, first), min(start + length, first + size)
        if hi > lo:
            out.append((whole + k, lo - first, hi - lo))
            begin = hi
    return out


def _places(rows: DataFrame, layout: Plan) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to remainders (length ``rest``, rank ``rank``); loose ones get
    NULL there and ``line``, their start in the line."""
    by_length: dict[int, np.ndarray] = {}
    for slot in layout.slots:
        by_length.setdefault(slot[0], []).append(slot[1:])
    by_length = {n: np.array(sorted(s), dtype=np.int64) for n, s in by_length.items()}
    loose = layout.loose
    schema = "doc_id {}, doc_tokens long, rest long, rest_crc long, part long, row long, sequence_id long, offset long, line long".format(
        rows.schema["doc_id"].dataType.simpleString())
    names = ["doc_id", "doc_tokens", "rest", "rest_crc", "part", "row"]

    def run(batches):
        for b in batches:
            length, rank = b.column("rest").to_numpy(), b.column("rank").to_numpy()
            seq, off, line = (np.full(len(length), -1, dtype=np.int64) for _ in range(3))
            for n in np.unique(length):
                here = np.flatnonzero(length == n)
                r = rank[here]
                if int(n) in loose:
                    first, at = loose[int(n)]
                    line[here] = np.where(r >= first, at + (r - first) * n, -1)
                if int(n) in by_length:
                    s = by_length[int(n)]
                    k = np.searchsorted(s[:, 0], r, side="right") - 1
                    t = r - s[k, 0]
                    inside = line[here] < 0
                    seq[here] = np.where(inside, s[k, 2] + t % s[k, 3], -1)
                    off[here] = np.where(inside, s[k, 4] + (t // s[k, 3]) * n, -1)
            yield record_batch(names + ["sequence_id", "offset", "line"], *[b.column(c) for c in names],
                               *[pa.array(v, mask=v < 0) for v in (seq, off, line)])

    return rows.select(*names, "rank").mapInArrow(run, schema)


def pack(docs: DataFrame, ranks: bytes, pattern: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    ``ranks``: the vocabulary file's content (at most 65,536 ids), ``pattern``: its pre-token pattern."""
    rows = stored(tokenized(docs, ranks, pattern, window, id_col, text_col), "tokens")
    parts = rows.where(F.col("rest") > 0).groupBy("rest", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "remainders")
    counts = {r["rest"]: r["n"] for r in parts.groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # under `window` rows
    layout = plan(counts, window)
    ranked = (rows.where(F.col("rest") > 0).drop("full", "rest_ids", "full_at")
              .join(parts.drop("n"), ["rest", "part"]).withColumn("rank", F.col("before") + F.col("nth")))
    placed = _places(ranked, layout)
    if layout.loose:
        placed = stored(placed, "places")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    # packed sequences have numbers under 2^33; those of full windows carry their task above that
    full = rows.select("doc_id", "doc_tokens", "part", "full_at", F.posexplode("full").alias("k", "ids_crc32")).select(
        "doc_id", (F.col("k").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.shiftleft(F.col("part") + 1, 33) + F.col("full_at") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    whole = placed.where(F.col("line").isNull()).select(
        "doc_id", (F.col("doc_tokens") - F.col("rest")).alias("start"), F.col("rest").alias("length"), F.col("rest_crc").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset")
    out = full.select(*columns).unionByName(whole.select(*columns))
    if layout.loose:
        loose = stored(placed.where(F.col("line").isNotNull()).select("part", "row", "line"), "loose")
        cut = _cut_pieces(rows.join(loose, ["part", "row"]), layout, window)
        out = out.unionByName(cut.select(*columns))
    return out


def _cut_pieces(rows: DataFrame, layout: Plan, window: int) -> DataFrame:
    total, base = layout.loose_tokens, layout.sequences
    schema = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long".format(
        rows.schema["doc_id"].dataType.simpleString())

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            index = []
            for i, (n, ids, line) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc_tokens", "rest_ids", "line")))):
                ids = np.frombuffer(ids, dtype="<u2")
                at = 0
                for seq, off, length in cuts(line, len(ids), total, window):
                    index.append(i)
                    for column, v in zip(out, (n - len(ids) + at, length, crc(ids[at:at + length]), n, base + seq, off)):
                        column.append(v)
                    at += length
            yield record_batch(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                               b.column("doc_id").take(pa.array(index, pa.int64())), *(pa.array(c, pa.int64()) for c in out))

    return rows.select("doc_id", "doc_tokens", "rest_ids", "line").mapInArrow(run, schema)


def vocabulary(path: str | None = None) -> tuple[bytes, str]:
    """Content of a rank file and the pre-token pattern."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), *vocabulary())
