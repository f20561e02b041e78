r"""Operator 11: near-duplicates by SimHash, with deletion-variant signatures.

A text's words are its runs of bytes other than space and U+0009..U+000D, A-Z lower-cased;
its shingles are runs of ``SHINGLE`` words, repeats included (fewer words: one shingle).
A bit of the 64-bit fingerprint is 1 if it is set in over half of the shingles'
XXH64 (seed 42) values.  Fingerprints link at ``DISTANCE`` or fewer differing bits.

1. One pass makes each row's fingerprint; from here on equal fingerprints are one.
2. A fingerprint is cut into ``DISTANCE // 2 + 1`` segments, so that of two linked ones some segment
   differs by one bit at most.  Each bit in turn is replaced by a wildcard and gives a
   signature: (bit, the rest of its segment).  Linked fingerprints share a signature.
3. Rows meet by signature (an equality join).  A signature of over ``BUCKET`` fingerprints is split by
   the same cut of the bits outside its segment, which loses no link; what is still over
   ``BUCKET`` after that goes in pairs of blocks, each pair one group of bounded size.
4. In a group the distance of all pairs is verified, except between fingerprints already
   connected there; only connecting links become rows, so dense groups of copies
   give about as many rows as they have members.  Components of the links follow.

Result: one row per document.  ``component_id`` is the least document id that can be reached (NULL ids
are passed over; NULL if there is no other).  NULL, empty and blank texts have
fingerprint zero and link like any other; repeated rows give repeated results; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_spread, map_texts, prepare, record_batch, release, stored, table
from .jaccard_join import components

SHINGLE, DISTANCE, SEED = 4, 4, 42
# Fingerprints of a group that are compared in one step, at most about.
BUCKET = 2048
# Rows (signature, fingerprint) that a task holds at once, about.
CHUNK_ROWS = 1 << 18
# Shingles of a text that are hashed in one step.
STEP_SHINGLES = 1 << 15
ALL_BITS = (1 << 64) - 1


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The text's fingerprint, as an unsigned number."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[:len(words) - shingle + 1], ends[shingle - 1:]
    ones = np.zeros(64, dtype=np.int64)
    hash_of = xxhash.xxh64_intdigest
    for at in range(0, len(first), STEP_SHINGLES):
        values = [hash_of(joined[a:b], SEED) for a, b in zip(first[at:at + STEP_SHINGLES].tolist(), last[at:at + STEP_SHINGLES].tolist())]
        octets = np.array(values, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row, its 64 bits as a signed number."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def task():
        def step(batch, texts):
            values = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
            yield record_batch(["doc_id", "fp"], batch.column("doc_id"), pa.array(values.view(np.int64)))

        return step

    return map_texts(rows, task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def segments(bits: list[int], distance: int) -> list[list[int]]:
    """``bits`` cut into even segments, the fewest with which one of them differs by at most one bit."""
    k = distance // 2 + 1
    at = [round(len(bits) * i / k) for i in range(k + 1)]
    return [bits[a:b] for a, b in zip(at, at[1:])]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def wildcards(distance: int, bits: list[int] | None = None) -> list[tuple[int, int]]:
    """(bit, mask of the rest of its segment) for each bit."""
    return [(b, _mask(s) & ~(1 << b)) for s in segments(list(range(64)) if bits is None else bits, distance) for b in s]


def _crowded(fps: DataFrame, distance: int, bucket: int) -> DataFrame:
    """(bit, value, outer) of the signatures that may have over ``bucket`` fingerprints.  A signature
    has two values of its segment, so one of them has over half of ``bucket``: the values
    are counted, of which there are at most 2^22 to a segment, however many rows."""
    cut = segments(list(range(64)), distance)
    values = fps.select(F.explode(F.array(*[F.struct(F.lit(k).alias("segment"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(s)))).alias("value"))
                                            for k, s in enumerate(cut)])).alias("at")).select("at.*")
    heavy = values.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket // 2)
    bits = F.coalesce(*[F.when(F.col("segment") == k, F.array(*map(F.lit, s))) for k, s in enumerate(cut)])
    flat = heavy.select("value", F.explode(bits).alias("bit"))
    return flat.select("bit", F.expr("value & ~shiftleft(1L, bit)").alias("value")).distinct()


def _groups(fps: DataFrame, distance: int, bucket: int) -> DataFrame:
    """(key, fp): fingerprints with the same key are to be compared; keys have about ``bucket`` rows at most.
    A key is the 64-bit hash of a signature: equal ones of different signatures only add candidates."""
    wild = wildcards(distance)
    crowded = stored(_crowded(fps, distance, bucket), "crowded")
    plain = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value"))
                                                 for b, m in wild])).alias("at")).select("fp", "at.*")
    if crowded.isEmpty():
        return plain.select(F.xxhash64("bit", "value").alias("key"), "fp")
    known = crowded.withColumn("crowded", F.lit(True))
    marked = plain.join(known, ["bit", "value"], "left")
    few = marked.where(F.col("crowded").isNull()).select(F.xxhash64("bit", "value").alias("key"), "fp")
    # the bits outside the segment differ by no more bits than the whole: cut them likewise
    finer = []
    for s in segments(list(range(64)), distance):
        outside = wildcards(distance, [b for b in range(64) if b not in s])
        finer.append(F.when(F.col("bit").isin(*s), F.array(*[F.xxhash64("bit", "value", F.lit(c), F.col("fp").bitwiseAND(F.lit(_signed(m))))
                                                             for c, m in outside])))
    finer = stored(marked.where("crowded").select("fp", F.explode(F.coalesce(*finer)).alias("key")), "finer")
    size = finer.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select(
        "key", F.ceil(F.col("n") / (bucket // 2)).cast("int").alias("blocks"))
    blocked = finer.join(stored(size, "blocks"), "key", "left")
    few = few.unionByName(blocked.where(F.col("blocks").isNull()).select("key", "fp"))
    mine = F.expr("cast(pmod(xxhash64(fp), blocks) as int)")
    pairs = blocked.where(F.col("blocks").isNotNull()).select("key", "fp", mine.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    return few.unionByName(pairs.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "fp"))


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the nodes ``a`` and ``b`` are connected pairwise."""
    while True:
        x, y = label[a], label[b]
        if np.array_equal(x, y):
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further


def connecting_links(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints with the same key (``keys`` sorted) that connect all that are linked."""
    again = keys[1:] == keys[:-1]
    in_group = np.append(again, False) | np.insert(again, 0, False)
    keys, fps = keys[in_group], fps[in_group]
    if not len(keys):
        return fps, fps
    names, node = np.unique(fps, return_inverse=True)
    label = np.arange(len(names))
    starts = np.flatnonzero(np.insert(keys[1:] != keys[:-1], 0, True))
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
    row, d = np.arange(len(keys)), 1
    left, right = [], []
    while True:
        row = row[row + d < len(keys)]
        row = row[keys[row] == keys[row + d]]
        if not len(row):
            break
        near = row[np.bitwise_count(fps[row] ^ fps[row + d]) <= distance]
        a, b = node[near], node[near + d]
        new = label[a] != label[b]
        if new.any():
            a, b = a[new], b[new]
            left.append(names[a])
            right.append(names[b])
            label = _unite(label, a, b)
        if d & (d - 1) == 0:  # now and then groups that are wholly connected drop out
            mine = label[node]
            whole = np.minimum.reduceat(mine, starts) == np.maximum.reduceat(mine, starts)
            row = row[~whole[group[row]]]
        d += 1
    empty = np.zeros(0, dtype=np.uint64)
    return np.concatenate(left or [empty]), np.concatenate(right or [empty])


def _links(groups: DataFrame, distance: int) -> DataFrame:
    """(u, v): links of each group that connect its linked fingerprints."""

    def found(keys, fps):
        u, v = connecting_links(keys, fps.view(np.uint64), distance)
        if len(u):
            yield record_batch(["u", "v"], pa.array(u.view(np.int64)), pa.array(v.view(np.int64)))

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append((batch.column("key").to_numpy(), batch.column("fp").to_numpy()))
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                keys, fps = (np.concatenate(c) for c in zip(*held))
                cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
                yield from found(keys[:cut], fps[:cut])
                held, rows = [(keys[cut:], fps[cut:])], len(keys) - cut
        if held:
            yield from found(*(np.concatenate(c) for c in zip(*held)))
        release()

    prepare(groups.sparkSession)
    return groups.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                       distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of each row."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    each = stored(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least")), "distinct-fingerprints")
    links = stored(_links(_groups(each.select("fp"), distance, bucket), distance), "fingerprint-links")
    label = components(links, "fingerprint-components")
    info = stored(each.join(label, F.col("fp") == F.col("node"), "left").select(
        "fp", "copies", "least", F.coalesce("label", "fp").alias("label")), "labelled-fingerprints")
    least = info.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = join_spread(info.select("fp", "copies", "label"), least, "label", "n")
    out = join_spread(rows, named.select("fp", "copies", "component_id"), "fp", "copies")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
