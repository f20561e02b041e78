r"""Operator 6: near-duplicate join on word n-grams with Bayesian pruning of candidates.

A text's set is its runs of ``SHINGLE`` words (runs of bytes other than space and
U+0009..U+000D); a text of fewer words is one run.  Two texts are linked if the Jaccard
similarity of their sets is ``THRESHOLD`` or more.

1. One pass makes each row's set digest and 128 MinHash values, kept as 32 band keys of
   four values.  Texts with equal sets are one class from here on.
2. Classes that share a band key are candidates: each bucket links its classes to its
   least one, and components of these links hold every pair that shares a key
   (a pair at the threshold has none with probability below 1e-7).
3. Components are cut into blocks by hash; each pair of blocks is one task's work, so a
   component of any size is many tasks of bounded size and no pair becomes a row.
   There MinHash values are compared 32 at a time, and a pair is dropped as soon as the
   posterior probability (uniform prior) that it reaches the threshold is below
   ``TOLERANCE``; the rest is verified exactly on the sets.
4. A task returns, for each class, its number of links and one edge to its group there;
   components of these edges are the groups.

Result: one row per document.  ``class_id`` is the least document id of its group and
``n_links`` the number of other documents linked to it directly, copies
included.  NULL and empty texts and those without words have no links and are groups of their own.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, record_batch, stored, table, unwrapped, whole_rows

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP, TOLERANCE = 32, 1e-9
# Classes and bytes of text in a block of a component, about.
BLOCK_CLASSES, BLOCK_BYTES = 256, 2 << 20
CACHE_WORDS = 1 << 16
_RANDOM = np.random.default_rng(7)
_A = (_RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
_B = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]
_MIX = _RANDOM.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


_WORD = _WordHash()


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted 64-bit hashes of the text's word runs; empty without words."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_WORD.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(SHINGLE, len(h))
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = (out ^ h[k:len(h) - size + 1 + k]) * _P
        out ^= out >> np.uint64(29)
    return np.unique(out)


def minhashes(values: np.ndarray) -> np.ndarray:
    x = (values >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(best, (_A * x[at:at + 4096] + _B).min(axis=1), out=best)
    return best


def band_keys(signature: np.ndarray) -> np.ndarray:
    s = signature.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    key = (s * _MIX).sum(axis=1, dtype=np.uint64) * _P
    return (key ^ (key >> np.uint64(31)) ^ np.arange(BANDS, dtype=np.uint64) * _MIX[0, 0]).view(np.int64)


def node_of(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def fewest_matches(compared: int) -> int:
    """Least number of equal values among ``compared`` with which the posterior probability of
    reaching the threshold (uniform prior: a binomial tail) is ``TOLERANCE`` or more."""
    tail, n = 0.0, compared + 1
    for m in range(n):
        tail += comb(n, m) * THRESHOLD**m * (1 - THRESHOLD) ** (n - m)
        if tail >= TOLERANCE:
            return m
    return compared


FEWEST = [(n, fewest_matches(n)) for n in range(STEP, HASHES + 1, STEP)]


def row_key(id_col: str, text_col: str) -> Column:
    """Names a row's id and text; equal only for repeated rows."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.coalesce(F.col(text_col), F.lit(""))).cast("binary"))


def _sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row_key"))

    def task():
        def step(batch, texts):
            nodes, sizes, bands = [], [], []
            for t in texts:
                s = shingles(t)
                nodes.append(node_of(s) if len(s) else None)
                sizes.append(len(t or b""))
                bands.append(band_keys(minhashes(s)) if len(s) else None)
            yield record_batch(["doc_id", "row_key", "node", "n_bytes", "bands"], batch.column("doc_id"), batch.column("row_key"),
                               pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())))

        return step

    return map_texts(rows, task, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, row_key string, node long, n_bytes long, bands array<long>")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label): the least node of each component of the edges (u, v), by alternating large
    and small stars; each round is a table, so lost executors cost one round."""
    e = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        e = stored(small, name)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            labels = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
            return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
        mark = now


def _candidate_edges(classes: DataFrame) -> DataFrame:
    keys = stored(classes.select("node", F.explode("bands").alias("key")), "bands")
    shared = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").drop("most")
    return keys.join(shared, "key").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))


def _links(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, links, root): one row for each class in each pair of blocks of its component."""
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("bytes")).select(
        "label", F.ceil(F.greatest(F.col("n") / BLOCK_CLASSES, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    texts = docs.select(row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    placed = (members.join(sizes, "label").withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
              .join(texts, "row_key").groupBy("label", "node", "blocks", "block", "copies").agg(F.any_value("text").alias("text")))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "text")
    keys = ["label", "i", "j"]

    def run(batches):
        group, rows = None, []
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("label", "i", "j", "block", "node", "copies")]
            texts = b.column("text").cast(pa.binary())
            for k, (label, i, j, block, node, copies) in enumerate(zip(*columns)):
                if (label, i, j) != group:
                    if group is not None:
                        yield from _compared(group, rows)
                    group, rows = (label, i, j), []
                rows.append((block, node, copies, texts[k].as_py()))
        if group is not None:
            yield from _compared(group, rows)

    return pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "node long, links long, root long")


def _compared(group, rows):
    """Links between the two blocks of a group (within the block if it is one)."""
    _, i, j = group
    left = [r for r in rows if r[0] == i]
    right = left if i == j else [r for r in rows if r[0] == j]
    if not left or not right or (i == j and len(left) < 2):
        return
    everyone = left if i == j else left + right
    sets = [shingles(r[3]) for r in everyone]
    signatures = np.array([minhashes(s) for s in sets])
    width = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(width)])
    first_right = 0 if i == j else len(left)
    mark = np.zeros(int(flat.max()) + 1, dtype=np.int32)
    copies = np.array([r[2] for r in everyone], dtype=np.int64)
    links = np.zeros(len(everyone), dtype=np.int64)
    root = list(range(len(everyone)))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x in range(len(left)):
        y = np.arange(max(first_right, x + 1 if i == j else 0), len(everyone))
        matches = np.zeros(len(y), dtype=np.int64)
        for n, fewest in FEWEST:
            if not len(y):
                break
            matches += (signatures[y, n - STEP:n] == signatures[x, n - STEP:n]).sum(axis=1)
            good = matches >= fewest
            y, matches = y[good], matches[good]
        if not len(y):
            continue
        mine = flat[starts[x]:starts[x + 1]]
        mark[mine] = 1
        both = np.array([mark[flat[starts[k]:starts[k + 1]]].sum() for k in y])
        mark[mine] = 0
        # exact: intersection / union >= 4/5 in whole numbers
        for k in y[5 * both >= 4 * (width[x] + width[y] - both)]:
            links[x] += copies[k]
            links[k] += copies[x]
            a, b = top(x), top(int(k))
            root[max(a, b)] = min(a, b)
    found = np.flatnonzero(links)
    if len(found):
        yield record_batch(["node", "links", "root"], pa.array([everyone[k][1] for k in found], pa.int64()),
                           pa.array(links[found]), pa.array([everyone[top(int(k))][1] for k in found], pa.int64()))


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row_key, group (NULL without words), n_links of each row."""
    rows = stored(_sketches(docs, id_col, text_col), "sketches")
    classes = stored(rows.where("node is not null").groupBy("node").agg(
        F.count(F.lit(1)).alias("copies"), F.min("row_key").alias("row_key"), F.min("n_bytes").alias("n_bytes"), F.any_value("bands").alias("bands")),
        "classes")
    coarse = components(_candidate_edges(classes), "candidates")
    members = stored(classes.drop("bands").join(coarse, "node"), "members")
    found = stored(_links(docs, members, id_col, text_col), "links")
    groups = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), "groups")
    info = classes.select("node", "copies").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(groups, "node", "left")
    info = info.select(F.col("node").alias("n"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                       F.coalesce("label", "node").alias("group"))
    return rows.select("doc_id", "row_key", "node").join(info, F.col("node") == F.col("n"), "left").select(
        "doc_id", "row_key", "group", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``class_id`` and ``n_links`` of each row."""
    rows = stored(_grouped(docs, id_col, text_col), "grouped")
    least = rows.where("group is not null").groupBy(F.col("group").alias("g")).agg(F.min("doc_id").alias("least"))
    return rows.join(least, F.col("group") == F.col("g"), "left").select("doc_id", F.when(F.col("group").isNull(), F.col("doc_id"))
                                                                         .otherwise(F.col("least")).alias("class_id"), "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group (the least id that is not NULL, then the least row key)
    and every row without words."""
    rows = _grouped(docs, id_col, text_col)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row_key"))
    keep = stored(rows.where("group is not null").groupBy("group").agg(F.min(first).alias("first")).select(F.col("first.row_key").alias("kept")), "kept")
    # texts without words have no set; of repeated rows of a group one stays
    words = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = whole_rows(docs, key=row_key(id_col, text_col), words=words)
    one = keyed.where("words").join(keep, F.col("key") == F.col("kept"), "left_semi").dropDuplicates(["key"])
    return unwrapped(one.unionByName(keyed.where(~F.col("words"))), docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))
