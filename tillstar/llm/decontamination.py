r"""Operator 1: benchmark decontamination by latent semantic retrieval.

Words are taken with ASCII letters lower-cased and punctuation blank.  Items are a query
set: they go through in blocks of ``ITEM_BLOCK``, each block against all documents.  A
block's features are the words of its items that are informative in the corpus: in at
most ``COMMON`` of the documents, or among an item's ``RAREST`` rarest words.

1. One pass over all documents counts the block's words (document frequencies, idf).
2. A second pass cuts all documents into passages of ``PASSAGE`` words and sums Y = A'A O for
   the tf-idf matrix A of passages and features and a random O (features x rank): the
   randomised (Nystroem) singular value decomposition of A follows on the driver from Y.
3. A third pass maps windows of every document, as long as the items and at steps of
   ``BLOCK`` words, to the latent space (whitened by the singular values); windows with a
   cosine of ``MIN_COSINE`` or more to an item are candidates.

For candidates the longest common subsequence of words decides: ``SURE`` of the item's
words in order are a copy; from ``LIKELY`` on, a paraphrase if also ``ANSWER`` of the words
of the item's last sentence (its answer) and of the item's idf weight are there.
Items of under ``SHORT`` words must be there whole.

NULL and empty texts match nothing; NULL and empty items are ignored, an item without an id is
reported with a NULL id; an empty corpus gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, record_batch, table

RANK = 96
PASSAGE, BLOCK = 64, 8
COMMON, RAREST = 0.02, 8
# A window is looked at if it holds this share of the features of the piece with fewest.
MIN_COSINE, FILLED = 0.42, 0.35
SURE, LIKELY, ANSWER, SHORT = 0.8, 0.55, 0.6, 8
ITEM_BLOCK = 1024
# Windows (times RANK numbers) that are handled at once.
CHUNK = 1 << 14
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def _tokens(texts: list, features: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Features that occur in the texts, one after the other; their positions in words, with
    texts ``gap`` apart; where each text begins in these; the texts' words."""
    words = [words_of(t) for t in texts]
    gap = 32 * PASSAGE
    begins = np.cumsum([0] + [(-(-len(w) // PASSAGE)) * PASSAGE + gap for w in words])
    index = [np.fromiter(map(features.get, w, repeat(-1)), dtype=np.int32, count=len(w)) for w in words]
    at = [np.flatnonzero(x >= 0) for x in index]
    feature = np.concatenate([x[k] for x, k in zip(index, at)]) if words else np.zeros(0, np.int32)
    position = np.concatenate([k + b for k, b in zip(at, begins)]) if words else np.zeros(0, np.int64)
    return feature, position, begins, words


def _sums_by_feature(docs: DataFrame, text_col: str, features: dict[bytes, int], width: int, kind: str, add) -> DataFrame:
    """feature, v0..: ``add(sums, texts)`` adds to a features x width array; one row per feature
    and task enters the shuffle."""

    def task():
        sums = np.zeros((len(features), width))

        def step(batch, texts):
            add(sums, texts)
            return None

        def end():
            seen = np.flatnonzero(sums.any(axis=1))
            if len(seen):
                yield record_batch(["feature"] + [f"v{k}" for k in range(width)], pa.array(seen, pa.int32()),
                                   *(pa.array(sums[seen, k].astype(np.float32 if kind == "float" else np.float64)) for k in range(width)))

        step.end = end
        return step

    columns = [f"v{k}" for k in range(width)]
    rows = map_texts(docs.select(F.col(text_col).alias("text")), task, "feature int, " + ", ".join(f"{c} {kind}" for c in columns))
    return rows.groupBy("feature").agg(*[F.sum(c).alias(c) for c in columns])


def document_frequencies(docs: DataFrame, words: list[bytes], text_col: str = "text") -> np.ndarray:
    features = {w: k for k, w in enumerate(words)}

    def add(sums, texts):
        for t in texts:
            found = features.keys() & set(words_of(t))
            for w in found:
                sums[features[w], 0] += 1

    out = np.zeros(len(words))
    for r in _sums_by_feature(docs, text_col, features, 1, "double", add).collect():
        out[r[0]] = r[1]
    return out


def _omega(n: int) -> np.ndarray:
    return np.random.default_rng(20240229).standard_normal((n, RANK), dtype=np.float32)


def latent_space(docs: DataFrame, features: dict[bytes, int], idf: np.ndarray, text_col: str = "text") -> np.ndarray:
    """features x rank: a feature's whitened latent vector, times its idf.  The driver holds at most
    the block's words x RANK numbers."""
    weight = idf.astype(np.float32)
    made: dict[str, np.ndarray] = {}

    def add(sums, texts):
        if not made:
            made["omega"] = _omega(len(features)) * weight[:, None]
        omega = made["omega"]
        f, position, _, _ = _tokens(texts, features)
        for at in range(0, len(f), CHUNK):
            part, passage = f[at:at + CHUNK], position[at:at + CHUNK] // PASSAGE
            first = np.flatnonzero(np.diff(passage, prepend=-1))
            g = np.add.reduceat(omega[part], first, axis=0)[np.cumsum(np.diff(passage, prepend=passage[0]) > 0)]
            order = np.argsort(part, kind="stable")
            begin = np.flatnonzero(np.diff(part[order], prepend=-1))
            sums[part[order[begin]]] += np.add.reduceat(g[order], begin, axis=0)

    y = np.zeros((len(features), RANK))
    for r in _sums_by_feature(docs, text_col, features, RANK, "float", add).collect():
        y[r[0]] = r[1:]
    y *= idf[:, None]
    core = _omega(len(features)).astype(float).T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-9 * max(1e-300, values[-1])
    if not good.any() or values[-1] <= 0:  # none of the words is in the corpus: nothing can be found
        out = np.zeros((len(features), 1))
    else:  # as many directions as there are, also where the corpus has few
        half = y @ (vectors[:, good] / np.sqrt(values[good]))
        u, s, _ = np.linalg.svd(half, full_matrices=False)
        out = u / np.maximum(s, 1e-3 * s[0]) * idf[:, None]
    return (out / max(1e-300, np.abs(out).max())).astype(np.float32)


@dataclass
class Item:
    item_id: int
    words: list[bytes]
    answer: set[bytes]


def make_item(item_id, text: str) -> Item | None:
    words = words_of(text.encode())
    sentences = [s for s in re.split(r"[.?!\n]+", text) if words_of(s.encode())]
    return Item(item_id, words, set(words_of(sentences[-1].encode()))) if words else None


def lcs_length(a: list[bytes], b: list[bytes]) -> int:
    """Longest common subsequence, a row at a time as bits of an integer."""
    where: dict[bytes, int] = {}
    for k, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << k
    mask = (1 << len(a)) - 1
    row = mask
    for w in b:
        x = row & where.get(w, 0)
        row = ((row + x) | (row - x)) & mask
    return len(a) - row.bit_count()


def similarity(item: Item, words: list[bytes], idf: dict[bytes, float]) -> float:
    """Share of the item's words found in order, 0 if that is no copy or paraphrase."""
    there = set(words)
    if sum(w in there for w in item.words) < LIKELY * len(item.words):
        return 0.0
    ratio = lcs_length(item.words, words) / len(item.words)
    if ratio >= (SURE if len(item.words) >= SHORT else 1.0):
        return ratio
    if len(item.words) < SHORT or ratio < LIKELY or sum(w in there for w in item.answer) < ANSWER * len(item.answer):
        return 0.0
    weight = {w: idf[w] for w in item.words}
    return ratio if sum(v for w, v in weight.items() if w in there) >= ANSWER * sum(weight.values()) else 0.0


@dataclass
class Queries:
    """A block of items with its features and latent space."""

    items: list[Item]
    features: dict[bytes, int]
    idf: dict[bytes, float]
    space: np.ndarray

    def __post_init__(self):
        pieces = []
        for i, item in enumerate(self.items):
            for at in range(0, len(item.words), PASSAGE):
                piece = item.words[at:at + PASSAGE]
                rows = [self.features[w] for w in piece if w in self.features]
                v = self.space[rows].sum(0)
                if rows and (norm := np.linalg.norm(v)) > 0:
                    pieces.append((-(-(len(piece) + BLOCK - 1) // BLOCK), i, at, v / norm, len(rows)))
        # by blocks of a window: the pieces, their vectors, and how many features a window must have
        self.by_blocks = {b: ([p[1:3] for p in pieces if p[0] == b], np.array([p[3] for p in pieces if p[0] == b]).T,
                              max(1, int(FILLED * min(p[4] for p in pieces if p[0] == b)))) for b in sorted({p[0] for p in pieces})}

    def search(self, texts: list) -> list[dict[int, float]]:
        """For each text: item index -> similarity."""
        f, position, begins, words = _tokens(texts, self.features)
        found: list[dict[int, float]] = [{} for _ in texts]
        tried: set[tuple[int, int, int]] = set()
        block = position // BLOCK
        heads = np.flatnonzero(np.diff(block, prepend=-1))  # windows begin with a block that holds a feature
        longest = max(self.by_blocks, default=1)
        for at in range(0, len(heads), CHUNK):
            head = heads[at:at + CHUNK]
            low, high = head[0], np.searchsorted(block, block[head[-1]] + longest)
            line = np.zeros((high - low + 1, self.space.shape[1]))
            np.cumsum(self.space[f[low:high]], axis=0, out=line[1:])
            for blocks, (owners, vectors, least) in self.by_blocks.items():
                end = np.searchsorted(block, block[head] + blocks)
                full = end - head >= least
                start = head[full]
                window = (line[end[full] - low] - line[start - low]).astype(np.float32)
                norms = np.sqrt(np.einsum("ij,ij->i", window, window)) + 1e-9
                hits = np.argwhere(window @ vectors >= MIN_COSINE * norms[:, None])
                for h, q in hits.tolist():
                    first = int(block[start[h]]) * BLOCK
                    d = int(np.searchsorted(begins, first, side="right")) - 1
                    i, offset = owners[q]
                    self._verify(i, words[d], first - int(begins[d]) - offset, blocks, d, found, tried)
        return found

    def _verify(self, i, words, first, blocks, d, found, tried):
        item = self.items[i]
        # the window may begin with any feature of the item, and an item before it is partly common words
        begin = max(0, first - len(item.words) - BLOCK)
        if found[d].get(i, 0) >= 1 or (d, i, begin) in tried:
            return
        tried.add((d, i, begin))
        s = similarity(item, words[begin:max(0, first) + max(len(item.words), blocks * BLOCK) + BLOCK], self.idf)
        if s > found[d].get(i, 0):
            found[d][i] = s


def make_queries(docs: DataFrame, items: list[Item], text_col: str = "text") -> Queries:
    words = sorted({w for item in items for w in item.words})
    n = docs.count()
    df = document_frequencies(docs, words, text_col)
    idf = dict(zip(words, np.log((n + 1) / (df + 0.5)).clip(0.05)))
    count = dict(zip(words, df))
    keep = {w for w in words if count[w] <= COMMON * n}
    for item in items:
        keep.update(sorted(set(item.words), key=lambda w: (count[w], w))[:RAREST])
    features = {w: k for k, w in enumerate(sorted(keep))}
    return Queries(items, features, idf, latent_space(docs, features, np.array([idf[w] for w in sorted(keep)]), text_col))


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "item_id", item_col: str = "text", text_col: str = "text",
                       keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its ``keep`` columns) with ``contamination``: array<struct<item_id, similarity>>, by item.
    A column of that name is replaced."""
    found = T.StructField("contamination", T.ArrayType(T.StructType([
        T.StructField("item_id", items.schema[id_col].dataType), T.StructField("similarity", T.DoubleType())])))
    kept = [f for f in docs.schema.fields if f.name != "contamination" and (keep is None or f.name in keep or f.name == text_col)]
    schema = T.StructType(kept + [found])
    out = docs.select(*[f.name for f in kept]).withColumn("contamination", F.array().cast(found.dataType))
    block: list[Item] = []
    rows = items.where(F.col(item_col).isNotNull()).select(id_col, item_col).distinct().toLocalIterator()
    for r in rows:
        if (item := make_item(r[0], r[1])) is not None:
            block.append(item)
        if len(block) == ITEM_BLOCK:
            out, block = _search(out, make_queries(docs, block, text_col), schema, text_col), []
    if block:
        out = _search(out, make_queries(docs, block, text_col), schema, text_col)
    return out if keep is None or text_col in keep else out.drop(text_col)


def _search(docs: DataFrame, queries: Queries, schema: T.StructType, text_col: str) -> DataFrame:
    names = [f.name for f in schema.fields]

    def task():
        block = queries.items

        def step(batch, texts):
            hits = queries.search(texts)
            old = batch.column("contamination").to_pylist()
            new = [o + [{"item_id": block[i].item_id, "similarity": s} for i, s in sorted(h.items(), key=lambda x: (block[x[0]].item_id is not None, block[x[0]].item_id or 0))]
                   for o, h in zip(old, hits)]
            yield record_batch(names, *[batch.column(n) for n in names[:-1]], pa.array(new, batch.column("contamination").type))

        return step

    return map_texts(docs, task, schema, text_col)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return rows.select("doc_id", (F.size("contamination") > 0).alias("contaminated"),
                       F.size("contamination").cast("long").alias("n_items"),
                       F.array_join(F.transform(F.array_sort(F.transform("contamination", lambda c: c["item_id"])), lambda i: i.cast("string")), ",").alias("items"),
                       F.coalesce(F.array_max(F.transform("contamination", lambda c: c["similarity"])), F.lit(0.0)).alias("similarity"))
