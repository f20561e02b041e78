r"""Operator 13: Merkle manifest of a data set, with a witness for each row.

``H`` is the lowercase hex sha256 of its inputs one after the other, digests as hex text.  A row's
leaf is H of its fields, each ``-`` if NULL, else its length in UTF-8 bytes, ``:`` and its value
as text.  The leaves of a group (a source) ascend by id; while there are several nodes, each
``ARITY`` consecutive ones (the last run: fewer, even one) become their H.  The node that
remains is the group's subroot, and the subroots, in the order of their groups (NULL first,
UTF-8 bytes), give the root in the same way.  A row's witness lists for each level the
siblings to its left and right, so its leaf alone folds up to the root again.

1. One pass makes the leaves; only digests and ids are stored.
2. Leaves are dealt by ranges of (group, id), numbered within the ranges and shifted by the counts of
   earlier ranges, so a group with most of the rows is many ranges.
3. Blocks of ``ARITY ** BLOCK_LEVELS`` consecutive leaves are aligned with the tree.  A task appends a
   block's leaves one after the other: each new leaf, and each subtree that it completes, takes the
   open siblings before it into its own witnesses and extends theirs by its digest.
4. The blocks' roots are the leaves of the next tree, appended in the same way, until a group has one
   block; then the subroots are.  A row's witness is the chain of its blocks' witnesses.

Rows with the same group and id are ordered by leaf; equal rows are interchangeable.  A NULL id
comes first.  A NULL text has a leaf of its own, other than that of an empty one.  An empty
table gives no rows (and no root).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, join_spread, prepare, stored, table

ARITY, BLOCK_LEVELS = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WITNESS = "array<struct<left:binary,right:binary>>"


def digest_of(digests: bytes) -> bytes:
    """H of digests, given and returned as 32 bytes each."""
    return hashlib.sha256(digests.hex().encode()).digest()


class AppendOnlyTree:
    """A tree that grows by appending leaves and keeps the witness of each of them.

    ``open[level]`` holds the complete subtrees of a level that still wait for siblings, as
    (digest, members).  With ``levels`` the tree is raised through exactly that many
    levels (a block among others), else until one node is left."""

    def __init__(self, levels: int | None = None):
        self.levels, self.open, self.witnesses, self.root = levels, [], [], None

    def append(self, leaf: bytes) -> None:
        self.witnesses.append([])
        self._complete(0, leaf, [self.witnesses[-1]])

    def _complete(self, level: int, digest: bytes, members: list) -> None:
        if level == self.levels:
            self.root = digest
            return
        if level == len(self.open):
            self.open.append([])
        siblings = self.open[level]
        for _, others in siblings:  # a later sibling extends the witnesses of those before it
            for witness in others:
                witness[level][1] += digest
        left = b"".join(d for d, _ in siblings)
        for witness in members:
            witness.append([left, b""])
        siblings.append((digest, members))
        if len(siblings) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        siblings, self.open[level] = self.open[level], []
        self._complete(level + 1, digest_of(b"".join(d for d, _ in siblings)), [m for _, members in siblings for m in members])

    def finish(self) -> bytes:
        """Closes the incomplete subtrees, from the lowest, and returns the root."""
        level = 0
        while self.root is None:
            if self.levels is None and sum(map(len, self.open)) == 1:
                (self.root, members), = next(s for s in self.open if s)
                for witness in members:
                    witness.pop()
            elif self.open[level]:
                self._close(level)
                level += 1
            else:
                level += 1
        return self.root


def leaf(fields: list[Column]) -> Column:
    """The leaf of a row with these fields, as hex text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def folded(leaf_hex: Column, witness: Column) -> Column:
    """The root that a leaf (hex text) and a witness lead to."""
    return F.aggregate(witness, leaf_hex, lambda h, at: F.sha2(F.concat(F.lower(F.hex(at["left"])), h, F.lower(F.hex(at["right"]))), 256))


def proof(witness: Column) -> Column:
    """H of all siblings of a witness, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(witness, lambda at: F.lower(F.hex(F.concat(at["left"], at["right"])))), ""), 256)


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``index``, the rank of a row in its ``tree`` by ``order``, and ``n``, the rows of the tree.  ``rows``
    is stored; ranges also divide by row, so equal rows don't meet in one."""
    keyed = rows.withColumn("row", F.monotonically_increasing_id())
    keys = ["tree", *order, "row"]

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            nth = []
            for t in b.column("tree").to_pylist():
                nth.append(seen.get(t, 0))
                seen[t] = nth[-1] + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(nth), pa.int64()), pa.array(nth, pa.int64())],
                                             names=[*b.schema.names, "part", "nth"])

    prepare(rows.sparkSession)
    ranged = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("row")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    ranged = stored(ranged.mapInArrow(run, f"{schema}, part long, nth long"), f"{name}-ranges")
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a tree has at most one row here for each range, however many leaves
    counts = ranged.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.select(F.col("tree").alias("t"), F.col("part").alias("p"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"),
                           F.sum("c").over(whole).alias("n"))
    return (ranged.join(counts, (F.col("tree") == F.col("t")) & (F.col("part") == F.col("p")))
            .withColumn("index", F.col("before") + F.col("nth")).drop("t", "p", "part", "nth", "before"))


def _appended(nodes: DataFrame) -> DataFrame:
    """Adds ``witness`` within the block and ``block_root`` to nodes (tree, index, n, digest, ...)."""
    size = ARITY**BLOCK_LEVELS
    names = nodes.columns
    kind = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))

    def done(rows: pa.Table):
        trees, blocks, digests, counts = (rows.column(c).to_pylist() for c in ("tree", "block", "digest", "n"))
        witnesses, roots, start = [], [], 0
        while start < len(trees):
            growing, at = AppendOnlyTree(BLOCK_LEVELS if counts[start] > size else None), start
            while at < len(trees) and trees[at] == trees[start] and blocks[at] == blocks[start]:
                growing.append(digests[at])
                at += 1
            roots += [growing.finish()] * (at - start)
            witnesses += [[{"left": a, "right": b} for a, b in w] for w in growing.witnesses]
            start = at
        for k in range(0, len(trees), size):
            part = rows.slice(k, size).select(names).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(c.chunk(0) for c in part.columns), pa.array(witnesses[k:k + size], kind),
                                              pa.array(roots[k:k + size], pa.binary())], names=[*names, "witness", "block_root"])

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b])
            held = rows if held is None else pa.concat_tables([held, rows])
            trees, blocks = held.column("tree").to_pylist(), held.column("block").to_numpy()
            cut = len(trees) - 1  # the last block may go on
            while cut and trees[cut - 1] == trees[cut] and blocks[cut - 1] == blocks[cut]:
                cut -= 1
            if cut:
                yield from done(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield from done(held)

    prepare(nodes.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    dealt = nodes.withColumn("block", F.expr(f"index div {size}")).repartition("tree", "block").sortWithinPartitions("tree", "block", "index")
    return dealt.mapInArrow(run, f"{schema}, witness {WITNESS}, block_root binary")


def _witnessed(nodes: DataFrame, name: str) -> DataFrame:
    """Adds ``witness`` up to the root of the tree, and that ``root``, to nodes (tree, index, n, digest, ...)."""
    size = ARITY**BLOCK_LEVELS
    layer = stored(_appended(nodes), name)
    blocks = layer.where(f"index % {size} = 0 and n > {size}").select(
        "tree", F.expr(f"index div {size}").alias("index"), F.ceil(F.col("n") / size).alias("n"), F.col("block_root").alias("digest"))
    if blocks.isEmpty():
        return layer.withColumnRenamed("block_root", "root")
    above = _witnessed(blocks, name).select(F.col("tree").alias("t"), F.col("index").alias("b"), F.col("witness").alias("further"), "root")
    joined = layer.join(above, (F.col("tree") == F.col("t")) & (F.expr(f"index div {size}") == F.col("b")), "left")
    chain = F.when(F.col("further").isNull(), F.col("witness")).otherwise(F.concat("witness", "further"))
    return joined.select(*nodes.columns, chain.alias("witness"), F.coalesce("root", "block_root").alias("root"))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "source", id_col: str = "doc_id",
             keep: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``id``, ``leaf``, ``subroot`` and ``root`` (hex text), ``witness`` and
    the columns of ``keep`` (name -> expression).  Other columns are left out."""
    group = F.col(group_col).cast("string")
    kept = F.struct(F.col(id_col).alias("id"), *[c.alias(k) for k, c in (keep or {}).items()])
    # the marker before a name keeps the order of bytes and puts NULL first
    leaves = docs.select(F.coalesce(F.concat(F.lit("s"), group), F.lit("n")).alias("tree"), kept.alias("kept"),
                         F.unhex(leaf([F.col(c) for c in fields])).alias("digest"))
    leaves = stored(leaves.select("tree", F.col("kept.id").alias("id"), "digest", "kept"), "leaves")
    nodes = _numbered(leaves, ["id", "digest"], "leaves").drop("id")
    sources = stored(_witnessed(nodes, "leaf-witnesses"), "source-witnesses")
    subroots = stored(sources.where("index = 0").select(F.col("tree").alias("name"), "n", F.col("root").alias("digest")), "subroots")
    top = _witnessed(_numbered(subroots.select(F.lit("").alias("tree"), "name", "digest"), ["name"], "subroots"), "subroot-witnesses")
    above = top.select("name", F.col("witness").alias("above"), F.col("root").alias("top")).join(subroots.select("name", "n"), "name")
    rows = join_spread(sources.drop("n").withColumnRenamed("tree", "name"), above, "name", "n")
    return rows.select(F.col("kept.id").alias("id"), F.lower(F.hex("digest")).alias("leaf"), F.lower(F.hex("root")).alias("subroot"),
                       F.lower(F.hex("top")).alias("root"), F.concat("witness", "above").alias("witness"),
                       *[F.col("kept")[k].alias(k) for k in keep or {}])


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in FIELDS[:-1]] + [F.when(fold("doc_id", 2) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))]
    rows = manifest(docs, keep={"tampered": F.unhex(leaf(fields))})
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof(F.col("witness")).alias("proof_sha256"),
                       folded(F.lower(F.hex("tampered")), F.col("witness")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def _level(k: int, nodes: str, key: str) -> str:
    """SQL of one level: siblings of the nodes of level k, and the nodes of level k + 1."""
    return f"""
{nodes}_at{k} AS (
  SELECT *, coalesce(string_agg(h, '') OVER (PARTITION BY {key}, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (PARTITION BY {key}, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {nodes}{k}),
{nodes}{k + 1} AS (
  SELECT {key}, i // 3 AS i, (n + 2) // 3 AS n, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
  FROM {nodes}{k} GROUP BY {key}, i // 3, n),"""


def _fold(k: int, rows: str, nodes: str, key: str, at: str, first: str) -> str:
    return f"""
{rows}{k + 1} AS (
  SELECT x.* REPLACE (CASE WHEN s.n = 1 THEN x.f ELSE sha256(s.l || x.f || s.r) END AS f,
                      CASE WHEN s.n = 1 THEN x.proof ELSE x.proof || s.l || s.r END AS proof)
  FROM {first if k == 0 else f'{rows}{k}'} x JOIN {nodes}_at{k} s ON x.{key} = s.{key} AND x.{at} // {3 ** k} = s.i),"""


def _oracle(levels: int = 16, top_levels: int = 10) -> str:
    """The manifest in DuckDB, level by level: up to 3 ** levels rows of a source, 3 ** top_levels sources."""
    def field(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR END"

    others = " || ".join(field(c) for c in FIELDS[:-1])
    octets = "list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ascii(c)::BIGINT)"
    # the checksum's remainder of eight zero bits
    shifted = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {shifted}), 4294967295::BIGINT)"
    return f"""
WITH leaves AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS tree, sha256({others} || {field('text')}) AS leaf,
         sha256({others} || {field("replace(text, chr(10), '')")}) AS stripped, {crc} % 2 = 0 AS tampered
  FROM documents),
rows AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS size,
         CASE WHEN tampered THEN stripped ELSE leaf END AS f, '' AS proof
  FROM leaves),
a0 AS (SELECT tree, place AS i, size AS n, leaf AS h FROM rows),{"".join(_level(k, "a", "tree") for k in range(levels))}
sources AS (SELECT *, row_number() OVER (ORDER BY tree) - 1 AS nth, '' AS one FROM a{levels}),
b0 AS (SELECT one, nth AS i, (SELECT count(*) FROM sources) AS n, h FROM sources),{"".join(_level(k, "b", "one") for k in range(top_levels))}{
    "".join(_fold(k, "u", "a", "tree", "place", "rows") for k in range(levels))}
tops AS (SELECT u{levels}.*, sources.h AS subroot, nth, one FROM u{levels} JOIN sources USING (tree)),{
    "".join(_fold(k, "v", "b", "one", "nth", "tops") for k in range(top_levels))}
root AS (SELECT h AS root FROM b{top_levels})
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified
FROM v{top_levels}, root
"""


ORACLE_SQL = _oracle()
