"""Operator 9: byte-limited shards by extendible hashing.

A document's hash is the first 48 bits of md5(id:text).  The directory starts as
one bucket; a bucket over the byte limit splits on the next bit of the hash, and only
such buckets do, until every bucket fits.  The directory is built from byte
sums by hash prefix (a "cell" is a prefix of ``global_depth`` bits): one shuffle of
partial sums, no document moves.  A cell that is still too large is split on
further bits in another round that reads only its documents' hashes.

Rows that share all 48 bits (repeats of one row) can't be split by hash.  They go
to pages of their bucket, as many to a page as fit, numbered by rank.  A
single document over the limit has a page of its own, marked ``oversize``.

NULL id or text: hashed as the empty text, 0 bytes.  Empty table: no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, rank_in_key, stored, table, unwrapped, whole_rows

HASH_BITS = 48
# Query parameter: the byte limit of a shard.
LIMIT_BYTES = 1 << 20
# Bits by which cells are finer than evenly filled shards, and bits of a further round.
SPARE_BITS, ROUND_BITS = 4, 12


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"),
                         F.coalesce(F.col(text_col), F.lit(""))).cast("binary"))
    return (docs.withColumn("__hash", F.conv(F.substring(key, 1, HASH_BITS // 4), 16, 10).cast("long"))
            .withColumn("__bytes", F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")))


def _prefix(bits: int):
    return F.shiftright("__hash", HASH_BITS - bits)


def _leaves(cells: DataFrame, top: int, depth: int, limit: int) -> DataFrame:
    """Buckets (bits, prefix, bytes) of the directory below ``top`` bits: those that fit
    while their parent does not, and cells of ``depth`` bits that still do not fit."""
    nodes = (cells.select("cell", "bytes", F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("bits"))
             .groupBy("bits", F.expr(f"shiftright(cell, {depth} - bits)").alias("prefix"))
             .agg(F.sum("bytes").alias("bytes")))
    split = nodes.where((F.col("bytes") > limit) & (F.col("bits") < depth))
    halves = split.select((F.col("bits") + 1).alias("bits"),
                          F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    root = nodes.where(F.col("bits") == top).select("bits", "prefix")
    return (nodes.join(halves.unionByName(root), ["bits", "prefix"], "left_semi")
            .where((F.col("bytes") <= limit) | (F.col("bits") == depth)))


def directory(docs: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The buckets: ``bits`` (local depth), ``prefix``, ``bytes``, ``most`` (bytes of the largest
    document of a bucket whose rows all have the same hash; NULL elsewhere)."""
    rows = stored(_hashed(docs, id_col, text_col).select("__hash", "__bytes")
                  .groupBy("__hash").agg(F.sum("__bytes").alias("__bytes"), F.max("__bytes").alias("most")), "hashes")
    total = rows.agg(F.sum("__bytes")).first()[0] or 0
    done, top = None, 0
    depth = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit_bytes)))) + SPARE_BITS)
    while True:
        cells = rows.groupBy(_prefix(depth).alias("cell")).agg(F.sum("__bytes").alias("bytes"))
        found = stored(_leaves(cells, top, depth, limit_bytes), "buckets")
        full = found.where(F.col("bytes") > limit_bytes)
        # a bucket whose rows share one hash is final, whatever its size
        one = (rows.join(full, _prefix(depth) == full["prefix"], "inner")
               .groupBy("bits", "prefix").agg(F.sum("__bytes").alias("bytes"), F.max("most").alias("most"),
                                              F.count(F.lit(1)).alias("hashes")))
        one = stored(one, "full")
        final = (found.where(F.col("bytes") <= limit_bytes).withColumn("most", F.lit(None).cast("long"))
                 .unionByName(one.where((F.col("hashes") == 1) | (F.col("bits") == HASH_BITS)).drop("hashes")))
        done = final if done is None else done.unionByName(final)
        more = one.where((F.col("hashes") > 1) & (F.col("bits") < HASH_BITS)).select("prefix")
        if more.isEmpty():
            return stored(done, "directory")
        rows = rows.join(more, _prefix(depth) == more["prefix"], "left_semi")
        top, depth = depth, min(HASH_BITS, depth + ROUND_BITS)


def assign_shards(docs: DataFrame, limit_bytes: int = LIMIT_BYTES, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``docs`` with ``shard`` (the bucket's bits as text, then ``/page``), ``depth``, ``page``,
    ``n_bytes`` and ``oversize``; columns of these names are replaced, others stay as they are, whatever
    their names.  Documents meet the directory by an equi-join for each local depth that
    occurs (at most 49)."""
    rows = whole_rows(docs, doc_id=F.col(f"`{id_col}`"), text=F.col(f"`{text_col}`"))
    made = ("n_bytes", "depth", "page", "shard", "oversize")
    return unwrapped(_assigned(rows, limit_bytes), docs.columns, {c: F.col(c) for c in made})


def _assigned(docs: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    buckets = directory(docs, limit_bytes, id_col, text_col)
    depths = sorted(r[0] for r in buckets.select("bits").distinct().collect())
    if not depths:
        depths = [0]
    rows = (_hashed(docs, id_col, text_col)
            .withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()))
    # a document lies in exactly one bucket: offer its prefix at each depth that occurs
    at = F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), _prefix(b).alias("prefix")) for b in depths]))
    mine = (rows.select("__hash").distinct().select("__hash", at.alias("at"))
            .join(buckets, (F.col("at.bits") == buckets["bits"]) & (F.col("at.prefix") == buckets["prefix"]))
            .select(F.col("__hash").alias("__h"), buckets["bits"].alias("depth"), buckets["prefix"].alias("__prefix"), "most"))
    placed = rows.join(mine, F.col("__hash") == F.col("__h")).drop("__h")
    whole = placed.where(F.col("most").isNull()).withColumn("page", F.lit(0).cast("long"))
    if buckets.where(F.col("most").isNotNull()).isEmpty():  # no bucket of repeats: nothing to page
        return _shard_columns(whole, limit_bytes)
    paged = rank_in_key(placed.where(F.col("most").isNotNull()), "__hash", "__row", "__part", "__rank")
    paged = paged.withColumn("page", F.floor(F.col("__rank") / F.greatest(F.lit(1), F.floor(F.lit(limit_bytes) / F.col("most"))))).drop("__rank")
    return _shard_columns(whole.unionByName(paged), limit_bytes)


def _shard_columns(placed: DataFrame, limit_bytes: int) -> DataFrame:
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(__prefix), depth, '0')"))
    return (placed.withColumn("shard", F.concat(bits, F.lit("/"), F.col("page").cast("string")))
            .withColumn("oversize", F.col("__bytes") > limit_bytes)
            .withColumnRenamed("__bytes", "n_bytes")
            .drop("__hash", "__part", "__row", "__prefix", "most"))


def write_shards(docs: DataFrame, path: str, limit_bytes: int = LIMIT_BYTES, **columns) -> None:
    """Writes the documents, one folder for each shard."""
    (assign_shards(docs, limit_bytes, **columns).repartition("shard").write.partitionBy("shard").parquet(path))


def query(spark, sf_dir: str) -> DataFrame:
    out = assign_shards(id_and_text(table(spark, sf_dir, "documents")), LIMIT_BYTES)
    return out.select("doc_id", "n_bytes", "shard", "depth", "page", "oversize")


ORACLE_SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 12))::BIGINT AS h
  FROM documents),
buckets AS (
  SELECT 0 AS depth, 0::BIGINT AS prefix, (SELECT sum(n_bytes) FROM hashed) AS bytes
  UNION ALL
  SELECT depth + 1, prefix * 2 + side,
         (SELECT sum(n_bytes) FROM hashed WHERE (h >> (47 - depth)) = prefix * 2 + side)
  FROM buckets, (VALUES (0), (1)) AS sides(side)
  WHERE bytes > {LIMIT_BYTES} AND depth < 48),
leaves AS (SELECT * FROM buckets WHERE bytes <= {LIMIT_BYTES})
SELECT doc_id, n_bytes,
       CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), 64, '0'), depth) END || '/0' AS shard,
       depth, 0::BIGINT AS page, n_bytes > {LIMIT_BYTES} AS oversize
FROM hashed JOIN leaves ON (h >> (48 - depth)) = prefix
"""
