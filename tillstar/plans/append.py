"""Appending loads: a warehouse of numbered versions, each a list of parts.

    w = AppendWarehouse(spark, "/warehouse/retail")
    w.append(star_of_todays_files)       # a new version: the parts before and today's
    w.star(); w.star(version=3); w.history()

A load adds one part for each table with the rows that are not there yet, so nothing stored is written
again.  It moves 16 bytes of hash and a place for each row, never the rows: the places of the new rows
become bitmaps of 32,768 rows, by which the rows are picked, and numbered, where they are read.  Each query's
shuffle files go when it ends, staged rows when their last load does.  Rows are compared by a 128-bit hash of their content, as many times as they occur: a second load
of the same files adds nothing, and a line that a file has twice stays twice.  The fact's
content is all but its surrogate key, which continues after the highest one stored; a dimension
row's content includes its key.

The manifest has a row for each version, table and part, with the part's rows, highest key and
checksum (a sum of the rows' hashes, so independent of their order).  A version counts from the
append of its manifest rows, the last step; parts of a load that failed are never read.
``expire`` gives up old versions and deletes the parts that no later one lists.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillstar.operators.joins import pin_small
from tillstar.plans.keys import row_keys
from tillstar.schema import NOW, STAR_TABLES
from tillstar.session import shuffles_freed
from tillstar.star import Star

HASH = "row_hash"
_MANIFEST = "version int, table_name string, part string, added_in int, row_count long, max_key long, checksum decimal(38,0), kept_from int"
_ATTR = {"fact_sales": "fact", "dim_customers": "customers", "dim_products": "products", "dim_stores": "stores", "dim_time": "time"}
# the fact's key is a number given by the warehouse; other keys come with the rows
GENERATED_KEYS = {"fact_sales": "sale_sk"}
# A bitmap has one bit for each row of a load, and counts; up to this many rows (256 MB) they are broadcast.
MAX_MARKED_ROWS = 3 << 29
# Parts and staged rows are numbers for the most part, which zstd stores in two thirds of snappy's bytes.
CODEC = "zstd"
_PLACE, _BUCKET, _AT = "_row_place", "_row_bucket", "_row_at"


def content_hash(df: DataFrame, table: str) -> Column:
    """16 bytes that name the row's content: every column but a generated key and load times."""
    t = STAR_TABLES[table]
    names = [c.name for c in t.columns if c.name in df.columns and c.default != NOW and c.name != GENERATED_KEYS.get(table)]
    texts = [F.col(n).cast("string") for n in names]
    # (compiled, where a lambda is interpreted field by field)
    fields = F.array(*[F.concat(F.octet_length(x).cast("string"), F.lit(":"), x) for x in texts])
    return F.unhex(F.md5(F.array_join(fields, "", "-").cast("binary")))


def row_hash(df: DataFrame, table: str) -> Column:
    """The hash that rows were staged with, or else made from their content."""
    return F.col(HASH) if HASH in df.columns else content_hash(df, table)


def checksum(hashes: Column) -> Column:
    """Sum of the rows' hashes (first 8 bytes as a number): the same in any order."""
    return F.coalesce(F.sum(F.xxhash64(hashes).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)")


class AppendWarehouse:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    # --------------------------------------------------------------- manifest
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> DataFrame:
        """One row for each version, table and part (versions x parts rows; never rows of data)."""
        path = os.path.join(self.base, "manifest")
        p, fs = self._fs(path)
        if not fs.exists(p):
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(path)

    def _rows(self) -> list:
        rows = self.manifest().collect()
        kept = max((r["kept_from"] for r in rows), default=1)
        return [r for r in rows if r["version"] >= kept and r["table_name"] is not None]

    def versions(self) -> list[int]:
        return sorted({r["version"] for r in self._rows()})

    def _parts(self, version: int | None = None) -> dict[str, list]:
        rows = self._rows()
        known = sorted({r["version"] for r in rows})
        if version is not None and version not in known:
            raise ValueError(f"no version {version}; there are {known}")
        current = version if version is not None else (known[-1] if known else 0)
        out: dict[str, list] = {t: [] for t in _ATTR}
        for r in sorted(rows, key=lambda r: r["added_in"]):
            if r["version"] == current:
                out[r["table_name"]].append(r)
        return out

    def _read(self, parts: list, table: str) -> DataFrame:
        paths = [os.path.join(self.base, r["part"]) for r in parts if r["row_count"]] or [os.path.join(self.base, r["part"]) for r in parts[:1]]
        return self.spark.read.parquet(*paths)

    def star(self, version: int | None = None) -> Star:
        """The tables of a version (default: the current one)."""
        parts = self._parts(version)
        if not all(parts.values()):
            raise ValueError(f"no version in {self.base}")
        return Star(**{_ATTR[t]: self._read(p, t).drop(HASH) for t, p in parts.items()})

    def history(self) -> DataFrame:
        """Rows added and in all, and the highest key, of each version and table."""
        rows = self.manifest()
        kept = rows.agg(F.coalesce(F.max("kept_from"), F.lit(1)).alias("first"))
        live = rows.join(F.broadcast(kept), F.col("version") >= F.col("first")).where("table_name is not null")  # one row
        return live.groupBy("version", "table_name").agg(
            F.coalesce(F.sum(F.when(F.col("added_in") == F.col("version"), F.col("row_count"))), F.lit(0)).alias("added"),
            F.sum("row_count").alias("row_count"), F.max("max_key").alias("max_key"))

    # ------------------------------------------------------------------ loads
    def _new_places(self, table: str, rows: DataFrame, parts: list) -> DataFrame:
        """The places of the rows that are not there yet: of equal rows those beyond the number stored."""
        if not any(r["row_count"] for r in parts):
            return rows.select(_PLACE)
        here = rows.select(row_hash(rows, table).alias(HASH), _PLACE)
        there = self._read(parts, table).select(HASH, F.lit(None).cast("long").alias(_PLACE))
        # equal rows in one order, the stored ones first: of n stored ones, row 2n + 1 is the first new one
        equal = Window.partitionBy(HASH).orderBy(F.col(_PLACE).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        seen = here.unionByName(there).select(
            _PLACE, F.count(F.lit(1)).over(equal).alias("nth"), (F.count(F.lit(1)).over(equal) - F.count(_PLACE).over(equal)).alias("there"))
        # (by bucket first: a task here has places of all buckets, whose bitmaps would be nearly empty)
        return seen.where(F.col(_PLACE).isNotNull() & (F.col("nth") > 2 * F.col("there"))).select(_PLACE).repartition(F.bitmap_bucket_number(_PLACE))

    def _new_rows(self, table: str, df: DataFrame, parts: list, key: str | None, start: int) -> DataFrame:
        """The rows of ``df``, a scan of stored files, that are not there yet, with their hash; numbered from
        ``start`` in ``key``, if given."""
        rows = row_keys(df, _PLACE)
        at = [F.bitmap_bucket_number(_PLACE).alias(_BUCKET), F.bitmap_bit_position(_PLACE).cast("int").alias(_AT)]
        places = self._new_places(table, rows, parts).select(*at)
        # (with the bytes of each 64 bits reversed, so that read as a number they have the first place lowest)
        bits = pin_small(places.groupBy(_BUCKET).agg(F.bitmap_construct_agg(F.col(_AT).bitwiseXOR(F.lit(56))).alias("bits")))
        sizes = bits.select(F.col(_BUCKET).alias("b"), F.bitmap_count("bits").alias("n"))
        # one row for 32,768 rows
        before = F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # 512 numbers of 64 bits, and how many rows are marked before each: a row looks at one of them
        each = F.sequence(F.lit(0), F.lit(511))
        words = F.transform(each, lambda i: F.conv(F.hex(F.substring("bits", i * 8 + 1, F.lit(8))), 16, -10).cast("long"))
        ranks = F.transform(each, lambda i: F.bitmap_count(F.substring("bits", F.lit(1), i * 8)).cast("smallint"))
        marks = bits.select(_BUCKET, words.alias("words"), ranks.alias("ranks")).join(sizes.select("b", before.alias("before")), F.col(_BUCKET) == F.col("b")).drop("b")
        last = bits.agg(F.max(_BUCKET)).first()[0] or 0
        marks = F.broadcast(marks) if last << 15 <= MAX_MARKED_ROWS else marks
        found = rows.select("*", *at).join(marks, _BUCKET).where(F.expr(f"words[{_AT} div 64] & shiftleft(1L, {_AT} % 64) <> 0"))
        found = found.withColumn(HASH, row_hash(df, table))
        content = [c for c in df.columns if c != HASH]
        if key is None:
            return found.select(*content, HASH)
        earlier = F.expr(f"ranks[{_AT} div 64] + bit_count(words[{_AT} div 64] & ~shiftleft(-1L, {_AT} % 64))")
        number = (F.col("before") + earlier + F.lit(start)).cast("long").alias(key)
        return found.select(number, *[c for c in content if c != key], HASH)

    @contextmanager
    def staged(self, df: DataFrame, table: str) -> Iterator[DataFrame]:
        """The rows of ``df`` written once, each with its hash, as a scan for the loads within; deleted after them."""
        path = os.path.join(self.base, "staged", table, uuid.uuid4().hex[:12])
        p, fs = self._fs(path)
        try:
            df.drop(HASH).select("*", content_hash(df, table).alias(HASH)).write.option("compression", CODEC).parquet(path)
            yield self.spark.read.parquet(path)
        finally:
            fs.delete(p, True)

    def append(self, star: Star, stored: tuple[str, ...] = ()) -> int:
        """Adds the rows of ``star`` that are not there yet, as a new version; its number.  Its tables are read
        twice: they are written to files first, but for those named in ``stored``, which are scans of
        parquet files already (``staged`` makes one), filtered or not.  The fact may come without its key."""
        parts, rows = self._parts(), self._rows()
        version = max((r["version"] for r in rows), default=0) + 1

        def add(table: str) -> dict:
            df, key = getattr(star, _ATTR[table]), STAR_TABLES[table].primary_key
            part = os.path.join(table, f"v{version}-{uuid.uuid4().hex[:8]}")
            path = os.path.join(self.base, part)
            if _ATTR[table] not in stored and table == "fact_sales":
                df = df.hint("rebalance", "order_id")
            highest = max((r["max_key"] or 0 for r in parts[table]), default=0)
            with nullcontext(df) if _ATTR[table] in stored else self.staged(df, table) as scan:
                new = self._new_rows(table, scan, parts[table], GENERATED_KEYS.get(table), highest + 1)
                if table == "fact_sales":
                    new = new.sortWithinPartitions("time_sk")
                new.write.option("compression", CODEC).parquet(path)
            written = self.spark.read.parquet(path)
            s = written.agg(F.count(F.lit(1)).alias("n"), F.max(key).cast("long").alias("k"), checksum(F.col(HASH)).alias("c")).first()
            return dict(version=version, table_name=table, part=part, added_in=version, row_count=s["n"], max_key=s["k"], checksum=s["c"], kept_from=1)

        with shuffles_freed(self.spark), ThreadPoolExecutor(max_workers=len(_ATTR)) as pool:
            added = [f.result() for f in [pool.submit(add, t) for t in _ATTR]]
        earlier = [{**r.asDict(), "version": version} for p in parts.values() for r in p]
        self._commit(earlier + added)
        return version

    def _commit(self, rows: list[dict]) -> None:
        names = [f.split()[0] for f in _MANIFEST.split(", ")]
        df = self.spark.createDataFrame([tuple(r[n] for n in names) for r in rows], _MANIFEST)
        df.coalesce(1).write.mode("append").parquet(os.path.join(self.base, "manifest"))

    def damaged_parts(self, version: int | None = None) -> list[str]:
        """Parts whose stored rows no longer have the manifest's number and checksum."""
        out = []
        for table, parts in self._parts(version).items():
            for r in parts:
                df = self.spark.read.parquet(os.path.join(self.base, r["part"]))
                plain = df.drop(HASH)
                s = df.agg(F.count(F.lit(1)).alias("n"), checksum(content_hash(plain, table)).alias("c")).first()
                if (s["n"], s["c"]) != (r["row_count"], r["checksum"]):
                    out.append(r["part"])
        return out

    def expire(self, keep: int = 1) -> list[str]:
        """Gives up all versions but the last ``keep``; the parts deleted."""
        rows = self._rows()
        known = sorted({r["version"] for r in rows})
        live = known[-max(1, keep):]
        if live == known:
            return []
        self._commit([dict(version=live[-1], table_name=None, part=None, added_in=None, row_count=None, max_key=None, checksum=None, kept_from=live[0])])
        used = {r["part"] for r in rows if r["version"] in live}
        gone = sorted({r["part"] for r in rows} - used)
        for part in gone:
            p, fs = self._fs(os.path.join(self.base, part))
            fs.delete(p, True)
        return gone
