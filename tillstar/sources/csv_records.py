r"""CSV records of files that many tasks read at once, also where quoted fields hold line breaks.

A line break ends a record only outside quotes, which a byte range alone can't tell.  Two passes do:

1. Each range counts its quotes (a doubled quote counts twice, so it changes nothing).  The
   parity of the counts of all earlier ranges of the file tells whether a range begins inside
   a quoted field.
2. Each range cuts its own lines into records from there.  What a range has of a record that began
   earlier, or that goes on after it, is put together with its other parts: at most two
   parts for each range are moved, all other records stay where they were read.

A quote toggles quoting wherever it stands, as in the warehouse's own load.  Records end at LF or CRLF,
empty lines between records are skipped, and line breaks inside quotes are kept as they are.  A
field that is never closed runs to the end of its file.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PARTS = "file long, range long, tail boolean, header boolean, record binary"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), "value")


def ranges_inside_quotes(lines: DataFrame) -> DataFrame:
    """(file, range) of the ranges that begin inside a quoted field."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counts = lines.groupBy("file", "range").agg(F.sum(quotes).alias("quotes"))
    # one row for each range of a file
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.sum("quotes").over(before)).where("before % 2 = 1").select("file", "range")


class _Range:
    """Cuts the lines of one range, given in order, into records."""

    def __init__(self, file: int, begin: int, inside: bool):
        self.file, self.begin, self.inside = file, begin, inside
        self.head: list[bytes] | None = [] if inside else None   # lines of a record that began earlier
        self.open: list[bytes] | None = None                     # lines of a record that is not complete
        self.header = begin == 0                                 # the file's first record is still to come

    def _rows(self, records: pa.Array, tail: bool | None = None, header: bool = False):
        n = len(records)
        columns = [pa.array([v] * n, t) for v, t in ((self.file, pa.int64()), (self.begin, pa.int64()), (tail, pa.bool_()), (header, pa.bool_()))]
        return pa.RecordBatch.from_arrays([*columns, records.cast(pa.binary())], names=["file", "range", "tail", "header", "record"])

    def lines(self, values: pa.Array):
        odd = pc.count_substring(values, '"').to_numpy(zero_copy_only=False) % 2
        after = (np.cumsum(odd) + self.inside) % 2 == 1
        before = np.insert(after[:-1], 0, self.inside)
        self.inside = bool(after[-1])
        # (the lines of the batch with the header go one by one)
        whole = ~before & ~after & (not self.header)
        found, several = values.filter(pa.array(whole)), []
        for k in np.flatnonzero(~whole).tolist():
            line = values[k].as_py()
            if self.head is not None and before[k]:
                self.head.append(line)
                if not after[k]:
                    yield self._rows(pa.array([b"\n".join(self.head)], pa.binary()), tail=False)
                    self.head = None
                continue
            if self.open is None:
                self.open = []
            self.open.append(line)
            if not after[k]:
                if not self.header:
                    several.append(b"\n".join(self.open))
                self.header, self.open = False, None
        for records in (found, pa.array(several, pa.binary())):
            if len(records):
                records = pc.replace_substring_regex(records, "\r$", "")
                yield self._rows(records.filter(pc.greater(pc.binary_length(records), 0)))

    def close(self):
        if self.head:  # no record ends in this range
            yield self._rows(pa.array([b"\n".join(self.head)], pa.binary()), tail=False)
        if self.open is not None:
            yield self._rows(pa.array([b"\n".join(self.open)], pa.binary()), tail=True, header=self.header)


def _cut(batches):
    at = None
    for b in batches:
        if not b.num_rows:
            continue
        files, begins = b.column("file").to_numpy(), b.column("range").to_numpy()
        inside = b.column("inside").to_numpy(zero_copy_only=False)
        cuts = (np.flatnonzero((files[1:] != files[:-1]) | (begins[1:] != begins[:-1])) + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
            if at is None or (at.file, at.begin) != (files[lo], begins[lo]):
                if at is not None:
                    yield from at.close()
                at = _Range(int(files[lo]), int(begins[lo]), bool(inside[lo]))
            yield from at.lines(b.column("value").slice(lo, hi - lo))
    if at is not None:
        yield from at.close()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``record``: the text of each record of the files at ``path``, without each file's first one (the
    header).  The files are read twice; ranges are as large as ``spark.sql.files.maxPartitionBytes``."""
    lines = _lines(spark, path)
    # one row of two numbers for each range that begins inside a field: 100 TB in ranges of
    # 128 MB are 800,000 ranges, so 13 MB at the very most
    inside = F.broadcast(ranges_inside_quotes(lines).withColumn("inside", F.lit(True)))
    marked = lines.join(inside, ["file", "range"], "left").select(
        "file", "range", F.coalesce("inside", F.lit(False)).alias("inside"), F.col("value").cast("binary").alias("value"))
    cut = marked.mapInArrow(_cut, _PARTS)
    parts = cut.where(F.col("tail").isNotNull())
    # a record's parts follow its tail in the order of the ranges; a range has one of each kind at most
    order = Window.partitionBy("file").orderBy("range", "tail").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("number", F.count(F.when(F.col("tail"), F.lit(1))).over(order))
    joined = parts.groupBy("file", "number").agg(
        F.sort_array(F.collect_list(F.struct("range", "tail", F.col("record").cast("string").alias("record")))).alias("parts"), F.max("header").alias("header"))
    text = F.array_join(F.transform("parts", lambda p: p["record"]), "\n")
    joined = joined.where(~F.col("header")).select(F.regexp_replace(text, "\r$", "").alias("record")).where("record <> ''")
    return cut.where(F.col("tail").isNull()).select(F.col("record").cast("string").alias("record")).unionByName(joined)
