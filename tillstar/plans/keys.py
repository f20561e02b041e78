"""Surrogate keys: dense 1..N numbering and continuing after a high-water mark.

``dense_keys`` numbers rows without a global sort or a one-partition
window: it counts rows per partition (one small aggregate), turns the
counts into running offsets (one row per partition), and adds each row's
position inside its partition.  Both passes must see the same rows in the
same order, so the input is first written to the shared checkpoint
directory (``checkpoint()``) unless the caller says it is already stable
(for example a plain parquet scan).  ``row_keys`` numbers a parquet scan from its files' own
row numbers, without storing it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillstar.session import ensure_checkpoint_dir


# Files whose offsets are broadcast at most: about 20 MB of paths and counts.
MAX_KEYED_FILES = 100_000
_FILE, _PLACE = "_key_file", "_key_place"


def dense_keys(df: DataFrame, col: str, start: int = 1, stable_input: bool = False) -> DataFrame:
    """Add ``col`` numbered ``start, start+1, ...`` in partition order."""
    if not stable_input:
        ensure_checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)
    tagged = df.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the input, whatever its rows
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = tagged.join(F.broadcast(offsets), "_pid")
    pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return out.withColumn(col, F.col("_off") + pos + F.lit(start)).drop("_pid", "_mid", "_off")


def row_keys(df: DataFrame, col: str, start: int = 1) -> DataFrame:
    """Add ``col``, dense from ``start``, to a parquet scan ``df``: a row's place in its file plus the rows
    of the files before it, in the order of their paths.  Nothing is stored or shuffled, and a
    recomputed task gives the same keys.  The offsets are one row for each file, so
    up to ``MAX_KEYED_FILES`` files they are broadcast; beyond, ``dense_keys`` numbers the rows."""
    files = len(df.inputFiles())
    if files > MAX_KEYED_FILES:
        return dense_keys(df, col, start)
    at = df.withColumn(_FILE, F.col("_metadata.file_path")).withColumn(_PLACE, F.col("_metadata.row_index"))
    if files <= 1:
        return at.withColumn(col, F.col(_PLACE) + F.lit(start)).drop(_FILE, _PLACE)
    counts = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).groupBy("f").agg((F.max("i") + 1).alias("n"))
    before = Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("f", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    out = at.join(F.broadcast(offsets), F.col(_FILE) == F.col("f"))
    return out.withColumn(col, F.col("off") + F.col(_PLACE) + F.lit(start)).drop(_FILE, _PLACE, "f", "off")


def high_water_mark(df: DataFrame, col: str) -> int:
    """``MAX(col)`` or 0 for an empty table (the sequence ``setval``)."""
    v = df.agg(F.max(col)).first()[0]
    return int(v) if v is not None else 0


def continue_keys(new_rows: DataFrame, existing: DataFrame, col: str, stable_input: bool = False) -> DataFrame:
    """Number ``new_rows`` after the largest ``col`` already in ``existing``."""
    return dense_keys(new_rows, col, start=high_water_mark(existing, col) + 1, stable_input=stable_input)
