"""Exact, mergeable sets of orders, for distinct counts without a row per order.

Orders are numbered densely in the order of their first hour.  A set is kept as one row per
(key, bucket of 32,768 order numbers): ``few``, the positions in the bucket, or, beyond
``FEW`` of them, ``bits``, a bitmap of 4 KB; ``n`` is their number.  Sets of one key in different
buckets are disjoint, and months of orders lie in different buckets, as numbers follow time.

Merging is exact: an order may be in the sets of several keys, loads or stores and is counted
once.  ``bitmap_construct_agg`` and ``bitmap_or_agg`` combine on the map side, so what is shuffled is
bitmaps, at most one per group, bucket and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstar.operators.joins import stored
from tillstar.plans.keys import dense_keys, high_water_mark

# Positions kept as a list at most: 512 bytes, an eighth of a bitmap.
FEW = 256


def number_orders(lines: DataFrame, known: DataFrame | None = None, order_col: str = "order_id", time_col: str = "time_sk") -> DataFrame:
    """(``order_id``, ``order_no``) of the orders of ``lines`` that ``known`` does not have: dense numbers by
    first hour, then id, that continue after the largest known one.  A NULL order has no number."""
    orders = lines.where(F.col(order_col).isNotNull()).groupBy(F.col(order_col).alias("order_id")).agg(F.min(time_col).alias("first_hour"))
    start = 1
    if known is not None:
        orders = orders.join(known.select("order_id"), "order_id", "left_anti")
        start = high_water_mark(known, "order_no") + 1
    ranged = orders.repartitionByRange("first_hour", "order_id").sortWithinPartitions("first_hour", "order_id")
    return dense_keys(ranged.select("order_id"), "order_no", start=start)


def _row(keys: list[str], n: Column, few: Column, bits: Column) -> list:
    return [*keys, "bucket", n.cast("int").alias("n"), few.cast("array<smallint>").alias("few"), bits.cast("binary").alias("bits")]


def order_sets(lines: DataFrame, keys: list[str], few_keys: bool = False) -> DataFrame:
    """The sets of ``order_no`` of each ``keys``.  ``few_keys``: there are few keys however many lines (months,
    channels), so bitmaps are built at once; else positions are gathered first, at most 32,768
    to a row, and long lists become bitmaps."""
    at = lines.where(F.col("order_no").isNotNull()).select(
        *keys, F.bitmap_bucket_number("order_no").alias("bucket"), F.bitmap_bit_position("order_no").cast("smallint").alias("position"))
    none = F.lit(None)

    def mapped(positions: DataFrame) -> DataFrame:
        bits = positions.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg(F.col("position").cast("long")).alias("bits"))
        return bits.select(*_row(keys, F.bitmap_count("bits"), none, F.col("bits")))

    if few_keys:
        return mapped(at)
    # (distinct first: that is a hash aggregate, a set of each group is sorted for)
    listed = stored(at.distinct().groupBy(*keys, "bucket").agg(F.sort_array(F.collect_list("position")).alias("few")), "order-lists")
    short = listed.where(F.size("few") <= FEW).select(*_row(keys, F.size("few"), F.col("few"), none))
    long = listed.where(F.size("few") > FEW).select(*keys, "bucket", F.explode("few").alias("position"))
    return short.unionByName(mapped(long))


def _united(sets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bucket, n): the size of the union of each group's sets."""
    listed = sets.where("few is not null").select(*keys, "bucket", F.explode("few").alias("position"))
    listed = listed.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg(F.col("position").cast("long")).alias("bits"))
    mapped = sets.where("bits is not null").select(*keys, "bucket", "bits")
    whole = listed.unionByName(mapped).groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return whole.select(*keys, "bucket", F.bitmap_count("bits").alias("n"))


def count_orders(sets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ``total_orders``): the number of different orders of each group; ``keys`` may be coarser than
    those of the sets, or empty (then one row, 0 without orders)."""
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_orders")
    return _united(sets, keys).groupBy(*keys).agg(total)


def count_orders_by_key(sets: DataFrame, keys: list[str]) -> DataFrame:
    """``count_orders`` by the sets' own keys (not NULL), of which there may be very many: only buckets of
    a key that several loads have are merged, all others give their stored number."""
    sets = sets.dropna(subset=keys)
    heads = sets.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("loads"), F.max("n").alias("n"))
    again = sets.join(heads.where("loads > 1").select(*keys, "bucket"), [*keys, "bucket"], "left_semi")
    sizes = heads.where("loads = 1").select(*keys, "n").unionByName(_united(again, keys).select(*keys, "n"))
    return sizes.groupBy(*keys).agg(F.sum("n").cast("bigint").alias("total_orders"))
