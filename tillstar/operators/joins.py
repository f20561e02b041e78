"""Join helpers: FK-style semi/anti joins, dimension checks above aggregates, pinned results, hot keys
spread over tasks, rows gathered by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pin_small(df: DataFrame) -> DataFrame:
    """Compute a small, bounded result once and cut its lineage.

    ``checkpoint(eager=True)`` writes it to the cluster's shared
    ``spark.checkpoint.dir`` (a local test session gets a temp dir), so a result
    referenced several times in a later plan -- a top-N list used as join
    keys and as rows -- is not recomputed per reference, and survives the
    loss of the executors that computed it.  The planner keeps the size estimate of
    the computed plan (N rows for a top-N), so joins with it need no hint: few rows
    are broadcast, many are sort-merged.
    """
    from tillstar.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to parquet files under the shared checkpoint directory, for rows that
    are read several times: columns, compressed, where ``checkpoint()`` would write whole rows as they are."""
    from tillstar.session import scratch_path

    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


_GATHER = "__gather_by"


def gathered(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` shuffled by ``key`` before an aggregate by it, for keys of which there are very many: a task's
    partial aggregate then holds its own keys, where over unordered rows each task would hold nearly
    all.  Shuffled by the key's hash, so the aggregate keeps both of its steps and AQE may split
    the rows of a hot key over several tasks."""
    return rows.withColumn(_GATHER, F.xxhash64(key)).hint("rebalance", _GATHER).drop(_GATHER)


def semi_join(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of ``df`` whose key exists in ``keys`` (SQL ``EXISTS``)."""
    return df.join(keys, on, "left_semi")


def keep_existing(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` exists in ``keys`` (inner-join semantics
    against a dimension), for ``df`` that is an aggregate by ``key``.

    Written as an inner join with the distinct dimension keys rather than a
    semi join: Catalyst pushes a semi join below the aggregate, which at
    scale shuffles the raw fact rows by ``key`` before any partial
    aggregation; the inner join stays above it and joins one row per key.
    """
    return df.join(keys.select(key).distinct(), key)


def anti_join(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of ``df`` whose key is missing from ``keys`` (SQL ``NOT EXISTS``)."""
    return df.join(keys, on, "left_anti")


# A key is spread if it has over this part of a task's even share of the rows; rows of a spread
# key and salt are about this part of one.
SPREAD_PART = 0.25
_SALT, _SALTS = "__spread_salt", "__spread_salts"


def hot_keys(rows: DataFrame, on: str, tasks: int) -> DataFrame:
    """(``on``, number of salts) of the keys that have over ``SPREAD_PART`` of a task's share of the rows.  A
    frequent-items sketch proposes them (none is missed; it returns a few for each task at
    most, whatever the rows), and only what it proposes is counted."""
    share = SPREAD_PART / tasks
    known = rows.select(on).where(F.col(on).isNotNull())
    found = known.stat.freqItems([on], max(1e-4, share)).first()[0] or []
    candidates = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in found], known.schema))
    counts = known.join(candidates, on, "left_semi").groupBy(on).agg(F.count(F.lit(1)).alias("n"))
    even = rows.count() * share
    return counts.where(F.col("n") > even).select(on, F.ceil(F.col("n") / even).cast("int").alias(_SALTS))


def spread_join(rows: DataFrame, dim: DataFrame, on: str, how: str = "inner", tasks: int | None = None) -> DataFrame:
    """``rows`` joined with ``dim`` (``how``: inner or left) by a shuffle in which no key makes a task: rows of a hot key
    get a salt from their content, and the few dimension rows with that key are repeated for
    each salt.  Rows with a NULL key, which a left join keeps, are spread too.  Other keys are
    joined as usual.  This does not depend on adaptive execution or its thresholds."""
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how!r}")
    tasks = tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(rows, "spread")  # read four times: its joins run once
    # at most a few keys for each task: 1 / SPREAD_PART of them at even shares
    hot = F.broadcast(pin_small(hot_keys(rows, on, tasks)))
    many = F.when(F.col(on).isNull(), F.lit(int(tasks / SPREAD_PART))).otherwise(F.coalesce(_SALTS, F.lit(1)))
    salted = rows.join(hot, on, "left").withColumn(_SALT, F.pmod(F.xxhash64(*rows.columns), many).cast("int")).drop(_SALTS)
    repeated = dim.join(hot, on, "left").withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.coalesce(_SALTS, F.lit(1)) - 1))).drop(_SALTS)
    return salted.join(repeated, [on, _SALT], how).drop(_SALT)
