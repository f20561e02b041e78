"""Shared pieces of the text operators: column handling, Arrow batches, stored
intermediates, ranks within hot keys.

Conventions of every operator here: the document id and text columns are
parameters, a NULL text counts as empty, each input row gives its own result
row (repeated rows are repeated in the result), other columns are ignored or
carried untouched, and an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillstar.session import scratch_path

# Rows of an Arrow batch at most: JVM and Python hold a few batches of whole texts each.
BATCH_ROWS = 1000
# Bytes of text that one step of an Arrow operator holds as Python objects.
STEP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, ``doc_id`` and ``text`` (never NULL); extra columns are left out."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def whole_rows(docs: DataFrame, **columns: Column) -> DataFrame:
    """The rows of ``docs`` as one struct column ``row``, and ``columns``: no name of ``docs`` can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def unwrapped(rows: DataFrame, names: list[str], columns: dict[str, Column] | None = None) -> DataFrame:
    """The columns ``names`` of the rows in ``row``, with ``columns`` in place of those of their names or at the end."""
    columns = columns or {}
    return rows.select(*[(columns[n] if n in columns else F.col("row").getField(n)).alias(n) for n in names],
                       *[c.alias(n) for n, c in columns.items() if n not in names])


def fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a NULL id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def prepare(spark: SparkSession) -> None:
    """Lowers the session's limit of rows in an Arrow batch to ``BATCH_ROWS``, for bounded memory:
    the default is meant for rows of a few numbers, not for documents.  Python workers get
    this package's folder in their path, for a package that is not installed."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [root])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def release() -> None:
    """Gives memory that a task no longer needs back to the system: Python workers live on, and
    several of them share an executor's memory."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_texts(docs: DataFrame, fn: Callable, schema: str, text_col: str = "text") -> DataFrame:
    """``mapInArrow`` in steps of at most about ``STEP_BYTES`` of text.

    ``docs``' text column is handed over as UTF-8 bytes.  ``fn()`` is called once per
    task and returns ``step(batch, texts)``, which gets a slice of the record batch
    and its texts as a list of ``bytes`` and yields record batches of ``schema``
    (or returns ``None``).  ``step.end()``, if there, is called after the last batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = fn()
        for batch in batches:
            for part in slices(batch, text_col):
                out = step(part, part.column(text_col).cast(pa.binary()).to_pylist())
                if out is not None:
                    yield from out
        if hasattr(step, "end"):
            yield from step.end()
        del step
        release()

    prepare(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text_col: str) -> Iterator[pa.RecordBatch]:
    """Cuts a record batch so that each part holds about ``STEP_BYTES`` of text (one row at least)."""
    import pyarrow.compute as pc

    sizes = pc.binary_length(batch.column(text_col)).fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > STEP_BYTES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def record_batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet under the session's shared ``spark.checkpoint.dir`` and
    read again: lineage is cut, later reads survive lost executors, and the
    planner knows its true size."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def least_by_hash(rows: DataFrame, n: int, *columns: str) -> DataFrame:
    """At most ``n`` rows, those whose hash of ``columns`` is least: a sample that is the same in
    every run (repeats of the last hash aside).  Only hashes are sorted, no texts."""
    h = F.xxhash64(*columns)
    last = rows.select(h.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return rows.where(h <= F.lit(last)).limit(n)


def rank_in_key(rows: DataFrame, key: str, order: str, part: str, out: str) -> DataFrame:
    """Adds ``out``: 0-based rank of a row within its ``key``, without gathering a hot key
    in one task.  ``part`` (a stored column, such as the partition that made the row)
    splits each key; ranks within (key, part) are shifted by the counts of the key's
    earlier parts, of which there are as many rows as parts, not as documents."""
    parts = rows.groupBy(key, part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(key).alias("__k"), F.col(part).alias("__p"),
                         F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = rows.withColumn("__local", F.row_number().over(Window.partitionBy(key, part).orderBy(order)) - 1)
    return (local.join(parts, (F.col(key) == F.col("__k")) & (F.col(part) == F.col("__p")))
            .withColumn(out, F.col("__before") + F.col("__local"))
            .drop("__k", "__p", "__before", "__local"))


# Keys that `join_spread` calls hot, at most.
HOT_KEYS = 10_000


def join_spread(rows: DataFrame, info: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` with the columns of ``info``, which has one row for each of their keys and in ``n``
    the number of rows with it (``n`` itself is left out).  Keys with over one in
    ``HOT_KEYS`` of all rows, which are fewer than ``HOT_KEYS``, are broadcast, so that the rows of a
    hot key don't meet in one task; the others are joined by shuffle."""
    info = stored(info, "keys")
    total = info.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(info.where(F.col(n) * HOT_KEYS > total).drop(n).withColumn("__hot", F.lit(True)))
    marked = rows.join(hot, key, "left")
    columns = [c for c in info.columns if c not in (key, n)]
    cold = marked.where(F.col("__hot").isNull()).drop("__hot", *columns).join(info.where(F.col(n) * HOT_KEYS <= total).drop(n), key)
    return marked.where("__hot").drop("__hot").unionByName(cold)
