"""Spark session settings and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings the library relies on: ANSI arithmetic (overflow and /0 raise),
# UTC session time, AQE (runtime join selection, partition coalescing and
# skew-join splitting).
RECOMMENDED_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a hot order is split in the conform join also below an aggregate that could have
    # used the join's partitioning
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # REBALANCE (the stored fact's layout) splits a hot key over several files
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # delete checkpoint files of pinned small results once they are unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tillstar",
                  extra: dict | None = None) -> SparkSession:
    """A local session for tests and the benchmark."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(RECOMMENDED_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    """The SparkContext, or None on a Spark Connect session."""
    try:
        return spark.sparkContext
    except Exception:  # Connect sessions have no local SparkContext
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, or the context's
    checkpoint directory.  Where neither is set, a local session (tests) gets a fresh
    temp directory; on any other master that folder would exist on the driver alone, so
    this is an error there."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = _context(spark)
    current = sc.getCheckpointDir() if sc is not None else None
    if configured is None and current is None:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tillstar-ckpt-")
    if sc is not None and current is None:
        sc.setCheckpointDir(configured)
        current = sc.getCheckpointDir()
    return spark.conf.get("spark.checkpoint.dir", None) or current or configured


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What a query within has shuffled is deleted when that query ends (Spark 4.1 and later), not at some
    time after the driver has collected its garbage: for jobs of several queries, each of which
    shuffles as much as the tables hold."""
    old = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREE_SHUFFLES) if old is None else spark.conf.set(_FREE_SHUFFLES, old)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared checkpoint directory, for tables
    written to cut lineage or to materialise the star."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")
