"""Driver parquet tables (one file per table under a scale-factor directory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class DriverTables:
    """Lazy readers for ``<root>/<name>.parquet``.

    Reading is lazy: only the columns and rows a query uses reach the scan
    (Catalyst prunes the ``ReadSchema`` and pushes filters into the reader).
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        if name not in DRIVER_TABLES:
            raise KeyError(f"unknown driver table {name!r}")
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in DRIVER_TABLES:
            return self.table(name)
        raise AttributeError(name)
