"""The warehouse load, start to finish.

    result = load_warehouse(spark, "/landing/retail_csv", "/warehouse/retail")

1. read the five CSV files with their declared types (FAILFAST: a value
   that does not parse fails the load);
2. write them as parquet to a new versioned directory under ``base`` -- a
   failed load leaves every earlier version untouched;
3. make the new version the current one (``current_path`` finds it), unless
   ``refuse_violations`` is set and a constraint check counts any violation;
4. report row counts, the constraint checks, and each table's key
   high-water mark (where new keys continue), all computed on Spark from
   the stored tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstar.plans.quality import load_report, quality_report
from tillstar.schema import STAR_TABLES
from tillstar.sources.csv_files import read_star_csv
from tillstar.sources.parquet_store import read_star, set_current, versioned_path, write_star
from tillstar.star import Star


@dataclass
class LoadResult:
    path: str
    star: Star
    load_report: DataFrame
    quality_report: DataFrame
    high_water_marks: DataFrame


def key_high_water_marks(star: Star) -> DataFrame:
    """``table_name, key_column, max_key`` per table (the sequence sync):
    one small aggregate per table, unioned."""
    parts = []
    for name, df in star.tables().items():
        key = STAR_TABLES[name].primary_key
        parts.append(df.agg(F.max(key).cast("bigint").alias("max_key")).select(
            F.lit(name).alias("table_name"), F.lit(key).alias("key_column"), "max_key"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class ConstraintViolation(ValueError):
    """The load broke declared constraints; ``.report`` has the rules and counts."""

    def __init__(self, report: DataFrame):
        self.report = report.where("violations > 0")
        rows = self.report.orderBy("rule", "table_name", "column_name").collect()  # at most one row per rule
        super().__init__(", ".join(f"{r['rule']} {r['table_name']}.{r['column_name']}: {r['violations']}" for r in rows))


def load_warehouse(spark: SparkSession, csv_dir: str, base: str, refuse_violations: bool = False,
                   multi_line: bool = False) -> LoadResult:
    root = versioned_path(base)
    write_star(read_star_csv(spark, csv_dir, multi_line), root)
    stored = read_star(spark, root)
    report = quality_report(stored)
    if refuse_violations and not report.where("violations > 0").isEmpty():
        raise ConstraintViolation(report)
    set_current(spark, base, root)
    return LoadResult(root, stored, load_report(stored), report, key_high_water_marks(stored))
