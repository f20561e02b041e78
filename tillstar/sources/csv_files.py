"""The warehouse's CSV load files: typed read (never inferred) and write.

Load semantics kept from the warehouse:
* columns are bound by position from a declared file-order schema; the
  header row is only skipped;
* comma separated, ``""`` doubled-quote escaping, empty field = NULL,
  quoted empty field = empty string;
* a quoted field may hold line breaks if ``multi_line`` is set; the file is then cut into
  records by ``csv_records``, by as many tasks as it has ranges;
* booleans ``True/False``, dates ``yyyy-MM-dd``;
* any value that does not parse fails the load (``FAILFAST``): the error
  surfaces on the first action, so write the loaded tables in one job;
* columns absent from a file get their DEFAULT (``created_at = now()``,
  and TRUE/FALSE/0 defaults for columns a file leaves out); explicit NULLs
  in the file stay NULL.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tillstar.schema import NOW, STAR_TABLES, TableDef
from tillstar.sources.csv_records import csv_records
from tillstar.star import Star

# A quoted empty field ("") is an empty string, an unquoted one is NULL, as in
# the warehouse's CSV load.  Spark reads both as NULL unless a quoted empty
# value is given its own marker, which text columns then turn back into "";
# in a typed column the marker fails to parse, so "" there fails the load.
_QUOTED_EMPTY = "\u0000"

CSV_OPTIONS = {
    "header": "true",
    "mode": "FAILFAST",
    "nullValue": "",
    "emptyValue": _QUOTED_EMPTY,
    "quote": '"',
    "escape": '"',
    "enforceSchema": "true",
    "dateFormat": "yyyy-MM-dd",
}


def with_defaults(df: DataFrame, table: TableDef) -> DataFrame:
    """Columns in table order; a column missing from ``df`` gets its DEFAULT
    (or NULL when it has none)."""
    present = set(df.columns)
    cols = []
    for c in table.columns:
        if c.name in present:
            cols.append(F.col(c.name).cast(c.dtype).alias(c.name))
        elif c.default == NOW:
            cols.append(F.current_timestamp().cast(c.dtype).alias(c.name))
        else:
            cols.append(F.lit(c.default).cast(c.dtype).alias(c.name))
    return df.select(*cols)


def read_table_csv(spark: SparkSession, path: str, table: TableDef | str, multi_line: bool = False) -> DataFrame:
    t = STAR_TABLES[table] if isinstance(table, str) else table
    if multi_line:
        options = {k: v for k, v in CSV_OPTIONS.items() if k not in ("header", "enforceSchema")}
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t.file_struct().fields)
        raw = csv_records(spark, path).select(F.from_csv("record", schema, {**options, "multiLine": "true"}).alias("row")).select("row.*")
    else:
        raw = spark.read.options(**CSV_OPTIONS).schema(t.file_struct()).csv(path)
    raw = raw.select(*[
        F.when(F.col(f.name) == _QUOTED_EMPTY, F.lit("")).otherwise(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, StringType) else F.col(f.name)
        for f in raw.schema.fields
    ])
    return with_defaults(raw, t)


def read_star_csv(spark: SparkSession, directory: str, multi_line: bool = False) -> Star:
    """``<dir>/dim_customers.csv`` ... ``<dir>/fact_sales.csv`` as a typed star."""
    def rd(name):
        return read_table_csv(spark, os.path.join(directory, f"{name}.csv"), name, multi_line)

    return Star(fact=rd("fact_sales"), customers=rd("dim_customers"), products=rd("dim_products"),
                stores=rd("dim_stores"), time=rd("dim_time"))


def write_table_csv(df: DataFrame, path: str, table: TableDef | str | None = None) -> None:
    """CSV with a header row and no index column, in file column order."""
    if table is not None:
        t = STAR_TABLES[table] if isinstance(table, str) else table
        order = [f.name for f in t.file_struct().fields]
        df = df.select(*[c for c in order if c in df.columns])
    (df.write.mode("overwrite").option("header", "true").option("escape", '"')
       .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
       .option("nullValue", "").option("dateFormat", "yyyy-MM-dd").csv(path))


def write_star_csv(star: Star, directory: str) -> None:
    for name, df in star.tables().items():
        write_table_csv(df, os.path.join(directory, f"{name}.csv"), name)
