"""Files cut into CSV records by many tasks, against the one-task reader and a plain parser."""

from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql.types import IntegerType, StringType

from tillstar.schema import Column_, TableDef
from tillstar.sources.csv_files import CSV_OPTIONS, read_table_csv
from tillstar.sources.csv_records import csv_records

TABLE = TableDef("t", (Column_("a", IntegerType()), Column_("b", StringType()), Column_("c", StringType())), "a")


def text(n, end, seed=0):
    rnd = random.Random(seed)
    pieces = ["x", "\n", end, '""', ",", "ü", " ", "\n\n", '""""', "long " * 9, "é,\n\"\"q\"\"\n"]
    rows = ["a,b,c" if seed % 2 else 'a,"b\n""b""",c']
    for i in range(n):
        quoted = '"' + "".join(rnd.choice(pieces) for _ in range(rnd.randrange(9))) + '"'
        rows.append(f"{i},{rnd.choice([quoted, 'plain', '', quoted])},{rnd.choice(['end', '', quoted])}")
    return end.join(rows) + (end if seed % 3 else "")


@pytest.fixture
def ranges(spark):
    """Sets the bytes of a range; the session's value comes back afterwards."""
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    yield lambda size: spark.conf.set(key, str(size))
    spark.conf.set(key, old)


@pytest.mark.parametrize("size", [5, 64, 1 << 20])
def test_records_at_every_cut(spark, tmp_path, ranges, size):
    for seed, end in enumerate(["\n", "\r\n", "\n"]):
        path = tmp_path / f"{seed}.csv"
        path.write_bytes(text(6 if size < 10 else 40, end, seed).encode())
    ranges(size)
    got = sorted(r.record for r in csv_records(spark, str(tmp_path)).collect())
    want = []
    for seed in range(3):
        raw = (tmp_path / f"{seed}.csv").read_bytes().decode()
        inside, start = False, 0
        for k, ch in enumerate(raw + "\n"):
            inside ^= ch == '"'
            if ch == "\n" and not inside:
                want.append((start, raw[start:k].removesuffix("\r")))
                start = k + 1
    assert got == sorted(r for at, r in want if at > 0 and r)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_rows_as_the_one_task_reader(spark, tmp_path, ranges, end):
    path = str(tmp_path / "t.csv")
    with open(path, "wb") as f:
        f.write(text(60, end, 4).encode())
    ranges(200)
    assert len(csv_records(spark, path).inputFiles()) == 1
    got = sorted((r.a, r.b, r.c) for r in read_table_csv(spark, path, TABLE, multi_line=True).collect())
    if end == "\n":  # (that reader leaves the CR of a CRLF in the last field)
        whole = spark.read.options(**CSV_OPTIONS).option("multiLine", True).schema(TABLE.file_struct()).csv(path)
        assert got == sorted(tuple(None if v is None else v.replace("\0", "") if isinstance(v, str) else v for v in r) for r in whole.collect())
    plain = list(csv.reader(io.StringIO(text(60, end, 4), newline="")))[1:]
    assert sorted((int(a), b, c) for a, b, c in plain) == sorted((a, b or "", c or "") for a, b, c in got)


def test_bad_values_fail_and_empty_files_give_nothing(spark, tmp_path, ranges):
    ranges(16)
    bad = tmp_path / "bad.csv"
    bad.write_text('a,b,c\n1,"x\ny",z\nno number,"p\nq",r\n')
    with pytest.raises(Exception):
        read_table_csv(spark, str(bad), TABLE, multi_line=True).collect()
    empty = tmp_path / "empty.csv"
    empty.write_text("a,b,c\n")
    assert read_table_csv(spark, str(empty), TABLE, multi_line=True).count() == 0
