from collections import defaultdict
import hashlib

import pytest

from tillstar.llm import sharding as S
from tillstar.llm.sharding import assign_shards

SCHEMA = "doc_id long, text string, page string, bytes long"


def brute(rows, limit):
    """Splits buckets one by one."""
    h = [int(hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:12], 16) for i, t, *_ in rows]
    size = [len((t or "").encode()) for _, t, *_ in rows]
    todo, out = [("", list(range(len(rows))))], {}
    while todo:
        bits, members = todo.pop()
        if sum(size[k] for k in members) <= limit or len(bits) == 48:
            out.update({k: bits for k in members})
        else:
            for side in "01":
                todo.append((bits + side, [k for k in members if f"{h[k]:048b}"[: len(bits) + 1] == bits + side]))
    return out, size


@pytest.mark.parametrize("limit", [200, 1000, 10**6])
def test_same_buckets_as_splitting_one_by_one(spark, limit):
    rows = [(i, "x" * (i * 7 % 90), "p", 1) for i in range(300)] + [(None, None, None, None), (5, "", "", 0)]
    want, size = brute(rows, limit)
    got = assign_shards(spark.createDataFrame(rows, SCHEMA).drop("page"), limit).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.shard) for r in got) == \
        sorted((rows[k][0] is None, rows[k][0], size[k], want[k] + "/0") for k in want)


def test_repeats_go_to_pages_and_all_shards_fit(spark):
    rows = [(7, "y" * 30)] * 50 + [(i, "z" * 20) for i in range(40)] + [(99, "w" * 500)]
    got = assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 100).collect()
    assert len(got) == len(rows)
    load = defaultdict(int)
    for r in got:
        load[r.shard] += r.n_bytes
    big = {r.shard for r in got if r.oversize}
    assert all(v <= 100 for s, v in load.items() if s not in big)
    assert [r.doc_id for r in got if r.oversize] == [99] and len(big) == 1
    assert sum(r.shard in big for r in got) == 1


def test_empty_table(spark):
    assert assign_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_columns_of_any_name_are_kept(spark):
    names = ["__hash", "__part", "__row", "__bytes", "__prefix", "page", "row", "most", "doc_id", "body"]
    df = spark.createDataFrame([(*range(8), k, "x" * k) for k in range(20)], ", ".join(f"`{n}` {'string' if n == 'body' else 'long'}" for n in names))
    out = S.assign_shards(df, 40, "doc_id", "body")
    assert out.columns == [*names, "n_bytes", "depth", "shard", "oversize"]
    rows = out.collect()
    assert len(rows) == 20 and all([r[n] for n in names if n not in ("page", "doc_id", "body")] == [0, 1, 2, 3, 4, 6, 7] for r in rows)
