import hashlib
import os
import random
import zlib

import duckdb
import pytest

from tillstar.llm import merkle_manifest as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    """Each level of the tree, from the leaves to the one node that remains."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k:k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def path(tree, at):
    for level in tree[:-1]:
        first = at - at % 3
        yield level[first:at], level[at + 1:first + 3]
        at //= 3


def brute(rows):
    """Results of rows (doc_id, source, lang, n_chars, text), as text, sorted."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in groups[s]])
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for at, r in enumerate(groups[s]):
            steps = list(path(trees[s], at)) + list(path(top, k))
            tampered = zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 2 == 0
            f = leaf((*r[:4], r[4].replace("\n", "") if tampered and r[4] is not None else r[4]))
            for left, right in steps:
                f = H(*left, f, *right)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], H(*(d for a, b in steps for d in a + b)), f, f == top[-1][0]))
    return sorted(map(str, out))


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def got(df):
    return sorted(str(tuple(r[c] for c in NAMES)) for r in df.collect())


def fixture(n):
    rnd = random.Random(n)
    rows = []
    for i in range(n):
        source = rnd.choice(["hot", "hot", "hot", "ä", "Z", "z", "", None, "s1", f"few{rnd.randrange(30)}"])
        rows.append((rnd.randrange(10**9), source, rnd.choice(["en", None, ""]), rnd.choice([None, 5, -1]), rnd.choice(["a\nb", "", None, "c", "\n", "ü\r\nx"])))
    rows += [(None, "hot", "en", 1, "no id"), (None, None, None, None, None), (7, "hot", "en", 1, "same\n")] + [(7, "hot", "en", 1, "same\n")] * 4
    rows += [(7, "hot", "en", 1, "other"), (8, "one", "en", 3, "x" * 200_000 + "\n")]
    return rows


@pytest.mark.parametrize("block_levels", [7, 1, 2])
def test_manifest_as_whole_trees(spark, tmp_path, monkeypatch, block_levels):
    monkeypatch.setattr(M, "BLOCK_LEVELS", block_levels)
    rows = fixture(300)
    df = spark.createDataFrame([(*r, "x", b"y", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, digest binary, n int")
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert got(M.query(spark, str(tmp_path))) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_trees_of_few_leaves(n):
    leaves = [hashlib.sha256(bytes([k])).hexdigest() for k in range(n)]
    tree = M.AppendOnlyTree()
    for d in leaves:
        tree.append(bytes.fromhex(d))
    whole = levels(leaves)
    assert tree.finish().hex() == whole[-1][0]
    for at, w in enumerate(tree.witnesses):
        assert [(a.hex(), b.hex()) for a, b in w] == [("".join(a), "".join(b)) for a, b in path(whole, at)]


def test_empty_table_and_one_row(spark):
    df = spark.createDataFrame([(1, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    assert M.manifest(df.limit(0)).count() == 0
    one = M.manifest(df).collect()[0]
    assert one.leaf == one.subroot == one.root == leaf((1, None, None, None, None)) and one.witness == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver test data not present")
def test_query_as_whole_trees_and_as_sql(spark):
    sf = "/root/testdata/sf0.01"
    out = got(M.query(spark, sf))
    docs = M.table(spark, sf, "documents").select(*M.FIELDS).collect()
    assert out == brute([tuple(r) for r in docs])
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    sql = con.execute(f"select {', '.join(NAMES)} from ({M.ORACLE_SQL})").fetchall()
    assert sorted(map(str, sql)) == out
