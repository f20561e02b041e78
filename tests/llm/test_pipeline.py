import os

import pytest

import corpus_pipeline as C
from tillstar.llm import decontamination as D
from tillstar.llm import toxicity as X
from tillstar.llm.common import stored, table

from .test_jaccard_join import brute as groups
from .test_packing import check as packed
from .test_secrets import brute_base

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_as_brute_force(spark):
    docs = table(spark, SF, "documents")
    before = rows(docs)
    # toxic: any lexicon term by edit distance, scored text by text
    kept = stored(C.toxicity(spark, docs, SF), "t")
    assert kept.schema == docs.schema
    model = X.train(docs, table(spark, SF, "labels"))
    matches = X._Matches(model.terms)
    after = rows(kept)
    assert set(after) == {i for i, r in before.items() if X.text_score(X._words(r.text.encode()), matches, model)[0] < 0.5}
    assert all(after[i] == before[i] for i in after) and len(after) > 0.8 * len(before)
    # near copies: all pairs
    one = stored(C.near_duplicates(spark, kept, SF), "n")
    least = groups([(i, r.text) for i, r in after.items()])
    before, after = after, rows(one)
    assert one.columns == docs.columns and set(after) == {int(c) for _, c, _ in least}
    assert all(after[i] == before[i] for i in after)
    # benchmark items, word for word
    clean = stored(C.decontamination(spark, one, SF), "d")
    flat = lambda t: b" " + b" ".join(D.words_of(t.encode())) + b" "
    items = [flat(r.text) for r in table(spark, SF, "benchmark").collect()]
    before, after = after, rows(clean)
    assert clean.columns == docs.columns
    assert set(after) == {i for i, r in before.items() if not any(x in flat(r.text) for x in items)}
    # secrets
    masked = stored(C.mask_secrets(spark, clean, SF), "s")
    before, after = after, rows(masked)
    assert masked.schema == docs.schema and set(after) == set(before)
    for i, r in after.items():
        assert r.n_chars == len(r.text) and brute_base(r.text) == []
        assert ("[secret]" in r.text) == (r.text != before[i].text) and (r.text == before[i].text or brute_base(before[i].text))
    packed(C.pack(spark, masked, SF).collect(), [(i, r.text) for i, r in after.items()])
    # and all of them together
    assert sorted(set(r.doc_id for r in C.run(spark, SF).collect())) == sorted(after)


def test_odd_rows_go_through(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, node string, row string, label int"
    odd = spark.createDataFrame([(None, None, None, None, None, None, None, None, None), (1, "", "en", "s", 0, 1.0, "a", "b", 2),
                                 (2, "one two", None, None, 7, None, None, "r", 1), (2, "one two", None, None, 7, None, None, "r", 1),
                                 (3, "word " * 30000, "x", "y", 150000, 0.0, "", "", 0)], schema)
    for docs, n in ((odd, 4), (odd.limit(0), 0)):
        for _, stage in C.STAGES[:-1]:
            docs = stored(stage(spark, docs, SF), "odd")
            assert docs.schema == odd.schema
        assert docs.count() == n
        pieces = C.pack(spark, docs, SF).collect()
        assert len({r.doc_id for r in pieces}) == n
