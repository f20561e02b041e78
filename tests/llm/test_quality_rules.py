import random
import re
from collections import Counter

from tillstar.llm import quality_rules as Q
from tillstar.llm.quality_rules import RULES, apply_rules, rule_order, verdict, with_statistics, with_words

SCHEMA = "doc_id long, text string, words string, n_words string"


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    cover = {k + o for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for o in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover),
            len(w) < 50 or 100 * len(cover) > 50 * len(w))


def test_statistics_as_brute_force(spark):
    rnd = random.Random(5)
    bits = ["a", "b", "é", "😀x", "#", "**", " ", "\t", "\n", "\n\n", "\x0b", " ", "\x1c", "word", "a b c "]
    texts = [None, "", " \n ", "a b", "x " * 40000] + [
        " ".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 200))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "w", "n") for i, t in enumerate(texts)], SCHEMA)
    rows = with_statistics(with_words(df)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])


def test_the_order_of_rules_does_not_change_the_verdict(spark):
    rnd = random.Random(6)
    texts = [" ".join(f"Word{rnd.randrange(500)}" for _ in range(80)) for _ in range(20)]
    texts += [t.upper() for t in texts[:5]] + [t.replace(" ", "!! ") for t in texts[:5]] + [t.replace(" ", " | ") for t in texts[:5]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = with_statistics(with_words(df))
    a = rows.withColumn("kept", verdict(rule_order(df))).select("doc_id", "kept").collect()
    b = rows.withColumn("kept", verdict(list(reversed(RULES)))).select("doc_id", "kept").collect()
    assert sorted(a) == sorted(b)
    assert [k for _, k in sorted(a)] == [True] * 20 + [False] * 15


def test_filters_on_the_verdict_are_planned(spark):
    df = spark.createDataFrame([(1, "a b c " * 30), (2, " ".join(f"word{i}" for i in range(60)))], "doc_id long, text string")
    assert [r.doc_id for r in apply_rules(df).where("kept and not base_failed and n_repeat_words = 0").collect()] == [2]


def test_empty_table(spark):
    assert apply_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_columns_of_any_name_are_kept(spark):
    names = ["words", "text", "row", "copy", "n_words", "body"]
    df = spark.createDataFrame([(1, 2, 3, 4, 5, "some words " * 40)], ", ".join(f"`{n}` {'string' if n == 'body' else 'long'}" for n in names))
    out = Q.apply_rules(df, text_col="body")
    assert out.columns == names + [c for c in Q.COLUMNS[1:] if c != "n_words"]
    r = out.collect()[0]
    assert [r[n] for n in names] == [1, 2, 3, 4, 80, "some words " * 40]


def test_order_by_rejections_among_what_is_left(spark):
    # `same` rejects what `most` does: it is worth nothing after it; `rest` rejects the others
    rules = (Q.Rule("none", "n_words < 0"), Q.Rule("same", "text like '%even%' and text like '%four%'"), Q.Rule("most", "text like '%even%'"),
             Q.Rule("rest", "text like '%odd%'"))
    rows = [(i, ("even " if i % 10 else "odd ") + ("four " if i % 4 == 0 else "") + " ".join(f"w{i}x{k}" for k in range(60))) for i in range(200)]
    order = [r.name for r in Q.rule_order(spark.createDataFrame(rows, "doc_id long, text string"), rules)]
    assert order.index("most") < order.index("same") and order.index("rest") < order.index("none")
