r"""Operator 5 [native]: text quality rules as a short-circuit cascade.

Base statistics of a text (words are runs of characters other than space and
U+0009..U+000D): number of words, code points in words, symbol characters, lines that
repeat an earlier line, and words that lie in a 3-word window found twice or more.

A text fails at the base with under 50 words or with over half of its words in
repeated windows.  The others go through a cascade of further rules.  Each rule's
cost (time of evaluating it alone) and selectivity (share it rejects) are
estimated on a bounded sample; rules run in order of rejection per cost, in one CASE
that stops at the first rule that rejects.  The order changes the time, never
the verdict: a text is kept if no rule rejects it.

Windows are compared by 64-bit hash of their three words.  NULL text: no words, fails
at the base.  Built-in column functions only.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, least_by_hash, stored, table, unwrapped, whole_rows

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
# Rows of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 512
# Copies of the sample over which a rule's time is taken.
SAMPLE_COPIES = 32
_BLANK = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """``rejects``: SQL over ``text``, ``words`` and the statistics."""

    name: str
    rejects: str


_LINES = r"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"
RULES = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("shouting", r"2 * length(regexp_replace(text, '\\P{Lu}+', '')) > length(regexp_replace(text, '\\P{L}+', ''))"),
    Rule("exclamation", "5 * (length(text) - length(replace(text, '!', ''))) > n_words"),
    Rule("repeated_lines", f"n_dup_lines > 2 and n_dup_lines > 0.3 * size({_LINES})"),
    Rule("word_length", "word_chars not between 2 * n_words and 20 * n_words"),
    Rule("few_distinct_words", "10 * size(array_distinct(words)) < n_words"),
)


def with_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``words`` and ``n_words``; the text column is made non-NULL as ``text``."""
    rows = docs.withColumn("text", F.coalesce(F.col(text_col), F.lit("")))
    rows = rows.withColumn("words", F.filter(F.split("text", _BLANK), lambda w: w != ""))
    return rows.withColumn("n_words", F.size("words").cast("long"))


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is computed once.  Columns would not do:
    a filter on the result is pushed below them and repeats each for every use of it."""
    return f"transform(array({value}), {name} -> {body})[0]"


# Words in windows found twice: hashes of the windows; sorted, if any repeats; the places of
# those with an equal neighbour; and what these places cover.
_REPEATED = _let("w", "words", _let(
    "h", "if(size(w) < 3, array(), transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))", _let(
        "s", "if(size(array_distinct(h)) = size(h), array(), array_sort(transform(h, (x, i) -> struct(x as h, i as i))))", _let(
            "p", "array_sort(filter(transform(s, (x, k) -> if((k > 0 and s[k - 1].h = x.h) or "
                 "(k < size(s) - 1 and s[k + 1].h = x.h), x.i, -1)), i -> i >= 0))",
            "aggregate(transform(p, (i, k) -> if(k < size(p) - 1, least(3, p[k + 1] - i), 3)), 0L, (a, x) -> a + x)"))))


def with_statistics(rows: DataFrame) -> DataFrame:
    """Adds the base statistics and ``base_failed`` to the result of ``with_words``."""
    rows = rows.withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
    rows = rows.withColumn("n_symbols", (F.length("text") - F.length(F.regexp_replace("text", f"[{SYMBOLS}]+", ""))).cast("long"))
    rows = rows.withColumn("__lines", F.expr(_LINES))
    rows = rows.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    rows = rows.withColumn("n_repeat_words", F.expr(_REPEATED))
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                           | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return rows.drop("__lines")


def rule_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS,
               text_col: str = "text") -> list[Rule]:
    """The rules by estimated rejections per second, most first, each among the texts that the rules before
    it leave.  The sample is the ``sample_rows`` texts of least hash, the same ones in every run."""
    sample = least_by_hash(docs.select(F.col(f"`{text_col}`").alias("text")), sample_rows, "text")
    sample = stored(with_statistics(with_words(sample)).where("not base_failed"), "rule-sample")
    # how many texts each combination of rules rejects (at most the sample's rows)
    rejected = [F.coalesce(F.expr(r.rejects), F.lit(False)).alias(f"r{k}") for k, r in enumerate(rules)]
    seen = sample.select(*rejected).groupBy(*[f"r{k}" for k in range(len(rules))]).agg(F.count(F.lit(1)).alias("n")).collect()
    # many copies of the sample in one job, so that a rule's own work shows beside the job's
    many = sample.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(SAMPLE_COPIES))))

    def seconds(what: Column) -> float:
        start = time.perf_counter()
        many.agg(F.sum(what)).first()
        return time.perf_counter() - start

    idle = min(seconds(F.col("n_words") + F.col("copy")) for _ in range(2))
    cost = [max(1e-3, seconds(F.expr(r.rejects).cast("int") + F.col("copy")) - idle) for r in rules]
    order, left = [], [tuple(r) for r in seen]
    while len(order) < len(rules):
        n = max(1, sum(r[-1] for r in left))
        k = max((k for k in range(len(rules)) if k not in order), key=lambda k: (sum(r[-1] for r in left if r[k]) + 0.5) / n / cost[k])
        order.append(k)
        left = [r for r in left if not r[k]]
    return [rules[k] for k in order]


def verdict(order: list[Rule]) -> Column:
    """True if no rule rejects; evaluation stops at the first that does."""
    out = F.when(F.col("base_failed"), False)
    for rule in order:
        out = out.when(F.expr(rule.rejects), False)
    return out.otherwise(True)


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS,
                text_col: str = "text") -> DataFrame:
    """``docs`` with the statistics, ``base_failed`` and ``kept``; columns of these names are replaced, others
    stay as they are, whatever their names."""
    order = rule_order(docs, rules, sample_rows, text_col)
    rows = with_statistics(with_words(whole_rows(docs, text=F.col(f"`{text_col}`")))).withColumn("kept", verdict(order))
    return unwrapped(rows, docs.columns, {c: F.col(c) for c in COLUMNS[1:]})


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def query(spark, sf_dir: str) -> DataFrame:
    return apply_rules(id_and_text(table(spark, sf_dir, "documents"))).select(*COLUMNS)


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
  SELECT rid, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
grams AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
          FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2)) AS v(o) GROUP BY rid),
s AS (
  SELECT rid, doc_id, t, w, l, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN lines USING (rid) LEFT JOIN covered USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words
            OR 2 * length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) > length(regexp_replace(t, '\P{{L}}+', '', 'g'))
            OR 5 * (length(t) - length(replace(t, '!', ''))) > n_words
            OR n_dup_lines > greatest(2, 0.3 * len(l))
            OR word_chars NOT BETWEEN 2 * n_words AND 20 * n_words
            OR 10 * len(list_distinct(w)) < n_words) AS kept
FROM b
"""
