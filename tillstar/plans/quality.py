"""Data-quality checks for the star, from its declared constraints.

The warehouse enforces NOT NULL, PRIMARY KEY/UNIQUE, CHECK (domain and
range), FOREIGN KEY, VARCHAR(n) and NUMERIC(p,s) while loading.  Here each
becomes a counting rule and ``quality_report`` returns one row per rule:
``rule, table_name, column_name, violations``.

Cost: one scan of each table and one exchange for all rules.  A row gives an entry for each unique and
foreign key, (domain, value), and one for each row rule that it breaks.  Entries are
counted per (domain, value), before the exchange too, so a hot key costs nothing; there the
dimension's own values and the keys that refer to them meet: a value that the dimension has
twice, or not at all, is a violation.  Long text keys take part as 64-bit fingerprints, and
only texts whose fingerprint is seen twice are compared themselves.
``violating_rows`` returns the offending rows of one rule.
Like SQL CHECK constraints, a NULL value never violates a domain, range,
length or precision rule.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StringType

from tillstar.operators.joins import anti_join, pin_small, semi_join
from tillstar.schema import STAR_TABLES, TableDef
from tillstar.star import Star

_STAR_ATTR = {
    "fact_sales": "fact", "dim_customers": "customers", "dim_products": "products",
    "dim_stores": "stores", "dim_time": "time",
}


@dataclass(frozen=True)
class Rule:
    rule: str          # B1_not_null, B2_primary_key, B2_unique, B3_domain, B4_range, B5_foreign_key,
    table: str         # B8_length, B9_precision
    column: str
    params: tuple = ()


def table_rules(t: TableDef) -> list[Rule]:
    out: list[Rule] = []
    for c in t.columns:
        if not c.nullable:
            out.append(Rule("B1_not_null", t.name, c.name))
    out.append(Rule("B2_primary_key", t.name, t.primary_key))
    for u in t.unique:
        out.append(Rule("B2_unique", t.name, u))
    for col, values in t.domains.items():
        out.append(Rule("B3_domain", t.name, col, tuple(values)))
    for col, rng in t.ranges.items():
        out.append(Rule("B4_range", t.name, col, tuple(rng)))
    for col, (ref_table, ref_col) in t.foreign_keys.items():
        out.append(Rule("B5_foreign_key", t.name, col, (ref_table, ref_col)))
    for c in t.columns:
        if c.max_len is not None:
            out.append(Rule("B8_length", t.name, c.name, (c.max_len,)))
    for c in t.columns:
        if isinstance(c.dtype, DecimalType):
            out.append(Rule("B9_precision", t.name, c.name, (c.dtype.precision, c.dtype.scale)))
    return out


def all_rules() -> list[Rule]:
    return [r for t in STAR_TABLES.values() for r in table_rules(t)]


def _literal(v) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else str(v)


def violation_sql(r: Rule) -> str:
    """Row-level predicate that is TRUE exactly for rows breaking the rule (a NULL in a checked column
    gives NULL or FALSE: it passes, as with SQL CHECK).  Not used for B2/B5.  (As text: a report
    has over a hundred of them, and a column object costs several calls into the JVM.)"""
    c = f"`{r.column}`"
    if r.rule == "B1_not_null":
        return f"{c} IS NULL"
    if r.rule == "B3_domain":
        return f"{c} NOT IN ({', '.join(map(_literal, r.params))})"
    if r.rule == "B4_range":
        low, high, strict_low = r.params
        below = [f"{c} {'<=' if strict_low else '<'} {low}"] if low is not None else []
        return " OR ".join(below + ([f"{c} > {high}"] if high is not None else [])) or "FALSE"
    if r.rule == "B8_length":
        return f"length({c}) > {r.params[0]}"
    if r.rule == "B9_precision":
        return f"{c} IS NOT NULL AND try_cast({c} AS DECIMAL({r.params[0]},{r.params[1]})) IS NULL"
    raise ValueError(f"rule {r.rule} has no row predicate")


def violation_condition(r: Rule) -> Column:
    return F.expr(violation_sql(r))


UNIQUE = ("B2_primary_key", "B2_unique")


# Entries of the one pass: a key value (``id``: its domain) or the set of row rules that a row breaks, as
# bits (``id``: ROWS + the number of the first of them).  ``slot``: 0 for the domain's own
# values, 1.. for the foreign keys that refer to it.
ROWS, MASK_RULES = 1 << 20, 62


def fingerprint(column: str) -> str:
    """64 bits that stand for a text in the first pass."""
    return f"xxhash64(`{column}`)"


def _is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, StringType)


def _entries(df: DataFrame, keys: list[tuple[int, int, str]], row_rules: list[tuple[int, Rule]]) -> DataFrame:
    """One row for each key value of a row (domain, slot, column), and one for the row rules that it breaks, if any."""
    def entry(i: int, slot: int, value: str) -> str:
        return f"named_struct('id', {i}, 'slot', {slot}, 'value', CAST({value} AS BIGINT))"

    found = [entry(i, slot, f"CASE WHEN `{c}` IS NOT NULL THEN {fingerprint(c)} END" if _is_text(df, c) else f"`{c}`") for i, slot, c in keys]
    masks = []
    for at in range(0, len(row_rules), MASK_RULES):
        some = row_rules[at:at + MASK_RULES]
        bits = ", ".join(f"CASE WHEN {violation_sql(r)} THEN {1 << k}L ELSE 0L END" for k, (_, r) in enumerate(some))
        # (folded by a lambda: as one expression they are a method too large for the JVM to compile)
        masks.append(f"aggregate(array({bits}), 0L, (a, b) -> a | b) AS `__mask{len(masks)}`")
        # a row without a violation, as nearly all are, adds no mask
        found.append(entry(some[0][0], 0, f"nullif(`__mask{len(masks) - 1}`, 0L)"))
    return df.selectExpr("*", *masks).selectExpr(f"explode(array({', '.join(found)})) AS e").selectExpr("e.*").where("value IS NOT NULL")


def _repeats(tables: dict[str, DataFrame], texts: list[tuple[int, str, str]], suspects: DataFrame) -> DataFrame:
    """(id, exact): rows beyond the first of each text of a unique column, counted on the texts themselves, but
    only those whose fingerprint was seen twice."""
    parts = [tables[t].where(f"`{c}` IS NOT NULL").selectExpr(f"{i} AS id", f"{fingerprint(c)} AS value", f"`{c}` AS text") for i, t, c in texts]
    per_text = reduce(DataFrame.unionByName, parts).join(suspects.select("id", "value"), ["id", "value"], "left_semi")
    return per_text.groupBy("id", "text").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(F.sum(F.col("n") - 1).alias("exact"))


def quality_report(star: Star, rules: list[Rule] | None = None) -> DataFrame:
    """One row per rule: ``rule, table_name, column_name, violations``.  Runs one job over the tables."""
    tables = star.tables()
    rules = [r for r in (all_rules() if rules is None else rules) if r.column in tables[r.table].columns]
    domains: dict[tuple[str, str], int] = {}
    keys: dict[str, list] = {t: [] for t in tables}
    row_rules: dict[str, list] = {t: [] for t in tables}
    amounts = [""] * len(rules)
    refers: dict[int, int] = {}

    def domain(table: str, column: str) -> int:
        if (table, column) not in domains:
            domains[table, column] = len(domains)
            keys[table].append((domains[table, column], 0, column))
        return domains[table, column]

    for n, r in enumerate(rules):
        if r.rule in UNIQUE:
            amounts[n] = f"CASE WHEN id = {domain(r.table, r.column)} AND n0 > 1 THEN n0 - 1 END"
        elif r.rule == "B5_foreign_key":
            i = domain(*r.params)
            refers[i] = refers.get(i, 0) + 1
            keys[r.table].append((i, refers[i], r.column))
            amounts[n] = f"CASE WHEN id = {i} AND n0 = 0 THEN n{refers[i]} END"
        else:
            row_rules[r.table].append((ROWS + n, r))
    for own in row_rules.values():
        for k, (i, _) in enumerate(own):
            amounts[i - ROWS] = f"CASE WHEN id = {own[k - k % MASK_RULES][0]} AND value & {1 << k % MASK_RULES}L <> 0 THEN n0 END"

    entries = reduce(DataFrame.unionByName, [_entries(df, keys[t], row_rules[t]) for t, df in tables.items() if keys[t] or row_rules[t]])
    counts = entries.groupBy("id", "value").agg(*[F.expr(f"count_if(slot = {k}) AS n{k}") for k in range(max(refers.values(), default=0) + 1)])
    # what breaks a rule: nothing in clean tables, so this is small, and stored for the two uses
    bad = pin_small(counts.where(f"id >= {ROWS} OR n0 <> 1"))

    unique_ids = [domains[r.table, r.column] if r.rule in UNIQUE else -1 for r in rules]
    rows = [f"named_struct('id', {i}, 'rule', {_literal(r.rule)}, 'table_name', {_literal(r.table)}, 'column_name', {_literal(r.column)}, "
            f"'violations', CAST(coalesce(r{n}, 0) AS BIGINT))" for n, (r, i) in enumerate(zip(rules, unique_ids))]
    out = bad.selectExpr(*[f"sum({a}) AS r{n}" for n, a in enumerate(amounts)]).selectExpr(f"explode(array({', '.join(rows)})) AS v").selectExpr("v.*")
    texts = [(i, t, c) for (t, c), i in domains.items() if _is_text(tables[t], c)]
    if texts:
        ids = ", ".join(str(i) for i, _, _ in texts)
        suspects = bad.where(f"id IN ({ids}) AND n0 > 1")
        if not suspects.isEmpty():
            out = out.join(_repeats(tables, texts, suspects), "id", "left").selectExpr(
                "rule", "table_name", "column_name", f"CASE WHEN id IN ({ids}) THEN coalesce(exact, 0L) ELSE violations END AS violations")
    return out.select("rule", "table_name", "column_name", "violations")


def violating_rows(star: Star, rule: Rule) -> DataFrame:
    """The rows of ``rule.table`` that break ``rule``."""
    df = getattr(star, _STAR_ATTR[rule.table])
    if rule.rule == "B5_foreign_key":
        ref_table, ref_col = rule.params
        dim = getattr(star, _STAR_ATTR[ref_table]).select(F.col(ref_col).alias(rule.column))
        return anti_join(df.where(F.col(rule.column).isNotNull()), dim, rule.column)
    if rule.rule in ("B2_primary_key", "B2_unique"):
        dups = df.groupBy(rule.column).count().where(F.col("count") > 1).select(rule.column)
        return semi_join(df.where(F.col(rule.column).isNotNull()), dups, rule.column)
    return df.where(violation_condition(rule))


def restricted_deletes(fact: DataFrame, to_delete: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``ON DELETE RESTRICT``: split dimension rows planned for deletion into
    (blocked: still referenced by the fact, deletable).  The fact's key column is first
    reduced to its distinct keys, where it is read; a semi join with those to delete would be
    pushed below that and move every line."""
    refs = fact.select(key).distinct()
    return semi_join(to_delete, refs, key), anti_join(to_delete, refs, key)


def load_report(star: Star) -> DataFrame:
    """Row count per table plus a grand total (``table_name = 'Total'``)."""
    counts = None
    for name, df in star.tables().items():
        c = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        counts = c if counts is None else counts.unionByName(c)
    out = counts.rollup("table_name").agg(F.sum("row_count").cast("bigint").alias("row_count"),
                                          F.grouping_id().alias("g"))
    return out.select(F.coalesce(F.col("table_name"), F.lit("Total")).alias("table_name"), "row_count",
                      "g").orderBy("g", "table_name").drop("g")
